"""Profiles and personas as tables: one row each, never a loop."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import text as tx
from beaconlake.functions.numeric import lookup


def _strings(values):
    return F.array(*[F.lit(v) for v in values])


def persona_from_profile(profiles):
    """A saved profile as a rankable persona: canonical keys, defaults, parsed limits."""
    domains = F.transform(F.col("domains"), lambda d: F.coalesce(lookup(d, lx.DOMAIN_ALIASES), d))
    platforms = F.transform(F.col("platforms"), lambda p: F.coalesce(lookup(p, lx.PLATFORM_ALIASES), p))
    limits = F.transform(F.split(F.coalesce(F.col("avoid"), F.lit("")), "[,/;]"), lambda x: F.trim(x))
    given = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return profiles.select(
        "user_id", given("profile_key", "custom").alias("id"), given("name", "You").alias("name"),
        F.when(F.size(domains) == 0, _strings(["technology", "open source"]))
        .otherwise(F.transform(domains, tx.domain_label)).alias("interests"),
        given("goal", "Find relevant opportunities to contribute to and discuss").alias("goal"),
        F.when(F.size(platforms) == 0, _strings(lx.SOURCES)).otherwise(platforms).alias("platforms"),
        domains.alias("domains"), F.filter(limits, lambda x: x != "").alias("exclude_languages"),
        F.coalesce(F.col("time_budget_hours"), F.lit(5.0)).alias("time_budget_hours"),
        F.coalesce(F.col("goal"), F.lit("")).alias("skills"))


def mode_of(personas):
    words = F.concat_ws(" ", F.col("goal"), F.array_join("interests", " "))
    return tx.engagement_mode(F.col("id"), words, F.try_element_at("platforms", F.lit(1)))


def experience_of(personas):
    return tx.experience(F.concat_ws(" ", "goal", "skills", "name", F.array_join("interests", " ")))


def allowed_sources(platforms):
    """Known sources among the platforms; all of them when none is known."""
    mapped = F.transform(platforms, lambda p: F.when(F.lower(p) == "blogs", "devto").otherwise(F.lower(p)))
    known = F.array_distinct(F.filter(mapped, lambda p: p.isin(*lx.SOURCES)))
    return F.when(F.size(known) == 0, _strings(lx.SOURCES)).otherwise(known)


def enriched(personas):
    """Adds mode, experience, allowed sources and lower-cased language limits."""
    return personas.withColumns({"mode": mode_of(personas), "experience": experience_of(personas),
                                 "allowed": allowed_sources(F.col("platforms")), "barred": F.transform("exclude_languages", F.lower)})


def profile_text(goal, interests, skills):
    return F.trim(F.concat(goal, F.lit(". Interests: "), F.array_join(interests, ", "), F.lit(". "), skills))


def facets(personas):
    """One row per query text of a persona: its goal, then each interest."""
    texts = F.filter(F.concat(F.array("goal"), F.col("interests")), lambda f: f != "")
    return personas.select("id", F.posexplode(texts).alias("facet_pos", "facet"))
