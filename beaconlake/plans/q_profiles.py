"""Profile and persona operators."""
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import numeric as nm, text as tx
from beaconlake.operators import personas as ps, splits
from beaconlake.plans import testbed as tb
from beaconlake.plans.registry import query

c = F.col


def personas(spark, d):
    """Customer profiles as personas, with their own skill words."""
    prof = tb.profiles(spark, d)
    base = ps.persona_from_profile(prof).drop("skills")
    base = base.join(prof.select("user_id", c("skill_words").alias("skills"), "avoid"), "user_id")
    return ps.enriched(base)


def P(body):
    return "WITH " + tb.PROF + body


@query("PRJ-13", P("""SELECT user_id, profile_key AS id, name, array_to_string(interests, '|') AS interests, the_goal AS goal, array_to_string(plats, '|') AS platforms,
  array_to_string(doms, '|') AS domains, array_to_string(langs, '|') AS exclude_languages, time_budget_hours FROM pers"""))
def profile_to_persona(spark, d):
    p = ps.persona_from_profile(tb.profiles(spark, d))
    join = lambda x: F.array_join(x, "|").alias(x)
    return p.select("user_id", "id", "name", join("interests"), "goal", join("platforms"), join("domains"), join("exclude_languages"), "time_budget_hours")


@query("TXT-10", P("""SELECT user_id, CASE WHEN contains(name, '—') THEN trim(split_part(name, '—', 1)) WHEN contains(name, ' - ') THEN trim(split_part(name, ' - ', 1))
  WHEN contains(name, '–') THEN trim(split_part(name, '–', 1)) ELSE trim(name) END AS first_part,
  CASE WHEN contains(name, '—') THEN trim(split_part(name, '—', 2)) WHEN contains(name, ' - ') THEN trim(split_part(name, ' - ', 2))
  WHEN contains(name, '–') THEN trim(split_part(name, '–', 2)) ELSE '' END AS role,
  array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS display,
  substr(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 20) AS slug FROM prof"""))
def names(spark, d):
    p = tb.profiles(spark, d).withColumn("nr", tx.name_and_role(c("name")))
    return p.select("user_id", c("nr.name").alias("first_part"), c("nr.role").alias("role"), tx.display_name(c("name")).alias("display"),
                    tx.slug(c("name"), "profile").alias("slug"))


@query("TXT-14", P("SELECT user_id, experience FROM pers"))
def experience(spark, d):
    return personas(spark, d).select("user_id", "experience")


@query("TXT-15", P("SELECT user_id, mode FROM pers"))
def mode(spark, d):
    return personas(spark, d).select("user_id", "mode")


_LABELS = "list_transform(list_slice(doms, 1, 3), lambda d: " + tb.sql_case("d", lx.DOMAIN_LABELS, "") + ")"
_PHRASE = (f"CASE len(doms) WHEN 0 THEN 'a broad range of technology' WHEN 1 THEN ({_LABELS})[1] ELSE "
           f"array_to_string(list_slice({_LABELS}, 1, len({_LABELS}) - 1), ', ') || ' and ' || ({_LABELS})[len({_LABELS})] END")


@query("TXT-18", P(f"SELECT user_id, {_PHRASE} AS phrase FROM pers"))
def domain_phrase(spark, d):
    return personas(spark, d).select("user_id", tx.domain_phrase(c("domains")).alias("phrase"))


@query("TXT-16", P(f"""SELECT user_id, 'You want to ' || {tb.sql_case('mode', lx.MODE_VERBS, '')} || ', focused on ' || {_PHRASE} || '. ' || {tb.sql_case('experience', lx.EXPERIENCE_CLAUSES, '')}
  || 'With about ' || CAST(time_budget_hours AS BIGINT) || ' hours a week, here is a mix that puts your time where it counts'
  || CASE WHEN avoid = '' THEN '.' ELSE ', and steers clear of ' || regexp_replace(trim(avoid), '\\.+$', '') || '.' END || ' Move any slider, or set one to zero to drop it.' AS read FROM pers"""))
def plan_read(spark, d):
    return personas(spark, d).select("user_id", tx.plan_read(
        c("mode"), c("experience"), c("domains"), F.floor(c("time_budget_hours") + 0.5), c("avoid")).alias("read"))


# Shares a user set by hand: whole numbers of the row, some of them zero.
HAND = "[c_custkey % 7, c_custkey % 5, c_custkey % 3, c_nationkey % 4]"


def hand_split(spark, d):
    return tb.profiles(spark, d).withColumn("hand", F.array(c("c_custkey") % 7, c("c_custkey") % 5, c("c_custkey") % 3, c("c_nationkey").cast("bigint") % 4))


def remainder_sql(arr, source):
    """Largest remainder over a four-element array column, as SQL text."""
    return f"""SELECT *, list_transform(fl, lambda f, i: f + CASE WHEN len(list_filter(rs, lambda y, j: y > rs[i] OR (y = rs[i] AND j < i))) < 100 - list_sum(fl) THEN 1 ELSE 0 END) AS split FROM
  (SELECT *, list_transform(sc, lambda s: CAST(floor(s) AS INTEGER)) AS fl, list_transform(sc, lambda s: s - floor(s)) AS rs FROM
  (SELECT *, list_transform({arr}, lambda x: CAST(x AS DOUBLE) * 100e0 / CASE WHEN list_sum({arr}) = 0 THEN 1e0 ELSE CAST(list_sum({arr}) AS DOUBLE) END) AS sc FROM {source}) q1) q2"""


@query("MTH-08", P(f"SELECT user_id, array_to_string(split, ',') AS split FROM ({remainder_sql('hand', f'(SELECT *, {HAND} AS hand FROM prof) q0')}) t WHERE list_sum(hand) > 0"))
def round_to_hundred(spark, d):
    p = hand_split(spark, d).where(F.aggregate("hand", F.lit(0).cast("bigint"), lambda a, x: a + x) > 0)
    return p.select("user_id", F.array_join(splits.largest_remainder(c("hand")).cast("array<string>"), ",").alias("split"))


_BASE = "CASE mode " + " ".join(f"WHEN '{m}' THEN {[s[b] for b in lx.BUCKETS]}" for m, s in lx.SPLIT_BASE.items()) + " END"
REC = (f"SELECT *, [base[1] - mv, base[2] + mv, base[3], base[4]] AS shifted FROM (SELECT *, CASE experience WHEN 'newbie' THEN greatest(0, least(12, base[1] - 8)) "
       f"WHEN 'expert' THEN -greatest(0, least(8, base[2] - 6)) ELSE 0 END AS mv FROM (SELECT *, {_BASE} AS base FROM pers) b0) b1")
REC_SPLIT = remainder_sql("shifted", f"({REC}) b2")


@query("MTH-09", P(f"SELECT user_id, mode, experience, array_to_string(split, ',') AS split FROM ({REC_SPLIT}) t"))
def recommended_split(spark, d):
    return personas(spark, d).select("user_id", "mode", "experience", F.array_join(
        splits.recommended_split(c("mode"), c("experience")).cast("array<string>"), ",").alias("split"))


_PRIOR = "list_transform(split, lambda p: CASE WHEN p > 0 THEN floor((0.80e0 + 0.45e0 * (CAST(p AS DOUBLE) / list_max(split))) * 1e4 + 0.5) / 1e4 END)"


@query("MTH-07", P(f"""SELECT user_id, array_to_string(list_transform({_PRIOR}, lambda x: CASE WHEN x IS NULL THEN '-' ELSE CAST(CAST(floor(x * 1e4 + 0.5) AS BIGINT) AS VARCHAR) END), ',') AS prior
  FROM ({remainder_sql('hand', f'(SELECT *, {HAND} AS hand FROM prof) q0')}) t WHERE list_sum(hand) > 0"""))
def bucket_prior(spark, d):
    p = hand_split(spark, d).where(F.aggregate("hand", F.lit(0).cast("bigint"), lambda a, x: a + x) > 0)
    p = p.withColumn("split", splits.largest_remainder(c("hand")))
    shown = F.transform(splits.bucket_prior(c("split")), lambda x: F.coalesce(F.floor(x * 1e4 + 0.5).cast("string"), F.lit("-")))
    return p.select("user_id", F.array_join(shown, ",").alias("prior"))


@query("PRJ-14", P("""SELECT user_id, array_to_string(list_concat(list_concat(CASE WHEN hand[1] > 0 THEN ['github'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN hand[2] > 0 THEN ['devto'] ELSE CAST([] AS VARCHAR[]) END),
  list_concat(CASE WHEN hand[3] > 0 THEN ['reddit', 'bluesky'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN hand[4] > 0 THEN ['hackernews'] ELSE CAST([] AS VARCHAR[]) END)), ',') AS sources,
  CAST(len(list_filter(hand, lambda x: x > 0)) AS BIGINT) AS active_buckets FROM (SELECT *, """ + HAND + """ AS hand FROM prof) t"""))
def split_to_sources(spark, d):
    return hand_split(spark, d).select("user_id", F.array_join(splits.split_sources(c("hand")), ",").alias("sources"),
                                       F.size(F.filter("hand", lambda x: x > 0)).cast("bigint").alias("active_buckets"))
