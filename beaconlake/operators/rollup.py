"""Per-scope trend views, merged from per-domain summaries without another look at the rows."""
from pyspark.sql import DataFrame, functions as F

from beaconlake.functions import numeric as nm
from beaconlake.operators import trends as tr

c = F.col


def ordered_list(value, *order):
    """The values of a small group as a list in a given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))), lambda s: s.v)


def outside_related(related: DataFrame, scopes: DataFrame, n=4) -> DataFrame:
    """Nearest domains outside a scope: the best similarity to any domain inside. A scope
    that holds everything has none. related: domain, other, sim."""
    rows = tr.scoped(related, scopes.where(~c("breadth")))
    inside = scopes.select("scope", c("domain").alias("other"))
    far = rows.join(inside, ["scope", "other"], "left_anti")
    best = far.groupBy("scope", "other").agg(F.max("sim").alias("sim"))
    return tr.top_n(best, ["scope"], [F.desc("sim"), c("other")], n)


def merged_terms(counts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per scope and term, the sum over the domains' counts. counts: domain, term, n, one row for
    each term of a domain; give it cut lists to sum only those."""
    return tr.scoped(counts, scopes).groupBy("scope", "term").agg(F.sum("n").alias("n"))


def merged_communities(top: DataFrame, scopes: DataFrame, n=6) -> DataFrame:
    """Per scope the most engaged communities, each named once."""
    first = tr.top_n(tr.scoped(top, scopes), ["scope", "community"], [F.desc("engagement"), c("domain")], 1, "again")
    return tr.top_n(first, ["scope"], [F.desc("engagement"), c("community")], n)


def assembled(parts: dict) -> DataFrame:
    """One row per scope with a list per part, in one aggregate: the rows of all parts are put under each
    other, each in a column of its own. parts: name -> (rows with a scope, value, order)."""
    tagged = [rows.select("scope", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")).alias(name)) for name, (rows, value, order) in parts.items()]
    whole = tagged[0]
    for rows in tagged[1:]:
        whole = whole.unionByName(rows, allowMissingColumns=True)
    return whole.groupBy("scope").agg(*[F.transform(F.array_sort(F.collect_list(name)), lambda s: s.v).alias(name) for name in parts])


def kpi_cards(v: DataFrame) -> DataFrame:
    """(scope, place, card): the five figures of a scope's mode. Fixed texts. v: one row per scope with mode, breadth,
    n_domains, reach, mover, best (community) and the numbers of all modes."""
    comma = lambda x: F.format_number(x, 0)
    card = lambda value, label, hint, tone=F.lit(""): F.struct(value.alias("value"), F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"),
                                                               F.lit(hint).alias("hint") if isinstance(hint, str) else hint.alias("hint"), tone.alias("tone"))
    change = nm.fixed_round(c("mover.delta_pp"), 1)
    moved = F.concat(F.when(c("mover.delta_pp") > 0, "+").otherwise(""), F.format_string("%.1f", change), F.lit(" share points this week"))
    every = [card(comma(c("reach")), "People active in your space", F.when(c("breadth"), "across all topics").otherwise(F.concat(F.lit("across your "), c("n_domains").cast("string"), F.lit(" domains")))),
             card(c("mover.label"), F.when(c("mover.direction") == "up", "Heating up fastest").otherwise("Biggest mover this week"), moved, c("mover.direction"))]
    contribute = [card(comma(c("open_issues")), "Open issues you could take", "the directly contributable work"),
                  card(F.concat(c("quick_pct").cast("string"), F.lit("%")), "Are quick wins, under an hour", F.concat(F.lit("median effort about "), c("middle_effort").cast("string"), F.lit(" min"))),
                  card(comma(c("standout")), "Repos with room to be seen", "high activity, few contributors")]
    talk = [card(comma(c("conversations")), "Conversations you could join", "live threads with real traction"),
            card(comma(c("total_engagement")), "Total engagement in your space", "comments + score, all sources"),
            card(F.coalesce("best.community", F.lit("-")), "Most active community", F.coalesce(F.concat(comma(c("best.engagement")), F.lit(" engagement, "), comma(c("best.authors")), F.lit(" voices")), F.lit("no community signal")))]
    watch = [card(c("up").cast("string"), "Topics gaining steam", F.concat(F.lit("of your "), F.when(c("breadth"), c("n_cards")).otherwise(c("n_domains")).cast("string"), F.lit(" domains"))),
             card(comma(c("breakout")), "Breakout items right now", "accelerating fastest"),
             card(comma(c("fresh")), "New this week", "in the last 7 days")]
    of_mode = F.when(c("mode") == "contribute", F.array(*contribute)).when(c("mode").isin("discuss", "promote"), F.array(*talk)).otherwise(F.array(*watch))
    return v.select("scope", F.posexplode(F.concat(F.array(every[0]), F.when(c("mover").isNotNull(), F.array(every[1])).otherwise(F.slice(F.array(every[1]), 1, 0)), of_mode)).alias("place", "card"))
