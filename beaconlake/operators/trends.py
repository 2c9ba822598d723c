"""Trend aggregates. Every table is reduced to (domain, week)-sized counts first; windows
run only over those small counts."""
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake.functions import dates, numeric as nm, text as tx
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.session import checkpointed

c = F.col


def activity(opps: DataFrame) -> DataFrame:
    """The columns trend work needs, with empty authors and communities as NULL."""
    day = F.to_date(F.when(dates.parsed(c("created_at")).isNotNull(), F.substring("created_at", 1, 10)))
    return opps.select(
        "opportunity_id", "source", F.coalesce("domain", F.lit("")).alias("domain"), day.alias("day"),
        F.trunc(day, "week").alias("week"), nm.engagement(c("score"), c("num_comments")).alias("engagement"),
        F.nullif("author", F.lit("")).alias("author"), F.nullif("community", F.lit("")).alias("community"),
        "created_at")


def category_distribution(act):
    return act.groupBy("domain").agg(
        F.count(F.lit(1)).alias("volume"), F.countDistinct("author").alias("authors"),
        nm.fixed_round(F.sum("engagement") / F.count(F.lit(1)), 1).alias("avg_engagement"))


def source_mix(act):
    """Counts per (source, domain) and per source in one pass; domain NULL = all."""
    g = act.rollup("source", "domain").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return g.where("g < 3").select("source", F.when(c("g") == 0, c("domain")).alias("domain"), "n")


def community_activity(act, keys):
    return act.where("community is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("volume"), F.sum("engagement").alias("engagement"),
        F.countDistinct("author").alias("authors"))


def weekly_counts(act):
    """(domain, week) counts with the newest day seen; the only pass over the rows."""
    return act.where("week is not null").groupBy("domain", "week").agg(
        F.count(F.lit(1)).alias("n"), F.max("day").alias("newest"))


def week_axis(weekly):
    """Complete weeks (their Sunday is not after the newest day), or all when none is."""
    newest = weekly.agg(F.max("newest"))
    weeks = weekly.groupBy("week").agg(F.sum("n").alias("total")).withColumn("newest", newest.scalar())
    weeks = weeks.withColumn("complete", F.date_add("week", 6) <= c("newest"))
    some = weeks.agg(F.max("complete"))
    return weeks.withColumn("some", some.scalar()).where(c("complete") | ~c("some")).select("week", "total")


def share_grid(weekly):
    """Every (domain, axis week) with count, week total and share; gaps are zeros. The small
    counts are stored first, so the rows behind them are read once."""
    weekly = checkpointed(weekly)
    axis = week_axis(weekly)
    weeks = axis.agg(F.collect_list(F.struct("week", "total")))
    grid = weekly.select("domain").distinct().withColumn("axis", weeks.scalar())
    grid = grid.select("domain", F.inline("axis"))
    got = grid.join(weekly.select("domain", "week", "n"), ["domain", "week"], "left")
    n = F.coalesce(c("n"), F.lit(0))
    return got.select("domain", "week", n.alias("n"), "total", (n / c("total")).alias("share"))


def share_changes(grid):
    """Every week of the grid with the change of its share against the week before, in points."""
    before = F.lag("share", 1, 0.0).over(Window.partitionBy("domain").orderBy("week"))
    return grid.withColumn("change_pp", (c("share") - before) * 100)


def simple_momentum(weekly):
    """Share change against the domain's previous active week, in points."""
    total = F.sum("n").over(Window.partitionBy("week"))
    s = weekly.select("domain", "week", "n", (c("n") / total).alias("share"))
    prev = F.lag("share").over(Window.partitionBy("domain").orderBy("week"))
    return s.select("domain", "week", "n", "share", nm.fixed_round((c("share") - prev) * 100, 2).alias("delta_pp"))


def momentum(grid):
    """Last complete week against the one before, per domain, plus the rising score."""
    w = Window.partitionBy("domain").orderBy("week")
    whole = Window.partitionBy("domain")
    s = grid.select("*", F.lag("share", 1, 0.0).over(w).alias("prev_share"), F.lag("n", 1, 0).over(w).alias("prev"),
                    F.sum("share").over(w.rowsBetween(-2, 0)).alias("recent"), F.avg("share").over(whole).alias("mean"),
                    F.lead("week").over(w).alias("later")).where("later is null")
    change = c("share") - c("prev_share")
    return s.select(
        "domain", c("week").alias("last_week"), c("n").alias("last"), "prev",
        nm.fixed_round(c("share") * 100, 1).alias("share_last"), nm.fixed_round(c("prev_share") * 100, 1).alias("share_prev"),
        nm.fixed_round(change * 100, 2).alias("delta_pp"),
        F.when(c("prev_share") == 0, 0.0).otherwise(nm.fixed_round(F.try_divide(change, c("prev_share")) * 100, 1)).alias("delta_pct"),
        F.when(c("prev_share") == 0, 1.0).otherwise(nm.fixed_round(F.try_divide(c("share"), c("prev_share")), 2)).alias("momentum"),
        F.when(c("mean") == 0, 1.0).otherwise(nm.fixed_round(F.try_divide(c("recent") / 3, c("mean")), 2)).alias("rising_score"))


def rolling_mean(weekly, since, domains=6, span=2):
    """Rolling mean volume of the largest domains on a zero-filled week grid."""
    weekly = checkpointed(weekly)
    named = weekly.where("domain <> ''")
    size = named.groupBy("domain").agg(F.sum("n").alias("size")).orderBy(F.desc("size"), "domain").limit(domains)
    recent = named.join(size, "domain").where(c("week") >= F.lit(since).cast("date"))
    weeks = recent.agg(F.collect_set("week"))
    grid = size.select("domain").withColumn("weeks", weeks.scalar()).select("domain", F.explode("weeks").alias("week"))
    full = grid.join(recent.select("domain", "week", "n"), ["domain", "week"], "left").fillna(0, ["n"])
    w = Window.partitionBy("domain").orderBy("week").rowsBetween(-(span - 1), 0)
    return full.select("domain", "week", "n", F.avg("n").over(w).alias("smooth"))


def numbered(df, keys, order, out="position"):
    """Every row with its place in its key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(df, keys, order, n, out="position"):
    """First n rows per key; Spark cuts each task's rows to n before the shuffle."""
    return numbered(df, keys, order, out).where(c(out) <= n)


def term_counts(items):
    """(domain, term) counts from titles and tags."""
    words = items.select("domain", F.explode(tx.terms(c("title"), c("tag_list"))).alias("term"))
    return words.groupBy("domain", "term").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(items):
    """Per (domain, tag): count, count of the tag anywhere, all rows of the domain."""
    rows = items.select("domain", F.explode_outer("tag_list").alias("tag"))
    tags = rows.select("domain", F.nullif(F.lower(F.trim("tag")), F.lit("")).alias("tag")).where("tag is not null")
    per = tags.groupBy("domain", "tag").agg(F.count(F.lit(1)).alias("n"))
    everywhere = per.groupBy("tag").agg(F.sum("n").alias("anywhere"))
    size = items.groupBy("domain").agg(F.count(F.lit(1)).alias("size"))
    return per.join(everywhere, "tag").join(size, "domain")


def topic_scores(tag_stats):
    """Tags that can stand as subtopics, scored by share in the domain times concentration."""
    ok = (c("n") >= 4) & tx.valid_topic(c("tag")) & ~tx.names_domain(c("tag"), c("domain"))
    score = (c("n") / c("size")) * (c("n") / (c("anywhere") + 2))
    return tag_stats.where(ok).withColumn("score", score)


def distinctive_topics(tag_stats, n=6):
    """Tags that are both common in a domain and concentrated there."""
    return top_n(topic_scores(tag_stats), ["domain"], [F.desc("score"), c("tag")], n)


def scoped(rows, scopes):
    """Rows once per scope that holds their domain."""
    return rows.join(broadcast_if_small(scopes), "domain")


def newest_in_scope(rows, scopes, at):
    """(scope, newest): from the newest row of each domain."""
    per = rows.groupBy("domain").agg(F.max(at).alias("newest"))
    return scoped(per, scopes).groupBy("scope").agg(F.max("newest").alias("newest"))


def fresh_inflow(rows, scopes, at, days=7):
    """Per scope and source, rows of the last days before the scope's newest row. Only rows that
    are fresh in a scope meet it."""
    newest = newest_in_scope(rows, scopes, at).select("scope", (c("newest") - F.make_dt_interval(days=F.lit(days))).alias("since"))
    cuts = scopes.select("scope", "domain").join(newest, "scope")
    recent = rows.join(broadcast_if_small(cuts), (rows["domain"] == cuts["domain"]) & (c(at) >= c("since")))
    return recent.groupBy("scope", "source").agg(F.count(F.lit(1)).alias("n"))


def limit_filter_limit(rows, scopes, order, first, keep, n):
    """Per scope the first `first` rows, then the filter, then the first n: in that order. A row
    among the first of a scope is among the first of its domain, so domains are cut before
    their rows are given to the scopes."""
    near = top_n(rows, ["domain"], order, first, "_own").drop("_own")
    head = top_n(scoped(near, scopes), ["scope"], order, first, "_cut")
    return top_n(head.where(keep), ["scope"], [c("_cut")], n).drop("_cut")


def narrative(cards):
    """One sentence per scope on what gains and what cools. `cards` has scope, breadth,
    label, delta_pp and direction; the first riser and the last cooler are named."""
    said = cards.groupBy("scope", "breadth").agg(
        F.max_by(F.when(c("direction") == "up", F.concat("label", F.lit(" is gaining momentum (+"), F.format_string("%.1f", nm.fixed_round(c("delta_pp"), 1)),
                                                         F.lit(" share points in the latest week)"))),
                 F.when(c("direction") == "up", F.struct("delta_pp", "label"))).alias("riser"),
        F.max_by(F.when(c("direction") == "down", F.concat("label", F.lit(" is cooling"))),
                 F.when(c("direction") == "down", F.struct(-c("delta_pp"), c("label")))).alias("cooler"))
    where = F.when(c("breadth"), "across all topics").otherwise("in your space")
    parts = F.concat_ws(", while ", "riser", "cooler")
    return said.select("scope", F.when(parts == "", F.concat(F.lit("Activity "), where, F.lit(" is steady week over week.")))
                       .otherwise(F.concat(F.lit("This week "), where, F.lit(", "), parts, F.lit("."))).alias("narrative"))
