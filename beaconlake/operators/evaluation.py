"""Ranking quality from graded rows, and persona acceptance checks."""
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import numeric as nm

c = F.col


def exponential_gain(grade):
    return F.pow(F.lit(2.0), grade) - 1


def dcg(gain, rank):
    return F.sum(gain / F.log2(rank + 1))


def ndcg(ranked: DataFrame, pool: DataFrame, k: int, gain=exponential_gain) -> DataFrame:
    """NDCG@k per persona. ranked: persona, rank, grade (0 outside the pool). The ideal order
    comes from the pool's grades, of which only the k best per persona move."""
    got = ranked.where(c("rank") <= k).groupBy("persona").agg(dcg(gain(c("grade")), c("rank")).alias("dcg"))
    best = pool.withColumn("r", F.row_number().over(Window.partitionBy("persona").orderBy(F.desc("grade")))).where(c("r") <= k)
    ideal = best.groupBy("persona").agg(dcg(gain(c("grade")), c("r")).alias("ideal"))
    return ideal.join(got, "persona", "left").select("persona", F.when(c("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / c("ideal")).otherwise(0.0).alias("ndcg"))


def share_relevant(ranked: DataFrame, k: int) -> DataFrame:
    """Share of the shown rows (not of k) with a grade of at least 1."""
    return ranked.where(c("rank") <= k).groupBy("persona").agg((F.count_if(c("grade") >= 1) / F.count(F.lit(1))).alias("precision"))


def judged(pool: DataFrame, judgments: DataFrame, fallback) -> DataFrame:
    """Known grades where there are some, the keyword grade elsewhere."""
    return pool.join(judgments, ["persona", "id"], "left").withColumn("grade", F.coalesce("judged", fallback))


def acceptance(top: DataFrame, basket: DataFrame, lane: DataFrame, median_age) -> DataFrame:
    """The 13 pass or fail checks, four persona shapes, as (persona, check, passed).

    top: persona, mode, source, language, domain_list, opportunity_type, age, velocity,
    whitelist, barred of the first ten; basket: persona, effort_min; lane: persona, standout."""
    inside = F.arrays_overlap("domain_list", "whitelist")
    general = F.arrays_overlap("domain_list", F.array(*[F.lit(x) for x in ("beginner_coding", "frontend_web", "mobile_dev", "gamedev_cpp")]))
    kinds = c("opportunity_type").isin("post", "story", "comment_thread")
    g = top.groupBy("persona", "mode").agg(
        F.count_if(c("source") == "github").alias("github"), F.count_if(F.array_contains("barred", F.lower(F.coalesce("language", F.lit(""))))).alias("barred_n"),
        F.count_if(inside).alias("inside"), F.count_if(kinds | (c("opportunity_type") == "issue")).alias("talk_or_issue"), F.count_if(kinds).alias("talk"),
        F.count_if(general).alias("general"), F.expr("percentile(age, 0.5)").alias("age"), F.avg("velocity").alias("velocity"), F.countDistinct("source").alias("sources"))
    g = g.join(basket.groupBy("persona").agg(F.max("effort_min").alias("longest")), "persona", "left")
    g = g.join(lane.groupBy("persona").agg(F.max("standout").alias("best")), "persona", "left").withColumn("corpus_age", median_age)
    check = lambda mode, name, ok: F.struct(F.lit(mode).alias("m"), F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"))
    checks = F.array(
        check("contribute", "three repositories", c("github") >= 3), check("contribute", "no barred language", c("barred_n") == 0),
        check("contribute", "six in own domains", c("inside") >= 6), check("contribute", "short basket", c("longest") <= 75),
        check("discuss", "six in own domains", c("inside") >= 6), check("discuss", "six discussions", c("talk_or_issue") >= 6),
        check("discuss", "a standout repository", c("best") >= 0.5), check("monitor", "fresher than corpus", c("age") < c("corpus_age")),
        check("monitor", "fast movers", c("velocity") >= 0.6), check("monitor", "two sources", c("sources") >= 2),
        check("promote", "six in own domains", c("inside") >= 6), check("promote", "six threads", c("talk") >= 6),
        check("promote", "little general coding", c("general") <= 2))
    return g.select("persona", "mode", F.inline(checks)).where(c("m") == c("mode")).select("persona", "check", "passed")
