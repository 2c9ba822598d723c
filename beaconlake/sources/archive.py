"""Hourly public event files: scan, weight, score and enrich repositories."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconlake import lexicon as lx
from beaconlake.functions.numeric import lookup

c = F.col
EVENT = "type string, repo struct<name: string>, created_at string, _corrupt_record string"


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """JSON event lines (`value`) as columns; lines that do not parse are left out."""
    parsed = F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select(parsed.alias("x")).where("x._corrupt_record is null")
    return rows.select("x.type", "x.repo", "x.created_at")


def read_event_files(spark: SparkSession, paths) -> DataFrame:
    """Hourly gzip files of JSON lines."""
    return parse_event_lines(spark.read.text(paths))


def weighted_events(events: DataFrame) -> DataFrame:
    """Events that count, with their weight and repository."""
    weight = lookup(c("type"), lx.ACTIVITY_WEIGHTS)
    rows = events.select("type", c("repo.name").alias("repo"), "created_at", weight.alias("weight"))
    return rows.where(c("weight").isNotNull() & (F.coalesce("repo", F.lit("")) != ""))


def activity_scores(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("repo").agg(F.sum("weight").alias("activity"))


def domain_of_text(text):
    """First domain, in domain order, with a term in the text; else the default."""
    low, expr = F.lower(text), F
    for domain, words in lx.DOMAIN_TERMS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        expr = expr.when(hit, F.lit(domain))
    return expr.otherwise(F.lit(lx.DEFAULT_REPO_DOMAIN))


def active_repos(scores: DataFrame, repos: DataFrame, top=400, star_floor=50) -> DataFrame:
    """The most active repositories, enriched by the repository table and kept when they
    have enough stars. Spark takes each task's best rows before the final sort."""
    best = scores.orderBy(F.desc("activity"), "repo").limit(top)
    got = best.join(repos, "repo").where(F.coalesce("stars", F.lit(0)) >= star_floor)
    words = F.concat_ws(" ", "repo", F.coalesce("language", F.lit("")), F.array_join(F.transform("topics", lambda t: F.lower(t)), " "),
                        F.coalesce("description", F.lit("")))
    return got.withColumn("domain", domain_of_text(words))
