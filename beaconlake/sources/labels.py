"""Label chunks, verdict files, enrichment tables and result caches."""
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from beaconlake.functions import jsontext

c = F.col


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name and its whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def label_chunks(files: DataFrame, valid: list[str]) -> DataFrame:
    """{row id: [labels]} files to one row per id; the last file wins. Broken files and
    values that are no list are left out, as are unknown labels past the first three."""
    entries = files.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("rid", "raw"))
    rows = entries.select("file", F.try_to_number("rid", F.lit("9999999999999999")).cast("bigint").alias("rid"),
                          F.from_json("raw", "array<string>").alias("labels")).where("rid is not null and labels is not null")
    rows = rows.withColumn("labels", jsontext.valid_labels(c("labels"), valid))
    return rows.groupBy("rid").agg(F.max_by("labels", "file").alias("labels"))


def verdicts(files: DataFrame, valid: list[str]) -> DataFrame:
    """[{id, domains, noise}] files to one verdict per id; the last one wins. No valid label
    counts as noise."""
    rows = files.select("file", F.posexplode(F.from_json("value", "array<struct<id: string, domains: array<string>, noise: boolean>>")).alias("pos", "x"))
    rows = rows.where(F.coalesce("x.id", F.lit("")) != "")
    keep = F.slice(F.filter(F.coalesce("x.domains", F.array().cast("array<string>")), lambda v: v.isin(*valid)), 1, 3)
    rows = rows.select(c("x.id").alias("id"), keep.alias("labels"), (F.coalesce("x.noise", F.lit(False)) | (F.size(keep) == 0)).alias("noise"), "file", "pos")
    return rows.groupBy("id").agg(F.max_by(F.struct("labels", "noise"), F.struct("file", "pos")).alias("v")).select("id", "v.*")


REPO = ("struct<stars: bigint, language: string, forks: bigint, watchers: bigint, open_issues: bigint, contributors: bigint, repo_pushed_at: string, repo_created_at: string, "
        "repo_age_days: double, star_velocity: double, archived: boolean, status: string>")


def repo_table(files: DataFrame) -> DataFrame:
    """{repo: {...}} JSON to a dimension table."""
    return files.select(F.explode(F.from_json("value", f"map<string,{REPO}>")).alias("repo", "x")).select("repo", "x.*")


def enrich_items(items: DataFrame, repos: DataFrame) -> DataFrame:
    """Repository facts onto repository items: stars overwrite, a known language wins, new
    signal keys win over old ones. Other items pass unchanged."""
    keys = ["forks", "watchers", "open_issues", "contributors", "repo_pushed_at", "repo_created_at", "repo_age_days", "star_velocity", "archived"]
    facts = repos.select(c("repo").alias("community"), F.lit("github").alias("source"), F.lit(True).alias("_known"), c("stars").alias("_stars"),
                         c("language").alias("_language"), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_facts"))
    got = items.join(facts, ["source", "community"], "left")
    known = F.coalesce("_known", F.lit(False))
    return (got.withColumn("community_size", F.when(known, c("_stars")).otherwise(c("community_size")))
            .withColumn("language", F.when(known, F.coalesce("_language", "language")).otherwise(c("language")))
            .withColumn("signals", F.when(known, jsontext.merged(c("signals"), c("_facts"))).otherwise(c("signals")))
            .drop("_known", "_stars", "_language", "_facts"))


def relabel(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """New primary and multi labels where there are some; other rows keep theirs."""
    new = labels.select(c("rid").alias(key), c("labels").alias("_labels"))
    got = items.join(new, key, "left")
    return (got.withColumn("domain", F.coalesce(F.get("_labels", F.lit(0)), "domain"))
            .withColumn("domains", F.when(c("_labels").isNotNull(), F.to_json("_labels")).otherwise(c("domains"))).drop("_labels"))


def label_coverage(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Covered, missing and unknown ids in one pass over a full outer join."""
    both = items.select(c(key).alias("k"), F.lit(1).alias("i")).join(labels.select(c("rid").alias("k"), F.lit(1).alias("l")), "k", "full")
    return both.agg(F.count_if(c("i").isNotNull() & c("l").isNotNull()).alias("covered"), F.count_if(c("l").isNull()).alias("missing"),
                    F.count_if(c("i").isNull()).alias("unknown"))


def merged_cache(old: DataFrame, new: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """Two result caches as one: fill gaps only, or let new rows replace old ones."""
    if overwrite:
        return old.join(new.select(key), key, "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(key), key, "left_anti"))
