"""Data profiles per source. Percentiles are exact and come from counted values."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from beaconlake.functions import dates, jsontext
from beaconlake.operators import ordered

c = F.col
CORE = ["score", "num_comments", "author_reputation", "community", "community_size", "last_activity_at", "language"]
NUMBERS = ["score", "num_comments", "community_size"]


def field_coverage(opps: DataFrame) -> DataFrame:
    """Share of rows per source in which a field holds something (0 and '' do not count)."""
    def filled(name, kind):
        empty = (c(name) == 0) if kind in ("bigint", "double", "int") else (c(name) == "")
        return F.count_if(c(name).isNotNull() & ~empty).alias(name)
    kinds = dict(opps.dtypes)
    tags = F.count_if(~F.coalesce("tags", F.lit("")).isin("", "[]", "null")).alias("tags")
    wide = opps.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *[filled(n, kinds[n]) for n in CORE], tags)
    long = wide.unpivot(["source", "rows"], CORE + ["tags"], "field", "present")
    return long.select("source", "field", "present", "rows")


def numeric_ranges(opps: DataFrame, key="source", fields=NUMBERS, p90_of_n=False) -> DataFrame:
    """min, p50 (middle, interpolated), p90 (a value that occurs) and max per key and field."""
    rows = opps.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c(f).cast("double").alias("v")) for f in fields])))
    placed = ordered.value_positions(rows, [key, "field"], "v")
    at = lambda i: F.max(F.when((c("below") <= i) & (i < c("below") + c("n")), c("v")))
    total = c("total")
    p90 = F.least(total - 1, F.floor(total * 0.9)) if p90_of_n else F.floor((total - 1) * 0.9)
    out = placed.groupBy(key, "field").agg(
        F.min("v").alias("min"), at(F.floor((total - 1) / 2)).alias("_a"), at(F.floor(total / 2)).alias("_b"), at(p90).alias("p90"),
        F.max("v").alias("max"), (F.sum(c("v") * c("n")) / F.sum("n")).alias("mean"))
    return out.select(key, "field", "min", ((c("_a") + c("_b")) / 2).alias("p50"), "p90", "max", "mean")



KIND = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def object_keys(rows: DataFrame, key: str, objects: str) -> DataFrame:
    """(key, name, kind, present, rows, broken): per source and key of a column of JSON objects, how many rows hold
    it with a value of that kind; any keys, in one pass over the rows. `broken` counts texts that are no
    object; a source without keys has one row with a null name."""
    text = F.nullif(F.trim(c(objects)), F.lit(""))
    parsed = F.from_json(text, "map<string,variant>")
    broken = text.isNotNull() & F.try_parse_json(text).isNull()
    kind = F.schema_of_variant("value")
    kind = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(
        F.coalesce(*[F.when(kind == k, v) for k, v in KIND.items()], F.lit("number")))
    sizes = rows.groupBy(c(key).alias("_key")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("broken"))
    found = rows.where(~F.coalesce(broken, F.lit(False))).select(c(key).alias("key"), F.explode(parsed).alias("name", "value"))
    found = found.select("key", "name", kind.alias("kind")).groupBy("key", "name", "kind").agg(F.count(F.lit(1)).alias("present"))
    return sizes.join(found, c("_key").eqNullSafe(c("key")), "left").select(c("_key").alias(key), "name", "kind", "present", "rows", "broken")


def presence(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, pct): the share of rows in which each field holds something, in percent."""
    held = [F.bround(100.0 * F.count_if(c(f).isNotNull() & (c(f).cast("string") != "")) / F.count(F.lit(1)), 1).alias(f) for f in fields]
    return rows.agg(*held).unpivot([], fields, "field", "pct")


def type_counts(opps: DataFrame) -> DataFrame:
    return opps.groupBy("source", "opportunity_type").agg(F.count(F.lit(1)).alias("n"))


def date_range(opps: DataFrame) -> DataFrame:
    day = F.when(c("created_at") != "", F.substring("created_at", 1, 10))
    return opps.groupBy("source").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def thread_profile(posts: DataFrame) -> DataFrame:
    """Shape of discussion threads: size shares, self posts, age in years."""
    n = F.count(F.lit(1))
    return posts.agg(n.alias("posts"), F.bround(100 * F.count_if(c("num_comments") > 10) / n, 0).cast("bigint").alias("over_10_pct"),
                     F.bround(100 * F.count_if(c("num_comments") > 50) / n, 0).cast("bigint").alias("over_50_pct"),
                     F.bround(100 * F.count_if(c("body") != "") / n, 0).cast("bigint").alias("self_pct"),
                     F.bround(100 * F.count_if(F.coalesce(c("body") == "", F.lit(True))) / n, 0).cast("bigint").alias("link_pct"))


def posts_by_year(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.year(dates.parsed(c("created_at"))).alias("year")).agg(F.count(F.lit(1)).alias("n")).where("year is not null")


def median_comments(posts: DataFrame, keys: list[str]) -> DataFrame:
    rows = posts.select(*keys, F.coalesce("num_comments", F.lit(0)).alias("v"))
    placed = ordered.value_positions(rows, keys, "v")
    at = lambda i: F.max(F.when((c("below") <= i) & (i < c("below") + c("n")), c("v")))
    out = placed.groupBy(*keys).agg(F.max("total").alias("posts"), at(F.floor((c("total") - 1) / 2)).alias("_a"), at(F.floor(c("total") / 2)).alias("_b"))
    return out.select(*keys, "posts", ((c("_a") + c("_b")) / 2).alias("median_comments"))
