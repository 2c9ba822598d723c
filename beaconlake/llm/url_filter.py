"""URL filter lists as of the fetch, with DataFrame operations only.

A list is a log of dated entries: (key, day, action), where a key is a host, a domain or a
host with its first path segment. Entries become validity intervals: an entry holds until the
next one of its key. Intervals and captures are cut into slices of the calendar, so the as-of
join is an equi-join on (key, slice) with the interval as its condition: a key that holds a third
of the captures is split by Spark's skew handling, and a key with a long history is cut by slice.
Every capture looks up all keys that can cover its URL; the most specific active entry decides.

Defined results: a null or host-less URL, a null day, and a URL without an active entry are
allowed, with null rule columns; among entries of one key and day the alphabetically last action
holds, equal entries count once; entries without key, day or action are ignored; repeated captures each get
their row; empty tables give empty or all-allowed results. Column names of the captures other
than those named are not read, so none can clash.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE_DAYS = 64
ALLOW = "allow"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user part and port; null without one."""
    found = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def segment_of(url: Column) -> Column:
    """First path segment, '' without one."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def candidate_keys(host: Column, segment: Column) -> Column:
    """Array of (kind, key) that may cover a URL. A larger kind is more specific: 1000 for host
    and first path segment, 500 for the host, else the number of labels of a domain with all
    its subdomains (`*.example.org` also covers example.org)."""
    labels = F.split(host, "\\.")
    count = F.size(labels)
    domains = F.transform(F.sequence(F.lit(2), F.greatest(count, F.lit(2))), lambda n: F.struct(
        n.alias("kind"), F.concat(F.lit("*."), F.array_join(F.slice(labels, F.greatest(count - n + 1, F.lit(1)), n), ".")).alias("key")))
    own = F.array(F.struct(F.lit(1000).alias("kind"), F.concat(host, F.lit("/"), segment).alias("key")),
                  F.struct(F.lit(500).alias("kind"), host.alias("key")))
    return F.concat(own, domains)


def intervals(entries: DataFrame, last_day: int, slice_days: int = SLICE_DAYS) -> DataFrame:
    """(key, day, action) as (key, slice, listed, to_day, action): the interval an entry holds,
    one row for each slice it touches up to `last_day`. `to_day` is exclusive, null: still open."""
    at = F.floor(F.col("day") / F.lit(slice_days)).cast("long")
    clean = (entries.select("key", F.col("day").cast("long").alias("day"), "action").dropna()
             .groupBy("key", "day").agg(F.max("action").alias("action")).withColumn("slice", at))
    # Within a slice an entry holds until the next one; a slice's last entry runs on to the next slice that has any.
    inside = Window.partitionBy("key", "slice").orderBy("day")
    own = clean.withColumn("next", F.lead("day").over(inside))
    per_key = Window.partitionBy("key").orderBy("slice")               # one row for each slice of the calendar
    later = (clean.groupBy("key", "slice").agg(F.min("day").alias("begin"))
             .withColumn("after", F.lead("begin").over(per_key)).drop("begin"))
    spans = own.join(later, ["key", "slice"]).withColumn("to_day", F.coalesce("next", "after"))
    end = F.least(F.coalesce(F.col("to_day") - 1, F.lit(last_day)), F.lit(last_day))
    last = F.floor(end / F.lit(slice_days)).cast("long")
    return (spans.where(F.col("day") <= last_day)
            .select("key", F.col("day").alias("listed"), "to_day", "action", F.explode(F.sequence("slice", F.greatest(last, F.col("slice")))).alias("slice")))


def verdicts(captures: DataFrame, entries: DataFrame, identity: str, url: str, day: str, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Per capture: id, url, day, host, verdict, and the deciding entry's rule, kind and listed day."""
    own = captures.select(F.col(identity).alias("id"), F.col(url).alias("url"), F.col(day).cast("long").alias("day"))
    own = own.withColumns({"host": host_of(F.col("url")), "slice": F.floor(F.col("day") / F.lit(slice_days)).cast("long")})
    last_day = own.agg(F.max("day").alias("day")).first()["day"]
    spans = intervals(entries, last_day if last_day is not None else 0, slice_days).withColumnsRenamed({"key": "rule", "slice": "_slice"})
    asked = own.where("host is not null and day is not null").select(
        "url", "host", "day", "slice", F.explode(candidate_keys(F.col("host"), segment_of(F.col("url")))).alias("try"))
    hit = asked.join(spans, (F.col("try.key") == F.col("rule")) & (F.col("slice") == F.col("_slice"))
                     & (F.col("listed") <= F.col("day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day"))))
    best = (hit.groupBy("url", "day").agg(F.max(F.struct(F.col("try.kind").alias("kind"), "rule", "listed", "action")).alias("best"))
            .select(F.col("url").alias("_url"), F.col("day").alias("_day"), "best"))
    return (own.join(best, (F.col("url") == F.col("_url")) & (F.col("day") == F.col("_day")), "left")
            .select("id", "url", "day", "host", F.coalesce("best.action", F.lit(ALLOW)).alias("verdict"),
                    F.col("best.rule").alias("rule"), F.col("best.kind").alias("kind"), F.col("best.listed").alias("listed")))
