"""Streaming twins of the event operators: append, dedup, context join, windows, state."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconlake.functions.dates import utc_text
from beaconlake.operators import ordered
from beaconlake.session import scratch_path

c = F.col


def event_stream(spark: SparkSession, path: str, schema, files=64) -> DataFrame:
    """Files that arrive under `path` as a stream, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Work off everything that is there now and return the written rows. Offsets go to the shared
    folder, so a restart goes on where the last run ended."""
    spark = stream.sparkSession
    path, marks = scratch_path(spark, name), scratch_path(spark, name + "-marks")
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    writer.format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def first_arrivals(stream: DataFrame, key: str, ts: str | None = None, delay="7 days") -> DataFrame:
    """Incremental dedup. Without a time a key passes once for as long as the stream lives, and its
    state grows with the keys; with one, repeats are caught within `delay` and state is dropped."""
    if ts is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def snapshots(log: DataFrame, keys) -> DataFrame:
    """What was shown and how long it held: (keys, signals, shown_seq, next_seq)."""
    shown = log.where("action = 'open_detail'").select(*keys, "signals", c("seq").alias("shown_seq"), (-c("seq")).alias("_back"))
    return ordered.previous_value(shown, list(keys), ["_back"], "shown_seq", "next_seq").drop("_back")


def with_context(feedback: DataFrame, shown: DataFrame, keys) -> DataFrame:
    """Each click joined to what was shown last before it; an unknown item gets no signals."""
    same = [feedback[k] == shown[k] for k in keys]
    held = (shown["shown_seq"] < feedback["seq"]) & (shown["next_seq"].isNull() | (feedback["seq"] <= shown["next_seq"]))
    got = feedback.join(shown, [*same, held], "left").select(feedback["*"], shown["signals"])
    return got.withColumn("signals", F.coalesce("signals", F.array().cast("array<double>")))


def weekly(stream: DataFrame, keys, ts="ts", delay="1 day") -> DataFrame:
    """Monday weeks per key with volume and reach; a week is out once it can no longer change."""
    week = F.window(ts, "7 days", "7 days", "4 days")
    return (stream.withWatermark(ts, delay).groupBy(week, *keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("author", 0.01).alias("reach"))
            .select(utc_text(c("window.start"), "yyyy-MM-dd").alias("week"), *keys, "n", "reach"))


def hourly_activity(stream: DataFrame, keys, weight="weight", span="6 hours", ts="ts", delay="1 hour") -> DataFrame:
    """Weighted activity over the trailing hours, one figure per hour."""
    w = F.window(ts, span, "1 hour")
    return (stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.sum(weight).alias("activity"))
            .select(utc_text(c("window.end"), "yyyy-MM-dd HH:mm").alias("until"), *keys, "activity"))
