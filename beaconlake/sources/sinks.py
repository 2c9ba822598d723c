"""Sinks: append what is new, overwrite, partitioned tables, chunked exports, archives."""
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from beaconlake.operators import ordered

c = F.col
SPAN = 50       # chunks of an export that share an upper folder


def first_arrivals(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the one that arrived first. The rest of the row travels in a struct,
    so repeats are folded before the shuffle."""
    other = [x for x in rows.columns if x != key]
    kept = rows.groupBy(key).agg(F.min_by(F.struct(*other), seq).alias("_r"))
    return kept.select(key, "_r.*").select(*rows.columns)


def append_new(rows: DataFrame, path: str, key: str, seq: str) -> tuple[int, int]:
    """Append the rows whose key the table at `path` lacks; returns (inserted, skipped)."""
    spark = rows.sparkSession
    seen, written = Observation("seen"), Observation("written")
    fresh = first_arrivals(rows.observe(seen, F.count(F.lit(1)).alias("n")), key, seq)
    fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"], seen.get["n"] - written.get["n"]


def overwrite(df: DataFrame, path: str, by: list[str] = ()) -> DataFrame:
    """Replace a table, split by `by` when given, and hand it back as read."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def export_blocks(chunks: DataFrame, path: str) -> DataFrame:
    """Replace a table of numbered chunks, a folder each, and hand it back as read. SPAN chunks in a row share an
    upper folder and one task. So the driver lists the upper folders only, tasks list what they hold, and each
    task moves its own folders into place, where the driver would move one after the other. The schema is known:
    no file is opened for it."""
    parted = chunks.withColumn("span", F.floor(c("chunk") / SPAN))
    last = chunks.agg(F.max("chunk")).first()[0] or 0
    parts = max(chunks.sparkSession.sparkContext.defaultParallelism, int(last) // SPAN + 1)
    (parted.repartition(parts, "span").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .partitionBy("span", "chunk").parquet(path))
    return chunks.sparkSession.read.schema(parted.schema).parquet(path).select(*chunks.columns)


def append_events(events: DataFrame, path: str) -> None:
    """Append-only log as JSON lines."""
    events.write.mode("append").json(path)


def round_robin_chunks(items: DataFrame, order: list[str], size: int, most: int = 16) -> DataFrame:
    """Chunk number per row, dealt in turn over clamp(ceil(rows / size), 1, most) chunks."""
    placed = ordered.numbered(items, order)
    total = placed.agg(F.count(F.lit(1)))
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(total.scalar() / size)))
    return placed.withColumn("_n", n).withColumn("chunk", F.pmod("position", "_n")).drop("_n", "position")


def block_chunks(items: DataFrame, order: list[str], size: int) -> DataFrame:
    """Chunk number per row: runs of `size` rows in order."""
    return ordered.numbered(items, order).withColumn("chunk", F.floor(c("position") / size)).drop("position")


def archive_and_drop(rows: DataFrame, bad: DataFrame, key: str, archive_path: str) -> DataFrame:
    """Write the marked rows to an archive and return the rest."""
    rows.join(bad.select(key), key, "left_semi").write.mode("overwrite").json(archive_path)
    return rows.join(bad.select(key), key, "left_anti")
