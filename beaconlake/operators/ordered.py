"""Ordered computations that do not put one key's rows into one task.

The rows are range-partitioned by (keys, order), so a key that holds a third of the data
is cut over many partitions. The partitions are fixed by a reliable checkpoint. Each one is
then worked on alone, and the only thing passed between partitions is one summary row per
partition, so the carried table never grows with the data.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from beaconlake.session import checkpointed

PART = "_part"


def split_sorted(df: DataFrame, by: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partition by `by` and record each row's partition, made stable on storage. With
    no number given Spark starts from its shuffle partitions and merges small neighbours."""
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return checkpointed(ranged.withColumn(PART, F.spark_partition_id()))


def _order_struct(names):
    return F.struct(*[F.col(x) for x in names])


def _partition_ends(rows: DataFrame):
    """The summary rows in partition order; there is one per partition."""
    return sorted(rows.collect(), key=lambda r: r[PART])


def _with_carry(here: DataFrame, carried, key_type, value_type) -> DataFrame:
    """Join what each partition takes over from the ones before it."""
    schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("_k", key_type), T.StructField("_v", value_type)])
    return here.join(F.broadcast(here.sparkSession.createDataFrame(carried, schema)), PART, "left")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                partitions: int | None = None) -> DataFrame:
    """`out` = sum of `value` over the rows of the same key that come earlier in `order`
    (the row itself excluded). `order` must be unique within a key."""
    cut = split_sorted(df, keys + order, partitions)
    local = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = cut.withColumn(out, F.coalesce(F.sum(value).over(local), F.lit(0)))
    key = _order_struct(keys) if keys else F.struct(F.lit(1).alias("one"))
    per_key = cut.groupBy(PART, *keys).agg(F.sum(value).alias("_t"))
    # Only the last key of a partition can go on in the next one.
    last = per_key.groupBy(PART).agg(F.max(key).alias("_k"), F.max_by("_t", key).alias("_t"))
    carried, open_key, open_sum = [], None, None
    for r in _partition_ends(last):
        if open_key is not None:
            carried.append((r[PART], open_key, open_sum))
        open_sum = open_sum + r["_t"] if r["_k"] == open_key else r["_t"]
        open_key = r["_k"]
    types = {f.name: f.dataType for f in last.schema.fields}
    joined = _with_carry(here, carried, types["_k"], types["_t"])
    return (joined.withColumn(out, F.col(out) + F.when(key.eqNullSafe(F.col("_k")), F.col("_v")).otherwise(F.lit(0)))
            .drop(PART, "_k", "_v"))


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                   partitions: int | None = None) -> DataFrame:
    """`out` = `value` of the row just before in the same key, like lag(1)."""
    cut = split_sorted(df, keys + order, partitions)
    local = Window.partitionBy(PART, *keys).orderBy(*order)
    here = cut.withColumns({out: F.lag(value).over(local), "_first": F.row_number().over(local) == 1})
    key, at = _order_struct(keys), _order_struct(keys + order)
    last = cut.groupBy(PART).agg(F.max_by(key, at).alias("_k"), F.max_by(value, at).alias("_v"))
    ends = _partition_ends(last)
    carried = [(after[PART], before["_k"], before["_v"]) for before, after in zip(ends, ends[1:])]
    types = {f.name: f.dataType for f in last.schema.fields}
    joined = _with_carry(here, carried, types["_k"], types["_v"])
    take = F.col("_first") & key.eqNullSafe(F.col("_k"))
    return (joined.withColumn(out, F.when(take, F.col("_v")).otherwise(F.col(out)))
            .drop(PART, "_k", "_v", "_first"))


def numbered(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """0-based position of every row in a global order, without a one-task window."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(ones, [], order, "_one", out).drop("_one")


def value_positions(df: DataFrame, keys: list[str], value: str, copies: str | None = None) -> DataFrame:
    """Distinct values per key with `n` copies, `below` (rows of the key that are strictly
    smaller) and `total` (non-null rows of the key). Equal values are counted before the
    shuffle, so a value that fills a third of the table costs one row. With `copies`, a row
    stands for that many."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.sum(copies).alias("n") if copies else F.count(F.lit(1)).alias("n")))
    ranked = running_sum(counts, keys, [value], "n", "below")
    if not keys:
        totals = ranked.agg(F.sum("n").alias("total"))
        return ranked.withColumn("total", totals.scalar())
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))
    return ranked.join(totals, keys)


def value_at(positions: DataFrame, keys: list[str], value: str, index: Column, out: str) -> DataFrame:
    """Per key, the value that stands at the 0-based `index` of the sorted rows."""
    hit = positions.where((F.col("below") <= index) & (index < F.col("below") + F.col("n")))
    return hit.select(*keys, F.col(value).alias(out))


def linear_percentile(positions: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """Per key, the linearly interpolated percentile (the usual numeric definition)."""
    spot = (F.col("total") - 1) * F.lit(q)
    lo, hi = F.floor(spot), F.ceil(spot)
    near = positions.where((F.col("below") <= hi) & (F.col("below") + F.col("n") > lo))
    inside = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("n"))
    picked = [F.max(F.when(inside(lo), F.col(value))).alias("_lo"),
              F.max(F.when(inside(hi), F.col(value))).alias("_hi"), F.max(spot - lo).alias("_f")]
    got = near.groupBy(*keys).agg(*picked) if keys else near.agg(*picked)
    return got.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))
