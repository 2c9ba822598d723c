"""Joins that stay even when one key holds a large part of the rows."""
from pyspark.sql import DataFrame, functions as F

SMALL = 10000         # rows a side may have to be broadcast by request
HOT_SHARE = 1000      # a key is hot when it holds more than 1/1000 of the rows: at most 1000 keys


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy per-row work all cores when the scan yields fewer partitions than there are
    cores (one small file). A scan with enough partitions passes unchanged, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Broadcast `df` when it is shown to hold at most `rows` rows; else leave the choice of
    join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, spread: str) -> DataFrame:
    """Left join of `rows` to `table` (unique by `keys`, `count` = rows per key).

    Keys that hold over a thousandth of all rows are at most a thousand, so their lookup
    rows are broadcast. The rest join by shuffle; rows already answered by the broadcast get
    a salted key there, spread by `spread`, so that no key is heavy."""
    total = table.agg(F.sum(count).alias("_all"))
    payload = [c for c in table.columns if c not in keys]
    hot = (table.withColumn("_all", total.scalar()).where(F.col(count) * HOT_SHARE > F.col("_all"))
           .select(*keys, F.struct(*payload).alias("_hot")))
    step = rows.join(F.broadcast(hot), keys, "left")
    salt = F.when(F.col("_hot").isNotNull() | F.isnull(F.col(keys[-1])),
                  F.pmod(F.xxhash64(spread), F.lit(4096)) + 1).otherwise(F.lit(0))
    cold = table.withColumn("_salt", F.lit(0).cast("long"))
    got = step.withColumn("_salt", salt.cast("long")).join(cold, keys + ["_salt"], "left")
    for c in payload:
        got = got.withColumn(c, F.coalesce(F.col(f"_hot.{c}"), F.col(c)))
    return got.drop("_hot", "_salt")

