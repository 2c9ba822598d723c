"""Mergeable approximate aggregates, all combined on the map side."""
import math

from pyspark.sql import Column, DataFrame, functions as F

LG_K = 14
TRACKED = 16384         # items a frequency sketch holds: estimates stay within 3.5 / 16384 of the stream


def reach_sketches(rows: DataFrame, keys, value="author") -> DataFrame:
    """One distinct-count sketch per key."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, LG_K).alias("sketch"))


def merged_reach(sketches: DataFrame, keys) -> DataFrame:
    """Union of sketches per key, without another pass over the rows."""
    whole = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("reach")
    return sketches.groupBy(*keys).agg(whole) if keys else sketches.agg(whole)


def frequency_sketches(rows: DataFrame, keys, item: str, tracked=TRACKED) -> DataFrame:
    """One sketch of the frequent items per key; sketches of parts combine."""
    sketch = F.expr(f"approx_top_k_accumulate({item}, {tracked})").alias("sketch")
    return rows.groupBy(*keys).agg(sketch) if keys else rows.agg(sketch)


def frequent(sketches: DataFrame, k: int, item: str) -> DataFrame:
    """(item, estimate) of the k most frequent items over all sketches together."""
    top = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {k})")
    return sketches.agg(top.alias("top")).select(F.inline("top")).select(F.col("item").alias(item), F.col("count").alias("estimate"))


def count_min_size(eps: float, delta: float) -> tuple[int, int]:
    """(width, depth) of a count-min table that is over by more than eps of the stream with a
    probability of at most delta."""
    return max(2, math.ceil(math.e / eps)), max(1, math.ceil(math.log(1 / delta)))


def count_min_cells(item: Column, width: int, depth: int) -> Column:
    """The cells of an item, one per row of the table: (row, bucket). Two hashes make all of them."""
    digest = F.md5(item.cast("string").cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    step = number(9).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), ((number(1) + i * step) % width).alias("bucket")))


def count_min(rows: DataFrame, keys, item: str, width: int, depth: int, weight: str | None = None) -> DataFrame:
    """(keys, row, bucket, n): the count-min table of each key, at most width * depth cells. Cells are
    summed where the rows lie."""
    amount = F.col(weight) if weight else F.lit(1)
    cells = rows.where(F.col(item).isNotNull()).select(*keys, amount.alias("_n"), F.inline(count_min_cells(F.col(item), width, depth)))
    return cells.groupBy(*keys, "row", "bucket").agg(F.sum("_n").alias("n"))


def merged_count_min(tables: DataFrame, keys=()) -> DataFrame:
    """Tables of parts added up: the table of the whole."""
    return tables.groupBy(*keys, "row", "bucket").agg(F.sum("n").alias("n"))


def count_min_estimates(table: DataFrame, items: DataFrame, item: str, width: int, depth: int) -> DataFrame:
    """The items with `estimate`: the least of their cells, never below the true count. One table has at
    most width * depth rows, so it is broadcast."""
    asked = items.withColumn("_cell", F.explode(count_min_cells(F.col(item), width, depth)))
    cells = F.broadcast(table.select(F.struct("row", "bucket").alias("_cell"), F.col("n").alias("_n")))
    return asked.join(cells, "_cell", "left").groupBy(*items.columns).agg(F.min(F.coalesce("_n", F.lit(0))).alias("estimate"))
