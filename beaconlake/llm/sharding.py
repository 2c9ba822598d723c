"""Shards of near-equal bytes from sampled splitters, with DataFrame operations only.

Rows are ordered by (hash of the text, id). A size-weighted sample of the keys gives quantile
boundaries, which cut the key space into ranges. The exact rows of each range are then counted
and an overfull one is subdivided: by equal steps of the key, and, where one text alone overfills
it, by a hash of the id. Prefix sums over these pieces say how many bytes and rows lie before
each, so every row's place is known from its own piece alone, and equal cuts of the byte total
give the shards. Equal texts stay together unless a group exceeds a hundredth of a shard.

Defined results: a null text has size 1 and checksum 0; rows that are equal in id and text get
places in any order among themselves; more shards than rows leave some shards empty; an empty
table gives an empty result. `shards` returns columns of its own, so no input name can clash.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconlake.llm.prefix import running
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.session import checkpointed

SAMPLE = 16384          # keys drawn for the splitters, about
RANGES = 64             # ranges cut from the sample
PIECE = 1024            # rows a piece of a range should hold; one text with more rows is cut
WHOLE_GROUP = 100       # groups above 1/100 of a shard may be cut
UNIT = ["range", "step", "hot", "salt"]


def measured(docs: DataFrame, identity: str, text: str) -> DataFrame:
    """(id, size, text_crc32, key): what sharding needs of a row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(identity).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"))


def splitters(rows: DataFrame, total: int, ranges: int = RANGES, sample: int = SAMPLE) -> list[int]:
    """Quantile boundaries of the size-weighted keys, ascending and distinct. A row of size s is
    drawn s * sample / total times, the fraction decided by a hash of the row: reruns agree."""
    luck = F.pmod(F.xxhash64("id", "key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draws = F.floor(F.col("size") * F.lit(float(sample) / total) + luck).cast("long")
    points = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    got = rows.select("key", draws.alias("draws")).where("draws > 0").agg(F.expr(f"percentile(key, array({points}), draws)").alias("at")).first()["at"]
    return sorted({int(x) for x in got or []})


def _at(bounds: list[int], index: Column, shift: int, edge: int) -> Column:
    """The bound `shift` places after `index`, `edge` beyond either end."""
    if not bounds:
        return F.lit(float(edge))
    return F.coalesce(F.get(F.array(*[F.lit(float(b)) for b in bounds]), index + shift), F.lit(float(edge)))


def pieces(rows: DataFrame, bounds: list[int], piece: int = PIECE) -> DataFrame:
    """rows with the ordered place of their piece: range, step in the range, the key of a text
    that overfills a piece (else null), and the salt that cuts such a text."""
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("key")))
    ranged = rows.withColumn("range", place)
    steps = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).alias("steps"))        # one row per range
    low, high = _at(bounds, F.col("range"), -1, -(1 << 63)), _at(bounds, F.col("range"), 0, 1 << 63)
    step = F.least(F.col("steps") - 1, F.floor((F.col("key").cast("double") - low) / (high - low) * F.col("steps"))).cast("long")
    hot = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > piece)
                       .select(F.col("key").alias("hot"), F.ceil(F.col("rows") / F.lit(piece)).alias("cuts")))
    # Rows that share the id as well are cut by their number; they are equal, so which is which does not matter.
    twin = checkpointed(rows.groupBy(F.col("key").alias("_key"), F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > piece)
                        .select("_key", "_id", F.lit(True).alias("twin")))
    salt = F.xxhash64("id", F.when(F.col("twin"), F.col("serial")).otherwise(F.lit(0)), F.lit("salt"))
    return (ranged.join(F.broadcast(steps), "range").withColumn("step", step).drop("steps")
            .join(hot, F.col("key") == F.col("hot"), "left")
            .join(broadcast_if_small(twin), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
            .withColumn("salt", F.when(F.col("cuts").isNotNull(), F.pmod(salt, F.col("cuts"))).otherwise(F.lit(0))).drop("cuts", "_key", "_id", "twin", "serial"))


def shards(docs: DataFrame, count: int = 8, identity: str = "doc_id", text: str = "text",
           ranges: int = RANGES, piece: int = PIECE) -> DataFrame:
    """Per document: id, size, text_crc32, shard (0 to count - 1) and slot (gapless from 0)."""
    rows = checkpointed(measured(docs, identity, text).withColumn("serial", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 1
    cut = pieces(rows, splitters(rows, total, ranges), piece)
    sums = cut.groupBy(*UNIT).agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    ahead = running(sums, UNIT, {"bytes_before": "_bytes", "rows_before": "_rows"}).drop("_bytes", "_rows")
    ahead = ahead.select(*[F.col(c).alias(f"_{c}") for c in UNIT], "bytes_before", "rows_before")
    same = (F.col("range") == F.col("_range")) & (F.col("step") == F.col("_step")) & F.col("hot").eqNullSafe(F.col("_hot")) & (F.col("salt") == F.col("_salt"))
    inside = Window.partitionBy(*UNIT).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*UNIT, "key")
    placed = (cut.join(ahead, same)
              .withColumns({"start": F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)),
                            "row": F.col("rows_before") + F.count(F.lit(1)).over(inside)})
              .withColumns({"first": F.min("start").over(group), "weight": F.sum("size").over(group)}))
    together = F.col("hot").isNull() & (F.col("weight") * (WHOLE_GROUP * count) <= F.lit(total))
    anchor = F.when(together, F.col("first")).otherwise(F.col("start"))
    shard = F.least(F.lit(count - 1), F.floor(anchor.cast("double") * count / F.lit(float(total)))).cast("int")
    dealt = checkpointed(placed.select("id", "size", "text_crc32", shard.alias("shard"), "row"))
    begins = dealt.groupBy("shard").agg(F.min("row").alias("begin"))                # one row per shard
    return dealt.join(F.broadcast(begins), "shard").select("id", "size", "text_crc32", "shard", (F.col("row") - F.col("begin")).alias("slot"))


def write_shards(docs: DataFrame, path: str, count: int = 8, identity: str = "doc_id", text: str = "text") -> None:
    """One folder per shard with whole rows; ids must be unique."""
    place = shards(docs, count, identity, text).select(F.col("id").alias("_shard_id"), F.col("shard").alias("_shard"))
    docs.join(place, docs[identity] == F.col("_shard_id")).drop("_shard_id").write.partitionBy("_shard").parquet(path)
