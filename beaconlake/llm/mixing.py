"""Mix sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within a source the documents stand in key order, and
the order is cut into about sqrt(n) key ranges. The words of the ranges are summed where the rows
lie and prefix-summed per source, which finds the one range that holds the source's budget;
only that range is sorted row by row. So a source with a third of all rows costs sqrt(n) rows in
one task, no row carries its text through a shuffle, and a rerun gives the same cut.

Defined results: a null text or one without words has size 0 and is taken 0 times; null sources
form one source that comes last; rows with equal id and size are one unit, and when the budget
ends inside it each of its copies takes the same share (at most copies - 1 words are then left
over); a null id has a key like any other; an empty table gives an empty result. Columns of the
input keep their names; the ones added must not clash with them (`mix` works on its own names).
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconlake.llm.prefix import running
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.session import checkpointed

WORDS = "[^\\x20\\x09-\\x0D]+"
CAP = 3                 # a target stops at this many times its source
KEY_SPACE = 1 << 60
ADDED = ("source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def random_key(identity: Column) -> Column:
    """60 bits of a hash of the id: the same on every run and engine."""
    digest = F.md5(F.coalesce(identity.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size) with `target`: weights 1, 2, 3, ... by code point share the total,
    no target above `cap` times its source, the excess reshared by weight.

    Resharing until none is above ends at one level: target = min(weight * level, cap * size).
    Sorted by cap / weight, the level is where the first source stays below its cap."""
    named = sources.withColumns({"_last": F.col("source").isNull(), "_one": F.lit(1).cast("long")})
    numbered = running(named, ["_last", "source"], {"_index": "_one"})
    weighed = numbered.selectExpr("source", "source_size", "_index % 3 + 1 as _w", f"{cap} * source_size as _cap")
    stepped = running(weighed.withColumn("_ratio", F.col("_cap") / F.col("_w")), ["_ratio", "source"],
                      {"_caps": "_cap", "_ws": "_w"})
    whole = weighed.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_weights"))
    level = F.expr("cast(_all - _caps as double) / (_weights - _ws)")
    first = (stepped.crossJoin(F.broadcast(whole)).withColumn("_level", level).where("_level <= _ratio")       # one row joined
             .agg(F.min_by("_level", F.struct("_ratio", F.col("source").isNotNull(), "source")).alias("_level")))
    return (weighed.crossJoin(F.broadcast(first))
            .selectExpr("source", "source_size", "least(_w * _level, cast(_cap as double)) as target"))


def cuts(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """rows: (id, source, size, key). Per source: its size and target, how many whole epochs it
    gives, and the place in key order where the last, partial epoch stops."""
    unit = ["source", "key", "id", "size"]
    units = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    units = checkpointed(units)
    per_source = checkpointed(units.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.ceil(F.sqrt(F.count(F.lit(1)).cast("double"))).alias("ranges")))
    plan = targets(per_source.select("source", "source_size"), cap)
    plan = checkpointed(plan.join(per_source.select(F.col("source").alias("_s"), "ranges"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
                        .withColumn("epochs", F.expr("case when source_size > 0 then budget div source_size else 0 end"))
                        .withColumn("rest", F.expr("budget - epochs * source_size")))
    named = broadcast_if_small(plan.select(F.col("source").alias("_s"), "ranges", "rest"))
    place = F.floor(F.col("key") / F.lit(float(KEY_SPACE)) * F.col("ranges")).cast("long")
    ranged = units.join(named, F.col("source").eqNullSafe(F.col("_s"))).withColumn("part", place)
    sums = ranged.groupBy("source", "part").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    hit = (sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
           .where("before <= rest and rest < before + words").select(F.col("source").alias("_t"), F.col("part").alias("_part"), "before"))
    near = ranged.join(hit, F.col("source").eqNullSafe(F.col("_t")) & (F.col("part") == F.col("_part")))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = (near.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
          .where("before <= rest and rest < before + words")
          .selectExpr("source as _t", "struct(key, id, size) as cut", "(rest - before) div copies as cut_words"))
    return checkpointed(plan.join(at, F.col("source").eqNullSafe(F.col("_t")), "left")
                        .select("source", "source_size", "target", "epochs", "cut", "cut_words"))


def taken(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: (id, source, size, key, ...) with source_size, target and the words taken."""
    named = broadcast_if_small(plan.withColumnRenamed("source", "_s"))
    at = F.struct("key", "id", "size")
    part = F.when(F.col("cut").isNull(), F.lit(0)).when(at < F.col("cut"), F.col("size")).when(at == F.col("cut"), F.col("cut_words")).otherwise(F.lit(0))
    return (rows.join(named, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")))


def sized(docs: DataFrame, identity: str, source: str, text: str) -> DataFrame:
    """(id, source, size, key) of every document: all that planning needs."""
    return docs.select(F.col(identity).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       random_key(F.col(identity)).alias("key"))


def mix(docs: DataFrame, identity: str = "doc_id", source: str = "source", text: str = "text", cap: int = CAP) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken."""
    rows = checkpointed(sized(docs, identity, source, text))
    return taken(cuts(rows, cap), rows).select("id", "source", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, identity: str = "doc_id", source: str = "source", text: str = "text", cap: int = CAP) -> DataFrame:
    """The mix itself: each row once per epoch that takes it. The row at a source's cut comes last
    with only the words that still fit, joined by single spaces; other texts are unchanged."""
    columns = docs.columns
    rows = checkpointed(sized(docs, identity, source, text))
    plan = broadcast_if_small(cuts(rows, cap).withColumnRenamed("source", "_s"))
    base = docs.select(F.struct(*columns).alias("row"), F.col(identity).alias("id"), F.col(source).alias("_source"),
                       word_count(F.col(text)).alias("size"), random_key(F.col(identity)).alias("key"))
    at = F.struct("key", "id", "size")
    kept = F.split(F.col("row")[text], "[\\x20\\x09-\\x0D]+")
    cut_text = F.array_join(F.slice(F.filter(kept, lambda w: w != ""), 1, F.col("cut_words").cast("int")), " ")
    extra = F.when(F.col("cut").isNull(), F.lit(0)).when(at < F.col("cut"), F.lit(1)).when((at == F.col("cut")) & (F.col("cut_words") > 0), F.lit(2)).otherwise(F.lit(0))
    whole = F.array_repeat(F.lit(False), (F.col("epochs") + F.when(extra == 1, 1).otherwise(0)).cast("int"))
    copies = F.when(F.col("size") > 0, F.concat(whole, F.when(extra == 2, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
    dealt = base.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("shortened", F.explode(copies))
    out = {c: F.col("row")[c] for c in columns} | {text: F.when(F.col("shortened"), cut_text).otherwise(F.col("row")[text])}
    return dealt.select(*[v.alias(k) for k, v in out.items()])
