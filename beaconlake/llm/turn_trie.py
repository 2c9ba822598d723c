"""Prefix trie of conversations, by a van Emde Boas recursion over their depth.

1. Turns become digests of 128 bits; their places come from range sorts (operators.ordered).
2. A sequence is cut at half its depth, again and again. The upper half keeps its names. The names of
   the lower half are mixed with the name of the cut prefix, so that equal names are equal
   prefixes. All halves of one size are named at the same time: inside blocks of BLOCK turns on
   arrays, above them by joins of the cut prefixes with the blocks of the lower halves, one
   join a doubling of the depth.
3. The prefixes of one name are a node. Its smallest conversation owns it; what a conversation owns is
   the lower end of its path.
4. Totals are grafted upward by the same halves: the total of a lower half goes to all nodes of
   the upper half of the path. What a path holds from its top down then goes to the nodes above that
   top, which other conversations own, by their names.

No step sees a conversation or a node whole: blocks are bounded, counts are folded where the rows
lie, and the ids under a hash are read as sorted pieces.

Defined results: rows without a conversation id are left out; a null role or text is empty; turns are
ordered by number, null first, then role, then digest; a repeated row is a turn of its own; an
empty table has no nodes; other columns are not read. Names are hashes: two different prefixes share
one with a chance of 2 ** -128 a pair.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconlake.llm.hashes import of_pieces
from beaconlake.operators.ordered import running_sum
from beaconlake.operators.skew import broadcast_if_small, lookup_join
from beaconlake.session import checkpointed

BLOCK = 32              # turns named inside one row
HEAD = 8                # turns at most that a conversation takes from another one
EVERY = 5               # conversations that share a beginning: c takes it from c - c % EVERY
PIECE = 10              # ids of 2 ** PIECE neighbouring conversations are one piece under a hash
COPIES = 4096           # equal rows written out at a time


def places(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, at, a, b, bytes): the digest of each turn and its place, from 0, in its conversation."""
    said, words = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), said.alias("role"), F.xxhash64(said, words).alias("a"),
        F.xxhash64(F.lit("b"), words, said).alias("b"), F.octet_length(words).cast("long").alias("bytes"))
    equal = slim.groupBy("conv", "turn", "role", "a", "b", "bytes").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sum(equal, ["conv"], ["turn", "role", "a", "b"], "n", "before")
    some = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    copy = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1))
    return some.withColumn("copy", copy).select("conv", (F.col("before") + F.col("copy")).alias("at"), "a", "b", "bytes")


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its neighbours."""
    return (F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def rebuilt(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, a, b, bytes, turns) of every conversation with the beginning that it borrows,
    below a root of depth 0; and (conv, turns), one row each."""
    sizes = at.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    heads = (at.where(F.col("at") < HEAD).groupBy("conv")
             .agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "bytes"))).alias("head")).withColumnRenamed("conv", "_from"))
    of = sizes.withColumn("take", borrowed(F.col("conv"))).join(heads, F.col("conv") - F.col("conv") % EVERY == F.col("_from"), "left")
    no = F.array().cast("array<struct<at:bigint,a:bigint,b:bigint,bytes:bigint>>")
    of = of.withColumn("head", F.slice(F.coalesce("head", no), F.lit(1), F.col("take")))
    of = checkpointed(of.select("conv", "size", "head", (F.size("head") - F.col("take")).cast("long").alias("shift"),
                                (F.size("head") + F.greatest(F.col("size") - F.col("take"), F.lit(0))).alias("turns")))
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("at"), zero.alias("a"), zero.alias("b"), zero.alias("bytes")))
    first = of.select("conv", F.posexplode(F.concat(root, "head")).alias("depth", "t"), "turns").select("conv", F.col("depth").cast("long"), "t.a", "t.b", "t.bytes", "turns")
    own = lookup_join(at.where(F.col("at") >= borrowed(F.col("conv"))), of.select("conv", "size", "shift", "turns"), ["conv"], "size", "at")
    return first.unionByName(own.select("conv", (F.col("at") + F.col("shift") + 1).alias("depth"), "a", "b", "bytes", "turns")), of.select("conv", "turns")


def mixed(above: Column, below: Column) -> Column:
    """The name of a sequence from the names of its two parts."""
    parts = [above["a"], above["b"], below["a"], below["b"]]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))


def blocks_named(rows: DataFrame) -> DataFrame:
    """(conv, block, turns, bytes, names): BLOCK turns a row, each named from the start of the block."""
    got = (rows.groupBy("conv", F.expr(f"depth div {BLOCK}").alias("block"))
           .agg(F.max("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("depth", "a", "b", "bytes"))).alias("t")))
    got = got.select("conv", "block", "turns", F.col("t.bytes").alias("bytes"), F.transform("t", lambda x: F.struct(x["a"], x["b"])).alias("names"))
    for level in range(BLOCK.bit_length() - 1):
        def below(x, i):
            cut = F.shiftleft(F.shiftright(i, level), level)          # the place, from 1, of the last turn above the cut
            return F.when(F.shiftright(i, level) % 2 == 1, mixed(F.element_at("names", cut), x)).otherwise(x)
        got = got.withColumn("names", F.transform("names", below))
    return got


def prefixes_above(blocks: DataFrame, most: int) -> DataFrame:
    """(conv, block, above): the names of the cut prefixes over each block, the nearest first. A level
    joins the last block above each cut with the blocks below it."""
    no = F.array().cast("array<struct<a:bigint,b:bigint>>")
    state = checkpointed(blocks.where(F.col("turns") >= BLOCK).select("conv", "block", F.element_at("names", -1).alias("name"), no.alias("above")))
    for level in range(most.bit_length()):
        pair, half = F.shiftright("block", level + 1), F.shiftright("block", level)
        cut = state.where((half % 2 == 0) & (F.col("block") % (1 << level) == (1 << level) - 1)).select(
            F.col("conv").alias("_conv"), pair.alias("_pair"), F.col("name").alias("cut"))
        lower = F.when(half % 2 == 1, pair)                           # no match for the upper blocks
        joined = state.join(broadcast_if_small(cut), (F.col("conv") == F.col("_conv")) & (lower == F.col("_pair")), "left")
        state = checkpointed(joined.select("conv", "block", F.when(F.col("cut").isNotNull(), mixed(F.col("cut"), F.col("name"))).otherwise(F.col("name")).alias("name"),
                                           F.when(F.col("cut").isNotNull(), F.concat("above", F.array("cut"))).otherwise(F.col("above")).alias("above")))
    return state.where(F.size("above") > 0).select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "above")


def named(rows: DataFrame) -> tuple[DataFrame, int]:
    """The blocks with names from the root on and `over`, the name of the turn before the block; and
    the number of the last block."""
    blocks = checkpointed(blocks_named(rows))
    most = int(blocks.agg(F.max("block")).first()[0] or 0)
    none = F.lit(None).cast("struct<a:bigint,b:bigint>")
    if not most:
        return blocks.withColumn("over", none), most
    got = blocks.join(prefixes_above(blocks, most), (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    down = F.transform("names", lambda x: F.aggregate("above", x, lambda name, cut: mixed(cut, name)))
    over = F.aggregate(F.slice("above", F.lit(2), F.size("above")), F.element_at("above", 1), lambda name, cut: mixed(cut, name))
    wide = F.size(F.coalesce("above", F.array().cast("array<struct<a:bigint,b:bigint>>"))) > 0
    return checkpointed(got.select("conv", "block", "turns", "bytes", F.when(wide, down).otherwise(F.col("names")).alias("names"), F.when(wide, over).alias("over"))), most


def _each(blocks: DataFrame) -> DataFrame:
    """A row per turn: (conv, depth, turns, bytes, a, b, pa, pb)."""
    before = F.transform("names", lambda x, i: F.when(i > 0, F.element_at("names", F.greatest(i, F.lit(1)))).otherwise(F.col("over")))
    rows = blocks.select("conv", "block", "turns", F.posexplode(F.arrays_zip(F.col("names"), F.col("bytes"), before.alias("up"))).alias("i", "t"))
    return rows.select("conv", (F.col("block") * BLOCK + F.col("i")).alias("depth"), "turns", "t.bytes", "t.names.a", "t.names.b",
                       F.col("t.up.a").alias("pa"), F.col("t.up.b").alias("pb"))


def nodes(blocks: DataFrame) -> DataFrame:
    """(a, b, depth, conv, n_convs, bytes, pa, pb, n_children): a row per distinct prefix."""
    found = checkpointed(_each(blocks).groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb")))
    below = found.where("depth > 0").groupBy(F.col("pa").alias("_a"), F.col("pb").alias("_b"), (F.col("depth") - 1).alias("_depth")).agg(F.count(F.lit(1)).alias("n_children"))
    return checkpointed(found.join(below, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("depth") == F.col("_depth")), "left")
                        .drop("_a", "_b", "_depth").fillna(0, ["n_children"]))


def below_blocks(totals: DataFrame, most: int) -> DataFrame:
    """(_conv, _block, first, saved_after, leaves_after): what a path holds below each block. A level
    grafts the total of the lower half on all blocks of the upper half."""
    state = totals.withColumns({"saved_after": F.lit(0).cast("long"), "leaves_after": F.lit(0).cast("long")})
    for level in range(most.bit_length()):
        half, pair = F.shiftright("block", level), F.shiftright("block", level + 1)
        lower = (totals.where(half % 2 == 1).groupBy(F.col("conv").alias("_conv"), pair.alias("_pair"))
                 .agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves")))
        upper = F.when(half % 2 == 0, pair)
        state = (state.join(lower, (F.col("conv") == F.col("_conv")) & (upper == F.col("_pair")), "left")
                 .withColumns({"saved_after": F.col("saved_after") + F.coalesce("_saved", F.lit(0)), "leaves_after": F.col("leaves_after") + F.coalesce("_leaves", F.lit(0))})
                 .drop("_conv", "_pair", "_saved", "_leaves"))
    return state.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "first", "saved_after", "leaves_after")


def totals_of(blocks: DataFrame, found: DataFrame, convs: DataFrame, most: int) -> DataFrame:
    """The nodes with n_leaves, saved_tokens and `top`: whether the owner's path begins here."""
    block = F.expr(f"depth div {BLOCK}")
    own = found.withColumns({"block": block, "saved": (F.col("n_convs") - 1) * F.col("bytes"), "leaf": (F.col("n_children") == 0).cast("long")})
    per = checkpointed(own.groupBy("conv", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.min("depth").alias("first")))
    down = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"saved": F.sum("saved").over(down), "leaf": F.sum("leaf").over(down)})
    own = own.join(below_blocks(per, most), (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block")))
    # The top of a path is its first node; a block of the path before this one would hold it.
    earlier = per.select(F.col("conv").alias("_above"), (F.col("block") + 1).alias("_next"))
    own = own.join(earlier, (F.col("conv") == F.col("_above")) & (F.col("block") == F.col("_next")), "left")
    own = own.withColumn("top", (F.col("depth") == F.col("first")) & F.col("_above").isNull())
    # From the top of each path on to the nodes above it.
    tails = (per.groupBy("conv").agg(F.min("first").alias("start"), F.sum("saved").alias("tail_saved"), F.sum("leaves").alias("tail_leaves"))
             .where("tail_saved > 0 or tail_leaves > 0").join(convs.select(F.col("conv").alias("_c"), (F.expr(f"turns div {BLOCK}") + 1).alias("_n")), F.col("conv") == F.col("_c")).drop("_c"))
    up = lookup_join(blocks.select("conv", "block", "names"), checkpointed(tails), ["conv"], "_n", "block").where(F.col("start") > F.col("block") * BLOCK)
    up = (up.select("block", "start", "tail_saved", "tail_leaves", F.posexplode("names").alias("i", "name")).withColumn("_depth", F.col("block") * BLOCK + F.col("i"))
          .where("_depth < start").groupBy("_depth", F.col("name.a").alias("_a"), F.col("name.b").alias("_b"))
          .agg(F.sum("tail_saved").alias("grafted"), F.sum("tail_leaves").alias("grafted_leaves")))
    got = own.join(up, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("depth") == F.col("_depth")), "left")
    return got.select("a", "b", "depth", "conv", "n_convs", "pa", "pb", "n_children", "top",
                      (F.col("leaf") + F.col("leaves_after") + F.coalesce("grafted_leaves", F.lit(0))).alias("n_leaves"),
                      (F.col("saved") + F.col("saved_after") + F.coalesce("grafted", F.lit(0))).alias("saved_tokens"))


def end_hashes(blocks: DataFrame) -> DataFrame:
    """(_a, _b, _depth, ends): SHA-256 of the ids of the conversations that end at a node. The ids of
    neighbours are one piece; a task reads the sorted pieces of a node one after another."""
    last = blocks.where(F.expr(f"block = turns div {BLOCK}")).select("conv", F.col("turns").alias("depth"), F.element_at("names", -1).alias("name"))
    pieces = (last.groupBy("depth", "name.a", "name.b", F.shiftright("conv", PIECE).alias("piece"))
              .agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    return of_pieces(pieces, ["depth", "a", "b"], ["piece"], "ids", b",", "ends")


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, the hash of the conversations that end there."""
    rows, convs = rebuilt(checkpointed(places(turns, conv, turn, role, text)))
    blocks, most = named(rows)
    got = checkpointed(totals_of(blocks, nodes(blocks), convs, most))
    got = got.join(end_hashes(blocks), (F.col("depth") == F.col("_depth")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").drop("_depth", "_a", "_b")
    # Below the top of a path the parent has the same owner; the parents of the tops are looked up.
    owners = got.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("owner"), F.col("n_children").alias("_n"))
    tops = lookup_join(got.where("top and depth > 0"), owners, ["depth", "pa", "pb"], "_n", "conv").withColumn("parent", F.col("owner"))
    rest = got.where("not top or depth = 0").withColumn("parent", F.when(F.col("depth") > 0, F.col("conv")))
    out = rest.unionByName(tops.select(*rest.columns))
    return out.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"),
                      F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
                      F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
