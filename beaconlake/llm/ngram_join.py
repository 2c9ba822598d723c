"""Groups of documents whose word shingles overlap by a Jaccard similarity of 0.8 or more, exactly.

1. Every document becomes a set of shingle numbers, and a signature: equal sets are one set from here.
2. A filter over all sets finds those that can have a partner. In an order of all shingles (here: by
   number) two similar sets share the first L of their common members within their first
   n - ceil(0.8 n) + L members. Each set sends that prefix, three tenths of it, to the
   shingles; a set stays if enough members of its prefix are shared with any other set. Members
   common inside one batch of rows are folded there, so a line that a third of all documents
   holds costs one row a batch.
3. The sets that stay are taken whole. A shingle that none of the others holds counts against a
   set; one with too many of those falls. The rest are ordered by frequency, rare ones first,
   and sets that share a member of their (now short) prefix form a candidate group.
4. A candidate group is joined by prefix trees (see trie_join): each set is sent once to its group.
   A large group is cut into blocks. They are joined alone first, then one set for each cluster of
   each block, and only groups in which clusters remain apart are compared block against block,
   without the pairs already connected. No step lists all pairs of a group.

Defined results: a null or empty text has no shingles and links with nothing; equal texts are one
group; a null id is left out of the groups (its component is null); an id that occurs more
than once stands for all of its texts; empty tables give empty results; other columns are not read.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake.llm.arrays import parts, plain, rows_of, texts_of, whole_texts
from beaconlake.llm.components import components
from beaconlake.llm.shingles import Hasher, shared_at_least, signature
from beaconlake.llm.trie_join import links
from beaconlake.session import checkpointed, removed, stored, stored_at

BLOCK = 1024            # sets a task joins at a time
SMALL = 1_000_000       # ids that may be broadcast (16 MB); beyond, the ids join by shuffle
FOLD = 4096             # documents whose common members are folded together in a task
MORE = 10               # a prefix is longer by a tenth of the set than one common member needs


def signed(docs: DataFrame, identity: str, text: str) -> DataFrame:
    """(id, sig, n): each document's signature and number of shingles; sig is null for none."""
    def run(batches):
        hasher = Hasher()
        for batch in parts(batches):
            sets = [(signature(s), len(s)) if len(s) else (None, 0) for s in hasher.sets(texts_of(batch))]
            yield rows_of({"id": batch.column("id"), "sig": pa.array([s for s, _ in sets], pa.int64()), "n": pa.array([n for _, n in sets], pa.int64())})
    rows = whole_texts(docs).select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, sig bigint, n bigint")


def prefixes(docs: DataFrame, text: str) -> DataFrame:
    """(key, sig, found): the prefix members of every set. `found` 1 says that the batch holds the
    member in several sets; what those sets share comes counted in rows of its own, which have the
    signature as key (it spreads them) and the count below zero."""
    def folded(own):
        sigs = np.fromiter(own, np.int64, len(own))
        size = np.array([len(s) for s in own.values()])
        key = np.concatenate(list(own.values())).view(np.int64)
        sig = np.repeat(sigs, size)
        order = np.argsort(key)
        key, sig = key[order], sig[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])      # one row for each member goes on
        shared = ~first
        shared[:-1] |= ~first[1:]
        names, count = np.unique(sig[shared], return_counts=True)
        yield rows_of({"key": pa.array(key[first]), "sig": pa.array(sig[first]), "found": pa.array(shared[first].astype(np.int32))})
        if len(names):
            yield rows_of({"key": pa.array(names), "sig": pa.array(names), "found": pa.array(-count.astype(np.int32))})

    def run(batches):
        hasher, own, seen = Hasher(), {}, 0
        for batch in parts(batches):
            for s in hasher.sets(texts_of(batch)):
                n = len(s)
                if n:
                    own.setdefault(signature(s), s[:n - shared_at_least(n) + 1 + n // MORE].copy())
            seen += batch.num_rows
            if seen >= FOLD and own:
                yield from parts(folded(own), 1 << 16)
                own, seen = {}, 0
        if own:
            yield from parts(folded(own), 1 << 16)
    return whole_texts(docs).select(F.col(text).alias("text")).mapInArrow(run, "key bigint, sig bigint, found int")


def survivors(docs: DataFrame, text: str, signs: DataFrame) -> DataFrame:
    """(sig, n, id) of the sets that can have a partner; `id` is the least one with the set."""
    same = Window.partitionBy("key")
    seen = prefixes(docs, text).withColumns({"low": F.min("sig").over(same), "high": F.max("sig").over(same), "any": F.max("found").over(same)})
    shared = F.when(F.col("found") < 0, -F.col("found")).otherwise(1)
    total = seen.where("found < 0 or found = 0 and (low <> high or any = 1)").groupBy("sig").agg(F.sum(shared).alias("found"))
    sets = signs.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    return sets.join(total, "sig").where(F.col("found") >= F.expr(f"1 + (4 * n) div {5 * MORE}")).select("sig", "n", "id")


def whole_sets(docs: DataFrame, identity: str, text: str, chosen: DataFrame) -> DataFrame:
    """(sig, n, members) of the chosen (sig, n, id)."""
    few = chosen.limit(SMALL + 1).count() <= SMALL
    rows = whole_texts(docs).select(F.col(identity).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(chosen) if few else chosen, "id").select("sig", "n", "text")

    def run(batches):
        hasher = Hasher()
        for batch in parts(batches):
            got = [(g, s) for g, s in zip(batch.column("sig").to_pylist(), hasher.sets(texts_of(batch))) if len(s) and signature(s) == g]
            yield rows_of({"sig": pa.array([g for g, _ in got], pa.int64()), "n": pa.array([len(s) for _, s in got], pa.int64()),
                           "members": pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64()))})
    return rows.mapInArrow(run, "sig bigint, n bigint, members array<bigint>").dropDuplicates(["sig"])


def rare_first(sets: DataFrame) -> DataFrame:
    """(sig, n, members, prefix): the sets that enough other sets' members can match, with those members that
    any other set holds, and the rarest of them that a partner must share."""
    held = sets.select("sig", "n", F.explode("members").alias("key"))
    live = checkpointed(held.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").withColumnRenamed("key", "_key"))
    need = F.expr("(4 * n + 4) div 5")
    kept = (held.join(live, F.col("key") == F.col("_key")).groupBy("sig", "n")
            .agg(F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("by_use"))         # one set's members
            .where(F.size("by_use") >= need))
    return kept.select("sig", "n", F.col("by_use.key").alias("members"), F.slice("by_use.key", 1, (F.size("by_use") - need + 1).cast("int")).alias("prefix"))


def candidates(kept: DataFrame) -> DataFrame:
    """(sig, n, members, group): the sets that share a rare member, with the candidate group."""
    first = kept.select("sig", F.explode("prefix").alias("key"))
    hub = checkpointed(first.groupBy("key").agg(F.min("sig").alias("b"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select(F.col("key").alias("_key"), "b"))
    edges = first.join(hub, F.col("key") == F.col("_key")).select(F.col("sig").alias("a"), "b")
    groups = checkpointed(components(edges).select(F.col("node").alias("_sig"), F.col("component").alias("group")))
    return kept.join(groups, F.col("sig") == F.col("_sig")).select("sig", "n", "members", "group")


def _cluster_block(table: pa.Table) -> pa.Table:
    """(sig, head): each set of a block and the least set that it is connected to inside the block."""
    sets = [np.array(x, np.int64) for x in table.column("members").to_pylist()]
    sig = table.column("sig").to_numpy()
    head = np.arange(len(sig))
    for a, b in links(sets, table.column("n").to_numpy(), np.arange(len(sig))):
        head[head == head[b]] = head[a]
    least = np.full(len(sig), np.iinfo(np.int64).max)
    np.minimum.at(least, head, sig)
    return pa.table({"sig": pa.array(sig), "head": pa.array(least[head])})


def _compare_blocks(table: pa.Table) -> pa.Table:
    """(sig, head): links between two blocks (`side`) of sets whose clusters differ."""
    sets = [np.array(x, np.int64) for x in table.column("members").to_pylist()]
    sig, side = table.column("sig").to_numpy(), table.column("side").to_numpy()
    found = links(sets, table.column("n").to_numpy(), table.column("cluster").to_numpy(), np.flatnonzero(side == 1), np.flatnonzero(side == 0))
    return pa.table({"sig": pa.array([sig[a] for a, _ in found], pa.int64()), "head": pa.array([sig[b] for _, b in found], pa.int64())})


def _placed(sets: DataFrame, block: int) -> DataFrame:
    """The sets with the number of blocks of their group and their own one, a hash of the signature."""
    size = checkpointed(sets.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks")).withColumnRenamed("group", "_group"))
    return (sets.join(size, F.col("group") == F.col("_group")).drop("_group")
            .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks"))))


def _clusters(sets: DataFrame) -> DataFrame:
    return sets.select("group", "block", "sig", "n", "members").groupBy("group", "block").applyInArrow(_cluster_block, "sig bigint, head bigint")


def _across(sets: DataFrame) -> DataFrame:
    """Links between each two blocks of a group."""
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("block")))
    return (sets.withColumn("other", other)
            .select("group", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                    (F.col("block") > F.col("other")).cast("int").alias("side"), "sig", "n", "members", "cluster")
            .groupBy("group", "one", "two").applyInArrow(_compare_blocks, "sig bigint, head bigint"))


def linked_sets(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, component) of the sets that link with another. sets: (sig, n, members, group)."""
    placed = _placed(sets, block)
    heads = checkpointed(_clusters(placed))
    moved = heads.where("sig <> head").select("sig", F.col("head").alias("component"))
    wide = placed.where("blocks > 1")
    if not wide.limit(1).count():
        return moved.select(F.col("sig").alias("node"), "component").unionByName(moved.select(F.col("component").alias("node"), "component").distinct())
    # One set for each cluster of a block: most clusters of a large group meet here.
    least = wide.join(heads.where("sig = head").select(F.col("sig").alias("_sig")), F.col("sig") == F.col("_sig"), "left_semi")
    upper = checkpointed(_clusters(_placed(least.select("group", "sig", "n", "members"), block)).select(F.col("sig").alias("_head"), F.col("head").alias("cluster")))
    named = wide.join(heads.withColumnRenamed("sig", "_sig"), F.col("sig") == F.col("_sig")).drop("_sig")
    named = checkpointed(named.join(upper, F.col("head") == F.col("_head")).drop("_head", "head"))
    # What is still apart is compared block against block.
    apart = checkpointed(named.groupBy("group").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select(F.col("group").alias("_group")))
    edges = heads.unionByName(upper.select(F.col("_head").alias("sig"), F.col("cluster").alias("head")))
    if apart.limit(1).count():
        edges = edges.unionByName(_across(named.join(apart, F.col("group") == F.col("_group"), "left_semi")))
    return components(edges.select(F.col("sig").alias("a"), F.col("head").alias("b")))


def _named(signs: DataFrame, linked: DataFrame) -> DataFrame:
    """(_sig, component_id): the least id of each set's group."""
    cluster = linked.select(F.col("node").alias("sig"), "component")
    least = signs.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("id"))
    named = least.join(cluster, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    names = checkpointed(named.groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "_c"))
    return named.join(names, F.col("component") == F.col("_c")).select(F.col("sig").alias("_sig"), "component_id")


def groups(docs: DataFrame, identity: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: id, n_shingles and component_id, the least id reachable by links."""
    signs = checkpointed(signed(docs, identity, text))
    chosen = stored(lambda: survivors(docs, text, signs))
    kept = stored(lambda: rare_first(checkpointed(whole_sets(docs, identity, text, chosen))))
    near = stored(lambda: candidates(kept))
    removed(docs.sparkSession, [stored_at(kept)])
    of = stored(lambda: _named(signs, linked_sets(near, block)))
    out = signs.join(of, F.col("sig") == F.col("_sig"), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row for each group: that of the least id, once if it is repeated.
    Rows with a null id stay."""
    rows, at = plain(docs)
    identity, text = at[identity], at[text]
    found = checkpointed(groups(rows, identity, text).where("id = component_id").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows")))
    few = found.limit(SMALL + 1).count() <= SMALL
    kept = rows.join(F.broadcast(found.select("_id")) if few else found.select("_id"), F.col(identity) == F.col("_id"), "left_semi")
    again = checkpointed(found.where("_rows > 1").select("_id"))
    if again.limit(1).count():
        same = F.col(identity) == F.col("_id")
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([identity, text]))
    return kept.unionByName(rows.where(F.col(identity).isNull())).toDF(*docs.columns)
