"""Groups of tokens of two tokenizers that cover the same bytes, and how often ids meet.

1. Texts are encoded by both libraries. A text over PART bytes is cut first, where neither
   tokenizer can join the sides (before a single space between two other characters), and its parts are dealt
   to all tasks. A text without such a place stays whole.
2. The tokens of a byte range make a fragment: an open prefix (up to the first byte at which tokens of both
   sides end), closed groups, an open suffix (behind the last such byte). Fragments are a monoid: composing
   two joins the suffix of the one with the prefix of the other, which closes a group, or leaves all open where
   neither has a cut. A text of one part is a single fragment; for the others Spark tasks compose FAN neighbours
   at a time, level by level. A row holds open ends only; closed groups stay where they were found.
3. Links are all pairs of tokens that share bytes. Their id pairs are counted over the corpus, folded per text
   first. Every text then looks its pairs up in the counts, sent to the tasks in shards of at most SHARD pairs;
   there are at most as many pairs as the vocabularies allow.

Defined results: a null or empty text, and one whose tokens don't spell a space and the text, has no tokens;
repeated rows count each; an empty table gives an empty result; other columns are not read.
"""
import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconlake.llm.arrays import parts, ranges, rows_of, whole_texts
from beaconlake.llm.hashes import of_pieces
from beaconlake.session import checkpointed, scratch_path

PART = 1 << 15          # bytes of a text that one task encodes
FAN = 8                 # neighbouring fragments composed by one task
SLICE = 1 << 19         # bytes of texts worked on at a time
SHARD = 2_000_000       # id pairs looked up at a time (24 MB)
SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Tokenizers:
    """The two libraries and the bytes of their tokens, from the contents of the files."""

    def __init__(self, files: dict):
        import sentencepiece
        import tiktoken
        vocabulary = json.loads(files["byte_level"])
        special = {x["content"] for x in vocabulary["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        self.first = tiktoken.Encoding("byte_level", pat_str=files["pattern"], mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=files["pieces"])
        spelled = {i: t for t, i in ranks.items()}
        self.a_bytes = np.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], object)
        self.b_bytes = np.array([self._piece(i) for i in range(self.second.get_piece_size())], object)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        decimal = lambda n, mark: np.array([b"%d%s" % (i, mark) for i in range(n)], object)
        self.a_text = decimal(len(self.a_bytes), b","), decimal(len(self.a_bytes), b"|")
        self.b_text = decimal(len(self.b_bytes), b","), decimal(len(self.b_bytes), b";")

    def _piece(self, i):
        if self.second.is_byte(i):
            return bytes([int(self.second.id_to_piece(i)[3:5], 16)])
        return self.second.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]):
        """(a, count of a, b, count of b, valid): the ids of all texts one after another; texts whose
        tokens spell something else have none."""
        a = [self.first.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self.second.encode(texts, num_threads=1)
        valid = np.array([bool(t) and self._spells(" " + t, x, y) for t, x, y in zip(texts, a, b)], bool)
        a, b = ([x if v else [] for x, v in zip(ids, valid)] for ids in (a, b))
        return *_flat(a), *_flat(b), valid

    def _spells(self, text, a, b):
        text = text.encode()
        return b"".join(self.a_bytes[a].tolist()) == text and b"".join(self.b_bytes[b].tolist()) == text


def _flat(ids):
    count = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(count.sum())), count


def shared(spark, byte_level: str, pieces: str, pattern: str):
    """The contents of the vocabulary files, for all tasks."""
    return spark.sparkContext.broadcast({"byte_level": open(byte_level, encoding="utf-8").read(), "pieces": open(pieces, "rb").read(), "pattern": pattern})


def tokenizers(files) -> Tokenizers:
    """Built once per Python worker: kept with the broadcast value."""
    if "built" not in files.value:
        files.value["built"] = Tokenizers(files.value)
    return files.value["built"]


def cuts(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Bytes at which tokens of both sides end."""
    if not len(a_end) or not len(b_end):
        return np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)
    return a_end[b_end[spot] == a_end]


def closed(t: Tokenizers, a, a_end, b, b_end, text_of=None):
    """Groups and links of tokens that end in a cut. `text_of` is the text's number of each cut, where
    several texts lie one after another; without it all is one. Per text: groups, links, distinct
    id pairs with their times, and the groups written out."""
    cut = cuts(a_end, b_end)
    text_of = np.zeros(len(cut), np.int64) if text_of is None else text_of(cut)
    n = int(text_of[-1]) + 1 if len(cut) else 0
    a_group, b_group = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
    low = np.searchsorted(a_end, b_end - t.b_size[b], "right")
    links = np.searchsorted(a_end, b_end) - low + 1
    pair = a[ranges(low, links)] * len(t.b_bytes) + np.repeat(b, links)
    span = len(t.a_bytes) * len(t.b_bytes)
    found, times = np.unique(np.repeat(text_of[b_group], links) * span + pair, return_counts=True)
    # The place of a token in the written groups: behind all tokens of earlier groups.
    in_a, in_b = np.bincount(a_group, minlength=len(cut)), np.bincount(b_group, minlength=len(cut))
    out = np.empty(len(a) + len(b), object)
    last = np.append(a_group[1:] != a_group[:-1], True) if len(a) else np.zeros(0, bool)
    out[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]] = np.where(last, t.a_text[1][a], t.a_text[0][a])
    last = np.append(b_group[1:] != b_group[:-1], True) if len(b) else np.zeros(0, bool)
    out[np.arange(len(b)) + np.cumsum(in_a)[b_group]] = np.where(last, t.b_text[1][b], t.b_text[0][b])
    ends = np.cumsum(np.bincount(text_of, (in_a + in_b), n)).astype(np.int64)
    written = [b"".join(out[x:y].tolist())[:-1] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
    return {"n_groups": np.bincount(text_of, minlength=n), "n_links": np.bincount(text_of[b_group], links, n).astype(np.int64),
            "pair": found % span, "times": times, "of": found // span, "written": written}


def fragment(t: Tokenizers, a, a_end, b, b_end, part=0):
    """The fragment of a byte range's tokens: (open ends, closed groups or None)."""
    cut = cuts(a_end, b_end)
    inside = lambda ids, end, low, high: (ids[(end > low) & (end <= high)], end[(end > low) & (end <= high)])
    take = lambda low, high: (*inside(a, a_end, low, high), *inside(b, b_end, low, high))
    if not len(cut):
        return {"cut": False, "at": part, "head": (a, a_end, b, b_end), "tail": take(0, -1)}, None
    first, last, end = int(cut[0]), int(cut[-1]), np.iinfo(np.int64).max
    middle = take(first, last)
    return {"cut": True, "at": part, "head": take(-1, first), "tail": take(last, end)}, middle if len(middle[0]) else None


def _joined(x, y):
    return tuple(np.concatenate([np.asarray(i, np.int64), np.asarray(j, np.int64)]) for i, j in zip(x, y))


def compose(f, g, close):
    """The monoid's product. A group that it closes goes to `close` with the part of its last cut."""
    if not f["cut"]:
        return {"cut": g["cut"], "at": g["at"], "head": _joined(f["head"], g["head"]), "tail": g["tail"]}
    if not g["cut"]:
        return {"cut": True, "at": f["at"], "head": f["head"], "tail": _joined(f["tail"], g["head"])}
    close(g["at"], _joined(f["tail"], g["head"]))
    return {"cut": True, "at": f["at"], "head": f["head"], "tail": g["tail"]}


def split(text: str):
    """(start byte, part) of a long text; a part's space is its first byte, that of the first part is added."""
    at, byte, size = 0, 0, PART // 4        # characters of at most four bytes
    while True:
        where = SAFE.search(text, at + size - 1)
        end = where.start() if where else len(text)
        yield byte, text[at:end]
        if not where:
            return
        byte += 1 + len(text[at:end].encode())
        at = end + 1


UNIT = "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, pairs array<bigint>, times array<int>"


def _lists(of, values, n, kind):
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def short_units(docs: DataFrame, files, written: bool = False) -> DataFrame:
    """A row per text of one part: its counts and id pairs, and `groups`: written out, or hashed."""
    def run(batches):
        t = tokenizers(files)
        for batch in parts(batches):
            ident, texts = batch.column("id"), ["" if x is None else x for x in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, room = at, SLICE
                while end < len(texts) and (end == at or room > len(texts[end])):
                    room -= len(texts[end])
                    end += 1
                yield unit(t, ident.slice(at, end - at), texts[at:end])
                at = end

    def unit(t, ident, texts):
        a, n_a, b, n_b, _ = t.encode(texts)
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        full = np.flatnonzero(n_a)                        # texts with tokens
        ends = a_end[np.cumsum(n_a)[full] - 1] if len(full) else np.zeros(0, np.int64)
        got = closed(t, a, a_end, b, b_end, lambda cut: np.searchsorted(ends, cut))
        wide = lambda values: np.bincount(full, values, len(texts)).astype(np.int64) if len(full) else np.zeros(len(texts), np.int64)
        groups = [""] * len(texts)
        for i, w in zip(full.tolist(), got["written"]):
            groups[i] = w.decode() if written else hashlib.sha256(w).hexdigest()
        of = full[got["of"]] if len(full) else got["of"]
        return rows_of({"row": pa.nulls(len(texts), pa.int64()), "id": ident, "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(wide(got["n_groups"])), "n_links": pa.array(wide(got["n_links"])),
                        "pairs": _lists(of, got["pair"], len(texts), pa.int64()), "times": _lists(of, got["times"].astype(np.int32), len(texts), pa.int32()), "groups": pa.array(groups)})
    return whole_texts(docs).mapInArrow(run, UNIT + ", groups string")


def _open_columns(ends, name):
    return {name: pa.array([dict(zip(("a", "a_end", "b", "b_end"), [x.tolist() for x in e])) for e in ends],
                           pa.struct([("a", pa.list_(pa.int32())), ("a_end", pa.list_(pa.int64())), ("b", pa.list_(pa.int32())), ("b_end", pa.list_(pa.int64()))]))}


def _group_columns(t, groups):
    """The counts of groups, one of them or several in a row each (None: none)."""
    got = [closed(t, *(np.asarray(x, np.int64) for x in g)) if g is not None and len(g[0]) else None for g in groups]
    number = lambda name: pa.array([0 if g is None else int(g[name][0]) for g in got], pa.int64())
    return {"n_a": pa.array([0 if g is None else len(g[0]) for g in groups], pa.int64()), "n_b": pa.array([0 if g is None else len(g[2]) for g in groups], pa.int64()),
            "n_groups": number("n_groups"), "n_links": number("n_links"), "pairs": pa.array([[] if g is None else g["pair"].tolist() for g in got], pa.list_(pa.int64())),
            "times": pa.array([[] if g is None else g["times"].tolist() for g in got], pa.list_(pa.int32())), "groups": pa.array(["" if g is None else g["written"][0].decode() for g in got])}


FRAGMENT = ("row bigint, id bigint, part bigint, valid boolean, cut boolean, at bigint, head struct<a:array<int>,a_end:array<bigint>,b:array<int>,b_end:array<bigint>>, "
            "tail struct<a:array<int>,a_end:array<bigint>,b:array<int>,b_end:array<bigint>>")


def fragments(docs: DataFrame, files) -> DataFrame:
    """A row per part of the long texts: its open ends and its closed groups."""
    def cut(batches):
        for batch in parts(batches, 16):
            for row, ident, text in zip(*[batch.column(c).to_pylist() for c in ("row", "id", "text")]):
                for part, (start, some) in enumerate(split(text)):
                    yield rows_of({"row": pa.array([row], pa.int64()), "id": pa.array([ident], pa.int64()), "part": pa.array([part], pa.int64()), "start": pa.array([start], pa.int64()), "text": pa.array([some])})

    def run(batches):
        t = tokenizers(files)
        for batch in parts(batches, 16):
            start = batch.column("start").to_pylist()
            a, n_a, b, n_b, valid = t.encode(batch.column("text").to_pylist())
            opened, middles = [], []
            for i, (x, y) in enumerate(zip(np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist())):
                own_a, own_b = a[x - n_a[i]:x], b[y - n_b[i]:y]
                ends, middle = fragment(t, own_a, start[i] + np.cumsum(t.a_size[own_a]), own_b, start[i] + np.cumsum(t.b_size[own_b]), batch.column("part")[i].as_py())
                opened.append(ends)
                middles.append(middle)
            yield rows_of({"row": batch.column("row"), "id": batch.column("id"), "part": batch.column("part"), "valid": pa.array(valid), "cut": pa.array([e["cut"] for e in opened]),
                           "at": pa.array([e["at"] for e in opened], pa.int64()), **_open_columns([e["head"] for e in opened], "head"), **_open_columns([e["tail"] for e in opened], "tail"), **_group_columns(t, middles)})
    rows = whole_texts(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, "row bigint, id bigint, part bigint, start bigint, text string")
    dealt = checkpointed(rows).repartition("row", "part")
    return checkpointed(dealt.mapInArrow(run, FRAGMENT + ", n_a bigint, n_b bigint, n_groups bigint, n_links bigint, pairs array<bigint>, times array<int>, groups string"))


def composed(found: DataFrame, files) -> DataFrame:
    """The groups that lie across parts: (row, id, part, counts, pairs, groups), by a tree of products."""
    level = found.select("row", "id", F.col("part").alias("block"), "cut", "at", "head", "tail")

    def product(table):
        t = tokenizers(files)
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        done = []
        close = lambda at, tokens: done.append((at, tokens))
        opened = lambda r: {"cut": r["cut"], "at": r["at"], **{x: tuple(np.array(r[x][c], np.int64) for c in ("a", "a_end", "b", "b_end")) for x in ("head", "tail")}}
        whole = functools.reduce(lambda f, g: compose(f, g, close), map(opened, rows))
        if rows[0]["last"] < FAN:       # the whole text: its start is a cut
            close(whole["at"], whole["head"])
        row, ident = rows[0]["row"], rows[0]["id"]
        groups = [None] + [tokens for _, tokens in done]
        empty = tuple(np.zeros(0, np.int64) for _ in range(4))
        n = len(groups)
        return pa.table({"row": pa.array([row] * n, pa.int64()), "id": pa.array([ident] * n, pa.int64()), "block": pa.array([rows[0]["block"] // FAN] * n, pa.int64()),
                         "cut": pa.array([whole["cut"]] * n), "at": pa.array([whole["at"]] + [at for at, _ in done], pa.int64()),
                         **_open_columns([whole["head"]] + [empty] * (n - 1), "head"), **_open_columns([whole["tail"]] + [empty] * (n - 1), "tail"),
                         "done": pa.array([False] + [True] * (n - 1)), **_group_columns(t, groups)})
    out, counts = None, ["n_a", "n_b", "n_groups", "n_links", "pairs", "times", "groups"]
    schema = FRAGMENT.replace("part", "block").replace("valid boolean, ", "") + ", done boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, pairs array<bigint>, times array<int>, groups string"
    last = level.groupBy(F.col("row").alias("_row")).agg(F.max("block").alias("last"))
    while True:
        most = level.agg(F.max("block")).first()[0]
        if most is None:
            break
        step = level.join(last, F.col("row") == F.col("_row")).drop("_row").withColumn("to", F.expr(f"block div {FAN}"))
        step = checkpointed(step.groupBy("row", "to").applyInArrow(product, schema))
        groups = step.where("done").select("row", "id", F.col("at").alias("part"), *counts)
        out = groups if out is None else out.unionByName(groups)
        if most < FAN:
            break
        level = step.where("not done").select("row", "id", "block", "cut", "at", "head", "tail")
        last = last.withColumn("last", F.expr(f"last div {FAN}"))
        # A text that is done already has no further levels.
        level = level.join(last.where("last > 0").select("_row"), F.col("row") == F.col("_row"), "left_semi")
    return out if out is not None else found.select("row", "id", "part", *counts).limit(0)


def pair_counts(units: DataFrame, size: int) -> DataFrame:
    """(pair, n, best): the links of each id pair, and whether they are the most of its second id."""
    each = units.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = checkpointed(each.groupBy("pair").agg(F.sum("times").alias("n")))
    top = counts.groupBy((F.col("pair") % size).alias("_b")).agg(F.max("n").alias("most"))
    return checkpointed(counts.join(top, F.col("pair") % size == F.col("_b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def looked_up(units: DataFrame, counts: DataFrame) -> DataFrame:
    """(_unit, n_best, count_sum) of each unit's links, over the counts shard by shard."""
    shards = 1 + counts.count() // SHARD
    out = None
    for shard in range(shards):
        table = counts.where(F.pmod("pair", F.lit(shards)) == shard).orderBy("pair").toArrow()
        known = units.sparkSession.sparkContext.broadcast((table.column("pair").to_numpy(), np.where(table.column("best").to_numpy(), 1, -1) * table.column("n").to_numpy()))

        def run(batches, known=known):
            names, signed = known.value
            for batch in parts(batches, 4096):
                pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
                of = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
                pair = pairs.flatten().to_numpy()
                spot = np.minimum(np.searchsorted(names, pair), max(len(names) - 1, 0))
                hit = names[spot] == pair if len(names) else np.zeros(len(pair), bool)
                n = signed[spot[hit]]
                best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(best, of[hit], times[hit] * (n > 0))
                np.add.at(total, of[hit], times[hit] * np.abs(n))
                yield rows_of({"_unit": batch.column("unit"), "n_best": pa.array(best), "count_sum": pa.array(total)})
        some = units.select("unit", "pairs", "times").mapInArrow(run, "_unit bigint, n_best bigint, count_sum bigint")
        out = some if out is None else out.unionByName(some)
    return out.groupBy("_unit").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs: DataFrame, files, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its second
    id), count_sum (over the links) and groups_sha256, the hash of all groups written out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(identity).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > PART, F.lit(False))
    found = fragments(rows.where(long), files)
    wrong = checkpointed(found.groupBy(F.col("row").alias("_row"), F.col("id").alias("_id")).agg(F.min("valid").alias("valid")))
    found = found.join(wrong.where("valid"), F.col("row") == F.col("_row"), "left_semi")
    counts = ["row", "id", "part", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", "groups"]
    across = checkpointed(composed(found, files).withColumn("sub", F.lit(0)))
    pieces = across.select(*counts, "sub").unionByName(found.select(*counts, F.lit(1).alias("sub")))
    units = short_units(rows.where(~long), files).unionByName(pieces.drop("part", "sub", "groups").withColumn("groups", F.lit(None).cast("string")))
    path = scratch_path(spark, "units")
    units.withColumn("unit", F.monotonically_increasing_id()).write.parquet(path)
    units = spark.read.parquet(path)
    b_size = len(tokenizers(files).b_bytes)
    scored = units.drop("pairs", "times").join(looked_up(units, pair_counts(units, b_size)), F.col("unit") == F.col("_unit")).drop("unit", "_unit")
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    hashes = of_pieces(pieces.where("groups <> ''"), ["row"], ["part", "sub"], "groups", b";", "hash").withColumnRenamed("_row", "_r")
    whole = scored.where("row is not null").groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in sums])
    whole = whole.join(hashes, F.col("row") == F.col("_r"), "left").select("id", *sums, F.col("hash").alias("groups_sha256"))
    none = wrong.where("not valid").select(F.col("_id").alias("id"), *[F.lit(0).cast("long").alias(c) for c in sums], F.lit("").alias("groups_sha256"))
    return scored.where("row is null").select("id", *sums, F.col("groups").alias("groups_sha256")).unionByName(whole).unionByName(none)


def written_groups(docs: DataFrame, files, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, part, sub, groups): the groups as text, `a1,a2|b1;a3|b2,b3`, of whole short texts and of
    the pieces of long ones, in the order of part and sub."""
    rows = docs.select(F.col(identity).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > PART, F.lit(False))
    short = short_units(rows.where(~long), files, written=True).select("id", "row", F.lit(0).cast("long").alias("part"), F.lit(0).alias("sub"), "groups")
    found = fragments(rows.where(long), files)
    wrong = found.where("not valid").select(F.col("row").alias("_row")).distinct()
    found = found.join(wrong, F.col("row") == F.col("_row"), "left_anti")
    pieces = composed(found, files).select("id", "row", "part", F.lit(0).alias("sub"), "groups").unionByName(found.select("id", "row", "part", F.lit(1).alias("sub"), "groups"))
    return short.unionByName(pieces.where("groups <> ''"))
