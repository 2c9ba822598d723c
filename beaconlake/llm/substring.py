"""Drop the passages that an earlier document holds: words under a window of WORDS words which a document
with a smaller id holds too.

1. Equal texts are one text: all but the one with the least id lose every word.
2. Every window picks the least of its GRAM-word numbers as its anchor, equal windows the same one. One
   row per anchor goes to a shuffle; windows whose anchor a single document holds are out.
3. The other windows are counted the same way, by their own number. That leaves those that two documents
   hold, and names one that has it first. What several documents of one batch hold is settled there, so
   that a passage of a third of all documents costs a row a batch.
4. Reference shards: the passages of the first holders, cut by place and dealt into shards of about
   SHARD words. Each shard becomes a suffix automaton. The passages to judge go to the shard of
   their first holder, as a document cut down to what may be removed; a much wanted reference is sent to as
   many tasks as its documents need.
5. The documents are streamed through the automata. A stretch of WORDS words or more that a smaller id
   holds is marked, and the marked words go.

Numbers only choose what the automata see; those compare whole windows word by word, words by 64-bit
numbers (two words share one with a chance of 2 ** -64).

Defined results: a null text has no words; a null id is neither judged nor a reference; rows with the same
id don't judge each other; repeated rows are judged alike; texts of fewer words stay; an empty table gives
an empty result; other columns are not read. The words kept are joined by one space.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake.llm.arrays import parts, ranges, rows_of, texts_of, whole_texts
from beaconlake.llm.automaton import Automaton
from beaconlake.llm.shingles import SLICE, Hasher, _mixed
from beaconlake.operators.skew import broadcast_if_small, lookup_join
from beaconlake.session import checkpointed

WORDS = 13
GRAM = 5                # words of an anchor
FOLD = 4096             # documents whose common windows are folded together in a task, or as many of their
FOLD_ROWS = 1 << 19     # numbers, whichever comes first
SHARD = 1 << 15         # words of a reference shard
PART = 4096             # windows of one document that go to the same shard
WANTED = 4096           # words judged by one reference passage in one task
SMALL = 1_000_000       # documents, and as many places, whose findings may be broadcast (32 MB)
MORE = 8 * SMALL        # places of anchors that may be broadcast


def numbered(hasher: Hasher, texts: list[bytes]):
    """(numbers of all words, words of each text) of as many texts as fit in a slice."""
    at = 0
    while at < len(texts):
        end, room = at, SLICE
        while end < len(texts) and (end == at or room > len(texts[end])):
            room -= len(texts[end]) + 1
            end += 1
        if end == at + 1:
            numbers = hasher._long(texts[at])
            yield at, numbers, np.array([len(numbers)])
        else:
            start, numbers = hasher.words(np.frombuffer(b"\n".join(texts[at:end]) + b"\n", np.uint8))
            ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[at:end]]))
            yield at, numbers, np.diff(ends, prepend=0)
        at = end


def grams(numbers: np.ndarray, size: int) -> np.ndarray:
    """A number for each `size` words in a row."""
    factor = _mixed(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    run = np.zeros(max(0, len(numbers) - size + 1), np.uint64)
    for i in range(size):
        run += numbers[i:i + len(run)] * factor[i]
    return _mixed(run)


def windows(sizes: np.ndarray, words: int) -> np.ndarray:
    """Places at which a window begins that stays in its text."""
    ends = np.cumsum(sizes)
    return ranges(ends - sizes, np.maximum(sizes - words + 1, 0))


def anchors(numbers: np.ndarray, at: np.ndarray, words: int):
    """(number, place) of the anchor of each window at the places `at`: the least, the first of equal ones."""
    gram = grams(numbers, GRAM)
    best, place = gram[at], at.copy()
    for i in range(1, words - GRAM + 1):
        other = gram[at + i]
        less = other < best
        best, place = np.where(less, other, best), np.where(less, at + i, place)
    return best, place


class Folded:
    """Numbers of a batch of documents, one row out for each number and one for each further holder."""
    SCHEMA = "key bigint, id bigint, tag int, at int, found int, ref bigint, part int"

    def __init__(self):
        self.rows, self.documents, self.size = [], 0, 0

    def add(self, key, ident, tag, at):
        self.rows.append((key, ident, tag, at))
        self.size += len(key)

    def full(self):
        return self.documents >= FOLD or self.size >= FOLD_ROWS

    def out(self):
        """found 0: one document here holds the number; 1: the least of several; 2: another of
        several, with the least one as its reference."""
        if not self.size:
            return
        key, ident, tag, at = (np.concatenate(c) for c in zip(*self.rows))
        self.rows, self.documents, self.size = [], 0, 0
        order = np.lexsort((at, tag, ident, key))
        key, ident, tag, at = key[order], ident[order], tag[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]) | (tag[1:] != tag[:-1])
        key, ident, tag, at = key[new], ident[new], tag[new], at[new]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]           # the first row of each row's number
        tail = np.append(np.flatnonzero(first)[1:], len(key)) - 1
        several = (ident[tail] != ident[np.flatnonzero(first)])[np.cumsum(first) - 1]
        other = ident != ident[head]
        found = np.where(other, 2, several.astype(np.int32)).astype(np.int32)
        spread = np.where(other, _mixed(ident.view(np.uint64) + np.uint64(1)), key).view(np.int64)
        batch = rows_of({"key": pa.array(spread), "id": pa.array(ident), "tag": pa.array(tag), "at": pa.array(at.astype(np.int32)), "found": pa.array(found),
                         "ref": pa.array(ident[head], mask=~other), "part": pa.array((at[head] // PART).astype(np.int32), mask=~other)})
        yield from parts([batch], 1 << 16)


def _counted(rows: DataFrame, numbers_of) -> DataFrame:
    """Folded rows of a table (id, tag, text, ...); `numbers_of` gives (number, place in the slice) of a slice."""
    def run(batches):
        hasher, folded = Hasher(), Folded()
        for batch in parts(batches):
            ident, tag = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            extra = batch.column("at").to_pylist() if "at" in batch.schema.names else None
            for start, numbers, sizes in numbered(hasher, texts_of(batch)):
                key, place = numbers_of(numbers, sizes, extra[start:start + len(sizes)] if extra else None)
                begin = np.cumsum(sizes) - sizes
                row = np.searchsorted(begin, place, "right") - 1
                folded.add(key, ident[start + row], tag[start + row], place - begin[row])
            folded.documents += batch.num_rows
            if folded.full():
                yield from folded.out()
        yield from folded.out()
    return whole_texts(rows).mapInArrow(run, Folded.SCHEMA)


def _known(df: DataFrame, places: str, most: int) -> DataFrame:
    """Broadcast what was found, if rows and places are few enough; else leave the join to Spark."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL and total <= most else df


def shared_anchors(rows: DataFrame, words: int) -> DataFrame:
    """(_id, _tag, at): the places of a document's anchors that other documents hold."""
    def numbers_of(numbers, sizes, _):
        number, place = anchors(numbers, windows(sizes, words), words)
        place, one = np.unique(place, return_index=True)
        return number[one], place
    same = Window.partitionBy("key")
    seen = _counted(rows, numbers_of).select("key", "id", "tag", "at", "found")
    seen = seen.withColumns({"low": F.min("id").over(same), "high": F.max("id").over(same), "any": F.max("found").over(same)})
    return seen.where("found = 2 or low < high or any = 1").groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_list("at").alias("at"))


def shared_windows(rows: DataFrame, near: DataFrame, words: int) -> DataFrame:
    """(id, tag, ref, part, start, end): runs of windows that another document holds, by their first
    holder; `ref` null: the document is such a holder itself."""
    def numbers_of(numbers, sizes, known):
        at = windows(sizes, words)
        number, _ = anchors(numbers, at, words)
        begin = np.cumsum(sizes) - sizes
        place = np.concatenate([np.array(k, np.int64) + b for k, b in zip(known, begin)])
        gram = grams(numbers, GRAM)
        at = at[np.isin(number, gram[place[place < len(gram)]])]
        return grams(numbers, words)[at], at
    joined = rows.join(_known(near, "at", MORE), (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")))
    same = Window.partitionBy("key")
    seen = _counted(joined.select("id", "tag", "text", "at"), numbers_of)
    carrier = F.col("found") < 2
    seen = seen.withColumns({"first": F.min(F.when(carrier, F.struct("id", "at"))).over(same), "high": F.max(F.when(carrier, F.col("id"))).over(same)})
    ref = lambda ident, part: F.struct(ident.cast("bigint").alias("ref"), part.cast("int").alias("part"))
    judged = F.when(~carrier, ref(F.col("ref"), F.col("part"))).when(F.col("first.id") < F.col("id"), ref(F.col("first.id"), F.expr(f"first.at div {PART}")))
    holder = F.when(carrier & ((F.col("found") == 1) | (F.col("first.id") == F.col("id")) & (F.col("high") > F.col("id"))), ref(F.lit(None), F.expr(f"at div {PART}")))
    marks = seen.select("id", "tag", "at", F.explode(F.filter(F.array(judged, holder), lambda x: x.isNotNull())).alias("r")).select("id", "tag", "at", "r.ref", "r.part")
    run = Window.partitionBy("id", "tag", "ref", "part").orderBy("at")
    marks = marks.repartition("id", "tag").withColumn("run", F.col("at") - F.row_number().over(run))
    return marks.groupBy("id", "tag", "ref", "part", "run").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end")).drop("run")


def _same_windows(gram: np.ndarray, runs: list[dict]):
    """(start, end, run) of all windows that equal one of a run's, repeats inside the text included."""
    size = np.array([max(0, min(r["end"], len(gram)) - r["start"]) for r in runs], np.int64)
    place = ranges(np.array([r["start"] for r in runs], np.int64), size)
    run = np.repeat(np.arange(len(runs)), size)
    at, which = _matches(gram, gram[place], run)
    edge = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(which, prepend=-1) != 0))
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(at)).tolist()):
        yield int(at[a]), int(at[b - 1]) + 1, runs[which[a]]


def _matches(gram: np.ndarray, wanted: np.ndarray, run: np.ndarray):
    """Places of `gram` whose number is wanted, each with one run that wants it."""
    order = np.argsort(wanted, kind="stable")
    wanted, run = wanted[order], run[order]
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
    at = np.flatnonzero(wanted[spot] == gram)
    return at, run[spot[at]]


PASSAGE = "shard bigint, salt int, copies int, id bigint, tag int, holder boolean, start int, words array<bigint>"


def passages(rows: DataFrame, runs: DataFrame, words: int, shards: int) -> DataFrame:
    """The passages to judge and their references, with the shard that joins them."""
    hot = (runs.where("ref is not null").groupBy(F.col("ref").alias("_ref"), F.col("part").alias("_part"))
           .agg(F.sum(F.col("end") - F.col("start") + (words - 1)).alias("wanted")).where(f"wanted > {WANTED}")
           .select("_ref", "_part", F.expr(f"cast(1 + wanted div {WANTED} as int)").alias("copies")))
    whose = F.coalesce("ref", "id")
    runs = runs.withColumn("whose", whose).join(broadcast_if_small(checkpointed(hot)), (F.col("whose") == F.col("_ref")) & (F.col("part") == F.col("_part")), "left")
    run = F.struct("start", "end", F.col("ref").isNull().alias("holder"), F.pmod(F.xxhash64("whose", "part"), F.lit(shards)).alias("shard"), F.coalesce("copies", F.lit(1)).alias("copies"))
    of = runs.groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_list(run).alias("runs"))
    joined = rows.join(_known(checkpointed(of), "runs", SMALL), (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("id", "tag", "text", "runs")

    def cut(batches):
        hasher = Hasher()
        for batch in parts(batches):
            ident, tag, runs = (batch.column(c).to_pylist() for c in ("id", "tag", "runs"))
            out = []
            for start, numbers, sizes in numbered(hasher, texts_of(batch)):
                ends = np.cumsum(sizes)
                for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist()), start):
                    own = numbers[a:b].view(np.int64)
                    gram = grams(numbers[a:b], words)
                    for holder in (True, False):
                        for x, y, r in _same_windows(gram, [r for r in runs[i] if r["holder"] == holder]):
                            for z in range(x, y, PART):
                                salt = (ident[i] * 31 + z) % r["copies"]
                                out.append((r["shard"], salt, r["copies"], ident[i], tag[i], holder, z, own[z:min(y, z + PART) + words - 1]))
            for z in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out[z:z + 4096]), KINDS)], names=NAMES)
    rows = whole_texts(joined).mapInArrow(cut, PASSAGE)
    salts = F.when(F.col("holder"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array("salt"))
    return rows.withColumn("salt", F.explode(salts))


NAMES = ["shard", "salt", "copies", "id", "tag", "holder", "start", "words"]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int64())]


def _judge(words: int):
    def judge(table: pa.Table) -> pa.Table:
        """(id, tag, start, end): stretches of a shard's passages that a smaller id of the shard holds."""
        holder = table.column("holder").to_numpy()
        flat = table.column("words").combine_chunks()
        names, number = np.unique(flat.flatten().to_numpy(), return_inverse=True)
        cut = np.append(0, np.cumsum(flat.value_lengths().to_numpy()))
        ident, tag, start = (table.column(c).to_pylist() for c in ("id", "tag", "start"))
        own = lambda i: number[cut[i]:cut[i + 1]].tolist()
        stored = np.flatnonzero(holder).tolist()
        held = Automaton(map(own, stored), [ident[i] for i in stored])
        out = []
        for i in np.flatnonzero(~holder).tolist():
            open_at, close = None, None
            for place, (length, low) in enumerate(held.statistics(own(i), words)):
                if length >= words and low < ident[i]:
                    if open_at is not None and place - words + 1 <= close:
                        close = place + 1
                        continue
                    if open_at is not None:
                        out.append((ident[i], tag[i], start[i] + open_at, start[i] + close))
                    open_at, close = place - words + 1, place + 1
            if open_at is not None:
                out.append((ident[i], tag[i], start[i] + open_at, start[i] + close))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("id", "tag", "start", "end"), columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))})
    return judge


def spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(_id, _tag, spans): the stretches [start, end) of words to remove, from a table (id, tag, text) without
    null ids. A null start stands for the whole text."""
    texts = docs.select("id", "tag", F.xxhash64("text").alias("one"), F.xxhash64(F.lit("b"), "text").alias("two"))
    twice = (texts.groupBy("one", "two").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
             .where("low < high").select("one", "two", "low", "n"))
    later = checkpointed(lookup_join(texts, checkpointed(twice), ["one", "two"], "n", "id").where("id > low").select(F.col("id").alias("_id"), F.col("tag").alias("_tag")).distinct())
    known = (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag"))
    rows = docs.join(broadcast_if_small(later, SMALL), known, "left_anti")
    near = checkpointed(shared_anchors(rows, words))
    runs = checkpointed(shared_windows(rows, near, words))
    held = runs.where("ref is null").agg(F.sum(F.col("end") - F.col("start") + (words - 1))).first()[0] or 0
    found = (passages(rows, runs, words, 1 + held // SHARD).groupBy("shard", "salt").applyInArrow(_judge(words), "id bigint, tag int, start int, end int"))
    all_of = later.select("_id", "_tag", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    found = found.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "start", "end").unionByName(all_of)
    return checkpointed(found.groupBy("_id", "_tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def first_only(docs: DataFrame, identity: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: id, n_words, n_removed and `kept`, the words that stay."""
    rows = docs.select(F.col(identity).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # Rows that share an id are told apart by a hash of their texts.
    repeated = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    rows = rows.withColumn("tag", F.hash("text") if repeated else F.lit(0))
    cuts = spans(rows.where("id is not null"), words)
    joined = rows.join(_known(cuts, "spans", SMALL), (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("id", "text", "spans")

    def run(batches):
        for batch in parts(batches):
            kept, count, removed = [], [], []
            for text, cut in zip(texts_of(batch), batch.column("spans").to_pylist()):
                own = text.split()          # at ASCII white space
                count.append(len(own))
                if cut and len(own) >= words:
                    stays = np.ones(len(own), bool)
                    for span in cut:
                        stays[slice(span["start"], span["end"])] = False
                    own = [own[i] for i in np.flatnonzero(stays).tolist()]
                removed.append(count[-1] - len(own))
                kept.append(b" ".join(own))
            yield rows_of({"id": batch.column("id"), "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})
    return whole_texts(joined).mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string")
