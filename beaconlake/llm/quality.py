"""Quality grades by ordinal regression on hashed text.

The model is a cumulative-link one: a document has a score (the sum of the hashed weights of its
distinct words and of a few marks of its style), and the chance that its grade exceeds k is
logistic(score - threshold k), with the thresholds in order and the weights shared by all grades.
That gives an expected grade and a tail probability to select by.

The model is fitted on at most SAMPLE labelled documents, those with the smallest hash of their
id (a bound of the fit, stated here); every document is scored. Texts stay where they lie: one
narrow scan gathers hashed features of the sample, another scores all rows against the broadcast
weights (2 ** BITS numbers).

Defined results: a null or empty text has no words and gets the grade of the style marks alone; labels without
a grade are ignored, of repeated labels of an id the lowest grade holds; without labels every
document gets the top grade and is kept; empty tables give empty results; other columns pass.
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from beaconlake.llm.arrays import parts, plain, rows_of, texts_of, whole_texts

BITS = 18
MASK = (1 << BITS) - 1
STEMS = (3, 5, 7)        # beginnings of a word that count like words
SAMPLE = 8_000
TAIL = 0.5              # documents are kept from this chance of the top grade on
CACHE = 150_000         # words a task remembers
STEPS, PENALTY, LONG_STEP, RARE = 300, 1e-3, 20.0, 3
_STRIP = b" .,;:!?\"'()[]{}*%$#&|<>-_"
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 2
_KIND[[ord(c) for c in "0123456789"]] = 3
_KIND[[ord(c) for c in "#*$%&|<>!"]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5

def word_slots(word: bytes) -> list[int]:
    """Slots of a word and of its first characters: lower case, without the marks around it."""
    bare = word.strip(_STRIP).lower()
    if not bare:
        return []
    found = [zlib.crc32(bare) & MASK]
    letters = bare.decode("utf-8", "replace")
    for size in STEMS:
        if len(letters) > size:
            found.append(zlib.crc32(b"\1" + letters[:size].encode()) & MASK)
    return found


def style_slots(text: bytes, words: int, distinct: int) -> list[int]:
    """Slots of the style marks: shares of kinds of characters and of distinct words, in steps."""
    if not text:
        return [zlib.crc32(b"\0empty") & MASK]
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    seen = max(1, len(text) - int(kinds[5]))
    marks = [("upper", 20 * int(kinds[1]) // seen), ("digit", 20 * int(kinds[3]) // seen), ("symbol", 40 * int(kinds[4]) // seen),
             ("distinct", 10 * distinct // max(1, words)), ("size", min(12, words.bit_length())), ("length", min(20, len(text) // max(1, words)))]
    return [zlib.crc32(f"\0{n}{v}".encode()) & MASK for n, v in marks]

def slots(text: bytes) -> np.ndarray:
    """All slots of a text, each once."""
    words = text.split()
    own = set(words)
    found = {x for w in own for x in word_slots(w)}
    found.update(style_slots(text, len(words), len(own)))
    return np.fromiter(found, np.int32, len(found))

def _pace(row, at, weight, n, m):
    """One over a bound of the loss's curvature, by power iteration."""
    x = np.ones(m)
    size = 1.0
    for _ in range(15):
        x = np.bincount(at, (np.bincount(row, x[at], minlength=n) * weight)[row], minlength=m)
        size = np.linalg.norm(x) or 1.0
        x /= size
    return 2 / size


def fit(at: np.ndarray, row: np.ndarray, grades: np.ndarray, levels: int, steps: int = STEPS, penalty: float = PENALTY):
    """Weights and ordered thresholds, by accelerated proximal steps with a 1-norm on the weights.
    Document `row[i]` has slot `at[i]`. Steps start long and shorten when the loss rises. A grade
    weighs as the root of its count."""
    n = len(grades)
    used, at, docs = np.unique(at, return_inverse=True, return_counts=True)
    often = docs >= RARE                            # a slot of one or two documents says nothing
    stay = often[at]
    at, row = (np.cumsum(often) - 1)[at[stay]], row[stay]
    used = used[often]
    weight = (1 / np.sqrt(np.maximum(1, np.bincount(grades, minlength=levels))))[grades]
    weight /= weight.sum()
    above = grades[:, None] > np.arange(levels - 1)[None, :]
    pace = LONG_STEP * _pace(row, at, weight, n, len(used))
    w, theta = np.zeros(len(used)), np.linspace(-1, 1, levels - 1)
    ahead_w, ahead_t, speed, last = w, theta, 1.0, np.inf
    for _ in range(steps):
        score = np.bincount(row, ahead_w[at], minlength=n)[:, None] - ahead_t[None, :]
        # Cumulative links: one logistic loss for each threshold.
        loss = float((np.logaddexp(0, np.where(above, -score, score)) * weight[:, None]).sum() + penalty * np.abs(ahead_w).sum())
        if loss > 1.02 * last:
            ahead_w, ahead_t, speed, pace, last = w, theta, 1.0, pace / 2, np.inf
            continue
        last = loss
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - above) * weight[:, None]
        new = ahead_w - pace * np.bincount(at, error.sum(1)[row], minlength=len(used))
        new = np.sign(new) * np.maximum(np.abs(new) - pace * penalty, 0)
        new_t = np.sort(ahead_t + pace * error.sum(0))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead_w = new + (speed - 1) / faster * (new - w)
        ahead_t = np.sort(new_t + (speed - 1) / faster * (new_t - theta))
        w, theta, speed = new, new_t, faster
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return weights, theta


def graded(labels: DataFrame, identity: str = "doc_id") -> DataFrame:
    """(id, grade): 0 low quality, 1 good but toxic, 2 good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col(identity).alias("id"), grade.alias("grade")).dropna().groupBy("id").agg(F.min("grade").alias("grade"))

def train(docs: DataFrame, grades: DataFrame, identity: str = "doc_id", text: str = "text", levels: int = 3, sample: int = SAMPLE):
    """Weights and thresholds, or None without labelled documents."""
    chosen = grades.orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(sample)              # a bounded sample
    rows = whole_texts(docs).select(F.col(identity).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def features(batches):
        for batch in parts(batches):
            yield rows_of({"id": batch.column("id"), "grade": batch.column("grade"),
                           "slots": pa.array([slots(t) for t in texts_of(batch)], pa.list_(pa.int32()))})
    got = rows.mapInArrow(features, f"id {dict(rows.dtypes)['id']}, grade int, slots array<int>").dropDuplicates(["id"]).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("id").combine_chunks()                # the same sums on every run
    found = got.column("slots").combine_chunks()
    row = np.repeat(np.arange(got.num_rows, dtype=np.int32), np.diff(found.offsets.to_numpy()))
    return fit(found.flatten().to_numpy(), row, got.column("grade").to_numpy(), levels)


def scored(docs: DataFrame, model, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of `docs` and its score by the model: `_expected` grade and `_tail`, the
    chance of the top grade."""
    if model is None:
        return docs.withColumns({"_expected": F.lit(None).cast("double"), "_tail": F.lit(1.0)})
    weights, theta = model
    shared = whole_texts(docs).sparkSession.sparkContext.broadcast((weights, theta))
    names = docs.columns

    def run(batches):
        weights, theta = shared.value
        known = {}
        for batch in parts(batches):
            batch = batch.rename_columns([*names])
            score = []
            for t in texts_of(batch, text):
                words = t.split()
                own = set(words)
                for w in own.difference(known):
                    known[w] = tuple([x for x in word_slots(w) if weights[x]])
                found = {x for some in map(known.__getitem__, own) if some for x in some}
                found.update(style_slots(t, len(words), len(own)))
                score.append(weights[np.sort(np.fromiter(found, np.int64, len(found)))].sum())
                if len(known) > CACHE:
                    known = {}
            p = 1 / (1 + np.exp(-np.clip(np.array(score)[:, None] - theta[None, :], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(p[:, -1].copy())], names=[*names, "_expected", "_tail"])
    schema = StructType(list(docs.schema.fields)).add("_expected", DoubleType()).add("_tail", DoubleType())
    return docs.mapInArrow(run, schema)

def select(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", tail: float = TAIL) -> DataFrame:
    """The documents that are good and clean by the model."""
    model = train(docs, graded(labels), identity, text)
    rows, at = plain(docs)
    return scored(rows, model, at[identity], at[text]).where(F.col("_tail") >= tail).drop("_expected", "_tail").toDF(*docs.columns)
