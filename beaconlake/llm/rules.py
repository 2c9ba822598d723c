"""Quality rules: hard limits, and an isolation forest on the rules' statistics.

One pass over the texts takes the statistics of every document. An isolation forest finds rows that
random splits set apart early: each of TREES trees is grown on ROWS rows of a bounded sample (the
SAMPLE smallest hashes of the id), and a row's anomaly is 2 ** (-mean path / expected path). One forest sees the
rates of characters and marks; another sees all statistics, those of the hard limits included (repeated lines
and words, length). Two, since splits on statistics that vary among good documents too hide what the others find.
The cut between normal and anomalous comes from the labelled documents, all of them: the anomaly that
best parts low quality from the rest while at least KEEP of the good ones stay; the second forest's from
what the first one leaves. A document is kept if it passes the hard limits and no forest finds it anomalous.

Defined results: a null text has no words, fails the limits and is not kept; without labels
nothing is anomalous; repeated rows get equal results; empty tables give empty results; columns
other than those named are not read.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconlake.llm.arrays import parts, rows_of, texts_of, whole_texts
from beaconlake.session import checkpointed

TREES, ROWS, SAMPLE = 128, 64, 8192
KEEP = 0.995            # share of the good labelled documents that the first cut must leave
KEEP_MORE = 0.999       # and the second, of those
MIN_WORDS = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["chars_per_word", "symbols_per_word", "upper_share", "one_mark_share", "dup_line_share", "repeat_share", "log_words"]
FORESTS = {"anomaly": (4, KEEP), "anomaly_all": (len(RATES), KEEP_MORE)}       # how many of the rates, and the share to leave
_SYMBOL, _UPPER, _TAIL, _WHITE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _UPPER
_KIND[0x80:0xC0] = _TAIL
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == n:
        return 0
    size = len(number)
    if size < 1 << 21:
        window = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        window = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1].astype(np.int64) * size + ids[2:]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift:shift + n - 2] |= often
    return int(inside.sum())


def statistics(text: bytes) -> tuple:
    """COUNTS, then RATES."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(RATES)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=5)
    chars = len(text) - int(kinds[_TAIL]) - int(kinds[_WHITE])
    lines = [x for x in text.split(b"\n") if x.split()]
    same = len(lines) - len(set(lines))
    repeat, symbols = repeated_words(words), int(kinds[_SYMBOL])
    single = sum([len(w) == 1 for w in words])
    return n, chars, symbols, same, repeat, chars / n, symbols / n, int(kinds[_UPPER]) / chars, single / n, same / len(lines), repeat / n, math.log(n)


def measured(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, the counts, rates): one pass over the whole texts."""
    def run(batches):
        for batch in parts(batches):
            got = [statistics(t) for t in texts_of(batch)]
            columns = {"id": batch.column("id")} | {c: pa.array([g[i] for g in got], pa.int64()) for i, c in enumerate(COUNTS)}
            yield rows_of(columns | {"rates": pa.array([list(g[len(COUNTS):]) for g in got], pa.list_(pa.float64()))})
    rows = whole_texts(docs).select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", rates array<double>")


def _expected_path(n):
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, seed: int, depth: int) -> list[tuple]:
    """One tree as nodes (column, value, left, right), leaves as (-1, path length, 0, 0)."""
    luck = np.random.RandomState(seed)
    nodes: list = []
    todo = [(rows, 0, None, None)]
    while todo:
        own, level, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = at
        low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(1), np.zeros(1))
        free = np.flatnonzero(high > low)
        if level >= depth or len(own) <= 1 or not len(free):
            nodes.append([-1, level + _expected_path(len(own)), at, at])
            continue
        column = int(free[luck.randint(len(free))])
        value = luck.uniform(low[column], high[column])
        nodes.append([column, value, at, at])
        left = own[:, column] < value
        todo += [(own[~left], level + 1, at, 1), (own[left], level + 1, at, 0)]
    return [tuple(x) for x in nodes]


def forest(sample: np.ndarray, trees: int = TREES, rows: int = ROWS) -> dict:
    """Trees as arrays, each grown on its own part of the sample."""
    rows = max(1, min(rows, len(sample)))
    depth = int(np.ceil(np.log2(max(2, rows))))
    grown = []
    for i in range(trees):
        pick = np.random.RandomState(1000 + i).choice(len(sample), rows, replace=False)
        grown.append(grow(sample[pick], i, depth))
    width = max(len(t) for t in grown)
    full = np.array([t + [(-1, 0.0, 0, 0)] * (width - len(t)) for t in grown], dtype=np.float64)
    return {"column": full[:, :, 0].astype(np.int32), "value": full[:, :, 1], "left": full[:, :, 2].astype(np.int32),
            "right": full[:, :, 3].astype(np.int32), "depth": depth, "expected": max(_expected_path(rows), 1e-9)}


def anomalies(rates: np.ndarray, trees: dict) -> np.ndarray:
    """2 ** (-mean path / expected path) of every row, rounded so that engines and runs agree."""
    total = np.zeros(len(rates))
    row = np.arange(len(rates))
    for column, value, left, right in zip(trees["column"], trees["value"], trees["left"], trees["right"]):
        at = np.zeros(len(rates), np.int32)
        for _ in range(trees["depth"]):
            below = rates[row, np.maximum(column[at], 0)] < value[at]
            at = np.where(column[at] < 0, at, np.where(below, left[at], right[at]))
        total += value[at]
    return np.round(2.0 ** (-total / len(trees["column"]) / trees["expected"]), 4)


def scored(stats: DataFrame, trees: dict[str, dict]) -> DataFrame:
    """The statistics with a column for each forest."""
    shared = stats.sparkSession.sparkContext.broadcast(trees)
    names = stats.columns

    def run(batches):
        for batch in batches:
            rates = np.array(batch.column(names.index("rates")).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            found = [pa.array(anomalies(rates[:, :FORESTS[name][0]], one)) for name, one in shared.value.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*names, *shared.value])
    return stats.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in stats.dtypes) + "".join(f", {name} double" for name in trees))


def cut_off(scores: DataFrame, labels: DataFrame, column: str = "anomaly", keep: float = KEEP) -> float:
    """The anomaly above which a document falls: over all labelled rows, the one with the best
    (share of bad found - share of good lost) among those that lose at most 1 - keep of the good. Scores have
    four digits, so the counts are few."""
    known = labels.select(F.col("doc_id").alias("_id"), "quality").dropna().groupBy("_id").agg(F.min("quality").alias("quality"))
    bins = (scores.join(known, F.col("id") == F.col("_id")).groupBy(F.col(column).alias("value"))
            .agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("quality") != 0, 1).otherwise(0)).alias("good")).collect())
    bins = sorted((r["value"], r["bad"], r["good"]) for r in bins)
    all_bad, all_good = sum(b for _, b, _ in bins), sum(g for *_, g in bins)
    best, cut, bad, good = 0.0, 1.0, 0, 0
    for value, b, g in reversed(bins):          # documents at `value` and above would fall
        bad, good = bad + b, good + g
        gain = bad / max(1, all_bad) - good / max(1, all_good)
        if good <= (1 - keep) * all_good and gain > best:
            best, cut = gain, value - 0.00005
    return cut


def failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, the counts, base_failed, the anomaly by each forest, kept."""
    stats = checkpointed(measured(docs, identity, text))
    sample = stats.where(~failed()).orderBy(F.xxhash64("id", F.lit("forest")), "id").limit(SAMPLE).select("rates").toArrow()   # a bounded sample
    rates = np.array(sample.column("rates").to_pylist(), dtype=np.float64)
    out = ["id", *COUNTS, failed().alias("base_failed")]
    if not len(rates):
        return stats.select(*out, *[F.lit(0.0).alias(name) for name in FORESTS], (~failed()).alias("kept"))
    scores = checkpointed(scored(stats, {name: forest(rates[:, :width]) for name, (width, _) in FORESTS.items()}))
    normal = ~failed()
    for name, (_, keep) in FORESTS.items():
        normal = normal & (F.col(name) <= cut_off(scores.where(normal), labels, name, keep))
    return scores.select(*out, *FORESTS, normal.alias("kept"))
