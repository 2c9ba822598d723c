"""Text encoders and pair scorers as Arrow-batched functions with pluggable models.

A model comes from a factory, a function without arguments that can be pickled; it is called in the Python
workers. The model it returns stays with a broadcast value, so a worker builds it once, however many tasks
it works on, and tasks get no copy of it."""
import hashlib
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

_WORD = re.compile(r"\w+")
KNOWN = 200_000         # words whose place a worker remembers


def embedding_text(title, body):
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))


class HashedWords:
    """Signed word-hash vectors of unit length: the offline default model. A text without words points along the first axis."""

    def __init__(self, dims):
        self.dims, self.known = dims, {}

    def place(self, word):
        got = self.known.get(word)
        if got is None:
            digest = hashlib.md5(word.encode()).hexdigest()
            got = int(digest[:8], 16) % self.dims, 1.0 if int(digest[8], 16) >= 8 else -1.0
            if len(self.known) < KNOWN:
                self.known[word] = got
        return got

    def __call__(self, texts):
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            places = [self.place(w) for w in _WORD.findall((text or "").lower())]
            if places:
                at, sign = zip(*places)
                np.add.at(row, list(at), sign)
            size = np.sqrt((row * row).sum())
            if size == 0:
                row[0] = size = 1.0
            row /= size
        return out.astype(np.float32)


def _model_of(make):
    """The model of a factory, built at its first use in each worker. The factory travels as bytes, which a
    worker can load without this library installed."""
    kept = SparkSession.active().sparkContext.broadcast({"make": cloudpickle.dumps(make)})

    def model():
        if "model" not in kept.value:
            kept.value["model"] = pickle.loads(kept.value["make"])()
        return kept.value["model"]
    return model


def encoder(dims=64, make: Callable[[], Callable] | None = None):
    """Column function text -> vector. `make()` gives a model, encode(list of texts) -> array; without it
    the model is HashedWords."""
    model = _model_of(make or (lambda: HashedWords(dims)))

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(model()(texts.tolist()), dtype=np.float32)))
    return encode


def overlap_score(query, text):
    """Share of a query's different words that the text holds: the offline default pair scorer."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    asked = words(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)).otherwise(0.0)


def overlaps(queries, texts):
    """The same score as a model for the hook."""
    words = lambda x: set(_WORD.findall((x or "").lower()))
    asked = [words(q) for q in queries]
    return [len(a & words(t)) / len(a) if a else 0.0 for a, t in zip(asked, texts)]


def pair_scorer(make: Callable[[], Callable] | None = None):
    """Column function (query, text) -> relevance. `make()` gives a model, score(queries, texts) -> array;
    without it the default runs inside Spark."""
    if make is None:
        return overlap_score
    model = _model_of(make)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series(model()(queries.tolist(), texts.tolist()), dtype="float64")
    return score
