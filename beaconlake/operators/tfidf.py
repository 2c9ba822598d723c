"""TF-IDF search over word and word-pair terms, as joins and sums."""
import functools
import os
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake.functions.numeric import once
from beaconlake.operators import trends as tr
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.session import checkpointed

c = F.col
VOCABULARY = 40000      # fixed value: default size; a vocabulary up to it is sent to every task
HEADS = 3               # strongest terms of a query that set its first threshold
TASK_BYTES = 4 << 20    # text that one task cuts into terms; the counts of a byte take some 70 bytes of memory
SLACK = 1e-8            # sums in another order may differ by less


@functools.cache
def stop_words(language="english") -> tuple[str, ...]:
    """Spark's own list of a language: the one StopWordsRemover.loadDefaultStopWords gives, read without a session."""
    homes = [Path(pyspark.__file__).parent / "jars", Path(os.environ.get("SPARK_HOME", "/")) / "jars"]
    jar = next(j for home in homes for j in sorted(home.glob("spark-mllib_*.jar")))
    with zipfile.ZipFile(jar) as parts:
        return tuple(w for w in parts.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split("\n") if w)


def term_list(text, stop=None):
    """Words of two characters or more without stop words, then neighbouring pairs."""
    left_out = stop_words() if stop is None else stop
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*left_out))
    return once(words, lambda ws: F.concat(ws, F.filter(_pairs(ws), lambda p: p.isNotNull())))


def _pairs(words):
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                      lambda a, b: F.concat_ws(" ", a, b))


def dealt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows by key, in as many partitions as their text needs: a task's share, and with it the memory of all
    work by key behind it, does not grow with the corpus. The number is given, so Spark merges none."""
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES)), key)


def by_id(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The rows by id, in as many partitions as the stored table `like` has."""
    return rows.repartition(like.rdd.getNumPartitions(), "id")


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(term_list(c(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, size: int) -> DataFrame:
    """The `size` most frequent terms of the corpus with ln((1 + n) / (1 + df)) + 1. Stored
    once: it is used for the queries and for the documents."""
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = stats.orderBy(F.desc("total"), "term").limit(size).withColumn("n", n_docs.scalar())
    return checkpointed(kept.select("term", (F.log((1 + c("n")) / (1 + c("df"))) + 1).alias("idf")))


def unit_weights(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, w) with every key's weights of length 1."""
    w = counts.join(vocab, "term").select(key, "term", (c("tf") * c("idf")).alias("w"))
    size = w.groupBy(key).agg(F.sqrt(F.sum(c("w") * c("w"))).alias("size"))
    return w.join(size, key).select(key, "term", (c("w") / c("size")).alias("w"))


def postings(docs: DataFrame, queries: DataFrame, size=VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(id, term, w) of the documents for the terms that any query asks for, and (qid, term, qw) of the
    queries; all weights are of unit length. docs: id, text; queries: qid, text.

    The documents are shuffled and cut into terms once: the counts are stored, and used for the
    vocabulary and for the weights. A vocabulary of up to 40,000 terms is broadcast, a larger one
    joined as Spark sees fit."""
    counts = checkpointed(term_counts(dealt(docs, "id", "text"), "id", "text"))
    vocab = vocabulary(counts, docs.agg(F.count(F.lit(1))), size)
    sent = F.broadcast if size <= VOCABULARY else (lambda df: df)
    asked = checkpointed(unit_weights(term_counts(queries, "qid", "text"), sent(vocab), "qid").withColumnRenamed("w", "qw"))
    marked = vocab.join(asked.select("term", F.lit(True).alias("asked")).distinct(), "term", "left")
    weighted = by_id(counts.join(sent(marked), "term").select("id", "term", "asked", (c("tf") * c("idf")).alias("w")), counts)
    per_doc = weighted.groupBy("id").agg(F.sqrt(F.sum(c("w") * c("w"))).alias("len"), F.collect_list(F.when(c("asked"), F.struct("term", "w"))).alias("hits"))
    return per_doc.select("id", "len", F.inline("hits")).select("id", "term", (c("w") / c("len")).alias("w")), asked


def search(docs: DataFrame, queries: DataFrame, size=VOCABULARY) -> DataFrame:
    """Cosine of every (query, document) pair that shares a term."""
    held, asked = postings(docs, queries, size)
    return held.join(broadcast_if_small(asked), "term").groupBy("qid", "id").agg(F.sum(c("w") * c("qw")).alias("sim"))


def bounds(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, term, qw, at, rest): a query's terms, the strongest first; `rest` is the most that this term and
    all behind it can add to a score: sums of each term's largest document weight."""
    most = held.groupBy("term").agg(F.max("w").alias("most"))
    strong = asked.join(most, "term").withColumn("reach", c("qw") * c("most"))
    order = Window.partitionBy("qid").orderBy(F.desc("reach"), "term")
    return strong.select("qid", "term", "qw", F.row_number().over(order).alias("at"), F.sum("reach").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))


def kth_best(scores: DataFrame, k: int) -> DataFrame:
    """(qid, floor): the k-th best score of each query that has as many."""
    best = tr.top_n(scores, ["qid"], [F.desc("sim")], k, "place")
    return best.where(c("place") == k).select("qid", (c("sim") - SLACK).alias("floor"))


def search_top(docs: DataFrame, queries: DataFrame, k: int, size=VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The pairs (qid, id, sim) that can be among a query's best k, ties included; and which they are
    (qid, id), to compare with all pairs that share a term.

    A query's strongest terms give a first floor: the k-th best score so far. Terms that together can't reach
    it are not worth a look of their own, so only documents with one of the others are scored. Those whose score
    by these terms plus the most that the rest can add stays below the next floor go; the rest is summed for
    what is left."""
    held, asked = postings(docs, queries, size)
    held = checkpointed(held)
    terms = checkpointed(bounds(held, asked))
    scored = lambda pairs: pairs.groupBy("qid", "id").agg(F.sum("part").alias("sim"))
    with_terms = lambda some: by_id(held, held).join(broadcast_if_small(some), "term").withColumn("part", c("w") * c("qw"))
    first = checkpointed(kth_best(scored(with_terms(terms.where(c("at") <= HEADS))), k))
    essential = checkpointed(terms.join(broadcast_if_small(first), "qid", "left").where((c("at") <= HEADS) | (c("rest") >= F.coalesce("floor", F.lit(0.0)))).drop("floor"))
    behind = terms.join(essential.groupBy("qid").agg(F.max("at").alias("last")), "qid").groupBy("qid").agg(F.coalesce(F.max(F.when(c("at") == c("last") + 1, c("rest"))), F.lit(0.0)).alias("behind"))
    partly = checkpointed(scored(with_terms(essential)))
    floor = kth_best(partly, k).join(behind, "qid", "right").fillna(0.0, ["floor"])
    left = checkpointed(partly.join(broadcast_if_small(floor), "qid").where(c("sim") + c("behind") >= c("floor")).select("qid", "id"))
    near = by_id(held, held).join(broadcast_if_small(by_id(left, held)), "id").join(broadcast_if_small(terms.select("qid", "term", "qw")), ["qid", "term"])
    return scored(near.withColumn("part", c("w") * c("qw"))), left
