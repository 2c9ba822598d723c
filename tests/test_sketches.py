"""Bounds of the approximate aggregates."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from beaconlake.operators import sketches as sk
from beaconlake.plans import registry  # noqa: F401 (the registry has to come first)


def skewed_words(n=20000):
    rng = np.random.default_rng(7)
    return [f"w{int(x)}" for x in rng.pareto(1.25, n) * 10]


def test_frequency_sketches_combine_and_stay_in_bounds(spark):
    words = skewed_words()
    df = spark.createDataFrame([(w, w[:2]) for w in words], "term string, part string").repartition(4)
    exact = {r.term: r.n for r in df.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    for keys in ([], ["part"]):
        got = sk.frequent(sk.frequency_sketches(df, keys, "term"), 50, "term").collect()
        assert len(got) == 50 and all(exact[r.term] <= r.estimate <= exact[r.term] + 5e-4 * len(words) + 1 for r in got)


def plain_table(words, width, depth):
    """The count-min table as a dict of cells, and an item's cells."""
    def cells(word):
        digest = hashlib.md5(word.encode()).hexdigest()
        one, two = int(digest[:8], 16), int(digest[8:16], 16) | 1
        return [(i, (one + i * two) % width) for i in range(depth)]
    table = {}
    for w in words:
        for x in cells(w):
            table[x] = table.get(x, 0) + 1
    return table, cells


def test_count_min_merges_and_never_undercounts(spark):
    words = skewed_words()
    eps, delta = 5e-4, 0.01
    width, depth = sk.count_min_size(eps, delta)
    assert (width, depth) == (5437, 5)
    df = spark.createDataFrame([(w, w[:2]) for w in words] + [(None, "x")], "term string, part string").repartition(4)
    table, cells = plain_table(words, width, depth)
    whole = sk.count_min(df, [], "term", width, depth)
    parts = sk.merged_count_min(sk.count_min(df, ["part"], "term", width, depth))
    for got in (whole, parts):
        assert {(r.row, r.bucket): r.n for r in got.collect()} == table
    exact = {w: words.count(w) for w in set(words)}
    asked = spark.createDataFrame([(w,) for w in exact] + [("never seen",)], "term string")
    got = {r.term: r.estimate for r in sk.count_min_estimates(parts, asked, "term", width, depth).collect()}
    assert got == {w: min(table.get(x, 0) for x in cells(w)) for w in [*exact, "never seen"]}
    assert all(got[w] >= n for w, n in exact.items())
    assert sum(got[w] - n <= eps * len(words) for w, n in exact.items()) >= (1 - delta) * len(exact)


def test_small_tables_are_over_within_their_bound(spark):
    words = skewed_words(5000)
    width, depth = sk.count_min_size(0.02, 0.05)
    df = spark.createDataFrame([(w, 2) for w in words], "term string, n int")
    weighted = sk.count_min(df, [], "term", width, depth, "n")
    got = sk.count_min_estimates(weighted, df.select("term").distinct(), "term", width, depth).collect()
    assert all(2 * words.count(r.term) <= r.estimate for r in got)
    assert sum(r.estimate > 2 * words.count(r.term) + 0.02 * 2 * len(words) for r in got) <= 0.05 * len(got)


def test_distinct_sketches_union(spark):
    a = spark.range(6000).selectExpr("'a' as g", "concat('u', id) as author")
    b = spark.range(4000, 11000).selectExpr("'b' as g", "concat('u', id) as author")
    s = sk.reach_sketches(a.union(b).union(a), ["g"])
    assert abs(sk.merged_reach(s, []).first().reach - 11000) <= 330
