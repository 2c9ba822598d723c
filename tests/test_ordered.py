"""Ordered operators against plain Python, with one key that holds most rows."""
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from beaconlake.operators import ordered, skew


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", i, rng.randrange(6), rng.choice("abc")) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "key string, seq long, v long, act string").repartition(5)


def test_running_sum_carries_over_partitions(spark):
    data = rows()
    got = ordered.running_sum(frame(spark, data), ["key"], ["seq"], "v", "before", partitions=7)
    want, total = {}, defaultdict(int)
    for key, seq, v, _ in sorted(data, key=lambda r: r[1]):
        want[seq] = total[key]
        total[key] += v
    assert {r.seq: r.before for r in got.collect()} == want


def test_previous_value_is_lag(spark):
    data = rows(seed=2)
    got = ordered.previous_value(frame(spark, data), ["key"], ["seq"], "act", "prev", partitions=9)
    want, last = {}, {}
    for key, seq, _, act in sorted(data, key=lambda r: r[1]):
        want[seq] = last.get(key)
        last[key] = act
    assert {r.seq: r.prev for r in got.collect()} == want


def test_numbered_is_a_dense_global_order(spark):
    data = rows(seed=3)
    got = ordered.numbered(frame(spark, data), ["key", "seq"]).collect()
    want = {r[1]: i for i, r in enumerate(sorted(data, key=lambda r: (r[0], r[1])))}
    assert {r.seq: r.position for r in got} == want


def test_value_positions_and_percentile(spark):
    data = rows(seed=4)
    pos = ordered.value_positions(frame(spark, data), ["key"], "v")
    by = defaultdict(list)
    for key, _, v, _ in data:
        by[key].append(v)
    for r in pos.collect():
        assert r.below == sum(x < r.v for x in by[r.key]) and r.total == len(by[r.key]) and r.n == by[r.key].count(r.v)
    p = ordered.linear_percentile(pos, ["key"], "v", 0.3, "p")
    for r in p.collect():
        assert abs(r.p - np.percentile(by[r.key], 30)) < 1e-9
    mid = ordered.value_at(pos, ["key"], "v", F.floor(F.col("total") / 2), "m")
    for r in mid.collect():
        assert r.m == sorted(by[r.key])[len(by[r.key]) // 2]


def test_lookup_join_keeps_every_row_under_skew(spark):
    data = rows(seed=5)
    df = frame(spark, data)
    table = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).where("key <> 'k3'")
    got = skew.lookup_join(df, table, ["key"], "n", "seq").collect()
    top = defaultdict(int)
    for key, _, v, _ in data:
        top[key] = max(top[key], v)
    assert len(got) == len(data)
    assert all(r.top == (None if r.key == "k3" else top[r.key]) for r in got)
