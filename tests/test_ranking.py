"""Solvers and scores of the funnel."""
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.operators import encode as en, evaluation as ev, ranking as rk


def test_basket_is_optimal_and_in_budget(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", i, i + 1, round(rng.random(), 4), float(rng.choice([8, 15, 45, 90, 160])), 3.0, "discuss") for p in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "persona string, id long, place int, impact double, effort_min double, time_budget_hours double, mode string")
    got = rk.packed(df).collect()
    for p in {r[0] for r in rows}:
        items = [r for r in rows if r[0] == p]
        best = max((sum(round(x[3] * 1000) for x in s) for n in range(13) for s in itertools.combinations(items, n) if sum(x[4] for x in s) <= 180), default=0)
        mine = [r for r in got if r.persona == p]
        assert sum(r.minutes for r in mine) <= 180
        assert sum(round(r.impact * 1000) for r in mine) == best


def test_monitors_get_no_basket(spark):
    df = spark.createDataFrame([("p", 1, 1, 0.5, 10.0, 3.0, "monitor")], "persona string, id long, place int, impact double, effort_min double, time_budget_hours double, mode string")
    assert rk.packed(df).count() == 0


def test_diversity_matches_a_plain_greedy_pass(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(50, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = m.astype(np.float32).astype(np.float64)
    imp = sorted(rng.random(50), reverse=True)
    df = spark.createDataFrame([("p", i, float(imp[i]), i + 1, [float(x) for x in m[i]]) for i in range(50)], "persona string, id long, impact double, place int, vec array<float>")
    for lam in (0.75, 1.0):
        got = [r.id for r in rk.diversified(df, 10, lam).orderBy("rank").collect()]
        pool, picked = list(range(40)), []
        lo, hi = min(imp[:40]), max(imp[:40])
        while len(picked) < 10:
            val = {i: lam * (imp[i] - lo) / (hi - lo) - (1 - lam) * max((m[i] @ m[j] for j in picked), default=0.0) for i in pool if i not in picked}
            picked.append(max(val, key=lambda i: val[i]))
        assert got == picked
    assert got == list(range(10))


def test_score_gate_and_zero_fallbacks(spark):
    base = {s: 0.5 for s in lx.SIGNALS if s not in ("platform_fit", "effort_fit")}
    df = spark.createDataFrame([("p", 1, "github", "contribute", 0.0), ("p", 2, "github", "contribute", 1.0), ("p", 3, "github", "monitor", 0.0)], "persona string, id long, source string, mode string, w double")
    for k, v in base.items():
        df = df.withColumn(k, F.lit(v))
    df = df.withColumn("contribution_worth", F.col("w")).withColumn("effort_min", F.lit(0.0))
    got = {r.id: r for r in rk.with_scores(df).collect()}
    w = lx.MODE_WEIGHTS["contribute"]
    raw = sum(x * {"platform_fit": 1.0, "effort_fit": 1.0, "contribution_worth": 0.0}.get(s, 0.5) for s, x in w.items())
    assert got[1].impact == pytest.approx(raw * (0.45 + 0.55 * 0.5), abs=1e-4)       # a worth of zero counts as one half
    assert got[1].roi == pytest.approx(raw * (0.45 + 0.55 * 0.5) / 0.5, abs=2e-4)    # no minutes counts as thirty
    assert got[2].impact > got[1].impact and got[3].roi == got[3].impact


def test_ndcg_of_the_ideal_order_is_one(spark):
    rows = [("p", i, g) for i, g in enumerate([3, 2, 2, 1, 0], 1)]
    df = spark.createDataFrame(rows, "persona string, rank int, grade int")
    assert ev.ndcg(df, df, 10).first().ndcg == pytest.approx(1.0)
    worse = df.withColumn("rank", 6 - F.col("rank"))
    assert 0 < ev.ndcg(worse, df, 10).first().ndcg < 1
    assert ev.share_relevant(df, 10).first().precision == 0.8


def test_outside_order_puts_unlisted_rows_last(spark):
    df = spark.createDataFrame([("p", i, i) for i in range(1, 6)], "persona string, id long, place int")
    given = spark.createDataFrame([("p", 4, 0), ("p", 2, 1)], "persona string, id long, given int")
    assert [r.id for r in rk.external_order(df, given).orderBy("rank").collect()] == [4, 2, 1, 3, 5]


def test_encoded_candidates_equal_brute_force(spark):
    from beaconlake.operators import encode as en, personas as ps
    from beaconlake.plans import registry  # noqa: F401
    from beaconlake.plans import q_ranking as qr
    from beaconlake.plans.q_columns import items
    folder = "/root/testdata/sf0.001"
    rows = items(spark, folder).selectExpr("ingest_seq as id", "source", "title", "body").collect()
    text = [f"{r.title or ''}\n{r.body or ''}".strip() for r in rows]
    docs = en.HashedWords(64)(text).astype(float)
    got = {}
    for r in qr.encoded_candidates(spark, folder).collect():
        got.setdefault((r.persona, r.source), []).append((r.place, r.id, r.sim_micro))
    people = qr.people(spark).collect()
    for p in people:
        facets = en.HashedWords(64)([f for f in [p.goal, *p.interests] if f]).astype(float)
        sims = (docs @ facets.T).max(1)
        for s in p.allowed:
            best = sorted((-sims[i], r.id) for i, r in enumerate(rows) if r.source == s)[:20]
            assert [x[2] for x in sorted(got.get((p.id, s), []))] == [int(np.floor(-v * 1e6 + 0.5)) for v, _ in best]


def test_a_model_is_built_once_in_each_worker(spark, tmp_path):
    where = str(tmp_path)

    def make():
        import os
        import uuid
        open(f"{where}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t))] for t in texts]
    texts = spark.range(4000).selectExpr("repeat('x', cast(id % 7 as int)) as text").repartition(40)
    got = texts.select("text", en.encoder(make=make)("text").alias("v")).collect()
    assert all(r.v == [len(r.text)] for r in got)
    made = [name.split("-")[0] for name in os.listdir(where)]
    assert 1 <= len(made) == len(set(made)) < 40


def test_the_default_scorer_and_its_model_agree(spark):
    rows = spark.createDataFrame([("Data tools, data", "tools for Data_x and data"), ("", "x"), (None, None), ("a b", None), ("É é", "É")], "q string, t string")
    got = rows.select(en.pair_scorer()(F.col("q"), F.col("t")).alias("a"), en.pair_scorer(make=lambda: en.overlaps)(F.col("q"), F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [1.0, 0.0, 0.0, 0.0, 1.0]


def test_bounded_search_finds_the_best_and_scores_less(spark, monkeypatch):
    from beaconlake.operators import tfidf
    rng = random.Random(5)
    rare = [f"term{i}" for i in range(400)]
    common = ["alpha", "beta", "gamma", "delta"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    docs = spark.createDataFrame([(i, text(40)) for i in range(600)] + [(900, ""), (901, None), (902, "the and of")], "id long, text string").repartition(4)
    asks = spark.createDataFrame([(i, text(6)) for i in range(25)] + [(100, "alpha beta"), (101, "never seen"), (102, None)], "qid long, text string")
    every = {}
    for r in tfidf.search(docs, asks).collect():
        every.setdefault(r.qid, []).append((-round(r.sim, 9), r.id))
    got, scored = tfidf.search_top(docs, asks, 5)
    best = {}
    for r in got.collect():
        best.setdefault(r.qid, []).append((-round(r.sim, 9), r.id))
    assert {q: sorted(x)[:5] for q, x in best.items()} == {q: sorted(x)[:5] for q, x in every.items()}
    assert scored.count() < 0.5 * sum(map(len, every.values()))
    assert len(tfidf.stop_words()) > 150 and "the" in tfidf.stop_words() and "le" in tfidf.stop_words("french")


def test_search_partitions_follow_the_text(spark, monkeypatch):
    from beaconlake.operators import tfidf
    docs = spark.createDataFrame([(i, f"alpha beta term{i % 50} term{i % 70}") for i in range(2000)] + [(None, "alpha"), (5, None)], "id long, text string")
    asks = spark.createDataFrame([(1, "alpha term3")], "qid long, text string")
    whole = {(r.id, r.term): round(r.w, 12) for r in tfidf.postings(docs, asks)[0].collect()}
    monkeypatch.setattr(tfidf, "TASK_BYTES", 2000, raising=False)
    held, _ = tfidf.postings(docs, asks)
    assert held.rdd.getNumPartitions() >= 20
    assert {(r.id, r.term): round(r.w, 12) for r in held.collect()} == whole
