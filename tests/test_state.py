"""Feedback state: batch against a direct simulation, and stream against batch."""
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.operators import feedback as fb
from beaconlake.session import scratch_path
from beaconlake.streaming import events as se, folds

SCHEMA = ("seq long, ts timestamp, user_id string, persona_key string, opportunity_id string, action string, reason string, rank int, page int, bucket string, source string, "
          "mode string, signals array<double>")


def log(n=1500, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = "u0" if rng.random() < 0.5 else f"u{rng.randrange(9)}"
        mode = "monitor" if i > n * 0.6 and user == "u0" else "contribute"
        out.append((i, datetime(2026, 1, 1) + timedelta(minutes=i), user, "p", f"c{rng.randrange(4)}", rng.choice(fb.ACTIONS + ["open_detail", "page_view"]),
                    rng.choice([None, "why"]), i % 10, 0, "learn", "devto", mode, [] if rng.random() < 0.1 else [round(rng.random(), 2) for _ in lx.SIGNALS]))
    return out


def simulate(rows):
    state, learner = {}, {}
    for seq, ts, u, p, o, act, reason, rank, page, b, s, mode, sig in rows:
        if act not in fb.ACTIONS:
            continue
        st = state.setdefault((u, p, o), {"status": "none", "saved": False, "reason": None, "rank": rank, "applied": 0})
        trains = None
        if act in ("engage", "dismiss"):
            if st["status"] != fb.STATUS_OF[act]:
                trains = act
            st["status"] = fb.STATUS_OF[act]
        elif act == "undo":
            st["status"] = "none"
        elif act == "save":
            if not st["saved"]:
                trains = "save"
            st["saved"] = True
        else:
            st["saved"] = False
        st["reason"] = reason if reason is not None else st["reason"]
        if trains:
            st["applied"] += 1
            if sig:
                m, n, w = learner.get((u, p), (None, 0, None))
                if m != mode:
                    m, n, w = mode, 0, fb.start_weights(mode)
                x = np.array(sig)
                w = np.maximum(0, w + 0.3 * (lx.REWARDS[trains] - w @ x) * x)
                learner[u, p] = (m, n + 1, w / (w.sum() or 1.0))
    return state, learner


def test_dispositions_transitions_and_weights(spark):
    rows = log()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    state, learner = simulate(rows)
    got = {(r.user_id, r.persona_key, r.opportunity_id): r for r in fb.interactions(df).collect()}
    assert got.keys() == state.keys()
    for k, r in got.items():
        assert (r.status, r.saved, r.reason, r["rank"]) == tuple(state[k][x] for x in ("status", "saved", "reason", "rank"))
    applied = {tuple(r[:3]): r.n for r in fb.transitions(df).where("applied").groupBy(*fb.KEY).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert applied == {k: v["applied"] for k, v in state.items() if v["applied"]}
    weights = {(r.user_id, r.persona_key): r for r in fb.learned_weights(fb.training_steps(df)).collect()}
    assert weights.keys() == learner.keys()
    for k, (mode, n, w) in learner.items():
        assert (weights[k].mode, weights[k].n) == (mode, n) and np.allclose(weights[k].weights, w)
        assert min(weights[k].weights) >= 0 and abs(sum(weights[k].weights) - 1) < 1e-9


def as_files(spark, parts):
    path = scratch_path(spark, "clicks")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def check_folds(spark, path, rows, hold):
    """Both states after all triggers equal the simulation of the clicks in order."""
    state, learner = simulate(sorted(rows))
    acts = lambda: se.event_stream(spark, path, spark.createDataFrame(rows, SCHEMA).schema, files=1)
    cards, last = folds.run_folded(acts(), "c", folds.dispositions(hold))
    got = {(r.user_id, r.persona_key, r.opportunity_id): (r.status, r.saved, r.applied) for r in cards.current("cards", last).collect()}
    assert got == {k: (v["status"], v["saved"], v["applied"]) for k, v in state.items()}
    weights, last = folds.run_folded(acts(), "l", folds.learners(hold))
    got = {(r.user_id, r.persona_key): r for r in weights.current("weights", last).collect()}
    assert got.keys() == learner.keys()
    for k, (mode, n, w) in learner.items():
        assert (got[k].mode, got[k].n) == (mode, n) and np.allclose(got[k].weights, w)
    return last


def test_triggers_in_order_with_late_clicks(spark, monkeypatch):
    """Some clicks come a trigger late within the hold, some far later; the state is written anew on the way."""
    monkeypatch.setattr(folds, "COMPACT", 3)
    rows = log(500, 11)
    late = {i: 1 + i % 3 for i in range(0, 400, 29)}
    parts = [[r for i, r in enumerate(rows) if min(i // 100 + late.get(i, 0), 4) == n] for n in range(5)]
    assert check_folds(spark, as_files(spark, parts), rows, 60) == 4


def test_any_order_of_arrival_gives_the_same_state(spark):
    rows = log(400, 5)
    rows += [(1000 + i, rows[i][1], "u0", "p", "hot", ["engage", "dismiss", "undo", "save", "unsave"][i * 7 % 5], *rows[i][6:]) for i in range(150)]
    mixed = list(rows)
    random.Random(5).shuffle(mixed)
    assert check_folds(spark, as_files(spark, [mixed[i::4] for i in range(4)]), rows, 0) == 3


def test_a_run_goes_on_and_a_retried_trigger_changes_nothing(spark):
    rows = log(300, 3)
    path, where = as_files(spark, [rows[:150]]), scratch_path(spark, "state")
    stream = lambda: se.event_stream(spark, path, spark.createDataFrame(rows, SCHEMA).schema, files=1)
    folds.run_folded(stream(), "l", folds.learners(20), where)
    spark.createDataFrame(rows[150:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    state, last = folds.run_folded(stream(), "l", folds.learners(20), where)
    state.trigger(spark.createDataFrame(rows[150:], SCHEMA), last)            # once more
    assert last == 1 and folds.run_folded(stream(), "l", folds.learners(20), where)[1] == 1
    want = simulate(rows)[1]
    got = {(r.user_id, r.persona_key): (r.mode, r.n) for r in state.current("weights", last).collect()}
    assert got == {k: v[:2] for k, v in want.items()}


def test_context_is_what_was_shown_before_the_click(spark):
    keys = ["user_id"]
    log_ = spark.createDataFrame([("u", "open_detail", 2, [0.1]), ("u", "open_detail", 6, [0.2]), ("v", "open_detail", 9, [0.3])], "user_id string, action string, seq long, signals array<double>")
    clicks = spark.createDataFrame([("u", s) for s in (1, 2, 3, 6, 7, 50)] + [("v", 9), ("v", 10), ("w", 1)], "user_id string, seq long")
    got = {(r.user_id, r.seq): r.signals for r in se.with_context(clicks, se.snapshots(log_, keys), keys).collect()}
    assert got == {("u", 1): [], ("u", 2): [], ("u", 3): [0.1], ("u", 6): [0.1], ("u", 7): [0.2], ("u", 50): [0.2], ("v", 9): [], ("v", 10): [0.3], ("w", 1): []}


def test_accounts_ignore_case_and_space(spark):
    df = spark.createDataFrame([("a", "Ada  Lovelace", 1.0), ("b", "ada lovelace ", 2.0), ("c", "Bo", 3.0)], "user_id string, name string, created_at double")
    assert {(r.user_id, r.name) for r in fb.accounts(df).collect()} == {("a", "Ada Lovelace"), ("c", "Bo")}


def test_upsert_keeps_creation_and_newest_values(spark):
    df = spark.createDataFrame([("u", "p", 1, 10.0, "x"), ("u", "p", 2, 20.0, None), ("v", "p", 3, 5.0, "z")], "user_id string, profile_key string, seq long, ts double, goal string")
    got = {r.user_id: r for r in fb.upserted(df, ["user_id", "profile_key"], "seq", "ts").collect()}
    assert (got["u"].goal, got["u"].created_at, got["u"].updated_at) == (None, 10.0, 20.0)
    kept = fb.without_deleted(df, df.where("user_id = 'v'").select("user_id", "profile_key"), ["user_id", "profile_key"])
    assert {r.user_id for r in kept.collect()} == {"u"}


def test_sessions_learn_from_their_own_logs(spark, tmp_path, monkeypatch):
    from beaconlake.plans import registry  # noqa: F401
    from beaconlake.plans import q_rollups as qr, q_state as qs
    kinds = ["click", "purchase", "error", "view"]
    rows = [(i, f"2024-01-{1 + i % 28:02d} 00:00:00", i % 7, kinds[i * 5 % 4], float(i % 30), '{"k": %d}' % (i * 13 % 90)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    every = {(r.user_id, r.persona_key): r for r in qs.learned(spark, str(tmp_path)).collect()}
    seen, plain = [], qs.fb.training_steps
    monkeypatch.setattr(qs.fb, "training_steps", lambda log: seen.append({r.user_id for r in log.select("user_id").distinct().collect()}) or plain(log))
    got = qr.session_weights(spark, str(tmp_path)).collect()
    assert seen == [{"u0", "u1", "u2", "u3"}]
    want = {p: every[u, k] for p, u, k in qr.SESSIONS if (u, k) in every}
    assert len(got) == len(want) > 0
    assert all((r.mode, r.n, r.weights) == (want[r.persona].mode, want[r.persona].n, want[r.persona].weights) for r in got)
