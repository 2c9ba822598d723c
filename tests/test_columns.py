"""Column functions on small hand-made rows."""
import pytest
from pyspark.sql import functions as F

from beaconlake import lexicon as lx, schema
from beaconlake.functions import dates, jsontext, numeric as nm, text as tx
from beaconlake.operators import features as ft, personas as ps, splits

c = F.col


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>"))
    return df.select(expr.alias("x")).first().x


def test_terms_drop_boilerplate_and_keep_repeats(spark):
    got = one(spark, tx.terms(c("t"), c("g")), t="The Rust... rust and C++17 api of node.js.", g=["Machine Learning", "go", "API"])
    assert got == ["rust", "rust", "c++17", "node.js", "machine learning"]


def test_markdown_to_one_line_and_to_lines(spark):
    md = "## Head\n> quote **bold** `code`\n- item ![i](u) [text](http://x)\n---\n\n\n\nend 🚀"
    assert one(spark, tx.strip_markdown(c("t")), t=md) == "Head quote bold code item text --- end"
    assert one(spark, tx.clean_lines(c("t")), t=md) == "Head\nquote bold code\n- item text\n\nend"


def test_issue_quality_rewards_a_good_write_up(spark):
    body = "Steps to reproduce\n1. run\n```x```\nhttps://a.b good first issue " + "x" * 1200
    assert one(spark, tx.issue_quality(F.lit("github"), c("b")), b=body) == pytest.approx(1.0)
    assert one(spark, tx.issue_quality(F.lit("reddit"), c("b")), b=body) == 0.5
    assert one(spark, tx.issue_quality(F.lit("github"), c("b")), b="") == 0.5


def test_names(spark):
    assert tuple(one(spark, tx.name_and_role(c("n")), n="Ada - Lovelace — Engineer")) == ("Ada - Lovelace", "Engineer")
    assert one(spark, tx.display_name(c("n")), n="  aDA   lovelace ") == "Ada Lovelace"
    assert one(spark, tx.slug(c("n"), "profile"), n="--!!") == "profile"


def test_dates_accept_z_offset_and_garbage(spark):
    rows = [("2026-02-04T10:00:00Z",), ("2026-02-04T10:00:00-05:00",), ("",), ("soon",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(F.date_format(dates.week_monday(c("t")), "yyyy-MM-dd").alias("w"),
                    dates.age_days(c("t"), F.try_to_timestamp(F.lit("2026-02-05T10:00:00Z"))).alias("a")).collect()
    assert [r.w for r in got] == ["2026-02-02", "2026-02-02", None, None, None]
    assert [round(r.a, 4) for r in got] == [1.0, round(19 / 24, 4), 9999.0, 9999.0, 9999.0]


def test_json_fallbacks_and_merge(spark):
    assert one(spark, jsontext.tags_of(c("t")), t="oops") == []
    assert one(spark, jsontext.domains_of(c("t"), F.lit("d")), t="[bad") == ["d"]
    merged = one(spark, jsontext.merged(c("a"), c("b")), a='{"state":"open","n":1}', b='{"n":2,"forks":3}')
    import json
    assert json.loads(merged) == {"state": "open", "n": 2, "forks": 3}
    assert one(spark, jsontext.valid_labels(c("t"), lx.DOMAINS), t=["x", "blockchain", "blockchain", "cloud_apis", "b2b_saas"]) == ["blockchain", "blockchain", "cloud_apis"]
    assert one(spark, jsontext.valid_labels(c("t"), lx.DOMAINS), t=["x"]) == ["other"]


def test_modes_and_experience(spark):
    mode = lambda pid, goal, first: one(spark, tx.engagement_mode(c("i"), c("g"), c("p")), i=pid, g=goal, p=first)
    assert mode("raj-2", "spot rising tools", "github") == "promote"           # a pinned id wins
    assert mode("x", "spot rising tools", "github") == "monitor"
    assert mode("x", "fix bugs", "reddit") == "discuss"
    assert mode("x", "fix bugs", "github") == "contribute"
    assert one(spark, tx.experience(c("b")), b="Senior but a student") == "newbie"


def test_split_sums_to_100_and_keeps_order(spark):
    data = [([1, 1, 1, 0],), ([5, 0, 0, 0],), ([33, 33, 33, 1],), ([0, 7, 2, 9],)]
    got = [r.s for r in spark.createDataFrame(data, "w array<int>").select(splits.largest_remainder(c("w")).alias("s")).collect()]
    assert all(sum(s) == 100 for s in got)
    assert got[0] == [34, 33, 33, 0]
    for m in lx.SPLIT_BASE:
        for level in ("newbie", "mid", "expert"):
            assert sum(one(spark, splits.recommended_split(c("m"), c("l")), m=m, l=level)) == 100
    assert one(spark, splits.recommended_split(c("m"), c("l")), m="contribute", l="newbie") == [38, 37, 15, 10]


def test_effort_and_reputation(spark):
    eff = lambda src, kind, body, gf, rt: one(spark, nm.effort_minutes(c("s"), c("k"), c("b"), c("g"), F.lit(rt).cast("double")), s=src, k=kind, b=body, g=gf)
    assert eff("devto", "article", "", False, 4) == 12.0 and eff("devto", "article", "", False, None) == 13.0
    assert eff("github", "issue", "x" * 1000, True, None) == 75.0
    assert eff("github", "pull_request", "x" * 9000, False, None) == 150.0
    assert eff("elsewhere", "post", "", False, None) == 30.0
    assert one(spark, nm.repo_reputation(c("s")), s=0) == 0.0
    assert one(spark, nm.repo_reputation(c("s")), s=60000) == pytest.approx(0.85)


def test_percentile_counts_strictly_smaller_values(spark):
    vals = [0, 0, 5, 7, None]
    data = [(str(i), "reddit", v, 0, None, None, "2026-01-01T00:00:00Z", "{}", "[]", "d", "[]") for i, v in enumerate(vals)]
    df = spark.createDataFrame(data, "opportunity_id string, source string, score long, num_comments long, community_size long, x string, created_at string, signals string, tags string, domain string, domains string")
    raw = ft.with_raw_signals(ft.decoded(df), F.try_to_timestamp(F.lit("2026-01-02T00:00:00Z")))
    got = {r.opportunity_id: r.pop_pct for r in ft.source_percentiles(raw).collect()}
    assert got == {"0": 0.0, "1": 0.0, "2": 0.6, "3": 0.8, "4": 0.0}     # a missing score counts as 0


def test_closed_or_archived_items_are_not_open(spark):
    data = [("github", '{"state":"closed"}'), ("github", '{"archived":true}'), ("github", "{}"), ("github", "{bad"), ("reddit", '{"state":"closed"}')]
    df = spark.createDataFrame(data, "source string, signals string").withColumn("sig", jsontext.signals_of(c("signals")))
    assert [r.o for r in df.select(ft.openness().alias("o")).collect()] == [0.0, 0.0, 1.0, 1.0, 1.0]


def test_canonical_record_fills_and_encodes(spark):
    df = spark.createDataFrame([("reddit", "7", ["a", "b"])], "source string, source_native_id string, tags array<string>")
    row = schema.canonical(df.withColumn("opportunity_id", schema.opportunity_key(c("source"), c("source_native_id")))).first()
    import hashlib
    assert row.opportunity_id == hashlib.sha1(b"reddit:7").hexdigest() and row.tags == '["a","b"]' and row.score is None


def test_profile_becomes_persona(spark):
    df = spark.createDataFrame([("u", "", None, None, ["blockchain_web3"], [], None, "C++, Rust;Go")],
                               "user_id string, profile_key string, name string, goal string, domains array<string>, platforms array<string>, time_budget_hours double, avoid string")
    p = ps.persona_from_profile(df).first()
    assert (p.id, p.name, p.domains, p.exclude_languages, p.time_budget_hours) == ("custom", "You", ["blockchain"], ["C++", "Rust", "Go"], 5.0)
    assert set(p.platforms) == set(lx.SOURCES) and p.interests == ["Blockchain"]


def test_some_items_are_compared_with_all(spark):
    """Shares of a few items against the whole corpus are those of the whole table."""
    rows = [(f"o{i}", "s" if i % 3 else "t", float(i % 7), float(i), None if i % 5 else 1.5, float(-i)) for i in range(60)]
    every = spark.createDataFrame(rows, "opportunity_id string, source string, pop double, disc double, vel double, standout_raw double")
    few = every.where("opportunity_id in ('o3', 'o4', 'o5', 'o50')")
    want = {r.opportunity_id: tuple(r) for r in ft.with_percentiles(every).collect()}
    assert len(want) == 60 and {r.opportunity_id: tuple(r) for r in ft.with_percentiles(few, corpus=every).collect()} == {k: want[k] for k in ("o3", "o4", "o5", "o50")}
    for r in ft.with_percentiles(every, ["vel"]).collect():
        assert r.vel_pct == want[r.opportunity_id][8]
    for i, source, pop, *_ in rows:
        own = [x[2] for x in rows if x[1] == source]
        assert want[i][6] == sum(v < pop for v in own) / len(own)


def test_split_reads_its_weights_once(spark, capsys):
    rows = spark.createDataFrame([([3, 3, 3, 1], "learn", "newbie"), (None, None, None)], "weights array<int>, m string, l string")
    rows.select(splits.largest_remainder(c("weights")).alias("s")).explain(True)
    shown = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert 0 < shown.count("weights#") <= 2
    got = rows.select(splits.largest_remainder(c("weights")).alias("s"), splits.recommended_split(c("m"), c("l")).alias("r")).collect()
    assert got[0].s == [30, 30, 30, 10] and got[1].s is None
    assert all(sum(r.r) == 100 for r in got)


def test_profiles_of_one_file_are_spread(spark, tmp_path):
    from beaconlake.plans import testbed as tb
    rows = spark.createDataFrame([(i, f"Customer#{i}", i % 25, 1.5 * i) for i in range(200)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    p = tb.profiles(spark, str(tmp_path)).select("user_id", F.spark_partition_id().alias("part")).collect()
    assert len(p) == 200 and len({r.part for r in p}) > 1
