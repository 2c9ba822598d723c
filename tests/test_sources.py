"""Payload edge cases, label files, sinks."""
import gzip
import json
import os

from pyspark.sql import functions as F

from beaconlake import lexicon as lx
from beaconlake.session import scratch_path
from beaconlake.sources import archive as ar, labels as lb, platforms as pl, sinks as si
from beaconlake.sources.captured import CapturedPayloads


def payload(spark, obj, domain="b2b_saas", seq=0):
    return spark.createDataFrame([(domain, seq, obj if isinstance(obj, str) else json.dumps(obj))], "domain string, seq long, value string")


def test_hackernews_fallback_url_and_cutoff(spark):
    hits = {"hits": [{"objectID": "5", "url": None, "title": "t", "created_at_i": 100}, {"objectID": "6", "url": "http://x", "created_at_i": 1}]}
    got = pl.hackernews(payload(spark, hits), 50).collect()
    assert len(got) == 1 and got[0].url.endswith("item?id=5") and got[0].body == ""
    assert pl.hackernews(payload(spark, "{broken"), 0).count() == 0


def test_github_kind_repo_and_labels(spark):
    items = {"items": [{"id": 1, "repository_url": "https://api.x/repos/a/b", "body": "y" * 5000, "pull_request": {"url": "z"}, "labels": [{"name": "bug"}, {"name": None}, {"name": ""}], "state": "open"},
                       {"id": 2, "repository_url": "nothing"}]}
    a, b = sorted(pl.github(payload(spark, items)).collect(), key=lambda r: r.source_native_id)
    assert (a.opportunity_type, a.community, len(a.body), a.tags) == ("pull_request", "a/b", 4000, ["bug"])
    assert (b.opportunity_type, b.community, b.tags, b.title) == ("issue", "", [], "")


def test_reddit_snapshot_leaves_out_pinned_and_nameless(spark):
    posts = [{"id": "1", "title": "t" * 400, "created_utc": 0, "link_flair_text": ""}, {"id": "2", "title": "x", "stickied": True}, {"id": "", "title": "x"}, {"id": "3"},
             {"id": "4", "title": "ok", "created_utc": 86400, "link_flair_text": "F", "is_self": False, "url": "u"}]
    got = {r.source_native_id: r for r in pl.reddit_snapshot(payload(spark, [{"domain": "d", "subreddit": "s", "posts": posts}]).drop("domain")).collect()}
    assert set(got) == {"1", "4"} and len(got["1"].title) == 300 and got["1"].created_at == "" and got["1"].tags == []
    assert got["4"].created_at == "1970-01-02T00:00:00+00:00" and got["4"].tags == ["F"] and got["4"].signals.external_url == "u"


def test_bluesky_url_needs_a_handle(spark):
    posts = {"posts": [{"uri": "at://a/b/k1", "author": {"handle": "h"}, "record": {"text": "hi"}}, {"uri": "at://a/b/k2"}]}
    got = {r.source_native_id: r.url for r in pl.bluesky(payload(spark, posts)).collect()}
    assert got == {"at://a/b/k1": "https://bsky.app/profile/h/post/k1", "at://a/b/k2": "at://a/b/k2"}


def test_archive_skips_bad_lines_and_weights_events(spark, tmp_path):
    lines = ['{"type":"PushEvent","repo":{"name":"a/b"}}', '{"type":"Push', '{"type":"WatchEvent","repo":{"name":"a/b"}}', '{"type":"IssuesEvent","repo":{"name":"a/b"}}', '{"type":"IssuesEvent"}']
    with gzip.open(tmp_path / "h.json.gz", "wt") as f:
        f.write("\n".join(lines))
    events = ar.read_event_files(spark, str(tmp_path))
    assert events.count() == 4
    assert [tuple(r) for r in ar.activity_scores(ar.weighted_events(events)).collect()] == [("a/b", 4)]
    repos = spark.createDataFrame([("a/b", 60, "Rust", [], "")], "repo string, stars long, language string, topics array<string>, description string")
    assert ar.active_repos(ar.activity_scores(ar.weighted_events(events)), repos).first().domain == "embedded_systems"


def test_label_files_last_file_wins(spark, tmp_path):
    (tmp_path / "chunk_1.json").write_text('{"1": ["blockchain","x"], "2": "no list", "3": ["x"]}')
    (tmp_path / "chunk_2.json").write_text('{"1": ["cloud_apis","b2b_saas","blockchain","ai_research"]}')
    (tmp_path / "chunk_3.json").write_text("{bad")
    got = {r.rid: r.labels for r in lb.label_chunks(lb.whole_files(spark, str(tmp_path)), lx.DOMAINS + ["other"]).collect()}
    assert got == {1: ["cloud_apis", "b2b_saas", "blockchain"], 3: ["other"]}


def test_append_new_counts_and_keeps_first(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame([("a", 1, "old")], "k string, seq long, v string").write.parquet(path)
    rows = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("b", 3, "first")], "k string, seq long, v string")
    assert si.append_new(rows, path, "k", "seq") == (1, 2)
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", "old"), ("b", "first")}


def test_chunks(spark):
    df = spark.range(95).select(F.col("id"))
    sizes = sorted(r["count"] for r in si.block_chunks(df, ["id"], 20).groupBy("chunk").count().collect())
    assert sizes == [15, 20, 20, 20, 20]
    assert {r["chunk"]: r["count"] for r in si.round_robin_chunks(df, ["id"], 10).groupBy("chunk").count().collect()} == {i: 10 if i < 5 else 9 for i in range(10)}


def test_captured_source_reads_one_partition_per_domain(spark, tmp_path):
    for d, n in (("x", 3), ("y", 2)):
        (tmp_path / f"domain={d}").mkdir()
        (tmp_path / f"domain={d}" / "part.txt").write_text("\n".join(f"line{i}" for i in range(n)))
    spark.dataSource.register(CapturedPayloads)
    df = spark.read.format("captured_payloads").option("path", f"file://{tmp_path}").load()
    assert df.rdd.getNumPartitions() == 2
    assert [(r.domain, r.seq, r.value) for r in df.orderBy("domain", "seq").collect()] == [("x", 0, "line0"), ("x", 1, "line1"), ("x", 2, "line2"), ("y", 0, "line0"), ("y", 1, "line1")]


def captured_files(folder, rows):
    for domain, name, lines in rows:
        place = folder / f"domain={domain}"
        place.mkdir(exist_ok=True)
        (place / name).write_text("\n".join(lines) + "\n")


def test_a_filter_on_the_domain_opens_only_its_files(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from beaconlake.sources.captured import _FilteringReader
    captured_files(tmp_path, [("a", "1", ["x", "y"]), ("a", "2", ["z"]), ("b", "1", ["w"]), ("c", "1", ["v"])])
    opened = lambda *filters: (reader := _FilteringReader({"path": f"file://{tmp_path}"}), list(reader.pushFilters(list(filters))), sorted({n.split("domain=")[1] for p in reader.partitions() for n in p.names}))[1:]
    more = GreaterThan(("seq",), 3)
    assert opened() == ([], ["a/1", "a/2", "b/1", "c/1"])
    assert opened(EqualTo(("domain",), "a"), more) == ([more], ["a/1", "a/2"])
    assert opened(In(("domain",), ("b", "c", "none")), EqualTo(("domain",), "c")) == ([], ["c/1"])
    assert opened(EqualTo(("domain",), "none")) == ([], [])
    spark.dataSource.register(CapturedPayloads)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("captured_payloads").option("path", f"file://{tmp_path}").option("pushdown", "true").load().where("domain = 'a' and value <> 'y'")
        assert sorted(r.value for r in got.collect()) == ["x", "z"] and got.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_gives_each_payload_once_across_restarts(spark, tmp_path):
    import time
    source, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    source.mkdir()
    spark.dataSource.register(CapturedPayloads)

    def run():
        time.sleep(0.4)
        stream = spark.readStream.format("captured_payloads").option("path", f"file://{source}").option("settle", "0.2").load()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(marks)).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.domain, r.value) for r in spark.read.parquet(str(out)).collect())
    captured_files(source, [("a", "1", ["x", "y"]), ("b", "1", ["w"])])
    first = run()
    assert first == [("a", "x"), ("a", "y"), ("b", "w")]
    assert run() == first
    captured_files(source, [("a", "0", ["early name"]), ("c", "9", ["new"])])
    assert run() == sorted(first + [("a", "early name"), ("c", "new")])
    assert run() == sorted(first + [("a", "early name"), ("c", "new")])


def test_keys_of_any_objects(spark):
    from beaconlake.operators import profiling as pf
    rows = [("s", '{"a": 1, "b": {"x": [1]}, "c": null}'), ("s", '{"a": "t", "b": [1, 2]}'), ("s", "{broken"), ("s", ""), ("s", None), ("s", '{"a": 2.5, "d": true}'), ("t", "{}"), (None, '{"a": 1}')]
    got = {(r.source, r.name, r.kind): (r.present, r.rows, r.broken) for r in pf.object_keys(spark.createDataFrame(rows, "source string, js string"), "source", "js").collect()}
    assert got == {("s", "a", "number"): (2, 6, 1), ("s", "a", "string"): (1, 6, 1), ("s", "b", "object"): (1, 6, 1), ("s", "b", "array"): (1, 6, 1), ("s", "c", "null"): (1, 6, 1), ("s", "d", "boolean"): (1, 6, 1),
                   ("t", None, None): (None, 1, 0), (None, "a", "number"): (1, 1, 0)}


def test_exported_blocks_lie_under_spans(spark, tmp_path):
    rows = spark.createDataFrame([(f"id{i:05d}",) for i in range(2407)], "id string")
    chunks = si.block_chunks(rows, ["id"], 20)
    path = f"{tmp_path}/blocks"
    got = si.export_blocks(chunks, path)
    assert sorted((r.id, r.chunk) for r in got.collect()) == [(f"id{i:05d}", i // 20) for i in range(2407)]
    spans = sorted(x for x in os.listdir(path) if x.startswith("span="))
    assert spans == ["span=0", "span=1", "span=2"]
    held = [f for s in spans for f in os.listdir(f"{path}/{s}")]
    assert len(held) == len(set(held)) == 121
    one = [f for f in os.listdir(f"{path}/span=1/chunk=77") if f.endswith(".parquet")]
    assert len(one) == 1
    assert si.export_blocks(chunks.where("false"), f"{tmp_path}/none").count() == 0
