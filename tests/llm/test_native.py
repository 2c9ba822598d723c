"""Sharding, URL lists and mixing: their laws, brute-force versions, and odd rows."""
import zlib
from collections import defaultdict

import pytest

from beaconlake.llm import line_dedup, mixing, q_mixing, q_urls, sharding, url_filter
from beaconlake.llm.queries import ORACLE, QUERIES
from tests.test_registry import norm

FOLDER = "/root/testdata/sf0.001"


def check_shards(rows, texts, count):
    assert len(rows) == len(texts)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(count))
    got = sorted((r["size"], r["text_crc32"]) for r in rows)
    assert got == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    largest = max((r["size"] for r in rows), default=0)
    fair = sum(sizes.values()) / count
    assert all(abs(s - fair) <= 2 * largest + 0.02 * fair for s in sizes.values()) if len(rows) > count else True


def test_shards_are_gapless_and_near_equal(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_shards(sharding.shards(docs, 4, ranges=8, piece=16).collect(), [r[0] for r in docs.select("text").collect()], 4)


def test_one_text_that_fills_a_third_is_cut(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id, ' of its own')) as text")
    rows = sharding.shards(docs, 8, piece=32).collect()
    check_shards(rows, [r["text"] for r in docs.collect()], 8)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.05 * min(sizes.values())
    assert rows and {tuple(r) for r in rows} == {tuple(r) for r in sharding.shards(docs, 8, piece=32).collect()}


def test_one_row_repeated_many_times_is_cut(spark):
    docs = spark.range(1500).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id, ' of its own')) as text")
    rows = sharding.shards(docs, 8, piece=32).collect()
    check_shards(rows, [r["text"] for r in docs.collect()], 8)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.05 * min(sizes.values())
    held = sharding.measured(docs, "doc_id", "text").selectExpr("*", "monotonically_increasing_id() as serial")
    assert max(r["count"] for r in sharding.pieces(held, [], 32).groupBy(*sharding.UNIT).count().collect()) <= 32 * 3


def test_small_groups_stay_together(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id div 2, ' twice') as text")
    shard_of = defaultdict(set)
    for r in sharding.shards(docs, 8).collect():
        shard_of[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())


def test_shards_of_odd_rows(odd, empty):
    check_shards(sharding.shards(odd, 8).collect(), [r["text"] for r in odd.collect()], 8)
    assert sharding.shards(empty, 8).count() == 0


@pytest.mark.parametrize("name", ["op3_line_dedup", "op9_url_filter", "op10_mixing"])
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLE[name])
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), [x[0] for x in cur.description])


@pytest.mark.parametrize("name", ["op9_url_filter", "op10_mixing"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def test_mixing_meets_targets(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null when id % 7 = 0 then 'é' else concat('s', id % 5) end as source",
                                       "repeat('w ', cast(id % 40 as int)) as text")
    rows = mixing.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_rows_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    got = {r[0]: r[1] for r in out.select("doc_id", mixing.word_count(out["text"]).alias("n")).groupBy("doc_id").sum("n").collect()}
    assert got == {r["id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mixed_rows(odd).columns == odd.columns
    same = [r["taken"] for r in rows if r["id"] == 7]
    assert len(same) == 2 and same[0] == same[1]
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_levels_are_exact_for_many_sources(spark):
    sources = spark.range(300).selectExpr("if(id = 0, null, concat('s', lpad(id, 4, '0'))) as source", "cast(pow(id % 17, 3) as bigint) as source_size")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    want = plain_targets({r["source"]: r["source_size"] for r in sources.collect()})
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert q_mixing.SQL


def plain_verdict(url, day, log):
    """The most specific entry that holds on the day."""
    from urllib.parse import urlsplit
    if url is None or day is None or not urlsplit(url).hostname:
        return "allow"
    host, path = urlsplit(url).hostname, urlsplit(url).path
    labels = host.split(".")
    keys = [host + "/" + path[1:].split("/")[0], host] + ["*." + ".".join(labels[-n:]) for n in range(len(labels), 1, -1)]
    for key in keys:
        known = [(d, a) for k, d, a in log if k == key and d is not None and a is not None and d <= day]
        if known:
            return max(known)[1]
    return "allow"


def test_lists_as_of_the_fetch(spark):
    log = [("a.b.org", 5, "block"), ("a.b.org", 90, "allow"), ("a.b.org", 90, "block"), ("*.b.org", 20, "block"), ("*.b.org", 400, "allow"), ("c.org/x", 10, "block"),
           ("c.org/x", 12, "allow"), ("c.org", 11, "block"), ("c.org", 700, "allow"), (None, 1, "block"), ("a.b.org", None, "block"), ("c.org", 3, None), ("c.org", 11, "block")]
    urls = ["http://a.b.org/x/1", "https://A.B.org:80", "http://z.b.org/", "http://b.org/q", "http://c.org/x/y?z", "http://user@c.org/w", "ftp://d.org/x", None, "no url", "http://c.org/x/y?z"]
    captures = [(i, u, d) for i, u in enumerate(urls) for d in (0, 5, 10, 11, 12, 19, 63, 64, 89, 90, 399, 400, 800, None)]
    caps = spark.createDataFrame(captures, "id long, url string, day long").selectExpr("*", "'x' as host", "1 as slice", "2 as rule")
    entries = spark.createDataFrame(log, "key string, day long, action string")
    got = sorted((r["id"], -1 if r["day"] is None else r["day"], r["verdict"]) for r in url_filter.verdicts(caps, entries, "id", "url", "day").collect())
    assert got == sorted((i, -1 if d is None else d, plain_verdict(u, d, log)) for i, u, d in captures)
    assert url_filter.verdicts(caps.where("1 = 0"), entries, "id", "url", "day").count() == 0
    assert {r[0] for r in url_filter.verdicts(caps, entries.where("1 = 0"), "id", "url", "day").select("verdict").distinct().collect()} == {"allow"}
    assert q_urls.SQL


def test_boilerplate_by_host(spark):
    rows = [(i, "menu \nown line %d\n\n menu" % i, "h" if i % 3 else None) for i in range(60)] + [(99, None, "h"), (98, "", "h"), (97, "menu", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _lines", "2 as _host", "3 as _at")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    assert got == {i: "own line %d\n" % i for i in range(60)} | {99: None, 98: "", 97: "menu"}
    assert line_dedup.drop_lines(docs).columns == docs.columns
    assert line_dedup.drop_lines(docs.where("1 = 0")).count() == 0


def test_boilerplate_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "menu\nline %d" % i, f"h{i % 2}") for i in range(60)], "doc_id long, text string, source string")
    want = sorted(map(tuple, line_dedup.drop_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    assert sorted(map(tuple, line_dedup.drop_lines(docs).collect())) == want


def test_lines_of_odd_rows(odd):
    assert sorted(map(str, line_dedup.drop_lines(odd).collect())) == sorted(map(str, odd.collect()))
