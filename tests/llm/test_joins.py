"""Near copies of texts and vectors, components, and the whole pipeline against plain versions."""
import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from beaconlake.llm import line_dedup, ngram_join, shingles, trie_join, vector_join
from beaconlake.llm.components import components
from beaconlake.llm.queries import ORACLE, QUERIES
from tests.test_registry import norm

FOLDER = "/root/testdata/sf0.001"


def plain_components(nodes, links):
    of = {x: x for x in nodes}
    find = lambda x: x if of[x] == x else find(of[x])
    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    random.seed(seed)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    links = chain + star + [(random.randint(0, 90), random.randint(0, 90)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components({x for l in links for x in l}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: c for x, c in want.items() if x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    return sets, plain_components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])])


def test_shingles_name_sets(monkeypatch):
    random.seed(1)
    monkeypatch.setattr(shingles, "SLICE", 300)
    texts = [b"", b"a", b"a b", b"b a", b"A B", b"  a\tb\x0bc d e f ", b"x" * 1000, b"w " * 900]
    texts += [b" ".join(random.choice([b"a", b"B", b"cc", "éd".encode()]) for _ in range(random.randint(0, 40))) for _ in range(300)]
    names = {}
    for text, got in zip(texts, shingles.Hasher().sets(texts)):
        want = frozenset(plain_set(text.decode()))
        assert len(got) == len(want) and names.setdefault(want, tuple(got.tolist())) == tuple(got.tolist())
    assert len(set(names.values())) == len(names)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=10), min_size=1, max_size=14), st.integers(0, 3))
def test_tree_finds_what_brute_force_finds(members, more):
    sets = [np.array(sorted(s), np.int64) for s in members]
    sizes = np.array([len(s) + (i % 4 < more) for i, s in enumerate(sets)])
    own = trie_join.ranked(sets)
    tree, mask = trie_join.Tree(own, sizes), np.zeros(32, np.int8)
    for i in range(len(sets)):
        got = set(tree.probe(own[i], int(sizes[i]), mask).tolist()) - {i}
        assert got == {j for j in range(len(sets)) if j != i and 180 * len(members[i] & members[j]) >= 80 * (sizes[i] + sizes[j])}
    links = trie_join.links(sets, sizes, np.arange(len(sets)))
    want = [(i, j) for i in range(len(sets)) for j in range(i) if 180 * len(members[i] & members[j]) >= 80 * (sizes[i] + sizes[j])]
    assert plain_components(range(len(sets)), links) == plain_components(range(len(sets)), want)


def corpus(seed):
    """Copies, near copies around the threshold, shared passages and unrelated texts."""
    random.seed(seed)
    word = lambda: f"w{random.randint(0, 400)}"
    passage = " ".join(word() for _ in range(60))
    out = [None, "", "one", "one", "One", "a b c d", "A b  c d"]
    for _ in range(14):
        base = [word() for _ in range(random.choice([3, 6, 12, 60, 150]))]
        for _ in range(random.randint(1, 9)):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(own) // 40))):
                own[random.randrange(len(own))] = word()
            out.append(" ".join(own) + (" " + passage if random.random() < 0.3 else ""))
    base = [word() for _ in range(200)]
    for i in range(40):                     # a large group of near copies
        own = list(base)
        own[random.randrange(len(own))] = word()
        out.append(" ".join(own))
    return out + out[10:14]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4), (3, 9)])
def test_groups_equal_brute_force(spark, seed, block):
    texts = corpus(seed)
    sets, want = plain_groups(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(docs, block=block).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_groups_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus(4))), "doc_id long, text string")
    want = sorted(map(str, ngram_join.groups(docs).collect()))
    monkeypatch.setattr(ngram_join, "SMALL", 0)
    assert sorted(map(str, ngram_join.groups(docs).collect())) == want


def test_groups_of_odd_rows(odd, empty):
    rows = ngram_join.groups(odd).collect()
    assert len(rows) == odd.count()
    of = {r["id"]: r["component_id"] for r in rows if r["id"] is not None}
    assert of == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 9, 10: 9, 11: 6}
    assert all(r["component_id"] is None for r in rows if r["id"] is None)
    assert ngram_join.groups(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 9)] + [(True, 0)] * 2


def test_a_repeated_row_stays_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs).collect()) == [1, 3]


@pytest.mark.parametrize("name", ["op5_vector_join", "op6_ngram_join"])
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLE[name])
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), [x[0] for x in cur.description])


def plain_links(rows, threshold):
    fit = {}
    for i, (vector, label) in enumerate(rows):
        if vector is not None and label is not None and None not in vector and np.isfinite(vector).all() and any(vector):
            fit[i] = (label, np.array(vector, np.float32).astype(np.float64))
    out = []
    for i, (la, a) in fit.items():
        for j, (lb, b) in fit.items():
            if j < i and la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                out.append((i, j))
    return out


@pytest.mark.parametrize("seed,block,per_pivot", [(1, 1024, 256), (2, 7, 8), (3, 16, 3)])
def test_vectors_equal_brute_force(spark, monkeypatch, seed, block, per_pivot):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    monkeypatch.setattr(vector_join, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(vector_join, "GAIN", 2.0 if seed == 2 else 0.0)
    luck = np.random.RandomState(seed)
    rows = [(None, 1), ([0.0] * 6, 1), ([float("nan")] + [1.0] * 5, 1), ([None] + [1.0] * 5, 1), ([float("inf")] + [0.0] * 5, 1), ([1.0] * 6, None), ([1.0, 0.0], 1), ([1.0, 0.0], 1), ([], 1)]
    for _ in range(12):
        base, label = luck.normal(0, 1, 6), int(luck.randint(0, 3))
        for _ in range(luck.randint(1, 9)):
            rows.append(((luck.uniform(0.5, 3) * (base + luck.normal(0, 0.1, 6))).tolist(), label))
    ball = luck.normal(0, 1, 6)
    rows += [((ball + luck.normal(0, 0.02, 6)).tolist(), 2) for _ in range(50)] + [([2.0] * 6, 1), ([2.0] * 6, 1), ([1.0] * 6, 1), ([1.0] * 6, 2)]
    links = plain_links(rows, 0.98)
    want = plain_components(range(len(rows)), links)
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    df = spark.createDataFrame([(i, v, l, "x", 1) for i, (v, l) in enumerate(rows)], "vec_id long, embedding array<float>, label int, cell string, uid int").repartition(3)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.near_copies(df).collect()}
    assert got == {i: (int(count[i]), want[i], want[i] == i) for i in range(len(rows))}
    assert vector_join.near_copies(df.where("1 = 0")).count() == 0


def test_repeated_and_null_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (5, [0.0, 1.0], 2)]
    got = vector_join.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_links"], r["component_id"] is None, r["component_id"] or 0, r["kept"]) for r in got) == [
        (False, 1, 2, False, 1, True), (False, 1, 2, False, 1, True), (False, 5, 0, False, 5, True), (True, 0, 0, True, 0, False), (True, 0, 2, False, 1, False)]


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.quality_classifier(spark, docs, FOLDER)
    assert good.columns == docs.columns
    label = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in good.collect()}
    clean = [i for i, l in label.items() if l["quality"] == 1 and l["toxic"] == 0]
    assert sum(i in stay for i in clean) >= 0.97 * len(clean)
    ids = sorted(rows)
    _, group = plain_groups([rows[i]["text"] for i in ids])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()) == [ids[k] for k, g in group.items() if k == g]


def plain_lines(rows, ratio, long_ratio, least):
    """{id: text} of rows (id, text, source) without boilerplate lines."""
    trim = lambda x: x.strip(" \t\n\r\x0b\x0c")
    count = lambda x: len(x.encode().split())
    pages = {}
    for _, text, source in rows:
        pages.setdefault(source, {})[text] = {trim(x) for x in text.split("\n")} - {""}
    bad = set()
    for source, own in pages.items():
        above = lambda x, n: n >= least and n > (long_ratio if count(x) >= 5 else ratio) * len(own)
        seen = collections.Counter(x for lines in own.values() for x in lines)
        first = {x for x, n in seen.items() if above(x, n)}
        copied = {t for t, lines in own.items() if lines & first and sum(map(len, lines & first)) >= 0.5 * sum(map(len, lines))}
        for x in first:
            holds = {t for t, lines in own.items() if x in lines}
            if above(x, len(holds - copied) + bool(holds & copied)):
                bad.add((source, x))
    return {i: "\n".join(x for x in text.split("\n") if (source, trim(x)) not in bad) for i, text, source in rows}


def test_line_stage_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = plain_lines(rows, 0.1, 0.005, 3)
    assert sum(want[i] != t for i, t, _ in rows) > 20
    for some in (docs, docs.repartition(7, "lang")):
        assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, some, FOLDER).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_copies_and_of_others(spark, seed):
    random.seed(seed)
    line = lambda: " ".join(f"w{random.randint(0, 30)}" for _ in range(random.randint(1, 9)))
    stock, rows = [line() for _ in range(30)], []
    for i in range(200):
        base = random.choice([[line() for _ in range(6)], stock[:8], stock[8:15]])
        own = [x for x in base if random.random() < 0.9] + random.sample(stock[15:], random.randint(0, 2)) + [line() for _ in range(random.randint(0, 6))]
        rows.append((i, random.choice(["\n", "\n \n"]).join(own), random.choice("aab")))
    rows += [(500 + i, t, s) for i, (_, t, s) in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df, ratio=0.1, long_ratio=0.05, min_pages=3).collect()}
    assert got == plain_lines(rows, 0.1, 0.05, 3)


def test_a_third_of_a_source_equal_keeps_one_whole_document(spark):
    text = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(8))
    rows = [(i, text(0 if i % 3 == 0 else i), "en", "a", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for stage in (corpus_pipeline.drop_boilerplate, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        docs = stage(spark, docs, FOLDER)
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(i, t) for i, t, *_ in rows if i == 0 or i % 3]


def test_near_copies_of_a_source_keep_their_shared_lines(spark):
    text = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(8))
    rows = [(i, text(0) + f"\nseen {i}" if i % 3 == 0 else text(i), "en", "a", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for stage in (corpus_pipeline.drop_boilerplate, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        docs = stage(spark, docs, FOLDER)
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(i, t) for i, t, *_ in rows if i == 0 or i % 3]


def test_long_lines_of_a_hundredth_of_a_source_go(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, own(i) + ("\nReleased under the usual public terms.\nOf." if i % 80 == 0 else ""), "a") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, docs, FOLDER).collect()}
    assert got == {i: own(i) + ("\nOf." if i % 80 == 0 else "") for i in range(1000)}


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "mixing", "byte_bpe"]


def test_cells_are_cut_where_that_pays(spark, monkeypatch):
    """Clusters far apart: cells of their own, few copies; vectors that lie evenly: no cut."""
    monkeypatch.setattr(vector_join, "PER_PIVOT", 5)
    luck = np.random.RandomState(4)
    centers = luck.normal(0, 1, (30, 32))
    close = [(centers[i % 30] + luck.normal(0, 0.02, 32)).tolist() for i in range(1800)]
    even = luck.normal(0, 1, (1800, 32)).tolist()
    radius = float(np.sqrt(2 - 2 * 0.98))
    for rows, cells, most in ((close, 30, 1.1), (even, 1, 1.0)):
        df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
        own = vector_join.prepared(df, "vec_id", "embedding", "label").selectExpr("cell", "uid", "true as own", "1L as copies", "vector")
        near = vector_join.pivots(own, radius)
        assert len(near.get("1:32", [0])) == cells
        assert vector_join.cut(own, near, radius).count() <= most * len(rows)
