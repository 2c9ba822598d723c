"""Tokens, quality, rules, personal data: the library they follow, brute force, held-out accuracy, odd rows."""
import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from beaconlake.llm import bpe, personal, q_tokens, quality, rules
from beaconlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PATH = P.path(q_tokens.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts, v, merger=None):
    merger = merger or bpe.Merger(v)
    return [bpe.unpacked(one) for some in bpe.text_pieces(texts, v) for one in merger.encode(some)]


def test_ids_equal_the_library(vocabulary, library):
    random.seed(3)
    marks = list("aeirlstmdvESLT'’ \n\t\r  01²Ⅷ,.!é中ñ  \x1c\x85\U0001F600\U000105C0́") + ["'s", "'re", "'ll", " '", " ", "<|endoftext|>"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 40))) for _ in range(6000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "!" * 300 + "?" * 100, "", "'", "\n\n a", "a  ", "'ve've", "é" * 200, "'l", "x'r", "\t\tx"]
    assert ids_of(texts, vocabulary) == [library.encode_ordinary(t) for t in texts]
    assert ids_of(texts, vocabulary, bpe.Merger(vocabulary, cache=50)) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_any_text_round_trips(vocabulary, library, texts):
    ids = ids_of(texts, vocabulary)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode_bytes(x, vocabulary).decode() for x in ids] == texts


def test_every_code_point_has_its_class(vocabulary, library):
    texts = ["".join(" a" + chr(c) + "b" for c in range(a, a + 256) if not 0xD800 <= c <= 0xDFFF) for a in range(0, 0x20000, 256)]
    assert ids_of(texts, vocabulary) == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_step_by_step_automaton(vocabulary):
    v, luck = vocabulary, np.random.RandomState(1)
    for n in (1, 5, 64, 65, 1000, 20_000):
        own = luck.randint(0, 8, n)
        state, want = bpe.START, []
        for s in own:
            state = bpe._step(state, s)[0]
            want.append(state)
        run = bpe.scan(v["symbol_of"][own], v["compose"], v["identity"])
        assert v["apply"][run, bpe.START].tolist() == want


def test_documents_encode_and_decode(spark, library, odd, empty):
    encoded = bpe.encode(odd, PATH)
    rows = encoded.collect()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    assert sorted(map(tuple, (r["ids"] for r in rows))) == sorted(map(tuple, map(library.encode_ordinary, texts)))
    for r in rows:
        starts = np.cumsum([0] + [len(library.decode_single_token_bytes(i)) for i in r["ids"]])
        assert r["offsets"] == starts[:-1].tolist()
    assert sorted(r["text"] for r in bpe.decode(encoded, PATH).collect()) == sorted(texts)
    assert bpe.round_trip(empty, PATH).count() == bpe.encode(empty, PATH).count() == 0


def test_token_query_equals_the_library(spark, library):
    text = {r[0]: r[1] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op2_byte_bpe"](spark, FOLDER).collect():
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    grades = quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    seen = grades.where("pmod(xxhash64(id), 3) > 0")
    held = grades.where("pmod(xxhash64(id), 3) = 0")
    model = quality.train(docs, seen)
    got = quality.scored(docs, model).join(held, F.expr("doc_id = id")).select("grade", "_tail", "_expected").collect()
    kept = {g: np.mean([r["_tail"] >= quality.TAIL for r in got if r["grade"] == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.97 and kept[0] < 0.06 and kept[1] < 0.35
    mean = {g: np.mean([r["_expected"] for r in got if r["grade"] == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    again = quality.train(docs.repartition(5), seen)
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])


def test_thresholds_are_ordered_and_grades_found():
    luck = np.random.RandomState(0)
    rows = [np.array([g, *luck.randint(10, 60, 5)], np.int32) for g in luck.randint(0, 4, 800)]
    grades = np.array([r[0] for r in rows])
    weights, theta = quality.fit(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), grades, 4)
    score = np.array([weights[r].sum() for r in rows])
    assert (np.diff(theta) >= 0).all() and ((score[:, None] > theta).sum(1) == grades).mean() > 0.95


def test_quality_of_odd_rows(spark, odd, empty, labels):
    out = quality.select(odd, labels)
    assert out.columns == odd.columns and out.count() <= odd.count()
    nothing = labels.where("1 = 0")
    assert sorted(map(str, quality.select(odd, nothing).collect())) == sorted(map(str, odd.collect()))
    assert quality.select(empty, labels).count() == 0
    assert {(r["id"], r["grade"]) for r in quality.graded(labels).collect()} == {(6, 2), (7, 2), (9, 0), (4, 1), (99, 0)}


def plain_counts(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    kept = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(kept) - len(set(kept)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x1c\x85é#|", max_size=60))
def test_rule_counts(text):
    assert rules.statistics(text.encode())[:5] == plain_counts(text)


def test_rules_find_junk_and_keep_the_good(spark):
    folder = "/root/testdata/sf0.1"
    label = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()}
    text = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op8_quality_rules"](spark, folder).collect()
    for r in rows[:1500]:
        n, *rest = plain_counts(text[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n) and not (r["kept"] and r["base_failed"])
    passed = [r for r in rows if not r["base_failed"] and r["doc_id"] in label]
    assert np.mean([r["kept"] for r in passed if label[r["doc_id"]] == 1]) > 0.985
    assert np.mean([r["kept"] for r in passed if label[r["doc_id"]] == 0]) < 0.1


def test_paths_isolate_what_is_far():
    luck = np.random.RandomState(2)
    rows = np.concatenate([luck.normal(0, 1, (500, 3)), np.full((5, 3), 12.0)])
    score = rules.anomalies(rows, rules.forest(rows))
    assert score[-5:].min() > np.quantile(score[:-5], 0.99)


def test_rules_of_odd_rows(odd, empty, labels):
    rows = rules.judged(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(not r["kept"] for r in rows if r["id"] in (1, 2, 3, 9, 10))
    assert rules.judged(odd, labels.where("1 = 0")).count() == odd.count()
    assert rules.judged(empty, labels).count() == 0


def plain_spans(t):
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == 3 or personal.luhn(digits)):
                found.append((kind, m.start(), m.end()))
    return found


_PARTS = ["a", "b@", "@", ".", "1", "25", "255", "256", "+1", " ", "-", "(", ")", "4111111111111111", "x.y", "%", "é", "\n", "00", "٣"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(_PARTS), max_size=16))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted(personal.base_spans(text, personal._tools())) == sorted(plain_spans(text))


def test_personal_query_keeps_the_base_and_adds(spark):
    folder = "/root/testdata/sf0.1"
    text = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows, more = QUERIES["op7_personal_data"](spark, folder).collect(), 0
    for r in rows:
        base = personal.written(plain_spans(text[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [base.count(k + ":") for k in personal.KINDS]
        own, all_spans = set(filter(None, base.split(","))), set(filter(None, r["spans"].split(",")))
        assert own <= all_spans
        if not re.search("[0-9@]", text[r["doc_id"]]):
            assert not all_spans
        more += len(all_spans - own)
    assert 0 < more < 50


def test_field_carries_labels_to_like_words(spark):
    """A card that another number hides from the pattern is found where it looks like a card, and a
    mailbox without its domain where the same mailbox stands in full elsewhere."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = personal.train(docs)
    hidden = "call 555-2361 4111111111111111 soon"
    plain = "in 1999 there were 12 of 300 on page 4"
    extra = spark.createDataFrame([(1, hidden), (2, plain), (3, "pay 4111111111111111 now " + "word " * 500 + hidden)], "doc_id long, text string")
    got = {r["id"]: r["spans"] for r in personal.found(extra, model).collect()}
    assert not got[2]
    at = got[3].count("card:")
    assert at >= 2


def test_hub_message_passing_is_exact_on_a_tree():
    """Two like words and a hub have no loop: beliefs equal the sum over all labellings."""
    luck = np.random.RandomState(4)
    w = np.zeros((personal.SLOTS, personal.LABELS))
    w[:20] = luck.normal(0, 1, (20, personal.LABELS))
    theta, pull = luck.normal(0, 0.5, (personal.LABELS, personal.LABELS)), 1.7
    slots = luck.randint(0, 20, (2, 7))
    left, hub = np.array([-1, -1]), np.array([0, 0])
    old, personal.ROUNDS = personal.ROUNDS, 60
    got = personal.beliefs((w, theta, pull), slots, left, hub)
    personal.ROUNDS = old
    own = w[slots].sum(1) + theta[0] + theta[:, 0]
    total = np.zeros((personal.LABELS, personal.LABELS))
    for h in range(personal.LABELS):
        total += np.exp(own[0][:, None] + own[1][None, :] + pull * (np.arange(personal.LABELS)[:, None] == h) + pull * (np.arange(personal.LABELS)[None, :] == h))
    total /= total.sum()
    assert np.allclose(got, np.stack([total.sum(1), total.sum(0)]), atol=1e-6)


def test_personal_data_of_odd_rows(odd, empty):
    rows = personal.found(odd, personal.train(odd)).collect()
    assert len(rows) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["id"] in (1, 2, 3))
    assert personal.train(empty) is None and personal.found(empty, None).count() == 0


def test_one_long_document_leaves_the_sample_whole(spark, monkeypatch):
    monkeypatch.setattr(personal, "WORDS", 3000)
    long = " ".join(f"call {i}-555-0100 or a{i}@b.org" for i in range(4000))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert personal.train(docs) is not None
