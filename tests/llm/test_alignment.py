"""Tokens of two tokenizers: fragments as a monoid, links and counts against plain Python."""
import collections
import functools
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from beaconlake.llm import alignment, q_alignment
from beaconlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files(spark):
    return alignment.shared(spark, P.path(q_alignment.BYTE_LEVEL), P.path(q_alignment.PIECES), P.PATTERN)


@pytest.fixture(scope="module")
def built(files):
    return alignment.tokenizers(files)


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(P.path(q_alignment.BYTE_LEVEL))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path(q_alignment.PIECES))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    names = {i: bytes(byte[c] for c in t) for t, i in first.get_vocab().items() if t != "<|endoftext|>"}

    def encode(text):
        """[(id, bytes)] of both sides, or nothing."""
        if not text:
            return [], []
        a = [(i, names[i]) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
        same = all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b))
        return (a, b) if same else ([], [])
    return encode


def placed(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(rows, encode):
    docs = []
    for ident, text in rows:
        a, b = map(placed, encode(text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links = []
        for j, s, e in b:
            links += [(i, j) for i, x, y in a if x < e and s < y]
        ends = [0] + cuts
        groups = [(",".join(str(i) for i, _, e in a if x < e <= y), ",".join(str(i) for i, _, e in b if x < e <= y)) for x, y in zip(ends, ends[1:])]
        docs.append((ident, len(a), len(b), cuts, links, ";".join(f"{x}|{y}" for x, y in groups)))
    count = collections.Counter(l for d in docs for l in d[4])
    most = collections.Counter()
    for (i, j), n in count.items():
        most[j] = max(most[j], n)
    return sorted(((ident, n_a, n_b, len(cuts), len(links), sum(count[l] == most[l[1]] for l in links), sum(count[l] for l in links), hashlib.sha256(text.encode()).hexdigest() if n_a else "")
                   for ident, n_a, n_b, cuts, links, text in docs), key=str)


TEXTS = ["hello world", "", None, " ", "  two spaces", "a▁b", "naïve café — 中文字", "\t\n\r mixed \x00 bytes\x85", "<|endoftext|> <s> </s> <unk>", "x" * 300, "don't stop!!! 12345 67,89", "\U0001F600 emoji",
         " leading", "trailing ", "ends\n", "　wide space", "á combining", "word " * 50]


def made(seed, n, longest):
    luck = random.Random(seed)
    words = ["the", "Étion", "unknownly", "x", "...", "1234567", "zwölf", "über-all", "don't", "\n", "", "中文", "Ω≈ç", "tab\there", "(a)"]
    return [" ".join(luck.choice(words) for _ in range(luck.randint(0, longest))) for _ in range(n)]


def got(spark, files, rows, partitions=3):
    df = spark.createDataFrame([(i, t, 1, "x", 2, "y", 3) for i, t in rows], "doc_id long, text string, id int, row string, part int, pairs string, unit int").repartition(partitions)
    return sorted((tuple(r[c] for c in COLUMNS) for r in alignment.aligned(df, files).collect()), key=str)


def test_ids_equal_the_libraries(built, libraries):
    texts = [t for t in TEXTS if t] + made(1, 60, 40)
    a, n_a, b, n_b, valid = built.encode(texts)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    for i, t in enumerate(texts):
        x, y = libraries(t)
        assert a[ends_a[i] - n_a[i]:ends_a[i]].tolist() == [j for j, _ in x] and b[ends_b[i] - n_b[i]:ends_b[i]].tolist() == [j for j, _ in y]
        assert bool(valid[i]) == bool(x)


def test_parts_encode_like_the_whole(built, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 160)
    for text in made(2, 40, 300) + ["x" * 900, " " * 500, "a " * 400, "中文 " * 200]:
        some = list(alignment.split(text))
        assert " ".join(t for _, t in some) == text
        assert [s for s, _ in some] == [len(text.encode()[:0]) if not i else len((" " + " ".join(t for _, t in some[:i])).encode()) for i in range(len(some))]
        a, _, b, _, valid = built.encode([t for _, t in some])
        x, y = libraries(text)
        if x:
            assert valid.all() and a.tolist() == [j for j, _ in x] and b.tolist() == [j for j, _ in y]


def sides(draw_a, draw_b, total):
    return [np.array(sorted({total, *(x % total for x in d if x % total)})) for d in (draw_a, draw_b)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 59), max_size=40), st.lists(st.integers(1, 59), max_size=40), st.lists(st.integers(0, 60), max_size=6), st.randoms())
def test_fragments_of_any_byte_ranges_compose(built, draw_a, draw_b, where, luck):
    """Any cut into byte ranges and any order of products give the groups of the whole."""
    a, b = sides(draw_a, draw_b, 60)
    bounds = sorted({0, 60, *where})
    part = lambda ends, x, y: ends[(ends > x) & (ends <= y)]
    found, level = [], []
    for n, (x, y) in enumerate(zip(bounds, bounds[1:])):
        own_a, own_b = part(a, x, y), part(b, x, y)
        ends, middle = alignment.fragment(built, own_a, own_a, own_b, own_b, n)      # ids are their ends
        level.append(ends)
        if middle:
            cut = alignment.cuts(middle[1], middle[3])
            found += [(part(middle[1], lo, hi).tolist(), part(middle[3], lo, hi).tolist()) for lo, hi in zip([middle[1][0] - 60, *cut], cut)]
    close = lambda at, tokens: found.append((tokens[1].tolist(), tokens[3].tolist()))
    while len(level) > 1:
        i = luck.randrange(len(level) - 1)
        level[i:i + 2] = [alignment.compose(level[i], level[i + 1], close)]
    close(0, level[0]["head"])
    assert not len(level[0]["tail"][0]) and not len(level[0]["tail"][2])
    cut = sorted(set(a.tolist()) & set(b.tolist()))
    assert sorted(found) == sorted((part(a, lo, hi).tolist(), part(b, lo, hi).tolist()) for lo, hi in zip([0, *cut], cut))


def test_equals_brute_force(spark, files, libraries):
    rows = [*enumerate(TEXTS), (7, "hello world"), (None, "null id here"), (None, None)] + [(100 + i, t) for i, t in enumerate(made(3, 80, 30))]
    assert got(spark, files, rows) == plain(rows, libraries)


def test_long_texts_over_many_parts_and_shards(spark, files, libraries, monkeypatch):
    for name, value in (("PART", 120), ("FAN", 2), ("SHARD", 50), ("SLICE", 300)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(i, t) for i, t in enumerate(made(4, 25, 200))] + [(50, "x" * 500 + " tail end of it " * 20), (51, "a▁b " + "word " * 100), (52, "word " * 100), (52, "word " * 100), (53, " " * 400), (None, "again " * 60)]
    assert got(spark, files, rows) == plain(rows, libraries)


def test_written_groups_are_the_hashed_ones(spark, files, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 200)
    df = spark.createDataFrame(list(enumerate(made(5, 20, 120))), "doc_id long, text string")
    want = {r["id"]: r["groups_sha256"] for r in alignment.aligned(df, files).collect()}
    pieces = collections.defaultdict(list)
    for r in alignment.written_groups(df, files).collect():
        if r["groups"]:
            pieces[r["id"]].append((r["part"], r["sub"], r["groups"]))
    assert {i: hashlib.sha256(";".join(x for *_, x in sorted(p)).encode()).hexdigest() for i, p in pieces.items()} == {i: h for i, h in want.items() if h}


def test_no_rows(spark, files):
    assert got(spark, files, []) == []
    assert got(spark, files, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_over_all_documents(spark):
    rows = QUERIES["op11_alignment"](spark, FOLDER).collect()
    assert len(rows) == 200 and sum(r["n_links"] for r in rows) > 0 and all(r["n_groups"] <= min(r["n_a"], r["n_b"]) for r in rows)
