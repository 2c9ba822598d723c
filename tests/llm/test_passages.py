"""Passages that an earlier document holds: the automaton and the operator against plain Python."""
import random

import numpy as np
import pytest

from beaconlake.llm import substring
from beaconlake.llm.automaton import NEVER, Automaton
from beaconlake.llm.queries import ORACLE, QUERIES
from tools.check import norm

FOLDER = "/root/testdata/sf0.001"


def plain(rows, n=13):
    """(id, n_words, n_removed, kept) of rows (id, text)."""
    low = {}
    for ident, text in rows:
        words = (text or "").encode().split()
        if ident is not None:
            for i in range(len(words) - n + 1):
                key = tuple(words[i:i + n])
                low[key] = min(low.get(key, ident), ident)
    out = []
    for ident, text in rows:
        words = (text or "").encode().split()
        gone = set()
        if ident is not None:
            for i in range(len(words) - n + 1):
                if low[tuple(words[i:i + n])] < ident:
                    gone.update(range(i, i + n))
        out.append((ident, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def got(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in rows], "doc_id long, text string, id int, tag int, ref string, at int, spans int").repartition(partitions)
    return sorted(map(tuple, substring.first_only(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_statistics_of_the_automaton(seed):
    luck = random.Random(seed)
    held = [[luck.choice("abc") for _ in range(luck.randint(0, 30))] for _ in range(luck.randint(0, 6))]
    ids = [luck.randint(-5, 5) for _ in held]
    first = {}
    for words, ident in zip(held, ids):
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                key = tuple(words[a:b])
                first[key] = min(first.get(key, ident), ident)
    one = Automaton(held, ids)
    assert len(one.link) <= 2 * sum(map(len, held)) + 1
    for most in (2, 4, 100):
        words = [luck.choice("abcd") for _ in range(60)]
        for end, (length, low) in enumerate(one.statistics(words, most), 1):
            best = next((n for n in range(end, 0, -1) if tuple(words[end - n:end]) in first), 0)
            assert (length >= most) == (best >= most) and (best >= most or length == best)
            assert low == first.get(tuple(words[end - min(best, most):end]), NEVER)


def made(seed, documents, vocabulary=40):
    """Documents with passages of others, of lengths around the threshold."""
    luck = random.Random(seed)
    word = lambda: f"w{luck.randint(0, vocabulary)}"
    stock = [[word() for _ in range(luck.randint(10, 40))] for _ in range(12)]
    texts = []
    for _ in range(documents):
        words = []
        for _ in range(luck.randint(0, 5)):
            if luck.random() < 0.5:
                one = luck.choice(stock)
                a = luck.randint(0, 8)
                words += one[a:a + luck.randint(8, 30)]
            else:
                words += [word() for _ in range(luck.randint(0, 20))]
        texts.append(luck.choice([" ", "\n", " \t"]).join(words))
    ids = luck.sample(range(-50, 10 * documents), documents)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = made(seed, 120)
    assert got(spark, rows) == plain(rows)


def test_small_batches_shards_and_pieces(spark, monkeypatch):
    for name, value in (("FOLD", 5), ("SHARD", 60), ("PART", 7), ("WANTED", 40)):
        monkeypatch.setattr(substring, name, value)
    rows = made(7, 150, 8)
    assert got(spark, rows) == plain(rows)


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring, "SMALL", 0)
    monkeypatch.setattr(substring, "MORE", 0)
    rows = made(8, 60) + [(999, "a " * 30), (1000, "a " * 30)]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    base = " ".join(f"alpha{i}" for i in range(40))
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (5, base), (5, base), (5, base + " tail"), (5, "other start " + base), (4, "short one"), (6, "short one"), (7, base.upper()),
            (8, "x " + base + " y"), (9, "  " + base.replace(" ", "\x0b") + "\r"), (None, base), (None, None), (20, long), (21, long + " end"), (22, "é " * 100), (23, "É " * 100), (24, "é " * 50),
            (25, base[:-3]), (26, "q " * 40 + "r " * 40), (27, "z " + "q " * 13 + "z " + "q " * 14)]
    assert got(spark, rows) == plain(rows)


def test_a_third_of_all_documents_share_a_passage(spark):
    line = " ".join(f"l{i}" for i in range(25))
    rows = [(i, f"u{i} v{i} " + (line if i % 3 == 0 else f"t{i} " * 25) + f" x{i} y{i}") for i in range(3000)] + [(5000 + i, line) for i in range(300)]
    assert got(spark, rows, 8) == plain(rows)


def test_anchors_are_the_same_in_equal_windows():
    luck = np.random.RandomState(1)
    one = luck.randint(0, 50, 400).astype(np.uint64)
    two = np.concatenate([luck.randint(50, 99, 30).astype(np.uint64), one[100:160]])
    number, place = substring.anchors(one, np.arange(len(one) - 12), 13)
    other, spot = substring.anchors(two, np.arange(len(two) - 12), 13)
    assert (place >= np.arange(len(place))).all() and (place <= np.arange(len(place)) + 8).all()
    assert (number[100:148] == other[30:]).all() and (place[100:148] - 100 == spot[30:] - 30).all()


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, "a " * 20)]) == [(None, 20, 0, " ".join("a" * 20))]


def test_query_equals_its_sql(spark, con):
    df = QUERIES["op12_first_passages"](spark, FOLDER)
    cur = con.execute(ORACLE["op12_first_passages"])
    want = norm(cur.fetchall(), [x[0] for x in cur.description])
    assert norm([tuple(r) for r in df.collect()], df.columns) == want
