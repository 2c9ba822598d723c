"""The trie of conversations against plain Python."""
import collections
import hashlib
import random
import zlib

import pytest

from beaconlake.llm import turn_trie
from beaconlake.llm.queries import ORACLE, QUERIES
from tools.check import norm

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string, a long, depth int, conv string, names int, turns int"


def plain(rows):
    """What trie() returns, with whole paths as names."""
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    paths = {}
    for c in own:
        base = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = [x[2:] for x in sorted(own.get(base, []))[:h] + sorted(own[c])[h:]]
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(who) - 1) * (len(n[-1][1].encode()) if n else 0)
    ends = {n: ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(n)) for n, who in members.items()}
    return sorted(map(str, ((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
                            for n, who in members.items())))


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], COLUMNS)
    return sorted(str(tuple(r)) for r in turn_trie.trie(df.repartition(3)).collect())


def made(seed, convs, longest, words):
    """Conversations that share beginnings of any length."""
    luck = random.Random(seed)
    rows, stems = [], [[(luck.choice("ua"), luck.choice(words)) for _ in range(longest)] for _ in range(3)]
    for c in convs:
        stem = luck.choice(stems)
        path = stem[:luck.randint(0, longest)] + [(luck.choice("ua"), luck.choice(words)) for _ in range(luck.randint(0, 3))]
        rows += [(c, i, *x) for i, x in enumerate(path)]
    return rows


def test_small_conversations(spark):
    rows = made(1, [*range(40), -3, -10, 2 ** 40, 2 ** 40 + 5, 2 ** 40 + 6], 6, ["é", "b", "long one"])
    assert got(spark, rows) == plain(rows)


def test_deep_conversations_meet_in_every_half(spark):
    rows = made(2, range(30), 150, ["x", "yy"])
    assert max(r[1] for r in rows) > 4 * turn_trie.BLOCK
    assert got(spark, rows) == plain(rows)


def test_one_conversation_many_times_and_one_very_long(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 6000, 5) for t in range(3)] + [(7, t, "user", f"w{t % 3}") for t in range(1200)]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, "u", "first"), (1, None, None, None), (1, 2, "u", "b"), (1, 2, "a", "b"), (1, 2, "a", "a"), (1, 2, "a", "a"), (5, 0, "", ""), (5, 0, "", None),
            (None, 1, "u", "lost"), (6, -4, "u", "x" * 100_000), (6, 2 ** 40, "u", "x"), (9, 1, "ab", "c"), (9, 2, "a", "bc"), (10, 1, "ab", "c")] + [(15, 3, "r", "same")] * 20
    assert got(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "u", "a")]) == []


def test_query_equals_its_sql(spark, con):
    df = QUERIES["op13_turn_trie"](spark, FOLDER)
    cur = con.execute(ORACLE["op13_turn_trie"])
    want = norm(cur.fetchall(), [x[0] for x in cur.description])
    assert norm([tuple(r) for r in df.collect()], df.columns) == want


def test_hashes_of_many_ids_are_read_in_pieces(spark):
    rows = [(c, 0, "u", "one") for c in range(0, 5 * 3000, 5)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("c", [0, 7, -1, 10 ** 15])
def test_borrowed_turns(spark, c):
    from pyspark.sql import functions as F
    assert spark.range(1).select(turn_trie.borrowed(F.lit(c).cast("long"))).first()[0] == zlib.crc32(str(c).encode()) % 9
