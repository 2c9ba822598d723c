"""Byte-level BPE by arrays: pre-tokenisation without regular expressions, cached pair merging.

Pre-tokenisation follows the usual pattern of contractions, letters, digits, other marks and white
space. Each character becomes a symbol by its class and a look ahead of two characters. A symbol is
a function on the ten states of a small automaton; composing such functions is associative, so
all states of a batch come out of one scan over composed functions. The compositions that can
occur are few, so a function is a small number and composing is one table lookup. A new
piece starts where state and symbol say so.

Pieces are merged once and cached. Pieces that a batch has not seen before are merged together,
one merge a round and piece, lowest rank first and leftmost among equals; long pieces go through a
heap instead, so that a megabyte without a space costs n log n.

Everything a task needs (ranks, pair table, classes) is built once on the driver from the
vocabulary file and broadcast: its size is that of the vocabulary. A task's cache is bounded.

Defined results: a null text is an empty one, with no ids; empty tables give empty results.
"""
import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconlake.llm.arrays import parts, whole_texts

# Symbols of the automaton: what a character can do, look ahead included.
LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, SPACES, LONE = range(8)
# States: nothing yet, a run of one class, a space that waits for a run, white space, one finished
# white space, a contraction that lacks one or two letters, a finished contraction.
(START, IN_LETTER, IN_NUMBER, IN_OTHER, WAITING, IN_SPACES, DONE, LACKS_ONE, LACKS_TWO, CONTRACTED) = range(10)
STATES, SYMBOLS = 10, 8
CACHE = 80_000         # pieces a task keeps
SLICE = 1 << 18         # characters scanned at a time (whole texts)
ARRAY_LENGTH = 40       # pieces of more bytes are merged by a heap


def _step(state, symbol):
    """(next state, whether a new piece starts)."""
    runs = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    if symbol == LETTER and state == LACKS_ONE:
        return CONTRACTED, False
    if symbol == LETTER and state == LACKS_TWO:
        return LACKS_ONE, False
    if symbol in runs:
        return runs[symbol], state not in (runs[symbol], WAITING)
    if symbol in (SHORT, LONG):             # an apostrophe before a contraction's letters
        if state in (IN_OTHER, WAITING):
            return IN_OTHER, False
        return (LACKS_ONE if symbol == SHORT else LACKS_TWO), True
    if symbol == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (WAITING if symbol == GLUE else DONE), True


def _functions():
    """The symbols' functions on states closed under composition: `table[f, g]` is f, then g;
    symbol s at the start of a text is function s + 8, which forgets what came before."""
    step = np.array([[_step(s, x)[0] for s in range(STATES)] for x in range(SYMBOLS)])
    start = np.array([[_step(START, x)[0]] * STATES for x in range(SYMBOLS)])
    known = {}
    for f in [*step, *start, np.arange(STATES)]:
        known.setdefault(tuple(f), len(known))
    symbol_of = np.array([known[tuple(f)] for f in [*step, *start]])
    identity = known[tuple(range(STATES))]
    made = list(known)
    table, at = {}, 0
    while at < len(made):
        for j in range(at + 1):
            for a, b in ((at, j), (j, at)):
                both = tuple(made[b][s] for s in made[a])
                if both not in known:
                    known[both] = len(made)
                    made.append(both)
                table[a, b] = known[both]
        at += 1
    n = len(made)
    compose = np.zeros((n, n), dtype=np.uint16)
    for (a, b), c in table.items():
        compose[a, b] = c
    apply = np.array(made, dtype=np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] for s in range(STATES)])
    return symbol_of.astype(np.uint16), compose, apply, starts, identity


def character_classes(pattern_engine) -> np.ndarray:
    """Class of every code point (0 other, 1 letter, 2 number, 3 white space) as the tokenizer's
    own library sees it: Unicode versions differ between libraries."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(map(chr, points))
    out = np.zeros(0x110000, dtype=np.uint8)
    for code, name in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        out[[ord(c) for c in pattern_engine(name, text)]] = code
    return out


def _matched(pattern, text):
    import tiktoken
    single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return single.decode(single.encode_ordinary(text))


def vocabulary(path: str) -> dict:
    """Ranks, the table of pairs that merge, and the ids' bytes, from a file of ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    pairs = np.array(pairs, dtype=np.int64).reshape(-1, 3)
    keys = pairs[:, 0] << 32 | pairs[:, 1]
    order = np.argsort(keys)
    texts = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        texts[rank] = token
    symbol_of, compose, apply, starts, identity = _functions()
    return {"ranks": ranks, "keys": keys[order], "merged": pairs[order, 2].astype(np.int32), "texts": texts,
            "bytes": np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32), "classes": character_classes(_matched),
            "symbol_of": symbol_of, "compose": compose, "apply": apply, "starts": starts, "identity": identity}


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The automaton's symbol of every character; `first` marks the first one of each text."""
    kind = classes[points]
    n = len(points)
    ahead, ahead2 = np.full(n, 255, np.uint8), np.zeros(n, np.uint32)
    last = np.ones(n, bool)                             # last character of its text
    last[:-1] = first[1:]
    ahead[:-1][~last[:-1]] = kind[1:][~last[:-1]]
    out = np.array([OTHER, LETTER, NUMBER, SPACES], dtype=np.uint8)[kind]
    white = kind == 3
    before_text = white & (ahead != 3) & (ahead != 255)
    out[before_text] = LONE
    out[before_text & (points == 32)] = GLUE
    marks = np.flatnonzero(points == 39)
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        ends = np.concatenate([last, np.ones(2, bool)])
        one, two = padded[marks + 1], padded[marks + 2]
        has_one = ~ends[marks]
        has_two = has_one & ~ends[marks + 1]
        out[marks[has_one & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]
        out[marks[has_two & np.logical_or.reduce([(one == a) & (two == b) for a, b in pair])]] = LONG
    return out


def scan(functions: np.ndarray, compose: np.ndarray, identity: int) -> np.ndarray:
    """Composition of all functions up to and including each place: blocks side by side, one
    column a step, then the same over the blocks' totals."""
    n = len(functions)
    if n <= 64:
        out = np.empty(n, np.uint16)
        now = identity
        for i, f in enumerate(functions.tolist()):
            now = compose[now, f]
            out[i] = now
        return out
    width = max(8, int(np.sqrt(n) / 4))
    rows = -(-n // width)
    grid = np.full(rows * width, identity, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    size, flat = compose.shape[0], compose.ravel()
    for j in range(1, width):
        grid[j] = flat[grid[j - 1].astype(np.int32) * size + grid[j]]
    ahead = np.full(rows, identity, np.uint16)
    ahead[1:] = scan(grid[-1], compose, identity)[:-1]
    out = flat[ahead.astype(np.int32)[None, :] * size + grid]
    return out.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray, v: dict) -> np.ndarray:
    """Whether a piece starts at each character of some whole texts laid end to end."""
    if not len(points):
        return np.zeros(0, bool)
    own = symbols(points, first, v["classes"])
    run = scan(v["symbol_of"][own.astype(np.int32) + 8 * first], v["compose"], v["identity"])
    state = v["apply"][run, START]
    before = np.empty_like(state)
    before[0], before[1:] = START, state[:-1]
    before[first] = START
    return v["starts"][before, own]


class Merger:
    """Pieces to ids, with a bounded cache."""

    def __init__(self, v: dict, cache: int = CACHE):
        self.v, self.cache, self.known = v, cache, {}

    def _rank(self, left, right):
        """Rank of the merge of each pair; a large number where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.v["keys"], key)
        at[at == len(self.v["keys"])] = 0
        hit = self.v["keys"][at] == key
        return np.where(hit, self.v["merged"][at], np.int32(2**31 - 1))

    def _together(self, pieces: list[bytes], length: int):
        """Pieces of one length, a merge a round in each."""
        ids = self.v["bytes"][np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, length)]
        size = np.full(len(pieces), length)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(pieces))
        none = 2**31 - 1
        done: list = [None] * len(pieces)
        while len(live):
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            over = best == none
            if over.any():
                for i in np.flatnonzero(over):
                    done[live[i]] = ids[i, :size[i]].tolist()
                stay = ~over
                live, ids, rank, size, at, best = live[stay], ids[stay], rank[stay], size[stay], at[stay], best[stay]
                if not len(live):
                    break
            row = np.arange(len(live))
            keep = np.arange(ids.shape[1] - 1)[None, :]
            moved = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)
            moved[row, at] = best
            size -= 1
            ids = moved
            keep = np.arange(ids.shape[1] - 1)[None, :]
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), 1)
            width = ids.shape[1]
            if width > 1:
                for side in (-1, 0):                    # the pairs left and right of the merged id
                    place = at + side
                    fits = (place >= 0) & (place < size - 1)
                    r, p = row[fits], place[fits]
                    rank[r, p] = self._rank(ids[r, p], ids[r, p + 1])
                past = keep >= (size - 1)[:, None]
                rank[past] = none
            else:
                for i in range(len(live)):
                    done[live[i]] = ids[i, :1].tolist()
                break
        return done

    def _long(self, piece: bytes):
        """One long piece: candidate pairs in a heap, neighbours in linked lists."""
        ids = self.v["bytes"][np.frombuffer(piece, np.uint8)]
        rank = self._rank(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != 2**31 - 1]
        heapq.heapify(heap)
        pair = {}

        def push(i):
            j = after[i]
            if i >= 0 and j < n:
                key = (ids[i], ids[j])
                if key not in pair:
                    pair[key] = int(self._rank(np.array([key[0]]), np.array([key[1]]))[0])
                if pair[key] != 2**31 - 1:
                    heapq.heappush(heap, (pair[key], i, *key))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def learn(self, pieces) -> None:
        """Merge all pieces that are not known yet."""
        ranks, by_length = self.v["ranks"], {}
        for p in pieces:
            whole = ranks.get(p)
            if whole is not None:
                self._keep(p, [whole])
            elif len(p) > ARRAY_LENGTH:
                self._keep(p, self._long(p))
            else:
                by_length.setdefault(len(p), []).append(p)
        for length, group in by_length.items():
            for at in range(0, len(group), 4096):
                some = group[at:at + 4096]
                for p, ids in zip(some, self._together(some, length)):
                    self._keep(p, ids)

    def _keep(self, piece, ids):
        self.known[piece] = (np.array(ids, np.int32).tobytes(), ",".join(map(str, ids)).encode())

    def encode(self, texts: list[list[bytes]]) -> list[list[tuple]]:
        """(ids as packed 32-bit numbers, ids in decimal) of each piece of each text. New pieces of
        all the texts are merged together."""
        known = self.known
        new = {p for pieces in texts for p in pieces if p not in known}
        if new:
            if known and len(known) + len(new) > self.cache:
                known.clear()
                new = {p for pieces in texts for p in pieces}
            self.learn(new)
        return [[known[p] for p in pieces] for pieces in texts]


def text_pieces(texts: list[str], v: dict):
    """Lists of texts, each text as the bytes of its pieces. Texts are scanned together, as many
    whole ones as fit a slice."""
    at = 0
    while at < len(texts):
        end, room = at, SLICE
        while end < len(texts) and (end == at or room >= len(texts[end])):
            room -= len(texts[end])
            end += 1
        some = texts[at:end]
        raw = [t.encode("utf-8", "surrogatepass") for t in some]
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in some])
        ends = np.cumsum(lengths)
        first = np.zeros(len(points), bool)
        first[(ends - lengths)[lengths > 0]] = True
        starts = piece_starts(points, first, v)
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width)])
        marks = np.flatnonzero(starts)
        places = offset[marks]
        bounds = np.searchsorted(marks, np.concatenate([[0], ends]))
        base = offset[np.concatenate([[0], ends])]
        out = []
        for i, b in enumerate(raw):
            cut = (places[bounds[i]:bounds[i + 1]] - base[i]).tolist()
            cut.append(len(b))
            out.append([b[x:y] for x, y in zip(cut, cut[1:])] if b else [])
        yield out
        at = end


def unpacked(pieces: list[tuple]) -> list[int]:
    """The ids of a text from those of its pieces."""
    return np.frombuffer(b"".join([p[0] for p in pieces]), np.int32).tolist()


def decode_bytes(ids, v: dict) -> bytes:
    texts = v["texts"]
    return b"".join([texts[i] for i in ids])


def offsets(ids, v: dict) -> list[int]:
    """Where each id's bytes start in the text's UTF-8."""
    size = np.array([len(v["texts"][i]) for i in ids], dtype=np.int64)
    return (np.cumsum(size) - size).tolist()


def _broadcast(df: DataFrame, path: str):
    return whole_texts(df).sparkSession.sparkContext.broadcast(vocabulary(path))


def encode(docs: DataFrame, path: str, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, offsets): each text's ids and the byte offset at which each id starts."""
    shared = _broadcast(docs, path)

    def run(batches):
        merger = Merger(shared.value)
        for batch in parts(batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            ids = [unpacked(one) for some in text_pieces(texts, shared.value) for one in merger.encode(some)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([offsets(x, shared.value) for x in ids], pa.list_(pa.int64()))],
                                             names=["id", "ids", "offsets"])
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of rows with ids."""
    shared = _broadcast(encoded, path)

    def run(batches):
        for batch in batches:
            texts = [decode_bytes(x or [], shared.value).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])
    rows = encoded.select("id", "ids")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string")


def round_trip(docs: DataFrame, path: str, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode without moving the ids out of
    the task that made them."""
    shared = _broadcast(docs, path)

    def run(batches):
        v = shared.value
        merger = Merger(v)
        for batch in parts(batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            count, ids_hash, text_hash = [], [], []
            for got in (one for some in text_pieces(texts, v) for one in merger.encode(some)):
                ids = unpacked(got)
                count.append(len(ids))
                ids_hash.append(hashlib.sha256(b",".join([g[1] for g in got])).hexdigest())
                text_hash.append(hashlib.sha256(decode_bytes(ids, v)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
