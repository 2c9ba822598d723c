"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the sure cases. The field labels words that hold a digit or an at sign (the only ones
that can be part of an address or number; all others are known to be plain): neighbours in the text
share a transition potential, and words with the same digits or the same mailbox name, however far
apart in the document, share a hub that draws them to one label. Loopy message passing spreads what is
certain at one place to the others, so a card number that a pattern misses because another number
stands next to it is found when it looks like one or recurs. A hub keeps the links of a word that
recurs n times at n.

The weights are fitted by pseudo-likelihood on the words of at most SAMPLE documents (the smallest hashes of
the id among those with a digit or an at sign) and at most WORDS of their words, labelled by the patterns. Every whole text is
searched.

Defined results: a null text is empty and has no spans; repeated rows get equal results; a table
without any such word is served by the patterns alone; empty tables give empty results; other columns are not
read. Places are code points, ends exclusive.
"""
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from beaconlake.llm.arrays import parts, rows_of, whole_texts

KINDS = ["email", "ip", "card", "phone"]
LABELS = 1 + len(KINDS)             # 0: plain
SAMPLE, WORDS = 3000, 60_000
PIECE = 2000            # words of one document that the fit reads, from a place given by a hash of the id
SLOTS = 1 << 13
STEPS, PACE, DECAY = 400, 0.5, 1e-4
ROUNDS = 8                          # of message passing
CERTAIN = 0.9                       # belief a span of the field needs
ALIKE = 6                           # digits or letters that make two words alike


def _tools():
    """Patterns of one task. All are linear in the text."""
    return {"any": re.compile(r"[0-9@]"), "word": re.compile(r"[^\x20\x09-\x0D]+"), "domain": re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
            "dotted": re.compile(r"[0-9]++(?:\.[0-9]++)*+"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
            "not_digit": re.compile(r"[^0-9]+"), "digits": re.compile(r"[0-9]+"), "letters": re.compile(r"[^\W\d_]+"),
            "local": frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str, t: dict) -> list[tuple]:
    """(kind, start, end) of the patterns, by kind as listed, then start."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in t["local"]:
            start -= 1
        domain = t["domain"].match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for chunk in t["dotted"].finditer(text):
        parts = chunk.group().split(".")
        place = chunk.start()
        for i in range(0, len(parts) - 3, 4):
            some = parts[i:i + 4]
            size = sum(map(len, some)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in some):
                found.append((1, place, place + size))
            place += size + 1
    for m in t["card"].finditer(text):
        digits = t["not_digit"].sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in t["phone"].finditer(text):
        if 8 <= len(t["not_digit"].sub("", m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


_EDGE = ".,;:!?\"'*%$&#<>|[]{}=`"


def _shape(core: str, t: dict) -> tuple[str, str]:
    """With and without the lengths of digit runs."""
    plain = t["letters"].sub("a", core)
    return t["digits"].sub(lambda m: f"d{min(20, len(m.group()))}", plain), t["digits"].sub("d", plain)


class Words:
    """The words of one document that take part: place, features, key of their hub."""

    def __init__(self, text: str, t: dict):
        self.start, self.end, self.slots, self.key, self.position = [], [], [], [], []
        shapes, cores = [], []
        for i, m in enumerate(t["word"].finditer(text)):
            word = m.group()
            if not t["any"].search(word):
                continue
            core = word.strip(_EDGE)
            if not t["any"].search(core):
                continue
            left = m.start() + len(word) - len(word.lstrip(_EDGE))
            self.start.append(left)
            self.end.append(left + len(core))
            self.position.append(i)
            cores.append(core)
            shapes.append(_shape(core, t))
        for j, (core, (exact, coarse)) in enumerate(zip(cores, shapes)):
            digits = t["not_digit"].sub("", core)
            near = [shapes[k][1] if 0 <= k < len(shapes) and abs(self.position[k] - self.position[j]) == 1 else "w" for k in (j - 1, j + 1)]
            parts = core.split(".")
            address = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
            bare = len(digits) == len(core.replace("-", ""))
            marks = [f"x{exact}", f"c{coarse}", f"n{min(20, len(digits))}", f"b{near[0]}", f"f{near[1]}", f"a{address}",
                     f"l{bare and 16 <= len(digits) <= 19 and luhn(digits)}"]
            self.slots.append([zlib.crc32(x.encode("utf-8", "replace")) % SLOTS for x in marks])
            name = core.partition("@")[0].strip("(+").lower() if "@" in core else digits
            self.key.append(("@" if "@" in core else "#") + name if len(name) >= ALIKE else None)

    def __len__(self):
        return len(self.start)

    def labels(self, spans: list[tuple]) -> np.ndarray:
        """The label of each word by the spans that touch it."""
        out = np.zeros(len(self), np.int64)
        start, end = np.array(self.start), np.array(self.end)
        for kind, a, b in spans:
            out[(start < b) & (end > a) & (out == 0)] = kind + 1
        return out


def graph(docs: list[Words]):
    """(slots, left, hub): features of all words of some documents, for each word the index of the
    word just before it (-1: plain), and the number of its hub (-1: none)."""
    slots, left, hub, names, at = [], [], [], {}, 0
    for d, w in enumerate(docs):
        slots += w.slots
        left += [at + j - 1 if j and w.position[j] == w.position[j - 1] + 1 else -1 for j in range(len(w))]
        hub += [-1 if k is None else names.setdefault((d, k), len(names)) for k in w.key]
        at += len(w)
    hub = np.array(hub, np.int64)
    counts = np.bincount(hub[hub >= 0], minlength=len(names)) if len(names) else np.zeros(0, int)
    alone = (hub >= 0) & (np.append(counts, 0)[hub] < 2)
    hub[alone] = -1
    return np.array(slots, np.int64).reshape(-1, 7), np.array(left, np.int64), hub


def _softmax(x):
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(slots, left, hub, label):
    """Word weights, transition potentials and the pull of a hub, by pseudo-likelihood: each word
    given the labels of its neighbours and the other words of its hub."""
    n = len(label)
    hot = np.eye(LABELS)[label]
    right = np.full(n, -1)
    right[left[left >= 0]] = np.flatnonzero(left >= 0)
    before = np.where(left >= 0, label[left], 0)
    after = np.where(right >= 0, label[right], 0)
    mean = np.zeros((n, LABELS))
    tied = hub >= 0
    if tied.any():
        size = hub.max() + 1
        total, count = np.zeros((size, LABELS)), np.bincount(hub[tied], minlength=size)
        np.add.at(total, hub[tied], hot[tied])
        mean[tied] = (total[hub[tied]] - hot[tied]) / (count[hub[tied]] - 1)[:, None]
    w, theta, pull = np.zeros((SLOTS, LABELS)), np.zeros((LABELS, LABELS)), 1.0
    squares = [np.full_like(w, 1e-8), np.full_like(theta, 1e-8)]
    for _ in range(STEPS):
        p = _softmax(w[slots].sum(1) + theta[before] + theta.T[after] + pull * mean)
        error = (p - hot) / n
        slope_w = np.zeros_like(w)
        for j in range(slots.shape[1]):
            np.add.at(slope_w, slots[:, j], error)
        slope_t = np.zeros_like(theta)
        np.add.at(slope_t, before, error)
        np.add.at(slope_t.T, after, error)
        for value, slope, square in ((w, slope_w, squares[0]), (theta, slope_t, squares[1])):
            slope += DECAY * value
            square += slope * slope
            value -= PACE * slope / np.sqrt(square)
        pull = float(np.clip(pull - PACE * (error * mean).sum(), 0.5, 4.0))
    return w, theta, pull


def beliefs(model, slots, left, hub):
    """Label chances of every word by loopy message passing over chains and hubs."""
    w, theta, pull = model
    own = w[slots].sum(1)
    has_left = left >= 0
    right = np.full(len(left), -1)
    right[left[has_left]] = np.flatnonzero(has_left)
    has_right = right >= 0
    own = own + np.where(has_left[:, None], 0, theta[0]) + np.where(has_right[:, None], 0, theta[:, 0])
    tied = hub >= 0
    size = int(hub.max()) + 1 if tied.any() else 0
    forward, backward, down, up = (np.zeros_like(own) for _ in range(4))
    norm = lambda x: x - np.logaddexp.reduce(x, axis=1, keepdims=True)
    link = pull * np.eye(LABELS)
    push = lambda x, potential: norm(np.logaddexp.reduce(x[:, :, None] + potential[None], axis=1))
    for _ in range(ROUNDS):
        total = own + forward + backward + down
        new_forward, new_backward = np.zeros_like(own), np.zeros_like(own)
        if has_left.any():
            new_forward[has_left] = push((total - backward)[left[has_left]], theta)
        if has_right.any():
            new_backward[has_right] = push((total - forward)[right[has_right]], theta.T)
        if size:
            up[tied] = push((total - down)[tied], link)
            hubs = np.zeros((size, LABELS))
            np.add.at(hubs, hub[tied], up[tied])
            down[tied] = 0.5 * down[tied] + 0.5 * push(hubs[hub[tied]] - up[tied], link)
        forward, backward = 0.5 * (forward + new_forward), 0.5 * (backward + new_backward)
    return np.exp(norm(own + forward + backward + down))


def added(w: Words, chance: np.ndarray, spans: list[tuple]) -> list[tuple]:
    """Spans of the field where no pattern has one: runs of adjacent words of one label."""
    label = chance.argmax(1)
    label[chance.max(1) < CERTAIN] = 0
    label[w.labels(spans) > 0] = 0
    out = []
    for j in np.flatnonzero(label):
        kind = int(label[j]) - 1
        if out and out[-1][0] == kind and out[-1][3] + 1 == w.position[j] and kind == 3:
            out[-1] = (kind, out[-1][1], w.end[j], w.position[j])
        else:
            out.append((kind, w.start[j], w.end[j], w.position[j]))
    return [x[:3] for x in out]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def piece(name, slots, left, hub, label):
    """At most PIECE words in a row of one document's graph, so that a long one can't fill the sample."""
    n = len(label)
    if n <= PIECE:
        return slots, left, hub, label
    start = zlib.crc32(str(name).encode()) % (n - PIECE + 1)
    end = start + PIECE
    _, number, count = np.unique(hub[start:end], return_inverse=True, return_counts=True)
    return slots[start:end], np.maximum(left[start:end] - start, -1), np.where((hub[start:end] >= 0) & (count[number] > 1), number, -1), label[start:end]


def train(docs: DataFrame, identity: str = "doc_id", text: str = "text"):
    """The model, or None where no document has a word to learn from."""
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    ids = rows.where(F.col("text").rlike("[0-9@]") & F.col("id").isNotNull()).select("id").distinct().orderBy(F.xxhash64("id", F.lit("field")), "id").limit(SAMPLE)

    def features(batches):
        t = _tools()
        for batch in parts(batches):
            got = []
            for name, x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                w = Words(x, t) if x else None
                if w is not None and len(w):
                    slots, left, hub, label = piece(name, *graph([w]), w.labels(base_spans(x, t)))
                    got.append((name, slots.ravel().tolist(), left.tolist(), hub.tolist(), label.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], batch.column("id").type)] + [pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in range(1, 5)],
                                             names=["id", "slots", "near", "hub", "label"])
    kind = dict(rows.dtypes)["id"]
    got = (rows.join(F.broadcast(ids), "id").mapInArrow(features, f"id {kind}, slots array<bigint>, near array<bigint>, hub array<bigint>, label array<bigint>")
           .dropDuplicates(["id"]).withColumn("sum", F.sum(F.size("label")).over(_by_hash())).where(F.col("sum") <= WORDS).toArrow())
    if not got.num_rows:
        return None
    order = got.sort_by("sum")
    slots, left, hub, label = ([np.array(x, np.int64) for x in order.column(c).to_pylist()] for c in ("slots", "near", "hub", "label"))
    at, hubs, lefts, names = 0, [], [], 0
    for a, h in zip(left, hub):
        lefts.append(np.where(a >= 0, a + at, -1))
        hubs.append(np.where(h >= 0, h + names, -1))
        at, names = at + len(a), names + int(h.max(initial=-1)) + 1
    return fit(np.concatenate(slots).reshape(-1, 7), np.concatenate(lefts), np.concatenate(hubs), np.concatenate(label))


def _by_hash():
    return Window.orderBy(F.xxhash64("id", F.lit("field")), "id")          # at most SAMPLE rows


def found(docs: DataFrame, model, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, the counts of base spans by kind, base_sha256, spans."""
    shared = whole_texts(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        t, model = _tools(), shared.value
        for batch in parts(batches):
            base, more, asked = [], [], []
            for x in batch.column("text").to_pylist():
                hit = bool(x) and t["any"].search(x) is not None
                base.append(base_spans(x, t) if hit else [])
                more.append([])
                if hit and model is not None:
                    w = Words(x, t)
                    if len(w):
                        asked.append((len(base) - 1, w))
            for some in [asked[i:i + 256] for i in range(0, len(asked), 256)]:
                chance = beliefs(model, *graph([w for _, w in some]))
                at = 0
                for row, w in some:
                    more[row] = added(w, chance[at:at + len(w)], base[row])
                    at += len(w)
            columns = {"id": batch.column("id")} | {f"n_{k}": pa.array([sum(s[0] == i for s in b) for b in base], pa.int64()) for i, k in enumerate(KINDS)}
            columns["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
            columns["spans"] = pa.array([written(b + m) for b, m in zip(base, more)], pa.string())
            yield rows_of(columns)
    rows = docs.select(F.col(identity).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")
