"""Word shingles of whole texts as sorted 64-bit numbers, by arrays.

Words are runs without ASCII white space, A-Z in lower case. A word's number is a polynomial of
its bytes, read from prefix sums; a shingle mixes five of them. Numbers are compared instead of
words: two different shingles share one with a chance of 2 ** -64 a pair."""
import numpy as np

WORDS = 5
SLICE = 1 << 18         # bytes hashed at a time; longer texts are cut at white space
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Hasher:
    """Tables of one task."""

    def __init__(self):
        self.byte = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self.base, self.back = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
        self.power = self.inverse = np.ones(0, np.uint64)
        self.factor = _mixed(np.arange(7, 7 + WORDS, dtype=np.uint64)) | _U(1)

    def _powers(self, size):
        if len(self.power) < size:
            for name, base in (("power", self.base), ("inverse", self.back)):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        return self.power, self.inverse

    def words(self, text: np.ndarray):
        """(start of each word, its number) of some bytes."""
        white = self.white[text]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(text) and not white[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) % 2:
            edge = np.concatenate([edge, [len(text)]])
        start, end = edge[::2], edge[1::2]
        power, inverse = self._powers(len(text) + 1)
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.byte[text] * power[:len(text)], out=total[1:])
        return start, _mixed((total[end] - total[start]) * inverse[start])

    def _long(self, text: bytes):
        """Word numbers of a text of any length, slice by slice."""
        found, at = [], 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            while end < len(text) and not self.white[text[end]]:
                end += 1
            found.append(self.words(np.frombuffer(text, np.uint8, end - at, at))[1])
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def _sets(self, numbers: np.ndarray, cuts: np.ndarray):
        n = len(numbers)
        run = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for i in range(WORDS):
            run += numbers[i:i + len(run)] * self.factor[i]
        run = _mixed(run)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= WORDS:
                yield np.unique(run[a:b - WORDS + 1])
            elif b > a:
                yield _mixed((numbers[a:b] * self.factor[:b - a]).sum(keepdims=True) + _U(b - a))
            else:
                yield np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]):
        """The sorted distinct shingles of each text; a text of fewer words is one shingle."""
        at = 0
        while at < len(texts):
            end, room = at, SLICE
            while end < len(texts) and (end == at or room > len(texts[end])):
                room -= len(texts[end]) + 1
                end += 1
            some = [t.lower() for t in texts[at:end]]
            if len(some) == 1:
                numbers = self._long(some[0])
                yield from self._sets(numbers, np.array([0, len(numbers)]))
            else:
                start, numbers = self.words(np.frombuffer(b"\n".join(some) + b"\n", np.uint8))
                ends = np.cumsum([len(t) + 1 for t in some])
                yield from self._sets(numbers, np.concatenate([[0], np.searchsorted(start, ends)]))
            at = end


def signature(shingles: np.ndarray) -> int:
    """One number for a whole set, the same for equal sets."""
    total, parity, size = int(shingles.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(shingles)), len(shingles)
    both = (total * 0x9E3779B97F4A7C15 + parity * 0xC2B2AE3D27D4EB4F + size) % (1 << 64)
    return int(_mixed(np.array([both], np.uint64)).astype(np.int64)[0])


def shared_at_least(n: int) -> int:
    """Members of a set of n that a partner of similarity 0.8 or more must hold."""
    return (4 * n + 4) // 5
