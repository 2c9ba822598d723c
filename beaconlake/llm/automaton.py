"""Suffix automaton of some word sequences: which stretches of another sequence do they hold, and
in which of their documents first?"""
import numpy as np

NEVER = np.iinfo(np.int64).max


class Automaton:
    """States are classes of stretches with the same places; `low` is the least document of a class."""

    def __init__(self, sequences, documents):
        self.next, self.link, self.length, self.low = [{}], [-1], [0], [NEVER]
        for words, document in zip(sequences, documents):
            last = 0
            for word in words:
                last = self._extended(last, word)
                self.low[last] = min(self.low[last], document)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            self.low[above] = min(self.low[above], self.low[state])

    def _state(self, after, link, length):
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.low.append(NEVER)
        return len(self.link) - 1

    def _split(self, state, word, target):
        """The class of the shorter stretches of `target`, those that follow `state`."""
        if self.length[target] == self.length[state] + 1:
            return target
        short = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = short
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = short
            state = self.link[state]
        return short

    def _extended(self, last, word):
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state({}, 0, self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last][word])
        return new

    def statistics(self, words, most):
        """For each word the length of the longest stretch that ends there and that the sequences hold,
        and the least document of its last `most` words (of all of it, where it is shorter). Longer
        stretches are followed only by their last words."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            while state and self.length[self.link[state]] >= most:
                state = self.link[state]
                length = self.length[state]
            yield length, self.low[state] if state else NEVER
