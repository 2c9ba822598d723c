"""Set similarity inside one block, by a prefix tree.

The sets of a block are written in one order of their members, the most frequent first, so that
similar sets share long paths. A probe walks the tree level by level and carries the overlap of each
shared path once for all sets below it. A subtree is left when even a full match of what remains
(of the probe behind the path's last member, and of the longest set below) cannot reach the
similarity of 0.8 with the smallest set below."""
import numpy as np

from beaconlake.llm.arrays import ranges


def linked(overlap, n, m):
    """Similarity of 0.8 or more, in whole numbers."""
    return 180 * overlap >= 80 * (n + m)


class Tree:
    """Path-compressed prefix tree of sorted number arrays; nodes in level order, so that the
    children of a node lie side by side."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=[s.astype(">u4").tobytes() for s in sets].__getitem__), dtype=np.int64)
        own, size = [sets[i] for i in self.order], sizes[self.order]
        # A node holds the sets [low, high) in order, which share their members up to `end`.
        low, high, start, end = [0], [len(own)], [0], [0]
        first_child, children, stops = [], [], []
        at = 0
        while at < len(low):
            a, b, depth = low[at], high[at], end[at]
            stop = a
            while stop < b and len(own[stop]) == depth:         # sets that end here come first
                stop += 1
            stops.append(stop)
            first_child.append(len(low))
            if stop < b:
                heads = np.array([own[i][depth] for i in range(stop, b)])
                cuts = np.concatenate([[0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [b - stop]]) + stop
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    left, right = own[x], own[y - 1]
                    short = min(len(left), len(right))
                    differ = np.flatnonzero(left[depth:short] != right[depth:short])
                    low.append(x)
                    high.append(y)
                    start.append(depth)
                    end.append(depth + int(differ[0]) if len(differ) else short)
            children.append(len(low) - first_child[-1])
            at += 1
        self.low, self.stop, self.first_child, self.children = map(np.array, (low, stops, first_child, children))
        length = np.array([len(s) for s in own])
        bounds = np.stack([low, high], 1).ravel()
        self.shortest = np.minimum.reduceat(np.append(size, size.max(initial=0)), bounds)[::2] if len(own) else np.zeros(1, int)
        self.remaining = (np.maximum.reduceat(np.append(length, 0), bounds)[::2] if len(own) else np.zeros(1, int)) - end
        self.size = size
        self.segment = np.array(end) - start
        self.at = np.cumsum(self.segment) - self.segment
        parts = [own[x][s:e] for x, s, e in zip(low, start, end)]
        self.members = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.last = np.array([p[-1] if len(p) else -1 for p in parts])

    def probe(self, own: np.ndarray, n: int, mask: np.ndarray) -> np.ndarray:
        """Places (in the list given) of the sets similar to `own`, a set of n members in all;
        `mask` is a scratch array of zeros over all numbers."""
        mask[own] = 1
        node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found = []
        while len(node):
            ends = self.stop[node] - self.low[node]
            if ends.any():
                place, have = ranges(self.low[node], ends), np.repeat(overlap, ends)
                found.append(place[linked(have, n, self.size[place])])
            count = self.children[node]
            node, overlap = ranges(self.first_child[node], count), np.repeat(overlap, count)
            if not len(node):
                break
            size = self.segment[node]
            member = mask[self.members[ranges(self.at[node], size)]]
            overlap = overlap + np.add.reduceat(member, np.cumsum(size) - size, dtype=np.int64)
            behind = len(own) - np.searchsorted(own, self.last[node], "right")
            reach = overlap + np.minimum(behind, self.remaining[node])
            stay = linked(reach, n, self.shortest[node])
            node, overlap = node[stay], overlap[stay]
        mask[own] = 0
        return self.order[np.concatenate(found)] if found else np.zeros(0, np.int64)


def ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets over numbers of their own: 0 for the member that most of them hold. Members of a
    single set are left out; sizes are kept apart."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    names, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -count))] = np.arange(len(names))
    many = count > 1
    ends = np.cumsum([len(s) for s in sets])
    return [np.sort(rank[p[many[p]]]) for p in np.split(place, ends[:-1])] if sets else []


def links(sets: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, probes: np.ndarray | None = None, stored: np.ndarray | None = None):
    """Pairs (a, b) of places that connect all similar sets of the block: a spanning set, not all
    pairs. Sets of one `group` are known to be connected and not compared again; by default each
    set is probed against all, else the `probes` against the `stored`."""
    own = ranked(sets)
    probes = np.arange(len(own)) if probes is None else probes
    stored = np.arange(len(own)) if stored is None else stored
    if not len(probes) or not len(stored):
        return []
    tree = Tree([own[i] for i in stored], sizes[stored])
    mask = np.zeros(1 + max((int(s[-1]) for s in own if len(s)), default=0), np.int8)
    label = np.unique(group, return_inverse=True)[1]
    out = []
    for i in probes:
        if (label[stored] != label[i]).any():
            near = stored[tree.probe(own[i], int(sizes[i]), mask)]
            for other in np.unique(label[near]):
                if other != label[i]:
                    out.append((int(i), int(near[label[near] == other][0])))
                    label[label == other] = label[i]
    return out
