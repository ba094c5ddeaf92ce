"""A signature tree over sets: nodes hold OR-combined bitmaps, size ranges and a component label."""

from __future__ import annotations

import numpy as np

FANOUT = 8
#: Node pairs looked at together.
CHUNK = 1 << 16


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token by its high bits; as many bits as the power of two from twice the set's size on (64 at least)."""
    bits = max(6, int(2 * len(tokens) - 1).bit_length())
    at = tokens >> np.uint64(64 - bits)
    out = np.zeros(1 << (bits - 6), np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def halve(bits: np.ndarray) -> np.ndarray:
    """Rows of bitmaps of half as many bits: neighbouring bits fall together."""
    m = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")
    m = m[:, 0::2] | m[:, 1::2]
    if m.shape[1] < 64:
        m = np.pad(m, ((0, 0), (0, 64 - m.shape[1])))
    return np.packbits(m, axis=1, bitorder="little").view(np.uint64)


class Labels:
    """A union-find forest over the members of a group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def all(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


class Tree:
    """Members in order of size; ``FANOUT`` of them, then of nodes, under each node."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((bits[:, 0], size))
        bits, size = bits[self.order], size[self.order].astype(np.int64)
        lost = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        #: Per level from the leaves: OR of bitmaps, least and most size, most tokens without a bit of their own.
        self.levels = [(bits, size, size, lost)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, lost = self.levels[-1]
            cut = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether members under the nodes i and j can reach the similarity: by sizes, then by the most tokens they can share."""
        bits, low, high, lost = self.levels[level]
        ok = (den * high[i] >= num * low[j]) & (den * high[j] >= num * low[i])
        k = np.flatnonzero(ok)
        if len(k):
            most = np.bitwise_count(bits[i[k]] & bits[j[k]]).sum(1).astype(np.int64) + np.minimum(lost[i[k]], lost[j[k]])
            most = np.minimum(most, np.minimum(high[i[k]], high[j[k]]))
            ok[k] = (num + den) * most >= num * (low[i[k]] + low[j[k]])
        return ok

    def self_join(self, labels: Labels, num: int, den: int, confirm=None) -> None:
        """Join in ``labels`` all members that link, by dual traversal; pairs of nodes that lie in one component are left out.

        Leaf pairs that the bounds allow link if ``confirm(a, b)`` says so, or as they are without it.
        """
        n = len(self.order)

        def leaves(i: np.ndarray, j: np.ndarray) -> None:
            for a, b in zip(self.order[i].tolist(), self.order[j].tolist()):
                if labels.find(a) != labels.find(b) and (confirm is None or confirm(a, b)):
                    labels.join(a, b)

        for step in (1, 2, 3):  # neighbours in order first: copies of one text lie close
            i = np.arange(n - step) if n > step else np.zeros(0, int)
            for k in range(0, len(i), CHUNK):
                part = i[k : k + CHUNK]
                ok = self.possible(0, part, part + step, num, den)
                leaves(part[ok], part[ok] + step)
        todo = [(len(self.levels) - 1, np.zeros(1, int), np.zeros(1, int))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > CHUNK:
                todo += [(level, i[k : k + CHUNK], j[k : k + CHUNK]) for k in range(0, len(i), CHUNK)]
                continue
            one = self._labels(labels, level)
            keep = (one[i] < 0) | (one[i] != one[j])
            i, j = i[keep], j[keep]
            ok = self.possible(level, i, j, num, den)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                leaves(i[i != j], j[i != j])
                continue
            f = np.arange(FANOUT)
            a = (i[:, None, None] * FANOUT + f[None, :, None] + 0 * f[None, None, :]).ravel()
            b = (j[:, None, None] * FANOUT + f[None, None, :] + 0 * f[None, :, None]).ravel()
            m = len(self.levels[level - 1][0])
            keep = (a < m) & (b < m) & (a <= b)
            todo.append((level - 1, a[keep], b[keep]))

    def _labels(self, labels: Labels, level: int) -> np.ndarray:
        """Each node's component, or -1 where its members have several."""
        one = labels.all()[self.order]
        for _ in range(level):
            cut = np.arange(0, len(one), FANOUT)
            low, high = np.minimum.reduceat(one, cut), np.maximum.reduceat(one, cut)
            one = np.where(low == high, high, -1)
        return one


def join_group(bits: list[np.ndarray], size: np.ndarray, num: int, den: int, labels: Labels, confirm=None) -> None:
    """Self-join of a group with bitmaps of several widths: those of one width with each other and with the next, folded."""
    width = np.array([len(b) for b in bits])
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        wider = np.flatnonzero((width == 2 * w) & (num * size <= den * size[own].max()))
        at = np.concatenate([own, wider])
        if len(at) < 2:
            continue
        rows = np.stack([bits[i] for i in own])
        if len(wider):
            rows = np.concatenate([rows, halve(np.stack([bits[i] for i in wider]))])
        local = Labels(len(at))
        first: dict[int, int] = {}
        for k, i in enumerate(at.tolist()):
            local.join(first.setdefault(labels.find(i), k), k)
        Tree(rows, size[at]).self_join(local, num, den, confirm and (lambda a, b: confirm(int(at[a]), int(at[b]))))
        for k, root in enumerate(local.all().tolist()):
            labels.join(int(at[k]), int(at[root]))
