"""Two-dimensional range reporting over words in numpy.

``Grid`` holds words of one length as points: the place of a word in forward
order, and its place in the order of the words read backwards.  Words with a
given prefix are an interval of the first order, words with a given suffix one
of the second, so words with both are the points of a rectangle, which a
wavelet tree reports in time that depends on the height of the tree and on what
is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def code_points(words: list[str], length: int) -> np.ndarray:
    """One row for each word of ``length`` code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


class Wavelet:
    """The values of a permutation, by bits from the highest: for each level, how many zeros lie before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (len(values) - 1).bit_length()) if len(values) else 1
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and value of every place in ``lo[q] .. hi[q]`` whose value is in ``least[q] .. end[q]`` (ends excluded)."""
        q = np.flatnonzero((lo < hi) & (least < end))
        lo, hi, node = lo[q], hi[q], np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            lo0, hi0 = zeros[lo], zeros[hi]
            lo1, hi1 = zeros[-1] + lo - lo0, zeros[-1] + hi - hi0
            left = (lo0 < hi0) & (node < end[q]) & (node + width > least[q])
            right = (lo1 < hi1) & (node + width < end[q]) & (node + 2 * width > least[q])
            lo, hi = np.concatenate([lo0[left], lo1[right]]), np.concatenate([hi0[left], hi1[right]])
            node = np.concatenate([node[left], node[right] + width])
            q = np.concatenate([q[left], q[right]])
        return q, node


class _Order:
    """Rows in their order, with what adjacent rows share and the points among them."""

    def __init__(self, rows: np.ndarray, is_point: np.ndarray):
        # numpy drops zero bytes at the end of such strings when it compares them, which moves no row of one width
        keys = np.ascontiguousarray(rows, ">u4").view(f"S{4 * rows.shape[1]}").ravel()
        self.order = np.argsort(keys, kind="stable")
        self.place = np.empty(len(rows), np.int64)
        self.place[self.order] = np.arange(len(rows))
        there = rows[self.order]
        differ = there[1:] != there[:-1]
        self.shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        self.points = np.concatenate([[0], np.cumsum(is_point[self.order])])

    def intervals(self, known: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the places among the points of those that begin with the same ``known`` code points."""
        first = np.concatenate([[0], np.flatnonzero(self.shared < known) + 1, [len(self.order)]])
        lo, hi = self.points[first[:-1]], self.points[first[1:]]
        size = np.diff(first)
        return np.repeat(lo, size)[self.place], np.repeat(hi, size)[self.place]


class Grid:
    """``points``: distinct words of one length; ``shorter``: distinct words with one code point less (rows of code points)."""

    def __init__(self, points: np.ndarray, shorter: np.ndarray):
        (n, self.length), m = points.shape, len(shorter)
        self.n, self.points, is_point = n, points, np.arange(n + m) < n
        forward, backward = np.zeros((n + m, self.length), np.uint32), np.zeros((n + m, self.length), np.uint32)
        forward[:n], backward[:n] = points, points[:, ::-1]
        forward[n:, :-1], backward[n:, :-1] = shorter, shorter[:, ::-1]
        self.ahead, self.back = _Order(forward, is_point), _Order(backward, is_point)
        place = np.empty(n, np.int64)
        place[(by_end := self.back.order[is_point[self.back.order]])] = np.arange(n)
        self.by_end = by_end
        self.tree = Wavelet(place[self.ahead.order[is_point[self.ahead.order]]])

    def edits(self, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each place of an edit from ``first`` on: rows (points, then shorter words) and the points made of them there.

        A point gets one other code point at that place, a shorter word one more;
        points come with the others, never with themselves.
        """
        own = np.arange(len(self.ahead.place)) < self.n
        for i in range(first, self.length):
            lo, hi = self.ahead.intervals(i)
            least, end = self.back.intervals(self.length - 1 - i)
            some = np.flatnonzero((hi - lo > own) & (end - least > own))  # one alone is the point itself
            if len(some):
                q, place = self.tree.report(lo[some], hi[some], least[some], end[some])
                row, point = some[q], self.by_end[place]
                other = row != point
                yield i, row[other], point[other]
