"""A K2-treap over a grid of terms and documents: a quadtree whose cells hold the greatest impact inside them.

Only cells with something in them are kept. A level is one byte for each of its cells, which says which quarters are
kept, and the maxima of these quarters as differences to their cell's. The quarters of all cells of a level follow each other, so
a child is found by counting.

Rows are set ``2 ** SPREAD`` apart: the last levels then have one term to a cell, so a cell over few documents is the term's own
maximum there.
"""

from __future__ import annotations

import heapq

import numpy as np

from salvage.llm.common import ragged

SPREAD = 5
# Ranges of this many documents are followed down to the documents at once; ranges of an item taken in a round.
LEAF_BITS = 6
AT_ONCE = 4

_POPCOUNT = np.array([bin(i).count("1") for i in range(16)], np.int64)


def _spaced(values: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^32 with a zero before each."""
    values = values.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        values = (values | (values << np.uint64(shift))) & np.uint64(mask)
    return values


def build(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int) -> tuple[list[int], bytes, bytes]:
    """Cells by level (the root first, single impacts last), the masks of all but the last level, and all maxima.

    ``rows`` and ``columns`` are different pairs below ``n_rows`` and ``n_columns``, impacts are positive.
    """
    height = max(1, (n_rows - 1).bit_length() + SPREAD, (n_columns - 1).bit_length())
    codes = (_spaced(rows << SPREAD) << np.uint64(1)) | _spaced(columns)
    order = np.argsort(codes)
    codes, maxima = codes[order], impacts[order].astype(np.int64)
    masks, levels, differences = [], [len(codes)], []
    for _ in range(height):
        parents = codes >> np.uint64(2)
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1])) if len(codes) else np.zeros(0, np.int64)
        greatest = np.maximum.reduceat(maxima, first) if len(codes) else maxima
        quarter = np.left_shift(1, (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        masks.append(np.bitwise_or.reduceat(quarter, first) if len(codes) else quarter)
        differences.append((np.repeat(greatest, np.diff(np.append(first, len(codes)))) - maxima).astype("<i4"))
        codes, maxima = parents[first], greatest
        levels.append(len(codes))
    differences.append(maxima.astype("<i4"))
    return levels[::-1], np.concatenate(masks[::-1]).tobytes(), np.concatenate(differences[::-1]).tobytes()


class Treap:
    """A tree as ``build`` made it, ready to be searched. Cells are numbered through all levels."""

    def __init__(self, levels: list[int], masks: bytes, differences: bytes) -> None:
        self.height = len(levels) - 1
        self._masks = np.frombuffer(masks, np.uint8).astype(np.int64)
        self._first = 1 + np.cumsum(_POPCOUNT[self._masks]) - _POPCOUNT[self._masks]
        self.maxima = np.frombuffer(differences, "<i4").astype(np.int64)
        start = 0
        for here, below in zip(levels, levels[1:]):
            children = _POPCOUNT[self._masks[start : start + here]]
            stop = start + here
            self.maxima[stop : stop + below] = np.repeat(self.maxima[start:stop], children) - self.maxima[stop : stop + below]
            start = stop

    def below(self, cells: np.ndarray, rows: np.ndarray, shift: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Which cells go on in the half ``side`` of their columns and in their row's half, and to which cells."""
        quarter = 2 * ((rows >> shift) & 1) + side
        masks = self._masks[cells]
        kept = np.flatnonzero((masks >> quarter) & 1)
        masks, quarter = masks[kept], quarter[kept]
        return kept, self._first[cells[kept]] + _POPCOUNT[masks & ((1 << quarter) - 1)]


class _Ranges:
    """Ranges of columns, each with the cells of its item's terms that are not empty there."""

    def __init__(self, item, level, start, lengths, terms, cells, bounds) -> None:
        self.item, self.level, self.start, self.lengths = item, level, start, lengths
        self.terms, self.cells, self.bounds = terms, cells, bounds


def _halves(treap: Treap, ranges: _Ranges, rows: np.ndarray, weights: np.ndarray) -> _Ranges:
    """Both halves of every range, as far as they hold anything."""
    n = len(ranges.item)
    owner = np.repeat(np.arange(n), ranges.lengths)
    shift = (treap.height - 1 - ranges.level)[owner]
    parts = []
    for side in (0, 1):
        kept, cells = treap.below(ranges.cells, rows[ranges.terms], shift, side)
        terms, own = ranges.terms[kept], owner[kept]
        lengths = np.bincount(own, minlength=n)
        # Sums of whole numbers below 2^53, so exact.
        bounds = np.bincount(own, weights[terms] * treap.maxima[cells], n).astype(np.int64)
        there = np.flatnonzero(lengths)
        start = ranges.start[there] + (side << (treap.height - 1 - ranges.level[there]))
        parts.append((ranges.item[there], ranges.level[there] + 1, start, lengths[there], terms, cells, bounds[there]))
    return _Ranges(*(np.concatenate(x) for x in zip(*parts)))


def search(treap: Treap, items: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, int]]]:
    """The ``k`` best columns of each item as ``(-score, column)``, best first, equal scores by column; scores above 0.

    An item is the rows and the whole weights of its terms. The paths of its rows descend together: a range of columns is
    bounded by the sum of its terms' weighted maxima, the greatest bound is halved first, and an item ends when no range
    can reach its ``k``-th best column. All items take their next ranges in the same round.
    """
    rows = np.concatenate([r << SPREAD for r, _ in items] or [np.zeros(0, np.int64)])
    weights = np.concatenate([w for _, w in items] or [np.zeros(0, np.int64)]).astype(np.float64)
    ends = np.cumsum([len(r) for r, _ in items])
    best: list[list[tuple[int, int]]] = [[] for _ in items]
    open_: list[list[tuple]] = [[] for _ in items]

    def put(found: _Ranges) -> None:
        stops = np.cumsum(found.lengths)
        columns = (x.tolist() for x in (found.bounds, found.start, found.item, found.level, stops - found.lengths, stops))
        for bound, start, item, level, a, b in zip(*columns):
            if bound > 0 and (len(best[item]) < k or bound >= -best[item][-1][0]):
                heapq.heappush(open_[item], (-bound, start, level, found.terms[a:b], found.cells[a:b]))

    def ranges(taken: list[tuple]) -> _Ranges:
        item, bound, start, level, terms, cells = zip(*taken)
        return _Ranges(
            np.array(item), np.array(level), np.array(start), np.fromiter(map(len, terms), np.int64, len(terms)),
            np.concatenate(terms), np.concatenate(cells), -np.array(bound),
        )

    for item, (own, _) in enumerate(items):
        if len(own) and len(treap.maxima):
            open_[item].append((-(1 << 62), 0, 0, np.arange(ends[item] - len(own), ends[item]), np.zeros(len(own), np.int64)))
    active = [i for i, heap in enumerate(open_) if heap]
    last = max(treap.height - LEAF_BITS, 0)
    while active:
        inner, small = [], []
        for item in active:
            heap, own = open_[item], best[item]
            for _ in range(min(AT_ONCE, len(heap))):
                if len(own) == k and -heap[0][0] < -own[-1][0]:
                    heap.clear()
                    break
                taken = (item, *heapq.heappop(heap))
                (small if taken[3] >= last else inner).append(taken)
        if inner:
            put(_halves(treap, ranges(inner), rows, weights))
        if small:
            found = ranges(small)
            while len(found.item) and found.level[0] < treap.height:
                found = _halves(treap, found, rows, weights)
            for item, score, column in zip(found.item.tolist(), (-found.bounds).tolist(), found.start.tolist()):
                if score < 0:
                    best[item].append((score, column))
            for item in {t[0] for t in small}:
                best[item] = sorted(best[item])[:k]
        active = [i for i in active if open_[i]]
    return best
