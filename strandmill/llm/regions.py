"""Joins of sets in the metric of Jaccard distance: pivots, nearest-pivot regions, windows from the triangle inequality.

Two sets link at a distance of at most t.  Every member of a region measures its distance to the region's pivots.

* A member belongs to the region of its nearest pivot if that is within CLOSE, else to the outer region.
* A linked pair whose members belong to the regions of p and q meets in the one whose pivot comes first: a member x is
  copied to an earlier region q if d(x, q) <= min(d(x, home) + 2t, CLOSE + t), which the triangle inequality shows to be
  true of every x with a partner there.  Members of the outer region are copied to all regions by the same rule.
* Within a region of pivot q a pair is compared only if |d(x, q) - d(y, q)| <= t.
* Regions are joined in the same way again with pivots of their own until they are small.  A region whose parts, with
  the copies, would take nearly as many pairs as itself is compared as it is, within windows.

Only components are asked for, so members that are tied already, as those within t of a common pivot are, are not
compared with each other.  Nothing else is left out: the join is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Distance to its pivot up to which a member belongs to a region.
CLOSE = 0.5
#: Members for each pivot of a region, and pivots at most, in one step within a task.
LEAF, PIVOTS = 32, 16
#: Members that are compared with others in one step.
UNLINKED = 128
#: Cells of a table of pivots' elements, at most (but for one pivot of more).
CELLS = 8_000_000
_SLACK = 1e-9


def common_counts(u_sets: list[np.ndarray], n_sets: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, common): how many elements n_sets[start:end] (rows) share with u_sets (columns), in steps of bounded size."""
    universe = np.unique(np.concatenate(u_sets))
    member = np.zeros((len(universe) + 1, len(u_sets)), dtype=np.int16)
    for i, s in enumerate(u_sets):
        member[np.searchsorted(universe, s), i] = 1
    at = 0
    while at < len(n_sets):
        end, elements = at, 0
        while end < len(n_sets) and (end == at or elements + len(n_sets[end]) <= 40_000):
            elements += len(n_sets[end])
            end += 1
        flat = np.concatenate(n_sets[at:end])
        place = np.minimum(np.searchsorted(universe, flat), len(universe) - 1)
        place = np.where(universe[place] == flat, place, len(universe))
        sizes = [len(s) for s in n_sets[at:end]]
        yield at, end, np.add.reduceat(member[place], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int32).astype(np.int64)
        at = end


def distances(pivots: list[np.ndarray], sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of sets (rows) to pivots (columns), and whether they link, which is decided in whole numbers."""
    sizes, own = np.array([len(s) for s in sets]), np.array([len(s) for s in pivots])
    far, link = np.empty((len(sets), len(pivots))), np.empty((len(sets), len(pivots)), dtype=bool)
    first = 0
    while first < len(pivots):
        last, elements = first + 1, len(pivots[first])
        while last < len(pivots) and (elements + len(pivots[last])) * (last + 1 - first) <= CELLS:
            elements += len(pivots[last])
            last += 1
        for a, b, common in common_counts(pivots[first:last], sets):
            total = sizes[a:b, None] + own[None, first:last] - common
            far[a:b, first:last] = 1 - common / total
            link[a:b, first:last] = common * 100 >= total * percent
        first = last
    return far, link


def windows(far: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distances to pivots: each member's nearest pivot, whether it is close, and to which regions it is copied."""
    home = far.argmin(axis=1)
    near = far[np.arange(len(far)), home]
    close = near <= CLOSE
    upto = np.minimum(near + 2 * threshold, CLOSE + threshold) + _SLACK
    earlier = np.arange(far.shape[1])[None, :] < np.where(close, home, far.shape[1])[:, None]
    return home, close, earlier & (far <= upto[:, None])


class Region:
    """Components of the sets of one region; `label` ends as the least number of each one."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, self.threshold = sets, percent, 1 - percent / 100
        self.sizes = np.array([len(s) for s in sets])
        self.label = np.arange(len(sets))
        #: What was done: regions, copies of boundary members, the deepest level, pairs that windows left out and that were compared.
        self.done: Counter[str] = Counter()

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        # Roots hang on lesser roots, so what earlier calls have tied moves as a whole; then every label is a root again.
        label = self.label
        while (label[i] != label[j]).any():
            a, b = label[i], label[j]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = self.label = label[label]

    def loose(self, rows: np.ndarray) -> np.ndarray:
        """Rows besides those of the most frequent label: one of each pair that is not tied yet is among them."""
        values, counts = np.unique(self.label[rows], return_counts=True)
        return rows[self.label[rows] != values[counts.argmax()]]

    def compare(self, rows: np.ndarray, far: np.ndarray | None) -> None:
        """Measure all pairs of rows that are not tied and that sizes and distances to the pivot allow to link."""
        order = np.argsort(self.sizes[rows] if far is None else far, kind="stable")
        rows = rows[order]
        far = np.zeros(len(rows)) if far is None else far[order]
        left = np.isin(rows, self.loose(rows)).nonzero()[0]
        for at in range(0, len(left), UNLINKED):
            some = left[at : at + UNLINKED]
            if (self.label[rows[some]] == self.label[rows[0]]).all() and (self.label[rows] == self.label[rows[0]]).all():
                return
            reach = self.threshold + _SLACK
            fits = (far >= far[some].min() - reach) & (far <= far[some].max() + reach)
            size, mine = self.sizes[rows], self.sizes[rows[some]]
            fits &= (size * 100 >= mine.min() * self.percent) & (size * self.percent <= mine.max() * 100)
            others = np.flatnonzero(fits)
            self.done["left out"] += len(some) * (len(rows) - len(others))
            self.done["compared"] += len(some) * len(others)
            _, link = distances([self.sets[k] for k in rows[some]], [self.sets[k] for k in rows[others]], self.percent)
            n, u = np.nonzero(link)
            self.tie(rows[some[u]], rows[others[n]])

    def join(self, far: np.ndarray | None = None) -> np.ndarray:
        """Labels of all sets.  far: their distances to a pivot of the region, if known."""
        todo = [(np.arange(len(self.sets)), far, 0)]
        while todo:
            rows, far, depth = todo.pop()
            loose = self.loose(rows) if len(rows) > 1 else rows[:0]
            if not len(loose):
                continue
            if len(rows) == 2:
                self.compare(rows, far)
                continue
            self.done["regions"] += 1
            self.done["deepest"] = max(self.done["deepest"], depth)
            # Near copies vary in length, so pivots of all sizes, middle ones first, are likely to be near many.
            k = min(PIVOTS, max(1, len(loose) // LEAF))
            chosen = loose[np.argsort(self.sizes[loose], kind="stable")[(np.arange(k) * 2 + 1) * len(loose) // (2 * k)]]
            d, link = distances([self.sets[p] for p in chosen], [self.sets[x] for x in rows], self.percent)
            x, p = np.nonzero(link)
            self.tie(rows[x], chosen[p])
            home, close, copied = windows(d, self.threshold)
            parts = []
            for q in range(k):
                own = close & (home == q)
                members = own | (copied[:, q] & (d[:, q] <= d[own, q].max(initial=-1) + self.threshold + _SLACK))
                parts.append((members, d[:, q]))
            parts.append((~close, None))
            work = lambda some: len(self.loose(some)) * len(some) if len(some) else 0
            if sum(work(rows[m]) for m, _ in parts) > 0.75 * work(rows):
                self.compare(rows, d[:, d.std(axis=0).argmax()])
                continue
            self.done["copies"] += sum(int(m.sum()) for m, _ in parts) - len(rows)
            for members, near in parts:
                part, near = rows[members], None if near is None else near[members]
                if len(part) > LEAF:
                    todo.append((part, near, depth + 1))
                elif len(part) > 1:
                    self.compare(part, near)
        return self.label


def region_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Number of each set's linked group: the least number in it."""
    return Region(sets, percent).join()
