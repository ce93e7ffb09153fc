"""A map of disjoint intervals in which the latest change wins; one object's state in streams and tests."""

from __future__ import annotations

from bisect import bisect_left, bisect_right


class Intervals:
    """Intervals [lo, hi) with values, in order; put() and cut() replace what they overlap."""

    def __init__(self, rows: list[tuple[int, int, int]] | None = None):
        self.lo = [r[0] for r in rows or []]
        self.hi = [r[1] for r in rows or []]
        self.value = [r[2] for r in rows or []]

    def cut(self, lo: int, hi: int | None = None) -> None:
        """Removes what lies in [lo, hi), to the end if hi is None; intervals over an edge are shortened or split."""
        first = bisect_right(self.hi, lo)
        last = len(self.lo) if hi is None else bisect_left(self.lo, hi)
        if first >= last:
            return
        keep = []
        if self.lo[first] < lo:
            keep.append((self.lo[first], lo, self.value[first]))
        if hi is not None and self.hi[last - 1] > hi:
            keep.append((hi, self.hi[last - 1], self.value[last - 1]))
        for column, k in ((self.lo, 0), (self.hi, 1), (self.value, 2)):
            column[first:last] = [r[k] for r in keep]

    def put(self, lo: int, hi: int, value: int) -> None:
        if lo >= hi:
            return
        self.cut(lo, hi)
        at = bisect_left(self.lo, lo)
        self.lo.insert(at, lo)
        self.hi.insert(at, hi)
        self.value.insert(at, value)

    def rows(self) -> list[tuple[int, int, int]]:
        return list(zip(self.lo, self.hi, self.value, strict=True))

    def length(self) -> int:
        return sum(self.hi) - sum(self.lo)
