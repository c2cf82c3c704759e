"""Unions of intervals of real numbers."""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (low, high, low included, high included)
Interval = tuple[float, float, bool, bool]


def _empty(i: Interval) -> bool:
    return i[0] > i[1] or i[0] == i[1] and not (i[2] and i[3])


@dataclass(frozen=True)
class IntervalUnion:
    """Disjoint intervals in ascending order. ``~ & | - ^`` and ``in``."""

    parts: tuple[Interval, ...] = ((-inf, inf, False, False),)

    @staticmethod
    def of(low: float = -inf, high: float = inf, low_in: bool = False, high_in: bool = False) -> IntervalUnion:
        i = (low, high, low_in and low > -inf, high_in and high < inf)
        return IntervalUnion(() if _empty(i) else (i,))

    def is_empty(self) -> bool:
        return not self.parts

    def is_all(self) -> bool:
        return self.parts == ((-inf, inf, False, False),)

    def __contains__(self, x: float) -> bool:
        return any((a < x or x == a and ai) and (x < b or x == b and bi) for a, b, ai, bi in self.parts)

    def __invert__(self) -> IntervalUnion:
        out, low, low_in = [], -inf, False
        for a, b, ai, bi in self.parts:
            out.append((low, a, low_in, not ai and a > -inf))
            low, low_in = b, not bi and b < inf
        out.append((low, inf, low_in, False))
        return IntervalUnion(tuple(i for i in out if not _empty(i) and not (abs(i[0]) == inf and i[0] == i[1])))

    def __and__(self, other: IntervalUnion) -> IntervalUnion:
        out = []
        for a in self.parts:
            for b in other.parts:
                low, low_in = max((a[0], not a[2]), (b[0], not b[2]))
                high, high_in = min((a[1], a[3]), (b[1], b[3]))
                i = (low, high, not low_in, high_in)
                if not _empty(i):
                    out.append(i)
        return IntervalUnion(tuple(sorted(out, key=lambda i: (i[0], not i[2]))))

    def __or__(self, other: IntervalUnion) -> IntervalUnion:
        return ~(~self & ~other)

    def __sub__(self, other: IntervalUnion) -> IntervalUnion:
        return self & ~other

    def __xor__(self, other: IntervalUnion) -> IntervalUnion:
        return (self - other) | (other - self)

    def __str__(self) -> str:
        text = [f"{'[' if ai else '('}{a}, {b}{']' if bi else ')'}" for a, b, ai, bi in self.parts]
        return " u ".join(text) or "{}"

    def column(self, col: Column) -> Column:
        """Whether a column's value lies inside; null stays null."""
        out = F.lit(False)
        for a, b, ai, bi in self.parts:
            low = F.lit(True) if a == -inf else col >= a if ai else col > a
            high = F.lit(True) if b == inf else col <= b if bi else col < b
            out = out | (low & high)
        return F.when(col.isNotNull(), out)
