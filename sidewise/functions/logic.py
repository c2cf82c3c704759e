"""Small Boolean terms on the driver. A clause is a frozenset of ``(variable, sign)``; a form is a
set of clauses: alternatives of conjunctions (DNF) or conjunctions of alternatives (CNF)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np

Clause = frozenset[tuple[int, int]]


def _consistent(c: Clause) -> bool:
    return not any((v, -s) in c for v, s in c)


def simplify(clauses: Iterable[Clause]) -> frozenset[Clause]:
    """Drop contradictory clauses and those that contain another; merge two that differ in the
    sign of one variable."""
    found = {c for c in clauses if _consistent(c)}
    while True:
        found = {c for c in found if not any(o < c for o in found)}
        for a in found:
            merged = next((a - {x} for x in a for b in found if b == (a - {x}) | {(x[0], -x[1])}), None)
            if merged is not None:
                found = found | {merged}
                break
        else:
            return frozenset(found)


def distribute(clauses: Iterable[Clause]) -> frozenset[Clause]:
    """The other normal form."""
    out: set[Clause] = {frozenset()}
    for c in clauses:
        out = set(simplify(frozenset((*o, x)) for o in out for x in c))
    return frozenset(out)


def _negated(clauses: Iterable[Clause]) -> frozenset[Clause]:
    return frozenset(frozenset((v, -s) for v, s in c) for c in clauses)


@dataclass(frozen=True)
class Term:
    """A disjunctive (``disjunctive``) or conjunctive form."""

    clauses: frozenset[Clause]
    disjunctive: bool = True

    @staticmethod
    def of(array: np.ndarray, disjunctive: bool = True) -> Term:
        """From -1/0/+1: rows are variables, columns clauses."""
        columns = np.asarray(array).T
        return Term(simplify(frozenset((int(v), int(c[v])) for v in np.flatnonzero(c)) for c in columns), disjunctive)

    def array(self, n: int) -> np.ndarray:
        ordered = sorted(self.clauses, key=sorted)
        out = np.zeros((n, len(ordered)), np.int8)
        for k, c in enumerate(ordered):
            for v, s in c:
                out[v, k] = s
        return out

    def other(self) -> Term:
        return Term(distribute(self.clauses), not self.disjunctive)

    def _as(self, disjunctive: bool) -> Term:
        return self if self.disjunctive == disjunctive else self.other()

    def __or__(self, o: Term) -> Term:
        return Term(simplify(self._as(True).clauses | o._as(True).clauses), True)

    def __and__(self, o: Term) -> Term:
        return Term(simplify(self._as(False).clauses | o._as(False).clauses), False)

    def __invert__(self) -> Term:
        return Term(_negated(self.clauses), not self.disjunctive)

    def value(self, signs: Sequence[int]) -> bool:
        inner, outer = (all, any) if self.disjunctive else (any, all)
        return outer(inner(signs[v] == s for v, s in c) for c in self.clauses)

    def text(self, names: Sequence[str] | Callable[[int, int], str]) -> str:
        say = names if callable(names) else lambda v, s: names[v] if s > 0 else f"not {names[v]}"
        inner, outer = (" and ", " or ") if self.disjunctive else (" or ", " and ")
        parts = [inner.join(say(v, s) for v, s in sorted(c)) for c in sorted(self.clauses, key=sorted)]
        if not parts:
            return "false" if self.disjunctive else "true"
        return outer.join(f"({p})" if len(parts) > 1 and inner in p else p or ("true" if self.disjunctive else "false") for p in parts)


def corner_term(feature: int, side: int, parents: dict[int, tuple[tuple[int, int], tuple[int, int]]], disjunctive: bool = True) -> Term:
    """What a corner of features says about the features it was made of."""
    if feature not in parents:
        return Term(frozenset({frozenset({(feature, side)})}), disjunctive)
    a, b = (corner_term(f, o, parents) for f, o in parents[feature])
    both = a & b
    return (both if side > 0 else ~both)._as(disjunctive)
