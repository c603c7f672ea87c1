"""The query representation: immutable, so that every rewrite is a pure function."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple


class Ref(NamedTuple):
    """Column `col` of the relation at position `binding` of the query's relation list."""

    binding: int
    col: int

    def __str__(self) -> str:
        return f"{self.binding}.{self.col}"

    @property
    def name(self) -> str:
        return f"b{self.binding}_c{self.col}"


@dataclass(frozen=True)
class Interval:
    """Closed integer interval; None is unbounded."""

    lo: int | None = None
    hi: int | None = None

    @staticmethod
    def of(op: str, value: int) -> Interval:
        if op == "=":
            return Interval(value, value)
        if op == "<":
            return Interval(None, value - 1)
        if op == ">":
            return Interval(value + 1, None)
        raise ValueError(f"unknown comparison {op!r}")

    def meet(self, other: Interval) -> Interval:
        los = [x for x in (self.lo, other.lo) if x is not None]
        his = [x for x in (self.hi, other.hi) if x is not None]
        return Interval(max(los, default=None), min(his, default=None))

    @property
    def empty(self) -> bool:
        return self.lo is not None and self.hi is not None and self.lo > self.hi

    @property
    def trivial(self) -> bool:
        return self.lo is None and self.hi is None


@dataclass(frozen=True)
class QuerySpec:
    """SELECT SUM(outputs...) over the relations, joined on `equi`, filtered by `domains`.

    A binding without any reference does not take part (it does not multiply rows).
    """

    relations: tuple[int, ...]
    equi: frozenset[frozenset[Ref]]
    domains: tuple[tuple[Ref, Interval], ...]
    outputs: tuple[Ref, ...]
    empty: bool = False
    trace: tuple[str, ...] = ()
    active: frozenset[int] | None = None  # bindings that take part, fixed before rewriting

    def noted(self, *notes: str, **changes) -> QuerySpec:
        return replace(self, trace=self.trace + notes, **changes)

    @property
    def domain(self) -> dict[Ref, Interval]:
        return dict(self.domains)

    @property
    def pairs(self) -> list[tuple[Ref, Ref]]:
        return sorted(tuple(sorted(p)) for p in self.equi)

    def refs(self) -> set[Ref]:
        return {r for p in self.equi for r in p} | {r for r, _ in self.domains} | set(self.outputs)

    @property
    def bindings(self) -> list[int]:
        """The bindings that take part, even if a rewrite has dropped their last predicate."""
        return sorted({r.binding for r in self.refs()} if self.active is None else self.active)

    def classes(self) -> list[list[Ref]]:
        """Columns that are equal in every result row, by union-find over the equalities."""
        parent: dict[Ref, Ref] = {}

        def find(x: Ref) -> Ref:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in self.pairs:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
        groups: dict[Ref, list[Ref]] = {}
        for x in sorted(parent):
            groups.setdefault(find(x), []).append(x)
        return [groups[k] for k in sorted(groups)]
