"""Statistics of relations: lazy, kept, and each got in one distributed aggregation.

Facts that the caller knows (keys, inclusion of foreign keys) can be declared; then no job
runs for them, as with informational constraints of a warehouse. Only counts, minima, maxima
and a verdict reach the driver.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import functions as F

from weir.catalog import Catalog
from weir.functions.histogram import Histogram
from weir.spec import Interval


@dataclass(frozen=True)
class ColumnStats:
    min: int | None
    max: int | None
    rows: int
    nulls: int
    distinct: int  # approximate

    @property
    def range(self) -> Interval:
        return Interval(self.min, self.max)


class Statistics:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.jobs = 0
        self._columns: dict[tuple[int, int], ColumnStats] = {}
        self._unique: dict[tuple[int, int], bool] = {}
        self._contained: dict[tuple[tuple[int, int], tuple[int, int]], bool] = {}
        self._groups: dict[tuple[int, tuple[int, ...]], int] = {}
        self.histograms: dict[tuple[int, int], Histogram] = {}
        self._lock = threading.Lock()
        self._locks: dict[tuple, threading.RLock] = {}

    def _once(self, known: dict, key: tuple, make) -> object:
        """known[key], made once; makers of different keys run side by side."""
        if key not in known:
            with self._lock:
                lock = self._locks.setdefault((id(known), key), threading.RLock())
            with lock:
                if key not in known:
                    known[key] = make()
        return known[key]

    def declare_unique(self, relation: int, col: int) -> None:
        self._unique[relation, col] = True

    def declare_contained(self, fk: tuple[int, int], pk: tuple[int, int]) -> None:
        self._contained[fk, pk] = True

    def column(self, relation: int, col: int) -> ColumnStats:
        """Minimum, maximum, rows, nulls and distinct values of one column; only it is read."""

        def make() -> ColumnStats:
            c = f"c{col}"
            df = self.catalog[relation].columns({col}, {})
            row = df.agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("k"), F.approx_count_distinct(c, 0.02).alias("d")).first()
            self.jobs += 1
            as_int = lambda v: None if v is None else int(v)
            return ColumnStats(as_int(row.lo), as_int(row.hi), row.n, row.n - row.k, row.d)

        return self._once(self._columns, (relation, col), make)

    def rows(self, relation: int) -> int:
        return next((s.rows for (r, _), s in list(self._columns.items()) if r == relation), None) or self.column(relation, 0).rows

    def unique(self, relation: int, col: int) -> bool:
        """No value occurs twice. An estimate far below the row count settles most columns."""

        def make() -> bool:
            s = self.column(relation, col)
            if s.nulls or s.distinct < 0.9 * s.rows:
                return False
            self.jobs += 1
            return self.catalog[relation].columns({col}, {}).groupBy(f"c{col}").count().where("count > 1").limit(1).isEmpty()

        return self._once(self._unique, (relation, col), make)

    def contained(self, fk: tuple[int, int], pk: tuple[int, int]) -> bool:
        """Every non-null value of column fk occurs in column pk."""
        if fk == pk:
            return True

        def make() -> bool:
            f, p = self.column(*fk), self.column(*pk)
            if f.min is None:
                return True
            if p.min is None or f.min < p.min or f.max > p.max:
                return False
            left = self.catalog[fk[0]].columns({fk[1]}, {}).select(F.col(f"c{fk[1]}").alias("v")).where("v is not null").distinct()
            right = self.catalog[pk[0]].columns({pk[1]}, {}).select(F.col(f"c{pk[1]}").alias("v"))
            self.jobs += 1
            return left.join(right, "v", "left_anti").limit(1).isEmpty()

        return self._once(self._contained, (fk, pk), make)

    def group_count(self, relation: int, cols: tuple[int, ...]) -> int:
        """About how many distinct combinations the columns have."""
        if len(cols) == 1:
            return self.column(relation, cols[0]).distinct

        def make() -> int:
            self.jobs += 1
            return self.catalog[relation].columns(set(cols), {}).agg(F.approx_count_distinct(F.struct(*[f"c{c}" for c in cols]), 0.02)).first()[0]

        return self._once(self._groups, (relation, cols), make)

    def fraction(self, relation: int, col: int, domain: Interval) -> float:
        """Share of the rows in the domain: by the column's histogram, if there is one, else the share
        of its value range; 1/distinct for a point."""
        if h := self.histograms.get((relation, col)):
            below = h.estimate("<", domain.lo) if domain.lo is not None else 0.0
            above = h.estimate(">", domain.hi) if domain.hi is not None else 0.0
            return max(0.0, h.rows - below - above) / max(1, h.rows)
        s = self.column(relation, col)
        if s.min is None:
            return 0.0
        d = domain.meet(s.range)
        if d.empty:
            return 0.0
        if d.lo == d.hi:
            return 1.0 / max(1, s.distinct)
        return (d.hi - d.lo + 1) / (s.max - s.min + 1)
