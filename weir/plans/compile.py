"""QuerySpec to DataFrame.

Leaves project and filter (both reach the Parquet scan); a leaf may be aggregated on its join
columns first, so that a many-to-many join never enumerates its pairs; joins carry one equality
per class, which covers composite keys and cycles; one global aggregation ends the plan. Physical
strategy is Catalyst's and AQE's, unless a hint is asked for. A broadcast that is asked for is done
as far as counted rows fit; beyond, that join merges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.catalog import Catalog
from weir.functions.statistics import Statistics
from weir.functions.unsigned import U64, wrapped_product, wrapped_sum
from weir.plans.ordering import components, key_columns, order
from weir.spec import Interval, QuerySpec, Ref

STRATEGIES = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}
#: Rows per join key from which aggregating before the join pays.
EAGER_ROWS_PER_KEY = 4
#: What the hash tables of one query may take in the driver, and about what a row of them takes, besides each of its columns.
BROADCAST_BYTES, ROW_BYTES, COLUMN_BYTES = 32 << 20, 96, 24


class PlanError(ValueError):
    """The query has no plan under the options given."""


@dataclass
class Compiled:
    df: DataFrame
    spec: QuerySpec
    join_order: list[list[int]] = field(default_factory=list)
    aggregated: list[int] = field(default_factory=list)
    from_index: list[int] = field(default_factory=list)


def _bounds(c: Column, i: Interval, kind: str) -> Column | None:
    value = lambda v: F.lit(str(v)).cast(kind) if kind != "bigint" else F.lit(v)
    if kind == "bigint":  # constants beyond bigint: every value is below them
        if i.lo is not None and i.lo > (1 << 63) - 1:
            return F.lit(False)
        i = Interval(i.lo, None if i.hi is not None and i.hi > (1 << 63) - 1 else i.hi)
    if i.lo is not None and i.lo == i.hi:
        return c == value(i.lo)
    parts = ([c >= value(i.lo)] if i.lo is not None else []) + ([c <= value(i.hi)] if i.hi is not None else [])
    return reduce(lambda a, b: a & b, parts) if parts else None


class Compiler:
    def __init__(self, catalog: Catalog, stats: Statistics, rules: frozenset[str], strategy: str | None, allow_cross: bool) -> None:
        if strategy is not None and strategy not in STRATEGIES:
            raise PlanError(f"strategy is one of {', '.join(STRATEGIES)}")
        self.catalog, self.stats, self.rules, self.strategy, self.allow_cross = catalog, stats, rules, strategy, allow_cross
        self.room = BROADCAST_BYTES

    def _fits(self, df: DataFrame) -> bool:
        """df's rows, counted after its filters, fit what this query may still broadcast; they take their part of it."""
        self.stats.jobs += 1
        size = df.count() * (ROW_BYTES + COLUMN_BYTES * len(df.columns))
        if size > self.room:
            return False
        self.room -= size
        return True

    def compile(self, spec: QuerySpec) -> Compiled:
        for b in spec.bindings:
            r = self.catalog[spec.relations[b]]
            if wide := [x for x in spec.refs() if x.binding == b and x.col >= r.width]:
                raise PlanError(f"{wide[0]}: relation {r.id} has {r.width} columns")
        u64 = any(self.catalog[spec.relations[b]].u64 for b in spec.bindings)
        groups = components(spec)
        if len(groups) > 1 and not self.allow_cross:
            raise PlanError(f"the join graph falls into {len(groups)} parts; allow_cross=True multiplies them")
        out = Compiled(None, spec)
        wanted = list(dict.fromkeys(spec.outputs))
        parts = [self._component(spec, g, [o for o in wanted if o.binding in g], u64, len(groups) > 1, out) for g in groups]
        if len(parts) == 1:
            sums = {o: F.col(f"sum_{o.name}") for o in wanted}
            df = parts[0]
        else:  # each part is one row of sums and a count
            df = reduce(lambda a, b: a.crossJoin(b), parts)
            sums = {}
            for o in wanted:
                own = next(k for k, g in enumerate(groups) if o.binding in g)
                product = F.col(f"sum_{o.name}").cast("decimal(38,0)")
                empty = F.lit(False)
                for k in range(len(groups)):
                    if k != own:
                        product = product * F.col(f"rows_{k}").cast("decimal(19,0)")
                        empty = empty | (F.col(f"rows_{k}") == 0)
                value = (product % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast(U64) if u64 else product.cast("bigint")
                sums[o] = F.when(~empty, value)
        out.df = df.select(*[sums[o].alias(f"s{i}") for i, o in enumerate(spec.outputs)])
        return out

    def _leaf(self, spec: QuerySpec, b: int) -> DataFrame:
        r = self.catalog[spec.relations[b]]
        own = sorted({x for x in spec.refs() if x.binding == b})
        kind = "decimal(20,0)" if r.u64 else "bigint"
        filters = [(x, i) for x, i in spec.domains if x.binding == b]
        df = r.columns({x.col for x in own}, {x.col: i for x, i in filters}).select(*[F.col(f"c{x.col}").alias(x.name) for x in own])
        if "order" in self.rules and len(filters) > 1:
            filters.sort(key=lambda f: self.stats.fraction(r.id, f[0].col, f[1]))
        conditions = [c for x, i in filters if (c := _bounds(F.col(x.name), i, kind)) is not None]
        for members in spec.classes():  # equalities inside one row
            mine = [m for m in members if m.binding == b]
            conditions += [F.col(mine[0].name) == F.col(m.name) for m in mine[1:]]
        if spec.empty:
            conditions = [F.lit(False)]
        return df.where(reduce(lambda a, c: a & c, conditions)) if conditions else df

    def _worth_aggregating(self, spec: QuerySpec, b: int, keys: list[Ref]) -> bool:
        rel = spec.relations[b]
        if not keys or self.stats.rows(rel) == 0:
            return False
        if any(self.stats.column(rel, k.col).distinct >= 0.9 * self.stats.rows(rel) for k in keys):
            return False
        rows = float(self.stats.rows(rel))
        for x, domain in spec.domains:
            if x.binding == b:
                rows *= self.stats.fraction(rel, x.col, domain)
        groups = self.stats.group_count(rel, tuple(k.col for k in keys))
        return rows / max(1.0, min(groups, rows)) >= EAGER_ROWS_PER_KEY

    def _component(self, spec: QuerySpec, group: list[int], wanted: list[Ref], u64: bool, counted: bool, out: Compiled) -> DataFrame:
        index = len(out.join_order)
        if len(group) == 1:
            done = group
        else:
            done = order(spec, group, self.stats if "order" in self.rules and not spec.empty else None)
        out.join_order.append(done)
        eager: set[int] = set()
        if "eager" in self.rules and len(group) > 1 and not spec.empty:
            for b in group:
                if self._worth_aggregating(spec, b, [c[0] for c in key_columns(spec, b, set(group) - {b})]):
                    eager.add(b)
        out.aggregated += sorted(eager)
        # products of sums and counts stay within bigint where the final sum does, if no value is negative
        signed = eager and not u64 and any((self.stats.column(spec.relations[o.binding], o.col).min or 0) < 0 for o in wanted)
        kind = U64 if u64 else "decimal(38,0)" if signed else "bigint"

        def leaf(b: int) -> DataFrame:
            df = self._leaf(spec, b)
            if b not in eager:
                return df
            keys = [c[0].name for c in key_columns(spec, b, set(group) - {b})]
            own = {x for x in spec.refs() if x.binding == b}
            index = self.catalog[spec.relations[b]].aggregate
            if index and len(keys) == 1 and not any(x.binding == b for x, _ in spec.domains) and len({m for members in spec.classes() for m in members if m.binding == b}) == 1:
                key = next(x for x in own if x.name == keys[0])
                if key.col in index:
                    out.from_index.append(b)
                    parts = [F.col(f"sum_c{o.col}").cast(kind).alias(f"part_{o.name}") for o in wanted if o.binding == b and o.name not in keys]
                    return index[key.col].select(F.col(f"c{key.col}").alias(key.name), F.col("n").cast(kind).alias(f"n_{b}"), *parts)
            total = wrapped_sum if u64 else F.sum
            sums = [total(o.name).cast(kind).alias(f"part_{o.name}") for o in wanted if o.binding == b and o.name not in keys]
            return df.groupBy(*keys).agg(F.count(F.lit(1)).cast(kind).alias(f"n_{b}"), *sums)

        df, seen = leaf(done[0]), {done[0]}
        for b in done[1:]:
            right = leaf(b)
            strategy = self.strategy
            if strategy == "broadcast" and not self._fits(right):
                if len(seen) == 1 and self._fits(df):
                    df, strategy = df.hint(STRATEGIES[strategy]), None
                else:  # by the hint, as Catalyst may broadcast what is small only in its files
                    strategy = "merge"
            if strategy:
                right = right.hint(STRATEGIES[strategy])
            keys = key_columns(spec, b, seen)
            condition = reduce(lambda a, c: a & c, [F.col(own.name) == F.col(rest[0].name) for own, *rest in keys])
            df = df.join(right, condition, "inner")
            seen.add(b)

        def total(o: Ref) -> Column:
            value = F.col(o.name)
            if o.binding in eager and f"part_{o.name}" in df.columns:
                value, others = F.col(f"part_{o.name}"), eager - {o.binding}
            else:
                others = set(eager)
            for b in sorted(others):
                value = wrapped_product(value, F.col(f"n_{b}")) if u64 else value * F.col(f"n_{b}")
            return wrapped_sum(value) if u64 else F.sum(value).cast("bigint")

        aggs = [total(o).alias(f"sum_{o.name}") for o in wanted]
        if counted:
            aggs.append((F.sum(reduce(lambda a, c: a * c, [F.col(f"n_{b}").cast("decimal(38,0)") if u64 else F.col(f"n_{b}") for b in sorted(eager)])) if eager else F.count(F.lit(1))).cast("bigint").alias(f"rows_{index}"))
            df = df.agg(*aggs)
            return df.withColumn(f"rows_{index}", F.coalesce(f"rows_{index}", F.lit(0)))
        return df.agg(*aggs)
