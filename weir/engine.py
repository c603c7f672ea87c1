"""The engine: register relations, ask single queries or batches."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.catalog import Catalog, Relation
from weir.dialect import format_row, parse
from weir.functions.histogram import Histogram
from weir.functions.statistics import ColumnStats, Statistics
from weir.functions.unsigned import wrapped_sum
from weir.plans.compile import Compiled, Compiler
from weir.plans.rewrite import RULES, rewrite
from weir.spec import QuerySpec


class Engine:
    """Answers select-join-sum queries over registered relations.

    rules: the rewrites in use (all by default), see weir.plans.rewrite.RULES and "eager"
    (aggregation before joins) and "order" (join order by statistics).
    """

    def __init__(self, spark: SparkSession, rules: Iterable[str] = RULES) -> None:
        self.spark = spark
        self.rules = frozenset(rules)
        if unknown := self.rules - set(RULES):
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        self.catalog = Catalog()
        self.statistics = Statistics(self.catalog)
        self._log: list[tuple[str, float, tuple[str, ...], bool, list, list]] = []

    # -- relations
    def register(self, df: DataFrame, columns: list[str] | None = None, **options) -> Relation:
        """See Catalog.register: id, name, u64 (unsigned sums modulo 2^64), not_null."""
        return self.catalog.register(df, columns, **options)

    def load(self, path: str, *, u64: bool = False, **options) -> Relation:
        """A relation from a file of the binary format (weir.sources.binary) or Parquet."""
        if path.rstrip("/").endswith(".parquet"):
            return self.register(self.spark.read.parquet(path), u64=u64, **options)
        from weir.sources.binary import read_relation

        top = (1 << 64) - 1

        def reader(columns: list[int], domains: dict) -> DataFrame:
            kind = "decimal(20,0)" if u64 else "bigint"
            bounds = {c: (i.lo, i.hi) for c, i in domains.items() if all(v is None or v <= top for v in (i.lo, i.hi)) and (i.hi is None or i.hi >= 0)}
            return read_relation(self.spark, path, columns=columns, bounds=bounds).select(*[F.col(f"c{c}").cast(kind).alias(f"c{c}") for c in columns])

        return self.register(read_relation(self.spark, path), u64=u64, not_null=True, reader=reader, **options)

    def build_aggregate_index(self, relation: int, col: int, path: str) -> None:
        """Writes the relation's rows and sums by one column; queries that aggregate it on this column
        before a join, without a filter on it, read them instead of the relation."""
        r = self.catalog[relation]
        total = wrapped_sum if r.u64 else (lambda c: F.sum(c).cast("bigint"))
        r.df.groupBy(f"c{col}").agg(F.count(F.lit(1)).alias("n"), *[total(F.col(f"c{i}")).alias(f"sum_c{i}") for i in range(r.width) if i != col]).write.mode("overwrite").parquet(path)
        r.aggregate[col] = self.spark.read.parquet(path)

    def build_histogram(self, relation: int, col: int, buckets: int = 50) -> Histogram:
        """Estimates of filters on this column come from its histogram from now on."""
        h = Histogram.of(self.catalog[relation].df, f"c{col}", buckets)
        self.statistics.histograms[relation, col] = h
        return h

    def declare_unique(self, relation: int, col: int) -> None:
        """States that a column is a key; no job will check it."""
        self.statistics.declare_unique(relation, col)

    def declare_foreign_key(self, fk: tuple[int, int], pk: tuple[int, int]) -> None:
        """States that each value of column fk occurs in the unique column pk."""
        self.statistics.declare_unique(*pk)
        self.statistics.declare_contained(fk, pk)

    def stats(self, relation: int, col: int) -> ColumnStats:
        return self.statistics.column(relation, col)

    # -- queries
    def compile(self, query: str | QuerySpec, *, strategy: str | None = None, allow_cross: bool = False, rules: Iterable[str] | None = None) -> Compiled:
        spec = parse(query) if isinstance(query, str) else query
        use = self.rules if rules is None else frozenset(rules)
        compiler = Compiler(self.catalog, self.statistics, use, strategy, allow_cross)
        for b in spec.bindings:  # ids and columns are checked before statistics are asked for
            r = self.catalog[spec.relations[b]]
            if wide := [x for x in spec.refs() if x.binding == b and x.col >= r.width]:
                raise ValueError(f"{wide[0]}: relation {r.id} has {r.width} columns")
        return compiler.compile(rewrite(spec, self.catalog, self.statistics, use))

    def query(self, query: str | QuerySpec, **options) -> DataFrame:
        """One row of sums s0..sn; null where no row qualifies. Options as in compile()."""
        return self.compile(query, **options).df

    def run_batch(self, lines: Iterable[str], *, parallel: int = 8, **options) -> list[str]:
        """Answers in the order of the queries; their jobs run side by side."""
        lines = [x.strip() for x in lines if x.strip()]

        def one(line: str) -> str:
            began = time.perf_counter()
            compiled = self.compile(line, **options)
            answer = format_row(compiled.df.first())
            self._log.append((line, time.perf_counter() - began, tuple(compiled.spec.trace), compiled.spec.empty, compiled.join_order, compiled.aggregated))
            return answer

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            return list(pool.map(one, lines))

    # -- insight
    def explain(self, query: str | QuerySpec, **options) -> str:
        """The rewrites taken, the join order, and Spark's plan."""
        c = self.compile(query, **options)
        plan = c.df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        head = [*c.spec.trace, f"join order: {c.join_order}", f"aggregated first: {c.aggregated}"]
        return "\n".join(head) + "\n" + plan

    def report(self, slowest: int = 4) -> str:
        """Counts over the batches so far and the slowest queries with their rewrites."""
        log = sorted(self._log, key=lambda x: -x[1])
        out = [f"queries {len(log)}, statistics jobs {self.statistics.jobs}, seconds {sum(x[1] for x in log):.3f}"]
        out.append(f"empty by contradiction {sum(x[3] for x in log)}, joins eliminated {sum(t.startswith('eliminate') for x in log for t in x[2])}, aggregated first {sum(bool(x[5]) for x in log)}")
        out += [f"{s:.3f} s {line}: order {order}; {'; '.join(trace) or 'as it is'}" for line, s, trace, _, order, _ in log[:slowest]]
        return "\n".join(out)
