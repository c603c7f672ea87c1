"""Equi-depth histograms: bucket bounds by rank, and selectivity estimates from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, buckets: int = 50) -> DataFrame:
    """bucket, lo, hi, rows: value ranges of about equally many rows, in order.

    Bounds come from a mergeable quantile sketch, so no sort and no single-task window is
    needed; rows are then counted exactly by one map-side combined aggregation. A value lies in
    one bucket only. Nulls are left out; an empty input gives no buckets.
    """
    bounds = df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()["q"] if buckets > 1 else []
    inner = sorted({int(b) for b in bounds or []})
    bucket = F.lit(0)
    if inner:
        bucket = F.size(F.filter(F.array(*[F.lit(b) for b in inner]), lambda b: b < F.col(column)))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(bucket.cast("int").alias("bucket"))
        .agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("rows"))
    )


@dataclass(frozen=True)
class Histogram:
    """Collected buckets (their number is a parameter) for estimates on the driver."""

    buckets: tuple[tuple[int, int, int], ...]  # lo, hi, rows

    @staticmethod
    def of(df: DataFrame, column: str, buckets: int = 50) -> Histogram:
        rows = histogram(df, column, buckets).orderBy("bucket").collect()
        return Histogram(tuple((int(r.lo), int(r.hi), r.rows) for r in rows))

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.buckets)

    def estimate(self, op: str, value: int) -> float:
        """Rows for which `column op value` holds, values spread evenly inside a bucket."""
        total = 0.0
        for lo, hi, n in self.buckets:
            width = hi - lo + 1
            below = min(max(value - lo, 0), width)
            equal = 1 if lo <= value <= hi else 0
            total += n * {"<": below, "=": equal, ">": width - below - equal}[op] / width
        return total

    def thresholds(self) -> list[int]:
        """Upper bounds of the buckets: split points of equal depth."""
        return [hi for _, hi, _ in self.buckets]
