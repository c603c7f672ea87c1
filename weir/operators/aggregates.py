"""Aggregations over one relation, and the containment test of two columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sums(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, n (rows), sum_<column>: the pre-aggregate that joins on `key` can use instead of
    the rows. Partial sums are combined before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("bigint").alias(f"sum_{c}") for c in columns])


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, min_value, max_value, rows: a row a column, all from one scan."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[f(c).cast("bigint").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"min_{c}").alias("min_value"), F.col(f"max_{c}").alias("max_value")) for c in columns])
    return one.select("rows", F.explode(entries).alias("e")).select("e.col", "e.min_value", "e.max_value", "rows")


def unique_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, is_unique (1 or 0): whether a column's values are all different, none null.

    Each column is counted by its own two-level aggregation; a distinct count over several
    columns in one go would multiply the rows instead.
    """
    each = [
        df.groupBy(F.col(c).alias("v")).count().agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("once"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"))
        .select(F.lit(c).alias("col"), (F.col("once") & (F.col("nulls") == 0)).cast("int").alias("is_unique"))
        for c in columns
    ]
    return reduce(DataFrame.unionByName, each)


def foreign_key_orphans(fk: DataFrame, fk_col: str, pk: DataFrame, pk_col: str) -> DataFrame:
    """orphans: distinct non-null values of fk_col that pk_col lacks. Zero: a foreign key."""
    left = fk.select(F.col(fk_col).alias("v")).where("v is not null").distinct()
    return left.join(pk.select(F.col(pk_col).alias("v")), "v", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
