"""Physical layouts that stand in for indexes: range-partitioned, sorted Parquet, and buckets.

Row-group minima and maxima then let a range or point filter skip nearly all of a sorted file, and
bucketed tables join without a shuffle.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a temporary one in
    local mode, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it names the folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weir-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/layout-{uuid.uuid4().hex}"


def write_sorted(df: DataFrame, path: str, column: str, partitions: int | None = None) -> None:
    """Parquet at `path`, ranged and sorted by `column`."""
    ranged = df.repartitionByRange(partitions, column) if partitions else df.repartitionByRange(column)
    ranged.sortWithinPartitions(column).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, column: str, buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by its join column: later joins on it need no exchange. Its files
    go to path, else to the warehouse."""
    writer = df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
