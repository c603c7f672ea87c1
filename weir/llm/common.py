"""Shared folder, written tables, what worker processes keep, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is
    made and set in local mode; on a cluster that is an error, as executors would not see it."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it names the folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weir-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    drop() removes those that later steps don't read. What a returned DataFrame reads stays
    until the cluster clears the folder.
    """

    #: Rows that a file of a table of narrow, counted rows holds at least, where there are so many.
    ROWS_A_FILE = 100_000

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{shared_folder(spark)}/weir-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.base}/{self.count:03d}"
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
        return path

    def table(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def narrow(self, df: DataFrame, rows: int) -> DataFrame:
        """table() of a few numbers a row and about so many rows, in no more files than they are worth."""
        return self.table(df.coalesce(1 + rows // self.ROWS_A_FILE))

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            for root in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                if root.find(self.base.split("://")[-1]) >= 0:
                    path = jvm.org.apache.hadoop.fs.Path(root)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that a worker process keeps of what it has computed, about.
CACHE_BYTES = 48 << 20

_kept: tuple[object, object] = (None, None)


def kept(owner: object, make: Callable[[], object]) -> object:
    """The one large object that a worker process keeps between tasks. Where another owner asks,
    the former's goes first, so an executor that runs one operator after another holds one."""
    global _kept
    if _kept[0] != owner:
        _kept = (None, None)
        release()
        _kept = (owner, make())
    return _kept[1]


def release() -> None:
    """Gives freed memory of this process back to the system, as far as it can be."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A table with at most so many rows and bytes may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20


def small(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """The broadcast hint, if the counted rows are few enough. size: their bytes, to be counted
    too where rows have no fixed width."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of links (a, b), ids of any one orderable type: id, component, the
    smallest id reachable. Only linked ids appear.

    Labels take the minimum over neighbours, then jump to their label's label, until none
    changes; each round is written to the shared folder. A hub's links are minimised before the
    shuffle; the joins on hot labels are split by adaptive execution.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct())
    rows = both.count()
    labels = scratch.narrow(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), rows)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jumped = lowered.join(labels.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component"))
        new = scratch.narrow(jumped, rows)
        changed = not new.where("old <> component").limit(1).isEmpty()
        scratch.drop(labels)
        labels = new.select("id", "component")
        if not changed:
            scratch.drop(both)
            return labels
