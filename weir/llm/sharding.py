"""Rendezvous hashing of record keys over weighted shards.

Each shard draws a score from the key; the highest takes the record. A new shard can only win
records for itself, a removed one only gives its own away. Scores are -weight / ln(u), u uniform
from the key and the shard, so shares follow the weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import Scratch

SHARDS = 40
OVERHEAD_BYTES = 16
#: Rows a range of the numbering holds, about.
ROWS_PER_RANGE = 2_000_000


def _scores(key: Column, weights: Sequence[float]) -> Column:
    """A (score, -shard) for each shard; the greatest is the winner, the lower shard at a tie."""
    base = F.xxhash64(key)
    entries = []
    for i, w in enumerate(weights):
        # 52 bits, strictly between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(base, F.lit(i)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        entries.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-i).alias("shard")))
    return F.greatest(*entries) if len(entries) > 1 else entries[0]


def assign(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """df with the shard of each record. A null key is a key like another."""
    return df.withColumn(name, (-_scores(F.coalesce(F.col(key).cast("string"), F.lit("\0null")), weights)["shard"]).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is `key`: doc_id and the shard count decide. grown_shard is the shard with one more of
    mean weight. slot numbers a shard's records from 0 by doc_id, then checksum; rows that are
    alike in both take adjoining slots. Null texts have size 16 and the checksum of no bytes.

    Records are ranged by (shard, doc_id, checksum, row), so one key with many rows still spreads
    over ranges; each range numbers its rows as it writes them, and a range's first slots follow
    from the counts of the ranges before (a row a range and shard).
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("a weight for each shard")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    more = _scores(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")), [*weights, sum(weights) / shards])
    scratch = Scratch(spark)
    rows = scratch.table(assign(rows, "doc_id", weights).withColumn("grown_shard", (-more["shard"]).cast("int")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE))
    order = ["shard", "doc_id", "text_crc32", "row"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, last, at = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            shard = b.column(b.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
            if not len(shard):
                continue
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            slot = np.arange(len(shard)) - np.repeat(starts, np.diff(np.r_[starts, len(shard)]))
            head = len(shard) if len(starts) == 1 else starts[1]
            if shard[0] == last:
                slot[:head] += at
            last, at = shard[-1], slot[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot, pa.int64()), pa.array(np.full(len(shard), part, "int32"))], names=[*b.schema.names, "local_slot", "part"])

    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("row")
    numbered = scratch.table(ranged.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, local_slot long, part int"))
    before, firsts = {}, []
    for r in numbered.groupBy("shard", "part").agg((F.max("local_slot") + 1).alias("n")).orderBy("shard", "part").toLocalIterator():  # at most ranges + shards rows
        firsts.append((r.shard, r.part, before.get(r.shard, 0)))
        before[r.shard] = before.get(r.shard, 0) + r.n
    scratch.drop(rows)
    first = F.broadcast(spark.createDataFrame(firsts, "shard int, part int, first long"))
    return numbered.join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("local_slot")).alias("slot"), "grown_shard")


def op4(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
