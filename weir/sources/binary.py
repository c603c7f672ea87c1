"""Column-major binary relations as a Spark data source.

Layout, little-endian unsigned 64-bit words: rows, columns, then each column's values in turn.
A file is cut into row ranges; a task reads its range of just the columns that the schema names, and of
rows within bounds on columns, if told. Paths must
be readable by the executors as files (a shared file system).
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DecimalType, StructField, StructType

HEADER_BYTES = 16
#: Rows a task reads at most by default: 64 MB for 8 columns.
ROWS_PER_TASK = 1 << 20
ROWS_PER_BATCH = 1 << 16


def _header(path: str) -> tuple[int, int]:
    import numpy as np

    rows, cols = (int(x) for x in np.fromfile(path, dtype="<u8", count=2))
    size = os.path.getsize(path)
    if size < HEADER_BYTES + 8 * rows * cols:
        raise ValueError(f"{path}: {rows} x {cols} values don't fit in {size} bytes")
    return rows, cols


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class BinaryRelation(DataSource):
    """format("weir_binary"), options path, rowsPerTask and bounds (JSON: column to [lo, hi], null open)."""

    @classmethod
    def name(cls) -> str:
        return "weir_binary"

    def schema(self) -> StructType:
        _, cols = _header(self.options["path"])
        return StructType([StructField(f"c{i}", DecimalType(20, 0), False) for i in range(cols)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rowsPerTask", ROWS_PER_TASK)), [int(f.name[1:]) for f in schema.fields], json.loads(self.options.get("bounds", "{}")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, step: int, columns: list[int], bounds: dict[str, list]) -> None:
        self.path, self.step, self.columns, self.bounds = path, max(1, step), columns, bounds

    def partitions(self):
        rows, _ = _header(self.path)
        return [_Range(s, min(rows, s + self.step)) for s in range(0, rows, self.step)] or [_Range(0, 0)]

    def read(self, part: _Range):
        import numpy as np
        import pyarrow as pa

        rows, cols = _header(self.path)
        if part.end <= part.start:
            return
        values = np.memmap(self.path, dtype="<u8", mode="r", offset=HEADER_BYTES, shape=(cols, rows))
        for s in range(part.start, part.end, ROWS_PER_BATCH):
            e = min(part.end, s + ROWS_PER_BATCH)
            arrays, keep = [], None
            for c, (lo, hi) in self.bounds.items():
                v = values[int(c), s:e]
                for hit in ([v >= np.uint64(max(0, lo))] if lo is not None else []) + ([v <= np.uint64(max(0, hi))] if hi is not None else []):
                    keep = hit if keep is None else keep & hit
            n = e - s if keep is None else int(keep.sum())
            if not n:
                continue
            for c in self.columns:
                low = np.zeros((n, 2), dtype="<u8")  # decimal128: low word, high word
                low[:, 0] = values[c, s:e] if keep is None else values[c, s:e][keep]
                arrays.append(pa.Array.from_buffers(pa.decimal128(20, 0), n, [None, pa.py_buffer(low.tobytes())]))
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{c}" for c in self.columns])


def read_relation(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK, columns: list[int] | None = None, bounds: dict[int, tuple] | None = None) -> DataFrame:
    """Columns c0..cn of a binary relation (or those named), decimal(20,0), and rows within bounds:
    (lowest, highest) by column, None where open."""
    spark.dataSource.register(BinaryRelation)
    reader = spark.read.format("weir_binary").option("path", path).option("rowsPerTask", str(rows_per_task)).option("bounds", json.dumps(bounds or {}))
    if columns is not None:
        reader = reader.schema(StructType([StructField(f"c{i}", DecimalType(20, 0), False) for i in columns]))
    return reader.load()


def write_relation(path: str, columns: list) -> None:
    """Writes equally long columns of unsigned integers in the binary layout."""
    import numpy as np

    arrays = [np.asarray(c, dtype="<u8") for c in columns]
    with open(path, "wb") as f:
        f.write(np.array([len(arrays[0]) if arrays else 0, len(arrays)], dtype="<u8").tobytes())
        for a in arrays:
            f.write(a.tobytes())
