"""Concatenate and cut: token sequences of fixed length without padding but in the last.

Pass 1 tokenises, and numbers the tokens of each partition as it goes; the table it writes has
each document's ids and its offset inside its partition. Partition totals (a row a partition)
are summed up to partition offsets. Pass 2 adds them and cuts at multiples of the length. No
text, no ids are ever shuffled.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import CACHE_BYTES, Scratch, kept

LENGTH = 1024
#: Bytes that a kept piece costs besides its letters, about.
PIECE_BYTES = 220
BATCH_BYTES = 4 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Text to little-endian 32-bit ids, as the tokenizer gives them for the whole text.

    The byte-level pattern never joins what stands before a space with what follows it, if the
    next character isn't white space; nor across a line break between two other characters. So a
    text is cut there, and the ids of each piece are kept. New pieces go through the same merges
    in a faster implementation, built from the tokenizer's own vocabulary; texts with adjoining
    white space or special tokens go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(special)
        self.first: dict[str, bytes] = {}  # the start of a text
        self.later: dict[str, bytes] = {}  # what a space leads, without it; "\nx" for the start of a line
        self.held = 0
        self.double = re.compile(r"\s\s").search

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.fast.encode_ordinary(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        if not text or self.double(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *later = text.replace("\n", " \n").split(" ")
        if self.held > CACHE_BYTES:
            self.first.clear()
            self.later.clear()
            self.held = 0
        known = self.later
        ids = list(map(known.get, later))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    w = later[i]
                    if w not in known:
                        known[w] = self._piece(w if w[:1] == "\n" else " " + w)
                        self.held += PIECE_BYTES + len(w)
                    ids[i] = known[w]
        if (head := self.first.get(first)) is None:
            head = self.first[first] = self._piece(first)
            self.held += PIECE_BYTES + len(first)
        return head + b"".join(ids)


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return kept(("encoder", path), lambda: Encoder(path))


def tokenise(docs: DataFrame, path: str | None = None) -> DataFrame:
    """part, doc_id, local_start, ids: each document's ids with id 0 after them, and the number
    of ids before it in its partition. A null text is an empty one."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("ids", pa.binary())])

        def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            held, start = 0, 0
            for i in range(batch.num_rows):
                held += len(batch.column(1)[i].as_py() or "")
                if held >= BATCH_BYTES:
                    yield batch.slice(start, i + 1 - start)
                    held, start = 0, i + 1
            if start < batch.num_rows:
                yield batch.slice(start)

        for batch in itertools.chain.from_iterable(map(pieces, batches)):
            ids = [enc.text(t or "") + b"\0\0\0\0" for t in batch.column(1).to_pylist()]
            starts = []
            for x in ids:
                starts.append(at)
                at += len(x) // 4
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part int, doc_id long, local_start long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continued boolean, continues boolean"


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence (PIECES; ids too if asked for).

    continued and continues mark pieces that a window boundary parts from the one before or
    after in the same document. Every sequence but the last is full. Equal rows are packed as often as
    they occur; an empty text has its closing id alone; an empty table gives no piece.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tokens = scratch.table(tokenise(docs, path))
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.length("ids") / 4).cast("long").alias("n"))
    offsets, at = {}, 0
    for r in totals.orderBy("part").toLocalIterator():  # a row a partition
        offsets[r.part] = at
        at += r.n
    shared = spark.sparkContext.broadcast(offsets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()] * with_ids
        base = shared.value
        for batch in batches:
            rows = []
            for part, doc, local, raw in zip(*(c.to_pylist() for c in batch.columns)):
                n, begin, p, view = len(raw) // 4, base[part] + local, 0, memoryview(raw)
                while p < n:
                    sequence, offset = divmod(begin + p, length)
                    k = min(n - p, length - offset)
                    ids = view[4 * p : 4 * (p + k)]
                    rows.append((doc, p, k, zlib.crc32(ids), n, sequence, offset, p > 0, p + k < n, *((bytes(ids),) if with_ids else ())))
                    p += k
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names + ["ids"] * with_ids)

    return tokens.select("part", "doc_id", "local_start", "ids").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
