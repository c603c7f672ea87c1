"""Media columns of MPEG audio.

store() writes text as a binary media column; probe() parses any binary column of MPEG audio
into its features. Both are narrow (no shuffle), a row at a time inside Arrow batches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Output is passed on in batches of about so many bytes.
BATCH_BYTES = 8 << 20


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with spaces up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as an MPEG stream that carries it.

    A null text counts as empty and gives one unit of spaces. Equal texts give equal streams;
    repeated rows stay. Other columns aren't read.
    """
    from weir.llm import mpeg

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            ids, ns, media, held = [], [], [], 0
            for i in range(batch.num_rows):
                n, payload = payload_of(batch.column(1)[i].as_py())
                ids.append(batch.column(0)[i].as_py())
                ns.append(n)
                media.append(mpeg.encode(payload))
                held += len(media[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(media, pa.binary())], schema=schema)
                    ids, ns, media, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames long, samples long, sample_rate int, duration_num long, duration_den long, vbr boolean, table_kind string, "
    "crc_ok long, crc_bad long, junk_bytes long, resyncs int, truncated boolean, seek_every int, seek_offsets array<long>, "
    "table_frames long, table_bytes long, table_agrees boolean, table_points array<long>, delay int, padding int, tags map<string,string>"
)


def features(media: bytes | None, seek_every: int = 64) -> tuple:
    """The values of FEATURES for one stream; null counts as empty. Never raises on junk."""
    from weir.llm import mpeg

    data = media or b""
    s = mpeg.scan(data, seek_every)
    payload = mpeg.decode(data, s) if s["tags"].get("TXXX:payload_bytes", "").isdigit() else b""
    d = s["duration"]
    table = s["table"] or {}
    kind = table.get("kind")
    text = f"mp{s['frames'][0][1].layer if s['frames'] else 0}/{s['rate']}Hz/{'vbr' if s['vbr'] else 'cbr'}/{len(s['frames'])}f/{d.numerator}:{d.denominator}s/crc{s['crc_ok']}-{s['crc_bad']}/{kind or 'none'}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), text,
        len(s["frames"]), s["samples"], s["rate"], d.numerator, d.denominator, s["vbr"], kind, s["crc_ok"], s["crc_bad"], s["junk"], s["resyncs"], s["truncated"], seek_every, s["seek"],
        *[table.get(x) for x in ("frames", "bytes", "agrees", "points")], table.get("delay", 0), table.get("padding", 0), list(s["tags"].items()),
    )


def probe(df: DataFrame, media: str = "media", seek_every: int = 64) -> DataFrame:
    """df's other columns and FEATURES of its media column: duration as an exact fraction,
    seek offsets of every seek_every-th frame (1: of all), checksum verdicts, junk passed over, tags, and
    what the variable-bitrate table tells.

    Null media counts as empty and has no frames. The media column and columns of df that are named
    like one of FEATURES (in any case) are left out. Repeated rows stay; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = [x.split()[0] for x in FEATURES.split(", ")]
    rest = [c for c in df.columns if c != media and c.lower() not in names]
    out = StructType([df.schema[c] for c in rest] + StructType.fromDDL(FEATURES).fields)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py(), seek_every) for x in batch.column(batch.num_columns - 1)]
            cols = list(zip(*rows)) or [()] * len(names)
            arrays = [batch.column(i).cast(schema.field(i).type) for i in range(len(rest))]
            arrays += [pa.array(list(c), schema.field(len(rest) + i).type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.select(*[f"`{c}`" for c in rest], f"`{media}`").mapInArrow(run, out)


def op1(spark, sf_dir: str) -> DataFrame:
    return probe(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
