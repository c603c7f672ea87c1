"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are made, one from toxic and one from ordinary text. A
window of text is compressed with each; where the toxic dictionary saves bytes that the ordinary one
doesn't, the window is like toxic text. How many windows save how much is turned into a probability
by a logistic calibration on labelled rows that the dictionaries have not seen.

What the dictionaries hold: the ordinary one is trained by zstandard on whole ordinary texts. Toxic
text is mostly ordinary too, and two dictionaries trained on whole texts of each kind differ by
chance far more than by what makes text toxic (held-out recall 0 to 12 %). So the toxic one is
the ordinary one and before it the starts of words that are evidence of toxic text, however many
there are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the fit gathers at most (twice as many rows, where ids repeat). Longer
#: texts than SAMPLE_CHARS are left out of the fit; they are scored like all others.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
#: Bytes of a window, and of the step to the next.
WINDOW, STEP = 96, 72
#: Bytes of ordinary text that both dictionaries end with.
COMMON = 32_768
#: Of so many labelled rows one is kept from the dictionaries, for the calibration.
KEPT_FROM = 4
#: Shorter matches than so many bytes aren't used: chance meetings.
LEAST_MATCH = 5
#: Least evidence of a word's start for the toxic dictionary, and least characters of a start.
EVIDENCE, LEAST_START = 15.0, 4
#: Savings, in bytes, that windows are counted by.
LEVELS = (1, 2, 3, 4, 6)
THRESHOLD = 0.7
LEVEL = 3
_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    bias: float


class Scorer:
    def __init__(self, model: Model) -> None:
        import zstandard as z

        log = max(12, len(model.toxic).bit_length())  # tables reach the whole dictionary
        params = z.ZstdCompressionParameters.from_level(LEVEL, window_log=log + 1, hash_log=log, chain_log=log, min_match=LEAST_MATCH, strategy=z.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)

        def make(content: bytes):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return z.ZstdCompressor(dict_data=d, compression_params=params)

        self.toxic, self.ordinary, self.model = make(model.toxic).compress, make(model.ordinary).compress, model

    def savings(self, text: str | None) -> list[int]:
        """For each window of the whole text: bytes that the toxic dictionary saves more."""
        raw = " ".join((text or "").lower().split()).encode("utf-8", "replace")
        toxic, ordinary = self.toxic, self.ordinary
        out = []
        for p in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP):
            w = b" " + raw[p : p + WINDOW]
            out.append(len(ordinary(w)) - len(toxic(w)))
        return out

    def vector(self, text: str | None, savings: list[int] | None = None) -> list[float]:
        s = np.array(savings if savings is not None else self.savings(text))
        top = np.sort(s)[-3:]
        return [*(float(np.log1p((s >= k).sum())) for k in LEVELS), max(-2.0, min(8.0, float(s.max()))) / 4, float(np.log1p(len(s))) / 4, float((s >= 2).mean()) * 10, float(top.mean())]

    def score(self, text: str | None, savings: list[int] | None = None) -> float:
        x = float(np.dot(self.model.weights, self.vector(text, savings)) + self.model.bias)
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, x)))))


def _train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's content; too few samples to train on give their own bytes."""
    import zstandard as z

    try:
        trained = z.train_dictionary(size + 512, samples, level=LEVEL).as_bytes()
        return trained[-size:]  # content stands behind the entropy tables
    except z.ZstdError:
        return b" ".join(samples)[:size]


def evidence(a: int, b: int, n1: int, n0: int) -> float:
    """The log-likelihood ratio of a share of a / n1 in toxic and b / n0 in ordinary text; 0 if it
    is not larger in toxic text."""
    p, q, both = a / n1, b / n0, (a + b) / (n1 + n0)
    if p <= q:
        return 0.0
    h = lambda k, n, x: k * np.log(max(x, 1e-12)) + (n - k) * np.log(max(1 - x, 1e-12))
    return float(2 * (h(a, n1, p) + h(b, n0, q) - h(a, n1, both) - h(b, n0, both)))


def starts(word: str) -> list[str]:
    """The word and its beginnings of LEAST_START characters or more."""
    return [word[:n] for n in range(min(LEAST_START, len(word)), len(word) + 1)]


def telling(toxic: list[list[str]], ordinary: list[list[str]]) -> list[str]:
    """Of each word of the toxic documents the start with most evidence, if that is EVIDENCE or
    more; weak ones first. Starts, as endings vary and would spread a stem's evidence thinly."""
    # by documents, and by the different contexts a word stands in, so that copies count once
    places = lambda docs: {(a, w, b) for d in docs for a, w, b in zip(["", *d], d, [*d[1:], ""])}
    places1, places0 = places(toxic), places(ordinary)
    in_documents = lambda docs: Counter(x for d in docs for x in {x for w in set(d) for x in starts(w)})
    in_places = lambda found: Counter(x for _, w, _ in found for x in starts(w))
    by_document = in_documents(toxic), in_documents(ordinary), max(1, len(toxic)), max(1, len(ordinary))
    by_place = in_places(places1), in_places(places0), max(1, len(places1)), max(1, len(places0))

    known = {x: min(evidence(*[n[x] for n in by_document[:2]], *by_document[2:]), evidence(*[n[x] for n in by_place[:2]], *by_place[2:])) for x, c in by_document[0].items() if c >= 3}
    best = {max((known.get(x, 0.0), len(x), x) for x in starts(w)) for w in {w for d in toxic for w in d}}
    return [x for e, _, x in sorted(best, key=lambda b: (b[0], b[2])) if e >= EVIDENCE]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Learns from (text, toxic): the dictionaries from three rows of KEPT_FROM, the calibration from
    the others. Both are learned from all rows if either part lacks a class."""
    held = [zlib.crc32(t.encode("utf-8", "replace")) % KEPT_FROM == 0 for t, _ in rows]
    learn, tell = [r for r, h in zip(rows, held) if not h], [r for r, h in zip(rows, held) if h]
    if any(len({y for _, y in part}) < 2 for part in (learn, tell)):
        learn = tell = rows
    toxic = [_WORDS(t.lower()) for t, y in learn if y]
    ordinary = [_WORDS(t.lower()) for t, y in learn if not y]
    own = "".join(f" {x}" for x in telling(toxic, ordinary)).encode()
    chunks = [x[i : i + 200].encode() for x in (" ".join(d) for d in ordinary) for i in range(0, len(x), 200)]
    trained = (_train(chunks, COMMON) if chunks else b"").rjust(COMMON)
    # of equal length, so that matches in the common part lie as far back with either; the ordinary
    # one is blank where the toxic one has its own part: other text there met windows by chance (on
    # 0.1 GB 23 false of 1,793 with its own bytes a second time, 46 with more ordinary ones, 2 blank)
    model = Model(own + trained, bytes(len(own)) + trained, np.zeros(len(LEVELS) + 4), 0.0)
    y = np.array([float(t) for _, t in tell])
    if not rows or y.min() == y.max():  # one class only: its share, the same for every text
        model.bias = 0.0 if not rows else 5.0 if y[0] else -5.0
        return model
    s = Scorer(model)
    x = np.array([s.vector(t) for t, _ in tell])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    x1 = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    for _ in range(40):  # Newton steps of the penalised logistic likelihood
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + 0.1 * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    model.weights = w[:-1] / spread
    model.bias = float(w[-1] - (w[:-1] * mean / spread).sum())
    return model


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most `rows` labelled rows, the classes in about equal numbers if there are enough, by a
    hash of their id. The ids are chosen first; only the chosen rows' texts are fetched."""
    known = labels.where("toxic is not null and doc_id is not null").where(remainder() != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id")
    ids = []
    for y in (0, 1):
        share = rows * 2 // 3 if y == 0 else rows // 3
        ids += [(r.doc_id, y) for r in known.where(F.col("toxic") == y).orderBy(key, "doc_id").limit(share).collect()]
    if not ids:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int"))
    got = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).join(chosen, "doc_id")
    return [(r.text, r.toxic) for r in got.orderBy("doc_id", "text").limit(2 * rows).collect()]


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_windows long, best_saving long"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """SCORED for every row, repeated ones too; an empty table gives none. Null and empty texts are one empty window and get the score that goes
    with it. Repeated ids in labels count as toxic if any says so; documents without a label are
    scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = [x.split()[0] for x in SCORED.split(", ")]
        for batch in batches:
            scores, windows, best = [], [], []
            for t in batch.column(2).to_pylist():
                s = scorer.savings(t)
                scores.append(scorer.score(t, s))
                windows.append(len(s))
                best.append(max(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(windows, pa.int64()), pa.array(best, pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder() == 1, F.lit(False)), F.col("text").cast("string")).mapInArrow(run, SCORED)


def op8(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
