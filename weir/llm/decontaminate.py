"""Benchmark decontamination by pigeonhole edit matching.

Text and items are words. An item of m words may differ by k = floor(0.2 m) word edits, so of
its k + 1 pieces one stands in the text exactly. Pieces are looked up at every word of a
document; each hit fixes where the item would lie, and Myers' bit-parallel edit distance on words
verifies the place. All documents are searched, whole. Items are the stated queries: they go to
the workers in blocks of bounded size, a pass for each block, so any number of items works.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's words that edits may touch.
ERRORS = 0.2
#: Characters of item text in one block.
BLOCK_CHARS = 8_000_000
_WORDS = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


class Pieces:
    """An index of the items' pieces by the pair of words they begin with (or their one word)."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS) -> None:
        self.vocabulary: dict[str, int] = {}
        by_text: dict[tuple[str, ...], list[int]] = {}
        for i, t in items:
            if w := tuple(words(t)):  # an item without words matches nothing
                by_text.setdefault(w, []).append(i)
        self.ids, self.items, self.budget, self.masks = [], [], [], []
        self.by_first: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
        for w, ids in by_text.items():
            word_ids = tuple(self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w)
            n, k = len(self.items), int(errors * len(w))
            self.ids.append(sorted(ids))
            self.items.append(word_ids)
            self.budget.append(k)
            mask: dict[int, int] = {}
            for p, x in enumerate(word_ids):
                mask[x] = mask.get(x, 0) | 1 << p
            self.masks.append(mask)
            cuts = [len(w) * j // (k + 1) for j in range(k + 2)]
            for s, e in zip(cuts, cuts[1:]):
                piece = word_ids[s:e]
                self.by_first.setdefault(self._code(piece), []).append((n, s, piece))

    def _code(self, piece: tuple[int, ...]) -> int:
        """Pieces of two words and more are keyed by the first two, others by minus their word."""
        return piece[0] << 32 | piece[1] if len(piece) > 1 else -1 - piece[0]

    def prepare(self):
        import numpy as np

        self.codes = np.array(sorted(self.by_first), dtype="int64")
        self.known = self.vocabulary.get
        return self

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, end word): the best place of each item within budget."""
        import numpy as np

        tokens = words(text)
        if not tokens or not len(self.codes):
            return []
        ids = np.array([*map(self.known, tokens, [-1] * len(tokens))], dtype="int64")
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | ids[1:], np.int64(1) << 62)
        hits = list(self._present(pair)) + list(self._present(np.where(ids >= 0, -1 - ids, np.int64(1) << 62)) if self.codes[0] < 0 else ())
        places: dict[int, set[int]] = {}
        for at, code in hits:
            for item, start, piece in self.by_first[code]:
                if at + len(piece) <= len(ids) and tuple(ids[at : at + len(piece)]) == piece:
                    places.setdefault(item, set()).add(at - start)
        out = []
        for item, starts in sorted(places.items()):
            if best := self._verify(item, starts, ids):
                out.append((item, *best))
        return out

    def _present(self, codes) -> Iterator[tuple[int, int]]:
        import numpy as np

        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        for p in np.flatnonzero(self.codes[at] == codes).tolist():
            yield p, int(codes[p])

    def _verify(self, item: int, starts: set[int], ids) -> tuple[int, int, int] | None:
        """The least distance over the windows about the given starts; the earliest at a tie."""
        m, k = len(self.items[item]), self.budget[item]
        windows: list[list[int]] = []
        for s in sorted(starts):  # a true place begins within k words of the one that a hit gives
            lo, hi = max(0, s - k), min(len(ids), s + m + k)
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], hi)
            else:
                windows.append([lo, hi])
        best = None
        for lo, hi in windows:
            d, end = myers(self.masks[item], m, ids[lo:hi].tolist())
            if d <= k and (best is None or d < best[0]):
                # the start: match the reversed item against the reversed text before the end
                back = {x: int(f"{v:0{m}b}"[::-1], 2) for x, v in self.masks[item].items()}
                d2, length = myers(back, m, ids[lo : lo + end][::-1].tolist(), anchored=True)
                best = d, lo + end - length, lo + end
        return best


def myers(mask: dict[int, int], m: int, text: list[int], anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of an m-word pattern to any piece of the text that ends at a word
    (with anchored: to any prefix), and that first end. mask: the pattern's positions by word."""
    every, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = every, 0, m
    best, end = m, 0
    for j, x in enumerate(text, 1):
        eq = mask.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & every, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | anchored) & every, mh << 1 & every
        pv, mv = mh | ~(xv | ph) & every, ph & xv
        if score < best:
            best, end = score, j
    return best, end


FOUND = "doc_id long, item_id long, distance int, item_words int, similarity double, start_word int, end_word int"


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        held += len(r.text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """FOUND: a row for each document and item that it contains within the budget, with the best
    place by words. Null and empty texts and items match nothing; repeated items (by id or by
    text) each give their row; a document row that is repeated gives its rows again."""
    spark = docs.sparkSession
    out = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Pieces(block, errors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value.prepare()
            names = [x.split()[0] for x in FOUND.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    for item, d, s, e in index.find(batch.column(1)[i].as_py()):
                        m = len(index.items[item])
                        rows += [(batch.column(0)[i].as_py(), item_id, d, m, 1 - d / m, s, e) for item_id in index.ids[item]]
                cols = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """docs without the documents that contain an item; columns as they were. Rows with a null
    doc_id can't be told apart by id and are judged by their own text as all others are."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index("text")

    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Pieces(block, errors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value.prepare()
            for batch in batches:
                keep = pa.array([not index.find(batch.column(at)[i].as_py()) for i in range(batch.num_rows)], pa.bool_())
                yield batch.filter(keep)

        docs = docs.mapInArrow(run, schema)
    return docs


def op5(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
