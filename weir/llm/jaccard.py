"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles as 64-bit hashes. Two sets of similarity t
share a token among their first n - ceil(t n) + 1 in any one order of all tokens (a prefix), and
l tokens among l - 1 more. The plan:

1. Each task writes every document's set digest and, once for each digest, the prefix in hash
   order. Equal sets are one entity from here on.
2. Tokens are counted (combined before the shuffle); entities that share none are done.
3. For the rest a common order is fixed: rare tokens by hash, then frequent ones by count. A
   prefix so passes over frequent tokens and grows past them; where it still holds frequent
   tokens, its candidates are costly, so it is lengthened and as many more shared tokens are asked
   for before a pair is verified.
4. Links first go to one pivot an entity (linear), components are formed, and only pairs that
   may still join two components are looked at. Tokens of few open entities give all their pairs. The
   entities of the others are dealt in blocks, and blocks that share such tokens are compared inside a
   task by bitmaps of the whole sets, whose differing bits never outnumber the differing tokens; only
   pairs that may be links leave it. No link between components is lost: both steps are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import Scratch, components, fresh, small

WORDS = 5
PERCENT = 80
#: A token in more entities counts as frequent, and in more than this share of all prefix tokens
#: over FREQUENT_MOST, so that there are at most FREQUENT_MOST of them.
FREQUENT, FREQUENT_MOST = 8, 500_000
#: Entities met by a prefix whose doubling, again and again, lengthens it by one more token.
COST_STEP = 4 * FREQUENT
PIVOT_ROUNDS = 2
#: A token of more open entities doesn't give its pairs; its entities are compared in blocks.
LIGHT, BLOCK = 32, 512
BATCH_BYTES = 4 << 20

_powers = np.ones(1, "uint64")
_inverses = np.ones(1, "uint64")
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8")
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _powers_to(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << n.bit_length()
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, "uint64")])
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(_BASE, -1, 1 << 64), "uint64")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole where there are fewer words;
    none without words. A-Z count as a-z; words are parted by space and bytes 9 to 13."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), "uint8")  # bytes.lower() is ASCII only
    if not len(raw):
        return np.empty(0, "uint64")
    _powers_to(len(raw) + 1)
    word = ~_SPACE[raw]
    edge = np.diff(np.r_[False, word, False].astype("int8"))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, "uint64")
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_TABLE[raw] * _powers[: len(raw)])]
        h = _mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype("uint64"))
        n = min(WORDS, len(h))
        g = np.full(len(h) - n + 1, n, "uint64")
        for i in range(n):
            g = _mix(g * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return np.unique(g)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts by their low bits; 2 to 4 bits a token, 2,048 to 65,536."""
    size = min(1 << 16, max(1 << 11, 1 << (2 * len(tokens) - 1).bit_length()))
    return np.packbits((np.bincount((tokens & np.uint64(size - 1)).astype("int64"), minlength=size) & 1).astype("uint8"), bitorder="little").tobytes()


def folded(raw: bytes, words: int) -> np.ndarray:
    """A bitmap brought to fewer 64-bit words: halves are added up until it has so many."""
    x = np.frombuffer(raw, "<u8")
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def need(n: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of n has with a set it links to."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def digests(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, digest, n, prefix: a row for each row; the prefix once a task and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])
        seen: set[bytes] = set()
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                s = shingles(batch.column(1)[i].as_py())
                digest = hashlib.md5(s.tobytes()).digest() if len(s) else None
                prefix = None
                if digest is not None and digest not in seen:
                    if len(seen) < 2_000_000:  # beyond, a digest's prefix may be written again, which is harmless
                        seen.add(digest)
                    prefix = s[: len(s) - need(len(s), percent) + 1].view("int64")
                    held += len(prefix) * 8
                rows.append((batch.column(0)[i].as_py(), digest, len(s), prefix))
                if held > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary, n long, prefix array<long>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _sets(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """id, n, tokens (bytes) of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                s = shingles(batch.column(1)[i].as_py())
                if len(s):
                    rows.append((batch.column(0)[i].as_py(), len(s), s.tobytes()))
                    held += 8 * len(s)
                if held > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    return _chosen(docs, ids, count).mapInArrow(run, "id long, n long, tokens binary")


def _index(docs: DataFrame, ids: DataFrame, count: int, frequent, percent: int) -> DataFrame:
    """id, n, m, l, prefix, bits: the adaptive prefix of each document named, its length m, l, and
    the bitmap of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = frequent.value
        schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("l", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                s = shingles(batch.column(1)[i].as_py()).view("int64")
                if not len(s):
                    continue
                base = len(s) - need(len(s), percent) + 1
                common = np.zeros(len(s), "int64")
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    hit = tokens[at] == s
                    common[hit] = counts[at[hit]]
                order = np.lexsort((s.view("uint64"), common))
                more = min((int(common[order[:base]].sum()) // COST_STEP).bit_length(), len(s) - base)
                rows.append((batch.column(0)[i].as_py(), len(s), base + more, 1 + more, s[order[: base + more]], bitmap(s.view("uint64"))))
                held += 8 * (base + more)
                if held > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    return _chosen(docs, ids, count).mapInArrow(run, "id long, n int, m int, l int, prefix array<long>, bits binary")


def _chosen(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """doc_id and text of the documents named; the list is sent if it is small, else joined."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(small(ids.withColumnRenamed("id", "doc_id"), count), "doc_id", "left_semi")


def _verify(docs: DataFrame, pairs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The links among pairs (a, b), by whole sets. A hot side of the join is split by adaptive
    execution."""
    ids = scratch.table(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = scratch.table(_sets(docs, ids, ids.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = [linked(np.frombuffer(x[i].as_py(), "uint64"), np.frombuffer(y[i].as_py(), "uint64"), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([a, b], schema=schema).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    links = scratch.table(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct())
    scratch.drop(ids, sets)
    return links


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Rows whose sets are equal and not empty are linked. Null and empty texts have no
    shingles and are alone. A row without doc_id keeps null as its component and links nothing.
    Rows with one doc_id are one node with several sets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.table(digests(docs, percent))
    # equal sets: the smallest doc_id stands for them
    named = signed.where("digest is not null and doc_id is not null")
    stands = scratch.table(named.groupBy("digest").agg(F.min("doc_id").alias("id")))
    # an entity's code is 64 bits of the digest: a clash only adds candidates
    code = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    first = signed.where("prefix is not null and doc_id is not null").select(code.alias("code"), F.explode("prefix").alias("token"))
    counted = scratch.table(first.groupBy("token").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("token", "c"))
    codes = first.join(counted, "token").select("code").distinct()
    ids = scratch.table(stands.select("id", code.alias("code")).join(codes, "code", "left_semi").select("id").distinct())
    bound = max(FREQUENT, (counted.agg(F.sum("c")).first()[0] or 0) // FREQUENT_MOST)  # the list that is sent stays small
    frequent = counted.where(F.col("c") > bound).toPandas().sort_values("token")
    shared = spark.sparkContext.broadcast((frequent["token"].to_numpy("int64"), frequent["c"].to_numpy("int64")))
    index = scratch.table(_index(docs, ids, ids.count(), shared, percent))
    scratch.drop(counted, ids)
    posts, meta = index.select("id", "n", F.explode("prefix").alias("token")), index.select("id", "n", "m", "l").dropDuplicates(["id", "n"])
    links, comp = None, None
    for _ in range(PIVOT_ROUNDS):
        pairs = scratch.table(_pivot_pairs(posts, meta, comp, percent))
        got = _verify(docs, pairs, scratch, percent)
        links = got if links is None else scratch.table(links.union(got))
        comp = components(links, scratch)
    placed = scratch.table(_open_posts(posts, comp))
    rest = scratch.table(_light_pairs(placed, meta, percent).union(_block_pairs(placed, index, percent)).distinct())
    links = scratch.table(links.union(_verify(docs, rest, scratch, percent)))
    comp = components(links, scratch)
    scratch.drop(index, placed, rest)
    known = scratch.table(stands.join(comp, "id", "left").select("digest", F.coalesce("component", "id").alias("component")))
    joined = signed.select("doc_id", "digest", "n").join(known, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _with_components(posts: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return posts.withColumn("component", F.col("id"))
    return posts.join(small(comp, comp.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _enough(met: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) with k shared prefix tokens those that can be links.

    Of the two prefixes let x's be the one that ends first in the common order. What y has of it
    stands in y's prefix, so m_x - k tokens of x are not in y, and the overlap is at most
    n_x - m_x + k. It must reach percent / (100 + percent) of n_x + n_y; and k must reach l of
    the shorter lengthened prefix.
    """
    side = lambda x: meta.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}"), F.col("l").alias(f"l_{x}"))
    count = meta.count()
    both = met.join(small(side("a"), count), "a").join(small(side("b"), count), "b")
    overlap = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent) - F.lit(1e-9))
    most = F.greatest(F.col("n_a") - F.col("m_a"), F.col("n_b") - F.col("m_b")) + F.col("k")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(sizes & (most >= overlap) & (F.col("k") >= F.least("l_a", "l_b")))


def _pivot_pairs(posts: DataFrame, meta: DataFrame, comp: DataFrame | None, percent: int) -> DataFrame:
    """For each id one pivot in another component: of its tokens' pivots the one met most often.

    A token has two pivots, an entity of its smallest and one of its largest component, so that
    every member sees one of another component, if there is one. Pairs that meet too seldom are
    left to the exact step.
    """
    p = _with_components(posts, comp)
    place = F.struct("component", "id")
    pivots = p.groupBy("token").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.component <> hi.component")
    pivots = pivots.select("token", F.col("lo.component").alias("low"), F.col("lo.id").alias("low_id"), F.col("hi.id").alias("high_id"))
    pick = F.when(F.col("component") != F.col("low"), F.col("low_id")).otherwise(F.col("high_id"))
    met = p.join(pivots, "token").select(F.least("id", pick).alias("a"), F.greatest("id", pick).alias("b"), "id")
    met = met.groupBy("a", "b", "id").agg(F.count(F.lit(1)).alias("k"))
    best = _enough(met, meta, percent).groupBy("id").agg(F.max(F.struct("k", (-F.col("a")).alias("a"), F.col("b"))).alias("best"))
    return best.select((-F.col("best.a")).alias("a"), F.col("best.b").alias("b")).distinct()


def _open_posts(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """token, id, n, component, c, lo: the tokens that stand in several components, with the number
    and the smallest of their entities."""
    p = _with_components(posts, comp)
    ends = p.groupBy("token").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("c"), F.min("id").alias("lo")).where("first <> last")
    return p.join(ends.select("token", "c", "lo"), "token").select("token", "id", "n", "component", "c", "lo")


def _light_pairs(placed: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """a < b: pairs of different components that share as many prefix tokens of few entities as a
    link needs. Pairs that share tokens of many as well are counted too low here and left to blocks."""
    p = placed.where(F.col("c") <= LIGHT).select("token", "id", "n", "component")
    q = p.select("token", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("component").alias("component2"))
    close = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("component") != F.col("component2")) & (F.col("id") < F.col("id2"))
    met = p.join(q, "token").where(close).groupBy(F.col("id").alias("a"), F.col("id2").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    return _enough(met, meta, percent).select("a", "b")


def _block_pairs(placed: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """a < b: pairs of different components that share a prefix token of many entities and whose
    sizes and bitmaps allow a link.

    Tokens that share entities mostly get one name, the smallest entity that theirs meet, so that two
    entities meet under few names. Under a name, entities of about equal size are dealt into blocks of
    BLOCK by hash, and a task compares two blocks. A group of g entities so sends each to g / BLOCK
    tasks; pairs are never rows.
    """
    p = placed.where(F.col("c") > LIGHT)
    near = p.groupBy("id").agg(F.min("lo").alias("near"))
    named = p.join(near, "id").groupBy("token").agg(F.min("near").alias("name"))
    step = math.log(100 / percent) if percent < 100 else 1e-9
    members = p.join(named, "token").select("name", "id", "component", "n").distinct()
    members = members.withColumn("size", F.floor(F.ln("n") / F.lit(step) + F.lit(1e-9)))
    # under its own size and the next larger: sizes that may link are at most one apart
    members = members.select("name", "id", "component", "size", F.explode(F.array("size", F.col("size") + 1)).alias("at"))
    groups = members.groupBy("name", "at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("g"), F.max("component").alias("hi"), F.min("component").alias("lo")).where("lo <> hi")
    dealt = members.join(groups.select("name", "at", "blocks"), ["name", "at"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("name", "at", "id", "component", "size", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = index.select("id", "n", "bits").join(members.select("id").distinct(), "id", "left_semi").distinct()  # an id may have several
    dealt = dealt.join(sets, "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        col = lambda x: table.column(x).to_numpy()
        ids, comp, size, own, n = (col(x) for x in ("id", "component", "size", "own", "n"))
        at, i, j = (table.column(x)[0].as_py() for x in ("at", "i", "j"))
        raw = table.column("bits").to_pylist()
        words = min(map(len, raw)) // 8
        bits = np.stack([folded(x, words) for x in raw])
        right = np.flatnonzero(own == j)
        found: list[np.ndarray] = []
        for x in np.flatnonzero(own == i).tolist():
            y = right[(comp[right] != comp[x]) & (np.maximum(size[right], size[x]) == at) & ((ids[right] > ids[x]) if i == j else True)]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            if len(y):
                apart = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype="int64")
                y = y[(100 + percent) * apart <= (100 - percent) * (n[y].astype("int64") + int(n[x]))]
                found.append(np.stack([np.minimum(ids[y], ids[x]), np.maximum(ids[y], ids[x])]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), "int64")
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return dealt.groupBy("name", "at", "i", "j").applyInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each component one row stays, of the smallest doc_id; if that id
    occurs in several rows, the first by text. Rows without id or without words stay; so do the columns.
    Rows that occur twice count as copies. An empty table stays empty."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.table(groups(docs, percent).where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct())
    own = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(r"[^\t-\r ]"), F.lit(False))
    twice = scratch.table(docs.where(own).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    name = fresh(docs, "row")
    key = lambda t: t.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    stay = docs.where(~own).unionByName(docs.where(own).join(small(key(gone), gone.count()), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]))
    if n := twice.count():
        again = stay.where(own).join(small(twice, n), "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns])
        one = again.groupBy("doc_id").agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), F.col("text").cast("string")).alias(name)).select(f"{name}.*")
        rest = stay.where(own).join(small(twice, n), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
        stay = stay.where(~own).unionByName(rest).unionByName(one)
    return stay.select(*[f"`{c}`" for c in docs.columns])


#: groups() of all documents by plain comparison; for small tables, as its closure is quadratic in a group.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x
)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(other)::BIGINT AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY doc_id
"""


def op10(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
