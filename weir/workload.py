"""The standing workload: positional relations over the star-schema tables, and its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir import operators
from weir.dialect import parse
from weir.engine import Engine
from weir.functions.histogram import histogram
from weir.plans.sql import to_sql

#: Relation ids in order: table and integral columns by position. The tables have no nulls there.
TABLES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("region", ("r_regionkey",)),
    ("nation", ("n_nationkey", "n_regionkey")),
    ("customer", ("c_custkey", "c_nationkey")),
    ("supplier", ("s_suppkey", "s_nationkey")),
    ("part", ("p_partkey", "p_size")),
    ("orders", ("o_orderkey", "o_custkey")),
    ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")),
    ("events", ("event_id", "user_id")),
    ("documents", ("doc_id", "n_chars")),
    ("embeddings", ("vec_id", "label")),
    ("labels", ("doc_id", "quality", "toxic")),
    ("conversations", ("conv_id", "turn")),
    ("pages", ("page_id",)),
    ("benchmark", ("item_id",)),
)

JOIN2 = "6 5|0.0=1.0|0.1 1.1"

QUERIES: dict[str, str] = {
    "scan_filter_eq": "6|0.2=7|0.0 0.4",
    "scan_filter_lt": "6|0.0<500|0.1",
    "scan_filter_gt": "6|0.0>500|0.1",
    "scan_range": "6|0.0>100&0.0<900|0.1 0.2",
    "scan_multi_filter": "6|0.1>50&0.2<60&0.3=2|0.0",
    "scan_sum_all": "6||0.1 0.4",
    "empty_null": "6|0.0>999999999|0.1",
    "contradiction_range": "6|0.0>10&0.0<5|0.1",
    "contradiction_point": "6|0.0=5&0.0>10|0.1",
    "contradiction_open": "6|0.0>3&0.0<4|0.1",
    "join2": JOIN2,
    "join3_chain": "6 5 2|0.0=1.0&1.1=2.0&2.0<500|0.1 2.1",
    "join4_chain": "6 5 2 1|0.0=1.0&1.1=2.0&2.1=3.0&0.2>50|3.1 1.0",
    "join_star": "6 4 3|0.1=1.0&0.2=2.0&1.1<20|1.1 2.1 0.4",
    "join_many_to_many": "6 6|0.1=1.1|0.2 1.0",
    "join_composite": "6 6|0.0=1.0&0.3=1.3|0.1 1.2",
    "join_composite_filter": "2 3 6|0.1=1.1&1.0=2.2&2.1<30|0.0 2.4",
    "self_predicate": "11|0.0=0.1|0.0 0.1",
    "cyclic_implied": "2 3 1|0.1=1.1&1.1=2.0&0.1=2.0|2.1 0.0",
    "cyclic": "6 5 7|0.0=1.0&1.1=2.1&0.1=2.0|0.4",
    "pkfk_eliminated": "6 5|0.0=1.0|0.1 1.0",
    "filter_expansion": "6 5|0.0=1.0&1.0<100|0.1",
    "equal_projection": "6 5|0.0=1.0|0.0 1.0 0.0",
    "eager_agg_3way": "7 5 2|0.1=2.0&1.1=2.0|0.0 1.0 2.1",
    "labels_documents": "10 8|0.0=1.0&0.2=1|1.1 0.1",
}

STRATEGY_QUERIES = {f"join2_{s}": s for s in ("broadcast", "merge", "shuffle_hash", "nested_loop")}
#: A nested-loop join enumerates the product, so it gets a filtered, small query.
NESTED = "1 0|0.1=1.0|0.0 1.0"
CROSS = "0 1|0.0<3&1.0>5|0.0 1.1"
_engines: dict[tuple[str, str, str], tuple[SparkSession, Engine]] = {}
M2M = "6 6|0.1=1.1|0.2 1.0"
SORTED = "0|0.0>100&0.0<900|0.1 0.2"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine for a session and folder, so that statistics are got once."""

    def make() -> Engine:
        e = Engine(spark)
        for i, (table, columns) in enumerate(TABLES):
            e.register(spark.read.parquet(f"{sf_dir}/{table}.parquet"), list(columns), id=i, name=table, not_null=True)
        return e

    return _kept(spark, sf_dir, "tables", make)


def _kept(spark: SparkSession, sf_dir: str, what: str, make) -> Engine:
    """An engine for an application, folder and layout; the session is kept with it."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _engines or _engines[key][0] is not spark and _engines[key][0]._jsparkSession is not spark._jsparkSession:
        _engines[key] = (spark, make())
    return _engines[key][1]


def unsigned_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """lineitem as relation 6, with unsigned arithmetic."""

    def make() -> Engine:
        e = Engine(spark)
        e.register(_table(spark, sf_dir, "lineitem"), list(dict(TABLES)["lineitem"]), id=6, u64=True, not_null=True)
        return e

    return _kept(spark, sf_dir, "unsigned", make)


def sorted_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """lineitem, range-partitioned and sorted by l_orderkey, as relation 0."""

    def make() -> Engine:
        e, path = Engine(spark), operators.shared_path(spark)
        operators.write_sorted(_lineitem_long(spark, sf_dir), path, "l_orderkey")
        e.register(spark.read.parquet(path), not_null=True)
        return e

    return _kept(spark, sf_dir, "sorted", make)


def bucketed_engine(spark: SparkSession, sf_dir: str, buckets: int = 8) -> Engine:
    """lineitem and orders as relations 0 and 1, both bucketed and sorted by the order's key."""

    def make() -> Engine:
        e = Engine(spark)
        for table, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
            path = operators.shared_path(spark)
            name = f"weir_{table}_{path[-8:]}"
            operators.write_bucketed(_table(spark, sf_dir, table).select(*[F.col(c).cast("bigint").alias(c) for c in dict(TABLES)[table]]), name, key, buckets, path)
            e.register(spark.table(name), not_null=True)
        return e

    return _kept(spark, sf_dir, "bucketed", make)


def indexed_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """All tables, with lineitem's sums by part written out, and a histogram of its order keys."""

    def make() -> Engine:
        e = Engine(spark)
        for i, (table, columns) in enumerate(TABLES):
            e.register(_table(spark, sf_dir, table), list(columns), id=i, name=table, not_null=True)
        e.build_aggregate_index(6, 1, operators.shared_path(spark))
        e.build_histogram(6, 0)
        return e

    return _kept(spark, sf_dir, "indexed", make)


def binary_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """nation, a table of fixed size, from a file of the binary format as relation 0."""

    def make() -> Engine:
        import tempfile

        from weir.sources.binary import write_relation

        e, path = Engine(spark), f"{tempfile.mkdtemp(prefix='weir-')}/nation"
        rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
        write_relation(path, [[r.n_nationkey for r in rows], [r.n_regionkey for r in rows]])
        e.load(path)
        return e

    return _kept(spark, sf_dir, "binary", make)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem_long(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("bigint").alias("l_quantity"))


FOREIGN_KEYS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_suppkey", "nation", "n_nationkey"))


def _fk_report(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for f, fc, p, pc in FOREIGN_KEYS:
        one = operators.foreign_key_orphans(_table(spark, d, f), fc, _table(spark, d, p), pc).select(F.lit(f"{f}.{fc}").alias("fk"), F.lit(f"{p}.{pc}").alias("pk"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


STAT_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
UNIQUE_COLUMNS = ["o_orderkey", "o_custkey"]


def queries() -> dict:
    out = {name: (lambda s, d, t=text: engine(s, d).query(t)) for name, text in QUERIES.items()}
    for name, strategy in STRATEGY_QUERIES.items():
        out[name] = lambda s, d, k=strategy: engine(s, d).query(NESTED if k == "nested_loop" else JOIN2, strategy=k, rules=())
    out["cross_components"] = lambda s, d: engine(s, d).query(CROSS, allow_cross=True)
    out["group_sums"] = lambda s, d: operators.group_sums(_lineitem_long(s, d), "l_partkey", ["l_orderkey", "l_quantity"])
    out["column_stats"] = lambda s, d: operators.column_stats(_table(s, d, "lineitem"), STAT_COLUMNS)
    out["is_unique"] = lambda s, d: operators.unique_columns(_table(s, d, "orders"), UNIQUE_COLUMNS)
    out["fk_check"] = _fk_report
    out["join_many_to_many_u64"] = lambda s, d: unsigned_engine(s, d).query(M2M).select(*[F.col(f"s{i}").cast("bigint").alias(f"s{i}") for i in range(2)])
    out["binary_scan"] = lambda s, d: binary_engine(s, d).query("0|0.1>1|0.0 0.1")
    out["sorted_scan"] = lambda s, d: sorted_engine(s, d).query(SORTED)
    out["bucketed_join"] = lambda s, d: bucketed_engine(s, d).query("0 1|0.0=1.0|0.1 1.1")
    out["aggregate_index_join"] = lambda s, d: indexed_engine(s, d).query(M2M)
    out["histogram_ordered_join"] = lambda s, d: indexed_engine(s, d).query(QUERIES["join4_chain"])
    out["histogram_totals"] = lambda s, d: histogram(_table(s, d, "lineitem"), "l_partkey", 20).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
    out["histogram"] = lambda s, d: histogram(_table(s, d, "lineitem"), "l_partkey", 20)
    return out


def oracle_sql() -> dict[str, str]:
    tables = dict(enumerate(TABLES))
    out = {name: to_sql(parse(text), tables) for name, text in QUERIES.items()}
    out |= {name: to_sql(parse(NESTED if s == "nested_loop" else JOIN2), tables) for name, s in STRATEGY_QUERIES.items()}
    out["cross_components"] = to_sql(parse(CROSS), tables)
    out["join_many_to_many_u64"] = out["aggregate_index_join"] = to_sql(parse(M2M), tables)
    out["binary_scan"] = to_sql(parse("0|0.1>1|0.0 0.1"), {0: dict(enumerate(TABLES))[1]})
    out["sorted_scan"] = to_sql(parse(SORTED), {0: dict(enumerate(TABLES))[6]})
    out["bucketed_join"] = to_sql(parse(JOIN2), tables)
    out["histogram_ordered_join"] = out["join4_chain"]
    out["histogram_totals"] = "SELECT MIN(l_partkey) AS lo, MAX(l_partkey) AS hi, COUNT(*) AS rows FROM lineitem"
    out["group_sums"] = "SELECT l_partkey, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS sum_l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_l_quantity FROM lineitem GROUP BY l_partkey"
    out["column_stats"] = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST(MIN({c}) AS BIGINT) AS min_value, CAST(MAX({c}) AS BIGINT) AS max_value, COUNT(*) AS rows FROM lineitem" for c in STAT_COLUMNS)
    out["is_unique"] = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST(COUNT(DISTINCT {c}) = COUNT(*) AS INTEGER) AS is_unique FROM orders" for c in UNIQUE_COLUMNS)
    out["fk_check"] = " UNION ALL ".join(f"SELECT '{f}.{fc}' AS fk, '{p}.{pc}' AS pk, COUNT(DISTINCT {fc}) AS orphans FROM {f} WHERE {fc} NOT IN (SELECT {pc} FROM {p})" for f, fc, p, pc in FOREIGN_KEYS)
    return out
