"""What layouts and indexes do to plans."""

import re

import pytest

from weir import workload
from weir.engine import Engine
from weir.functions.unsigned import wrapped_product
from weir.sources.binary import write_relation

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorted_scan_pushes_its_range(spark):
    text = plan(workload.sorted_engine(spark, SF).query(workload.SORTED))
    assert "GreaterThanOrEqual(l_orderkey,101)" in text or "GreaterThan(l_orderkey,100)" in text


def test_bucketed_join_shuffles_nothing(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(workload.bucketed_engine(spark, SF, 4).query("0 1|0.0=1.0|0.1 1.1", rules=()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "hashpartitioning" not in text


def test_aggregate_index_is_read(spark):
    c = workload.indexed_engine(spark, SF).compile(workload.M2M)
    assert c.from_index == [0, 1]
    assert workload.indexed_engine(spark, SF).compile("6 6|0.1=1.1&0.0<50|0.2 1.0").from_index in ([], [1])


def test_u64_aggregates_before_many_to_many(spark):
    assert workload.unsigned_engine(spark, SF).compile(workload.M2M).aggregated == [0, 1]


def test_u64_products_wrap(spark):
    values = [0, 1, 7, (1 << 32) - 1, 1 << 32, (1 << 63) + 12345, (1 << 64) - 1]
    df = spark.createDataFrame([(str(a), str(b)) for a in values for b in values], "a string, b string").selectExpr("cast(a as decimal(20,0)) a", "cast(b as decimal(20,0)) b")
    for r in df.withColumn("p", wrapped_product(df.a, df.b)).collect():
        assert int(r.p) == int(r.a) * int(r.b) % (1 << 64)


def test_u64_many_to_many_wraps(spark, tmp_path):
    big = (1 << 64) - 1
    path = str(tmp_path / "r")
    write_relation(path, [[1] * 10 + [2] * 6, [big] * 8 + [5] * 8])
    e = Engine(spark)
    e.load(path, u64=True)
    c = e.compile("0 0|0.0=1.0|0.1 1.1")
    want = (10 * (8 * big + 2 * 5) + 6 * 6 * 5) % (1 << 64)
    assert c.aggregated == [0, 1] and [int(x) for x in c.df.first()] == [want, want]


def test_binary_scan_reads_its_columns_and_rows(spark, tmp_path):
    path = str(tmp_path / "r")
    write_relation(path, [list(range(1000)), [7] * 1000, list(range(1000, 0, -1))])
    e = Engine(spark)
    e.load(path)
    df = e.query("0|0.2<11|0.0")
    assert re.search(r"BatchScan weir_binary\[c0#\d+, c2#\d+\]", plan(df)) and df.first().s0 == sum(range(990, 1000))
    assert e.catalog[0].columns({0}, {2: workload.parse("0|0.2<11|0.0").domains[0][1]}).count() == 10


def test_histogram_estimates_order_joins(spark):
    e = workload.indexed_engine(spark, SF)
    h = e.statistics.histograms[6, 0]
    assert h.thresholds() == sorted(h.thresholds()) and len(h.thresholds()) == len(h.buckets)
    domain = workload.parse("6|0.0>100&0.0<900|0.1").domains[0][1]
    exact = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey > 100 and l_orderkey < 900")
    share = exact.count() / h.rows
    assert e.statistics.fraction(6, 0, domain) == pytest.approx(share, abs=0.02)


def test_runtime_bloom_filter(spark):
    """A selective side's keys are turned into a Bloom filter that the other side's scan probes."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        text = plan(workload.engine(spark, SF).query("6 5|0.0=1.0&1.1<50|0.1 1.0", rules=()))
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert "might_contain" in text
