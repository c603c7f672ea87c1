import io
import random

import duckdb
import pytest

from weir import Engine
from weir.dialect import parse
from weir.plans.compile import PlanError
from weir.plans.rewrite import RULES
from weir.plans.sql import names, to_sql
from weir.sources.binary import read_relation, write_relation
from weir.spec import QuerySpec, Ref, Interval
from weir.streaming.session import run_script

GOLDEN = [[(1, 2, 3), (2, 2, 4), (4, 2, 6), (3, 4, 2)], [(1, 1, 4), (2, 1, 3), (2, 4, 2), (3, 3, 4)], [(1, 2, 2), (4, 4, 8), (4, 8, 2)]]


def make(spark, relations, **options):
    e = Engine(spark)
    for rows, width in relations:
        e.register(spark.createDataFrame(rows, ", ".join(f"c{i} bigint" for i in range(width))), not_null=True, **options)
    return e


@pytest.fixture(scope="module")
def golden(spark):
    return make(spark, [(r, 3) for r in GOLDEN])


@pytest.mark.parametrize("text,answer", [("0 1|0.0=1.1|1.1 1.2", "9 13"), ("0 1 2|0.0=1.0&2.0=0.0|0.2 1.1 1.2 2.0", "3 1 4 1"), ("0 1 2|0.1=1.0&1.0=2.2&0.0>2|1.0 0.0 0.2", "8 16 24"), ("0 1|0.2=1.0&0.2=2|1.1 0.2 1.0", "5 4 4")])
def test_golden(golden, text, answer):
    assert golden.run_batch([text]) == [answer]
    assert golden.run_batch([text], rules=()) == [answer]


def test_null_and_zero(spark, golden):
    assert golden.run_batch(["0|0.0>100|0.1", "0|0.0=5&0.0>10|0.1", "0|0.0>3&0.0<4|0.0"]) == ["NULL", "NULL", "NULL"]
    e = make(spark, [([(0, 0)], 2), ([], 2)])
    assert e.run_batch(["0||0.0", "1||0.0 0.1", "0 1|0.0=1.0|0.1"]) == ["0", "NULL NULL", "NULL"]


def test_constant_beyond_bigint(golden):
    assert golden.run_batch(["0|0.0<18446744073709551615|0.0", "0|0.0>18446744073709551614|0.0"]) == ["10", "NULL"]


def test_unused_binding_and_cross(golden):
    assert golden.run_batch(["0 1|0.0>0|0.0"]) == ["10"]
    with pytest.raises(PlanError):
        golden.query("0 1|0.0>0&1.0>0|0.0")
    assert golden.run_batch(["0 1|0.0>0&1.0>0|0.0 1.1"], allow_cross=True) == ["40 36"]
    assert golden.run_batch(["0 1|0.0>0&1.0>100|0.0 1.1"], allow_cross=True) == ["NULL NULL"]


def test_bad_ids(golden):
    with pytest.raises(KeyError):
        golden.query("9||0.0")
    with pytest.raises(ValueError):
        golden.query("0||0.7")


def test_elimination_keeps_two_key_correlation(spark):
    """A relation with two unique columns joins two others: neither join may go."""
    e = make(spark, [([(0, 1), (1, 0)], 2), ([(0,), (1,)], 1), ([(0,), (0,)], 1)])
    text = "0 1 2|1.0=0.0&2.0=0.1|1.0 2.0"
    assert e.run_batch([text]) == e.run_batch([text], rules=())
    assert not any("eliminate: binding 0" in t for t in e.compile(text).spec.trace)
    c = e.compile("1 0|0.0=1.0|0.0 1.0")
    assert any("eliminate" in t for t in c.spec.trace) and len(c.spec.bindings) == 1


def test_elimination_keeps_nulls_out(spark):
    e = Engine(spark)
    e.register(spark.createDataFrame([(1, 5), (None, 7)], "a bigint, b bigint"))
    e.register(spark.createDataFrame([(1,), (2,)], "a bigint"))
    assert e.run_batch(["0 1|0.0=1.0|0.1"]) == ["5"]


def test_eager_plan_and_signed_values(spark):
    rows = [(k % 5, v - 50) for k, v in enumerate(range(200))]
    e = make(spark, [(rows, 2), (rows, 2)])
    text = "0 1|0.0=1.0|0.1 1.1 0.0"
    assert e.compile(text).aggregated == [0, 1]
    assert e.run_batch([text]) == e.run_batch([text], rules=())


@pytest.mark.parametrize("strategy,node", [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("nested_loop", "CartesianProduct")])
def test_strategies(golden, strategy, node):
    text = "0 1|0.0=1.1|1.1 1.2"
    assert node in golden.explain(text, strategy=strategy, rules=())
    assert golden.run_batch([text], strategy=strategy, rules=()) == ["9 13"]


@pytest.mark.parametrize(
    "text,nodes,absent,answer",
    [
        ("0 1|0.0=1.0|0.1 1.1", ["SortMergeJoin"], "BroadcastHashJoin", "1499998500000 999999000000"),  # neither side fits
        ("2 1|0.0=1.0|0.1 1.1", ["BroadcastHashJoin Inner BuildLeft"], "SortMergeJoin", "147 42"),
        ("0 1|0.0=1.0&1.1<10|0.1 1.1", ["BroadcastHashJoin Inner BuildRight"], "SortMergeJoin", "30 20"),  # its filter leaves five rows
        ("3 4 3|0.0=1.0&1.1=2.1|0.0 2.1", ["BroadcastHashJoin Inner BuildRight", "SortMergeJoin"], "BuildLeft", "19999900000 39999800000"),  # one fits, two don't
    ],
)
def test_broadcast_as_far_as_it_fits(spark, text, nodes, absent, answer):
    e = Engine(spark)
    for rows, by in ((1_000_000, 3), (1_000_000, 2), (7, 7), (200_000, 2), (200_000, 2)):
        e.register(spark.range(rows).selectExpr("id", f"id * {by}"), not_null=True)
    plan = e.explain(text, strategy="broadcast", rules=())
    assert all(n in plan for n in nodes) and absent not in plan
    assert e.run_batch([text], strategy="broadcast", rules=()) == [answer]


def random_spec(rng, widths):
    n = rng.randint(1, 4)
    relations = tuple(rng.randrange(len(widths)) for _ in range(n))
    any_ref = lambda b: Ref(b, rng.randrange(widths[relations[b]]))
    equi = {frozenset((any_ref(b), any_ref(rng.randrange(b)))) for b in range(1, n)}
    for _ in range(rng.choice([0, 0, 1, 2])):
        a, b = any_ref(rng.randrange(n)), any_ref(rng.randrange(n))
        if a != b:
            equi.add(frozenset((a, b)))
    domains = {}
    for _ in range(rng.choice([0, 1, 1, 2])):
        r = any_ref(rng.randrange(n))
        domains[r] = domains.get(r, Interval()).meet(Interval.of(rng.choice("=<>"), rng.randint(0, 8)))
    return QuerySpec(relations, frozenset(equi), tuple(sorted(domains.items())), tuple(any_ref(rng.randrange(n)) for _ in range(rng.randint(1, 3))))


@pytest.mark.parametrize("seed", range(3))
def test_random_specs_agree_with_sql(spark, seed):
    rng = random.Random(seed)
    widths = [rng.randint(1, 4) for _ in range(4)]
    data = [[tuple(rng.randint(0, 5 if w > 1 else 9) for _ in range(w)) for _ in range(rng.choice([0, 6, 20, 40]))] for w in widths]
    data[0] = [(i, *r[1:]) for i, r in enumerate(data[0])]  # a key
    e = make(spark, list(zip(data, widths)))
    con = duckdb.connect()
    for i, (rows, w) in enumerate(zip(data, widths)):
        con.execute(f"create table r{i} ({', '.join(f'c{k} bigint' for k in range(w))})")
        if rows:
            con.executemany(f"insert into r{i} values ({', '.join('?' * w)})", rows)
    for _ in range(8):
        spec = random_spec(rng, widths)
        expected = con.execute(to_sql(spec, names(e.catalog))).fetchone()
        for rules in ((), RULES, (rng.choice(RULES),)):
            c = e.compile(spec, rules=rules, allow_cross=True, strategy=rng.choice([None, "merge", "shuffle_hash"]))
            assert tuple(c.df.first()) == expected, (spec, rules, c.spec.trace)


def test_u64_wraps(spark, tmp_path):
    big = 2**64 - 1
    path = str(tmp_path / "r0")
    write_relation(path, [[big, big, 1, 2**63], [1, 2, 3, 4]])
    df = read_relation(spark, path, rows_per_task=2)
    assert df.rdd.getNumPartitions() == 2
    assert sorted(int(r.c0) for r in df.collect()) == sorted([big, big, 1, 2**63])
    e = Engine(spark)
    e.load(path, u64=True)
    assert e.run_batch(["0||0.0 0.1", "0|0.0>9223372036854775807|0.1", "0 0|0.0=1.0|0.0"]) == [f"{(2 * big + 1 + 2**63) % 2**64} 10", "7", f"{(4 * big + 1 + 2**63) % 2**64}"]


def test_session(spark, tmp_path):
    paths = []
    for i, rows in enumerate(GOLDEN):
        paths.append(str(tmp_path / f"g{i}"))
        write_relation(paths[-1], list(zip(*rows)))
    out = io.StringIO()
    e = run_script(spark, [*paths, "Done", "0 1|0.0=1.1|1.1 1.2", "0|0.0>100|0.0", "F", "0 1|0.2=1.0&0.2=2|1.1 0.2 1.0", "F"], out)
    assert out.getvalue() == "9 13\nNULL\n5 4 4\n"
    assert "queries 3" in e.report()


def test_empty_binary_relation(spark, tmp_path):
    path = str(tmp_path / "empty")
    write_relation(path, [[], []])
    e = Engine(spark)
    e.load(path)
    assert e.run_batch(["0||0.0"]) == ["NULL"]


def test_histogram(spark):
    from weir.functions.histogram import Histogram

    df = spark.range(0, 1000).selectExpr("id % 100 as v")
    h = Histogram.of(df, "v", 10)
    assert h.rows == 1000 and len(h.buckets) == 10
    assert abs(h.estimate("<", 50) - 500) < 60 and abs(h.estimate("=", 7) - 10) < 3
    assert Histogram.of(df.where("v < 0"), "v").rows == 0


def test_prune_only_without_nulls(spark):
    e = Engine(spark)
    e.register(spark.createDataFrame([(1, 5), (None, 7)], "a bigint, b bigint"))
    assert e.run_batch(["0|0.0<100|0.1"]) == ["5"]
