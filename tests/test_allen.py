"""The interval algebra: dimensions, laws and parity of expressions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import allen

#: Composition sizes and distances in canonical order.
SIZES = {"before": "1 1 13 1 5 1 5 1 1 5 1 5 1", "overlaps": "1 1 5 1 3 3 9 1 3 3 5 3 3", "during": "1 1 1 1 1 5 5 1 5 1 13 1 5", "finished-by": "1 1 5 1 3 1 3 1 1 3 1 3 1"}
DISTANCES = {"equals": "0 3 3 3 3 2 2 1 1 2 2 1 1", "meets": "3 1 4 0 4 1 3 2 3 2 2 3 2", "contains": "2 2 2 2 2 1 1 2 1 2 0 2 1"}


@pytest.fixture(scope="module")
def compose(spark):
    return {(r.r1, r.r2): r["mask"] for r in allen.composition_dim(spark).collect()}


def test_relations_and_inverses(spark):
    rows = allen.relation_dim(spark).collect()
    assert sorted(r.rel for r in rows) == list(range(13))
    inv = {r.rel: r.inverse for r in rows}
    assert all(inv[inv[r]] == r for r in inv) and [r for r in inv if inv[r] == r] == [0]
    assert {r.name for r in rows if r.precedes} == set(allen.PRECEDES)


def test_distances(spark):
    d = {(r.r1, r.r2): (r.distance, r.score) for r in allen.distance_dim(spark).collect()}
    assert all(d[a, b] == d[b, a] for a, b in d) and all((d[a, b][0] == 0) == (a == b) for a, b in d)
    for name, want in DISTANCES.items():
        assert [d[allen.ID[name], j][0] for j in range(13)] == [*map(int, want.split())]
    assert sorted({x for x, _ in d.values()}) == [0, 1, 2, 3, 4] and d[1, 3][1] == pytest.approx(5 / 6)


def test_composition(compose):
    size = lambda m: bin(m).count("1")
    assert len(compose) == 169 and sum(map(size, compose.values())) == 409
    for name, want in SIZES.items():
        assert [size(compose[allen.ID[name], j]) for j in range(13)] == [*map(int, want.split())]
    turn = lambda r: r if r == 0 else ((r - 1) ^ 1) + 1
    turned = lambda mask: sum(1 << turn(r) for r in range(13) if mask >> r & 1)
    assert all(turned(m) == compose[turn(b), turn(a)] for (a, b), m in compose.items())
    assert all(compose[0, r] == compose[r, 0] == 1 << r for r in range(13))


def test_partial_table(spark, compose):
    core = {(r.r1, r.r2): r.r3 for r in allen.core_dim(spark).collect()}
    assert len(core) == 39
    wrong = [k for k, r3 in core.items() if compose[k] != 1 << r3]
    assert [(allen.SYMBOLIC[a], allen.SYMBOLIC[b]) for a, b in wrong] == [("before", "during")]
    assert len(allen.full_dim(spark).collect()) == 97


def test_sql_functions_agree(spark):
    allen.register(spark)
    at = lambda h: datetime(2026, 1, 1, h)
    rows = [(at(a), at(b), at(c), at(d)) for a in range(4) for b in range(a, 4) for c in range(4) for d in range(c, 4)]
    df = spark.createDataFrame(rows, "s1 timestamp_ntz, e1 timestamp_ntz, s2 timestamp_ntz, e2 timestamp_ntz")
    cols = [F.col(c) for c in df.columns]
    got = df.select(allen.relation(*cols).alias("a"), F.expr("allen_relation(s1, e1, s2, e2)").alias("b"), allen.proper_relation(*cols).alias("p"), "*").collect()
    assert all(r.a == r.b for r in got)
    assert all((r.p is None) == (r.s1 == r.e1 or r.s2 == r.e2) for r in got)
    instant = [r for r in got if r.s1 == r.e1 == r.s2 == r.e2]
    assert {r.a for r in instant} == {allen.ID["meets"]}


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("Before", "MET-BY", "same time", "overlapped by", "nonsense", " includes ")], "x string")
    got = [r.n for r in df.select(allen.label(allen.parse_relation(F.col("x"))).alias("n")).collect()]
    assert got == ["before", "met_by", "equal", "overlapped_by", None, "contains"]
