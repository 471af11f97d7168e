"""A ring of accounts fed by a chain, worked out by hand.

2 -> 1 <- 8, 3 -> 2 <- 6, 4 -> 3, 5 -> 4 lead up to account 1; 1 -> 7 -> 8 -> 1 and
1 -> 7 -> 9 -> 8 -> 1 run round. Ids have no ranges: companies are those in their table.
"""

import pytest

from skein.plans.graph import PropertyGraph
from skein.plans.registry import run

ANN, BEA, CY, FIRM, SHOP, BAD, GOOD, L1, L2 = 101, 102, 103, 201, 202, 301, 302, 401, 402
WIDE = {"lo": 0, "hi": 1000, "limit": 100}


@pytest.fixture(scope="module")
def g(spark):
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long, ts long, amt double")
    t = lambda rows: spark.createDataFrame(rows, "src long, dst long, ts long")
    return PropertyGraph(spark, {
        "transfer": e([
            (2, 1, 50, 10.0), (3, 2, 40, 20.0), (4, 3, 30, 30.0), (5, 4, 20, 40.0), (6, 2, 60, 5.0),
            (1, 7, 70, 100.0), (7, 8, 80, 90.0), (8, 1, 90, 80.0), (7, 9, 75, 60.0), (9, 8, 78, 50.0),
        ]),
        "withdraw": e([(8, 12, 85, 70.0), (8, 12, 79, 30.0)]), "deposit": e([(L1, 3, 100, 200.0), (L1, 9, 101, 300.0), (L2, 3, 102, 50.0)]), "repay": e([(3, L1, 110, 60.0)]),
        "apply": e([(BEA, L1, 1, 1000.0), (CY, L2, 1, 500.0)]), "guarantee": t([(ANN, BEA, 1), (BEA, CY, 2), (CY, BEA, 3)]),
        "own": t([(ANN, 1, 1), (FIRM, 7, 1), (BEA, 8, 1), (CY, 9, 1)]), "invest": t([(ANN, FIRM, 1), (ANN, SHOP, 1), (BEA, FIRM, 1), (BEA, SHOP, 2), (CY, SHOP, 2), (FIRM, SHOP, 3)]),
        "sign_in": t([(BAD, 3, 1), (BAD, 4, 1), (BAD, 5, 1), (BAD, 9, 1), (GOOD, 2, 1)]), "medium": spark.createDataFrame([(BAD, True), (GOOD, False)], "id long, blocked boolean"),
        "loan": spark.createDataFrame([(L1, 1000.0, 400.0), (L2, 500.0, 100.0)], "id long, amount double, balance double"), "company": spark.createDataFrame([(FIRM,), (SHOP,)], "id long"),
    })


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_upstream_in_falling_time(g):
    assert rows(run("cr1", g, account=1, **WIDE)) == [(3, 2, BAD, "Medium"), (9, 2, BAD, "Medium"), (4, 3, BAD, "Medium")]
    assert rows(run("cr1", g, account=1, **{**WIDE, "limit": 1})) == [(3, 2, BAD, "Medium"), (4, 3, BAD, "Medium")]
    assert rows(run("cr1", g, account=1, **{**WIDE, "lo": 75})) == [(9, 2, BAD, "Medium")]
    assert rows(run("cr2", g, person=ANN, **WIDE)) == [(3, 1500.0, 500.0), (9, 1000.0, 400.0)]
    assert rows(run("cr2", g, person=ANN, **{**WIDE, "limit": 1})) == [(3, 1500.0, 500.0)]
    assert rows(run("cr2", g, person=CY, **WIDE)) == []


def test_shortest(g):
    assert rows(run("cr3", g, account=1, target=8, **WIDE)) == [(2,)]
    assert rows(run("cr3", g, account=1, target=8, **{**WIDE, "hi": 79})) == [(3,)]
    assert rows(run("cr3", g, account=1, target=5, **WIDE)) == [(-1,)]
    assert rows(run("trace_transfers_in", g, account=1, hops=2, **WIDE)) == [(1, 0), (2, 1), (8, 1), (3, 2), (6, 2), (7, 2), (9, 2)]


def test_cycles_and_traces(g):
    assert rows(run("cr4", g, account=1, min=45.0, window=100)) == [("-1-7-8-", 3), ("-1-7-9-8-", 4)]
    assert rows(run("cr4", g, account=1, min=55.0, window=100)) == [("-1-7-8-", 3)]
    assert rows(run("cr4", g, account=1, min=0.0, window=15)) == []
    assert rows(run("cr5", g, person=ANN, **WIDE)) == [("-1-7-9-8-", 3), ("-1-7-8-", 2), ("-1-7-9-", 2), ("-1-7-", 1)]
    assert rows(run("cr5", g, person=ANN, **{**WIDE, "limit": 1})) == [("-1-7-8-", 2), ("-1-7-", 1)]


def test_sums_and_ratios(g):
    assert rows(run("cr6", g, account=8, t1=0.0, t2=0.0, **WIDE)) == [(7, 90.0, 100.0), (9, 50.0, 100.0)]
    assert rows(run("cr6", g, account=8, t1=60.0, t2=40.0, **WIDE)) == [(7, 90.0, 70.0)]
    assert rows(run("cr6", g, account=8, t1=0.0, t2=0.0, **{**WIDE, "hi": 79})) == [(9, 50.0, 30.0)]
    assert rows(run("cr7", g, account=8, t=0.0, **WIDE)) == [(2, 1, 1.75)]
    assert rows(run("cr7", g, account=8, t=0.0, **{**WIDE, "limit": 1})) == [(1, 1, 0.625)]
    assert rows(run("cr7", g, account=12, t=0.0, **WIDE)) == [(0, 0, -1.0)]
    assert rows(run("cr8", g, loan=L1, t=0.5, **WIDE)) == [(1, 0.08, 3), (8, 0.05, 2), (2, 0.02, 2), (9, 0.3, 1), (3, 0.2, 1)]
    assert rows(run("cr9", g, account=3, t=0.0, **WIDE)) == [(0.24, 2.0, 0.667)]
    assert rows(run("cr9", g, account=12, t=0.0, **WIDE)) == [(-1.0, -1.0, -1.0)]


def test_investors_guarantors_companies(g):
    assert rows(run("cr10", g, person=ANN, **WIDE)) == [(BEA, 2), (CY, 1), (FIRM, 1)]
    assert rows(run("cr10", g, person=ANN, **{**WIDE, "lo": 1, "hi": 0})) == []
    assert rows(run("cr11", g, person=ANN)) == [(1500.0,)]
    assert rows(run("cr12", g, person=ANN, **WIDE)) == [(7, 100.0)]
    assert rows(run("cr12", g, person=CY, **WIDE)) == []  # to an account of a person


def test_limit(g):
    with pytest.raises(ValueError, match="limit"):
        run("cr1", g, account=1, **{**WIDE, "limit": 100_000})
