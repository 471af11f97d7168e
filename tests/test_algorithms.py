import random

import pytest

from skein.operators import algorithms as a
from skein.operators.paths import closure, hops, relax, roots, same_component


def graph(spark, n, edges):
    return spark.range(n).select("id"), spark.createDataFrame(edges, "src long, dst long, weight double") if edges else spark.createDataFrame([], "src long, dst long, weight double")


def values(df):
    return [r[1] for r in df.orderBy("id").collect()]


def test_bfs_sssp_wcc(spark):
    """A square with a tail and a short cut, and a node alone: 3 -> 1 -> 4 -> 0, 3 -> 5 -> 4, 0 -> 6; 2."""
    v, e = graph(spark, 7, [(3, 1, 1.5), (1, 4, 6.0), (4, 0, 0.25), (3, 5, 2.0), (5, 4, 3.0), (0, 6, 1.0)])
    far = 9223372036854775807
    assert values(a.bfs(v, e, 3)) == [3, 1, far, 0, 2, 1, 4]
    assert values(a.bfs(v, e, 6, directed=False)) == [1, 3, far, 4, 2, 3, 0]
    assert values(a.sssp(v, e, 3)) == [5.25, 1.5, float("inf"), 0.0, 5.0, 2.0, 6.25]
    assert values(a.wcc(v, e)) == [0, 0, 2, 0, 0, 0, 0]
    n = 300
    line = [(i + 1, i, 1.0) for i in range(1, n - 1)]
    assert values(a.wcc(*graph(spark, n, line))) == [0] + [1] * (n - 1)


def test_pagerank(spark):
    """Two rings share vertex 0; against the recurrence written out."""
    edges = [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0), (0, 3)]
    want, n = [1 / 6] * 6, 6  # vertex 5 has no edges: it gives its rank to all
    for _ in range(4):
        pull = [0.0] * n
        for x, y in edges:
            pull[y] += want[x] / sum(s == x for s, _ in edges)
        want = [0.1 / n + 0.9 * (p + want[5] / n) for p in pull]
    v, e = graph(spark, n, [(x, y, 1.0) for x, y in edges])
    assert values(a.pagerank(v, e, damping=0.9, iterations=4)) == pytest.approx(want)


def test_cdlp_lcc(spark):
    """Two cliques of four with a bridge."""
    clique = lambda k: [(i, j, 1.0) for i in range(k, k + 4) for j in range(i + 1, k + 4)]
    v, e = graph(spark, 9, clique(0) + clique(4) + [(3, 4, 1.0)])
    assert values(a.cdlp(v, e, iterations=5, directed=False)) == [0, 0, 0, 0, 4, 4, 4, 4, 8]
    seeds = spark.createDataFrame([(i, 500 - i) for i in range(9)], "id long, label long")
    assert values(a.cdlp(v, e, iterations=6, seeds=seeds))[:3] == [497, 497, 497]
    assert values(a.lcc(v, e, directed=False)) == pytest.approx([1, 1, 1, 0.5, 0.5, 1, 1, 1, 0])
    assert values(a.lcc(v, e)) == pytest.approx([0.5, 0.5, 0.5, 0.25, 0.25, 0.5, 0.5, 0.5, 0])


def test_target_and_components(spark):
    v, e = graph(spark, 40, [(i, (i * 7 + 3) % 40, 1.0 + i % 3) for i in range(20)] + [(i, i + 1, 4.0) for i in range(19)])
    start = spark.createDataFrame([(0, 0)], "source long, id long")
    full = {r["id"]: r["dist"] for r in relax(e, start).collect()}
    for t in (5, 18, 31):
        some = {r["id"]: r["dist"] for r in relax(e, start, spark.createDataFrame([(t,)], "id long")).collect()}
        assert some.get(t) == full.get(t)
    targets = spark.createDataFrame([(t,) for t in (3, 9, 17, 24)], "id long")
    near = sorted((d, t) for t, d in full.items() if t in (3, 9, 17, 24))[:2]
    some = sorted((r["dist"], r["id"]) for r in relax(e, start, targets, 2).collect() if r["id"] in (3, 9, 17, 24))[:2]
    assert some == near
    assert {r["id"]: r["d"] for r in hops(e, spark.createDataFrame([(0,)], "id long"), target=24).collect()}[24] == {r["id"]: r["d"] for r in hops(e, spark.createDataFrame([(0,)], "id long")).collect()}[24]
    c = a.wcc(*graph(spark, 6, [(0, 1, 1.0), (2, 3, 1.0)]))
    assert same_component(c, 0, 1) and not same_component(c, 1, 2) and same_component(c, 4, 4) and not same_component(c, 0, 99)


def test_random_lcc_and_paths(spark):
    rng = random.Random(4)
    n, pairs = 14, {(rng.randrange(14), rng.randrange(14)) for _ in range(60)}
    v, e = graph(spark, n, [(x, y, float(1 + (x * y) % 5)) for x, y in pairs])
    near = {u: {x for p in pairs for x in p if u in p and x != u} for u in range(n)}
    want = [sum((x, y) in pairs for x in near[u] for y in near[u] if x != y) / (len(near[u]) * (len(near[u]) - 1)) if len(near[u]) > 1 else 0.0 for u in range(n)]
    assert values(a.lcc(v, e)) == pytest.approx(want)
    dist = {0: 0.0}
    for _ in range(n):
        for x, y in pairs:
            if x in dist and dist[x] + 1 + (x * y) % 5 < dist.get(y, 1e9):
                dist[y] = dist[x] + 1 + (x * y) % 5
    got = relax(e, spark.createDataFrame([(0, 0)], "source long, id long"))
    assert {r["id"]: r["dist"] for r in got.collect()} == dist


def test_roots_and_closure(spark):
    tree = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, None), (7, 6), (8, 99)]
    got = {r["id"]: r["root"] for r in roots(spark.createDataFrame(tree, "id long, parent long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 99}
    up = closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))
    assert up.count() == 9
    assert {r["id"]: r["d"] for r in hops(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), spark.createDataFrame([(1,)], "id long"), 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_validators(spark):
    x = spark.createDataFrame([(1, 1.0), (2, float("inf"))], "id long, v double")
    y = spark.createDataFrame([(1, 1.0 + 1e-9), (2, float("inf"))], "id long, v double")
    z = spark.createDataFrame([(1, 1.0), (2, 5.0)], "id long, v double")
    assert a.close(x, y, "v") and not a.close(x, z, "v") and a.exact(x, x, "v") and not a.exact(x, z, "v")
    p = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, c long")
    q = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, c long")
    r = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, c long")
    assert a.same_partition(p, q, "c") and not a.same_partition(p, r, "c")
