"""The six standard graph algorithms on (vertices id; edges src, dst[, weight])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.operators.lineage import cut
from skein.operators.paths import both_ways, hops, relax

UNREACHED = 9223372036854775807


def _one(vertices: DataFrame, source: int) -> DataFrame:
    return vertices.filter(F.col("id") == source)


def bfs(vertices: DataFrame, edges: DataFrame, source: int, directed: bool = True) -> DataFrame:
    """(id, depth); unreachable vertices have the largest long."""
    found = hops(edges if directed else both_ways(edges), _one(vertices, source))
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("d", F.lit(UNREACHED)).alias("depth"))


def sssp(vertices: DataFrame, edges: DataFrame, source: int, directed: bool = True) -> DataFrame:
    """(id, dist); weight 1.0 where absent; unreachable vertices are infinitely far."""
    e = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    e = e.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    start = _one(vertices, source).select(F.col("id").alias("source"), "id")
    found = relax(e if directed else both_ways(e), start).select("id", "dist")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("dist", F.lit(float("inf"))).alias("dist"))


def wcc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the weakly connected component."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return vertices.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 10, directed: bool = True) -> DataFrame:
    """(id, rank): (1 - d)/n + d (sum over in-edges + dangling/n); parallel edges count."""
    e = edges.select("src", "dst")
    e = e if directed else both_ways(e)
    n = vertices.count()
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    e = cut(e.join(deg, "src"))
    sinks = vertices.select("id").join(deg.withColumnRenamed("src", "id"), "id", "left_anti")
    sinks = cut(sinks)
    rank = vertices.select("id", F.lit(1.0 / n if n else 0.0).alias("rank"))
    for k in range(iterations):
        lost = rank.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        pull = e.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("pull"))
        rank = vertices.select("id").join(pull.withColumnRenamed("dst", "id"), "id", "left").crossJoin(F.broadcast(lost)).select(
            "id", ((1 - damping) / n + damping * (F.coalesce("pull", F.lit(0.0)) + F.col("lost") / n)).alias("rank")
        )
        rank = cut(rank)
    return rank


def cdlp(vertices: DataFrame, edges: DataFrame, iterations: int = 10, directed: bool = True, seeds: DataFrame | None = None) -> DataFrame:
    """(id, label): synchronous label propagation, most frequent label, least on ties.

    In- and out-neighbours count separately; a vertex without neighbours keeps its label.
    """
    e = cut(both_ways(edges.select("src", "dst")))
    label = vertices.select("id", F.col("id").alias("label")) if seeds is None else vertices.select("id").join(seeds, "id")
    for _ in range(iterations):
        votes = e.join(label, F.col("src") == F.col("id")).groupBy("dst", "label").agg(F.count("*").alias("c"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.max_by("label", F.struct(F.col("c"), (-F.col("label")).alias("l"))).alias("new"))
        label = cut(label.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return label


def lcc(vertices: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(id, lcc): edges among the undirected neighbours over k (k - 1); edges are distinct.

    Each undirected triangle is found once, from its end of least degree, so hubs do not
    open all their wedges.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    und = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(1).alias("one"))
    und = cut(und.groupBy("a", "b").agg(F.count("*").alias("w")))
    w = F.col("w").cast("long") if directed else F.lit(2).cast("long")
    und = und.withColumn("w", w)
    deg = und.select(F.col("a").alias("id")).unionByName(und.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("k"))
    ka, kb = deg.select(F.col("id").alias("a"), F.col("k").alias("ka")), deg.select(F.col("id").alias("b"), F.col("k").alias("kb"))
    up = und.join(ka, "a").join(kb, "b").select(
        F.expr("if(struct(ka, a) < struct(kb, b), a, b)").alias("lo"), F.expr("if(struct(ka, a) < struct(kb, b), b, a)").alias("hi"), "a", "b", "w"
    )
    up = cut(up)
    x = up.select("lo", F.col("hi").alias("u"), F.col("w").alias("wu"))
    y = up.select("lo", F.col("hi").alias("v"), F.col("w").alias("wv"))
    wedge = x.join(y, "lo").filter("u < v")
    tri = wedge.join(und.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("w").alias("wuv")), ["u", "v"])
    parts = tri.select(F.explode(F.array(
        F.struct(F.col("lo").alias("id"), F.col("wuv").alias("t")), F.struct(F.col("u").alias("id"), F.col("wv").alias("t")), F.struct(F.col("v").alias("id"), F.col("wu").alias("t"))
    )).alias("p")).select("p.id", "p.t").groupBy("id").agg(F.sum("t").alias("t"))
    out = vertices.select("id").join(deg, "id", "left").join(parts, "id", "left")
    return out.select("id", F.when(F.col("k") > 1, F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(F.lit(0.0)).alias("lcc"))


# -- validators --------------------------------------------------------------------------


def exact(got: DataFrame, want: DataFrame, column: str) -> bool:
    """Same value at every vertex."""
    j = got.select("id", F.col(column).alias("g")).join(want.select("id", F.col(column).alias("w")), "id", "full")
    return j.filter("not (g <=> w)").isEmpty()


def close(got: DataFrame, want: DataFrame, column: str, epsilon: float = 1e-6) -> bool:
    """Values within ``epsilon`` (relative where over 1), infinity equal to itself."""
    j = got.select("id", F.col(column).alias("g")).join(want.select("id", F.col(column).alias("w")), "id", "full")
    bad = F.expr(f"g is null or w is null or (g <> w and (abs(g) = double('infinity') or abs(w) = double('infinity') or not abs(g - w) <= {epsilon} * greatest(1.0, abs(w))))")
    return j.filter(bad).isEmpty()


def same_partition(got: DataFrame, want: DataFrame, column: str) -> bool:
    """Whether labels differ by renaming only."""
    j = got.select("id", F.col(column).alias("g")).join(want.select("id", F.col(column).alias("w")), "id", "full")
    if not j.filter("g is null or w is null").isEmpty():
        return False
    pairs = j.select("g", "w").distinct()
    return all(pairs.groupBy(c).count().filter("count > 1").isEmpty() for c in ("g", "w"))
