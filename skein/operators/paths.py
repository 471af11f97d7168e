"""Hop distances, weighted shortest paths, closures and forest roots.

Edges are DataFrames (src, dst[, weight]); each loop round is one join and one aggregation,
with only the nodes that changed as its frontier, and ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both orientations, columns kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def hops(edges: DataFrame, sources: DataFrame, most: int | None = None, target: int | None = None) -> DataFrame:
    """(id, d): fewest hops from any of ``sources`` (id); d is 0 at a source; unreached absent.

    Small bounds are unrolled into one plan; otherwise a level loop that stops when no new
    node appears, at ``most``, or at the level that reaches ``target``.
    """
    seen = sources.select(F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("d")).distinct()
    pairs = edges.select("src", "dst").distinct()
    if most is not None and most <= 3:
        frontier = seen
        for d in range(1, most + 1):
            frontier = frontier.join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(d).cast("long").alias("d")).distinct()
            seen = seen.unionByName(frontier)
        return seen.groupBy("id").agg(F.min("d").alias("d"))
    seen = frontier = cut(seen)
    d = 0
    while most is None or d < most:
        d += 1
        new = frontier.join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(seen, "id", "left_anti").withColumn("d", F.lit(d).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if target is not None and not frontier.filter(F.col("id") == target).isEmpty():
            break
        if d % 8 == 0:
            seen = cut(seen)
    return seen


def relax(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, nearest: int = 1) -> DataFrame:
    """(source, id, dist): least sum of non-negative ``weight`` from each source; unreached absent.

    ``sources`` has (source, id). Null weights are edges that cannot be walked. With
    ``targets`` (id) only the ``nearest`` pairs of a source and a target (and their ties) need
    be right: what is farther than these are so far is not walked on, so the loop ends early
    and other distances may be missing or too long.
    """
    e = edges.filter("weight is not null").groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"))
    e = cut(e)
    best = frontier = cut(sources.select("source", "id", F.lit(0.0).alias("dist")).distinct())
    k = 0
    while True:
        step = frontier.join(e, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(
            F.min(F.col("dist") + F.col("weight")).alias("dist")
        )
        old = best.withColumnRenamed("dist", "old")
        better = step.join(old, ["source", "id"], "left").filter("old is null or dist < old").select("source", "id", "dist")
        if targets is not None:
            found = best.join(targets.select("id").distinct(), "id", "left_semi").filter("source <> id").orderBy("dist").limit(nearest).select("dist").collect()
            if len(found) == nearest:
                better = better.filter(F.col("dist") <= found[-1]["dist"])
        frontier = cut(better)
        if frontier.isEmpty():
            return best
        best = best.unionByName(frontier).groupBy("source", "id").agg(F.min("dist").alias("dist"))
        k += 1
        if k % 4 == 0:
            best = cut(best)


def same_component(components: DataFrame, a: int, b: int) -> bool:
    """Whether two nodes have the same component in (id, component), as ``wcc`` gives it: a pre-check for paths."""
    found = components.filter(F.col("id").isin(a, b)).select("component").collect()
    return len(found) == (1 if a == b else 2) and len({r["component"] for r in found}) == 1


def closure(edges: DataFrame) -> DataFrame:
    """(id, up): every node of an acyclic or cyclic ``edges`` with all it reaches, itself included."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    all_ = cut(nodes.select("id", F.col("id").alias("up")))
    frontier = all_
    while True:
        new = frontier.join(edges, F.col("up") == F.col("src")).select("id", F.col("dst").alias("up")).distinct()
        frontier = cut(new.join(all_, ["id", "up"], "left_anti"))
        if frontier.isEmpty():
            return all_
        all_ = cut(all_.unionByName(frontier))


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of a functional relation (id, parent), by pointer jumping.

    A node without a parent is its own root; a parent that is no node itself counts as one.
    The number of rounds is the logarithm of the depth.
    """
    at = cut(parents.select("id", F.coalesce("parent", "id").alias("root")))
    while True:
        up = at.select(F.col("id").alias("mid"), F.col("root").alias("top"))
        new = cut(at.join(up, F.col("root") == F.col("mid"), "left").select("id", F.coalesce("top", "root").alias("root"), F.coalesce(F.col("top") != F.col("root"), F.lit(False)).alias("moved")))
        at = new.select("id", "root")
        if new.filter("moved").isEmpty():
            return at
