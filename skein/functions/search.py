"""Full text and places: whole-word search, BM25, distances on the sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088


def tokens(column):
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def full_text_search(nodes: DataFrame, fields: list[str], query: str) -> DataFrame:
    """(id) of nodes with every term of ``query`` as a whole word in one of the fields; no term, no hit."""
    want = terms(query)
    if not want:
        return nodes.select("id").limit(0)
    hit = F.lit(False)
    for f in fields:
        hit = hit | (F.size(F.array_intersect(tokens(F.col(f)), F.array(*map(F.lit, want)))) == len(want))
    return nodes.filter(hit).select("id")


def full_text_search_ranked(nodes: DataFrame, field: str, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` (id, score) by BM25; any term counts. Ties go by id.

    Only rows with a query term are exploded; the three corpus figures are one aggregation.
    """
    want = terms(query)
    if not want:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    toks = nodes.select("id", tokens(F.col(field)).alias("w")).withColumn("n", F.size("w"))
    def times(t):
        return F.size(F.filter("w", lambda x: x == t))

    tfs = [times(t).alias(f"t{i}") for i, t in enumerate(want)]
    toks = toks.select("id", "n", *tfs)
    stats = toks.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(want))))
    rows = toks.filter(" or ".join(f"t{i} > 0" for i in range(len(want)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(want)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"t{i}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("avg_n")))
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def haversine_km(lat1, lon1, lat2, lon2):
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geo_within_radius(nodes: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """(id, km) within a radius; a latitude band filters first (it reaches the scan)."""
    band = km / 110.0
    d = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return nodes.filter(F.col("lat").between(lat - band, lat + band)).select("id", d.alias("km")).filter(F.col("km") <= km)


def geo_within_bbox(nodes: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """(id) inside an inclusive box."""
    return nodes.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon)).select("id")


def geo_knn(nodes: DataFrame, lat: float, lon: float, k: int) -> DataFrame:
    """The ``k`` nearest (id, km); ties by id."""
    return nodes.filter("lat is not null and lon is not null").select("id", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")).alias("km")).orderBy("km", "id").limit(k)
