"""Query functions by name, for the library's families, and the DuckDB SQL of each.

A query is SQL text over a graph view; derived tables that plain SQL can't make well (hop
distances, weighted distances, closures, thread roots, word hits) come from operators. For
DuckDB the same tables are recursive or unrolled CTEs written apart from the operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.search import full_text_search, full_text_search_ranked, geo_knn
from skein.operators import algorithms, paths
from skein.plans import bi, finance, independent, interactive, publishing, surface
from skein.plans.graph import PropertyGraph, build, with_roots
from skein.sources import views

FAMILIES = {"social": views.SOCIAL, "finance": views.FINANCE, "publishing": views.PUBLISHING}


def bind(sql: str, params: dict) -> str:
    """Put literals in the place of ``:name``; a tuple or list becomes literals with commas."""
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return ", ".join(map(literal, v))
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return re.sub(r"(?<![:\w]):([a-z_]\w*)", lambda m: literal(params[m[1]]), sql)


def family(name: str) -> str:
    if name.startswith("spb"):
        return "publishing"
    return "finance" if name in finance.QUERIES else "social"


def text(name: str) -> tuple[str, dict]:
    for m in (bi, interactive, finance, publishing):
        if name in m.QUERIES:
            return m.QUERIES[name]
    raise KeyError(name)


# -- derived tables, as DataFrames --------------------------------------------------------


def near(g: PropertyGraph, name: str, p: dict) -> DataFrame:
    spark = g.spark
    one = lambda v: spark.createDataFrame([(v,)], "id long")
    if name in ("cr3", "trace_transfers_in"):
        e = g["transfer"].filter(F.col("ts").between(p["lo"], p["hi"]))
        if name == "trace_transfers_in":
            e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return paths.hops(e, one(p["account"]), p.get("hops"), p.get("target"))
    if name == "cr11":
        return paths.hops(g["guarantee"], one(p["person"]))
    return paths.hops(g["knows"], one(p["person"]), p.get("hops", p.get("max")), p.get("target"))


def reach(g: PropertyGraph, name: str, p: dict) -> DataFrame:
    """Distances; only the targets that the query can return need be right."""
    one = lambda v, schema: g.spark.createDataFrame([(v,) * (schema.count(",") + 1)], schema)
    if name == "bi_q19":
        city = lambda c: g["person"].filter(F.col("city") == p[c])
        start, end, nearest = city("city1").select(F.col("id").alias("source"), "id"), city("city2"), 20
    else:
        start = one(p.get("source", p.get("person")), "source long, id long")
        end, nearest = (one(p["target"], "id long"), 1) if "target" in p else (g["work_at"].filter(F.col("org") == p["org"]).select(F.col("person").alias("id")), 20)
    return paths.relax(g.sql(bind(bi.WEIGHTS[name], p)), start, end, nearest)


def under(g: PropertyGraph, name: str, p: dict) -> DataFrame:
    return paths.closure(g["tagclass"].filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst")))


def hits(g: PropertyGraph, name: str, p: dict) -> DataFrame:
    """Works with the words; one made of a document is searched in the whole of its text."""
    if "documents" in g:
        docs = g["documents"].select(F.col("doc_id").alias("id"), "text")
        return full_text_search(docs, ["text"], p["words"])
    return full_text_search(g["work"], p["fields"].split(","), p["words"])


DERIVED = {"near": near, "reach": reach, "under": under, "hits": hits}


def run(name: str, g: PropertyGraph, **params) -> DataFrame:
    """Run a query of any family over a graph with that family's tables."""
    sql, defaults = text(name)
    p = {**defaults, **params}
    if family(name) == "finance" and p.get("limit", 0) > finance.MOST:
        raise ValueError(f"limit is {finance.MOST} at most")
    needed = set(views.names(sql)) | (set(views.names(bi.WEIGHTS[name])) if name in bi.WEIGHTS else set())
    if "thread" in needed and "thread" not in g:
        g = with_roots(g)
    for t, make in DERIVED.items():
        if t in needed and t not in g:
            g = g.with_tables(**{t: make(g, name, p)})
    return g.sql(bind(sql, p))


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, build(spark, sf_dir, FAMILIES[family(name)]))

    return call


# -- the same for DuckDB ------------------------------------------------------------------


def _near_sql(name: str, p: dict) -> str:
    edges, start = "SELECT src, dst FROM {knows}", p.get("person")
    if name in ("cr3", "trace_transfers_in"):
        a, b = ("src", "dst") if name == "cr3" else ("dst", "src")
        edges, start = f"SELECT DISTINCT {a} AS src, {b} AS dst FROM {{transfer}} WHERE ts BETWEEN {p['lo']} AND {p['hi']}", p["account"]
    if name == "cr11":
        edges = "SELECT src, dst FROM {guarantee}"
    most = p.get("hops", p.get("max", 25))
    return (
        f"near_e AS ({edges}), near_b AS (SELECT CAST({start} AS BIGINT) AS id, CAST(0 AS BIGINT) AS d UNION SELECT e.dst, b.d + 1 FROM near_b b JOIN near_e e ON e.src = b.id WHERE b.d < {most}),"
        " near AS (SELECT id, min(d) AS d FROM near_b GROUP BY id)"
    )


def _relaxed(start: str, rounds: int = 24) -> str:
    parts = ["reach_0 AS MATERIALIZED (" + start + ")"]
    for k in range(1, rounds + 1):
        parts.append(
            f"reach_{k} AS MATERIALIZED (SELECT source, id, min(dist) AS dist FROM (SELECT * FROM reach_{k - 1} UNION ALL"
            f" SELECT r.source, w.dst, r.dist + w.weight FROM reach_{k - 1} r JOIN reach_w w ON w.src = r.id) x GROUP BY source, id)"
        )
    return ", ".join(parts) + f", reach AS (SELECT * FROM reach_{rounds})"


def _reach_sql(name: str, p: dict) -> str:
    at = p.get("source", p.get("person"))
    start = (
        f"SELECT id AS source, id, CAST(0 AS DOUBLE) AS dist FROM {{person}} WHERE city = {p['city1']}" if name == "bi_q19"
        else f"SELECT CAST({at} AS BIGINT) AS source, CAST({at} AS BIGINT) AS id, CAST(0 AS DOUBLE) AS dist"
    )
    return f"reach_w AS MATERIALIZED ({bind(bi.WEIGHTS[name], p)}), " + _relaxed(start)


def _hits_sql(name: str, p: dict) -> str:
    words = ", ".join(f"'{w}'" for w in p["words"].split())
    return f"hits AS (SELECT doc_id AS id FROM documents WHERE list_has_all(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), [{words}]))"


_THREAD = (
    "thread_up AS (SELECT id, id AS at FROM {message} UNION ALL SELECT u.id, c.parent FROM thread_up u JOIN {comment} c ON c.id = u.at),"
    " thread AS (SELECT u.id, p.id AS root, p.forum, p.lang AS root_lang, p.creator AS starter, p.day AS root_day FROM thread_up u JOIN {post} p ON p.id = u.at)"
)
_UNDER = (
    "under AS (SELECT id, id AS up FROM {tagclass} UNION SELECT u.id, c.parent FROM under u JOIN {tagclass} c ON c.id = u.up WHERE c.parent IS NOT NULL)"
)
_NAMES = re.compile(r"\{([a-z]\w+)\}")


def assemble(sql: str, view: dict[str, str], derived: dict[str, str]) -> str:
    """One DuckDB statement: the views and derived tables it needs as CTEs, then the query."""
    ctes: list[str] = []
    done: set[str] = set()

    def need(s: str) -> None:
        for n in _NAMES.findall(s):
            if n in done:
                continue
            done.add(n)
            if n in derived:
                need(derived[n])
                ctes.append(derived[n])
            elif n in view:
                need(view[n])
                ctes.append(f"{n} AS MATERIALIZED ({view[n]})")

    need(sql)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        body = ""
    head = "WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else ""
    return _NAMES.sub(r"\1", views.dialect(head + body, "duckdb"))


def oracle(name: str) -> str:
    """DuckDB SQL of a family query: a text of its own where there is one, else the query's."""
    sql, p = text(name)
    sql = independent.SQL.get(name, sql)
    derived = {"thread": _THREAD, "under": _UNDER}
    needed = views.names(sql)
    if "near" in needed:
        derived["near"] = _near_sql(name, p)
    if "reach" in needed:
        derived["reach"] = _reach_sql(name, p)
    if "hits" in needed:
        derived["hits"] = _hits_sql(name, p)
    return assemble(bind(sql, p), FAMILIES[family(name)], derived)


# -- algorithms on the transfer graph -----------------------------------------------------


def _transfers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = build(spark, sf_dir, views.FINANCE)
    return g["account"].select("id"), g["transfer"].select("src", "dst", F.col("amt").alias("weight"))


def ga_bfs(spark, sf_dir):
    return algorithms.bfs(*_transfers(spark, sf_dir), 76)


def ga_sssp(spark, sf_dir):
    return algorithms.sssp(*_transfers(spark, sf_dir), 76).select("id", F.round("dist", 6).alias("dist"))


def ga_wcc(spark, sf_dir):
    return algorithms.wcc(*_transfers(spark, sf_dir))


def ga_pagerank(spark, sf_dir):
    return algorithms.pagerank(*_transfers(spark, sf_dir)).select("id", F.round("rank", 6).alias("rank"))


def ga_cdlp(spark, sf_dir):
    return algorithms.cdlp(*_transfers(spark, sf_dir), iterations=5)


def ga_lcc(spark, sf_dir):
    v, e = _transfers(spark, sf_dir)
    return algorithms.lcc(v, e).select("id", F.round("lcc", 6).alias("lcc"))


def _unrolled(first: str, step: str, rounds: int) -> str:
    parts = [f"k0 AS MATERIALIZED ({first})"] + [f"k{i} AS MATERIALIZED ({step.replace('@', f'k{i - 1}')})" for i in range(1, rounds + 1)]
    return ", ".join(parts)


_E = "e AS MATERIALIZED (SELECT src, dst, amt AS weight FROM {transfer})"
_BOTH = "u AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
ALGORITHM_SQL = {
    "ga_bfs": f"WITH {_E}, b AS (SELECT CAST(76 AS BIGINT) AS id, CAST(0 AS BIGINT) AS d UNION SELECT e.dst, b.d + 1 FROM b JOIN e ON e.src = b.id WHERE b.d < 12)"
    " SELECT a.id, coalesce(min(b.d), 9223372036854775807) AS depth FROM {account} a LEFT JOIN b ON b.id = a.id GROUP BY a.id",
    "ga_sssp": f"WITH {_E}, reach_w AS MATERIALIZED (SELECT src, dst, min(weight) AS weight FROM e GROUP BY src, dst), {_relaxed('SELECT CAST(76 AS BIGINT) AS source, CAST(76 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS dist')}"
    " SELECT a.id, round(coalesce(r.dist, CAST('Infinity' AS DOUBLE)), 6) AS dist FROM {account} a LEFT JOIN reach r ON r.id = a.id",
    "ga_wcc": f"WITH {_E}, {_BOTH}, c AS (SELECT id, id AS c FROM {{account}} UNION SELECT u.dst, c.c FROM c JOIN u ON u.src = c.id) SELECT id, min(c) AS component FROM c GROUP BY id",
    "ga_pagerank": f"WITH {_E}, deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src), n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM {{account}}), "
    + _unrolled(
        "SELECT id, 1.0 / n AS rank FROM {account} CROSS JOIN n",
        "SELECT a.id, 0.15 / n.n + 0.85 * (coalesce(x.pull, 0) + l.lost / n.n) AS rank FROM {account} a CROSS JOIN n"
        " CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM @ WHERE id NOT IN (SELECT src FROM deg)) l"
        " LEFT JOIN (SELECT e.dst, sum(r.rank / d.deg) AS pull FROM e JOIN @ r ON r.id = e.src JOIN deg d ON d.src = e.src GROUP BY e.dst) x ON x.dst = a.id", 10)
    + " SELECT id, round(rank, 6) AS rank FROM k10",
    "ga_cdlp": f"WITH {_E}, {_BOTH}, " + _unrolled(
        "SELECT id, id AS label FROM {account}",
        "SELECT k.id, coalesce(v.label, k.label) AS label FROM @ k LEFT JOIN (SELECT id, label FROM (SELECT u.dst AS id, l.label, row_number() OVER (PARTITION BY u.dst ORDER BY count(*) DESC, l.label) AS rn"
        " FROM u JOIN @ l ON l.id = u.src GROUP BY u.dst, l.label) y WHERE rn = 1) v ON v.id = k.id", 5)
    + " SELECT id, label FROM k5",
    "ga_lcc": "WITH e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {transfer}), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),"
    " k AS (SELECT a, count(*) AS k FROM u GROUP BY a), t AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON y.a = x.a JOIN e ON e.src = x.b AND e.dst = y.b GROUP BY x.a)"
    " SELECT a.id, round(CASE WHEN k.k > 1 THEN coalesce(t.t, 0) / (k.k * (k.k - 1)) ELSE 0.0 END, 6) AS lcc FROM {account} a LEFT JOIN k ON k.a = a.id LEFT JOIN t ON t.a = a.id",
}
ALGORITHMS = {f.__name__: f for f in (ga_bfs, ga_sssp, ga_wcc, ga_pagerank, ga_cdlp, ga_lcc)}


# -- words and places ---------------------------------------------------------------------


def fts_bm25(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return full_text_search_ranked(docs, "text", "the of", 10).select("id", F.round("score", 6).alias("score"))


def geo_nearest(spark, sf_dir):
    g = build(spark, sf_dir, views.PUBLISHING)
    return geo_knn(g["entity"], 10.0, 20.0, 10).select("id", F.round("km", 6).alias("km"))


SEARCH = {f.__name__: f for f in (fts_bm25, geo_nearest)}
SEARCH_SQL = {
    "fts_bm25": """
        WITH d AS (SELECT doc_id AS id, [t for t in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if t <> ''] AS w FROM documents),
        f AS (SELECT id, len(w) AS n, len([x for x in w if x = 'the']) AS a, len([x for x in w if x = 'of']) AS b FROM d),
        s AS (SELECT count(*) AS docs, avg(n) AS avg_n, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
        SELECT id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / avg_n)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / avg_n)), 6) AS score
        FROM f CROSS JOIN s WHERE a > 0 OR b > 0 ORDER BY ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / avg_n)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / avg_n)) DESC, id LIMIT 10""",
    "geo_nearest": """
        SELECT id, round(2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * power(sin(radians(lon - 20.0) / 2), 2)))), 6) AS km
        FROM {entity} WHERE lat IS NOT NULL AND lon IS NOT NULL
        ORDER BY 2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * power(sin(radians(lon - 20.0) / 2), 2)))), id LIMIT 10""",
}

NAMES = [*bi.QUERIES, *interactive.QUERIES, *finance.QUERIES, *publishing.QUERIES]


def _surface(f, view: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(build(spark, sf_dir, view))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {f"graph_{f.__name__}": _surface(f, FAMILIES[k]) for k, fs in surface.QUERIES.items() for f in fs}
    return {**{n: query(n) for n in NAMES}, **ALGORITHMS, **SEARCH, **more}


def oracles() -> dict[str, str]:
    out = {n: oracle(n) for n in NAMES}
    out.update({n: assemble(s, views.FINANCE, {}) for n, s in ALGORITHM_SQL.items()})
    out["fts_bm25"] = SEARCH_SQL["fts_bm25"]
    out["geo_nearest"] = assemble(SEARCH_SQL["geo_nearest"], views.PUBLISHING, {})
    out.update({f"graph_{f.__name__}": assemble(surface.SQL[f.__name__], FAMILIES[k], {}) for k, fs in surface.QUERIES.items() for f in fs})
    return out
