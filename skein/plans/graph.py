"""A property graph: one DataFrame for each node label and relationship type, never changed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.lineage import complete, shared_dir
from skein.operators.paths import roots
from skein.sources import views

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


class _Lazy(dict):
    """Tables by name, made when first asked for."""

    def __init__(self, make: Callable[[str], DataFrame], names):
        super().__init__()
        self.make, self.names = make, set(names)

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        self[name] = self.make(name)
        return self[name]

    def __contains__(self, name) -> bool:
        return name in self.names or dict.__contains__(self, name)

    def copy(self) -> "_Lazy":
        out = _Lazy(self.make, self.names)
        out.update(self)
        return out


class PropertyGraph:
    """Named DataFrames; ``sql`` runs a statement over them, with names in braces.

    A node table has ``id``; the first two columns of a relationship table are its ends, the
    rest are its properties. ``label`` (id, label), where a graph has it, lists labels that
    have no table of their own.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables.copy()

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def with_tables(self, **more: DataFrame) -> "PropertyGraph":
        tables = self.tables.copy()
        tables.update(more)
        return PropertyGraph(self.spark, tables)

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        text = views.dialect(text, "spark")
        return self.spark.sql(text, **{n: more[n] if n in more else self.tables[n] for n in views.names(text)})

    # -- nodes ---------------------------------------------------------------------------

    def nodes(self, label: str, /, **where) -> DataFrame:
        """Nodes of a label whose properties have the given values (a list: any of them)."""
        df = self.tables[label] if label in self.tables else self.tables["label"].filter(F.col("label") == label).select("id").distinct()
        for k, v in where.items():
            df = df.filter(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
        return df

    def node(self, label: str, /, **where) -> int | None:
        """The least id with the given property values, or None."""
        return self.nodes(label, **where).agg(F.min("id")).first()[0]

    def nodes_with_property(self, key: str, value=None) -> DataFrame:
        """(id) of nodes of any label that have a property (of a value, if given)."""
        found = []
        for name in sorted(getattr(self.tables, "names", None) or self.tables):
            df = self.tables[name]
            if "id" in df.columns and key in df.columns:
                test = F.col(key).isNotNull() if value is None else F.col(key).cast("string") == str(value)
                found.append(df.filter(test).select("id"))
        if "property" in self.tables:
            df = self.tables["property"].filter(F.col("key") == key)
            found.append((df if value is None else df.filter(F.col("text") == str(value))).select("id"))
        if not found:
            raise KeyError(key)
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def has_label(self, frontier: DataFrame, label: str) -> DataFrame:
        """Rows of ``frontier`` (id) whose node has the label."""
        return frontier.join(self.nodes(label).select("id").distinct(), "id", "left_semi")

    def node_count(self, *labels: str) -> int:
        return sum(self.nodes(x).count() for x in labels)

    def relationship_count(self, *types: str) -> int:
        return sum(self.tables[x].count() for x in types)

    # -- relationships -------------------------------------------------------------------

    def relationships(self, rel: str | list[str] | tuple[str, ...], direction: str = "out") -> DataFrame:
        """(src, dst, type, properties...) of one or more types, seen from ``src``."""
        parts = []
        for name in [rel] if isinstance(rel, str) else rel:
            e = self.tables[name]
            a, b = e.columns[:2]
            rest = [F.col(c) for c in e.columns[2:]]
            for way, x, y in (("out", a, b), ("in", b, a)):
                if direction in (way, "both"):
                    parts.append(e.select(F.col(x).alias("src"), F.col(y).alias("dst"), F.lit(name).alias("type"), *rest))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def traverse(self, frontier: DataFrame, rel, direction: str = "out") -> DataFrame:
        """``relationships`` that start in ``frontier`` (id), with their properties."""
        return self.relationships(rel, direction).join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi")

    def neighbors(self, frontier: DataFrame, rel, direction: str = "out", distinct: bool = False) -> DataFrame:
        """(id) reached from ``frontier`` (id) over one or more types; a multiset unless ``distinct``."""
        e = self.relationships(rel, direction).select("src", "dst")
        out = frontier.select("id").join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
        return out.distinct() if distinct else out

    def neighbors_in(self, frontier: DataFrame, rel, among: DataFrame, direction: str = "out") -> DataFrame:
        """(id) of neighbours that are in ``among`` (id)."""
        return self.neighbors(frontier, rel, direction).join(among.select("id").distinct(), "id", "left_semi")

    def first_neighbor(self, frontier: DataFrame, rel, direction: str = "out") -> DataFrame:
        """(id, neighbor): the least neighbour of each node that has one."""
        e = self.traverse(frontier, rel, direction)
        return e.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("neighbor"))

    def follow(self, frontier: DataFrame, *steps: tuple[str, str]) -> DataFrame:
        """(start, id) after a chain of (type, direction) steps."""
        out = frontier.select(F.col("id").alias("start"), "id")
        for rel, direction in steps:
            e = self.relationships(rel, direction).select("src", "dst")
            out = out.join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"))
        return out

    def has_rel(self, frontier: DataFrame, rel, direction: str = "out") -> DataFrame:
        """Rows of ``frontier`` whose node has such a relationship."""
        return frontier.join(self.relationships(rel, direction).select(F.col("src").alias("id")).distinct(), "id", "left_semi")

    def has_neighbor_with_property(self, frontier: DataFrame, rel, label: str, direction: str = "out", /, **where) -> DataFrame:
        """Rows of ``frontier`` with a neighbour of a label that has the given properties."""
        e = self.relationships(rel, direction).join(self.nodes(label, **where).select(F.col("id").alias("dst")), "dst", "left_semi")
        return frontier.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi")

    # -- aggregates ----------------------------------------------------------------------

    def degree(self, rel, direction: str = "out") -> DataFrame:
        """(id, degree) of nodes with at least one such relationship."""
        return self.relationships(rel, direction).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def neighbor_counts(self, frontier: DataFrame, rel, direction: str = "out", distinct: bool = False) -> DataFrame:
        """(id, n): how often each neighbour is reached, or from how many nodes if ``distinct``."""
        e = self.traverse(frontier, rel, direction).select("src", F.col("dst").alias("id"))
        return (e.distinct() if distinct else e).groupBy("id").agg(F.count("*").alias("n"))

    def neighbor_groups(self, frontier: DataFrame, rel, direction: str, project: DataFrame) -> DataFrame:
        """(id, group, n): sizes of the cohorts of each node's neighbours, which ``project`` (id, group) names."""
        e = self.traverse(frontier, rel, direction).select(F.col("src").alias("of"), F.col("dst").alias("id"))
        return e.join(project, "id").groupBy(F.col("of").alias("id"), "group").agg(F.count("*").alias("n"))

    def top_by_size(self, groups: DataFrame, k: int) -> DataFrame:
        """The ``k`` nodes (id, n) whose largest cohort is largest; ties by id."""
        return groups.groupBy("id").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "id").limit(k)

    def co_occurring(self, rel: str, direction: str = "out", least: int = 1) -> DataFrame:
        """(a, b, n): pairs a < b of ends that share at least ``least`` of the nodes they hang on."""
        e = self.relationships(rel, direction).select("src", "dst").distinct()
        x, y = e.select("src", F.col("dst").alias("a")), e.select("src", F.col("dst").alias("b"))
        return x.join(y, "src").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)

    def fold_via(self, rel: str, a: DataFrame, b: DataFrame, value: Column | None = None) -> DataFrame:
        """(a, b, n): relationships carried over to other nodes, both ends looked up in ``a`` and ``b`` (id, via).

        For instance replies between messages, folded to replies between their creators.
        ``value`` is summed over the relationship's columns; without it, relationships are counted.
        """
        e = self.relationships(rel)
        if value is not None:
            e = e.withColumn("value", value)
        x = a.select(F.col("id").alias("src"), F.col("via").alias("a"))
        y = b.select(F.col("id").alias("dst"), F.col("via").alias("b"))
        total = F.count("*") if value is None else F.sum("value")
        return e.join(x, "src").join(y, "dst").groupBy("a", "b").agg(total.alias("n"))

    def aggregate(self, *labels: str) -> "Aggregate":
        """Start an aggregation over the nodes of some labels (their common columns)."""
        parts = [self.nodes(x).withColumn("label", F.lit(x)) for x in labels]
        both = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        out = parts[0].select(*both)
        for p in parts[1:]:
            out = out.unionByName(p.select(*both))
        return Aggregate(self, out)


class Aggregate:
    """A fluent aggregation: where, through, by, by_label, bin, then run; each step gives a new one."""

    def __init__(self, graph: PropertyGraph, rows: DataFrame, keys: tuple = (), measures: tuple = (), least: tuple = ()):
        self.graph, self.rows, self.keys, self.measures, self.least = graph, rows, keys, measures, least

    def _with(self, **new) -> "Aggregate":
        return Aggregate(**{"graph": self.graph, "rows": self.rows, "keys": self.keys, "measures": self.measures, "least": self.least, **new})

    def where(self, test) -> "Aggregate":
        """Keep nodes that pass a condition (SQL text or a column)."""
        return self._with(rows=self.rows.filter(test))

    def where_in(self, nodes: DataFrame) -> "Aggregate":
        return self._with(rows=self.rows.join(nodes.select("id").distinct(), "id", "left_semi"))

    def through(self, rel, direction: str = "out", name: str = "via") -> "Aggregate":
        """One row for each neighbour, whose id is the column ``name``."""
        e = self.graph.relationships(rel, direction).select(F.col("src").alias("id"), F.col("dst").alias(name))
        return self._with(rows=self.rows.join(e, "id"))

    def by(self, *columns) -> "Aggregate":
        return self._with(keys=self.keys + columns)

    def by_label(self) -> "Aggregate":
        return self.by("label")

    def bin(self, column: str, edges: list, name: str = "bin") -> "Aggregate":
        """Group by how many of the rising ``edges`` a value reaches."""
        return self.by(sum(((F.col(column) >= e).cast("int") for e in edges), F.lit(0)).alias(name))

    def count(self, name: str = "n") -> "Aggregate":
        return self._with(measures=self.measures + (F.count("*").alias(name),))

    def sum(self, column: str, name: str | None = None) -> "Aggregate":
        return self._with(measures=self.measures + (F.sum(column).alias(name or f"{column}_sum"),))

    def count_distinct(self, column: str, name: str) -> "Aggregate":
        return self._with(measures=self.measures + (F.countDistinct(column).alias(name),))

    def having(self, test) -> "Aggregate":
        return self._with(least=self.least + (test,))

    def run(self) -> DataFrame:
        out = self.rows.groupBy(*self.keys).agg(*(self.measures or (F.count("*").alias("n"),)))
        for test in self.least:
            out = out.filter(test)
        return out


class Snapshots:
    """Named versions of graphs."""

    def __init__(self):
        self._held: dict[str, PropertyGraph] = {}

    def publish(self, version: str, graph: PropertyGraph) -> None:
        if version in self._held:
            raise ValueError(f"version {version} exists; snapshots are not changed")
        self._held[version] = graph

    def versions(self) -> list[str]:
        return list(self._held)

    def graph(self, version: str) -> PropertyGraph:
        return self._held[version]


def _mark(spark: SparkSession, paths: list[str]) -> str:
    """What tells versions of files apart: their names, lengths and times."""
    found = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}" for x in fs.listStatus(p)]
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:24]


def build(spark: SparkSession, sf_dir: str, view: dict[str, str], stored: bool = True) -> PropertyGraph:
    """A graph view of the driver tables, lazy.

    ``stored``: a table of the view is written once, in the shared folder, when it is first
    needed, and later queries of this application read it as long as the files it was made
    from are the same.
    """
    needed = {n for sql in view.values() for n in views.names(sql)}
    base = [t for t in TABLES if t in needed]
    folder = None

    def make(name: str) -> DataFrame:
        nonlocal folder
        if name in base:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if folder is None and stored:
            mark = _mark(spark, [f"{sf_dir}/{t}.parquet" for t in base])
            folder = f"{shared_dir(spark).rstrip('/')}/graph-{spark.sparkContext.applicationId}-{mark}"
        path = f"{folder}/{name}"
        if not stored or not complete(spark, path):
            made = _threads(g) if name == "thread" else g.sql(view[name])
            if not stored:
                return made
            made.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    g = PropertyGraph(spark, _Lazy(make, [*base, *view, *(["thread"] if "message" in view else [])]))
    return g


def _threads(g: PropertyGraph) -> DataFrame:
    top = roots(g["message"].select("id", "parent"))
    thread = top.join(g["post"].select(F.col("id").alias("root"), "forum", F.col("lang").alias("root_lang"), F.col("creator").alias("starter"), F.col("day").alias("root_day")), "root")
    return thread.select("id", "root", "forum", "root_lang", "starter", "root_day")


def with_roots(g: PropertyGraph) -> PropertyGraph:
    """Add ``thread``: every message with the post its replies lead up to, and that post's forum."""
    return g.with_tables(thread=_threads(g))
