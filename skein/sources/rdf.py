"""N-Triples and N-Quads to a graph, with closure of classes and properties.

Lines are parsed with one anchored pattern in the JVM; only IRIs with ``%`` or a backslash
and literals with a backslash go through an Arrow function that decodes them.
"""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.paths import closure
from skein.plans.graph import PropertyGraph

_LINE = (
    r"^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+"
    r'(?:<([^>]*)>|_:([^\s.]+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)'
)
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", re.S)
#: Escapes of the format, and the kinds of its number types.
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_INTEGERS = ("int", "integer", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")
_DECIMALS = ("double", "float", "decimal")
_TYPE, _SUBCLASS, _SUBPROPERTY = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "http://www.w3.org/2000/01/rdf-schema#subPropertyOf",
)
_TOP = "http://www.w3.org/2002/07/owl#Thing"


def unescape(text: str) -> str:
    """Undo \\n, \\uXXXX and the like; any other escaped character stands for itself with its backslash."""
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROLS.get(m[3], m[0]), text)


def canonical(iri: str) -> str:
    """Unescaped and percent-decoded; kept as it is where the result is not UTF-8."""
    iri = unescape(iri)
    try:
        return unquote_to_bytes(iri).decode("utf-8")
    except UnicodeDecodeError:
        return iri


def local_name(c):
    return F.element_at(F.split(F.element_at(F.split(c, "#"), -1), "/"), -1)


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else canonical(x))


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unescape(x))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(pos, subject, predicate, object, kind, datatype, lang); blank, comment and malformed lines drop out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value").filter(F.col("value").rlike(_LINE))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    t = lines.select(
        "pos", part(1).alias("s"), part(2).alias("sb"), part(3).alias("p"), part(4).alias("o"), part(5).alias("ob"), part(6).alias("lit"), part(7).alias("dt"), part(8).alias("lang"),
        F.col("value").rlike(r'^\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+"').alias("literal"),
    )
    odd = lambda c: F.when(F.instr(c, "%").cast("boolean") | F.contains(c, F.lit("\\")), _canonical(c)).otherwise(F.col(c))
    text = F.when(F.contains(F.col("lit"), F.lit("\\")), _unescaped("lit")).otherwise(F.col("lit"))
    node = lambda iri, blank: F.when(F.col(blank) != "", F.concat(F.lit("B:"), F.col(blank))).otherwise(F.concat(F.lit("I:"), odd(iri)))
    return t.select(
        "pos", node("s", "sb").alias("subject"), odd("p").alias("predicate"),
        F.when(F.col("literal"), text).otherwise(node("o", "ob")).alias("object"),
        F.when(F.col("literal"), "literal").when(F.col("ob") != "", "blank").otherwise("iri").alias("kind"),
        F.nullif("dt", F.lit("")).alias("datatype"), F.nullif("lang", F.lit("")).alias("lang"),
    )


def load_rdf(spark: SparkSession, path: str) -> PropertyGraph:
    """Tables resource (id, uri), label (id, label), rel (src, type, dst) and property (id, key, text, number, integer, truth).

    Labels and relationships include all super-classes (but owl:Thing) and super-properties;
    of several literals the first in the file stays; schema triples are no data.
    """
    t = triples(spark, path)
    schema = t.filter(F.col("predicate").isin(_SUBCLASS, _SUBPROPERTY))
    data = t.filter(~F.col("predicate").isin(_SUBCLASS, _SUBPROPERTY))
    edges = lambda p: schema.filter(F.col("predicate") == p).select(F.substring("subject", 3, 10**6).alias("src"), F.substring("object", 3, 10**6).alias("dst"))
    classes, properties = closure(edges(_SUBCLASS)), closure(edges(_SUBPROPERTY))
    typed = data.filter((F.col("predicate") == _TYPE) & (F.col("kind") == "iri")).select(F.col("subject").alias("id"), F.substring("object", 3, 10**6).alias("class"))
    up = typed.join(classes, F.col("class") == classes["id"], "left").select(typed["id"], F.coalesce("up", "class").alias("class"))
    label = up.filter(F.col("class") != _TOP).select("id", local_name(F.col("class")).alias("label")).distinct()
    links = data.filter((F.col("predicate") != _TYPE) & (F.col("kind") != "literal"))
    rel = links.join(properties, F.col("predicate") == properties["id"], "left").select(
        F.col("subject").alias("src"), local_name(F.coalesce("up", "predicate")).alias("type"), F.col("object").alias("dst")
    )
    lit = data.filter("kind = 'literal'").groupBy(F.col("subject").alias("id"), local_name(F.col("predicate")).alias("key")).agg(F.min_by(F.struct("object", "datatype"), "pos").alias("v"))
    kind = local_name(F.coalesce("v.datatype", F.lit("string")))
    raw = F.col("v.object")
    prop = lit.select(
        "id", "key", F.nullif(raw, F.lit("")).alias("text"), F.when(kind.isin(*_DECIMALS), raw.try_cast("double")).alias("number"),
        F.when(kind.isin(*_INTEGERS), raw.try_cast("long")).alias("integer"), F.when(kind == "boolean", raw.isin("true", "1")).alias("truth"),
    )
    ids = data.select(F.col("subject").alias("id")).union(links.select("object")).distinct()
    return PropertyGraph(spark, {"resource": ids.select("id", F.substring("id", 3, 10**6).alias("uri")), "label": label, "rel": rel, "property": prop})


#: Classes of works that the queries tell apart.
_WORKS = ("BlogPost", "NewsItem", "Programme")


def publishing(g: PropertyGraph) -> PropertyGraph:
    """The tables of the publishing queries (work, entity, kind, about, mentions, tagged, content_of), out of ``load_rdf``.

    Works are the resources labelled CreativeWork or one of its kinds; an entity is what a
    work is about or mentions. Ids are those of the resources (``I:`` or ``B:`` and the
    name). A category, audience, format or thumbnail is the uri it links to or its literal,
    the least one where a work has several; ``tagged`` is about and mentions together with
    any ``tag`` that is neither.
    """
    resource, label, rel, prop = (g[t] for t in ("resource", "label", "rel", "property"))

    def text(key: str) -> DataFrame:
        return prop.filter(F.col("key") == key).select("id", F.col("text").alias(key))

    def target(kind: str) -> DataFrame:
        linked = rel.filter(F.col("type") == kind).select(F.col("src").alias("id"), F.substring("dst", 3, 10**6).alias(kind))
        return linked.unionByName(text(kind).filter(F.col(kind).isNotNull())).groupBy("id").agg(F.min(kind).alias(kind))

    def links(*kinds: str) -> DataFrame:
        return rel.filter(F.col("type").isin(*kinds)).select(F.col("src").alias("work"), F.col("dst").alias("entity")).distinct().join(works.select(F.col("id").alias("work")), "work", "left_semi")

    kind = F.min(F.when(F.col("label").isin(*_WORKS), F.col("label"))).alias("type")
    works = label.filter(F.col("label").isin("CreativeWork", *_WORKS)).groupBy("id").agg(kind)
    live = prop.filter(F.col("key") == "liveCoverage").select("id", F.coalesce("truth", F.col("text") == "true").alias("live"))
    work = works.join(resource, "id")
    for t in [*(text(k) for k in ("title", "description", "dateCreated", "dateModified")), *(target(k) for k in ("category", "audience", "primaryFormat", "thumbnail")), live]:
        work = work.join(t, "id", "left")
    work = work.select(
        "id", "uri", "title", "description", "type", "category", "audience", "live", F.col("primaryFormat").alias("format"), "thumbnail",
        F.col("dateCreated").alias("created"), F.col("dateModified").alias("modified"),
    )
    about, mentions = links("about"), links("mentions")
    tagged = links("about", "mentions", "tag")
    number = lambda key, name: prop.filter(F.col("key") == key).select("id", F.coalesce("number", F.col("text").try_cast("double")).alias(name))
    entity = tagged.select(F.col("entity").alias("id")).distinct().join(resource, "id")
    for t in (text("label"), text("name"), number("lat", "lat"), number("long", "lon")):
        entity = entity.join(t, "id", "left")
    docs = rel.filter("type = 'primaryContentOf'").select(F.col("src").alias("work"), F.col("dst").alias("at"))
    web = target("webDocumentType").select(F.col("id").alias("at"), F.col("webDocumentType").alias("web_type"))
    content = docs.join(web, "at", "left").select("work", F.substring("at", 3, 10**6).alias("doc"), "web_type")
    return PropertyGraph(g.spark, {
        "work": work, "entity": entity.select("id", "uri", F.coalesce("label", "name").alias("label"), "lat", "lon"),
        "kind": label.select(F.col("id").alias("entity"), F.col("label").alias("kind")).join(entity.select(F.col("id").alias("entity")), "entity", "left_semi"),
        "about": about, "mentions": mentions, "tagged": tagged, "content_of": content,
    })
