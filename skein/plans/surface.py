"""Queries that use the graph's lookups, traversals and aggregates themselves, with DuckDB SQL written apart.

They run on the social and the publishing view; each is one operator of the surface with
whole tables as its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.search import geo_within_bbox, geo_within_radius
from skein.operators.algorithms import wcc
from skein.plans.graph import PropertyGraph


def _fans(g: PropertyGraph) -> DataFrame:
    return g.neighbors(g.nodes("tag", name="tag50"), "interest", "in", True)


def nodes_with_label(g):
    """Posts in some languages from one country."""
    return g.nodes("post", lang=["en", "fr"], country=105).select("id", "lang")


def nodes_with_property(g):
    """Nodes of any label with a name."""
    return g.nodes_with_property("name", "Brand#13")


def has_label(g):
    """Ends of likes that are comments."""
    return g.has_label(g["likes"].select(F.col("message").alias("id")).distinct(), "comment")


def typed_default(g):
    """A property, and its default where it is absent."""
    return g["message"].groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("messages"))


def counts(g):
    """Nodes and relationships of some kinds."""
    return g.spark.sql(f"SELECT {g.node_count('person', 'forum', 'tag')}L AS nodes, {g.relationship_count('knows', 'likes', 'member')}L AS relationships")


def traverse_types(g):
    """Several types at once, with their properties."""
    e = g.traverse(_fans(g), ["work_at", "study_at"])
    return e.select("src", "dst", "type", F.coalesce("wf", "cy").alias("year"))


def neighbors(g):
    """Friends of fans, as often as they are reached."""
    return g.neighbors(_fans(g), "knows").groupBy("id").agg(F.count("*").alias("times"))


def neighbors_in(g):
    """Friends of fans who are fans."""
    return g.neighbors_in(_fans(g), "knows", _fans(g)).groupBy("id").agg(F.count("*").alias("times"))


def first_neighbor(g):
    """The first forum of each fan."""
    return g.first_neighbor(_fans(g), "member", "in")


def follow(g):
    """Fans to their forums to these forums' moderators' interests."""
    m = g.with_tables(moderates=g["forum"].select("id", "moderator"))
    return m.follow(_fans(g), ("member", "in"), ("moderates", "out"), ("interest", "out")).distinct()


def has_rel(g):
    """Persons without a like."""
    all_ = g["person"].select("id")
    return all_.join(g.has_rel(all_, "likes"), "id", "left_anti")


def has_neighbor_with_property(g):
    """Messages with a tag of a class."""
    ids = g["message"].select("id")
    return g.has_neighbor_with_property(ids, "has_tag", "tag", **{"class": 113})


def degree(g):
    """Persons by number of likes: how many have how many."""
    return g.degree("likes").groupBy("degree").agg(F.count("*").alias("persons"))


def neighbor_counts(g):
    """Forums by how many fans they have."""
    return g.neighbor_counts(_fans(g), "member", "in", distinct=True)


def neighbor_groups(g):
    """Forums whose largest group from one country is largest."""
    country = g["person"].select("id", F.col("country").alias("group"))
    return g.top_by_size(g.neighbor_groups(g["forum"], "member", "out", country), 10)


def co_occurring(g):
    """Tags that are on a message together at least three times."""
    return g.co_occurring("has_tag", least=3)


def fold_via(g):
    """Replies between messages as replies between their creators, summed by length."""
    via = g["message"].select("id", F.col("creator").alias("via"))
    m = g.with_tables(reply=g["comment"].select("id", "parent", "len"))
    return m.fold_via("reply", via, via, F.col("len")).filter("n > 500")


def aggregate(g):
    """Posts and comments by kind and length class, where there are many."""
    return g.aggregate("post", "comment").where("day >= 9000").by_label().bin("len", [40, 80, 160], "class").count("messages").sum("len", "length").having("messages > 10").run()


def aggregate_through(g):
    """Tags by the distinct creators of their posts."""
    return g.aggregate("post").through("has_tag", name="tag").by("tag").count_distinct("creator", "persons").having("persons >= 15").run()


def same_component(g):
    """Components of friends: their sizes."""
    return wcc(g["person"].select("id"), g["knows"]).groupBy("component").agg(F.count("*").alias("persons"))


def radius(g):
    """Entities within 2,000 km."""
    return geo_within_radius(g["entity"], 10.0, 20.0, 2000.0).select("id", F.round("km", 6).alias("km"))


def box(g):
    """Entities in a box."""
    return geo_within_bbox(g["entity"], (-5.0, 25.0), (10.0, 60.0))


_FANS = "(SELECT DISTINCT i.person AS id FROM {interest} i JOIN {tag} t ON t.id = i.tag WHERE t.name = 'tag50')"
QUERIES = {
    "social": (
        nodes_with_label, nodes_with_property, has_label, typed_default, counts, traverse_types, neighbors, neighbors_in, first_neighbor, follow, has_rel,
        has_neighbor_with_property, degree, neighbor_counts, neighbor_groups, co_occurring, fold_via, aggregate, aggregate_through, same_component,
    ),
    "publishing": (radius, box),
}
SQL = {
    "nodes_with_label": "SELECT id, lang FROM {post} WHERE lang IN ('en', 'fr') AND country = 105",
    "nodes_with_property": "SELECT id FROM {tagclass} WHERE name = 'Brand#13' UNION SELECT id FROM {tag} WHERE name = 'Brand#13' UNION SELECT id FROM {place} WHERE name = 'Brand#13' UNION SELECT id FROM {org} WHERE name = 'Brand#13'",
    "has_label": "SELECT DISTINCT c.id FROM {comment} c WHERE EXISTS (SELECT 1 FROM {likes} k WHERE k.message = c.id)",
    "typed_default": "SELECT lang, count(*) AS messages FROM {post} GROUP BY lang UNION ALL SELECT 'none', count(*) FROM {comment}",
    "counts": "SELECT (SELECT count(*) FROM {person}) + (SELECT count(*) FROM {forum}) + (SELECT count(*) FROM {tag}) AS nodes, (SELECT count(*) FROM {knows}) + (SELECT count(*) FROM {likes}) + (SELECT count(*) FROM {member}) AS relationships",
    "traverse_types": f"SELECT person AS src, org AS dst, 'work_at' AS type, wf AS year FROM {{work_at}} WHERE person IN {_FANS} UNION ALL SELECT person, org, 'study_at', cy FROM {{study_at}} WHERE person IN {_FANS}",
    "neighbors": f"SELECT dst AS id, count(*) AS times FROM {{knows}} WHERE src IN {_FANS} GROUP BY dst",
    "neighbors_in": f"SELECT dst AS id, count(*) AS times FROM {{knows}} WHERE src IN {_FANS} AND dst IN {_FANS} GROUP BY dst",
    "first_neighbor": f"SELECT DISTINCT person AS id, first_value(forum) OVER (PARTITION BY person ORDER BY forum) AS neighbor FROM {{member}} WHERE person IN {_FANS}",
    "follow": f"SELECT DISTINCT m.person AS start, i.tag AS id FROM {{member}} m, {{forum}} f, {{interest}} i WHERE m.person IN {_FANS} AND f.id = m.forum AND i.person = f.moderator",
    "has_rel": "SELECT id FROM {person} EXCEPT SELECT person FROM {likes}",
    "has_neighbor_with_property": "SELECT DISTINCT h.message AS id FROM {has_tag} h, {tag} t, {message} m WHERE t.id = h.tag AND t.class = 113 AND m.id = h.message",
    "degree": "SELECT n AS degree, count(*) AS persons FROM (SELECT count(*) AS n FROM {likes} GROUP BY person) x GROUP BY n",
    "neighbor_counts": f"SELECT forum AS id, count(DISTINCT person) AS n FROM {{member}} WHERE person IN {_FANS} GROUP BY forum",
    "neighbor_groups": "SELECT forum AS id, max(n) AS n FROM (SELECT m.forum, p.country, count(*) AS n FROM {member} m, {person} p WHERE p.id = m.person AND m.forum IN (SELECT id FROM {forum}) GROUP BY ALL) x GROUP BY forum ORDER BY n DESC, id LIMIT 10",
    "co_occurring": "SELECT least(x.tag, y.tag) AS a, greatest(x.tag, y.tag) AS b, count(*) // 2 AS n FROM {has_tag} x, {has_tag} y WHERE x.message = y.message AND x.tag <> y.tag GROUP BY ALL HAVING count(*) >= 6",
    "fold_via": "SELECT (SELECT min(creator) FROM {message} s WHERE s.id = c.id) AS a, (SELECT min(creator) FROM {message} s WHERE s.id = c.parent) AS b, CAST(sum(len) AS BIGINT) AS n FROM {comment} c WHERE c.parent IN (SELECT id FROM {message}) GROUP BY ALL HAVING sum(len) > 500",
    "aggregate": "SELECT * FROM (SELECT k AS label, CASE WHEN len >= 160 THEN 3 WHEN len >= 80 THEN 2 WHEN len >= 40 THEN 1 ELSE 0 END AS class, count(*) AS messages, CAST(sum(len) AS BIGINT) AS length FROM (SELECT 'post' AS k, len, day FROM {post} UNION ALL SELECT 'comment', len, day FROM {comment}) x WHERE NOT day < 9000 GROUP BY ALL) y WHERE messages > 10",
    "aggregate_through": "SELECT tag, count(*) AS persons FROM (SELECT DISTINCT h.tag, p.creator FROM {has_tag} h, {post} p WHERE p.id = h.message) x GROUP BY tag HAVING count(*) >= 15",
    "same_component": "WITH c AS (SELECT id, id AS c FROM {person} UNION SELECT k.dst, c.c FROM c JOIN {knows} k ON k.src = c.id), l AS (SELECT id, min(c) AS component FROM c GROUP BY id) SELECT component, count(*) AS persons FROM l GROUP BY component",
    "radius": "SELECT id, round(km, 6) AS km FROM (SELECT id, 12742.0176 * asin(sqrt(least(1.0, power(sin(radians(lat - 10) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * power(sin(radians(lon - 20) / 2), 2)))) AS km FROM {entity}) x WHERE km <= 2000",
    "box": "SELECT id FROM {entity} WHERE lat >= -5 AND lat <= 25 AND lon >= 10 AND lon <= 60",
}
