"""Publishing queries: works, what they are about or mention, facets, words, places, days.

``hits`` holds the works found by words (see functions.search); strings are compared as text
where dates are ISO text, in milliseconds where the query says so.
"""

_NEWEST = "ORDER BY w.modified DESC, w.uri"
_FULL = "w.title IS NOT NULL AND w.description IS NOT NULL AND w.live IS NOT NULL AND w.format IS NOT NULL AND w.category IS NOT NULL AND w.audience IS NOT NULL AND w.created IS NOT NULL"
_TAGGED = "SELECT work FROM {tagged} WHERE entity = :entity"
_FACETS = " AND ".join(f"(CAST(:{p} AS {kind}) IS NULL OR {test})" for p, kind, test in (
    ("category", "VARCHAR(99)", "w.category = :category"), ("audience", "VARCHAR(99)", "w.audience = :audience"), ("live", "BOOLEAN", "coalesce(w.live, FALSE) = :live"),
    ("after", "VARCHAR(99)", "w.created >= :after"), ("before", "VARCHAR(99)", "w.created <= :before"), ("tag", "VARCHAR(99)", "w.id IN (SELECT t.work FROM {tagged} t JOIN {entity} e ON e.id = t.entity WHERE e.uri = :tag)"),
))
_DAY = "substring(w.created, 1, 10)"

QUERIES = {
    "spb_q1": (f"SELECT w.uri, w.modified FROM {{work}} w WHERE w.id IN ({_TAGGED}) AND w.modified IS NOT NULL {_NEWEST}", {"entity": 22}),
    "spb_q2": ("SELECT uri, title FROM {work} WHERE uri = :uri AND title IS NOT NULL", {"uri": "urn:work:5"}),
    "spb_q3": (f"SELECT w.uri, w.created FROM {{work}} w WHERE w.id IN ({_TAGGED}) ORDER BY w.created DESC, w.uri LIMIT 10", {"entity": 22}),
    "spb_q4": (f"SELECT w.uri, w.created FROM {{work}} w WHERE w.type = 'BlogPost' AND w.id IN ({_TAGGED}) ORDER BY w.created DESC, w.uri LIMIT 10", {"entity": 22}),
    "spb_q5": ("""
        SELECT e.label, count(*) AS works FROM {work} w JOIN {tagged} t ON t.work = w.id JOIN {entity} e ON e.id = t.entity
        WHERE w.type = :type AND w.audience = :audience AND $ms(w.modified) > :lo AND $ms(w.modified) < :hi AND e.label IS NOT NULL
        GROUP BY e.id, e.label ORDER BY works DESC, e.label""", {"type": "BlogPost", "audience": "en", "lo": 1330000000000, "hi": 1350000000000}),
    "spb_q6": ("""
        SELECT DISTINCT w.uri FROM {mentions} m JOIN {work} w ON w.id = m.work JOIN {entity} e ON e.id = m.entity
        WHERE e.id IN (SELECT entity FROM {kind} WHERE kind = 'Feature') AND e.lat BETWEEN :lat - :km / 110.0 AND :lat + :km / 110.0
          AND 2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(e.lat - :lat) / 2), 2) + cos(radians(:lat)) * cos(radians(e.lat)) * power(sin(radians(e.lon - :lon) / 2), 2)))) <= :km
        ORDER BY w.uri""", {"lat": 10.0, "lon": 20.0, "km": 6000.0}),
    "spb_q7": ("""
        SELECT w.uri, w.title, w.created FROM {work} w WHERE w.type = :type AND w.created >= :lo AND w.created <= :hi AND w.title IS NOT NULL AND w.live IS NOT NULL
          AND w.category = :category AND w.audience = :audience ORDER BY w.uri""", {"type": "NewsItem", "lo": "2011-02", "hi": "2011-12", "category": "src1", "audience": "en"}),
    "spb_q8": ("SELECT w.uri FROM {work} w JOIN {hits} h ON h.id = w.id ORDER BY w.uri", {"words": "the and", "fields": "title,description"}),
    "spb_q6_q8": ("""
        SELECT DISTINCT w.uri FROM {mentions} m JOIN {work} w ON w.id = m.work JOIN {entity} e ON e.id = m.entity JOIN {hits} h ON h.id = w.id
        WHERE e.id IN (SELECT entity FROM {kind} WHERE kind = 'Feature') AND 2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(e.lat - :lat) / 2), 2) + cos(radians(:lat)) * cos(radians(e.lat)) * power(sin(radians(e.lon - :lon) / 2), 2)))) <= :km
        ORDER BY w.uri""", {"lat": 10.0, "lon": 20.0, "km": 6000.0, "words": "the", "fields": "title,description"}),
    "spb_q9": ("""
        WITH mine AS (SELECT entity, 1 AS a, 0 AS m FROM {about} WHERE work = :work UNION ALL SELECT entity, 0, 1 FROM {mentions} WHERE work = :work),
        f AS (SELECT entity, max(a) AS a, max(m) AS m FROM mine GROUP BY entity),
        s AS (SELECT o.work, sum(CASE WHEN o.k = 'a' THEN 2.0 * f.a + 1.0 * f.m ELSE 1.5 * f.a + 0.5 * f.m END) AS score
          FROM (SELECT DISTINCT work, entity, 'a' AS k FROM {about} UNION ALL SELECT DISTINCT work, entity, 'm' FROM {mentions}) o JOIN f ON f.entity = o.entity WHERE o.work <> :work GROUP BY o.work)
        SELECT w.uri, CAST(s.score AS DOUBLE) AS score, w.modified FROM s JOIN {work} w ON w.id = s.work WHERE w.modified IS NOT NULL ORDER BY s.score DESC, w.modified DESC, w.uri LIMIT 20""", {"work": 7}),
    "spb_a1": (f"SELECT w.uri, w.modified FROM {{work}} w WHERE w.id IN (SELECT work FROM {{mentions}} WHERE entity = :entity) AND w.modified IS NOT NULL {_NEWEST}", {"entity": 22}),
    "spb_a2": ("SELECT uri, type FROM {work} WHERE uri = :uri AND title IS NOT NULL AND type IN ('BlogPost', 'NewsItem', 'Programme')", {"uri": "urn:work:5"}),
    "spb_a3": ("SELECT CAST(substring(created, 15, 2) AS BIGINT) AS minute, count(*) AS works FROM {work} WHERE created > :lo AND created < :hi GROUP BY 1 ORDER BY minute", {"lo": "2011-02", "hi": "2011-11"}),
    "spb_a4": ("SELECT type, count(*) AS works FROM {work} WHERE created > :lo AND created < :hi GROUP BY type ORDER BY type", {"lo": "2011-02", "hi": "2011-11"}),
    "spb_a5": ("""
        SELECT e.uri, count(DISTINCT w.id) AS works FROM {about} a JOIN {work} w ON w.id = a.work JOIN {entity} e ON e.id = a.entity
        WHERE e.label IS NOT NULL AND w.category IN (:c1, :c2) GROUP BY e.uri ORDER BY works DESC, e.uri LIMIT 50""", {"c1": "src1", "c2": "src2"}),
    # pairs of a work and what it is about, by every kind that this has
    "spb_a6": ("""
        SELECT k.kind, count(*) AS works FROM (SELECT DISTINCT work, entity FROM {about}) a JOIN {work} w ON w.id = a.work JOIN {kind} k ON k.entity = a.entity
        WHERE k.kind IN ('Company', 'Event', 'Thing') AND coalesce(w.live, FALSE) = :live AND w.audience = :audience GROUP BY k.kind ORDER BY works DESC, k.kind""", {"live": True, "audience": "en"}),
    "spb_a7": ("""
        SELECT e.uri, count(*) AS n FROM {mentions} m JOIN {entity} e ON e.id = m.entity WHERE m.work IN (SELECT work FROM {content_of} GROUP BY work HAVING count(*) > :n)
        GROUP BY e.uri ORDER BY n DESC, e.uri""", {"n": 0}),
    "spb_a8": ("""
        SELECT e.uri, count(*) AS n FROM (SELECT work, entity FROM {about} UNION ALL SELECT work, entity FROM {mentions}) t JOIN {work} w ON w.id = t.work JOIN {entity} e ON e.id = t.entity
        WHERE w.type = :type AND w.audience = :audience AND w.modified > :lo AND w.modified < :hi GROUP BY e.uri ORDER BY n DESC, e.uri""", {"type": "BlogPost", "audience": "en", "lo": "2012-02", "hi": "2012-11"}),
    "spb_a9": ("SELECT coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM {mentions} GROUP BY work) x", {}),
    "spb_a10": ("""
        WITH n AS (SELECT work, count(*) AS n FROM {mentions} GROUP BY work)
        SELECT w.uri, w.created FROM n JOIN {work} w ON w.id = n.work WHERE n.n = (SELECT max(n) FROM n) AND w.created IS NOT NULL ORDER BY w.uri LIMIT 100""", {}),
    "spb_a13": ("""
        SELECT DISTINCT w.uri, e.uri AS tag FROM {tagged} t JOIN {work} w ON w.id = t.work JOIN {entity} e ON e.id = t.entity
        WHERE w.category IN (:c1, :c2) AND w.modified IS NOT NULL ORDER BY w.uri, tag""", {"c1": "src1", "c2": "src2"}),
    "spb_a14": (f"""
        SELECT w.uri, w.modified FROM {{work}} w WHERE w.id IN (SELECT work FROM {{tagged}}) AND w.category IS NOT NULL AND w.thumbnail IS NOT NULL AND w.audience IS NOT NULL AND w.format = :format
          AND w.id IN (SELECT work FROM {{content_of}} WHERE web_type = :web) AND w.modified IS NOT NULL {_NEWEST}""", {"format": "fmt1", "web": "HighWeb"}),
    "spb_a15": ("""
        SELECT w.uri FROM {work} w JOIN {hits} h ON h.id = w.id WHERE w.category = :category AND w.id IN (SELECT a.work FROM {about} a JOIN {kind} k ON k.entity = a.entity WHERE k.kind = 'Thing')
          AND w.id IN (SELECT m.work FROM {mentions} m JOIN {kind} k ON k.entity = m.entity WHERE k.kind = 'Thing') ORDER BY w.uri""", {"words": "the", "fields": "title", "category": "src2"}),
    "spb_a16": ("""
        SELECT DISTINCT e.uri AS tag, w.uri FROM {work} w JOIN {hits} h ON h.id = w.id JOIN {tagged} t ON t.work = w.id JOIN {entity} e ON e.id = t.entity
        WHERE w.category = :category ORDER BY tag, w.uri""", {"words": "the", "fields": "title", "category": "src1"}),
    "spb_a17": ("""
        SELECT DISTINCT w.uri, w.modified FROM {mentions} m JOIN {work} w ON w.id = m.work JOIN {entity} e ON e.id = m.entity
        WHERE e.id IN (SELECT entity FROM {kind} WHERE kind = 'Feature') AND e.lat BETWEEN :lat1 AND :lat2 AND e.lon BETWEEN :lon1 AND :lon2 AND w.modified IS NOT NULL ORDER BY w.modified DESC, w.uri""", {"lat1": -20.0, "lat2": 40.0, "lon1": -60.0, "lon2": 90.0}),
    "spb_a18": ("""
        SELECT w.uri, w.created FROM {work} w WHERE w.type = :type AND w.created >= :lo AND w.created <= :hi AND w.title IS NOT NULL AND w.live IS NOT NULL AND w.category IS NOT NULL AND w.audience IS NOT NULL
        ORDER BY w.created DESC, w.uri LIMIT 25""", {"type": "NewsItem", "lo": "2011-02", "hi": "2011-12"}),
    "spb_a19": ("""
        SELECT coalesce(e.label, e.uri) AS name, e.uri, count(*) AS works, max(w.modified) AS newest FROM {tagged} t JOIN {work} w ON w.id = t.work JOIN {entity} e ON e.id = t.entity
        WHERE $ms(w.modified) BETWEEN :lo AND :hi GROUP BY e.uri, e.label ORDER BY newest DESC, works DESC, e.uri""", {"lo": 1330000000000, "hi": 1350000000000}),
    "spb_a20": (f"SELECT w.uri, w.modified FROM {{work}} w JOIN {{hits}} h ON h.id = w.id WHERE w.modified IS NOT NULL {_NEWEST} LIMIT 25", {"words": "the of", "fields": "title,description"}),
    # facets of a21 and a22 are optional: None asks for any value (a21) or any that is there (a22)
    "spb_a21": (f"SELECT w.uri FROM {{work}} w JOIN {{hits}} h ON h.id = w.id WHERE w.id IN (SELECT work FROM {{tagged}}) AND {_FACETS} ORDER BY w.uri LIMIT :limit", {"words": "the", "fields": "title", "category": "src1", "audience": "en", "tag": None, "live": None, "after": None, "before": None, "limit": 500}),
    "spb_a22": (f"SELECT w.uri FROM {{work}} w JOIN {{hits}} h ON h.id = w.id WHERE {_FULL} AND w.id IN (SELECT work FROM {{tagged}}) AND {_FACETS} ORDER BY w.uri LIMIT :limit", {"words": "the", "fields": "title", "category": None, "audience": "en", "tag": None, "live": True, "after": "2011-02", "before": "2011-12", "limit": 500}),
    "spb_a23": (f"""
        SELECT e.uri, count(DISTINCT {_DAY}) AS days FROM {{work}} w JOIN {{hits}} h ON h.id = w.id JOIN {{tagged}} t ON t.work = w.id JOIN {{entity}} e ON e.id = t.entity
        WHERE {_FULL} AND w.audience = :audience GROUP BY e.uri ORDER BY days DESC, e.uri""", {"words": "the", "fields": "title", "audience": "en"}),
    "spb_a24": (f"""
        SELECT {_DAY} AS day, count(*) AS works FROM {{work}} w WHERE w.id IN (SELECT work FROM {{about}} WHERE entity = :e1) AND w.id IN (SELECT work FROM {{about}} WHERE entity = :e2) GROUP BY 1 ORDER BY day""", {"e1": 30, "e2": 70}),
    "spb_a25": (f"""
        SELECT e.uri, count(DISTINCT {_DAY}) AS days FROM {{about}} a JOIN {{about}} b ON b.work = a.work AND b.entity <> a.entity JOIN {{work}} w ON w.id = a.work JOIN {{entity}} e ON e.id = b.entity
        WHERE a.entity = :entity AND w.created IS NOT NULL GROUP BY e.uri ORDER BY days DESC, e.uri""", {"entity": 22}),
}
