"""Graph views of the driver's parquet tables, as SQL that Spark and DuckDB both run.

Each view names the tables it reads in braces. ``$day(x)`` and ``$ms(x)`` are epoch days and
epoch milliseconds, the only spots where the two dialects differ.

Social view: customers are persons (two friends by arithmetic on the key, and customers of
near keys), nations are countries with three cities each, regions are continents, orders
are posts, lineitems are comments that reply to the order or to the line before (some by a
friend of the post's creator), parts are tags, brands are tag classes, suppliers are forums,
events are likes; some comments also have a tag of their post. Financial view: a user's event
is a transfer to the user of the next event. Publishing view: documents are works, parts are
entities. Keys begin at 0. Lineitem has no key, so comments take the first of equal (order,
line) pairs.
"""

from __future__ import annotations

import re

SOCIAL = {
    "base": "SELECT CAST(count(*) AS BIGINT) AS n FROM {customer}",
    "place": """
        SELECT CAST(r_regionkey AS BIGINT) + 1000 AS id, r_name AS name, 'Continent' AS label, CAST(NULL AS BIGINT) AS part_of FROM {region}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, n_name, 'Country', CAST(n_regionkey AS BIGINT) + 1000 FROM {nation}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + k.i + 10000, concat(n_name, '-', k.i), 'City', CAST(n_nationkey AS BIGINT) + 100
        FROM {nation} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) k""",
    "person": """
        SELECT c_custkey AS id, concat('N', CAST(c_custkey % 23 AS VARCHAR(9))) AS fname, c_name AS lname,
          CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
          c_custkey % 12 + 1 AS bmon, c_custkey % 28 + 1 AS bdom, 7500 + c_custkey % 900 AS pday,
          (1990 + c_custkey % 3) * 12 + c_custkey % 12 + 1 AS pym,
          CAST(c_nationkey AS BIGINT) * 10 + c_custkey % 3 + 10000 AS city, CAST(c_nationkey AS BIGINT) + 100 AS country
        FROM {customer}""",
    "knows": """
        SELECT DISTINCT a AS src, b AS dst, 7600 + (a + b) % 1500 AS kd FROM (
          SELECT c_custkey AS a, c_custkey * 7 % n + 1 AS b FROM {customer} CROSS JOIN {base}
          UNION ALL SELECT c_custkey, c_custkey * c_custkey % n + 1 FROM {customer} CROSS JOIN {base}
          UNION ALL SELECT c_custkey, c_custkey % n + 1 FROM {customer} CROSS JOIN {base}
          UNION ALL SELECT c_custkey, (c_custkey + 1) % n + 1 FROM {customer} CROSS JOIN {base}
          UNION ALL SELECT c_custkey * 7 % n + 1, c_custkey FROM {customer} CROSS JOIN {base}
          UNION ALL SELECT c_custkey * c_custkey % n + 1, c_custkey FROM {customer} CROSS JOIN {base}
          UNION ALL SELECT c_custkey % n + 1, c_custkey FROM {customer} CROSS JOIN {base}
          UNION ALL SELECT (c_custkey + 1) % n + 1, c_custkey FROM {customer} CROSS JOIN {base}
        ) e WHERE a <> b AND a IN (SELECT c_custkey FROM {customer}) AND b IN (SELECT c_custkey FROM {customer})""",
    "tagclass": """
        SELECT CAST(1 AS BIGINT) AS id, 'Thing' AS name, CAST(NULL AS BIGINT) AS parent
        UNION ALL SELECT DISTINCT 10 + CAST(substring(p_brand, 7, 1) AS BIGINT), concat('Maker', substring(p_brand, 7, 1)), CAST(1 AS BIGINT) FROM {part}
        UNION ALL SELECT DISTINCT 100 + CAST(substring(p_brand, 7, 2) AS BIGINT), p_brand, 10 + CAST(substring(p_brand, 7, 1) AS BIGINT) FROM {part}""",
    "tag": "SELECT p_partkey AS id, concat('tag', p_partkey) AS name, 100 + CAST(substring(p_brand, 7, 2) AS BIGINT) AS class FROM {part}",
    "forum": """
        SELECT s_suppkey AS id, s_name AS title, 7700 + s_suppkey * 13 % 900 AS fday, s_suppkey * 11 % n AS moderator FROM {supplier} CROSS JOIN {base}""",
    "line": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_shipdate) AS ship,
          CAST(min(l_quantity) AS BIGINT) AS qty, min(l_returnflag) AS flag FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "post": """
        SELECT o_orderkey * 100 AS id, o_custkey AS creator, CAST($day(o_orderdate) AS BIGINT) AS day, CAST($ms(o_orderdate) AS BIGINT) AS ms,
          CAST(extract(year FROM o_orderdate) AS BIGINT) AS year, o_orderkey % 200 AS len, o_orderstatus <> 'P' AS content,
          CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS lang,
          o_orderkey % f.n AS forum, o_orderkey % 25 + 100 AS country
        FROM {orders} CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {supplier}) f""",
    "comment": """
        SELECT l.l_orderkey * 100 + l.l_linenumber AS id,
          CASE WHEN l.first AND l.l_orderkey % 3 = 0 THEN o.o_custkey * 7 % b.n + 1 WHEN l.first AND l.l_orderkey % 3 = 1 THEN o.o_custkey * o.o_custkey % b.n + 1 ELSE (l.part * 13 + l.supp) % b.n END AS creator,
          CAST($day(l.ship) AS BIGINT) AS day, CAST($ms(l.ship) AS BIGINT) + l.l_linenumber AS ms, CAST(extract(year FROM l.ship) AS BIGINT) AS year, l.qty * 4 AS len, l.flag <> 'N' AS content,
          CASE WHEN l.first THEN l.l_orderkey * 100 ELSE l.l_orderkey * 100 + l.l_linenumber - 1 END AS parent,
          l.part % 25 + 100 AS country
        FROM (SELECT x.*, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <> l_linenumber - 1, TRUE) AS first FROM {line} x) l
        JOIN {orders} o ON o.o_orderkey = l.l_orderkey CROSS JOIN {base} b""",
    "message": """
        SELECT id, FALSE AS is_comment, creator, day, ms, year, len, content, lang, forum, CAST(NULL AS BIGINT) AS parent, country FROM {post}
        UNION ALL SELECT id, TRUE, creator, day, ms, year, len, content, CAST(NULL AS VARCHAR(9)), CAST(NULL AS BIGINT), parent, country FROM {comment}""",
    "has_tag": """
        SELECT l_orderkey * 100 + l_linenumber AS message, part AS tag FROM {line} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders})
        UNION SELECT l_orderkey * 100 + l_linenumber, l_orderkey * 17 % t.n FROM {line} CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {part}) t
        WHERE l_linenumber % 2 = 0 AND l_orderkey IN (SELECT o_orderkey FROM {orders})
        UNION SELECT o_orderkey * 100, (o_orderkey * 17 + k.i) % t.n FROM {orders} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) k CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {part}) t""",
    "interest": """
        SELECT c_custkey AS person, c_custkey * k.m % t.n AS tag FROM {customer}
        CROSS JOIN (SELECT 3 AS m UNION ALL SELECT 5 UNION ALL SELECT 11) k CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {part}) t
        UNION SELECT c_custkey, c_custkey % 40 * CAST(floor(t.n / 40) AS BIGINT) FROM {customer} CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {part}) t""",
    "likes": """
        SELECT person, message, max(ld) AS ld FROM (
          SELECT e.user_id * 7 % b.n AS person, m.id AS message, CAST($ms(e.ts) AS BIGINT) AS ld FROM {events} e CROSS JOIN {base} b
          JOIN {post} m ON m.id = (e.event_id + 1) * 100
          UNION ALL SELECT (e.user_id + 3) % b.n, m.id, CAST($ms(e.ts) AS BIGINT) + 5 FROM {events} e CROSS JOIN {base} b
          CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {orders}) o
          JOIN {comment} m ON m.id = e.event_id * 7 % o.n * 100 + 1) x GROUP BY person, message""",
    "member": """
        SELECT forum, person, min(hd) AS hd FROM (
          SELECT forum, creator AS person, day - 30 AS hd FROM {post}
          UNION ALL SELECT c_custkey % f.n, c_custkey, 7800 + c_custkey % 700 FROM {customer} CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {supplier}) f
        ) m GROUP BY forum, person""",
    "org": """
        SELECT 500 + CAST(n_nationkey AS BIGINT) AS id, concat('Company ', n_name) AS name, 'Company' AS label, 100 + CAST(n_nationkey AS BIGINT) AS place FROM {nation}
        UNION ALL SELECT 600 + CAST(n_nationkey AS BIGINT), concat('University ', n_name), 'University', 10000 + 10 * CAST(n_nationkey AS BIGINT) FROM {nation}""",
    "work_at": "SELECT c_custkey AS person, 500 + c_custkey * 3 % 25 AS org, 1995 + c_custkey % 20 AS wf FROM {customer}",
    "study_at": """
        SELECT c_custkey AS person, 600 + c_custkey % 5 AS org, 1990 + c_custkey % 7 AS cy FROM {customer}
        UNION ALL SELECT c_custkey, 610 + c_custkey % 3, 1992 + c_custkey % 5 FROM {customer} WHERE c_custkey % 2 = 0""",
}

FINANCE = {
    "step": """
        SELECT e.user_id AS src, n.user_id AS dst, CAST($ms(e.ts) AS BIGINT) AS ts, e.value AS amt, e.event_id FROM {events} e LEFT JOIN {events} n ON n.event_id = e.event_id + 1""",
    "account": "SELECT DISTINCT user_id AS id, user_id % 17 = 0 AS blocked FROM {events}",
    "transfer": "SELECT src, dst, ts, amt FROM {step} WHERE dst IS NOT NULL AND src <> dst AND event_id % 3 <> 0",
    "withdraw": "SELECT src, dst, ts, amt FROM {step} WHERE dst IS NOT NULL AND src <> dst AND event_id % 3 = 0",
    "company": "SELECT DISTINCT 8000 + id % 20 AS id FROM {account}",
    "loan": "SELECT 5000 + id AS id, CAST(id * 100 + 1000 AS DOUBLE) AS amount, CAST(id * 40 AS DOUBLE) AS balance FROM {account}",
    "deposit": "SELECT 5000 + user_id AS src, user_id * 3 % 150 AS dst, CAST($ms(ts) AS BIGINT) AS ts, value AS amt FROM {events} WHERE event_id % 11 = 0",
    "repay": "SELECT user_id AS src, 5000 + user_id * 5 % 150 AS dst, CAST($ms(ts) AS BIGINT) AS ts, value AS amt FROM {events} WHERE event_id % 13 = 0",
    "apply": "SELECT 9000 + id % 60 AS src, 5000 + id AS dst, CAST(1000 AS BIGINT) AS ts, CAST(id * 100 + 1000 AS DOUBLE) AS amt FROM {account}",
    "guarantee": "SELECT 9000 + id % 60 AS src, 9000 + (id * 7 + 1) % 60 AS dst, CAST(1000 AS BIGINT) AS ts FROM {account} WHERE id % 3 = 0",
    "own": """
        SELECT CASE WHEN id % 5 = 0 THEN 8000 + id % 20 ELSE 9000 + id % 60 END AS src, id AS dst, CAST(10 AS BIGINT) AS ts FROM {account}""",
    "invest": """
        SELECT DISTINCT 9000 + user_id % 60 AS src, 8000 + event_id % 20 AS dst, CAST($ms(ts) AS BIGINT) AS ts FROM {events} WHERE event_id % 17 = 0""",
    "medium": "SELECT DISTINCT 7000 + event_id % 100 AS id, event_id % 100 % 10 = 0 AS blocked FROM {events}",
    "sign_in": "SELECT 7000 + event_id % 100 AS src, user_id AS dst, CAST($ms(ts) AS BIGINT) AS ts FROM {events} WHERE event_id % 5 = 0",
}

PUBLISHING = {
    "work": """
        SELECT doc_id AS id, concat('urn:work:', doc_id) AS uri, substring(text, 1, 40) AS title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substring(text, 41, 60) END AS description,
          CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'BlogPost' WHEN 1 THEN 'NewsItem' ELSE 'Programme' END AS type,
          source AS category, lang AS audience, doc_id % 2 = 0 AS live, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('fmt', doc_id % 3) END AS format,
          concat('thumb', doc_id) AS thumbnail,
          concat('2011-', lpad(CAST(doc_id % 12 + 1 AS VARCHAR(9)), 2, '0'), '-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR(9)), 2, '0'), 'T10:', lpad(CAST(doc_id % 60 AS VARCHAR(9)), 2, '0'), ':00.000+00:00') AS created,
          CASE WHEN doc_id % 11 = 0 THEN NULL ELSE
            concat('2012-', lpad(CAST(doc_id * 5 % 12 + 1 AS VARCHAR(9)), 2, '0'), '-', lpad(CAST(doc_id * 3 % 28 + 1 AS VARCHAR(9)), 2, '0'), 'T11:', lpad(CAST(doc_id * 7 % 60 AS VARCHAR(9)), 2, '0'), ':00.000+00:00') END AS modified
        FROM {documents}""",
    "entity": """
        SELECT CAST(p_partkey AS BIGINT) AS id, concat('urn:entity:', p_partkey) AS uri, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS label,
          CAST(p_partkey * 7 % 180 - 90 AS DOUBLE) AS lat, CAST(p_partkey * 13 % 360 - 180 AS DOUBLE) AS lon
        FROM {part}""",
    "kind": """
        SELECT id AS entity, CASE CAST(id % 3 AS INT) WHEN 0 THEN 'Company' WHEN 1 THEN 'Event' ELSE 'Feature' END AS kind FROM {entity}
        UNION ALL SELECT id, 'Thing' FROM {entity} WHERE id % 10 <> 9""",
    "about": """
        SELECT DISTINCT id AS work, id * k.m % t.n AS entity FROM {work} CROSS JOIN (SELECT 3 AS m UNION ALL SELECT 7) k CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {part}) t
        UNION SELECT id, id % 50 FROM {work} WHERE id % 2 = 0""",
    "mentions": """
        SELECT DISTINCT id AS work, id * k.m % t.n AS entity FROM {work} CROSS JOIN (SELECT 5 AS m UNION ALL SELECT 7 UNION ALL SELECT 11) k CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM {part}) t WHERE id % 6 <> 0
        UNION SELECT id, id % 40 FROM {work} WHERE id % 6 <> 0""",
    "tagged": "SELECT DISTINCT work, entity FROM (SELECT * FROM {about} UNION ALL SELECT * FROM {mentions}) t",
    "content_of": "SELECT id AS work, concat('urn:doc:', id % 9) AS doc, CASE WHEN id % 9 < 5 THEN 'HighWeb' ELSE 'Mobile' END AS web_type FROM {work} WHERE id % 4 <> 1",
}

_CALL = re.compile(r"\$(day|ms|names|ids)\(([^()]*)\)")


def dialect(sql: str, engine: str) -> str:
    """Expand ``$day``, ``$ms``, ``$names`` (sorted distinct list) and ``$ids`` (sorted list of numbers) for "spark" or "duckdb"."""
    forms = {
        "spark": {"day": r"unix_date(CAST({} AS DATE))", "ms": r"(unix_micros(CAST({} AS TIMESTAMP)) DIV 1000)", "names": r"array_join(array_sort(collect_set({})), ',')", "ids": r"array_join(array_sort(collect_list({})), ',')"},
        "duckdb": {"day": r"date_diff('day', DATE '1970-01-01', CAST({} AS DATE))", "ms": r"epoch_us(CAST({} AS TIMESTAMP)) // 1000", "names": r"string_agg(DISTINCT {0}, ',' ORDER BY {0})", "ids": r"string_agg(CAST({0} AS VARCHAR), ',' ORDER BY {0})"},
    }[engine]
    return _CALL.sub(lambda m: forms[m[1]].format(m[2]), sql)


def names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))
