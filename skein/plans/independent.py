"""DuckDB SQL written apart from the queries, for those with conditional counts, anti joins or cuts.

Same tables and parameters, other means: FILTER instead of CASE, EXCEPT and counting instead
of NOT EXISTS, QUALIFY and lists instead of ranked subqueries, correlated subqueries instead
of joins. The rest of the queries have the text that Spark runs as their oracle.
"""

SQL = {
    "bi_q1": """
        SELECT year, is_comment, list_position([40, 80, 160, 1000000000], list_filter([40, 80, 160, 1000000000], lambda x: x > len)[1]) - 1 AS cat, count(*) AS messages,
          CAST(sum(len) AS BIGINT) AS length_sum, (SELECT count(*) FROM {message} WHERE day < :day) AS total
        FROM {message} WHERE day < :day AND content GROUP BY ALL""",
    "bi_q2": """
        SELECT t.name, count(m.id) FILTER (m.day < :day + 100) AS w1, count(m.id) FILTER (m.day >= :day + 100) AS w2, abs(count(m.id) FILTER (m.day < :day + 100) - count(m.id) FILTER (m.day >= :day + 100)) AS diff
        FROM {tag} t LEFT JOIN (SELECT h.tag, m.id, m.day FROM {has_tag} h, {message} m WHERE m.id = h.message AND m.day BETWEEN :day AND :day + 199) m ON m.tag = t.id
        WHERE t.class IN (SELECT id FROM {tagclass} WHERE name = :class) GROUP BY t.id, t.name ORDER BY diff DESC, t.name LIMIT 100""",
    "bi_q4": """
        WITH n AS (SELECT m.forum, count(*) AS n FROM {member} m, {person} p, {forum} f WHERE p.id = m.person AND f.id = m.forum AND f.fday > :day GROUP BY m.forum, p.country),
        top AS (SELECT forum FROM n GROUP BY forum ORDER BY max(n) DESC, forum LIMIT :k), who AS (SELECT person FROM {member} WHERE forum IN (FROM top) GROUP BY person)
        SELECT person, (SELECT count(*) FROM {message} m, {thread} t WHERE t.id = m.id AND t.forum IN (FROM top) AND m.creator = person) AS messages,
          array_to_string(list_sort((SELECT list(forum) FROM top)), ',') AS forums FROM who ORDER BY messages DESC, person LIMIT 100""",
    "bi_q5": """
        WITH m AS (SELECT id, creator, (SELECT count(*) FROM {comment} c WHERE c.parent = x.id) AS r, (SELECT count(*) FROM {likes} l WHERE l.message = x.id) AS l FROM {message} x
          WHERE id IN (SELECT message FROM {has_tag} SEMI JOIN (SELECT id AS tag FROM {tag} WHERE name = :tag) t USING (tag)))
        SELECT creator AS person, count(*) AS messages, CAST(sum(r) AS BIGINT) AS replies, CAST(sum(l) AS BIGINT) AS liked, CAST(sum(1 + 2 * r + 10 * l) AS BIGINT) AS score FROM m GROUP BY creator ORDER BY score DESC, person LIMIT 100""",
    "bi_q7": """
        WITH x AS (SELECT message FROM {has_tag} WHERE tag = (SELECT id FROM {tag} WHERE name = :tag)), c AS (SELECT id FROM {comment} WHERE parent IN (FROM x) EXCEPT FROM x)
        SELECT name, count(*) AS comments FROM (SELECT DISTINCT t.name, h.message FROM {has_tag} h, {tag} t WHERE t.id = h.tag AND h.message IN (FROM c)) y GROUP BY name ORDER BY comments DESC, name LIMIT 100""",
    "bi_q8": """
        WITH t AS (SELECT id FROM {tag} WHERE name = :tag), s AS (SELECT p.id AS person, 100 * CAST(p.id IN (SELECT person FROM {interest} WHERE tag IN (FROM t)) AS BIGINT)
            + (SELECT count(*) FROM {message} m, {has_tag} h WHERE h.message = m.id AND h.tag IN (FROM t) AND m.creator = p.id AND m.day > :lo AND m.day < :hi) AS s
          FROM (SELECT id FROM {person} UNION SELECT creator FROM {message}) p),
        f AS (SELECT person, s AS score, coalesce((SELECT sum(b.s) FROM {knows} k, s b WHERE k.src = a.person AND b.person = k.dst), 0) AS friends FROM s a WHERE s > 0)
        SELECT person, score, CAST(friends AS BIGINT) AS friends_score FROM f ORDER BY score + friends DESC, person LIMIT 100""",
    "bi_q13": """
        WITH z AS (SELECT id, :ym - pym + 1 AS months FROM {person} p WHERE country = :country AND pday < :day AND (SELECT count(*) FROM {message} m WHERE m.creator = p.id AND m.day < :day) < :ym - pym + 1 AND :ym >= pym),
        l AS (SELECT m.creator, l.person IN (SELECT id FROM z) AS is_z FROM {likes} l, {message} m, {person} p WHERE m.id = l.message AND p.id = l.person AND p.pday < :day),
        n AS (SELECT id AS person, (SELECT count(*) FROM l WHERE l.creator = z.id AND is_z) AS zombie_likes, (SELECT count(*) FROM l WHERE l.creator = z.id) AS likes FROM z)
        SELECT *, CASE WHEN likes = 0 THEN 0.0::DOUBLE ELSE zombie_likes / likes END AS score FROM n ORDER BY score DESC, person LIMIT 100""",
    "bi_q14": """
        WITH pair AS (SELECT DISTINCT k.src AS p1, k.dst AS p2, a.city FROM {knows} k, {person} a, {person} b WHERE a.id = k.src AND b.id = k.dst AND a.country = :c1 AND b.country = :c2),
        r AS (SELECT DISTINCT c.creator AS a, m.creator AS b FROM {comment} c, {message} m WHERE m.id = c.parent), l AS (SELECT DISTINCT k.person AS a, m.creator AS b FROM {likes} k, {message} m WHERE m.id = k.message),
        s AS (SELECT p1, p2, city, 4 * (SELECT count(*) FROM r WHERE a = p1 AND b = p2) + (SELECT count(*) FROM r WHERE a = p2 AND b = p1) + 10 * (SELECT count(*) FROM l WHERE a = p1 AND b = p2) + (SELECT count(*) FROM l WHERE a = p2 AND b = p1) AS score FROM pair)
        SELECT p1, p2, c.name AS city, score FROM s, {place} c WHERE c.id = s.city QUALIFY row_number() OVER (PARTITION BY s.city ORDER BY score DESC, p1, p2) = 1 ORDER BY score DESC, p1, p2 LIMIT 100""",
    "bi_q16": """
        WITH w AS (SELECT t.name, m.day, m.creator, count(*) AS n FROM {message} m, {has_tag} h, {tag} t WHERE h.message = m.id AND t.id = h.tag GROUP BY ALL),
        ok AS (SELECT name, day, creator, n FROM w x WHERE (name = :tag_a AND day = :day_a OR name = :tag_b AND day = :day_b) AND (SELECT count(*) FROM {knows} k, w y WHERE k.src = x.creator AND y.creator = k.dst AND y.name = x.name AND y.day = x.day) <= :most)
        SELECT a.creator AS person, a.n AS on_a, b.n AS on_b FROM ok a, ok b WHERE b.creator = a.creator AND a.name = :tag_a AND a.day = :day_a AND b.name = :tag_b AND b.day = :day_b ORDER BY a.n + b.n DESC, person LIMIT 20""",
    "bi_q17": """
        WITH x AS (SELECT DISTINCT h.message FROM {has_tag} h, {tag} t WHERE t.id = h.tag AND t.name = :tag), m AS (SELECT m.*, t.forum AS at FROM {message} m, {thread} t WHERE t.id = m.id AND m.id IN (FROM x)),
        hit AS (SELECT DISTINCT m1.creator AS p1, m2.id, m2.at FROM m m1, m m2, m c WHERE c.parent = m2.id AND c.creator <> m2.creator AND m1.at <> m2.at AND m2.ms > m1.ms + :delta * 3600000
          AND EXISTS (SELECT 1 FROM {member} z WHERE z.forum = m1.at AND z.person = c.creator) AND EXISTS (SELECT 1 FROM {member} z WHERE z.forum = m1.at AND z.person = m2.creator))
        SELECT p1 AS person, count(DISTINCT id) AS messages FROM hit ANTI JOIN {member} z ON z.forum = hit.at AND z.person = hit.p1 GROUP BY p1 ORDER BY messages DESC, person LIMIT 10""",
    "bi_q18": """
        WITH fan AS (SELECT person FROM {interest} WHERE tag = (SELECT id FROM {tag} WHERE name = :tag)), f AS (SELECT src, list_distinct(list(dst)) AS friends FROM {knows} WHERE src IN (FROM fan) GROUP BY src)
        SELECT a.src AS person1, b.src AS person2, len(list_intersect(a.friends, b.friends)) AS mutual FROM f a, f b
        WHERE a.src <> b.src AND NOT list_contains(a.friends, b.src) AND len(list_intersect(a.friends, b.friends)) > 0 ORDER BY mutual DESC, person1, person2 LIMIT 20""",
    "ic3": """
        SELECT id AS person, in_x, in_y FROM (
          SELECT n.id, (SELECT count(*) FROM {message} m WHERE m.creator = n.id AND m.country = :x AND m.day BETWEEN :day AND :day + :dur - 1) AS in_x,
            (SELECT count(*) FROM {message} m WHERE m.creator = n.id AND m.country = :y AND m.day BETWEEN :day AND :day + :dur - 1) AS in_y
          FROM {near} n, {person} p WHERE p.id = n.id AND n.d IN (1, 2) AND p.country <> :x AND p.country <> :y) z
        WHERE in_x > 0 AND in_y > 0 ORDER BY in_x + in_y DESC, person LIMIT 20""",
    "ic4": """
        WITH p AS (SELECT t.name, m.day FROM {post} m, {has_tag} h, {tag} t WHERE h.message = m.id AND t.id = h.tag AND m.creator IN (SELECT dst FROM {knows} WHERE src = :person)),
        new AS (SELECT DISTINCT name FROM p EXCEPT SELECT name FROM p WHERE day < :day)
        SELECT name, count(*) AS posts FROM p WHERE name IN (FROM new) AND day < :day + :dur GROUP BY name ORDER BY posts DESC, name LIMIT 10""",
    "ic7": """
        WITH l AS (SELECT k.person, arg_min(k.message, (-k.ld, k.message)) AS message, max(k.ld) AS ld FROM {likes} k SEMI JOIN (SELECT id AS message FROM {message} WHERE creator = :person) m USING (message) GROUP BY k.person)
        SELECT person, message, ld, (SELECT count(*) FROM {knows} k WHERE k.src = :person AND k.dst = l.person) = 0 AS is_new FROM l ORDER BY ld DESC, person LIMIT 20""",
    "ic10": """
        WITH c AS (SELECT n.id FROM {near} n, {person} p WHERE p.id = n.id AND n.d = 2 AND ((p.bmon = :month AND p.bdom > 20) OR (p.bmon = CASE WHEN :month = 12 THEN 1 ELSE :month + 1 END AND p.bdom <= 21))),
        hit AS (SELECT DISTINCT h.message FROM {has_tag} h, {interest} i WHERE i.tag = h.tag AND i.person = :person)
        SELECT id AS person, 2 * (SELECT count(*) FROM {post} m WHERE m.creator = c.id AND m.id IN (FROM hit)) - (SELECT count(*) FROM {post} m WHERE m.creator = c.id) AS score FROM c ORDER BY score DESC, person LIMIT 10""",
    "is7": """
        SELECT c.id AS message, c.ms, c.creator AS person, c.creator <> m.creator AND (m.creator, c.creator) IN (SELECT (src, dst) FROM {knows}) AS knows FROM {comment} c, {message} m WHERE m.id = :message AND c.parent = m.id""",
    "cr7": """
        WITH a AS (SELECT src AS o, amt FROM {transfer} WHERE dst = :account AND amt > :t AND ts BETWEEN :lo AND :hi QUALIFY row_number() OVER (ORDER BY ts, src, amt) <= :limit),
        b AS (SELECT dst AS o, amt FROM {transfer} WHERE src = :account AND amt > :t AND ts BETWEEN :lo AND :hi QUALIFY row_number() OVER (ORDER BY ts, dst, amt) <= :limit)
        SELECT (SELECT count(DISTINCT o) FROM a) AS sources, (SELECT count(DISTINCT o) FROM b) AS targets, coalesce(round(coalesce((SELECT sum(amt) FROM a), 0) / nullif((SELECT sum(amt) FROM b), 0), 3), -1.0) AS ratio""",
    "cr9": """
        WITH s AS (SELECT 'r' AS k, amt, row_number() OVER (ORDER BY ts, dst, amt) AS rk FROM {repay} WHERE src = :account AND ts BETWEEN :lo AND :hi
          UNION ALL SELECT 'd', amt, row_number() OVER (ORDER BY ts, src, amt) FROM {deposit} WHERE dst = :account AND ts BETWEEN :lo AND :hi
          UNION ALL SELECT 'o', amt, row_number() OVER (ORDER BY ts, dst, amt) FROM {transfer} WHERE src = :account AND amt >= :t AND ts BETWEEN :lo AND :hi
          UNION ALL SELECT 'i', amt, row_number() OVER (ORDER BY ts, src, amt) FROM {transfer} WHERE dst = :account AND amt >= :t AND ts BETWEEN :lo AND :hi),
        x AS (SELECT coalesce(sum(amt) FILTER (k = 'r'), 0) AS r, sum(amt) FILTER (k = 'd') AS d, coalesce(sum(amt) FILTER (k = 'o'), 0) AS o, sum(amt) FILTER (k = 'i') AS i FROM s WHERE rk <= :limit)
        SELECT coalesce(round(r / nullif(d, 0), 3), -1.0) AS repay_deposit, coalesce(round(r / nullif(i, 0), 3), -1.0) AS repay_in, coalesce(round(o / nullif(i, 0), 3), -1.0) AS out_in FROM x""",
    "cr12": """
        WITH mine AS (SELECT dst FROM {own} WHERE src = :person QUALIFY row_number() OVER (ORDER BY dst) <= :limit), firm AS (SELECT o.dst FROM {own} o SEMI JOIN {company} c ON c.id = o.src),
        t AS (SELECT src, dst, amt FROM {transfer} WHERE src IN (FROM mine) AND ts BETWEEN :lo AND :hi QUALIFY row_number() OVER (PARTITION BY src ORDER BY amt DESC, dst, ts) <= :limit)
        SELECT dst AS account, round(sum(amt), 6) AS total FROM t WHERE dst IN (FROM firm) GROUP BY dst""",
    "spb_q9": """
        WITH a AS (SELECT DISTINCT entity FROM {about} WHERE work = :work), m AS (SELECT DISTINCT entity FROM {mentions} WHERE work = :work),
        s AS (SELECT id, 2.0 * (SELECT count(DISTINCT entity) FROM {about} x WHERE x.work = w.id AND entity IN (FROM a)) + 1.0 * (SELECT count(DISTINCT entity) FROM {about} x WHERE x.work = w.id AND entity IN (FROM m))
            + 1.5 * (SELECT count(DISTINCT entity) FROM {mentions} x WHERE x.work = w.id AND entity IN (FROM a)) + 0.5 * (SELECT count(DISTINCT entity) FROM {mentions} x WHERE x.work = w.id AND entity IN (FROM m)) AS score, uri, modified
          FROM {work} w WHERE id <> :work AND modified IS NOT NULL)
        SELECT uri, CAST(score AS DOUBLE) AS score, modified FROM s WHERE score > 0 ORDER BY score DESC, modified DESC, uri LIMIT 20""",
    "spb_a21": """
        SELECT uri FROM {work} w SEMI JOIN {hits} h ON h.id = w.id WHERE category = :category AND audience = :audience AND (SELECT count(*) FROM {tagged} t WHERE t.work = w.id) > 0 ORDER BY uri LIMIT 500""",
    "spb_a22": """
        SELECT uri FROM {work} w SEMI JOIN {hits} h ON h.id = w.id WHERE len(list_filter([title, description, format, category, audience, created], lambda x: x IS NULL)) = 0 AND live
          AND audience = :audience AND created BETWEEN :after AND :before AND (SELECT count(*) FROM {tagged} t WHERE t.work = w.id) > 0 ORDER BY uri LIMIT 500""",
}
