"""Analytical queries over the social graph, as SQL text over its tables.

Tables in braces, parameters with a colon. Every order is total; ids break ties. ``thread``
(message, root post, its forum) comes from pointer jumping, ``near`` from hop counting and
``reach`` from relaxation; these are passed in as DataFrames.
"""

QUERIES = {
    # messages before a day, by year, kind and length class; total counts all of them, without content too
    "bi_q1": ("""
        SELECT year, is_comment, cat, messages, length_sum, total FROM (
          SELECT year, is_comment, content, cat, count(*) AS messages, CAST(sum(len) AS BIGINT) AS length_sum, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM (
            SELECT year, is_comment, content, len, CASE WHEN len < 40 THEN 0 WHEN len < 80 THEN 1 WHEN len < 160 THEN 2 ELSE 3 END AS cat FROM {message} WHERE day < :day) m
          GROUP BY year, is_comment, content, cat) g
        WHERE content ORDER BY year DESC, is_comment, cat""", {"day": 9900}),
    # tags of a class in two windows of 100 days
    "bi_q2": ("""
        SELECT t.name, count(CASE WHEN m.day >= :day AND m.day < :day + 100 THEN 1 END) AS w1,
          count(CASE WHEN m.day >= :day + 100 AND m.day < :day + 200 THEN 1 END) AS w2,
          CAST(abs(count(CASE WHEN m.day >= :day AND m.day < :day + 100 THEN 1 END) - count(CASE WHEN m.day >= :day + 100 AND m.day < :day + 200 THEN 1 END)) AS BIGINT) AS diff
        FROM {tag} t JOIN {tagclass} c ON c.id = t.class LEFT JOIN {has_tag} h ON h.tag = t.id
        LEFT JOIN {message} m ON m.id = h.message AND m.day >= :day AND m.day < :day + 200
        WHERE c.name = :class GROUP BY t.id, t.name ORDER BY diff DESC, t.name LIMIT 100""", {"day": 9000, "class": "Brand#13"}),
    # forums moderated from a country with messages of a class in their threads
    "bi_q3": ("""
        SELECT f.id AS forum, f.title, f.fday, f.moderator, count(DISTINCT th.id) AS messages
        FROM {forum} f JOIN {person} p ON p.id = f.moderator JOIN {thread} th ON th.forum = f.id
        WHERE p.country = :country AND th.id IN (SELECT h.message FROM {has_tag} h JOIN {tag} t ON t.id = h.tag JOIN {tagclass} c ON c.id = t.class WHERE c.name = :class)
        GROUP BY f.id, f.title, f.fday, f.moderator ORDER BY messages DESC, f.id LIMIT 20""", {"country": 105, "class": "Brand#13"}),
    # creators in the forums with the largest share of one country, and these forums; members without a message stay
    "bi_q4": ("""
        WITH cohort AS (
          SELECT m.forum, p.country, count(*) AS n FROM {member} m JOIN {person} p ON p.id = m.person JOIN {forum} f ON f.id = m.forum WHERE f.fday > :day GROUP BY m.forum, p.country),
        top AS (SELECT forum, max(n) AS n FROM cohort GROUP BY forum ORDER BY n DESC, forum LIMIT :k),
        members AS (SELECT DISTINCT m.person FROM {member} m WHERE m.forum IN (SELECT forum FROM top)),
        wrote AS (SELECT m.creator, count(*) AS n FROM {message} m JOIN {thread} th ON th.id = m.id WHERE th.forum IN (SELECT forum FROM top) GROUP BY m.creator)
        SELECT members.person, coalesce(wrote.n, 0) AS messages, f.forums FROM members CROSS JOIN (SELECT $ids(forum) AS forums FROM top) f LEFT JOIN wrote ON wrote.creator = members.person
        ORDER BY messages DESC, members.person LIMIT 100""", {"day": 8000, "k": 100}),
    # posters of a tag: messages, replies, likes and their score
    "bi_q5": ("""
        WITH tagged AS (SELECT DISTINCT m.id, m.creator FROM {has_tag} h JOIN {tag} t ON t.id = h.tag JOIN {message} m ON m.id = h.message WHERE t.name = :tag),
        r AS (SELECT parent, count(*) AS n FROM {comment} WHERE parent IN (SELECT id FROM tagged) GROUP BY parent),
        l AS (SELECT message, count(*) AS n FROM {likes} WHERE message IN (SELECT id FROM tagged) GROUP BY message)
        SELECT t.creator AS person, count(*) AS messages, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS replies, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS liked,
          CAST(count(*) + 2 * coalesce(sum(r.n), 0) + 10 * coalesce(sum(l.n), 0) AS BIGINT) AS score
        FROM tagged t LEFT JOIN r ON r.parent = t.id LEFT JOIN l ON l.message = t.id GROUP BY t.creator ORDER BY score DESC, person LIMIT 100""", {"tag": "tag52"}),
    # authority of the creators of a tag: likes that their likers received; creators without likers drop out
    "bi_q6": ("""
        WITH pairs AS (SELECT DISTINCT m.creator AS p1, k.person AS p2 FROM {has_tag} h JOIN {tag} t ON t.id = h.tag JOIN {message} m ON m.id = h.message
          JOIN {likes} k ON k.message = m.id WHERE t.name = :tag),
        got AS (SELECT m.creator, count(*) AS n FROM {likes} k JOIN {message} m ON m.id = k.message GROUP BY m.creator)
        SELECT p1 AS person, CAST(sum(coalesce(got.n, 0)) AS BIGINT) AS score FROM pairs LEFT JOIN got ON got.creator = pairs.p2 GROUP BY p1 ORDER BY score DESC, person LIMIT 100""",
        {"tag": "tag52"}),
    # tags of comments that reply to a tag and lack it
    "bi_q7": ("""
        WITH target AS (SELECT id FROM {tag} WHERE name = :tag), tagged AS (SELECT message FROM {has_tag} WHERE tag IN (SELECT id FROM target)),
        other AS (SELECT c.id FROM {comment} c WHERE c.parent IN (SELECT message FROM tagged) AND NOT EXISTS (SELECT 1 FROM tagged x WHERE x.message = c.id))
        SELECT t.name, count(DISTINCT h.message) AS comments FROM other JOIN {has_tag} h ON h.message = other.id JOIN {tag} t ON t.id = h.tag
        GROUP BY t.name ORDER BY comments DESC, t.name LIMIT 100""", {"tag": "tag52"}),
    # central persons of a tag: own score and friends' scores
    "bi_q8": ("""
        WITH target AS (SELECT id FROM {tag} WHERE name = :tag),
        score AS (SELECT person, CAST(sum(s) AS BIGINT) AS s FROM (
          SELECT DISTINCT person, 100 AS s FROM {interest} WHERE tag IN (SELECT id FROM target)
          UNION ALL SELECT m.creator, count(*) FROM {message} m JOIN {has_tag} h ON h.message = m.id WHERE h.tag IN (SELECT id FROM target) AND m.day > :lo AND m.day < :hi GROUP BY m.creator) x GROUP BY person),
        friends AS (SELECT k.src AS person, CAST(sum(f.s) AS BIGINT) AS s FROM {knows} k JOIN score f ON f.person = k.dst GROUP BY k.src)
        SELECT s.person, s.s AS score, coalesce(f.s, 0) AS friends_score FROM score s LEFT JOIN friends f ON f.person = s.person
        ORDER BY s.s + coalesce(f.s, 0) DESC, s.person LIMIT 100""", {"tag": "tag52", "lo": 8000, "hi": 10500}),
    # thread starters: threads and messages in the window (replies never precede what they answer)
    "bi_q9": ("""
        SELECT th.starter AS person, count(DISTINCT th.root) AS threads, count(*) AS messages FROM {thread} th JOIN {message} m ON m.id = th.id
        WHERE th.root_day BETWEEN :lo AND :hi AND (NOT m.is_comment OR m.day BETWEEN :lo AND :hi) GROUP BY th.starter ORDER BY messages DESC, person LIMIT 100""", {"lo": 9000, "hi": 9300}),
    # experts at some hops from a person, in a country, on every tag of messages of a class
    "bi_q10": ("""
        WITH expert AS (SELECT n.id FROM {near} n JOIN {person} p ON p.id = n.id WHERE n.d BETWEEN :min AND :max AND p.country = :country),
        msg AS (SELECT DISTINCT m.id, m.creator FROM {message} m JOIN expert e ON e.id = m.creator JOIN {has_tag} h ON h.message = m.id JOIN {tag} t ON t.id = h.tag JOIN {tagclass} c ON c.id = t.class WHERE c.name = :class)
        SELECT m.creator AS person, t.name AS tag, count(DISTINCT m.id) AS messages FROM msg m JOIN {has_tag} h ON h.message = m.id JOIN {tag} t ON t.id = h.tag
        GROUP BY m.creator, t.name ORDER BY messages DESC, tag, person LIMIT 100""", {"person": 17, "min": 2, "max": 3, "country": 105, "class": "Brand#13"}),
    # triangles of friends in a country within a window; edges point from the smaller id
    "bi_q11": ("""
        WITH local AS (SELECT k.src, k.dst FROM {knows} k JOIN {person} a ON a.id = k.src JOIN {person} b ON b.id = k.dst
          WHERE k.src < k.dst AND a.country = :country AND b.country = :country AND k.kd BETWEEN :lo AND :hi)
        SELECT count(*) AS triangles FROM local x JOIN local y ON y.src = x.dst JOIN local z ON z.src = x.src AND z.dst = y.dst""", {"country": 105, "lo": 7000, "hi": 9999}),
    # how many persons have how many messages, those without any too
    "bi_q12": ("""
        WITH per AS (SELECT m.creator, count(*) AS n FROM {message} m JOIN {thread} th ON th.id = m.id
          WHERE m.content AND m.len < :len AND m.day > :day AND th.root_lang IN (:langs) GROUP BY m.creator)
        SELECT messages, count(*) AS persons FROM (SELECT p.id, coalesce(per.n, 0) AS messages FROM {person} p LEFT JOIN per ON per.creator = p.id) x
        GROUP BY messages ORDER BY persons DESC, messages DESC""", {"len": 120, "day": 8800, "langs": ("en", "fr")}),
    # persons of a country with less than a message a month, and who likes them
    "bi_q13": ("""
        WITH zombie AS (SELECT p.id FROM {person} p LEFT JOIN (SELECT creator, count(*) AS n FROM {message} WHERE day < :day GROUP BY creator) m ON m.creator = p.id
          WHERE p.country = :country AND coalesce(p.pday, 0) < :day AND :ym - p.pym + 1 > 0 AND coalesce(m.n, 0) < :ym - p.pym + 1),
        liked AS (SELECT m.creator, count(CASE WHEN k.person IN (SELECT id FROM zombie) THEN 1 END) AS zlc, count(*) AS tlc
          FROM {likes} k JOIN {message} m ON m.id = k.message JOIN {person} p ON p.id = k.person WHERE coalesce(p.pday, 0) < :day GROUP BY m.creator)
        SELECT z.id AS person, coalesce(l.zlc, 0) AS zombie_likes, coalesce(l.tlc, 0) AS likes, CASE WHEN coalesce(l.tlc, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(l.zlc AS DOUBLE) / l.tlc END AS score
        FROM zombie z LEFT JOIN liked l ON l.creator = z.id ORDER BY score DESC, person LIMIT 100""", {"country": 105, "day": 10400, "ym": 24000}),
    # best pair of friends of two countries for each city of the first
    "bi_q14": ("""
        WITH pair AS (SELECT DISTINCT k.src AS p1, k.dst AS p2, a.city FROM {knows} k JOIN {person} a ON a.id = k.src JOIN {person} b ON b.id = k.dst WHERE a.country = :c1 AND b.country = :c2),
        who AS (SELECT p1 AS id FROM pair UNION SELECT p2 FROM pair),
        said AS (SELECT id, creator FROM {message} WHERE creator IN (SELECT id FROM who)),
        reply AS (SELECT DISTINCT c.creator AS a, m.creator AS b FROM {comment} c JOIN said m ON m.id = c.parent WHERE c.creator IN (SELECT id FROM who)),
        lik AS (SELECT DISTINCT k.person AS a, m.creator AS b FROM {likes} k JOIN said m ON m.id = k.message WHERE k.person IN (SELECT id FROM who)),
        scored AS (SELECT p.p1, p.p2, p.city, CASE WHEN r1.a IS NULL THEN 0 ELSE 4 END + CASE WHEN r2.a IS NULL THEN 0 ELSE 1 END + CASE WHEN l1.a IS NULL THEN 0 ELSE 10 END + CASE WHEN l2.a IS NULL THEN 0 ELSE 1 END AS score
          FROM pair p LEFT JOIN reply r1 ON r1.a = p.p1 AND r1.b = p.p2 LEFT JOIN reply r2 ON r2.a = p.p2 AND r2.b = p.p1
          LEFT JOIN lik l1 ON l1.a = p.p1 AND l1.b = p.p2 LEFT JOIN lik l2 ON l2.a = p.p2 AND l2.b = p.p1)
        SELECT p1, p2, c.name AS city, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, p1, p2) AS rn FROM scored) s JOIN {place} c ON c.id = s.city
        WHERE rn = 1 ORDER BY score DESC, p1, p2 LIMIT 100""", {"c1": 105, "c2": 107}),
    # cheapest path between two persons over friends, cheaper the more they answer each other
    "bi_q15": ("SELECT coalesce(round(max(dist), 6), -1.0) AS cost FROM {reach} WHERE id = :target", {"source": 17, "target": 400, "lo": 7800, "hi": 8400}),
    # persons who wrote on a tag on a day, with few friends who did so too, for both of two tags and days
    "bi_q16": ("""
        WITH a AS (SELECT m.creator, count(*) AS n FROM {message} m JOIN {has_tag} h ON h.message = m.id JOIN {tag} t ON t.id = h.tag WHERE t.name = :tag_a AND m.day = :day_a GROUP BY m.creator),
        b AS (SELECT m.creator, count(*) AS n FROM {message} m JOIN {has_tag} h ON h.message = m.id JOIN {tag} t ON t.id = h.tag WHERE t.name = :tag_b AND m.day = :day_b GROUP BY m.creator),
        fa AS (SELECT k.src, count(*) AS n FROM {knows} k JOIN a ON a.creator = k.dst WHERE k.src IN (SELECT creator FROM a) GROUP BY k.src),
        fb AS (SELECT k.src, count(*) AS n FROM {knows} k JOIN b ON b.creator = k.dst WHERE k.src IN (SELECT creator FROM b) GROUP BY k.src)
        SELECT a.creator AS person, a.n AS on_a, b.n AS on_b FROM a JOIN b ON b.creator = a.creator LEFT JOIN fa ON fa.src = a.creator LEFT JOIN fb ON fb.src = b.creator
        WHERE coalesce(fa.n, 0) <= :most AND coalesce(fb.n, 0) <= :most ORDER BY a.n + b.n DESC, person LIMIT 20""", {"tag_a": "tag17", "day_a": 10009, "tag_b": "tag18", "day_b": 10009, "most": 4}),
    # who spreads a tag from one forum to another
    "bi_q17": ("""
        WITH msg AS (SELECT m.id, m.creator, m.ms, m.parent, m.is_comment, th.forum FROM {message} m JOIN {thread} th ON th.id = m.id JOIN (SELECT DISTINCT x.message FROM {has_tag} x JOIN {tag} t ON t.id = x.tag WHERE t.name = :tag) h ON h.message = m.id),
        link AS (SELECT c.creator AS p2, m2.creator AS p3, m2.id AS msg2, m2.ms AS ms2, m2.forum AS f2 FROM msg c JOIN msg m2 ON m2.id = c.parent WHERE c.is_comment AND c.creator <> m2.creator),
        seen AS (SELECT DISTINCT a.forum, l.msg2, l.ms2, l.f2 FROM link l JOIN {member} a ON a.person = l.p2 JOIN {member} b ON b.forum = a.forum AND b.person = l.p3 WHERE a.forum <> l.f2),
        hit AS (SELECT DISTINCT m1.creator AS p1, l.msg2, l.f2 FROM seen l JOIN msg m1 ON m1.forum = l.forum WHERE l.ms2 > m1.ms + :delta * 3600000)
        SELECT hit.p1 AS person, count(DISTINCT hit.msg2) AS messages FROM hit WHERE NOT EXISTS (SELECT 1 FROM {member} x WHERE x.forum = hit.f2 AND x.person = hit.p1)
        GROUP BY hit.p1 ORDER BY messages DESC, person LIMIT 10""", {"tag": "tag52", "delta": 1}),
    # strangers with a common interest and many common friends
    "bi_q18": ("""
        WITH fan AS (SELECT DISTINCT i.person FROM {interest} i JOIN {tag} t ON t.id = i.tag WHERE t.name = :tag)
        SELECT x.src AS person1, y.dst AS person2, count(DISTINCT x.dst) AS mutual FROM {knows} x JOIN {knows} y ON y.src = x.dst AND y.dst <> x.src
        WHERE x.src IN (SELECT person FROM fan) AND y.dst IN (SELECT person FROM fan) AND NOT EXISTS (SELECT 1 FROM {knows} z WHERE z.src = x.src AND z.dst = y.dst)
        GROUP BY x.src, y.dst ORDER BY mutual DESC, person1, person2 LIMIT 20""", {"tag": "tag50"}),
    # cheapest ways from one city to another
    "bi_q19": ("""
        SELECT source AS person1, r.id AS person2, round(dist, 6) AS cost FROM {reach} r JOIN {person} p ON p.id = r.id WHERE p.city = :city2
        ORDER BY cost, person1, person2 LIMIT 20""", {"city1": 10050, "city2": 10070}),
    # employees of a company by their distance from a person over study friends
    "bi_q20": ("""
        SELECT r.id AS person, round(r.dist, 6) AS cost FROM {reach} r JOIN {work_at} w ON w.person = r.id WHERE w.org = :org AND r.id <> :person
        ORDER BY cost, person LIMIT 20""", {"org": 512, "person": 29}),
    "bi1_cotags": ("""
        SELECT count(*) AS pairs FROM (SELECT DISTINCT a.tag AS x, b.tag AS y FROM {has_tag} a JOIN {has_tag} b ON b.message = a.message AND b.tag > a.tag) p""", {}),
    "bi3_tags_used": ("SELECT count(DISTINCT tag) AS tags FROM {has_tag}", {}),
    "bi4_comment_creators": ("SELECT count(DISTINCT creator) AS persons FROM {comment}", {}),
    "bi5_post_creators": ("SELECT count(DISTINCT creator) AS persons FROM {post}", {}),
    "bi_reachability": ("SELECT count(*) AS persons, CAST(max(d) AS BIGINT) AS eccentricity FROM {near}", {"person": 1}),
}

#: Weighted relations of the path queries (src, dst, weight), over tables in braces, with the same parameters.
WEIGHTS = {
    "bi_q15": ("""
        SELECT k.src, k.dst, 1.0 / (1.0 + coalesce(w.w, 0.0)) AS weight FROM (SELECT DISTINCT src, dst FROM {knows}) k LEFT JOIN (
          SELECT a, b, CAST(sum(v) AS DOUBLE) AS w FROM (
            SELECT least(c.creator, m.creator) AS a, greatest(c.creator, m.creator) AS b, CASE WHEN m.is_comment THEN 0.5 ELSE 1.0 END AS v
            FROM {comment} c JOIN {message} m ON m.id = c.parent JOIN {thread} th ON th.id = c.id JOIN {forum} f ON f.id = th.forum WHERE f.fday BETWEEN :lo AND :hi) x GROUP BY a, b
        ) w ON w.a = least(k.src, k.dst) AND w.b = greatest(k.src, k.dst)"""),
    "bi_q19": ("""
        SELECT k.src, k.dst, 1.0 / w.n AS weight FROM (SELECT DISTINCT src, dst FROM {knows}) k JOIN (
          SELECT least(c.creator, m.creator) AS a, greatest(c.creator, m.creator) AS b, count(*) AS n FROM {comment} c JOIN {message} m ON m.id = c.parent GROUP BY 1, 2
        ) w ON w.a = least(k.src, k.dst) AND w.b = greatest(k.src, k.dst)"""),
    "bi_q20": ("""
        SELECT k.src, k.dst, CAST(min(abs(a.cy - b.cy)) + 1 AS DOUBLE) AS weight FROM {knows} k JOIN {study_at} a ON a.person = k.src JOIN {study_at} b ON b.person = k.dst AND b.org = a.org GROUP BY k.src, k.dst"""),
    "ic14": ("""
        SELECT k.src, k.dst, 1.0 / (1.0 + coalesce(w.n, 0)) AS weight FROM (SELECT DISTINCT src, dst FROM {knows}) k LEFT JOIN (
          SELECT least(c.creator, m.creator) AS a, greatest(c.creator, m.creator) AS b, count(*) AS n FROM {comment} c JOIN {message} m ON m.id = c.parent GROUP BY 1, 2
        ) w ON w.a = least(k.src, k.dst) AND w.b = greatest(k.src, k.dst)"""),
}
