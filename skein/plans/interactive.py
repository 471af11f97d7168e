"""Interactive queries over the social graph. ``near`` holds persons by hops from :person."""

_FRIEND = "SELECT DISTINCT dst FROM {knows} WHERE src = :person"

QUERIES = {
    "ic1": ("SELECT n.id AS person, p.lname, n.d FROM {near} n JOIN {person} p ON p.id = n.id WHERE n.d BETWEEN 1 AND 3 AND p.fname = :name ORDER BY n.d, p.lname, n.id LIMIT 20", {"person": 17, "name": "N5", "hops": 3}),
    "ic2": (f"SELECT m.creator AS person, m.id AS message, m.ms FROM {{message}} m WHERE m.creator IN ({_FRIEND}) AND m.day <= :day ORDER BY m.ms DESC, m.id LIMIT 20", {"person": 17, "day": 9900}),
    "ic3": ("""
        SELECT n.id AS person, count(CASE WHEN m.country = :x THEN 1 END) AS in_x, count(CASE WHEN m.country = :y THEN 1 END) AS in_y
        FROM {near} n JOIN {person} p ON p.id = n.id JOIN {message} m ON m.creator = n.id
        WHERE n.d BETWEEN 1 AND 2 AND p.country NOT IN (:x, :y) AND m.country IN (:x, :y) AND m.day >= :day AND m.day < :day + :dur GROUP BY n.id
        HAVING count(CASE WHEN m.country = :x THEN 1 END) > 0 AND count(CASE WHEN m.country = :y THEN 1 END) > 0
        ORDER BY in_x + in_y DESC, person LIMIT 20""", {"person": 17, "x": 105, "y": 110, "day": 8000, "dur": 2500, "hops": 2}),
    "ic4": (f"""
        SELECT t.name, count(CASE WHEN m.day >= :day AND m.day < :day + :dur THEN 1 END) AS posts FROM {{post}} m JOIN {{has_tag}} h ON h.message = m.id JOIN {{tag}} t ON t.id = h.tag
        WHERE m.creator IN ({_FRIEND}) GROUP BY t.name HAVING min(m.day) >= :day AND count(CASE WHEN m.day >= :day AND m.day < :day + :dur THEN 1 END) > 0
        ORDER BY posts DESC, t.name LIMIT 10""", {"person": 17, "day": 9000, "dur": 600}),
    "ic5": ("""
        SELECT f.title, f.id AS forum, count(*) AS posts FROM {member} mb JOIN {near} n ON n.id = mb.person JOIN {post} p ON p.forum = mb.forum AND p.creator = mb.person JOIN {forum} f ON f.id = mb.forum
        WHERE n.d BETWEEN 1 AND 2 AND mb.hd > :day GROUP BY f.id, f.title ORDER BY posts DESC, f.id LIMIT 20""", {"person": 17, "day": 7800, "hops": 2}),
    "ic6": ("""
        SELECT o.name, count(DISTINCT m.id) AS posts FROM {near} n JOIN {post} m ON m.creator = n.id JOIN {has_tag} h ON h.message = m.id JOIN {tag} t ON t.id = h.tag JOIN {has_tag} g ON g.message = m.id AND g.tag <> h.tag JOIN {tag} o ON o.id = g.tag
        WHERE n.d BETWEEN 1 AND 2 AND t.name = :tag GROUP BY o.name ORDER BY posts DESC, o.name LIMIT 10""", {"person": 17, "tag": "tag52", "hops": 2}),
    "ic7": (f"""
        SELECT person, message, ld, NOT coalesce(person IN ({_FRIEND}), FALSE) AS is_new FROM (
          SELECT k.person, k.message, k.ld, row_number() OVER (PARTITION BY k.person ORDER BY k.ld DESC, k.message) AS rn FROM {{likes}} k JOIN {{message}} m ON m.id = k.message WHERE m.creator = :person) x
        WHERE rn = 1 ORDER BY ld DESC, person LIMIT 20""", {"person": 17}),
    "ic8": ("SELECT c.creator AS person, c.id AS message, c.ms FROM {comment} c JOIN {message} m ON m.id = c.parent WHERE m.creator = :person ORDER BY c.ms DESC, c.id LIMIT 20", {"person": 17}),
    "ic9": ("SELECT m.creator AS person, m.id AS message, m.ms FROM {message} m JOIN {near} n ON n.id = m.creator WHERE n.d BETWEEN 1 AND 2 AND m.day <= :day ORDER BY m.ms DESC, m.id LIMIT 20", {"person": 17, "day": 9900, "hops": 2}),
    "ic10": ("""
        WITH mine AS (SELECT DISTINCT tag FROM {interest} WHERE person = :person),
        cand AS (SELECT n.id FROM {near} n JOIN {person} p ON p.id = n.id WHERE n.d = 2 AND (p.bmon = :month AND p.bdom >= 21 OR p.bmon = :month % 12 + 1 AND p.bdom < 22)),
        s AS (SELECT m.creator, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM {has_tag} h JOIN mine ON mine.tag = h.tag WHERE h.message = m.id) THEN 1 ELSE -1 END) AS BIGINT) AS s FROM {post} m WHERE m.creator IN (SELECT id FROM cand) GROUP BY m.creator)
        SELECT c.id AS person, coalesce(s.s, 0) AS score FROM cand c LEFT JOIN s ON s.creator = c.id ORDER BY score DESC, person LIMIT 10""", {"person": 17, "month": 5, "hops": 2}),
    "ic11": ("""
        SELECT n.id AS person, o.name AS company, w.wf FROM {near} n JOIN {work_at} w ON w.person = n.id JOIN {org} o ON o.id = w.org LEFT JOIN {place} pl ON pl.id = o.place
        WHERE n.d BETWEEN 1 AND 2 AND w.wf < :year AND o.label = 'Company' AND (o.place = :country OR pl.part_of = :country) ORDER BY w.wf, n.id, o.name DESC LIMIT 10""", {"person": 17, "country": 110, "year": 2012, "hops": 2}),
    "ic12": (f"""
        SELECT c.creator AS person, count(DISTINCT c.id) AS replies, $names(t.name) AS tags
        FROM {{comment}} c JOIN {{post}} p ON p.id = c.parent JOIN {{has_tag}} h ON h.message = p.id JOIN {{tag}} t ON t.id = h.tag JOIN {{under}} u ON u.id = t.class
        WHERE u.up = :class AND c.creator IN ({_FRIEND}) GROUP BY c.creator ORDER BY replies DESC, person LIMIT 20""", {"person": 17, "class": 11}),
    "ic13": ("SELECT coalesce(max(d), -1) AS hops FROM {near} WHERE id = :target", {"person": 17, "target": 400}),
    "ic14": ("SELECT round(max(dist), 6) AS cost FROM {reach} WHERE id = :target", {"source": 17, "target": 400}),
    "is1": ("SELECT fname, lname, pday FROM {person} WHERE id = :person", {"person": 17}),
    "is2": ("SELECT id AS message, ms FROM {message} WHERE creator = :person AND day <= :day ORDER BY ms DESC, id LIMIT 10", {"person": 17, "day": 10400}),
    "is3": ("SELECT DISTINCT dst AS person FROM {knows} WHERE src = :person ORDER BY person", {"person": 17}),
    "is4": ("SELECT ms, content FROM {message} WHERE id = :message", {"message": 100}),
    "is5": ("SELECT creator AS person FROM {message} WHERE id = :message", {"message": 100}),
    "is6": ("SELECT f.id AS forum, f.title, f.moderator FROM {thread} th JOIN {forum} f ON f.id = th.forum WHERE th.id = :message", {"message": 103}),
    "is7": ("""
        SELECT c.id AS message, c.ms, c.creator AS person, c.creator <> m.creator AND k.src IS NOT NULL AS knows FROM {comment} c JOIN {message} m ON m.id = c.parent
        LEFT JOIN (SELECT DISTINCT src, dst FROM {knows}) k ON k.src = m.creator AND k.dst = c.creator WHERE m.id = :message ORDER BY c.ms DESC, c.creator, c.id""", {"message": 100}),
    # seeds of the interactive runs
    "ic_seed": ("SELECT src AS person, count(*) AS degree FROM {knows} GROUP BY src ORDER BY degree DESC, src LIMIT 1", {}),
    "ic_seed_name": ("SELECT p.fname, count(*) AS n FROM {near} n JOIN {person} p ON p.id = n.id WHERE n.d BETWEEN 1 AND 3 GROUP BY p.fname ORDER BY n DESC, p.fname LIMIT 1", {"person": 17, "hops": 3}),
    "ic_seed_far": ("SELECT id AS person, d FROM {near} ORDER BY d DESC, id LIMIT 1", {"person": 17}),
}
