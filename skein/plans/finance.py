"""Temporal transfer queries over the financial graph.

Traces that depend on who claims a node first are unrolled level by level: each node's
edges are ranked and cut at the limit, a neighbour belongs to the first (claim order, edge
rank) that reaches it, and the claim order of the next level is the pair of both, so no
global sort is needed. Ties at a cut go by neighbour id. ``limit`` is at most 99,999.
"""

from __future__ import annotations

#: Edges that a trace may follow from a node: a claim's place is its predecessor's times a hundred thousand, plus its rank.
MOST = 99_999


def claims(start: str, edges: str, levels: int, key: str, order: str, early: str = "TRUE", late: str = "TRUE", carry: str = "e.ts") -> str:
    """CTEs l0..l{levels} of (root, node, ord, carry).

    ``start``: SELECT of root, node, carry. ``edges``: SELECT of node, nbr, ts, amt. ``early``
    filters before ranking and cutting, ``late`` after; both see f (frontier) and e (edges).
    """
    parts = [f"e AS ({edges})", f"l0 AS (SELECT root, node, CAST(1 AS BIGINT) AS ord, carry FROM ({start}) s)"]
    for k in range(1, levels + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM l{j} v WHERE v.root = c.root AND v.node = c.nbr)" for j in range(k))
        parts.append(f"""r{k} AS (SELECT f.root, f.ord, f.carry AS before, e.nbr, e.ts, e.amt, {carry} AS carry, f.node,
            row_number() OVER (PARTITION BY f.root, f.node ORDER BY {key} {order}, e.nbr, e.ts, e.amt) AS rk FROM l{k - 1} f JOIN e ON e.node = f.node WHERE {early})""")
        parts.append(f"""c{k} AS (SELECT root, nbr, ord * 100000 + rk AS ord, carry, row_number() OVER (PARTITION BY root, nbr ORDER BY ord, rk) AS rn FROM r{k} f WHERE rk <= :limit AND {late})""")
        # the first claim among those that pass; nodes of earlier levels are taken
        parts.append(f"l{k} AS (SELECT root, nbr AS node, ord, carry FROM c{k} c WHERE rn = 1 {seen})")
    return ", ".join(parts)


_IN = "SELECT dst AS node, src AS nbr, ts, amt FROM {transfer}"
_WINDOW = "ts BETWEEN :lo AND :hi"
_ALL = {"lo": 0, "hi": 4_000_000_000_000}


def _paths(hops: int, first: str, step: str) -> str:
    parts = [f"p1 AS ({first})"]
    parts += [f"p{k} AS ({step.format(prev=f'p{k - 1}')})" for k in range(2, hops + 1)]
    return ", ".join(parts)


def _levels(n: int, first: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT root, node, carry, CAST({k} AS BIGINT) AS d FROM l{k}" for k in range(first, n + 1))


_CYCLE = _paths(
    6,
    "SELECT dst AS node, concat('-', src, '-', dst, '-') AS path, ts AS last_ts, ts AS first_ts, dst = :account AS closed, CAST(2 AS BIGINT) AS n, '' AS cycle FROM {{transfer}} WHERE src = :account AND dst <> :account AND amt >= :min",
    "SELECT t.dst AS node, concat(p.path, t.dst, '-') AS path, t.ts AS last_ts, p.first_ts, t.dst = :account AS closed, p.n + 1 AS n, p.path AS cycle FROM {prev} p JOIN {{transfer}} t ON t.src = p.node"
    " WHERE NOT p.closed AND t.ts > p.last_ts AND t.amt >= :min AND t.ts - p.first_ts <= :window AND (t.dst = :account OR p.path NOT LIKE concat('%-', t.dst, '-%'))",
).replace("{{", "{").replace("}}", "}")

_STEP5 = """
    SELECT root, node, path, ts FROM (SELECT x.*, row_number() OVER (PARTITION BY parent_path ORDER BY ts DESC, node) AS rk FROM (
      SELECT p.root, t.dst AS node, p.path AS parent_path, concat(p.path, t.dst, '-') AS path, min(t.ts) AS ts FROM {prev} p JOIN {{transfer}} t ON t.src = p.node
      WHERE t.ts BETWEEN :lo AND :hi AND t.ts > p.ts AND p.path NOT LIKE concat('%-', t.dst, '-%') GROUP BY p.root, t.dst, p.path) x) y WHERE rk <= :limit"""
_TRACE5 = _paths(4, "SELECT dst AS root, dst AS node, concat('-', dst, '-') AS path, CAST(-1 AS BIGINT) AS ts FROM {{own}} WHERE src = :person", _STEP5).replace("{{", "{").replace("}}", "}")


def _cut(name: str, sql: str) -> str:
    return f"{name} AS (SELECT * FROM ({sql}) x ORDER BY ts, other, amt LIMIT :limit)"


QUERIES = {
    # accounts upstream within three hops that a blocked medium signed in to, one row for each sign-in
    "cr1": (f"""
        WITH {claims("SELECT CAST(:account AS BIGINT) AS root, CAST(:account AS BIGINT) AS node, CAST(9223372036854775807 AS BIGINT) AS carry", _IN, 3, "e.ts", "ASC", early="e.ts BETWEEN :lo AND :hi AND e.ts < f.carry")}
        SELECT a.node AS account, a.d, s.src AS medium, 'Medium' AS kind FROM ({_levels(3, 1)}) a JOIN {{sign_in}} s ON s.dst = a.node JOIN {{medium}} m ON m.id = s.src
        WHERE m.blocked ORDER BY a.d, account, medium""", {"account": 76, "limit": 20, **_ALL}),
    # loans paid into the accounts upstream of what a person owns; the cut comes before the window here
    "cr2": (f"""
        WITH {claims("SELECT dst AS root, dst AS node, CAST(9223372036854775807 AS BIGINT) AS carry FROM {own} WHERE src = :person", _IN, 3, "e.ts", "ASC", late="f.ts BETWEEN :lo AND :hi AND f.ts < f.before")},
        got AS (SELECT DISTINCT a.root, a.node, d.src AS loan FROM ({_levels(3, 1)}) a JOIN {{deposit}} d ON d.dst = a.node WHERE d.ts BETWEEN :lo AND :hi)
        SELECT g.node AS account, CAST(sum(l.amount) AS DOUBLE) AS amount, CAST(sum(l.balance) AS DOUBLE) AS balance FROM got g JOIN {{loan}} l ON l.id = g.loan GROUP BY g.node ORDER BY amount DESC, account""",
        {"person": 9016, "limit": 20, **_ALL}),
    "cr3": ("SELECT coalesce(max(d), -1) AS hops FROM {near} WHERE id = :target", {"account": 76, "target": 30, "lo": 1705000000000, "hi": 1705200000000}),
    # cycles of rising time in a window; parallel edges repeat them
    "cr4": (f"""
        WITH {_CYCLE} SELECT cycle, n - 1 AS accounts FROM ({' UNION ALL '.join(f'SELECT cycle, closed, n FROM p{k}' for k in range(2, 7))}) x WHERE closed ORDER BY accounts, cycle LIMIT 1000""",
        {"account": 76, "min": 20.0, "window": 604_800_000}),
    # traces of rising time from owned accounts, parallel edges as one
    "cr5": (f"""
        WITH {_TRACE5} SELECT DISTINCT path, hops FROM (SELECT path, CAST(1 AS BIGINT) AS hops FROM p2 UNION ALL SELECT path, CAST(2 AS BIGINT) FROM p3 UNION ALL SELECT path, CAST(3 AS BIGINT) FROM p4) x
        ORDER BY hops DESC, path""", {"person": 9016, "limit": 4, "lo": 1705000000000, "hi": 1705600000000}),
    # transfers into a card that precede its last large withdrawal
    "cr6": ("""
        WITH w AS (SELECT sum(amt) AS total, max(ts) AS last_ts FROM {withdraw} WHERE src = :account AND ts BETWEEN :lo AND :hi AND amt > :t2)
        SELECT t.src AS account, round(sum(t.amt), 6) AS sum_in, round(max(w.total), 6) AS sum_out FROM {transfer} t CROSS JOIN w
        WHERE t.dst = :account AND t.ts BETWEEN :lo AND :hi AND t.amt > :t1 AND t.ts <= w.last_ts GROUP BY t.src ORDER BY sum_in DESC, account""", {"account": 76, "t1": 0.0, "t2": 0.0, **_ALL}),
    "cr7": (f"""
        WITH {_cut("a", "SELECT src AS other, ts, amt FROM {transfer} WHERE dst = :account AND amt > :t AND ts BETWEEN :lo AND :hi")}, {_cut("b", "SELECT dst AS other, ts, amt FROM {transfer} WHERE src = :account AND amt > :t AND ts BETWEEN :lo AND :hi")},
        x AS (SELECT count(DISTINCT other) AS n, sum(amt) AS s FROM a), y AS (SELECT count(DISTINCT other) AS n, sum(amt) AS s FROM b)
        SELECT x.n AS sources, y.n AS targets, CASE WHEN coalesce(y.s, 0) > 0 THEN round(coalesce(x.s, 0) / y.s, 3) ELSE -1.0 END AS ratio FROM x CROSS JOIN y""", {"account": 76, "t": 1.0, "limit": 100, **_ALL}),
    # where a loan's money goes, up to two transfers or withdrawals after its deposits
    "cr8": (f"""
        WITH up AS (SELECT dst, sum(amt) AS total FROM {{transfer}} WHERE {_WINDOW} GROUP BY dst),
        dep AS (SELECT concat(dst, '-', row_number() OVER (PARTITION BY dst ORDER BY ts, amt)) AS root, dst AS node, amt AS carry FROM {{deposit}} WHERE src = :loan AND {_WINDOW}),
        {claims("SELECT root, node, carry FROM dep", "SELECT t.src AS node, t.dst AS nbr, t.ts, t.amt, coalesce(up.total, 0) AS total FROM (SELECT * FROM {transfer} UNION ALL SELECT * FROM {withdraw}) t LEFT JOIN up ON up.dst = t.src WHERE t.ts BETWEEN :lo AND :hi", 2, "e.amt", "DESC", carry="CASE WHEN e.amt > :t * e.total THEN e.amt END", late="f.carry IS NOT NULL")},
        seen AS ({_levels(2)})
        SELECT node AS account, round(sum(carry) / max(l.amount), 3) AS ratio, min(d) + 1 AS distance FROM seen CROSS JOIN {{loan}} l WHERE l.id = :loan GROUP BY node ORDER BY distance DESC, ratio DESC, account""",
        {"loan": 5016, "t": 0.01, "limit": 5, **_ALL}),
    "cr9": (f"""
        WITH {_cut("a", "SELECT dst AS other, ts, amt FROM {repay} WHERE src = :account AND ts BETWEEN :lo AND :hi")}, {_cut("b", "SELECT src AS other, ts, amt FROM {deposit} WHERE dst = :account AND ts BETWEEN :lo AND :hi")},
        {_cut("c", "SELECT dst AS other, ts, amt FROM {transfer} WHERE src = :account AND amt >= :t AND ts BETWEEN :lo AND :hi")}, {_cut("d", "SELECT src AS other, ts, amt FROM {transfer} WHERE dst = :account AND amt >= :t AND ts BETWEEN :lo AND :hi")},
        s AS (SELECT coalesce((SELECT sum(amt) FROM a), 0.0) AS a, coalesce((SELECT sum(amt) FROM b), 0.0) AS b, coalesce((SELECT sum(amt) FROM c), 0.0) AS c, coalesce((SELECT sum(amt) FROM d), 0.0) AS d)
        SELECT CASE WHEN b = 0 THEN -1.0 ELSE round(a / b, 3) END AS repay_deposit, CASE WHEN d = 0 THEN -1.0 ELSE round(a / d, 3) END AS repay_in, CASE WHEN d = 0 THEN -1.0 ELSE round(c / d, 3) END AS out_in FROM s""",
        {"account": 76, "t": 1.0, "limit": 100, **_ALL}),
    "cr10": (f"""
        SELECT i.src AS investor, count(*) AS shared FROM {{invest}} i JOIN (SELECT DISTINCT dst FROM {{invest}} WHERE src = :person AND {_WINDOW}) c ON c.dst = i.dst
        WHERE i.src <> :person GROUP BY i.src ORDER BY shared DESC, investor""", {"person": 9016, **_ALL}),
    "cr11": ("SELECT coalesce(CAST(sum(a.amt) AS DOUBLE), 0.0) AS total FROM {apply} a WHERE a.src IN (SELECT id FROM {near})", {"person": 9003}),
    "cr12": (f"""
        WITH mine AS (SELECT dst FROM {{own}} WHERE src = :person ORDER BY dst LIMIT :limit),
        t AS (SELECT t.src, t.dst, t.amt, row_number() OVER (PARTITION BY t.src ORDER BY t.amt DESC, t.dst, t.ts) AS rk FROM {{transfer}} t WHERE t.src IN (SELECT dst FROM mine) AND t.{_WINDOW})
        SELECT t.dst AS account, round(sum(t.amt), 6) AS total FROM t WHERE rk <= :limit AND t.dst IN (SELECT o.dst FROM {{own}} o JOIN {{company}} c ON c.id = o.src) GROUP BY t.dst ORDER BY total DESC, account""",
        {"person": 9016, "limit": 100, **_ALL}),
    # seeds of the financial runs: the busiest node of each kind
    "cr_seed_account": ("SELECT id AS account, count(*) AS degree FROM (SELECT src AS id FROM {transfer} UNION ALL SELECT dst FROM {transfer}) t GROUP BY id ORDER BY degree DESC, id LIMIT 1", {}),
    "cr_seed_card": ("SELECT src AS account, count(*) AS degree FROM {withdraw} GROUP BY src ORDER BY degree DESC, src LIMIT 1", {}),
    "cr_seed_loan": ("SELECT src AS loan, count(*) AS degree FROM {deposit} GROUP BY src ORDER BY degree DESC, src LIMIT 1", {}),
    "cr_seed_investor": ("SELECT src AS person, count(*) AS degree FROM {invest} WHERE src NOT IN (SELECT id FROM {company}) GROUP BY src ORDER BY degree DESC, src LIMIT 1", {}),
    "cr_seed_owner": ("SELECT src AS person, count(*) AS degree FROM {own} WHERE src NOT IN (SELECT id FROM {company}) GROUP BY src ORDER BY degree DESC, src LIMIT 1", {}),
    "cr_seed_guarantor": ("SELECT src AS person, count(*) AS degree FROM {guarantee} GROUP BY src ORDER BY degree DESC, src LIMIT 1", {}),
    "trace_transfers_in": ("SELECT id AS account, d FROM {near} ORDER BY d, account", {"account": 76, "hops": 2, "lo": 1705000000000, "hi": 1705400000000}),
}
