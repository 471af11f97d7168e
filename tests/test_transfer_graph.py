"""Clustering on the whole transfer graph, small amounts too, against brute force."""

import datetime as dt
import random

import pytest

from skein.plans import registry
from tests.conftest import write


def test_lcc_of_all_transfers(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), rng.randrange(12), float(rng.randrange(120))) for i in range(150)]
    path = write(tmp_path, events=spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double"))
    edges = {(a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[2] != b[2] and a[0] % 3}
    near = {u: {x for e in edges for x in e if u in e and x != u} for u in {r[2] for r in rows}}
    want = {u: sum((x, y) in edges for x in n for y in n if x != y) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0 for u, n in near.items()}
    got = {r["id"]: r["lcc"] for r in registry.queries()["ga_lcc"](spark, path).collect()}
    assert got == pytest.approx(want, abs=1e-6)
