import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import suffix
from skein.llm.suffix import dedup, op8_prefix_doubling, sliding_min
from tests.llm.conftest import write

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, size=200):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        until = 0
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                for j in range(max(i, until), i + size):
                    gone[j] = True
                until = i + size
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, path, rows):
    got = Counter(map(tuple, op8_prefix_doubling(spark, path).collect()))
    assert got == Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows])))


def planted(rng, n):
    word = lambda: "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(3, 9)))
    said = lambda k: " ".join(word() for _ in range(k))
    shared = [said(rng.randint(20, 120)) for _ in range(6)]
    out = [said(rng.randint(0, 150)) for _ in range(n)]
    for _ in range(n):
        i, p = rng.randrange(n), rng.choice(shared)
        a = rng.randint(0, len(p) // 2)
        cut = rng.randint(0, len(out[i]))
        out[i] = out[i][:cut] + p[a : a + rng.randint(100, 700)] + out[i][cut:]
    out += [out[0]] * 3 + [out[1][:50] + "x" + out[1][51:]] * 2
    return out


def test_planted(spark, tmp_path):
    rng = random.Random(8)
    texts = planted(rng, 60) + ["ab" * 400, "z" * 199, "z" * 200, "z" * 900, None, "", "é" * 150, "ab" * 100, "q" * 201]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None), (5, texts[5]), (5, texts[5])]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    check(spark, write(spark, tmp_path, documents=df), rows)


def test_small_slices(spark, tmp_path, monkeypatch):
    # slices of a batch end inside documents
    rng = random.Random(9)
    rows = list(enumerate(planted(rng, 25)))
    monkeypatch.setattr(suffix, "_SLICE", 701)
    from skein.llm.suffix import Batch

    import pyarrow as pa

    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "sa_hash": pa.array([0] * len(rows), pa.int64())})
    b = Batch(table, 200)
    _, _, at, size = b.blocks()
    starts = suffix.spread(at, size)
    want = [i for x, y in zip(b.begins, b.ends) for i in range(x, y - 199)]
    assert sorted(starts.tolist()) == want


def test_odd_and_empty(spark, odd, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(spark, write(spark, tmp_path / "a", documents=odd), rows)
    check(spark, write(spark, tmp_path / "b", documents=odd.limit(0)), [])


def test_all_columns(spark, odd):
    out = dedup(odd.withColumnRenamed("lang", "round")).collect()
    assert len(out) == odd.count() and "round" in out[0].asDict()
    x = next(r for r in out if r["doc_id"] == 8)
    assert x["kept"] == "" and x["spans"] == [0, 5000]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 333).astype(np.uint64)
    assert sliding_min(x, 17).tolist() == [x[i : i + 17].min() for i in range(333 - 16)]


def test_sf(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, sf, rows)
