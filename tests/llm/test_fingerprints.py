import hashlib
import random
import re
from collections import Counter

from skein.llm.fingerprints import compare, op5_bloom_lookup_sketch, with_next
from tests.llm.conftest import write


def paragraphs(text):
    """Lines, cut after the first sentence end before a space that follows 300 characters."""
    out = set()
    for line in text.split("\n"):
        start = 0
        for i, c in enumerate(line):
            if c in ".!?" and line[i + 1 : i + 2] == " " and i - start >= 300:
                out.add(line[start : i + 1])
                start = i + 1
        out.add(line[start:])
    return {p for p in out if re.search(r"[^\x20\x09-\x0D]", p)}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """For distinct doc_ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = Counter()
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(t, e), 9), round(alike(t, nxt), 9))] += 1
    return out


def check(spark, path, rows):
    got = op5_bloom_lookup_sketch(spark, path).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == brute(rows)
    return got


def test_sf(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = check(spark, sf, rows)
    text, by = dict(rows), {}
    for r in got:
        assert by.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert sum(r["near_edited"] for r in got) > 10 * sum(r["near_next"] for r in got)


def test_odd_and_empty(spark, odd, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert len({d for d, _ in rows}) == len(rows) - 1  # one repeated row
    got = op5_bloom_lookup_sketch(spark, write(spark, tmp_path / "a", documents=odd)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    assert all(r["near_next"] is not None and r["near_edited"] is not None for r in got)
    one = odd.dropDuplicates(["doc_id"])
    check(spark, write(spark, tmp_path / "b", documents=one), [(r["doc_id"], r["text"]) for r in one.collect()])
    check(spark, write(spark, tmp_path / "c", documents=odd.limit(0)), [])
    check(spark, write(spark, tmp_path / "d", documents=odd.filter("doc_id = 9")), [(r["doc_id"], r["text"]) for r in odd.filter("doc_id = 9").collect()])


def test_differences(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for pid in range(80):
        common = [rng.getrandbits(64) - 2**63 for _ in range(rng.randrange(60))]
        a, b = ([rng.getrandbits(64) - 2**63 for _ in range(rng.randrange(rng.choice((2, 8, 90))))] for _ in range(2))
        rows.append((pid, common + a, b + common))
        want[pid] = (len(a), len(b), len(common) / max(1, len(common + a + b)) if common + a + b else 1.0)
    for pid, n in ((100, 4000), (101, 3000)):  # a long text: against another one, and with a few changes
        a = [rng.getrandbits(64) - 2**63 for _ in range(n)]
        b = a[:-5] if pid == 101 else [rng.getrandbits(64) - 2**63 for _ in range(n)]
        rows.append((pid, a, b))
        want[pid] = (len(set(a) - set(b)), len(set(b) - set(a)), len(set(a) & set(b)) / len(set(a) | set(b)))
    got = compare(spark.createDataFrame(rows, "pid long, a array<long>, b array<long>")).collect()
    assert {r["pid"]: (r["only_a"], r["only_b"], round(r["near"], 12)) for r in got} == {k: (x, y, round(z, 12)) for k, (x, y, z) in want.items()}


def test_next_over_many_ranges(spark):
    """Gaps, equal, null and huge doc_ids over many ranges."""
    rng = random.Random(5)
    ids = [rng.randrange(100) for _ in range(300)] + [rng.randrange(10**12) for _ in range(300)] + [7] * 400 + [None] * 200 + [2**62 + k for k in range(50)] + [-(2**60), -5]
    rows = [(d, f"text {k} {rng.random()}") for k, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in with_next(df, range_bytes=1).collect()]
    assert Counter((d, t) for d, t, _ in got) == Counter(rows)
    after = {t: n for _, t, n in got}
    of, seen, at = dict((t, d) for d, t in rows), [], got[0][1]
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(seen) == len(rows)  # one cycle through all
    order = [-(2**63) if of[t] is None else of[t] for t in seen]
    turn = sum(a < b for a, b in zip(order, order[1:] + order[:1]))
    assert turn == 1  # it goes down all the way and up once


def test_long_text_and_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    long = "".join(f"{rng.random()} words of it{rng.choice(['. ', chr(10), ' '])}" for _ in range(30_000))
    rows = [(1, long), (2, long[:-40] + "end"), (3, "x" * 700_000), (4, None)]
    df = spark.createDataFrame([(d, t, 0, "b", 1.0, "n") for d, t in rows], "doc_id long, text string, o int, bucket string, h double, digests string")
    check(spark, write(spark, tmp_path, documents=df), rows)
