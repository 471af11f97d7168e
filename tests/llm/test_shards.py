import random
import zlib
from collections import Counter, defaultdict

from skein.llm.shards import minimax, op3_minimax_shards, search, shard
from tests.llm.conftest import write


def best(sizes, shards):
    """Smallest largest sum by dynamic programming."""
    n = len(sizes)
    at = [0]
    for s in sizes:
        at.append(at[-1] + s)
    cost = [at[i] for i in range(n + 1)]
    for _ in range(shards - 1):
        cost = [0] + [min(max(cost[j], at[i] - at[j]) for j in range(i)) for i in range(1, n + 1)]
    return cost[n]


def test_minimax_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 25))]
        k = rng.randint(1, 7)
        cuts = minimax(sizes, k)
        assert cuts[-1] == len(sizes) and len(cuts) <= k
        assert max(sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)) == best(sizes, k)
    assert minimax([], 3) == []


def test_search_is_exact_over_groups(spark):
    """Far more groups than ranges to begin with; the result is that of all groups in order."""
    rng = random.Random(8)
    for n, k, bits, clustered in ((3000, 7, 2, False), (3000, 40, 4, True), (500, 40, 1, False), (30, 40, 2, False), (1, 3, 16, False)):
        keys = {rng.getrandbits(64) - 2**63 if not clustered or rng.random() < 0.2 else rng.getrandbits(20) for _ in range(n)}
        groups = sorted((x, rng.randint(16, 5000) if rng.random() < 0.9 else 20000) for x in keys)
        sizes = [s for _, s in groups]
        df = spark.createDataFrame(groups, "key long, size long")
        cuts = search(df, k, sum(sizes), max(sizes), bits=bits, step=3)
        assert cuts == [groups[c][0] for c in minimax(sizes, k)[:-1]]
        ends = [next(i for i, g in enumerate(groups) if g[0] == c) for c in cuts] + [len(groups)]
        if n < 1000:
            assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends)) == best(sizes, k)


def test_large_groups_stand_alone_and_long_texts(spark):
    texts = ["x" * 300_000, None] + ["copy " * 40] * 500 + [f"text {i} " * (1 + i % 9) for i in range(2000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, shard string, key int")
    rows = shard(df, shards=6).collect()
    where, load = defaultdict(set), Counter()
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(len(v) == 1 for v in where.values()) and len(rows) == len(texts)
    alone = [min(where["x" * 300_000]), min(where["copy " * 40])]
    assert sorted(alone) == [0, 1] and load[alone[0]] == 300_016 and load[alone[1]] == 500 * 216
    rest = [v for k, v in load.items() if k not in alone]
    assert len(rest) == 4 and max(rest) - min(rest) < 400


def test_rows(spark, odd, tmp_path):
    path = write(spark, tmp_path, documents=odd)
    got = op3_minimax_shards(spark, path).collect()
    rows = odd.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {type(r["grown_shard"]) for r in got} == {type(None)}
    assert shard(odd.limit(0)).count() == 0


def test_even_and_atomic(spark, sf):
    got = op3_minimax_shards(spark, sf).collect()
    where = defaultdict(set)
    load = Counter()
    for r in got:
        where[(r["size"], r["text_crc32"])].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(len(v) == 1 for v in where.values())
    assert max(load.values()) <= sum(load.values()) / 40 + 2 * max(r["size"] for r in got)
