import math
import random
import re
from collections import Counter, defaultdict

from skein.llm.packing import LENGTHS, cost, op4_variable_best_fit, pack, pack_lengths
from tests.llm.conftest import write


def test_pack_lengths():
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randint(1, rng.choice((30, 600, 4096))) for _ in range(rng.randint(0, 80))]
        where, offset, final = pack_lengths(sizes)
        inside = defaultdict(list)
        for s, b, o in zip(sizes, where, offset):
            inside[b].append((o, s))
        for b, rows in inside.items():
            rows.sort()
            assert rows[0][0] == 0 and all(a[0] + a[1] == c[0] for a, c in zip(rows, rows[1:]))
            total = sum(s for _, s in rows)
            assert final[b] == min(c for c in LENGTHS if c >= total)
    assert pack_lengths([]) == ([], [], [])


def total_cost(sizes, lengths):
    return sum(cost(c) for c in pack_lengths(sizes, lengths)[2])


def optimum(sizes, lengths):
    """Least cost over all ways to divide the sizes into bins."""
    most, best = max(lengths), {0: 0.0}
    full = (1 << len(sizes)) - 1
    price = {}
    for m in range(1, full + 1):
        held = sum(s for i, s in enumerate(sizes) if m >> i & 1)
        if held <= most:
            price[m] = cost(min(c for c in lengths if c >= held))
    for m in range(1, full + 1):
        low = m & -m  # the bin of the first size that is left
        sub, found = m, math.inf
        while sub:
            if sub & low and sub in price:
                found = min(found, price[sub] + best[m ^ sub])
            sub = (sub - 1) & m
        best[m] = found
    return best[full]


def test_close_to_the_optimum():
    rng = random.Random(12)
    ratios = []
    for _ in range(60):
        sizes = [rng.randint(10, rng.choice((400, 1000, 4000))) for _ in range(rng.randint(1, 8))]
        want = optimum(sizes, LENGTHS)
        ratios.append(total_cost(sizes, LENGTHS) / want)
    assert min(ratios) > 0.999999 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.05, (max(ratios), sum(ratios) / len(ratios))


def test_several_lengths_beat_each_alone():
    """Lengths are weighed jointly: short and long documents get bins of different sizes from the start."""
    rng = random.Random(13)
    sizes = [rng.choice((505, 1015, 1010, 2030, 250, 120, 4090)) for _ in range(2000)]
    joint = total_cost(sizes, LENGTHS)
    for most in LENGTHS:
        cut = [s for s in sizes if s <= most]
        if len(cut) == len(sizes):
            assert joint < 0.95 * total_cost(sizes, (most,))
    _, _, final = pack_lengths(sizes)
    opened = Counter(final)
    assert all(opened[c] > 50 for c in LENGTHS), opened
    where, _, _ = pack_lengths([1300] * 9, (1400, 4096))
    assert len(set(where)) == 9  # three in a long bin would cost more than each alone
    where, _, final = pack_lengths([1300] * 9, (2048, 4096))
    assert len(set(where)) == 3 and set(final) == {4096}


def test_well_filled():
    rng = random.Random(6)
    sizes = [rng.randint(20, 900) for _ in range(3000)]
    _, _, final = pack_lengths(sizes)
    assert sum(sizes) / sum(final) > 0.99


def check(docs, got):
    words = Counter()
    for r in docs.collect():
        words[(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1)] += 1
    total = Counter()
    ends = defaultdict(list)
    for r in got:
        ends[r["bin_id"]].append((r["bin_offset"], r["length"], r["bin_length"]))
    for rows in ends.values():
        rows.sort()
        assert rows[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))
        used = rows[-1][0] + rows[-1][1]
        assert {r[2] for r in rows} == {min(c for c in LENGTHS if c >= used)}
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    for (d, n), c in words.items():
        total[d] += n * c
    assert have == total


def test_rows(spark, odd, tmp_path):
    long = spark.createDataFrame([(99, "w " * 10000, "", "", 0)], odd.schema)
    for df, at in ((odd, "a"), (odd.limit(0), "b"), (odd.unionByName(long), "c")):
        check(df, op4_variable_best_fit(spark, write(spark, tmp_path / at, documents=df)).collect())


def test_many_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, pack(docs, group=40).collect())
