import random
import re
from collections import Counter, defaultdict

import pytest

from skein.llm.jaccard import op7_adaptive_prefix_join
from skein.operators.components import components
from tests.llm.conftest import write

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    count = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    linked = defaultdict(set)
    for (a, b), n in count.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
            if sets[a] != sets[b]:
                linked[sets[a]].add(sets[b])
                linked[sets[b]].add(sets[a])
    copies = Counter(sets)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return Counter((d, len(s), low[find(i)], copies[s] if s else 1, len(linked[s])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check(spark, path, rows):
    got = Counter(map(tuple, op7_adaptive_prefix_join(spark, path).collect()))
    assert got == brute(rows)


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_planted(spark, tmp_path):
    rng = random.Random(11)
    said = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    base = [said(rng.randint(1, 160)) for _ in range(60)]
    line = said(12)
    texts = base + [line + " " + said(15) for _ in range(40)]
    for b in base[:25]:
        texts += [edited(rng, b, rng.randint(0, 5)) for _ in range(rng.randint(1, 6))]
    chain = said(120)
    for _ in range(60):
        texts.append(chain)
        chain = edited(rng, chain, 1)
    hub = said(150)
    texts += [edited(rng, hub, rng.randint(1, 5)) for _ in range(80)]
    texts += [None, "", "One two", "one  TWO\n", "É é", "é É", "a b c d e", "a b c d E", "a b c d", texts[3].upper()]
    rows = list(enumerate(texts)) + [(None, texts[0]), (7, texts[8]), (7, texts[8]), (None, None)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    check(spark, write(spark, tmp_path, documents=df), rows)


def test_odd_and_empty(spark, odd, tmp_path):
    check(spark, write(spark, tmp_path / "a", documents=odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    check(spark, write(spark, tmp_path / "b", documents=odd.limit(0)), [])


def test_sf(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, sf, rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(500, 500), (501, 500), (500, 501)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)
