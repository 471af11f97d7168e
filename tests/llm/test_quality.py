import re
from collections import Counter

from skein.llm.quality import fit, measure, judge, op6_weak_supervision, posterior
from tests.llm.conftest import write


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def check(spark, df, path):
    got = op6_weak_supervision(spark, path).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r["doc_id"], *brute(r["text"])) for r in df.collect())
    assert not any(r["kept"] and r["base_failed"] for r in got)
    return {r["doc_id"]: r for r in got}


def test_odd(spark, odd, tmp_path):
    check(spark, odd, write(spark, tmp_path, documents=odd))


def test_empty(spark, odd, tmp_path):
    assert check(spark, odd.limit(0), write(spark, tmp_path, documents=odd.limit(0))) == {}


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(r["kept"] for r in good if not r["base_failed"]) >= 0.98 * sum(not r["base_failed"] for r in good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_em_recovers_accuracies():
    import random

    rng = random.Random(1)
    rows = Counter()
    for _ in range(6000):
        y = rng.random() < 0.8
        v = [0] * 6
        for k, acc in enumerate((0.95, 0.9, 0.85, 0.8)):
            right = rng.random() < acc
            v[k] = (1 if y else -1) * (1 if right else -1)
        rows[tuple(v)] += 1
    prior, on_good, on_bad = fit(sorted(rows.items()))
    assert abs(prior - 0.8) < 0.05
    for k, acc in enumerate((0.95, 0.9, 0.85, 0.8)):
        assert abs(on_good[k][2] - acc) < 0.08 and abs(on_bad[k][0] - acc) < 0.08
    assert posterior((1, 1, 1, 1, 0, 0), prior, on_good, on_bad) > 0.99


def test_clashing_columns_are_kept(spark, odd):
    d = judge(measure(odd.withColumnRenamed("lang", "n_words")))
    assert d.filter("n_words is not null").count() == 0 and d.count() == odd.count()
