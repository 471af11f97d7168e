import math
import re
import zlib
from collections import Counter

import numpy as np

from skein.llm import maxent
from skein.llm.maxent import CLASSES, GROUPS, Model, Trainer, op2_class_maxent
from tests.llm.conftest import write


def brute(rows):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(t for ts, h in zip(toks, held) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    return [
        (d, h, len(ts), sum(t in c for t in ts), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6))
        for (d, _), ts, h in zip(rows, toks, held)
    ]


def check(spark, path, rows):
    got = op2_class_maxent(spark, path).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == Counter(brute(rows))
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    return got


def test_odd_and_empty(spark, odd, tmp_path):
    check(spark, write(spark, tmp_path / "a", documents=odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    check(spark, write(spark, tmp_path / "b", documents=odd.limit(0)), [])


def test_held_out_likelihood(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = check(spark, sf, rows)
    held = [r for r in got if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    gain = (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / tokens
    print("gain in log10 per held-out token", gain)
    assert gain > 0.05


def test_score_against_a_plain_version(spark, tmp_path, monkeypatch):
    """Scores under a given model, token by token: two softmaxes, then smoothed counts inside the class."""
    rng = np.random.default_rng(5)
    shape = maxent.FEATURES * maxent.ROWS
    bias = rng.normal(size=GROUPS), rng.normal(size=(GROUPS, GROUPS))
    model = Model(*(x.astype(np.float32) for x in (*bias, rng.normal(size=(shape, GROUPS)), rng.normal(size=(shape * GROUPS, GROUPS)))))
    monkeypatch.setattr(maxent, "train", lambda docs, common, counts: model)
    words = [f"word{k * 37}" for k in range(400)]  # more than are classes of their own
    rows = [(i, " ".join(rng.choice(words, size=int(rng.integers(0, 60))))) for i in range(60)] + [(60, None), (61, "never seen before")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in maxent.score(spark.read.parquet(write(spark, tmp_path, documents=df) + "/documents.parquet")).collect()}

    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    made = {d: maxent.tokens([(0, (t or "").encode())]) for d, t in rows}
    count, kind_of = Counter(), {}
    for d, (token, kind, _) in made.items():
        kind_of |= dict(zip(token.tolist(), kind.tolist()))
        if not held[d]:
            count.update(token.tolist())
    common = sorted(h for h, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: maxent.OWN])
    cls_of = {h: common.index(h) if h in common else k for h, k in kind_of.items()}
    n_class, v_class = Counter(), Counter()
    for h, n in count.items():
        n_class[cls_of[h]] += n
        v_class[cls_of[h]] += 1

    def log_softmax(x, k):
        return (x[k] - math.log(sum(math.exp(v) for v in x))) / math.log(10)

    for d, (token, kind, doc) in made.items():
        cls = np.array([cls_of[h] for h in token.tolist()])
        f, want = maxent.features(token, cls, doc), 0.0
        for at, (h, c) in enumerate(zip(token.tolist(), cls.tolist())):
            g, inside = divmod(c, GROUPS)
            used = [k * maxent.ROWS + int(f[k, at]) for k in range(maxent.FEATURES)]
            want += log_softmax(bias[0] + sum(model.group[u].astype(float) for u in used), g)
            want += log_softmax(bias[1][g] + sum(model.within[u * GROUPS + g].astype(float) for u in used), inside)
            if h not in common:
                want += math.log10((count[h] + 0.1) / (n_class[c] + 0.1 * (v_class[c] + 1)))
        assert abs(got[d] - want) < 1e-3 * max(1, len(token)), d


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    m = Model.start(np.ones(CLASSES))
    f = rng.integers(0, 4096, (4, 1))
    p = sum(10 ** m.log10(f, np.array([c]))[0] for c in range(CLASSES))
    assert abs(p - 1) < 1e-4
    t = Trainer(m, 0.3)
    f = np.repeat(rng.integers(0, 4096, (4, 8)), 200, axis=1)
    cls = np.repeat(rng.integers(0, CLASSES, 8), 200)
    before = t.m.log10(f, cls).mean()
    for _ in range(10):
        t.step(f, cls)
    assert t.m.log10(f, cls).mean() > before + 1
    p = sum(10 ** t.m.log10(f[:, :1], np.array([c]))[0] for c in range(CLASSES))
    assert abs(p - 1) < 1e-4 and GROUPS * GROUPS == CLASSES
