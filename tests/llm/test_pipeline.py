import random
from collections import Counter

import corpus_pipeline
from skein.llm.pii import mask, spans, train
from tests.llm.conftest import write
from tests.llm.test_jaccard import brute as components
from tests.llm.test_suffix import brute as repeats

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_by_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, rows = docs, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        got = out.collect()
        if name != "packing":
            assert out.columns == NAMES
        before = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality":
            assert all(before[r["doc_id"]] == r["text"] for r in got) and 0.5 * len(rows) < len(got) < len(rows)
        if name == "near_duplicates":
            groups = {d: c for d, _, c, *_ in components([(r["doc_id"], r["text"]) for r in rows])}
            assert Counter(groups[r["doc_id"]] for r in got) == Counter(set(groups.values()))
        if name == "repeated_passages":
            want = {r["doc_id"]: b for r, b in zip(rows, repeats([r["text"] for r in rows]))}
            assert len(got) == len(rows) and all(abs(len(r["text"].encode()) - (want[r["doc_id"]][0] - want[r["doc_id"]][1])) <= 6 for r in got)
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "personal_data":
            w = train()
            assert len(got) == len(rows) and not any("@mail" in r["text"] for r in got)
            assert all(r["text"] == mask(before[r["doc_id"]], spans(w, before[r["doc_id"]])) for r in got if "[" in before[r["doc_id"]])
        if name == "packing":
            assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows}
        kept, rows = out, got


def test_odd_and_empty(spark, odd, tmp_path):
    some = odd.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30))
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "a", documents=some)).count() >= 10
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "b", documents=odd.limit(0))).count() == 0


CLASHES = ["row", "row_no", "q_words", "q_kept", "kept", "spans", "sa_batch", "nid", "n", "can", "token", "a b", "_left"]


def test_clashing_columns_and_long_text(spark, tmp_path):
    """Further columns go through all stages as they are, a very long text whole."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    texts = [". ".join(" ".join(word() for _ in range(8)) for _ in range(n)) for n in (12, 30, 40_000)] + [None, ""]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *CLASHES) for i, t in enumerate(texts)], schema)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
        got = {r["doc_id"]: r for r in kept.collect()}
        assert [got[i]["text"] for i in range(3)] == texts[:3]
        assert all(list(r[5:]) == CLASHES for r in got.values())
    assert sum(r["length"] for r in corpus_pipeline.packed(spark, kept, "").collect() if r["doc_id"] == 2) == 40_000 * 8 + 1


def test_resumes_and_keeps_other_results(spark, tmp_path):
    """A second run over the same folder reads what is written; lazy results of others stay readable."""
    from skein.llm.fingerprints import op5_bloom_lookup_sketch
    from skein.llm.maxent import op2_class_maxent

    sf, folder = "/root/testdata/sf0.001", f"{tmp_path}/runs"
    lazy = [op2_class_maxent(spark, sf), op5_bloom_lookup_sketch(spark, sf)]
    first = sorted(map(tuple, corpus_pipeline.run(spark, sf, folder).collect()))
    stages, ran = corpus_pipeline.STAGES, []
    corpus_pipeline.STAGES = [(n, lambda *a, n=n, f=f: ran.append(n) or f(*a)) for n, f in stages]
    try:
        again = sorted(map(tuple, corpus_pipeline.run(spark, sf, folder).collect()))
    finally:
        corpus_pipeline.STAGES = stages
    assert ran == ["packing"] and again == first and len(first) > 100
    assert all(x.count() == 200 for x in lazy)
