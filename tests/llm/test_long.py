"""Very long texts and further columns with clashing names, through every query of the subpackage."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm.bpe import op9_bpe_tree
from skein.llm.queries import QUERIES
from tests.llm import test_chat, test_fingerprints, test_jaccard, test_maxent, test_quality, test_suffix
from tests.llm.conftest import write

#: Names that the operators use themselves.
CLASHES = (
    "nid", "n", "can", "token", "row", "q_words", "q_kept", "q_list", "kept", "spans", "sa_batch", "sa_hash", "n_bytes", "held_out", "bucket", "o", "h", "digests", "size",
    "key", "shard", "part", "slot", "tokens", "pack_group", "piece", "i", "own", "seg", "before", "round", "target", "data",
)


def texts():
    rng = random.Random(21)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    long = " ".join(w + (".\n" if k % 37 == 0 else "") for k, w in enumerate(words))
    other = words[:]
    for k in range(0, len(other), 1500):
        other[k] = "changed"
    return [(1, long), (2, " ".join(other)), (3, "x" * 400_000), (4, None), (5, "one short text of some words"), (6, long)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    chats = [(1, k, "assistant" if k % 2 else "user", rows[0][1][: 200_000] if k == 3 else f"turn {k}") for k in range(6)]
    conv = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in CLASHES if c not in ("role", "text")})
    return rows, chats, write(spark, tmp_path_factory.mktemp("long"), documents=df, conversations=conv)


def test_all_queries_run(spark, data):
    rows, _, path = data
    for name, f in QUERIES.items():
        if name != "op1_chat_windows":
            got = f(spark, path)
            assert set(CLASHES) & set(got.columns) <= {"shard", "slot", "size", "piece", "spans", "kept", "held_out", "n_bytes"}, name
            assert {r["doc_id"] for r in got.select("doc_id").collect()} == {d for d, _ in rows}, name


def test_long_chat(spark, data):
    from skein.llm.chat import op1_chat_windows

    _, chats, path = data
    got = op1_chat_windows(spark, path).collect()
    want = test_chat.brute([(*r, "x") for r in chats])
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want


def test_long_against_brute_force(spark, data):
    rows, _, path = data
    test_maxent.check(spark, path, rows)
    test_jaccard.check(spark, path, rows)
    test_suffix.check(spark, path, rows)
    test_fingerprints.check(spark, path, rows)
    test_quality.check(spark, spark.createDataFrame(rows, "doc_id long, text string"), path)
    by = {r["doc_id"]: r for r in op9_bpe_tree(spark, path).collect()}
    assert by[1]["ids_sha256"] == by[6]["ids_sha256"] and by[4]["n_tokens"] == 0
