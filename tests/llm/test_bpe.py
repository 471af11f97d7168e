import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from skein.llm import bpe
from skein.llm.bpe import Codec, encode_frame, op9_bpe_tree, read_ranks
from tests.llm.conftest import write

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    raw = read_ranks(PATH)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return Codec(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(both):
    codec, own = both
    rng = random.Random(3)
    alphabets = ["abc ", "ab'srelvmtd ", " \n\t", "éèß漢字𝔘 x", "0123 .,", "aaaaaaab", "the of and ing ", "'’s    a"]
    for k in range(1500):
        chars = rng.choice(alphabets)
        text = "".join(rng.choice(chars) for _ in range(rng.choice((0, 1, 5, 40, 300))))
        assert codec.encode(text) == own.encode_ordinary(text)


def test_long_pieces_and_small_segments(both, monkeypatch):
    codec, own = both
    rng = random.Random(4)
    for n in (100, 1000, 30000):
        for chars in ("a", "ab", "thequickbrown", "é漢", " "):
            text = "".join(rng.choice(chars) for _ in range(n))
            assert codec.encode(text) == own.encode_ordinary(text)
    monkeypatch.setattr(bpe, "SEGMENT", 12)
    for _ in range(400):
        chars = rng.choice([" \n a", "ab's're 'll", "12 .,!  x", "  \n\n  \t"])
        text = "".join(rng.choice(chars) for _ in range(rng.randint(10, 120)))
        assert codec.pieces(text) == codec.pattern.findall(text)


def want(own, rows):
    out = []
    for r in rows:
        ids = own.encode_ordinary(r["text"] or "")
        out.append((
            r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((r["text"] or "").encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def test_rows(spark, odd, tmp_path, both):
    for df, at in ((odd, "a"), (odd.limit(0), "b")):
        path = write(spark, tmp_path / at, documents=df)
        assert sorted(map(tuple, op9_bpe_tree(spark, path).collect()), key=str) == want(both[1], df.collect())


def test_sf(spark, sf, both):
    assert sorted(map(tuple, op9_bpe_tree(spark, sf).collect()), key=str) == want(both[1], spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_general_interface(spark, both):
    df = spark.createDataFrame([(1, "héllo wörld 漢字", 5)], "doc_id long, text string, n_tokens long")
    r = encode_frame(df, PATH, public_tokenizers.PATTERN).first()
    assert r["ids"] == both[1].encode_ordinary("héllo wörld 漢字") and r["decoded"].decode() == "héllo wörld 漢字"
