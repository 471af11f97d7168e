"""Byte-level BPE by monoid tree reduction; decoding concatenates up the tree.

Two levels of the same idea. A text is cut into halves down to ``SEGMENT`` characters,
each leaf is split by the vocabulary's pattern, and neighbours are joined by splitting a
window around their border again; the window grows until its pieces fall on a piece border
of the right side, after which both sides agree for good, since the pattern looks ahead
but never back. A piece is cut into halves down to ``LEAF`` bytes, each leaf is merged by
rank, and neighbours are joined by encoding a window of border tokens again, which grows
until the tokens on each side of its two edges are each other's own encoding: a sequence
in which every adjacent pair encodes to itself is the encoding of its bytes, so the tokens
outside cannot change.

Defined cases: null text is empty and gives no tokens; repeated rows are all encoded;
an empty table gives no rows; other columns are untouched (`encode_frame` adds ``ids_text``,
``n_tokens``, ``decoded`` only). Bytes of one text live in one task; nothing else does.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

LEAF, SEGMENT, CACHE = 16, 16384, 150_000


def read_ranks(path: str) -> bytes:
    """The rank file as bytes; its size is that of the vocabulary, so it may be broadcast."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        merges = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._merge = merges._encode_single_piece
        self._own: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    # pieces -> tokens

    def _pair(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens are the encoding of their own bytes."""
        found = self._own.get((a, b))
        if found is None:
            if len(self._own) > CACHE:
                self._own.clear()
            found = self._own[(a, b)] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._pair(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j]))
            mid = self._merge(window) if len(window) <= 4 * LEAF else self._halves(window)
            grow_left = i < len(left) and not self._pair(left[-i - 1], mid[0])
            grow_right = j < len(right) and not self._pair(mid[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + mid + right[j:]
            i, j = (min(len(left), 2 * i) if grow_left else i), (min(len(right), 2 * j) if grow_right else j)
            if i == len(left) and j == len(right):
                return self._merge(b"".join(map(self.bytes_of.__getitem__, left + right)))

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self._merge(piece)
        mid = len(piece) // 2
        return self._join(self._halves(piece[:mid]), self._halves(piece[mid:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._halves(piece)

    # text -> pieces

    def pieces(self, text: str) -> list[str]:
        if len(text) <= SEGMENT:
            return self.pattern.findall(text)
        mid = len(text) // 2
        return self._join_pieces(self.pieces(text[:mid]), self.pieces(text[mid:]))

    def _join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        # What of the left side is settled: pieces that end before its last character and
        # begin three characters or more before its end have seen all they look at.
        keep, tail = len(left), 0
        while keep and (tail == 0 or tail + len(left[keep - 1]) < 3):
            keep -= 1
            tail += len(left[keep])
        start = "".join(left[keep:])
        take = 8
        while True:
            window = start + "".join(right[:take])
            borders, at = {}, tail
            for k, p in enumerate(right[:take]):
                borders[at] = k
                at += len(p)
            out, at = [], 0
            for p in self.pattern.findall(window):
                if at >= tail and at in borders:
                    return left[:keep] + out + right[borders[at] :]
                if take < len(right) and (at + len(p) >= len(window) or at + 3 > len(window)):
                    break
                out.append(p)
                at += len(p)
            if take >= len(right):
                return left[:keep] + out
            take *= 4

    # text -> digests

    def entry(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.encode_piece(piece.encode())
        made = ",".join(map(str, ids)), len(ids), self.decode(ids)
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = made
        return made

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 64:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in self.entry(p)[0].split(",")]

    def entries(self, text: str) -> list[tuple[str, int, bytes]]:
        get, entry = self.cache.get, self.entry
        return [get(p) or entry(p) for p in self.pieces(text)]


_HELD: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    key = hash((len(shared.value), hash(shared.value), pattern))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Codec(shared.value, pattern)
    return _HELD[key]


def encode_frame(docs: DataFrame, ranks: str, pattern: str, digest: bool = False) -> DataFrame:
    """doc_id with the ids of each text and the text decoded from them, or their digests."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    columns = ("ids_sha256 string, decoded_sha256 string") if digest else ("ids array<int>, decoded binary")

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            a, n, b = [], [], []
            for text in batch.column(1):
                found = codec.entries(text.as_py() or "")
                ids, raw = ",".join([x[0] for x in found]), b"".join([x[2] for x in found])
                n.append(sum([x[1] for x in found]))
                a.append(hashlib.sha256(ids.encode()).hexdigest() if digest else [int(i) for i in ids.split(",") if i])
                b.append(hashlib.sha256(raw).hexdigest() if digest else raw)
            kind = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, kind[0]), pa.array(b, kind[1])],
                names=["doc_id", "n_tokens", *[c.split()[0] for c in columns.split(", ")]],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {columns}")


def op9_bpe_tree(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_frame(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True,
    )
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
