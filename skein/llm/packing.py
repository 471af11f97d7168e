"""Best-fit packing into sequences of several permitted lengths.

A document of n words is n + 1 tokens (words and one end). Tokens beyond the largest length
go on in further pieces, so texts stay whole. Pieces are packed longest first: a piece goes
to the open bin it fits best. If it fits none, a bin is opened, and all permitted lengths
are weighed against each other: each is filled, on trial, with the longest pieces still to
come that fit, downsized to what it then holds, and the length whose cost per token is least
is opened. A bin of c tokens costs ``overhead + c + c * c / square`` (a sequence takes linear
and, for attention, quadratic work), so a long bin has to earn its length. At the end every
bin is downsized to the least length that holds its contents.

Documents are dealt by a hash into groups of about ``group`` rows and each group is packed by
itself, so memory is bounded; what that costs is a few badly filled bins a group (README has
the measured share).

Defined cases: null or empty text is one token; null doc_id is a value like any other;
equal lengths go by doc_id; repeated rows are packed each; a very long text has many pieces;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)


def cost(length: int, overhead: int = 32, square: int = 16384) -> float:
    """Work of one sequence."""
    return overhead + length + length * length / square


class _Rest:
    """The lengths still to come, as a falling histogram."""

    def __init__(self, sizes: list[int]):
        self.count = Counter(sizes)
        self.keys = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            self.keys.pop(bisect_left(self.keys, size))

    def filled(self, room: int) -> int:
        """How much of ``room`` the longest lengths that fit, one after the other, take up."""
        left, k = room, len(self.keys)
        while left:
            k = bisect_right(self.keys, left, 0, k) - 1
            if k < 0:
                break
            size = self.keys[k]
            left -= size * min(self.count[size], left // size)
        return room - left


def pack_lengths(sizes: list[int], lengths=LENGTHS, overhead: int = 32, square: int = 16384) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (in the order given), and the final length of each bin."""
    lengths = sorted(lengths)
    price = {c: cost(c, overhead, square) for c in lengths}
    rest = _Rest(sizes)
    free: list[tuple[int, int]] = []
    used: list[int] = []
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        rest.take(size)
        k = bisect_left(free, (size, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            def per_token(c: int) -> tuple[float, int]:
                holds = size + rest.filled(c - size)
                return price[next(x for x in lengths if x >= holds)] / holds, c

            room = min((c for c in lengths if c >= size), key=per_token)
            b = len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(free, (room - size, b))
    return where, offset, [next(c for c in lengths if c >= u) for u in used]


def pack(docs: DataFrame, lengths=LENGTHS, overhead: int = 32, square: int = 16384, group: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_length, bin_offset for every piece."""
    n = max(1, -(-docs.count() // group))
    largest = max(lengths)
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
        (words + 1).alias("tokens"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("pack_group")
    )

    def run(key, pdf):
        # a document of many full pieces needs no search for these
        ids, piece, start, size = [], [], [], []
        for none, doc, tokens in sorted(zip(pdf["no_id"], pdf["doc_id"], pdf["tokens"])):
            for k, at in enumerate(range(0, int(tokens), largest)):
                ids.append(pd.NA if none else doc)
                piece.append(k)
                start.append(at)
                size.append(min(largest, int(tokens) - at))
        where, offset, final = pack_lengths(size, lengths, overhead, square)
        first = int(key[0]) << 32
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64"), "piece": piece, "start": start, "length": size,
            "bin_id": [first + b for b in where], "bin_length": [final[b] for b in where], "bin_offset": offset,
        })

    return rows.groupBy("pack_group").applyInPandas(
        run, "doc_id long, piece int, start long, length int, bin_id long, bin_length int, bin_offset int"
    )


def op4_variable_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
