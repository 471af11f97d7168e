"""Sharding by minimax contiguous partition (DataFrame functions only).

Atomic groups are equal texts (by a 64-bit hash). Their order: groups larger than an even
share of what is left come first, by size; the others go by their hash. A large group is a
shard of its own, as it would else set the capacity for everybody. For the others a binary
search finds the smallest capacity for which a greedy left-to-right fill needs no more than
the shards that remain; the cuts are the greedy ones at that capacity.

The search is exact over groups, and what the driver sees is bounded: groups are summed into
ranges of the hash; ranges in which a cut of any capacity still possible can fall are split
again, 256 ways, until they hold a single group. A cut moves by at most some ranges a shard,
so a round reads at most about ``shards ** 2`` ranges, whatever the number of groups.

Slots are numbered in salted parts of a shard: counts of the parts (``shards * parts`` rows,
a fixed bound) give offsets, and each part is numbered by itself, so no task sees a whole
shard and a group of copies is spread over all parts.

Defined cases: null text has no bytes, crc32 0, and is a group of its own; null doc_id is
a value like any other; repeated rows each get a slot; a very long text is a group like any
other; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import table

SIGN = "(-9223372036854775807L - 1L)"


def fill(ends: list[int], capacity: int, most: int) -> list[int] | None:
    """Greedy cuts (exclusive cell ends) of at most ``most`` shards; None if they don't do."""
    cuts, at, done = [], 0, 0
    while done < len(ends):
        if len(cuts) == most:
            return None
        upto = bisect_right(ends, at + capacity, done)
        if upto == done:
            return None
        cuts.append(upto)
        at, done = ends[upto - 1], upto
    return cuts


def minimax(sizes: list[int], shards: int) -> list[int]:
    """Cuts of the smallest feasible capacity over ordered sizes."""
    if not sizes:
        return []
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if fill(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return fill(ends, low, shards)


def windows(sizes: list[int], low: int, high: int, most: int) -> set[int]:
    """Ranges in which the greedy cuts of some capacity in low..high can fall, for any grouping inside ranges."""
    ends = list(accumulate(sizes))
    out: set[int] = set()
    first = last = 0  # the earliest and latest place of the cut before
    for _ in range(most):
        upto = ends[-1] if ends else 0
        if first >= upto:
            break
        k = bisect_right(ends, first + low)
        reach = min(last + high, upto)
        j = bisect_left(ends, reach)
        out.update(range(k, min(j, len(ends) - 1) + 1))
        first, last = ends[k - 1] if k else 0, ends[min(j, len(ends) - 1)]
    return out


def search(groups: DataFrame, shards: int, total: int, largest: int, bits: int = 16, step: int = 8) -> list[int]:
    """Least key (shifted, see ``shard``) of each shard but the first, for ``groups`` (key, size) in order of key."""

    def summed(df, width):
        at = F.expr(f"(shiftrightunsigned(key ^ {SIGN}, {64 - width})) ^ {0 if width < 64 else SIGN}").alias("at")
        return df.groupBy(at).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("key")).select("key", "size", "n")

    pieces = [(r["key"], r["size"], r["n"]) for r in summed(groups, bits).collect()]
    width = bits
    while True:
        pieces.sort()
        sizes = [p[1] for p in pieces]
        low = max(largest, -(-total // shards), 1)
        cuts, high = minimax(sizes, shards), 0
        for a, b in zip([0, *cuts], cuts):
            high = max(high, sum(sizes[a:b]))
        split = [k for k in windows(sizes, low, high, shards) if pieces[k][2] > 1]
        if not split or width >= 64:
            return [pieces[c][0] for c in cuts[:-1]]
        # a range is what shares its leading bits with its least key
        wide = width
        width = min(64, width + step)
        lead = F.expr(f"shiftrightunsigned(key ^ {SIGN}, {64 - wide})")
        chosen = groups.sparkSession.createDataFrame([((pieces[k][0] ^ -(2**63)) % 2**64 >> (64 - wide),) for k in split], "lead long")
        part = groups.join(F.broadcast(chosen), lead == F.col("lead"), "left_semi")
        gone = set(split)
        pieces = [p for k, p in enumerate(pieces) if k not in gone] + [(r["key"], r["size"], r["n"]) for r in summed(part, width).collect()]


def shard(docs: DataFrame, shards: int = 40, parts: int = 512, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``.

    The signed order of a hash is that of its bits with the first one turned, which makes
    ranges of leading bits (``key ^ SIGN``) contiguous.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("key"),
    )
    groups = table(slim.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    big, left = [], shards
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if left > 1 and r["size"] * left > total:
            big.append(r["key"])
            total, left = total - r["size"], left - 1
        else:
            break
    rest = groups.filter(~F.col("key").isin(big)) if big else groups
    largest = rest.agg(F.max("size")).first()[0] or 0
    cuts = search(rest, left, total, largest)
    where = F.lit(len(big))
    if cuts:
        where = where + F.expr("size(filter(array(" + ", ".join(_long(c) for c in cuts) + "), c -> c <= key))")
    for k, key in enumerate(big):
        where = F.when(F.col("key") == key, F.lit(k)).otherwise(where)
    rows = slim.withColumn("shard", where.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "key", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot")
    )


def _long(v: int) -> str:
    return SIGN if v == -(2**63) else f"{v}L"


def op3_minimax_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
