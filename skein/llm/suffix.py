"""Suffix-array dedup: distributed prefix doubling over byte positions.

A byte goes if it lies in a ``length``-byte string that also starts anywhere else (matches
stay inside documents; overlaps count; everything is judged on the input). Positions are
ranked by growing prefixes: the rank of the first 2k bytes at p comes from the pair (rank
of k bytes at p, rank of k bytes at p + k). Ranks start as rolling hashes of a quarter of
``length`` and are doubled twice; what is unique at half of it is dropped before the second
time, because no longer prefix of it can repeat. The pairs are brought together by range and
sorted there. A rank is a 64-bit hash of its pair, so equal pairs get the same rank in every
task and a rank needs no second trip through the cluster.

Most positions are settled before the first sort, by blocks. Every window of ``length``
bytes picks the 64-byte gram of least hash inside it; a run of starts with the same pick is
a block. Equal windows pick equal grams, so a block whose gram is nowhere else holds no
repeat; a block whose whole extent occurs again holds nothing but repeats; only blocks that
share a gram and differ (one block of each content) are ranked position by position.

Documents are dealt into batches by a hash of doc_id and text, and a batch sends each distinct pair
once, with a mark whether it has it twice, so a group of copies costs each batch one pair
however many copies there are. What is sent are packed arrays for ranges of ranks; the
answers come back in the same order, a byte each. A batch is some megabytes of text; a
document longer than that makes a longer batch, but is hashed in slices.

Defined cases: null text is empty; null and repeated doc_ids are kept as they are, and equal
rows are documents of their own (so all of a repeated text of ``length`` bytes or more goes);
texts shorter than ``length`` stay; an empty table gives no rows; other columns are carried
by ``dedup`` and may have any name but those it adds (kept, n_bytes, n_removed, n_spans,
spans) or its own (sa_batch, sa_hash).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.llm.common import task_count

GRAM = 64
_SLICE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_BASE, _ROOT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT))


class Slice:
    """Hashes of any stretch of a slice of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b ^ np.uint64(_ROOT)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = -len(x) % w
    a = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    left = np.minimum.accumulate(a, axis=1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


class Batch:
    """The documents of one batch, in an order that every round repeats."""

    def __init__(self, rows: pa.Table, length: int):
        ids = rows.column("doc_id")
        order = np.lexsort((
            rows.column("sa_hash").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
        ))
        self.rows = rows.take(pa.array(order))
        self.length = length
        texts = [(t.as_py() or "").encode() for t in self.rows.column("text")]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.begins = self.ends - np.array([len(t) for t in texts], np.int64)

    def slices(self):
        for at in range(0, len(self.data), _SLICE):
            yield at, min(len(self.data), at + _SLICE)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gram hash, extent hash, first start and number of starts of each block."""
        n, size = len(self.data), self.length
        long = self.ends - self.begins >= size
        step = np.zeros(n + 1, np.int8)
        step[self.begins[long]] += 1
        np.subtract.at(step, self.ends[long] - size + 1, 1)
        valid = np.cumsum(step[:n], dtype=np.int8)
        out = []
        for a, b in self.slices():
            starts = np.flatnonzero(valid[a:b])
            if not len(starts):
                continue
            s = Slice(self.data[a : min(n, b + size - 1)])
            g = s.grams(GRAM)
            key = (mix(g) & ~_LOW) | np.arange(len(g), dtype=np.uint64)
            pick = (sliding_min(key, size - GRAM + 1)[starts] & _LOW).astype(np.int64)
            new = np.flatnonzero((starts[1:] != starts[:-1] + 1) | (pick[1:] != pick[:-1])) + 1
            first = np.concatenate([[0], new])
            count = np.diff(np.concatenate([first, [len(starts)]]))
            at = starts[first]
            pick = pick[first]
            extent = s.stretch(at, at + count - 1 + size)
            out.append((mix(g[pick]), pair(extent, ((pick - at) * (1 << 32) + count).astype(np.uint64)), at + a, count))
        if not out:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*out))

    def ranks(self, at: np.ndarray, k: int) -> np.ndarray:
        """Ranks of the first 2k bytes at ordered positions, from pairs of k-byte ranks."""
        out = np.zeros(len(at), np.uint64)
        for a, b in self.slices():
            lo, hi = np.searchsorted(at, (a, b))
            if lo < hi:
                s = Slice(self.data[a : min(len(self.data), b + 2 * k)])
                p = at[lo:hi] - a
                out[lo:hi] = pair(s.stretch(p, p + k), s.stretch(p + k, p + 2 * k))
        return out


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, index of the first of each distinct key in it, and how often it occurs."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.concatenate([first, [len(order)]]))


_SENT = pa.schema([("sa_batch", pa.int64()), ("round", pa.int32()), ("target", pa.int64()), ("data", pa.binary())])
_SENT_DDL = "sa_batch long, round int, target long, data binary"


def send(batch: int, no: int, keys: list[np.ndarray], twice: np.ndarray, bits: int) -> pa.Table:
    """Sorted distinct keys as one packed row for each range of the first key."""
    to = (keys[0] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else [0]
    rows = [
        b"".join([*(k[a:b].tobytes() for k in keys), twice[a:b].astype(np.uint8).tobytes()]) for a, b in zip(cuts[:-1], cuts[1:])
    ]
    return pa.Table.from_arrays(
        [pa.array([batch] * len(rows), pa.int64()), pa.array([no] * len(rows), pa.int32()), pa.array(to[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())],
        schema=_SENT,
    )


def settle(rows: pa.Table) -> pa.Table:
    """Sort what all batches sent for one range of ranks, and answer each.

    Round 1 (gram, extent): bit 1: the extent occurs again; bit 2: the gram has several
    extents and this batch ranks the positions of this one. Later rounds: 1: not unique.
    """
    out = []
    for no in sorted(set(rows.column("round").to_pylist())):
        # by batch, so that every evaluation (a retried task too) chooses the same ones
        mine = rows.filter(pc.equal(rows.column("round"), no)).sort_by("sa_batch")
        data = [x.as_py() for x in mine.column("data")]
        width = 17 if no == 1 else 9
        sizes = [len(d) // width for d in data]
        part = lambda d, n, i: np.frombuffer(d, np.uint64, n, 8 * n * i)
        keys = [np.concatenate([part(d, n, i) for d, n in zip(data, sizes)]) for i in range(2 if no == 1 else 1)]
        twice = np.concatenate([np.frombuffer(d, np.uint8, n, (width - 1) * n) for d, n in zip(data, sizes)])
        order, first, count = distinct(*keys)
        again = (count > 1) | (np.maximum.reduceat(twice[order], first) > 0)
        code = np.zeros(len(order), np.uint8)
        code[order] = np.repeat(again, count)
        if no == 1:
            gram = keys[0][order][first]
            same = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            kinds = np.diff(np.concatenate([same, [len(gram)]]))
            several = np.repeat(kinds > 1, kinds)
            code[order[first[several]]] |= 2
        cuts = np.cumsum([0, *sizes])
        out.append(pa.Table.from_arrays(
            [mine.column("sa_batch"), mine.column("round"), mine.column("target"), pa.array([code[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            schema=_SENT,
        ))
    return pa.concat_tables(out)


def answers(rows: pa.Table, no: int) -> np.ndarray:
    mine = sorted((t, d) for t, r, d in zip(rows.column("target").to_pylist(), rows.column("round").to_pylist(), rows.column("data").to_pylist()) if r == no)
    return np.frombuffer(b"".join(d for _, d in mine), np.uint8)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of first[i] .. first[i] + count[i] - 1."""
    if not len(count):
        return np.zeros(0, np.int64)
    total = np.cumsum(count)
    return np.arange(total[-1]) + np.repeat(first - (total - count), count)


def doubling(batch: Batch, no: int, heard: pa.Table | None, key: int, bits: int):
    """What this batch sends in round ``no``, or after the last round its repeated starts."""
    gram, extent, at, size = batch.blocks()
    order, first, count = distinct(gram, extent)
    if no == 1:
        return send(key, 1, [gram[order][first], extent[order][first]], count > 1, bits)
    code = answers(heard, 1)
    chosen = order[first[(code & 2) > 0]]
    live = np.sort(spread(at[chosen], size[chosen]))
    half = batch.length // 2
    need = np.union1d(live, live + half)
    rank = batch.ranks(need, half // 2)
    ro, rf, rc = distinct(rank)
    if no == 2:
        return send(key, 2, [rank[ro][rf]], rc > 1, bits)
    shared = np.zeros(len(need), bool)
    shared[ro] = np.repeat(answers(heard, 2) > 0, rc)
    here, there = np.searchsorted(need, live), np.searchsorted(need, live + half)
    still = shared[here] & shared[there]
    full = pair(rank[here[still]], rank[there[still]])
    fo, ff, fc = distinct(full)
    if no == 3:
        return send(key, 3, [full[fo][ff]], fc > 1, bits)
    again = np.zeros(len(full), bool)
    again[fo] = np.repeat(answers(heard, 3) > 0, fc)
    copied = np.zeros(len(order), bool)
    copied[order] = np.repeat((code & 1) > 0, count)
    return np.concatenate([spread(at[copied], size[copied]), live[still][again]])


def dedup(docs: DataFrame, length: int = 200, batch_bytes: int = 8 << 20, digest: bool = False) -> DataFrame:
    """Every row of ``docs`` with n_bytes, n_removed, n_spans and the remaining text.

    ``digest``: doc_id, the counts and kept_sha256 only. Otherwise all columns and ``kept``
    (characters cut in half go) and ``spans`` (start and end bytes of what was removed).
    ``length`` must be a multiple of 4 and over 64.
    """
    if length % 4 or length <= GRAM:
        raise ValueError("length must be a multiple of 4 and over 64")
    clash = {"kept", "n_bytes", "n_removed", "n_spans", "spans", "sa_batch", "sa_hash"} & set(docs.columns)
    if clash and not digest:
        raise ValueError(f"columns that dedup adds itself: {sorted(clash)}")
    n = task_count(docs, F.octet_length("text"), batch_bytes, 256)
    bits = max(4, (n - 1).bit_length())
    source = (docs.select("doc_id", "text") if digest else docs).withColumns({
        "sa_hash": F.xxhash64("text"), "sa_batch": F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long"),
    })
    names = [c for c in source.columns if c not in ("sa_hash", "sa_batch")]
    placed = source.repartition("sa_batch")

    def opening(rows: pa.Table) -> pa.Table:
        return doubling(Batch(rows, length), 1, None, rows.column("sa_batch")[0].as_py(), bits)

    def turn(no):
        def step(rows: pa.Table, heard: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _SENT.empty_table()
            return doubling(Batch(rows, length), no, heard, rows.column("sa_batch")[0].as_py(), bits)

        return step

    def closing(rows: pa.Table, heard: pa.Table) -> pa.Table:
        b = Batch(rows, length)
        starts = doubling(b, 4, heard, 0, bits)
        step = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(step, starts, 1)
        np.subtract.at(step, starts + length, 1)
        gone = np.cumsum(step[:-1]) > 0
        cols = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
        for x, y in zip(b.begins, b.ends):
            g = gone[x:y]
            kept = b.data[x:y][~g].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            cols["n_bytes"].append(int(y - x))
            cols["n_removed"].append(int(g.sum()))
            cols["n_spans"].append(len(edge) // 2)
            cols["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "ignore"))
            cols["spans"].append(edge.tolist())
        made = [pa.array(cols[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")] + [pa.array(cols["kept"], pa.string())]
        if digest:
            return pa.Table.from_arrays([b.rows.column("doc_id"), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return pa.Table.from_arrays(
            [*(b.rows.column(c) for c in names), *made, pa.array(cols["spans"], pa.list_(pa.int64()))],
            names=[*names, "n_bytes", "n_removed", "n_spans", "kept", "spans"],
        )

    by = lambda df: df.groupBy("sa_batch")
    heard = by(placed).applyInArrow(opening, _SENT_DDL).groupBy("target").applyInArrow(settle, _SENT_DDL)
    for no in (2, 3):
        sent = by(placed).cogroup(by(heard)).applyInArrow(turn(no), _SENT_DDL)
        heard = heard.unionByName(sent.groupBy("target").applyInArrow(settle, _SENT_DDL))
    if digest:
        ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        made = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept string, spans array<bigint>")
        ddl = StructType([*docs.schema.fields, *made.fields])
    return by(placed).cogroup(by(heard)).applyInArrow(closing, ddl)


def op8_prefix_doubling(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
