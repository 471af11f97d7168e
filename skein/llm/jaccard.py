"""N-gram Jaccard self-join with adaptive multi-match prefixes.

1. Who can link at all. Two sets of Jaccard 0.8 share 0.8 of each, so a document links only
   if 0.8 of its shingles occur in another document. All shingles of all documents are
   exchanged once, as packed arrays of truncated hashes by hash range; a range answers which
   of them it saw twice. A shingle that several documents of a chunk hold is sent once a
   chunk, so frequent ones cost a few bytes a chunk. (Two shingles with equal truncated
   hashes let a document through in vain, and lose nothing.)
2. Equal sets become one node; only nodes are read again. Their shingles are counted exactly
   and ordered rarest first, then by hash. Sets of Jaccard 0.8 share at least l tokens of
   their first n - ceil(0.8 n) + l. Each node picks its own l: the one for which the postings
   that its longer prefix opens, and the candidates that can share l of them, cost least.
3. Nodes are dealt into blocks of at most ``BLOCK`` by a min-hash (salted where one value is
   frequent). A pair of blocks that hold a prefix token in common counts, in one task, the
   prefix tokens that its pairs of nodes share. A pair of nodes that share as many as the
   smaller of its two l is verified over whole sets, which travel for these nodes only.
4. No pair of nodes is ever a row: a pair of blocks returns for each node how many links it
   has there and one member of its component there. These rows grow with the nodes; all
   links are found and counted, those inside a component as well. (What is compared inside
   a group of m different near copies is m * m / 2 pairs in blocks, as they are all links.)

Nothing is capped; counts, prefixes and sets cover every document.

Defined cases: null or blank text has no shingles, no links and is a component of its own
(its doc_id); null doc_ids never name a component that has another; repeated rows are equal
texts; an empty table gives no rows; other columns are ignored, whatever their names; a very
long text is one chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, table, task_count
from skein.llm.shingles import chunks, shingle_sets
from skein.llm.suffix import distinct, mix, spread
from skein.operators.components import components

LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
BLOCK = 1024
#: Nodes up to this many are found in the texts by a broadcast bit set (16 bits a node, 64 MB at most), beyond it by a join.
FEW = 1 << 25
MIX = 0x9E3779B97F4A7C15
_MANY = 0xFFFF
_PAIRS = 1 << 22


def set_hashes(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each set, in two halves."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens, dtype=np.uint64)])
    more = tokens * np.uint64(MIX)
    more = np.concatenate([[np.uint64(0)], np.cumsum((more ^ (more >> np.uint64(31))) * tokens, dtype=np.uint64)])
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64), (more[at[1:]] - more[at[:-1]]).view(np.int64)


# -- who can link --------------------------------------------------------------------------

_SENT = "target long, chunk long, data binary"
_SENT_ARROW = pa.schema([("target", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
_KEYS = np.dtype([("doc_id", "<i8"), ("null", "?"), ("n", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("k", "<i8")])


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], schema=_SENT_ARROW)


def _chunk(ids: pa.Array, rows: list, chunk: int, bits: int) -> list[tuple[int, int, bytes]]:
    """One packed row for each range of hashes, and one with the sets' sizes and hashes."""
    tokens, at = shingle_sets(rows)
    order, first, count = distinct(tokens)
    doc = np.repeat(np.arange(len(rows)), np.diff(at))[order]
    held = np.repeat(count > 1, count)
    keys = np.zeros(len(rows), _KEYS)
    keys["doc_id"], keys["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    keys["n"], keys["k"] = np.diff(at), np.bincount(doc[held], minlength=len(rows))
    keys["h1"], keys["h2"] = set_hashes(tokens, at)
    h = tokens[order][first]
    who = np.where(count > 1, _MANY, doc[first]).astype(np.uint16)
    to = (h >> np.uint64(64 - bits)).astype(np.int64)
    rest = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else [0]
    out = [(int(to[a]), chunk, rest[a:b].tobytes() + who[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    return [*out, (-1 - chunk, chunk, keys.tobytes())]


def _settle(rows: pa.Table) -> pa.Table:
    """Which hashes of one range occur twice: to each chunk the documents that hold one, once a hash."""
    if rows.column("target")[0].as_py() < 0:
        return rows
    data = [x.as_py() for x in rows.column("data")]
    sizes = np.array([len(d) // 6 for d in data])
    rest = np.concatenate([np.frombuffer(d, np.uint32, n) for d, n in zip(data, sizes)])
    who = np.concatenate([np.frombuffer(d, np.uint16, n, 4 * n) for d, n in zip(data, sizes)])
    order, _, count = distinct(rest)
    twice = np.zeros(len(rest), bool)
    twice[order] = np.repeat(count > 1, count)
    twice &= who != _MANY
    cuts = np.cumsum([0, *sizes])
    replies = [(0, c, who[a:b][twice[a:b]].tobytes()) for c, a, b in zip(rows.column("chunk").to_pylist(), cuts, cuts[1:])]
    return _sent([r for r in replies if r[2]])


def _finish(rows: pa.Table) -> pa.Table:
    """The documents of one chunk, with whether 0.8 of the set occurs elsewhere."""
    keys, heard = None, []
    for target, data in zip(rows.column("target").to_pylist(), rows.column("data")):
        if target < 0:
            keys = np.frombuffer(data.as_py(), _KEYS)
        else:
            heard.append(np.frombuffer(data.as_py(), np.uint16))
    k = keys["k"] + (np.bincount(np.concatenate(heard), minlength=len(keys)) if heard else 0)
    return pa.Table.from_arrays(
        [pa.array(keys["doc_id"], mask=keys["null"]), *(pa.array(np.ascontiguousarray(keys[c])) for c in ("n", "h1", "h2")), pa.array((keys["n"] > 0) & (5 * k >= 4 * keys["n"]))],
        names=["doc_id", "n", "h1", "h2", "can"],
    )


def linkable(docs: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, set size n, set hash h1 h2 of every row, and ``can``: whether it can link or has a copy.

    A range of hashes gets about ``range_bytes`` of text's worth of shingles. ``docs`` should be
    read from a table, whose rows come in the same order when a lost task is run again.
    """
    bits = (task_count(docs, F.octet_length("text"), range_bytes, 256) - 1).bit_length()

    def run(batches):
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for rows in chunks(batch.column(1)):
                yield from _sent(_chunk(batch.column(0).slice(rows[0][0], len(rows)), rows, chunk, bits)).to_batches()
                chunk += 1

    sent = docs.select("doc_id", "text").mapInArrow(run, _SENT)
    heard = sent.groupBy("target").applyInArrow(_settle, _SENT)
    return heard.groupBy("chunk").applyInArrow(_finish, "doc_id long, n long, h1 long, h2 long, can boolean")


# -- whole sets of nodes ---------------------------------------------------------------------


def _slot(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _id_filter(ids: DataFrame, count: int) -> np.ndarray:
    """Bit set of doc_ids, 16 to 32 bits an id; a false hit costs work, not results."""
    size = 1 << max(16, (16 * count).bit_length())

    def mark(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_slot(batch.column(0).fill_null(-1).to_numpy(), size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["data"])

    out = np.zeros(size // 8, np.uint8)
    for r in ids.coalesce(8).mapInArrow(mark, "data binary").toLocalIterator():
        out |= np.frombuffer(bytes(r["data"]), np.uint8)
    return out


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nid, n and whole set of each node (nid, doc_id, n, h1, h2), from one row of ``docs`` with its doc_id."""
    count = nodes.count()
    source, shared = docs.select("doc_id", "text"), None
    if count > FEW:
        ids = nodes.select(F.coalesce("doc_id", F.lit(-1)).alias("w")).distinct()
        source = source.join(ids, F.coalesce("doc_id", F.lit(-1)) == F.col("w"), "left_semi")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(_id_filter(nodes.select("doc_id"), count))

    def run(batches):
        for batch in batches:
            if shared is not None:
                bits = shared.value
                slot = _slot(batch.column(0).fill_null(-1).to_numpy(), 8 * len(bits))
                batch = batch.take(pa.array(np.flatnonzero(bits[slot >> 3] & (128 >> (slot & 7)))))
            for rows in chunks(batch.column(1)):
                tokens, at = shingle_sets(rows)
                h1, h2 = set_hashes(tokens, at)
                ids = batch.column(0).slice(rows[0][0], len(rows))
                # equal rows of a chunk once
                _, first = np.unique(np.stack([ids.fill_null(-1).to_numpy(), h1, h2]), axis=1, return_index=True)
                first = np.sort(first)
                size = np.diff(at)[first]
                cuts = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(first)), pa.array(size, pa.int64()), pa.array(h1[first]), pa.array(h2[first]),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens[spread(at[:-1][first], size)].view(np.int64))),
                ], names=["doc_id", "n", "h1", "h2", "tokens"])

    made = source.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, tokens array<long>")
    keys = [F.coalesce(F.col(f"{t}.doc_id"), F.lit(-1)) for t in ("s", "w")]
    on = (keys[0] == keys[1]) & (F.col("s.h1") == F.col("w.h1")) & (F.col("s.h2") == F.col("w.h2")) & (F.col("s.n") == F.col("w.n"))
    return made.alias("s").join(nodes.alias("w"), on).select("w.nid", "w.n", "tokens").dropDuplicates(["nid"])


# -- prefixes ------------------------------------------------------------------------------


def choose(n: int, df: np.ndarray) -> tuple[int, int]:
    """l and how many shared tokens (given by rising df, after n - len(df) that no other node has) the prefix takes."""
    need = -(-4 * n // 5)
    opened = np.concatenate([[0], np.cumsum(df - 1)])
    best = None
    for k in LEVELS:
        if k > need:
            break
        p = max(0, n - need + k - (n - len(df)))
        # k of the postings opened make a candidate, so there are at most opened / k
        cost = (opened[p] + opened[p] / k * (1 + n / 16), k, p)
        best = cost if best is None or cost < best else best
    return best[1], best[2]


def prefixes(sets: DataFrame) -> DataFrame:
    """nid, n, l, min-hash and prefix (only tokens that several nodes hold) of nodes that can still link."""
    tokens = sets.select("nid", "n", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    have = tokens.join(df, "token").groupBy("nid").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x")
    ).filter(5 * F.size("x") >= 4 * F.col("n")).select("nid", "n", "x.df", "x.token")

    def run(batches):
        for batch in batches:
            cols = {k: [] for k in ("ell", "mh", "prefix")}
            for n, df, token in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                token = token.values.to_numpy()
                ell, p = choose(n, df.values.to_numpy())
                cols["ell"].append(ell)
                cols["mh"].append(int(mix(mix(token.view(np.uint64)).min(keepdims=True))[0] >> np.uint64(1)))
                cols["prefix"].append(token[:p])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols["ell"], pa.int32()), pa.array(cols["mh"], pa.int64()), pa.array(cols["prefix"], pa.list_(pa.int64()))],
                names=["nid", "n", "ell", "mh", "prefix"],
            )

    return have.mapInArrow(run, "nid long, n long, ell int, mh long, prefix array<long>")


def blocks(pref: DataFrame) -> DataFrame:
    """Put a block number to each node; a block holds about ``BLOCK`` nodes at most."""
    buckets = 1 << max(0, (2 * pref.count() // BLOCK).bit_length())
    pref = pref.withColumn("bucket", F.col("mh") % buckets)
    sizes = pref.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    salt = F.pmod(F.xxhash64("nid"), F.col("salts"))
    return pref.join(sizes, "bucket").select("nid", "n", "ell", "prefix", (salt * buckets + F.col("bucket")).alias("block"))


# -- candidates and links of a pair of blocks ------------------------------------------------


def candidates(rows: pa.Table) -> pa.Table:
    """Of one pair of blocks: each node in a candidate pair, with its partners (the later ends)."""
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    nid, block, token = (rows.column(c).to_numpy() for c in ("nid", "block", "token"))
    ids, first, local = np.unique(nid, return_index=True, return_inverse=True)
    n, ell = rows.column("n").to_numpy()[first], rows.column("ell").to_numpy()[first]
    order = np.argsort(token, kind="stable")
    sides = []
    for b in (lo, hi):
        mine = order[block[order] == b]
        nodes = np.unique(local[mine])
        sides.append((token[mine], np.searchsorted(nodes, local[mine]), nodes))
    (ta, a, na), (tb, b, nb) = sides
    shared = np.zeros(len(na) * len(nb), np.int32)
    start = np.searchsorted(tb, ta)
    count = np.searchsorted(tb, ta, side="right") - start
    upto, at = np.cumsum(count), 0
    while at < len(ta):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        flat = np.repeat(a[at:end], count[at:end]) * len(nb) + b[spread(start[at:end], count[at:end])]
        shared += np.bincount(flat, minlength=len(shared)).astype(np.int32)
        at = end
    shared = shared.reshape(len(na), len(nb))
    x, y = n[na][:, None], n[nb][None, :]
    hit = (shared >= np.minimum(ell[na][:, None], ell[nb][None, :])) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
    if lo == hi:
        hit = np.triu(hit, 1)
    partners = {int(ids[k]): b"" for k in nb[hit.any(axis=0)]}
    partners |= {int(ids[na[i]]): ids[nb[hit[i]]].tobytes() for i in np.flatnonzero(hit.any(axis=1))}
    m = len(partners)
    return pa.table({
        "lo": pa.array([lo] * m, pa.int64()), "hi": pa.array([hi] * m, pa.int64()),
        "nid": pa.array(list(partners), pa.int64()), "partners": pa.array(list(partners.values()), pa.binary()),
    })


def links(rows: pa.Table) -> pa.Table:
    """Verify the candidates of one pair of blocks over whole sets: links of each node, and its component there."""
    order = np.argsort(rows.column("nid").to_numpy())
    rows = rows.take(pa.array(order)).combine_chunks()
    ids, n = rows.column("nid").to_numpy(), rows.column("n").to_numpy()
    flat = rows.column("tokens").combine_chunks().flatten().to_numpy()
    _, token = np.unique(flat, return_inverse=True)
    at = np.cumsum(n) - n
    mark = np.zeros(int(token.max()) + 1, bool)
    count, ends = np.zeros(len(ids), np.int64), []
    for i, raw in enumerate(rows.column("partners")):
        near = np.searchsorted(ids, np.frombuffer(raw.as_py(), np.int64))
        if not len(near):
            continue
        own = token[at[i] : at[i] + n[i]]
        mark[own] = True
        step = max(1, _PAIRS // int(n[near].max()))
        for s in range(0, len(near), step):
            some = near[s : s + step]
            size = n[some]
            both = np.add.reduceat(mark[token[spread(at[some], size)]].astype(np.int64), np.cumsum(size) - size)
            some = some[100 * both >= 80 * (n[i] + size - both)]
            count[i] += len(some)
            count[some] += 1
            ends.append(np.stack([np.full(len(some), i), some]))
        mark[own] = False
    root = np.arange(len(ids))
    a, b = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(count)
    return pa.table({"nid": ids[some], "links": count[some], "root": ids[root[some]]})


def node_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """nid, links, root for every node and pair of blocks in which it has links."""
    posts = placed.select("nid", "n", "ell", "block", F.explode("prefix").alias("token"))
    held = posts.groupBy("token", "block").agg(F.count("*").alias("c")).withColumnRenamed("block", "other")
    met = posts.join(held, "token").filter("block <> other or c > 1").select(
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "nid", "n", "ell", "block", "token"
    )
    found = met.groupBy("lo", "hi").applyInArrow(candidates, "lo long, hi long, nid long, partners binary")
    whole = found.join(sets, "nid").select("lo", "hi", "nid", "partners", "n", "tokens")
    return whole.groupBy("lo", "hi").applyInArrow(links, "nid long, links long, root long")


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies and n_links of every row, and the 128-bit hash of its set.

    n_copies: rows with the same set, itself included; n_links: other sets it links with.
    """
    spark = docs.sparkSession
    work = table(linkable(docs), "jaccard-documents")
    nodes = table(
        work.filter("can").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
        .select(F.monotonically_increasing_id().alias("nid"), "doc_id", "n", "h1", "h2", "n_copies"),
        "jaccard-nodes",
    )
    sets = table(node_sets(docs, nodes), "jaccard-sets")
    pref = table(prefixes(sets), "jaccard-prefixes")
    found = table(node_links(blocks(pref), sets), "jaccard-links")
    discard(spark, sets, pref)
    roots = components(found.filter("nid <> root").select(F.col("nid").alias("a"), F.col("root").alias("b")))
    named = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    low = named.groupBy("root").agg(F.min("doc_id").alias("low"))
    count = found.groupBy("nid").agg(F.sum("links").alias("n_links"))
    named = table(named.join(low, "root").join(count, "nid", "left").select(
        "n", "h1", "h2", "low", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    ), "jaccard-components")
    discard(spark, found, nodes)
    alone = work.filter("not can").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), "h1", "h2",
    )
    return work.filter("can").join(named, ["n", "h1", "h2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), "n_copies", "n_links", "h1", "h2"
    ).unionByName(alone)


def op7_adaptive_prefix_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h1", "h2")
