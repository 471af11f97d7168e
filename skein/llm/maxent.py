"""Language-model scoring with a hashed maximum-entropy model, classes factored twice.

A token's class is itself for the ``OWN`` commonest words, else one of 128 classes by a hash
of its last two bytes. P(word | before) = P(group | before) P(class | group, before)
P(word | class): 16 groups of 16 classes, two softmaxes of 16 over hashed features of what
stands before (the previous word, the one before it with a skip, both words, both classes),
and smoothed counts inside a class, with one slot for unknown words.

Counts are exact: batches of documents send each distinct word once, for ranges of hashes,
and hear its count over all training documents. Training is distributed gradient descent
over every training document: in each of ``rounds`` rounds the tasks take their share of the
documents in mini-batches from the same weights, and the rows they changed are averaged by
how often they were used. The weights have a fixed size, whatever the corpus.

Defined cases: null text is empty and has one token, the end; null doc_id counts as the
empty string for the fold (held out); repeated rows count each; an empty table gives no
rows; with no training document every count is 0 and the classes are equally likely; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import table, task_count
from skein.llm.shingles import chunks, layout, words
from skein.llm.suffix import Batch, answers, distinct, mix, send

OWN, GROUPS = 128, 16
CLASSES = GROUPS * GROUPS
FEATURES, ROWS = 4, 4096
END, START = np.uint64(0x123456789ABCDEF1), np.uint64(0x0FEDCBA987654321)
MINI = 16384
_ONES = np.ones(GROUPS, np.float32)


def tokens(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, suffix class and document of every token of a chunk, ends included."""
    data, begins, ends = layout(rows)
    a, b, h = words(data, begins)
    first, last = np.searchsorted(a, begins), np.searchsorted(a, ends)
    size = last - first + 1
    doc = np.repeat(np.arange(len(rows)), size)
    stop = np.cumsum(size) - 1
    inside = np.ones(len(doc), bool)
    inside[stop] = False
    token, kind = np.full(len(doc), END), np.zeros(len(doc), np.int64)
    token[inside] = h
    if len(a):
        tail = data[b - 1].astype(np.uint64) * np.uint64(256) + np.where(b - a > 1, data[np.maximum(b - 2, 0)], 0).astype(np.uint64)
        kind[inside] = (mix(tail + np.uint64(1)) & np.uint64(127)).astype(np.int64)
    return token, kind + OWN, doc


def classes(token: np.ndarray, kind: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Class of each token; ``common``: sorted hashes of the words that are classes themselves."""
    if not len(common):
        return kind
    at = np.minimum(np.searchsorted(common, token), len(common) - 1)
    return np.where(common[at] == token, at, kind)


def features(token: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of the four feature tables for each token."""
    def before(x, k, none):
        out = np.full(len(x), none, x.dtype)
        out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], none)
        return out

    one, two = before(token, 1, START), before(token, 2, START)
    c1, c2 = before(cls, 1, CLASSES).astype(np.uint64), before(cls, 2, CLASSES).astype(np.uint64)
    made = (one, two + np.uint64(7), one * np.uint64(3) + mix(two), c1 * np.uint64(1000) + c2 + np.uint64(11))
    return np.stack([(mix(x) >> np.uint64(52)).astype(np.int64) for x in made])


class Model:
    """Weights: a bias and one row per feature value, for groups and for classes in a group."""

    def __init__(self, group_bias, class_bias, group=None, within=None):
        self.group_bias, self.class_bias = group_bias, class_bias
        self.group = np.zeros((FEATURES * ROWS, GROUPS), np.float32) if group is None else group
        self.within = np.zeros((FEATURES * ROWS * GROUPS, GROUPS), np.float32) if within is None else within

    @staticmethod
    def start(counts: np.ndarray) -> "Model":
        """From the training counts of the classes."""
        c = counts.reshape(GROUPS, GROUPS) + 0.5
        return Model(np.log(c.sum(1) / c.sum()).astype(np.float32), np.log(c / c.sum(1, keepdims=True)).astype(np.float32))

    def logits(self, f: np.ndarray, cls: np.ndarray):
        """Logits of groups, of classes in the right group, and the rows used.

        They are small (biases are logarithms of counts), so no maximum is taken off before
        they are raised.
        """
        g = cls // GROUPS
        rows = f + (np.arange(FEATURES) * ROWS)[:, None]
        deep = rows * GROUPS + g
        a, b = self.group.take(rows[0], 0), self.within.take(deep[0], 0)
        a += self.group_bias
        b += self.class_bias.take(g, 0)
        for k in range(1, FEATURES):
            a += self.group.take(rows[k], 0)
            b += self.within.take(deep[k], 0)
        return a, b, g, rows, deep

    def log10(self, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(class | before) of each token."""
        a, b, g, _, _ = self.logits(f, cls)
        at = np.arange(len(cls))
        right = a[at, g].astype(float) + b[at, cls % GROUPS]
        return (right - np.log(np.exp(a) @ _ONES) - np.log(np.exp(b) @ _ONES)) / np.log(10)


class Trainer:
    """Mini-batch gradient steps with a step size per row."""

    def __init__(self, model: Model, rate: float):
        self.m, self.rate = Model(model.group_bias, model.class_bias, model.group.copy(), model.within.copy()), rate
        self.g2, self.w2 = np.zeros(FEATURES * ROWS, np.float32), np.zeros(FEATURES * ROWS * GROUPS, np.float32)
        self.gn, self.wn = np.zeros(FEATURES * ROWS, np.float32), np.zeros(FEATURES * ROWS * GROUPS, np.float32)

    def _move(self, weights, squares, used, rows, grad, first):
        total = np.add.reduceat(grad, first, axis=0)
        at = rows[first]
        used[at] += np.diff(np.append(first, len(rows)))
        so_far = squares[at] + np.einsum("ij,ij->i", total, total) / GROUPS
        squares[at] = so_far
        total *= (self.rate / np.sqrt(so_far + 1.0))[:, None]
        total += weights.take(at, 0)
        weights[at] = total

    def step(self, f: np.ndarray, cls: np.ndarray) -> None:
        a, b, g, rows, deep = self.m.logits(f, cls)
        at = np.arange(len(cls))
        ga, gb = np.exp(a, out=a), np.exp(b, out=b)
        ga *= (-1 / (ga @ _ONES))[:, None]
        gb *= (-1 / (gb @ _ONES))[:, None]
        ga[at, g] += 1
        gb[at, cls % GROUPS] += 1
        for k in range(FEATURES):
            order = np.argsort((f[k] * GROUPS + g).astype(np.uint16), kind="stable")
            for rr, grad, w, sq, used in ((rows[k][order], ga, self.m.group, self.g2, self.gn), (deep[k][order], gb, self.m.within, self.w2, self.wn)):
                first = np.flatnonzero(np.concatenate([[True], rr[1:] != rr[:-1]]))
                self._move(w, sq, used, rr, grad.take(order, 0), first)


_PARTS, _ARITY = 16, 32


def _summed(made: DataFrame, tasks: int) -> DataFrame:
    """Sum of the tasks' arrays of each part, in a tree: no node loads more than ``_ARITY`` of them."""

    def add(key, rows):
        total = None
        for x in rows.column("data"):
            a = np.frombuffer(x.as_py(), np.float32).astype(np.float64)
            total = a if total is None else np.add(total, a, out=total)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        made = made.withColumn("task", F.floor(F.col("task") / _ARITY).cast("int")).groupBy("part", "task").applyInArrow(add, "part int, task int, data binary")
        tasks = -(-tasks // _ARITY)
        if tasks <= 1:
            return made


def train(docs: DataFrame, common: np.ndarray, counts: np.ndarray, rounds: int = 2, rate: float = 0.3, task_bytes: int = 96 << 20) -> Model:
    """Weights after ``rounds`` rounds that take half (a part) of the training documents each.

    A round has a task for each ``task_bytes`` of text, whatever the cluster's cores; their
    weights are averaged by how often a row was used.
    """
    spark = docs.sparkSession
    model = Model.start(counts)
    tasks = task_count(docs, F.octet_length("text"), task_bytes, 8)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model, common))

        def run(batches, shared=shared):
            model, common = shared.value
            task = TaskContext.get().partitionId()
            t = Trainer(model, rate)
            for batch in batches:
                for rows in chunks(batch.column(0)):
                    token, kind, doc = tokens(rows)
                    cls = classes(token, kind, common)
                    f = features(token, cls, doc)
                    for at in range(0, len(token), MINI):
                        t.step(f[:, at : at + MINI], cls[at : at + MINI])
            made = [(t.m.group - model.group) * t.gn[:, None], t.gn, (t.m.within - model.within) * t.wn[:, None], t.wn]
            for k in range(_PARTS):
                data = b"".join(np.array_split(x, _PARTS)[k].astype(np.float32).tobytes() for x in made)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([data], pa.binary())], names=["part", "task", "data"])

        mine = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text").coalesce(tasks)
        found = {x["part"]: np.frombuffer(bytes(x["data"]), np.float32) for x in _summed(mine.mapInArrow(run, "part int, task int, data binary"), tasks).toLocalIterator()}
        if found:
            n, m = FEATURES * ROWS // _PARTS, FEATURES * ROWS * GROUPS // _PARTS
            cut = lambda k, a, b: np.concatenate([found[p][a:b] for p in range(_PARTS)])
            e = n * GROUPS
            group, gn = cut(0, 0, e).reshape(-1, GROUPS), cut(0, e, e + n)
            within, wn = cut(0, e + n, e + n + m * GROUPS).reshape(-1, GROUPS), cut(0, e + n + m * GROUPS, e + n + m * GROUPS + m)
            model = Model(model.group_bias, model.class_bias, model.group + group / np.maximum(gn, 1)[:, None], model.within + within / np.maximum(wn, 1)[:, None])
        shared.unpersist()
    return model


_SENT_DDL = "sa_batch long, round int, target long, data binary"


def _batch_words(b: Batch):
    """Tokens of a batch, its distinct words (sorted) and where each token's word is."""
    parts = []
    base = 0
    for rows in chunks(b.rows.column("text")):
        token, kind, doc = tokens(rows)
        parts.append((token, kind, doc + base))
        base += len(rows)
    token, kind, doc = (np.concatenate(x) for x in zip(*parts))
    order, first, count = distinct(token)
    place = np.zeros(len(token), np.int64)
    place[order] = np.repeat(np.arange(len(first)), count)
    return token, kind, doc, token[order][first], kind[order][first], place


def placed(docs: DataFrame, batch_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """Documents in batches, with the fold of each."""
    n = task_count(docs, F.octet_length("text"), batch_bytes, 256)
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
    return docs.select(
        "doc_id", "text", held.alias("held_out"), F.xxhash64("text").alias("sa_hash"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long").alias("sa_batch")
    ).repartition("sa_batch"), max(4, (n - 1).bit_length())


def count_words(batches: DataFrame, bits: int) -> DataFrame:
    """Counts heard by each batch (round 1), and sums by class and common words of each range (rounds 2, 3)."""

    def ask(rows: pa.Table) -> pa.Table:
        b = Batch(rows, 0)
        token, kind, doc, word, word_kind, place = _batch_words(b)
        held = b.rows.column("held_out").to_numpy(zero_copy_only=False)
        n = np.bincount(place[~held[doc]], minlength=len(word)).astype(np.uint64)
        return send(rows.column("sa_batch")[0].as_py(), 1, [word, n, word_kind.astype(np.uint64)], np.zeros(len(word)), bits)

    def settle(rows: pa.Table) -> pa.Table:
        data = [x.as_py() for x in rows.column("data")]
        sizes = [len(d) // 25 for d in data]
        word, n, kind = (np.concatenate([np.frombuffer(d, np.uint64, s, 8 * s * i) for d, s in zip(data, sizes)]) for i in range(3))
        order, first, count = distinct(word)
        total = np.add.reduceat(n[order], first)
        heard = np.zeros(len(word), np.uint64)
        heard[order] = np.repeat(total, count)
        cuts = np.cumsum([0, *sizes])
        kinds = kind[order][first].astype(np.int64)
        known = total > 0
        sums = np.concatenate([np.bincount(kinds, total.astype(float), CLASSES), np.bincount(kinds[known], minlength=CLASSES).astype(float)])
        top = np.lexsort((word[order][first], -total.astype(np.int64)))[:OWN]
        best = np.stack([word[order][first][top], total[top], kinds[top].astype(np.uint64)])
        t = rows.column("target")[0].as_py()
        return pa.table({
            "sa_batch": pa.array([*rows.column("sa_batch").to_pylist(), -1, -1], pa.int64()), "round": pa.array([1] * len(data) + [2, 3], pa.int32()),
            "target": pa.array([t] * (len(data) + 2), pa.int64()),
            "data": pa.array([*(heard[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), sums.tobytes(), best.tobytes()], pa.binary()),
        })

    return batches.groupBy("sa_batch").applyInArrow(ask, _SENT_DDL).groupBy("target").applyInArrow(settle, _SENT_DDL)


def totals(heard: DataFrame) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Training tokens and distinct words by suffix class, and the commonest words (hash, count, class)."""
    sums, best = np.zeros(2 * CLASSES), []
    for r in heard.filter("round > 1").select("round", "data").toLocalIterator():
        if r["round"] == 2:
            sums += np.frombuffer(bytes(r["data"]))
        else:
            best += zip(*np.frombuffer(bytes(r["data"]), np.uint64).reshape(3, -1).tolist())
            best = sorted((x for x in best if x[1] > 0), key=lambda x: (-x[1], x[0]))[:OWN]
    return sums[:CLASSES], sums[CLASSES:], best


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    batches, bits = placed(docs)
    heard = table(count_words(batches, bits), "word-counts")
    n_class, v_class, best = totals(heard)
    total, distinct_words = n_class.sum(), v_class.sum()
    common = np.array(sorted(h for h, _, _ in best), np.uint64)
    by_class = np.zeros(CLASSES)
    for h, n, k in best:
        n_class[k] -= n
        v_class[k] -= 1
        by_class[int(np.searchsorted(common, np.uint64(h)))] = n
    by_class[OWN:] = n_class[OWN:]
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
    model = train(docs.select("doc_id", "text").filter(~held), common, by_class)
    shared = docs.sparkSession.sparkContext.broadcast((model, common, n_class, v_class, float(total), float(distinct_words)))

    def run(rows: pa.Table, said: pa.Table) -> pa.Table:
        model, common, n_class, v_class, total, v = shared.value
        b = Batch(rows, 0)
        token, kind, doc, word, word_kind, place = _batch_words(b)
        mine = said.filter(pc.equal(said.column("round"), 1))
        count = answers(mine, 1).view(np.uint64).astype(float)[place]
        n = len(b.ends)
        cls = classes(token, kind, common)
        inside = np.where(cls < OWN, 0.0, np.log10((count + 0.1) / (n_class + 0.1 * (v_class + 1))[cls]))
        made = np.zeros(len(token))
        f = features(token, cls, doc)
        for at in range(0, len(token), MINI):
            made[at : at + MINI] = model.log10(f[:, at : at + MINI], cls[at : at + MINI])
        total_of = lambda x: np.bincount(doc, x, n)
        base = np.log10((count + 0.1) / (total + 0.1 * (v + 1)))
        return pa.table({
            "doc_id": b.rows.column("doc_id"), "held_out": b.rows.column("held_out"),
            "n_tokens": pa.array(np.bincount(doc, minlength=n)), "n_known": pa.array(total_of(count > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, int(total))), "base_score": pa.array(total_of(base)), "score": pa.array(total_of(made + inside)),
        })

    by = lambda df: df.groupBy("sa_batch")
    return by(batches).cogroup(by(heard.filter("round = 1"))).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op2_class_maxent(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
