"""Document fingerprints as invertible Bloom lookup sketches (DataFrame functions only).

A text is cut into paragraphs by one rule for all lengths: lines, and within a line after the
first sentence end that follows ``LEAST`` characters. The distinct paragraph digests go into
three tables of cells; a cell holds a count, the exclusive or of its digests, and that of
their check values. The fingerprint prints such a sketch of ``CELLS`` cells a table.

Two versions are compared by subtracting their printed sketches cell by cell: what they share
cancels, and peeling recovers the rest from cells that hold a single digest, until none does.
If cells are left over, the pair is tried again with a larger sketch: a sketch of an eighth
of the digests estimates how many differ, and that many, by eight, is the number of parts
(by leading bits of the digest) that get a sketch each; as long as a part can't be peeled out
the number of parts is doubled and the cells are hashed anew. Likeness is shared over all
digests, from the numbers recovered. Nothing but sketches is compared, and it all happens
inside the row, so the only thing shuffled is each text, once, to meet the next one.

Defined cases: null text is empty; a text without a paragraph has an empty sketch, and two
of these are alike (1.0); equal texts have equal fingerprints; null doc_id comes last in the
order; equal doc_ids are ordered by a hash of the text, and one that many rows have is split
by this hash; repeated rows are kept; a very long text has more parts, not larger ones; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, task_count

LEAST, CELLS, PART = 300, 4, 8
KNOTS = 256
RANGES = 65536
LAST = -(2**63)
_PARAGRAPH = rf"[^\n]{{{LEAST},}}?[.!?](?=\x20)|[^\n]+"


def digests(c):
    """Distinct paragraph digests of a text."""
    pieces = F.regexp_extract_all(c, F.lit(_PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(F.filter(pieces, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)))


# -- sketches, as SQL ------------------------------------------------------------------------


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _element(d: str, s: str) -> str:
    """A digest with its sign and check value."""
    return f"named_struct('d', {d}, 's', {s}, 'h', xxhash64({d}, 7L))"


def _placed(x: str, cells: int, seed: str) -> str:
    """The elements of ``x`` with their cell in each of the three tables."""
    at = ", ".join(f"'i{t}', {t * cells} + cast(pmod(xxhash64(e.d, {seed}, {t}), {cells}) as int)" for t in range(3))
    return f"transform({x}, e -> named_struct('d', e.d, 's', e.s, 'h', e.h, {at}))"


def _folded(elements: str, start: str, sign: str) -> str:
    """What cell ``i`` holds after adding or subtracting its elements."""
    return (
        f"aggregate(filter({elements}, e -> e.i0 = i or e.i1 = i or e.i2 = i), {start},"
        f" (c, e) -> named_struct('n', c.n {sign} e.s, 'k', c.k ^ e.d, 'h', c.h ^ e.h))"
    )


def cells(x: str, count: int, seed: str) -> str:
    """Three tables of ``count`` cells of the elements ``x``."""
    fold = _folded("placed", "named_struct('n', 0, 'k', 0L, 'h', 0L)", "+")
    return _let(_placed(x, count, seed), "placed", f"transform(sequence(0, {3 * count - 1}), i -> {fold})")


def peeled(sketch: str, count: int, seed: str) -> str:
    """struct(ok, a, b): whether a sketch peels out, and how many digests of each sign it held."""
    pure = f"filter(s.cells, x -> abs(x.n) = 1 and x.h = xxhash64(x.k, 7L))"
    found = _placed(f"array_distinct(transform({pure}, x -> named_struct('d', x.k, 's', x.n, 'h', x.h)))", count, seed)
    step = _let(found, "pure", (
        "if(size(pure) = 0, named_struct('cells', s.cells, 'a', s.a, 'b', s.b, 'go', false),"
        f" named_struct('cells', transform(s.cells, (x, i) -> {_folded('pure', 'x', '-')}),"
        " 'a', s.a + size(filter(pure, e -> e.s > 0)), 'b', s.b + size(filter(pure, e -> e.s < 0)), 'go', true))"
    ))
    return (
        f"aggregate(sequence(0, {3 * count}), named_struct('cells', {sketch}, 'a', 0, 'b', 0, 'go', true), (s, z) -> if(s.go, {step}, s),"
        " s -> named_struct('ok', not exists(s.cells, x -> x.n <> 0 or x.k <> 0 or x.h <> 0), 'a', s.a, 'b', s.b))"
    )


def sketch(name: str) -> str:
    """The printed sketch's cells of digest column ``name``."""
    return cells(f"transform({name}, d -> {_element('d', '1')})", CELLS, "0")


def printed(digest: str, cell: str) -> str:
    """Number of digests, then the cells in hexadecimal."""
    one = "concat_ws('.', lower(hex(c.n)), lower(hex(c.k)), right(lower(hex(c.h)), 8))"
    return f"concat(size({digest}), ':', array_join(transform({cell}, c -> {one}), '|'))"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """struct(ok, a, b): numbers of digests that only ``a`` and only ``b`` have, by sketches."""
    first = peeled(f"zip_with({cells_a}, {cells_b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'h', p.h ^ q.h))", CELLS, "0")
    signed = f"sort_array(concat(transform({a}, d -> {_element('d', '1')}), transform({b}, d -> {_element('d', '-1')})))"
    some = peeled(cells("filter(x, e -> (e.h & 7) = 0)", PART, "1"), PART, "1")
    bits = f"greatest(1, cast(ceil(log2((if(r.ok, 8 * (r.a + r.b) + 8, size(x))) / {PART}D)) as int))"
    # parts are runs of the sorted digests; equal leading bits are adjacent
    lead = lambda i: f"shiftrightunsigned(get(x, {i}).d, 64 - least(63, bits + t))"
    starts = f"filter(sequence(0, size(x) - 1), i -> i = 0 or {lead('i')} <> {lead('i - 1')})"
    part = "slice(x, p + 1, coalesce(get(starts, j + 1), size(x)) - p)"
    each = _let(starts, "starts", f"transform(starts, (p, j) -> {peeled(cells(part, PART, 't + 2'), PART, 't + 2')})")
    once = (
        f"aggregate({each}, named_struct('ok', true, 'a', 0, 'b', 0),"
        " (m, y) -> named_struct('ok', m.ok and y.ok, 'a', m.a + y.a, 'b', m.b + y.b))"
    )
    again = f"aggregate(sequence(0, 40), named_struct('ok', false, 'a', 0, 'b', 0), (w, t) -> if(w.ok, w, {once}))"
    larger = _let(signed, "x", _let(some, "r", _let(bits, "bits", again)))
    return _let(first, "f", f"if(f.ok, f, {larger})")


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> str:
    share = f"if(size({a}) + v.b = 0, 1D, (size({a}) - v.a) / cast(size({a}) + v.b as double))"
    sure = f"if(v.ok, {share}, cast(raise_error('a sketch does not peel out') as double))"
    return _let(difference(a, b, cells_a, cells_b), "v", sure)


# -- the next document -----------------------------------------------------------------------


def _range(docs: DataFrame, range_bytes: int):
    """Expression of a range that rises with (o, descending h); ranges hold about equal numbers of rows.

    Between ``KNOTS`` quantiles of doc_id ranges are evenly spaced; a doc_id that fills whole
    intervals is spread by h. Their number follows the bytes, up to ``RANGES``.
    """
    ranges = min(RANGES, task_count(docs, F.octet_length("text"), range_bytes, KNOTS))
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("double").alias("o"))
    knots = sorted(int(x) for x in ids.approxQuantile("o", [k / KNOTS for k in range(KNOTS + 1)], 1 / (8 * KNOTS)))
    if not knots:
        return F.lit(0).cast("long")
    values = sorted(set(knots))
    marks = []
    for j, v in enumerate(values):
        lo, hi = knots.index(v), bisect_right(knots, v) - 1
        upto = values[j + 1] if j + 1 < len(values) else v
        marks.append((v, lo, hi if abs(v) < 2**53 or v == LAST else lo, float(upto) - v, (knots.index(upto) if upto > v else hi) - hi))
    # a step of 16 marks, then the marks of that step
    steps = [marks[k : k + 16] for k in range(0, len(marks), 16)]
    top = "array(" + ", ".join(f"{_long(s[0][0])}" for s in steps) + ")"
    one = lambda m: f"named_struct('v', {_long(m[0])}, 'lo', {m[1]}, 'hi', {m[2]}, 'gap', {m[3]!r}D, 'more', {m[4]})"
    rest = "array(" + ", ".join("array(" + ", ".join(map(one, s)) + ")" for s in steps) + ")"
    inside = f"get({rest}, greatest(0, size(filter({top}, v -> v <= o)) - 1))"
    mark = f"get(steps, greatest(0, size(filter(steps, m -> m.v <= o)) - 1))"
    high = "(0.5D - h / 18446744073709551616D)"
    place = (
        f"case when o < m.v then 0D when o = m.v then m.lo + (m.hi - m.lo) * {high}"
        " when m.gap > 0 then m.hi + least(1D, (cast(o as double) - cast(m.v as double)) / m.gap) * m.more else m.hi + 0D end"
    )
    found = _let(inside, "steps", _let(mark, "m", place))
    return F.expr(f"cast(floor({found} * {ranges / KNOTS!r}D) as bigint)")


def _long(v: int) -> str:
    return "(-9223372036854775807L - 1L)" if v == LAST else f"{v}L"


def with_next(docs: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Each row of (doc_id, text) with text and digests of the next by descending doc_id, cyclic.

    One shuffle of the texts by range of doc_id. The first row of every range goes to the
    range before it as well, where it is what the last row there looks at.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({
        "o": F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long"), "h": F.xxhash64("text"),
    })
    d = d.withColumn("bucket", _range(docs, range_bytes))
    heads = d.groupBy("bucket").agg(F.max(F.struct("o", F.bitwise_not("h").alias("nh"))).alias("x"))
    heads = heads.select("bucket", F.col("x.o").alias("o"), F.bitwise_not("x.nh").alias("h"))
    everything = Window.orderBy("bucket")  # one row a range
    heads = cut(heads.select("o", "h", F.coalesce(
        F.lead("bucket").over(everything), F.min("bucket").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).alias("into")))
    places = F.when(F.col("into").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("into").alias("bucket"), F.lit(True).alias("ghost")))
    )
    rows = d.join(F.broadcast(heads), ["o", "h"], "left").withColumn("digests", digests(F.col("text")))
    rows = rows.select("doc_id", "o", "h", "text", "digests", F.explode(places).alias("p")).select(
        "doc_id", "o", "h", "text", "digests", "p.bucket", "p.ghost"
    )
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("o").desc(), "h")
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_digests": F.lead("digests").over(w)})
    return rows.filter(~F.col("ghost")).select("doc_id", "text", "digests", "next_text", "next_digests")


def compare(pairs: DataFrame) -> DataFrame:
    """``pairs`` (digest arrays a, b) with what only each has and their likeness, by sketches."""
    both = pairs.withColumns({"cells_a": F.expr(sketch("a")), "cells_b": F.expr(sketch("b"))})
    return both.withColumn("d", F.expr(difference("a", "b", "cells_a", "cells_b"))).select(
        *pairs.columns, F.col("d.a").alias("only_a"), F.col("d.b").alias("only_b"), F.expr(likeness("a", "b", "cells_a", "cells_b")).alias("near")
    )


def op5_bloom_lookup_sketch(spark, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.char_length("text") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "digests", digests(F.col("edited")).alias("edited_digests"), "next_digests",
    )
    for name in ("", "edited_", "next_"):
        rows = rows.withColumn(f"{name}cells", F.expr(sketch(f"{name}digests")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(printed("digests", "cells")).alias("fingerprint"),
        F.expr(printed("edited_digests", "edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("digests", "edited_digests", "cells", "edited_cells")).alias("near_edited"),
        F.expr(likeness("digests", "next_digests", "cells", "next_cells")).alias("near_next"),
    )
