"""Chat formatting with budgeted, turn-aligned windows (DataFrame functions only).

A conversation is rendered as one or more windows. Prefix sums of turn tokens choose the
spans: a window takes new turns while system turn, repeated history and new turns fit in
``budget`` tokens (one new turn at least). Each later window repeats the system turn and
the latest earlier turns of ``history`` tokens at most, fewer where the first new turn
would pass the budget with them. Only assistant turns that are new
in a window are under its loss mask, so every assistant text is a target exactly once.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In texts and roles every ``<``,
backslashes, ``|`` gets one more backslash, so no control string can occur inside them;
in roles ``%`` and line breaks are percent-coded as well. Both are undone exactly.

A conversation of up to ``segment`` rows is one array. A longer one is never gathered: where
the next window would begin if one began at a turn only depends on the turns just after it
(a turn has four tokens at least, so a window has at most ``budget / 4`` turns). So segments
of that many rows, with some neighbours on both sides, work out this jump for each of their
turns, hence where a chain of windows that enters the segment at a turn leaves it. These
maps are composed in a tree, the tree is walked down again for the turn at which the chain
enters each segment, and the windows are then gathered one by one. They are the same as if
the conversation were one array.

Defined cases: null role or text is the empty string; null conv_id is a conversation of
its own; null turn sorts first; equal turns are ordered by role, then text, and repeated
rows are all kept; an empty table gives no rows; further columns are ignored, whatever their
names; a very long text is a window of its own. An empty text yields an empty target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(c):
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c):
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _role_out(c):
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(c):
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


#: First turn of the history that a window opening at turn i repeats, within the budget.
_HIST = """element_at(filter(sequence(greatest(head, turns[{i}].hist), {i}),
  h -> turns[{i}].before - turns[h].before <= greatest(0L, {budget} - sys_tokens - turns[{i}].tokens)), 1)"""

#: Spans of a conversation as struct(hist, start, end). Each turn knows the tokens before it
#: and the first turn of the history it may repeat, so this is one pass.
_SPANS = """
aggregate(
  sequence(0, size(turns) - 1),
  named_struct('start', 0, 'hist', 0, 'used', 0L, 'spans', cast(array() as array<struct<hist:int,start:int,end:int>>)),
  (a, i) -> if(
    i = a.start or a.used + turns[i].tokens <= {budget},
    named_struct('start', a.start, 'hist', a.hist, 'used', a.used + turns[i].tokens, 'spans', a.spans),
    named_struct(
      'start', i,
      'hist', {hist},
      'used', sys_tokens + turns[i].before - turns[{hist}].before + turns[i].tokens,
      'spans', concat(a.spans, array(named_struct('hist', a.hist, 'start', a.start, 'end', i))))),
  a -> concat(a.spans, array(named_struct('hist', a.hist, 'start', a.start, 'end', size(turns)))))
"""

#: Turns of each window; ctx: repeated, target: under the loss mask.
_WINDOWS = """
transform(spans, span -> concat(
  transform(slice(turns, 1, if(span.start > 0, head, 0)),
     t -> named_struct('role', t.role, 'text', t.text, 'ctx', true, 'target', false)),
  transform(slice(turns, span.hist + 1, if(span.start > 0, span.start - span.hist, 0)),
     t -> named_struct('role', t.role, 'text', t.text, 'ctx', true, 'target', false)),
  transform(slice(turns, span.start + 1, span.end - span.start),
     t -> named_struct('role', t.role, 'text', t.text, 'ctx', false, 'target', t.role = 'assistant'))))
"""

#: Character spans (start from 0, length) of the loss mask inside the rendered window.
_MASK = """
aggregate(shown, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,len:int>>)),
  (a, t) -> named_struct(
    'at', a.at + char_length(t.head) + char_length(t.body) + {tail},
    'out', if(t.target, concat(a.out, array(named_struct('start', a.at + char_length(t.head), 'len', char_length(t.body)))), a.out)),
  a -> a.out)
"""


def _numbered(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Rows of the ``long`` conversations with ``rn``, their place from 0.

    Range partitions are sorted and counted, so no task sorts a whole conversation.
    """
    key = ["conv_id", "turn", "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = rows.alias("r").join(F.broadcast(long).alias("l"), F.expr("r.conv_id <=> l.conv_id")).select("r.*", "l.c")
    x = cut(mine.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()))
    x = x.withColumn("part", F.shiftright("at", 33))
    of = x.groupBy("conv_id", "part").agg(F.min("at").alias("lo"), F.count("*").alias("k"))
    so_far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    of = of.withColumn("ahead", F.sum("k").over(so_far) - F.col("k"))
    return x.alias("x").join(F.broadcast(of).alias("o"), F.expr("x.conv_id <=> o.conv_id and x.part = o.part")).select(
        *(f"x.{c}" for c in rows.columns), "x.c", F.expr("o.ahead + x.at - o.lo").alias("rn")
    )


#: First row of the history that a window opening at row ``r`` of ``t`` repeats, and its tokens.
_BACK = """try_element_at(filter(slice(t, greatest(1, k - {most}), least(k, {most} + 1)),
  x -> x.rn >= head and r.before - x.before <= greatest(0L, least({history}L, {budget}L - sys_tokens - r.tokens))), 1)"""
#: First row after ``k`` that does not fit a window opening there, or null.
_NEXT = """try_element_at(filter(slice(t, k + 1, {most} + 1), x -> x.before + x.tokens - r.before + used > {budget}), 1)"""


def _jumps(x: DataFrame, segment: int, budget: int, history: int) -> DataFrame:
    """conv_id, seg, c and for each row of a segment: where a window that opens there begins to repeat, and ends."""
    ahead, behind = -(-budget // 4) + 1, -(-history // 4) + 1
    slim = x.select("conv_id", "rn", "c", F.col("tokens"), (F.col("rn").eqNullSafe(0) & (F.col("role") == "system")).alias("is_head"))
    first = slim.filter("rn = 0").select(F.col("conv_id").alias("conv"), F.when(F.col("is_head"), F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("sys_tokens"), F.col("is_head").cast("int").alias("head"))
    at = f"(rn div {segment})"
    near = F.expr(
        f"filter(array({at}, if(rn % {segment} < {ahead}, {at} - 1, null), if(rn % {segment} >= {segment - behind} and ({at} + 1) * {segment} < c, {at} + 1, null)), s -> s >= 0)"
    )
    rows = slim.withColumn("seg", F.explode(near))
    so_far = Window.partitionBy("conv_id", "seg").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("tokens").over(so_far) - F.col("tokens"))
    g = rows.groupBy("conv_id", "seg", "c").agg(F.sort_array(F.collect_list(F.struct("rn", "tokens", "before"))).alias("t"))
    g = g.alias("g").join(F.broadcast(first).alias("f"), F.expr("g.conv_id <=> f.conv")).select("g.*", "sys_tokens", "head")
    sizes = {"budget": budget, "history": history}
    back = _BACK.format(most=behind, **sizes)
    follow = _NEXT.format(most=ahead, **sizes)
    one = (
        f"transform(array({back}), y -> transform(array(if(r.rn = 0, 0L, sys_tokens + r.before - y.before)), used ->"
        f" named_struct('rn', r.rn, 'hist', if(r.rn = 0, 0L, y.rn), 'next', coalesce({follow}.rn, c)))[0])[0]"
    )
    own = f"filter(transform(t, (r, i) -> named_struct('r', r, 'k', i + 1)), z -> z.r.rn div {segment} = seg)"
    return g.select("conv_id", "seg", "c", F.expr(f"transform({own}, z -> transform(array(z.r), r -> transform(array(z.k), k -> {one})[0])[0])").alias("jump"))


#: Composed maps: a map is the array of the rows at which chains leave, by the row at which they enter.
_WIDE = 64


def _entries(jumps: DataFrame, segment: int, segments: int) -> DataFrame:
    """conv_id, seg, entry: the first row of each segment at which a window begins."""
    leave = (
        "aggregate(reverse(jump), cast(array() as array<bigint>),"
        f" (out, j) -> concat(array(if(j.next >= least(c, (seg + 1) * {segment}), j.next, out[cast(j.next - j.rn - 1 as int)])), out))"
    )
    levels = [cut(jumps.select("conv_id", "c", F.col("seg").alias("at"), (F.col("seg") * segment).alias("base"), F.expr(leave).alias("map")))]
    while segments > 1:
        segments = -(-segments // _WIDE)
        step = "if(e >= c, e, m.map[cast(e - m.base as int)])"
        g = levels[-1].groupBy("conv_id", "c", F.expr(f"at div {_WIDE}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "base", "map"))).alias("m"))
        composed = f"aggregate(slice(m, 2, size(m)), m[0].map, (acc, m) -> transform(acc, e -> {step}))"
        levels.append(cut(g.select("conv_id", "c", F.col("up").alias("at"), F.expr("m[0].base").alias("base"), F.expr(composed).alias("map"))))
    found = levels[-1].select("conv_id", "c", "at", F.lit(0).cast("long").alias("entry"))
    for below in levels[-2::-1]:
        g = below.groupBy("conv_id", F.expr(f"at div {_WIDE}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "base", "map"))).alias("m"))
        j = g.alias("g").join(found.alias("f"), F.expr("g.conv_id <=> f.conv_id and g.up = f.at")).select("g.conv_id", "f.c", "g.m", "f.entry")
        walk = (
            "aggregate(m, named_struct('e', entry, 'out', cast(array() as array<struct<at:bigint,entry:bigint>>)),"
            " (a, m) -> named_struct('e', if(a.e >= c, a.e, m.map[cast(a.e - m.base as int)]), 'out', concat(a.out, array(named_struct('at', m.at, 'entry', a.e)))), a -> a.out)"
        )
        found = cut(j.select("conv_id", "c", F.explode(F.expr(walk)).alias("x")).select("conv_id", "c", "x.at", "x.entry").filter("entry < c"))
    return found.select("conv_id", F.col("at").alias("seg"), "entry")


def _long_windows(x: DataFrame, segment: int, budget: int, history: int) -> DataFrame:
    """conv_id, seg (the row at which it begins), window and members of the windows of numbered long conversations."""
    jumps = cut(_jumps(x, segment, budget, history))
    segments = jumps.agg(F.max("seg")).first()[0] + 1
    begun = jumps.alias("j").join(_entries(jumps, segment, segments).alias("e"), F.expr("j.conv_id <=> e.conv_id and j.seg = e.seg")).select("j.conv_id", "jump", "entry")
    orbit = (
        "aggregate(jump, named_struct('e', entry, 'out', cast(array() as array<struct<rn:bigint,hist:bigint,next:bigint>>)),"
        " (a, j) -> if(j.rn = a.e, named_struct('e', j.next, 'out', concat(a.out, array(j))), a), a -> a.out)"
    )
    windows = begun.select("conv_id", F.explode(F.expr(orbit)).alias("w")).select("conv_id", F.col("w.rn").alias("start"), F.col("w.hist").alias("hist"), F.col("w.next").alias("end"))
    covered = windows.withColumn("at", F.explode(F.expr("sequence(hist, end - 1)"))).select("conv_id", "start", "at")
    head = x.filter("rn = 0 and role = 'system'").select(F.col("conv_id").alias("conv"))
    again = windows.filter("start > 0").alias("w").join(F.broadcast(head).alias("h"), F.expr("w.conv_id <=> h.conv")).select("w.conv_id", "w.start", F.lit(0).cast("long").alias("at"))
    covered = covered.unionByName(again)
    met = covered.alias("v").join(x.alias("x"), F.expr("v.conv_id <=> x.conv_id and v.at = x.rn")).select("v.conv_id", "v.start", "v.at", "x.role", "x.text")
    g = met.groupBy("conv_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("m"))
    members = F.expr("transform(m, t -> named_struct('role', t.role, 'text', t.text, 'ctx', t.at < start, 'target', t.at >= start and t.role = 'assistant'))")
    return g.select("conv_id", F.col("start").alias("seg"), F.lit(0).alias("window"), members.alias("members"))


def _short_windows(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """The same of conversations that are one array."""
    whole = Window.partitionBy("conv_id")
    place = whole.orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "i": F.row_number().over(place) - 1,
        "before": F.sum("tokens").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"),
    })
    rows = rows.withColumn("hist", F.min("i").over(whole.orderBy("before").rangeBetween(-int(history), 0)))
    g = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "role", "text", "tokens", "before", "hist"))).alias("turns")
    )
    g = g.withColumn("head", F.expr("if(turns[0].role = 'system', 1, 0)"))
    g = g.withColumn("sys_tokens", F.expr("if(head = 1, turns[0].tokens, 0L)"))
    g = g.withColumn("spans", F.expr(_SPANS.format(budget=int(budget), hist=_HIST.format(i="i", budget=int(budget)))))
    return g.select("conv_id", F.lit(0).cast("long").alias("seg"), F.posexplode(F.expr(_WINDOWS)).alias("window", "members"))


def format_chats(turns: DataFrame, budget: int = 512, history: int = 128, segment: int = 256) -> DataFrame:
    """Windows of every conversation: conv_id, seg, window, formatted, mask, n_context, n_tokens.

    ``seg`` is the row at which a window of a long conversation begins, else 0; windows are in
    the order of seg and window. ``segment`` (raised to hold a window) decides how the work is
    divided, not the windows.
    """
    budget, history = int(budget), int(history)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")).cast("long") + 4)
    segment = max(int(segment), -(-max(budget, history) // 4) + 2)
    long = cut(rows.groupBy("conv_id").agg(F.count("*").alias("c")).filter(F.col("c") > segment))
    short = rows.alias("r").join(F.broadcast(long).alias("l"), F.expr("r.conv_id <=> l.conv_id"), "left_anti")
    w = _short_windows(short, budget, history)
    if not long.isEmpty():
        w = w.unionByName(_long_windows(cut(_numbered(rows, long)), segment, budget, history))
    shown = F.transform(
        "members",
        lambda t: F.struct(
            F.concat(F.lit(START), _role_out(t.role), F.lit("\n")).alias("head"),
            escape(t.text).alias("body"), t.ctx.alias("ctx"), t.target.alias("target"),
        ),
    )
    w = w.select("conv_id", "seg", "window", shown.alias("shown"))
    return w.select(
        "conv_id", "seg", "window",
        F.expr(f"array_join(transform(shown, t -> concat(t.head, t.body, '{END}\n')), '')").alias("formatted"),
        F.expr(_MASK.format(tail=len(END) + 1)).alias("mask"),
        F.expr("size(filter(shown, t -> t.ctx))").alias("n_context"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets of each window, parsed from the rendered string and its mask."""
    parts = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    new = F.slice(parts, F.col("n_context") + 1, F.greatest(F.size(parts) - 1 - F.col("n_context"), F.lit(0)))
    body = F.transform(new, lambda t: F.struct(
        _role_in(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.regexp_replace(t, r"\A<\|im_start\|>[^\n]*\n", "")).alias("text"),
    ))
    loss = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m.start + 1, m["len"])))
    return windows.select("conv_id", "seg", "window", "formatted", body.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def op1_chat_windows(spark, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", args={"said": said})
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_chats(rows))
    each = back.select(
        "conv_id",
        F.struct(
            "seg", "window",
            F.size("turns").cast("long").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"),
            F.col("loss_text").alias("loss"),
            F.char_length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    loss = F.array_join(F.col("w.loss"), "")
    total = lambda f: F.aggregate(F.col(f), F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id",
        total("w.n").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.col("w.said"), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        total("w.chars").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )
