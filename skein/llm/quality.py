"""Quality rules combined by weak supervision (DataFrame functions only).

Every rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation
over the counts of vote patterns (at most 3 ** len(RULES), whatever the number of documents)
estimates how often each rule votes rightly, wrongly or not at all on good and on bad
documents, and the share of good ones; a document is kept when its posterior probability
of being good reaches ``threshold``. A bad vote may never speak for a document nor a good
one against it, so that the two classes cannot change places.

Defined cases: null or empty text has no words, every rule abstains, and the base test
fails it; ties and repeated rows get equal verdicts; an empty table gives no rows and no
model is fitted; extra columns are carried by ``judge`` unless they begin with ``q_``,
the prefix of this module's own columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (name, votes bad if, votes good if) over the measured columns; neither: the rule abstains.
#: Most rules know one kind of junk and say nothing about the rest.
RULES = (
    ("symbols", "q_symbols > 0.08 * q_words", None),
    ("symbol_share", "q_symbols > 0.03 * q_chars", None),
    ("long_words", "q_chars > 12 * q_words", None),
    ("tiny_words", "q_chars < 2 * q_words", None),
    ("repeated_lines", "q_dup_lines > 0.25 * q_lines", None),
    ("repeated_words", "q_repeat > 0.35 * q_words", None),
    ("upper_case", "q_upper > 0.3 * q_chars", None),
    ("shouting", "q_shouts > 0.08 * q_words", None),
    ("short_words", "q_short < 0.12 * q_words", "q_short between 0.3 * q_words and 0.8 * q_words"),
    ("length", "q_words < 30", None),
)


def measure(docs: DataFrame) -> DataFrame:
    """Add the q_ columns that rules and base test read; counts are over the whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("q_list", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("q_line_list", lines)
    d = d.withColumn("q_hashes", F.expr(
        "if(size(q_list) < 3, cast(array() as array<bigint>),"
        " transform(sequence(0, size(q_list) - 3), i -> xxhash64(q_list[i], q_list[i + 1], q_list[i + 2])))"))
    d = d.withColumn("q_sorted", F.expr(
        "if(size(array_distinct(q_hashes)) = size(q_hashes), cast(array() as array<struct<h:bigint,i:int>>),"
        " sort_array(transform(q_hashes, (h, i) -> named_struct('h', h, 'i', i))))"))
    d = d.withColumn("q_found", F.expr(
        "sort_array(transform(filter(q_sorted, (x, j) -> (j > 0 and get(q_sorted, j - 1).h = x.h)"
        " or (j < size(q_sorted) - 1 and get(q_sorted, j + 1).h = x.h)), x -> x.i))"))
    d = d.withColumns({
        "q_words": F.size("q_list").cast("long"),
        "q_chars": (F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "q_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "q_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        "q_shouts": F.regexp_count(t, F.lit("!")).cast("long"),
        "q_short": F.size(F.filter("q_list", lambda w: F.char_length(w) <= 4)).cast("long"),
        "q_lines": F.size("q_line_list").cast("long"),
        "q_dup_lines": (F.size("q_line_list") - F.size(F.array_distinct("q_line_list"))).cast("long"),
        "q_repeat": F.expr(
            "aggregate(q_found, named_struct('end', 0, 'n', 0),"
            " (a, i) -> named_struct('end', i + 3, 'n', a.n + i + 3 - greatest(i, a.end)), a -> cast(a.n as bigint))"),
    })
    votes = [
        F.expr(f"case when q_words = 0 then 0 when {bad} then -1 when {good or 'false'} then 1 else 0 end").cast("int")
        for _, bad, good in RULES
    ]
    return d.withColumn("q_votes", F.array(*votes)).drop("q_list", "q_line_list", "q_hashes", "q_sorted", "q_found")


#: Where estimation starts: chance of a bad, no, good vote on good and on bad documents,
#: and the share of good ones. The start also counts as ``HELD`` of all documents, since
#: most kinds of junk are rare.
ON_GOOD, ON_BAD, PRIOR, HELD = (0.01, 0.69, 0.3), (0.3, 0.6, 0.1), 0.85, 0.02


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list, list]:
    """Share of good documents, and each rule's chances of its votes on good and on bad ones."""
    if not patterns:
        return PRIOR, [ON_GOOD] * len(RULES), [ON_BAD] * len(RULES)
    k = len(patterns[0][0])
    prior, on_good, on_bad = PRIOR, [ON_GOOD] * k, [ON_BAD] * k
    total = sum(n for _, n in patterns)
    held = HELD * total
    for _ in range(rounds):
        good_sum = 0.0
        good, bad = [[held * x for x in ON_GOOD] for _ in range(k)], [[held * x for x in ON_BAD] for _ in range(k)]
        for votes, n in patterns:
            p = posterior(votes, prior, on_good, on_bad)
            good_sum += n * p
            for g, b, v in zip(good, bad, votes):
                g[v + 1] += n * p
                b[v + 1] += n * (1 - p)
        before = prior
        prior = min(0.98, max(0.05, (good_sum + held * PRIOR) / (total + held)))
        on_good, on_bad = [tuple(x / sum(g) for x in g) for g in good], [tuple(x / sum(b) for x in b) for b in bad]
        if abs(before - prior) < 1e-9:
            break
    return prior, on_good, on_bad


def weights(prior: float, on_good: list, on_bad: list) -> tuple[float, list[tuple[float, float, float]]]:
    """Log odds: the start, and what a bad, no and good vote of each rule add.

    A bad vote never speaks for a document, nor a good vote against it.
    """
    each = []
    for g, b in zip(on_good, on_bad):
        w = [math.log(max(x, 1e-6) / max(y, 1e-6)) for x, y in zip(g, b)]
        each.append((min(0.0, w[0]), w[1], max(0.0, w[2])))
    return math.log(prior / (1 - prior)), each


def posterior(votes, prior: float, on_good: list, on_bad: list) -> float:
    start, each = weights(prior, on_good, on_bad)
    return 1 / (1 + math.exp(-(start + sum(w[v + 1] for w, v in zip(each, votes)))))


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add q_posterior, q_base_failed and q_kept to the output of ``measure``."""
    counts = [(tuple(r["q_votes"]), r["count"]) for r in measured.groupBy("q_votes").count().collect()]
    start, each = weights(*fit(sorted(counts)))
    odds = F.lit(start)
    for i, (bad, none, good) in enumerate(each):
        v = F.get("q_votes", F.lit(i))
        odds = odds + F.when(v > 0, F.lit(good)).when(v < 0, F.lit(bad)).otherwise(F.lit(none))
    base = (F.col("q_words") < 50) | (100 * F.col("q_repeat") > 50 * F.col("q_words"))
    return measured.withColumns({"q_posterior": 1 / (1 + F.exp(-odds)), "q_base_failed": base}).withColumn(
        "q_kept", ~F.col("q_base_failed") & (F.col("q_posterior") >= threshold)
    )


def op6_weak_supervision(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import cut, documents

    rows = cut(measure(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return judge(rows).select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"), F.round("q_posterior", 6).alias("posterior"),
    )
