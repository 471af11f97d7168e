"""Corpus pipeline: five stages over ``documents``, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Nulls, repeated rows and empty tables go through every stage as
their operators define them; a very long text goes through whole; a text emptied by a stage
stays as an empty document. All columns but the text travel as one struct, so further
columns are kept and none of them can clash with an operator's own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard, packing, pii, quality, suffix
from skein.llm.common import complete, discard, documents, shared_dir, table, written

#: Dropped row numbers up to this many are broadcast (8 bytes each), beyond it joined.
FEW = 4_000_000


def _apart(docs: DataFrame) -> DataFrame:
    """``text``, and all columns (the text empty) as ``row``."""
    return docs.select("text", F.struct(*(F.lit(None).cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _together(out: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` out of ``row``, some of them new."""
    return out.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and the posterior of the weak supervision."""
    # written, as a filter on the verdict would else be pushed into the measuring expressions
    judged = quality.judge(table(quality.measure(_apart(docs)), "stage-quality"))
    return _together(judged.filter("q_kept"), docs, text=F.col("text"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each component of near-duplicates; texts without words all stay."""
    # written, so that every reader sees the same numbers
    numbered = table(_apart(docs).select(F.monotonically_increasing_id().alias("doc_id"), "text", "row"), "stage-numbered")
    found = jaccard.similar_components(numbered)
    drop = table(found.filter("n_shingles > 0 and doc_id <> component_id").select("doc_id"), "stage-dropped")
    if drop.count() <= FEW:
        drop = F.broadcast(drop)
    return _together(numbered.join(drop, "doc_id", "left_anti"), docs, text=F.col("text"))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of a 200-byte string that occurs more than once."""
    plain = _apart(docs).select(F.col("row.doc_id").alias("doc_id"), "text", "row")
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return _together(suffix.dedup(plain), docs, text=text, n_chars=F.char_length(text).cast("long"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets in the place of personal data."""
    return pii.redact(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths: one row per document piece."""
    return packing.pack(docs)


#: Tables that the latest stage's result was made from.
_LEFT: list[str] = []


def _cleared(stage: Callable) -> Callable:
    """``stage``, after deleting the tables of the stage before, whose result is written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = set(written(spark))
        discard(spark, *(p for p in _LEFT if p in before))
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [p for p in written(spark) if p not in before]
        return out

    return run


STAGES = [
    ("quality", _cleared(good_quality)),
    ("near_duplicates", _cleared(one_of_each_group)),
    ("repeated_passages", _cleared(no_repeated_passages)),
    ("personal_data", _cleared(no_personal_data)),
    ("packing", _cleared(packed)),
]

#: Learned accuracies, greedy packing and repeated substrings are beyond plain SQL; the
#: stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Every stage but the last is written under ``folder`` and read again. With a folder named
    by the caller, a lost run can be started again: stages that have been written are read.
    """
    docs = documents(spark, sf_dir)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        if not complete(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
