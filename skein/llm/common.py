"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.lineage import cut, shared_dir  # noqa: F401

#: Whitespace is exactly these code points; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    out._skein_path = path
    return out


#: Tables of this process that have not been deleted.
_WRITTEN: list[tuple[str, str]] = []


def written(spark: SparkSession) -> list[str]:
    """Paths of this application's tables that have not been deleted."""
    return [p for app, p in _WRITTEN if app == spark.sparkContext.applicationId]


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete the named tables (or paths of tables), which only results already written were made from.

    Shuffle files of plans that nothing refers to any more go too, once the JVM collects them.
    """
    for path in [t if isinstance(t, str) else t._skein_path for t in tables]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has written ``path`` to its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def task_count(df: DataFrame, bytes_expr, target: int, least: int) -> int:
    """Number of groups so that each holds about ``target`` bytes; one scan."""
    total = df.agg(F.sum(bytes_expr)).first()[0] or 0
    return max(least, -(-int(total) // target))
