"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it (spark.checkpoint.dir).

    Only a local session without the setting (tests, one machine) gets a folder of its own;
    on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has written ``path`` to its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the rows survive lost executors and the lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
