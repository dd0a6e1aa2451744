"""Written intermediate tables in the shared folder, and schema helpers."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.storage import work_path

TEXT = "string"


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read back; cuts lineage and leaves no shuffle files."""
    path = work_path(df.sparkSession, name)
    with _setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    Executors keep them until the driver's garbage collector finds that no plan needs them, by default once in half an hour,
    so that a row of large jobs would hold the files of all of them at once.
    """
    spark._jvm.java.lang.System.gc()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A session setting for the jobs that are run inside; the former one comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession, size: int = 16_000_000):
    """Arrow batches of at most about ``size`` bytes in the jobs that are run inside."""
    return _setting(spark, BATCH_BYTES, str(size))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = stem
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"{stem}_{uuid.uuid4().hex[:6]}"
    return name
