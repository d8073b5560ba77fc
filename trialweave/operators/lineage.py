"""Cutting lineage in storage that outlives an executor, and broadcasts behind a size check."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Most rows of a broadcast look-up table; the dictionary model refuses more fields than this.
LOOKUP_ROWS = 100_000


#: Spark's setting by which an execution removes its shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files: each execution removes its own as it ends,
    which Spark else does when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the cluster names, or else in the shared warehouse. The
    shuffle files that it took to make are removed, nothing reads them again."""
    use_checkpoint_dir(df.sparkSession)
    with releasing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame of its own, which the setting binds


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Set the checkpoint folder if none is set: ``spark.checkpoint.dir``, else the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(
            folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def lookup(df: DataFrame, rows: list) -> DataFrame:
    """A table made from ``rows`` on the driver, with a broadcast hint if it is small enough."""
    return F.broadcast(df) if len(rows) <= LOOKUP_ROWS else df
