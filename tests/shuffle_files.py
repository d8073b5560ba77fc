"""Shuffle files that a piece of work leaves on the disk of a local session."""
import os
import time


def _files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}


def left_by(spark, work, seconds=10):
    """Names of the shuffle files that ``work()`` adds and that are still there after some seconds."""
    before = _files(spark)
    kept = work()  # noqa: F841  held, so that nothing goes only because the driver forgets it
    end = time.time() + seconds
    while (left := _files(spark) - before) and time.time() < end:
        time.sleep(0.2)  # Spark removes them in the background
    return left
