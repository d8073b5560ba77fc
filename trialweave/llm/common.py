"""What the operators share: tables, folds, Arrow batches, row keys and a safe checkpoint."""
from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lineage import checkpointed, releasing, use_checkpoint_dir

#: Texts are handed to Python code in pieces of about so many bytes, so that a batch of long
#: documents and what is made of it stays small beside a worker's memory.
PIECE_BYTES = 4 << 20

#: Spark's limit of the bytes of a batch that goes to a worker, beside that of its rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

__all__ = ["checkpointed", "releasing", "use_checkpoint_dir", "table", "fold", "fresh", "map_arrow",
           "pieces", "ship", "small_batches", "give_back"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the workers, once for each application, so that tasks can
    import it wherever they run and whatever folder they start in."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix=f"{package.name}-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{package.name}-sources.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as sources:
        for path in sorted(package.rglob("*.py")):
            sources.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder of crc32 of the id, written as text; null ids take part 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not use yet, whatever it carries."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batch: pa.RecordBatch, text: int | str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``PIECE_BYTES`` of text each, empty batches too."""
    size, start = 0, 0
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    for offset, length in enumerate(lengths):
        size += length or 0
        if size >= PIECE_BYTES:
            yield batch.slice(start, offset + 1 - start)
            start, size = offset + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Let Spark send batches of about ``PIECE_BYTES``. By default they may have 64 MB, which the
    executor and the worker both hold whole before ``pieces`` cuts them. The frames that are made run
    later, so the setting stays; one that the session was given is left as it is."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(PIECE_BYTES))


def give_back() -> None:
    """Return to the system what this worker has freed. Workers stay for later tasks, and what they
    keep meanwhile counts beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc
        trim(0)


def map_arrow(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
              schema, text: str | None = None) -> DataFrame:
    """Run ``build()`` once in each task and its function over the task's batches.

    With ``text`` the batches are cut by the size of that column first.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        fn = build()
        for batch in batches:
            for part in (pieces(batch, text) if text else (batch,)):
                yield fn(part)
        del fn
        give_back()
    return df.mapInArrow(run, schema)
