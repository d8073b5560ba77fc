"""Batches that go to Python workers stay small beside the memory of an executor."""
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialweave.llm.common import BATCH_BYTES, PIECE_BYTES, map_arrow


def _held(df):
    """Bytes of text, of rows of 100,000 each, in the batch that each piece is cut from."""
    def build():
        def run(piece):
            size = sum(b.size for b in piece.column("text").buffers() if b is not None)
            return pa.RecordBatch.from_arrays([pa.array([size]), pa.array([piece.num_rows])], ["size", "n"])
        return run
    return map_arrow(df, build, "size long, n long", "text").collect()


@pytest.fixture
def long_texts(spark):
    return spark.range(0, 200, 1, 1).select(F.repeat(F.lit("a long text "), 8334).alias("text"))


def test_a_batch_is_not_larger_than_a_piece(spark, long_texts):
    """20 MB of text used to go to the worker as one batch."""
    spark.conf.unset(BATCH_BYTES)
    found = _held(long_texts)
    assert sum(r["n"] for r in found) == 200
    assert max(r["size"] for r in found) < 2 * PIECE_BYTES


def test_a_limit_that_the_session_was_given_stays(spark, long_texts):
    spark.conf.set(BATCH_BYTES, "1m")
    try:
        found = _held(long_texts)
        assert spark.conf.get(BATCH_BYTES) == "1m"
        assert sum(r["n"] for r in found) == 200 and max(r["size"] for r in found) < 2 << 20
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_a_single_row_above_the_limit_is_whole(spark):
    size = 3 * PIECE_BYTES
    df = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("x"), size).alias("text"))
    assert [(r["n"], r["size"] >= size) for r in _held(df)] == [(1, True)] * 3
