"""Checkpoints leave their rows and nothing else."""
import pytest
from pyspark.sql import functions as F
from shuffle_files import left_by

from trialweave.operators.lineage import CLEANUP, checkpointed, releasing


def _counts(spark):
    return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    frame, made = _counts(spark), []
    assert not left_by(spark, lambda: made.append(checkpointed(frame)))
    want = [(k, len(range(k, 1000, 7))) for k in range(7)]
    assert sorted(map(tuple, made[0].collect())) == want
    assert sorted(map(tuple, frame.collect())) == want  # the frame itself can still be run


def test_columns_of_any_name_are_kept(spark):
    frame = spark.sql("select 1 as `a.b`, 2 as x, 3 as x, 4 as `*`")
    assert checkpointed(frame).columns == ["a.b", "x", "x", "*"]
    assert tuple(checkpointed(frame).first()) == (1, 2, 3, 4)


@pytest.mark.parametrize("value", [None, "true", "false"])
def test_the_setting_is_as_before_afterwards(spark, value):
    if value is not None:
        spark.conf.set(CLEANUP, value)
    try:
        before = spark.conf.get(CLEANUP, None)
        with pytest.raises(ZeroDivisionError), releasing(spark):
            assert spark.conf.get(CLEANUP) == "true"
            raise ZeroDivisionError
        checkpointed(_counts(spark))
        assert spark.conf.get(CLEANUP, None) == before
    finally:
        spark.conf.unset(CLEANUP)
