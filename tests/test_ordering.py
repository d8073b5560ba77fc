import random

from trialweave.operators.matching import number_targets, renumber_duplicates
from trialweave.operators.ordering import (
    first_per_key, last_per_key, numbered, running_total, smallest_per_key,
)
from pyspark.sql import functions as F


def test_numbering_over_a_hot_value(spark):
    rnd = random.Random(3)
    data = [(i, 5 if i % 3 == 0 else rnd.randint(0, 9), f"g{0 if i % 2 else i % 4}")
            for i in range(500)]
    df = spark.createDataFrame(data, "id long, v int, g string").repartition(7)
    got = {r.id: r.position for r in numbered(df, ["v", "id"], slices=16).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(data, key=lambda r: (r[1], r[0])), 1)}
    assert got == want
    inside = {r.id: r.position for r in numbered(df, ["v", "id"], group=["g"], slices=16).collect()}
    for g in {r[2] for r in data}:
        part = sorted((r for r in data if r[2] == g), key=lambda r: (r[1], r[0]))
        assert all(inside[r[0]] == n for n, r in enumerate(part, 1))


def test_running_total_with_nulls_first(spark):
    data = [(None, 2), (1, 3), (2, 5), (7, 1)]
    df = spark.createDataFrame(data, "k int, w long")
    got = {r.k: r.t for r in running_total(df, ["k"], {"t": "w"}, slices=3).collect()}
    assert got == {None: 2, 1: 5, 2: 10, 7: 11}


def test_edges_per_key(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, s int, v string")
    assert rows(last_per_key(df, ["k"], ["s"])) == [("a", 3, "y"), ("b", 2, "z")]
    assert rows(first_per_key(df, ["k"], ["s"])) == [("a", 1, "x"), ("b", 2, "z")]
    top = smallest_per_key(df, ["k"], [F.desc("s")], 1)
    assert rows(top, "k", "s") == [("a", 3), ("b", 2)]


def test_hot_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = smallest_per_key(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_targets_and_renumbering(spark):
    data = [("a", 2, "9"), ("b", 0, "x"), ("c", 0, "10"), ("d", 0, "9"), ("e", 1, "")]
    df = spark.createDataFrame(data, "id string, bucket int, pid string")
    got = {r.id: r.target_id for r in number_targets(df, "bucket", "pid", ["id"]).collect()}
    assert got == {"d": 1, "c": 2, "b": 3, "e": 4, "a": 5}
    ids = spark.createDataFrame([(1, 41), (2, 41), (3, 50), (4, 41)], "seq int, pid long")
    out = {r.seq: (r.new_id, r.renumbered) for r in renumber_duplicates(ids, "pid", ["seq"]).collect()}
    assert out == {1: (41, False), 2: (51, True), 3: (50, False), 4: (52, True)}
