"""Range hashes and payloads without a schema against plain Python."""
import json
from collections import Counter

from pyspark.sql import functions as F

from trialweave.operators import ranges as G
from trialweave.sources import payloads as P


def _table(spark, edited=(), repeated=(), lost=(), size=3000):
    k = F.col("id")
    base = spark.range(size).where(~k.isin(*lost) if lost else F.lit(True)).select(
        k.cast("string").alias("key"), F.when(k.isin(*edited), "new").otherwise("old").alias("a")
        if edited else F.lit("old").alias("a"), F.when(k % 7 == 0, None).otherwise(k).alias("b"))
    return base.unionByName(base.where(base.key.isin(*map(str, repeated)))) if repeated else base


def _plain(before, after):
    a, b = [Counter(tuple(r) for r in t.collect()) for t in (before, after)]
    return sorted([(*map(str, r), "before") for r in (a - b).elements()]
                  + [(*map(str, r), "after") for r in (b - a).elements()])


def test_changed_rows_equal_a_plain_comparison(spark):
    before, after = _table(spark, lost=[5]), _table(spark, edited=[1, 2999], repeated=[8], lost=[77])
    found = G.changed_ranges(before, after, ["key"]).select("key", "a", "b", "side").collect()
    assert sorted(tuple(map(str, r)) for r in found) == _plain(before, after)


def test_only_leaves_that_differ_are_read(spark):
    before, after = _table(spark), _table(spark, edited=[1, 42, 999])
    leaves = G.changed_leaves(G.leaf_hashes(before, ["key"]), G.leaf_hashes(after, ["key"]))
    assert 1 <= leaves.count() <= 3
    # 3,000 keys in 16 million leaves: hardly ever does another row share one
    assert G.rows_in(after, ["key"], leaves).count() <= 4
    assert {r.key for r in G.rows_in(after, ["key"], leaves).collect()} >= {"1", "42", "999"}


def test_equal_and_empty_tables(spark):
    same, none = _table(spark), _table(spark).limit(0)
    assert G.changed_ranges(same, same.repartition(3), ["key"]).count() == 0
    assert G.changed_ranges(none, none, ["key"]).count() == 0
    assert G.changed_ranges(none, same, ["key"]).where("side = 'after'").count() == 3000


def test_null_is_not_the_empty_text(spark):
    one = spark.createDataFrame([("x", None)], "key string, a string")
    other = spark.createDataFrame([("x", "")], "key string, a string")
    assert G.changed_ranges(one, other, ["key"]).count() == 2


def test_stored_leaves_do_not_depend_on_order_or_partitions(spark, rows):
    t = _table(spark)
    assert rows(G.leaf_hashes(t, ["key"])) == rows(G.leaf_hashes(t.select("b", "a", "key").repartition(5), ["key"]))


PAYLOADS = [("1", json.dumps({"a": "x", "n": 5, "deep": {"k": [1, 2]}, "gone": None, "blank": ""})),
            ("2", json.dumps({"a": True, "käse": "ü\"q", "n": 1.5})), ("3", "{}"), ("4", "[1, 2]"),
            ("5", "not json"), ("6", None), ("1", json.dumps({"a": "again"}))]


def test_cells_of_unknown_payloads(spark, rows):
    df = spark.createDataFrame(PAYLOADS, "field string, payload string")  # the id is named as a result is
    frame = df.withColumnRenamed("field", "id")
    assert rows(P.cells_of(frame, ["id"]), "id", "field", "value") == [
        ("1", "a", "again"), ("1", "a", "x"), ("1", "deep", '{"k":[1,2]}'), ("1", "n", "5"),
        ("2", "a", "true"), ("2", "käse", 'ü"q'), ("2", "n", "1.5")]
    assert ("1", "blank", "") in rows(P.cells_of(frame, ["id"], keep_blank=True), "id", "field", "value")
    assert rows(P.unreadable(frame), "id") == [("4",), ("5",)]
    assert P.cells_of(frame.limit(0), ["id"]).count() == 0


def test_fields_of_unknown_payloads(spark):
    found = {r.field: (r.types, r.records, r.filled) for r in P.fields_of(
        spark.createDataFrame(PAYLOADS, "id string, payload string")).collect()}
    assert found["a"] == ("BOOLEAN, STRING", 3, 3)
    assert found["blank"] == ("STRING", 1, 0)
    assert set(found) == {"a", "n", "deep", "blank", "käse"}
