"""History over any number of snapshots or rounds: how long each record or cell had which status.

An interval says that a key had a status from one stamp until, but not at, another. A key that a
snapshot does not list has no status then. A scope (a queue, a site) with no row at all in a snapshot
could not be read: its intervals run on until the next snapshot in which it was.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _same(a, b):
    return a["status"].eqNullSafe(b["status"])


def fold_rounds(rounds: DataFrame, keys: list[str], scope: str, stamp: str = "stamp",
                status: str = "status") -> DataFrame:
    """T1 and T7 over many rounds: ``keys``, ``status``, ``from_stamp`` and ``to_stamp``.

    ``scope`` is one of the keys. ``to_stamp`` is null where the status still holds. The rounds of a
    scope are numbered in a table with one row for each, and one aggregate with partial combine
    folds all rounds of a key, so a key costs at most one entry for each round and status. Of rows
    that repeat a key in one round the greatest status counts. Null keys, statuses and scopes are
    values like others; rows without a stamp belong to no round and are left out.
    """
    rows = rounds.where(F.col(stamp).isNotNull()).select(
        *keys, F.col(stamp).alias("_stamp"), F.col(status).alias("status"))
    # without a window over all: a scope's stamps are few, and a set of them is small
    read = rows.groupBy(F.col(scope).alias("_scope")).agg(
        F.array_sort(F.collect_set("_stamp")).alias("_stamps"))
    numbered = read.select("_scope", F.posexplode("_stamps").alias("_n", "_at"), F.get(
        "_stamps", F.col("_n") + 1).alias("_next"))
    entries = rows.join(numbered, F.col(scope).eqNullSafe(F.col("_scope")) & (
        F.col("_stamp") == F.col("_at"))).groupBy(*keys).agg(F.array_sort(F.collect_set(
            F.struct(F.col("_n").alias("n"), "status", F.col("_stamp").alias("from_stamp"),
                     F.col("_next").alias("to_stamp")))).alias("_all"))
    after = lambda i: F.get("_one", i + 1)
    before = lambda i: F.get("_one", i - 1)
    runs = entries.select(*keys, F.filter("_all", lambda x, i: (
        F.get("_all", i + 1)["n"].isNull() | (F.get("_all", i + 1)["n"] != x["n"]))).alias("_one")) \
        .select(*keys, F.filter("_one", lambda x, i: (i == 0) | ~(
            (before(i)["n"] == x["n"] - 1) & _same(before(i), x))).alias("_first"),
            F.filter("_one", lambda x, i: (i == F.size("_one") - 1) | ~(
                (after(i)["n"] == x["n"] + 1) & _same(after(i), x))).alias("_last"))
    return runs.select(*keys, F.explode(F.arrays_zip("_first", "_last")).alias("_run")).select(
        *keys, F.col("_run._first.status").alias("status"),
        F.col("_run._first.from_stamp").alias("from_stamp"),
        F.col("_run._last.to_stamp").alias("to_stamp"))


def add_round(history: DataFrame, latest: DataFrame, keys: list[str], scope: str, stamp,
              status: str = "status") -> DataFrame:
    """The history with one more round, taken at ``stamp``, which is later than all before it.

    The same rows as ``fold_rounds`` over all rounds, but only the intervals that are still open and
    the new round are shuffled; closed ones pass through.
    """
    kind = history.schema["from_stamp"].dataType
    at, none = F.lit(stamp).cast(kind), F.lit(None).cast(kind)
    open_now = history.where(F.col("to_stamp").isNull())
    was = F.struct(F.col("from_stamp"), F.col("status"))
    now = F.struct(F.col(status).alias("status"))
    new = latest.select(*keys, now.alias("_now"))
    old = open_now.select(*keys, was.alias("_was"))
    both = old.unionByName(new, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("_was").alias("_was"), F.max("_now").alias("_now"))
    read = latest.select(F.col(scope).alias("_scope")).distinct().withColumn("_read", F.lit(True))
    both = both.join(read, F.col(scope).eqNullSafe(F.col("_scope")), "left")
    interval = lambda s, a, b: F.struct(s.alias("status"), a.alias("from_stamp"), b.alias("to_stamp"))
    kept = interval(F.col("_was.status"), F.col("_was.from_stamp"), none)
    ended = interval(F.col("_was.status"), F.col("_was.from_stamp"), at)
    begun = interval(F.col("_now.status"), at, none)
    gone = F.col("_now").isNull()
    intervals = (
        F.when(F.col("_was").isNull(), F.array(begun))
        .when(gone & F.col("_read").isNull(), F.array(kept))
        .when(gone, F.array(ended))
        .when(_same(F.col("_was"), F.col("_now")), F.array(kept))
        .otherwise(F.array(ended, begun)))
    fresh = both.select(*keys, F.explode(intervals).alias("_i")).select(*keys, "_i.*")
    return history.where(F.col("to_stamp").isNotNull()).select(*fresh.columns).unionByName(fresh)


def status_at(history: DataFrame, stamp) -> DataFrame:
    """The intervals that hold at a stamp; a scope that was not read then shows its last reading."""
    return history.where((F.col("from_stamp") <= F.lit(stamp)) & (
        F.col("to_stamp").isNull() | (F.col("to_stamp") > F.lit(stamp))))


def time_in_status(history: DataFrame, by: list[str], until) -> DataFrame:
    """Intervals, those closed, and days spent by status; open ones count up to ``until``."""
    days = F.datediff(F.coalesce(F.col("to_stamp").cast("date"), F.lit(until).cast("date")),
                      F.col("from_stamp").cast("date"))
    return history.groupBy(*by, "status").agg(
        F.count(F.lit(1)).alias("intervals"), F.count("to_stamp").alias("closed"),
        F.sum(days).cast("long").alias("days"))
