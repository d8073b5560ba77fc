"""Ten rounds of request queues made of ``events``, folded into intervals."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from .registry import query, table

ROUNDS = 10
KEYS = ["queue", "record_id"]


def _rounds(spark, sf):
    """Requests by round: each is left out now and then, done late, reopened once in a while. One
    queue could not be read in the fourth and fifth round."""
    k, r = F.col("event_id"), F.col("r")
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("queue"), "event_id",
        F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))).alias("r"))
    return rows.where(((k + r) % 7 != 0) & ~((F.col("queue") == "view") & r.isin(4, 5))).select(
        "queue", F.col("event_id").alias("record_id"),
        F.format_string("2024-03-%02d", r).alias("stamp"),
        F.when((r >= k % 13) & ((k + r) % 11 != 0), "done").otherwise("open").alias("status"))


_ROUNDS_SQL = f"""rounds AS (
  SELECT event_type AS queue, event_id AS record_id, printf('2024-03-%02d', r) AS stamp,
    CASE WHEN r >= event_id % 13 AND (event_id + r) % 11 <> 0 THEN 'done' ELSE 'open' END AS status
  FROM events, (SELECT CAST(unnest(range(1, {ROUNDS + 1})) AS BIGINT) AS r)
  WHERE (event_id + r) % 7 <> 0 AND NOT (event_type = 'view' AND r IN (4, 5))),
stamps AS (SELECT queue, stamp, row_number() OVER (PARTITION BY queue ORDER BY stamp) AS n,
    lead(stamp) OVER (PARTITION BY queue ORDER BY stamp) AS next
  FROM (SELECT DISTINCT queue, stamp FROM rounds)),
history AS (
  SELECT queue, record_id, status, min(stamp) AS from_stamp, arg_max(coalesce(next, ''), stamp) AS t
  FROM (SELECT *, n - row_number() OVER (PARTITION BY queue, record_id, status ORDER BY n) AS run
        FROM rounds JOIN stamps USING (queue, stamp)) GROUP BY queue, record_id, status, run),
closed AS (SELECT queue, record_id, status, from_stamp, nullif(t, '') AS to_stamp FROM history)"""


@query(f"WITH {_ROUNDS_SQL} SELECT * FROM closed")
def cell_history(spark, sf):
    return H.fold_rounds(_rounds(spark, sf), KEYS, "queue")


@query(f"WITH {_ROUNDS_SQL} SELECT * FROM closed")
def cell_history_extended(spark, sf):
    """The same by adding the last two rounds to the history of those before."""
    rounds = _rounds(spark, sf)
    history = H.fold_rounds(rounds.where("stamp <= '2024-03-08'"), KEYS, "queue")
    for stamp in ("2024-03-09", "2024-03-10"):
        history = H.add_round(history, rounds.where(F.col("stamp") == stamp), KEYS, "queue", stamp)
    return history


@query(f"""WITH {_ROUNDS_SQL}
SELECT queue, status, count(*) AS records FROM rounds r
WHERE stamp = (SELECT max(stamp) FROM rounds x WHERE x.queue = r.queue AND x.stamp <= '2024-03-05')
GROUP BY queue, status""")
def history_status_at(spark, sf):
    """What every queue showed on a day, or when it was last read before."""
    history = H.fold_rounds(_rounds(spark, sf), KEYS, "queue")
    return H.status_at(history, "2024-03-05").groupBy("queue", "status").agg(
        F.count(F.lit(1)).alias("records"))


@query(f"""WITH {_ROUNDS_SQL}
SELECT queue, status, count(*) AS intervals, count(to_stamp) AS closed,
  CAST(sum(CAST(coalesce(to_stamp, '2024-03-11') AS DATE) - CAST(from_stamp AS DATE)) AS BIGINT)
    AS days FROM closed GROUP BY queue, status""")
def history_time_in_status(spark, sf):
    return H.time_in_status(H.fold_rounds(_rounds(spark, sf), KEYS, "queue"), ["queue"],
                            "2024-03-11")
