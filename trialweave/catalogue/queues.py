"""Request queues made of ``events`` and ``orders``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import queues as Q
from . import shapes as S
from .registry import query, table


#: Queues as a caller describes them; the lines are fixed formats.
QUEUES = {q.name: q for q in (
    Q.Queue("build", "study_production", (
        "[", Q.Part("study_status", width=14, blank="?"), "] PID ",
        Q.Part("new_project_pid", width=4, right=True, blank="no PID", absent="no PID"), " ",
        Q.Steps(width=4), " — ",
        Q.Part("shortened_study_name", cut=55, instead=Q.Part(
            "project_title", cut=60, absent="(no title)")),
        " — PI: ", Q.Part("pi_surname"))),
    Q.Queue("people", "completed", (
        Q.Part("first_name"), " ", Q.Part("last_name"), " → ", Q.Part("institution"), " (",
        Q.Part("user_role"), ")")),
    Q.Queue("linkage", "completed", (
        "For ", Q.Part("request_for_name"), " — needed by ", Q.Part("needed_by"))),
    Q.Queue("extract", "completed", (
        "For ", Q.Part("request_for_name"), " — ", Q.Part("database_name"), " — needed by ",
        Q.Part("date_needed_by"))),
    Q.Queue("ticket", "completed", (
        Q.Part("first_name"), " ", Q.Part("surname"), ": ",
        Q.Part("issue_summary", cut=60, absent=""))),
)}


def _requests(spark, sf):
    """Events as requests: one queue per type, two markers, a daily snapshot stamp."""
    k = "event_id"
    mark = lambda done: F.when(done, F.when(S.every(k, 2), "Yes").otherwise(" Yes ")).when(
        S.every(k, 5), "No").otherwise("")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.when(kind == "signup", "build")
        .when(kind == "click", "people").when(kind == "view", "extract")
        .when(kind == "purchase", "linkage").otherwise("ticket")
        .alias("queue"),
        S.text(k).alias("record_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        mark(S.every(k, 3)).alias("completed"), mark(S.every(k, 7)).alias("study_production"))


_REQUESTS_SQL = """requests AS (
  SELECT CASE event_type WHEN 'signup' THEN 'build' WHEN 'click' THEN 'people' WHEN 'view' THEN 'extract'
      WHEN 'purchase' THEN 'linkage' ELSE 'ticket' END AS queue,
    CAST(event_id AS VARCHAR) AS record_id, strftime(ts, '%Y-%m-%d') AS day,
    CASE WHEN event_id % CASE event_type WHEN 'signup' THEN 7 ELSE 3 END = 0 THEN 'done'
      ELSE 'open' END AS status FROM events)"""


@query(f"""WITH {_REQUESTS_SQL}
SELECT queue, count(*) AS total, count(*) FILTER (status = 'open') AS open,
  count(*) FILTER (status = 'done') AS done FROM requests GROUP BY queue""")
def queue_counts(spark, sf):
    return Q.queue_counts(Q.with_status(_requests(spark, sf), tuple(QUEUES.values())), ["queue"])


def _snapshots(spark, sf):
    """Two weekly states per request, from its number; some requests are missing from one."""
    now = Q.with_status(_requests(spark, sf), tuple(QUEUES.values()))
    k = F.col("record_id").cast("long")
    before = now.withColumn("status", F.when(k % 6 == 0, "open").when(
        k % 10 == 0, "done").otherwise(F.col("status")))
    # Half of the first month's last days had not been asked yet; one queue could not be read.
    before = before.where(F.col("day") < "2024-01-25")
    now = now.where((F.col("day") >= "2024-01-03") & (F.col("queue") != "extract"))
    keep = ("queue", "record_id", "status")
    return before.select(*keep), now.select(*keep)


_SNAPSHOTS_SQL = _REQUESTS_SQL + """,
before AS (SELECT queue, record_id, CASE WHEN CAST(record_id AS BIGINT) % 6 = 0 THEN 'open'
    WHEN CAST(record_id AS BIGINT) % 10 = 0 THEN 'done' ELSE status END AS b
  FROM requests WHERE day < '2024-01-25' AND queue <> 'extract'),
after AS (SELECT queue, record_id, status AS a FROM requests
  WHERE day >= '2024-01-03' AND queue <> 'extract'),
diff AS (SELECT queue, record_id,
    CASE WHEN a IS NULL THEN 'vanished' WHEN a = 'open' AND b IS NULL THEN 'new_open'
         WHEN a = 'open' AND b = 'done' THEN 'reopened' WHEN a = 'open' THEN 'still_open'
         WHEN b = 'done' THEN 'still_done' ELSE 'newly_done' END AS change,
    coalesce(a = 'done' AND b IS NULL, false) AS unseen_before
  FROM before FULL JOIN after USING (queue, record_id))"""


@query(f"WITH {_SNAPSHOTS_SQL} SELECT * FROM diff")
def queue_diff(spark, sf):
    return Q.queue_diff(*_snapshots(spark, sf))


@query(f"""WITH {_SNAPSHOTS_SQL}
SELECT queue, change, count(*) AS records FROM diff GROUP BY queue, change""")
def queue_diff_counts(spark, sf):
    return Q.queue_diff(*_snapshots(spark, sf)).groupBy("queue", "change").agg(
        F.count(F.lit(1)).alias("records"))


@query("""SELECT event_id, event_type FROM events
WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events
  WHERE strftime(ts, '%Y-%m-%d') < '2024-01-20')""")
def latest_snapshot(spark, sf):
    days = table(spark, sf, "events").select(
        "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("snapshot_ts"))
    return Q.latest_before(days, before="2024-01-20").select("event_id", "event_type")


def _builds(spark, sf):
    """Orders as builds: seven steps, some settled by an answer other than Yes."""
    k = "o_orderkey"
    step = lambda i: F.when(F.col(k) % (i + 2) == 0, "Yes").when(
        F.col(k) % (i + 5) == 1, "Prospective study, not required").when(
        S.every(k, 9), "No").when(S.every(k, 10), "0").otherwise("")
    return table(spark, sf, "orders").select(
        S.text(k).alias("record_id"),
        F.when(S.every(k, 4), "").otherwise(F.col("o_orderstatus")).alias("study_status"),
        F.when(S.every(k, 3), "").otherwise(S.text(F.col("o_custkey"))).alias("new_project_pid"),
        F.when(S.every(k, 2), "").otherwise(F.col("o_orderpriority")).alias("shortened_study_name"),
        F.concat(F.lit("A study of the long-term outcomes of the group called "),
                 "o_orderpriority").alias("project_title"),
        F.lit("Ojo").alias("pi_surname"),
        *[step(i).alias(s) for i, s in enumerate(K.BUILD_STEPS)])


_STEP = ("(CASE WHEN o_orderkey % {a} = 0 THEN 1 ELSE 0 END)",
         "(CASE WHEN o_orderkey % {a} = 0 OR o_orderkey % {b} = 1 THEN 1 ELSE 0 END)")
_BUILDS_SQL = "builds AS (SELECT *, " + ", ".join(
    " + ".join(t.format(a=i + 2, b=i + 5) for i in range(7)) + f" AS {n}"
    for t, n in zip(_STEP, ("strict", "lenient"))) + " FROM orders)"


@query(f"""WITH {_BUILDS_SQL}
SELECT 'strict' AS rule, strict AS steps, count(*) AS records FROM builds GROUP BY strict
UNION ALL SELECT 'lenient', lenient, count(*) FROM builds GROUP BY lenient""")
def progress_hist(spark, sf):
    return Q.progress_histogram(_builds(spark, sf))


@query(f"""WITH {_BUILDS_SQL}
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, '[' || rpad(CASE WHEN o_orderkey % 4 = 0 THEN '?'
    ELSE o_orderstatus END, 14, ' ') || '] PID ' ||
  CASE WHEN o_orderkey % 3 = 0 THEN 'no PID' WHEN length(CAST(o_custkey AS VARCHAR)) >= 4
    THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR), 4, ' ') END ||
  ' ' || lpad(lenient || '/7', 4, ' ') || ' — ' ||
  CASE WHEN o_orderkey % 2 = 0 THEN substr('A study of the long-term outcomes of the group called '
    || o_orderpriority, 1, 55) ELSE o_orderpriority END || ' — PI: Ojo' AS summary FROM builds""")
def queue_summaries(spark, sf):
    builds = _builds(spark, sf)
    return builds.select("record_id", Q.queue_summary(
        QUEUES["build"], builds.columns).alias("summary"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'people' AS queue,
  c_name || ' ' || CAST(c_nationkey AS VARCHAR) || ' → ' || c_mktsegment || ' (?)' AS summary FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'linkage',
  'For ' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || ' — needed by ' || CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'extract',
  'For ' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || ' — ' || c_mktsegment
    || ' — needed by ?' FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'ticket',
  c_name || ' ?: ' || substr('Issue of ' || c_name || ' about the segment ' || c_mktsegment
    || ' and the number ' || CAST(c_nationkey AS VARCHAR), 1, 60) FROM customer""")
def queue_lines(spark, sf):
    """The other four templates, over one table that lacks some of their columns."""
    people = table(spark, sf, "customer").select(
        S.text("c_custkey").alias("record_id"), F.col("c_name").alias("first_name"),
        S.text("c_nationkey").alias("last_name"), F.col("c_mktsegment").alias("institution"),
        F.when(S.every("c_custkey", 3), "").otherwise(F.col("c_name")).alias("request_for_name"),
        S.text("c_nationkey").alias("needed_by"), F.col("c_mktsegment").alias("database_name"),
        F.concat(F.lit("Issue of "), "c_name", F.lit(" about the segment "), "c_mktsegment",
                 F.lit(" and the number "), S.text("c_nationkey")).alias("issue_summary"))
    lines = F.array(*[
        F.struct(F.lit(n).alias("queue"), Q.queue_summary(QUEUES[n], people.columns).alias("summary"))
        for n in ("people", "linkage", "extract", "ticket")])
    return people.select("record_id", F.explode(lines).alias("l")).select("record_id", "l.*")


def _tickets(spark, sf):
    k = "c_custkey"
    return table(spark, sf, "customer").select(
        S.text(k).alias("record_id"),
        F.when(S.every(k, 3), "").otherwise(F.col("c_name")).alias("first_name"),
        F.when(S.every(k, 2), "").otherwise(F.col("c_mktsegment")).alias("category"),
        F.when(S.every(k, 5), "").otherwise(S.text("c_nationkey")).alias("nation"),
        F.when(S.every(k, 7), "").otherwise(S.text(F.floor("c_acctbal"))).alias("amount"),
        F.lit("Yes").alias("completed"), F.lit("2").alias("form_complete"))


_LABELS = {"first_name": "First  name", "category": "Category", "nation": "Nation",
           "amount": "Amount"}
_TICKETS_SQL = """tickets AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS record_id,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS a,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS b,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS c,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS d
FROM customer)"""


@query(f"""WITH {_TICKETS_SQL},
bits AS (SELECT record_id, list_filter([CASE WHEN a <> '' THEN 'First name: ' || a END,
  CASE WHEN b <> '' THEN 'Category: ' || b END, CASE WHEN c <> '' THEN 'Nation: ' || c END,
  CASE WHEN d <> '' THEN 'Amount: ' || d END], lambda x: x IS NOT NULL)[1:3] AS bits FROM tickets)
SELECT record_id, CASE WHEN len(bits) = 0 THEN '(no details filled in)'
  ELSE array_to_string(bits, '; ') END AS summary FROM bits""")
def dictionary_summaries(spark, sf):
    tickets = _tickets(spark, sf)
    fields = [(c, _LABELS.get(c, c)) for c in tickets.columns]
    return tickets.select("record_id", Q.summary_from_fields(fields, "record_id").alias("summary"))


@query(f"""WITH {_TICKETS_SQL}
SELECT record_id, pos, label, value FROM (
  SELECT record_id, 0 AS pos, 'record_id' AS label, record_id AS value FROM tickets
  UNION ALL SELECT record_id, 1, 'First  name', a FROM tickets
  UNION ALL SELECT record_id, 2, 'Category', b FROM tickets
  UNION ALL SELECT record_id, 3, 'Nation', c FROM tickets
  UNION ALL SELECT record_id, 4, 'Amount', d FROM tickets
  UNION ALL SELECT record_id, 5, 'completed', 'Yes' FROM tickets) WHERE value <> ''""")
def record_details(spark, sf):
    return Q.record_detail(_tickets(spark, sf), "record_id", _LABELS)


@query("""SELECT count(*) FILTER (o_custkey BETWEEN 10 AND 108) AS kept,
  count(*) FILTER (o_custkey NOT BETWEEN 10 AND 108) AS skipped FROM orders""")
def id_range(spark, sf):
    return Q.id_range_report(table(spark, sf, "orders"), "o_custkey",
                             *Q.parse_id_range(" 10 - 108 "))
