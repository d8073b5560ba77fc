"""Completeness worklists over the study made of ``orders``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import worklist as W
from . import shapes as S
from .registry import query


def _cells(spark, sf):
    return W.worklist_cells(S.study(spark, sf), S.STUDY, S.WORKBOOKS)


@query(f"WITH {S.CELLS_SQL} SELECT * FROM cells")
def worklist_cells(spark, sf):
    return _cells(spark, sf)


@query(f"""WITH {S.CELLS_SQL}
SELECT workbook, site, mode, count(DISTINCT record_id) AS rows_with_work,
       count(*) FILTER (flag = 'gap') AS gap_cells,
       count(*) FILTER (flag = 'uncertain') AS uncertain_cells
FROM cells GROUP BY ALL""")
def worklist_counts(spark, sf):
    return W.worklist_counts(S.study(spark, sf), S.STUDY, S.WORKBOOKS)


@query(f"""WITH {S.CELLS_SQL}
SELECT workbook, site, mode, field, count(*) FILTER (flag = 'gap') AS gap_cells,
       count(*) FILTER (flag = 'uncertain') AS uncertain_cells
FROM cells GROUP BY ALL""")
def worklist_field_counts(spark, sf):
    return W.field_counts(_cells(spark, sf))


@query(f"""WITH {S.CELLS_SQL},
gates(field, gate) AS (VALUES ('review', 'status'), ('review', 'price'), ('flag_detail', 'flags'),
  ('lost_reason', 'status'), ('lost_reason', 'priority'), ('mixed', 'price'), ('mixed', 'flags')),
shown AS (SELECT DISTINCT workbook, site, mode, field FROM cells)
SELECT workbook, site, mode, field, 'flagged' AS role FROM shown
UNION ALL
SELECT DISTINCT workbook, site, mode, gate, 'gate' FROM shown JOIN gates USING (field)
WHERE NOT EXISTS (SELECT 1 FROM shown o WHERE o.workbook = shown.workbook
  AND o.site = shown.site AND o.mode = shown.mode AND o.field = gate)""")
def worklist_gates(spark, sf):
    return W.display_fields(_cells(spark, sf), S.STUDY)


@query(f"""WITH {S.CELLS_SQL}
SELECT record_id, site,
  CASE WHEN priority = '1' THEN 'Urgent' WHEN priority = '2' THEN 'High'
       WHEN priority = '3' THEN 'Medium' WHEN priority = '4' THEN 'Unspecified'
       WHEN priority = '5' THEN 'Low' WHEN priority = '-999' THEN 'Other missing'
       ELSE priority END AS "Priority level",
  CASE status WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending, partly'
       ELSE status END AS "Order status",
  CASE WHEN lost_reason = '2' THEN 'Refused' ELSE lost_reason END AS "Reason lost",
  (SELECT c.flag FROM cells c WHERE c.record_id = study.record_id AND c.mode = 'with_MDC'
     AND c.field = 'lost_reason') AS reason_flag,
  '' AS "RESPONSE"
FROM study WHERE record_id IN
  (SELECT record_id FROM cells WHERE mode = 'with_MDC' AND field = 'lost_reason')""")
def worklist_sheet(spark, sf):
    sheet = W.worklist_sheet(S.study(spark, sf), S.STUDY,
                             W.Workbook("lost", ("lost_reason",)), W.WITH_CODES)
    return sheet.withColumn("reason_flag", sheet["flags"]["lost_reason"]).drop("flags")


def _second_round(spark, sf):
    """The study after some answers came in and some were lost."""
    k = F.col("record_id").cast("long")
    return S.study(spark, sf).withColumn(
        "status", F.when(k % 22 == 0, "O").otherwise(F.col("status"))).withColumn(
        "lost_reason", F.when(k % 10 == 0, "").otherwise(F.col("lost_reason")))


@query(f"""WITH {S.CELLS_SQL},
second AS (SELECT * REPLACE (
    CASE WHEN k % 22 = 0 THEN 'O' ELSE status END AS status,
    CASE WHEN k % 10 = 0 THEN '' ELSE lost_reason END AS lost_reason) FROM study),
asked2 AS (
  SELECT record_id, site, 'status' AS field, status AS value, true AS applies FROM second
  UNION ALL SELECT record_id, site, 'lost_reason', lost_reason, status = 'O' OR priority <> '1'
  FROM second),
before AS (SELECT record_id, site, mode, field FROM cells
  WHERE field IN ('status', 'lost_reason')),
flagged2 AS (SELECT * FROM asked2
  WHERE applies AND value IN ('', '666', '-666', '-777', '-888', '-999')),
after AS (SELECT record_id, site, 'with_MDC' AS mode, field FROM flagged2
  UNION ALL SELECT record_id, site, 'no_MDC', field FROM flagged2 WHERE value = '')
SELECT record_id, site, 'two' AS workbook, mode, field,
  CASE WHEN a.one IS NULL THEN 'closed' WHEN b.one IS NULL THEN 'new'
       ELSE 'still_open' END AS status
FROM (SELECT *, 1 AS one FROM before) b
FULL JOIN (SELECT *, 1 AS one FROM after) a USING (record_id, site, mode, field)""")
def round_diff(spark, sf):
    books = [W.Workbook("two", ("status", "lost_reason"))]
    build = lambda df: W.worklist_cells(df, S.STUDY, books)
    return W.round_diff(build(S.study(spark, sf)), build(_second_round(spark, sf)), ["record_id"])


@query(f"""WITH {S.CELLS_SQL}
SELECT field, count(*) AS cells,
  CASE field WHEN 'review' THEN '[status] = ''F'' AND [price] >= 100000'
    WHEN 'recheck' THEN 'datediff([order_date],[price],''d'') > 30'
    ELSE '[price] < 200000 and hasvalue([x]) or [flags(-999)] = ''1''' END AS logic
FROM cells WHERE flag = 'uncertain' AND mode = 'with_MDC' GROUP BY field""")
def worklist_uncertain_logic(spark, sf):
    return W.uncertain_logic(_cells(spark, sf), S.STUDY)


@query(f"""WITH {S.CELLS_SQL},
wanted AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS record_id FROM lineitem
           WHERE l_returnflag = 'R')
SELECT workbook, site, mode, count(DISTINCT record_id) AS rows_with_work,
       count(*) FILTER (flag = 'gap') AS gap_cells,
       count(*) FILTER (flag = 'uncertain') AS uncertain_cells
FROM cells SEMI JOIN wanted USING (record_id) GROUP BY ALL""")
def worklist_scoped(spark, sf):
    """Only the records a scope list names; here, orders with a returned line."""
    ids = S.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey")
    return W.worklist_counts(W.scope(S.study(spark, sf), ids, "record_id"), S.STUDY, S.WORKBOOKS)


@query(f"""WITH {S.STUDY_SQL}
SELECT site AS {K.SITE_FIELD}, count(*) AS records FROM study GROUP BY site""")
def site_default(spark, sf):
    return W.with_site(S.study(spark, sf)).groupBy(K.SITE_FIELD).agg(
        F.count(F.lit(1)).alias("records"))
