"""Study-shaped inputs derived from the given tables, in Spark and as SQL.

Blanks, missing codes and disagreements are planted by arithmetic on keys over every row of the
table, so each input grows with its table. The SQL says the same independently.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..operators.worklist import Workbook
from ..plans.dictionary import Dictionary, Field
from .registry import table


def every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


STUDY = Dictionary([
    Field("record_id", "intake", field_label="Record ID"),
    Field("status", "intake", field_type="radio", field_label="Order status:",
          select_choices_or_calculations="F, Filled | O, Open | P, Pending, partly"),
    Field("priority", "intake", field_type="dropdown", field_label="Priority  level?",
          select_choices_or_calculations="1, Urgent | 2, High | 3, Medium | 4, Unspecified | "
                                         "5, Low | -888, Missing in case notes | -999, Other missing"),
    Field("price", "intake", field_label="Total price",
          text_validation_type_or_show_slider_number="number",
          text_validation_min="20000", text_validation_max="450000"),
    Field("order_date", "intake", field_label="Date of order",
          text_validation_type_or_show_slider_number="date_dmy"),
    Field("review", "follow", field_type="radio", field_label="Review outcome",
          select_choices_or_calculations="0, None | 1, Minor | 2, Major | 3, Other",
          branching_logic="[status] = 'F' AND [price] >= 100000"),
    Field("flags", "follow", field_type="checkbox", field_label="Flags raised",
          select_choices_or_calculations="1, Late | 2, Damaged | -999, Other missing"),
    Field("flag_detail", "follow", field_type="notes", field_label="Flag detail",
          branching_logic="[flags(2)] = 1"),
    Field("recheck", "follow", field_type="yesno", field_label="Recheck due",
          branching_logic="datediff([order_date],[price],'d') > 30"),
    Field("lost_reason", "follow", field_type="radio", field_label="Reason lost",
          select_choices_or_calculations="1, Moved | 2, Refused | 3, Died",
          branching_logic="[status] = 'O' OR [priority] <> '1'"),
    Field("mixed", "follow", field_label="Mixed logic",
          branching_logic="[price] < 200000 and hasvalue([x]) or [flags(-999)] = '1'"),
])

WORKBOOKS = [
    Workbook("core", ("status", "priority", "price", "review", "flags"), "Core"),
    Workbook("follow", ("flag_detail", "recheck", "lost_reason", "mixed"), "Follow-up"),
]


def study(spark, sf: str) -> DataFrame:
    """A record export made of ``orders``: every column text, blank is ''."""
    k = "o_orderkey"
    bit = lambda cond: F.when(cond, "1").otherwise("0")
    return table(spark, sf, "orders").select(
        text(k).alias("record_id"),
        F.when(every("o_custkey", 9), "").otherwise(F.substring("o_orderpriority", 3, 20))
        .alias(K.SITE_FIELD),
        F.when(every(k, 11), "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(every(k, 17), "-999").when(every(k, 23), "")
        .otherwise(F.substring("o_orderpriority", 1, 1)).alias("priority"),
        F.when(every(k, 13), "").when(every(k, 29), "unknown")
        .otherwise(text(F.floor("o_totalprice"))).alias("price"),
        F.when(every(k, 19), "").when(every(k, 31), "8888-08-08")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(every(k, 3), text(F.col(k) % 4)).when(every(k, 37), "-888").otherwise("")
        .alias("review"),
        bit(~every(k, 2)).alias("flags___1"), bit(every(k, 5)).alias("flags___2"),
        bit(every(k, 41)).alias("flags____999"),
        F.when(every(k, 7), "seen").otherwise("").alias("flag_detail"),
        F.when(every(k, 4), "1").otherwise("").alias("recheck"),
        F.when(every(k, 6), "2").when(every(k, 43), "-777").otherwise("").alias("lost_reason"),
        F.when(every(k, 8), "x").otherwise("").alias("mixed"))


STUDY_SQL = """study AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderkey AS k,
    CASE WHEN o_custkey % 9 = 0 THEN '' ELSE substr(o_orderpriority, 3) END AS site_raw,
    CASE WHEN o_custkey % 9 = 0 THEN 'unassigned' ELSE substr(o_orderpriority, 3) END AS site,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 17 = 0 THEN '-999' WHEN o_orderkey % 23 = 0 THEN ''
         ELSE substr(o_orderpriority, 1, 1) END AS priority,
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN 'unknown'
         ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
    CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 31 = 0 THEN '8888-08-08'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS VARCHAR)
         WHEN o_orderkey % 37 = 0 THEN '-888' ELSE '' END AS review,
    CASE WHEN o_orderkey % 2 = 1 THEN '1' ELSE '0' END AS flags___1,
    CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '0' END AS flags___2,
    CASE WHEN o_orderkey % 41 = 0 THEN '1' ELSE '0' END AS flags____999,
    CASE WHEN o_orderkey % 7 = 0 THEN 'seen' ELSE '' END AS flag_detail,
    CASE WHEN o_orderkey % 4 = 0 THEN '1' ELSE '' END AS recheck,
    CASE WHEN o_orderkey % 6 = 0 THEN '2' WHEN o_orderkey % 43 = 0 THEN '-777' ELSE '' END
      AS lost_reason,
    CASE WHEN o_orderkey % 8 = 0 THEN 'x' ELSE '' END AS mixed
  FROM orders)"""

# The worklist cells of the study, every condition written out.
CELLS_SQL = STUDY_SQL + """,
flagvalue AS (
  SELECT *, concat_ws(',', CASE WHEN flags___1 = '1' THEN '1' END,
                           CASE WHEN flags___2 = '1' THEN '2' END,
                           CASE WHEN flags____999 = '1' THEN '-999' END) AS flags,
         TRY_CAST(price AS DOUBLE) AS price_n
  FROM study),
asked AS (
  SELECT record_id, site, 'core' AS workbook, 'status' AS field, status AS value,
         'yes' AS applies FROM flagvalue
  UNION ALL SELECT record_id, site, 'core', 'priority', priority, 'yes' FROM flagvalue
  UNION ALL SELECT record_id, site, 'core', 'price', price, 'yes' FROM flagvalue
  UNION ALL SELECT record_id, site, 'core', 'review', review,
    CASE WHEN status <> 'F' OR price = '' THEN 'no' WHEN price_n >= 100000 THEN 'yes'
         WHEN price_n IS NULL THEN 'perhaps' ELSE 'no' END FROM flagvalue
  UNION ALL SELECT record_id, site, 'core', 'flags', flags, 'yes' FROM flagvalue
  UNION ALL SELECT record_id, site, 'follow', 'flag_detail', flag_detail,
    CASE WHEN flags___2 = '1' THEN 'yes' ELSE 'no' END FROM flagvalue
  UNION ALL SELECT record_id, site, 'follow', 'recheck', recheck, 'perhaps' FROM flagvalue
  UNION ALL SELECT record_id, site, 'follow', 'lost_reason', lost_reason,
    CASE WHEN status = 'O' OR priority <> '1' THEN 'yes' ELSE 'no' END FROM flagvalue
  UNION ALL SELECT record_id, site, 'follow', 'mixed', mixed,
    CASE WHEN flags____999 = '1' THEN 'yes' WHEN price = '' THEN 'no'
         WHEN price_n IS NULL OR price_n < 200000 THEN 'perhaps' ELSE 'no' END FROM flagvalue),
flagged AS (
  SELECT record_id, site, workbook, field, value,
    CASE WHEN value = '' THEN 'blank' ELSE 'sentinel' END AS reason,
    CASE WHEN applies = 'yes' THEN 'gap' ELSE 'uncertain' END AS flag
  FROM asked
  WHERE applies <> 'no' AND value IN ('', '666', '-666', '-777', '-888', '-999')),
cells AS (
  SELECT record_id, site, 'with_MDC' AS mode, workbook, field, value, reason, flag FROM flagged
  UNION ALL
  SELECT record_id, site, 'no_MDC', workbook, field, value, reason, flag FROM flagged
  WHERE reason = 'blank')"""


def computed(spark, sf: str) -> DataFrame:
    """What a linkage says the cells should be: some differ, some ids do not exist yet."""
    k = "o_orderkey"
    return table(spark, sf, "orders").select(
        text(F.when(every(k, 97), F.col(k) + 10000000).otherwise(F.col(k))).alias("record_id"),
        F.lit("elsewhere").alias(K.SITE_FIELD),
        F.when(every(k, 14), "X").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(every(k, 21), "").otherwise(
            F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".0"))).alias("priority"),
        F.concat(F.lit(" 0"), text(F.floor("o_totalprice"))).alias("price"))


DIFF_SQL = STUDY_SQL + """,
computed AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN CAST(o_orderkey + 10000000 AS VARCHAR)
              ELSE CAST(o_orderkey AS VARCHAR) END AS record_id,
    CASE WHEN o_orderkey % 14 = 0 THEN 'X' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 21 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END AS priority,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price
  FROM orders),
pairs AS (
  SELECT c.record_id, s.record_id IS NULL AS orphan, f.field,
    CASE f.field WHEN 'status' THEN c.status WHEN 'priority' THEN c.priority
                 ELSE c.price END AS computed,
    coalesce(CASE f.field WHEN 'status' THEN s.status WHEN 'priority' THEN s.priority
                 ELSE s.price END, '') AS existing
  FROM computed c LEFT JOIN study s USING (record_id)
  CROSS JOIN (VALUES ('status'), ('priority'), ('price')) AS f(field)),
verdicts AS (
  SELECT record_id, field, existing, computed,
    CASE WHEN orphan THEN 'orphan' WHEN existing = computed OR computed = '' THEN 'noop'
         WHEN existing = '' THEN 'fill' ELSE 'conflict' END AS verdict
  FROM pairs)"""
