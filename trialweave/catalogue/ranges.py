"""Tables compared by hashes of key ranges, and payloads without a schema."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges as G
from ..sources import payloads as P
from . import shapes as S
from .registry import query, table


def _versions(spark, sf):
    """Orders before and after a round: some edited, some removed, some added, some repeated."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(
        S.text("o_orderkey").alias("record_id"), "o_orderstatus", "o_orderpriority", k.alias("k"))
    k = F.col("k")
    before = orders.where(k % 211 != 0)
    after = orders.where(k % 223 != 0).withColumn("o_orderstatus", F.when(
        k % 97 == 0, "edited").when(k % 101 == 0, None).otherwise(F.col("o_orderstatus")))
    twice = after.where(k % 503 == 0)
    return before.drop("k"), after.unionByName(twice).drop("k")


@query("""WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderstatus, o_orderpriority FROM orders
  WHERE o_orderkey % 211 <> 0),
e AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS record_id, CASE WHEN o_orderkey % 97 = 0 THEN 'edited'
    WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders
  WHERE o_orderkey % 223 <> 0),
a AS (SELECT * EXCLUDE (o_orderkey) FROM e UNION ALL SELECT * EXCLUDE (o_orderkey) FROM e WHERE o_orderkey % 503 = 0)
SELECT *, 'before' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
UNION ALL SELECT *, 'after' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def changed_ranges(spark, sf):
    return G.changed_ranges(*_versions(spark, sf), ["record_id"])


def _payloads(spark, sf):
    """Orders as JSON whose keys nobody names beforehand: which keys a row has depends on the row."""
    k, orders = F.col("o_orderkey"), table(spark, sf, "orders")
    some = lambda n, c: F.when(k % n != 0, F.col(c))
    return orders.select(S.text("o_orderkey").alias("record_id"), F.when(k % 89 == 0, "{broken").otherwise(
        F.to_json(F.struct(F.col("o_custkey").alias("person"), some(3, "o_orderstatus").alias("status"),
                           some(5, "o_orderpriority").alias("priority"),
                           F.when(k % 7 == 0, "").alias("remark")))).alias("payload"))


_CELLS_SQL = """cells AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, u.field, u.value FROM orders,
  LATERAL (VALUES ('person', CAST(o_custkey AS VARCHAR)),
    ('status', CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END),
    ('priority', CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END),
    ('remark', CASE WHEN o_orderkey % 7 = 0 THEN '' END)) u(field, value)
  WHERE o_orderkey % 89 <> 0 AND u.value IS NOT NULL)"""


@query(f"WITH {_CELLS_SQL} SELECT * FROM cells WHERE value <> ''")
def eav_discovered(spark, sf):
    return P.cells_of(_payloads(spark, sf), ["record_id"])


@query(f"""WITH {_CELLS_SQL} SELECT field, CASE field WHEN 'person' THEN 'BIGINT' ELSE 'STRING' END AS types,
  count(*) AS records, count(*) FILTER (value <> '') AS filled FROM cells GROUP BY field""")
def json_unknown_columns(spark, sf):
    return P.fields_of(_payloads(spark, sf))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS record_id, '{broken' AS payload FROM orders WHERE o_orderkey % 89 = 0")
def json_unreadable(spark, sf):
    return P.unreadable(_payloads(spark, sf))
