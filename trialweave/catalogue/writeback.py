"""Diff-only write-back of a linkage result into the study."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators.ordering import first_per_key, last_per_key
from ..sources import readers as R
from . import shapes as S
from .registry import query, table


def _diff(spark, sf):
    return D.CellDiff(S.computed(spark, sf), S.study(spark, sf), "record_id", unique=True)


@query(f"WITH {S.DIFF_SQL} SELECT field, verdict, count(*) AS cells FROM verdicts GROUP BY ALL")
def cell_diff_verdicts(spark, sf):
    return _diff(spark, sf).counts()


@query(f"""WITH {S.DIFF_SQL}
SELECT record_id, field, existing, computed FROM verdicts WHERE verdict = 'conflict'""")
def cell_diff_conflicts(spark, sf):
    return _diff(spark, sf).conflicts()


_WIDE = """WITH {body}
SELECT record_id,
  coalesce(max(CASE WHEN field = 'status' THEN computed END), '') AS status,
  coalesce(max(CASE WHEN field = 'priority' THEN computed END), '') AS priority,
  coalesce(max(CASE WHEN field = 'price' THEN computed END), '') AS price
FROM verdicts WHERE verdict = '{verdict}' GROUP BY record_id"""


@query(_WIDE.format(body=S.DIFF_SQL, verdict="fill"))
def cell_diff_updates(spark, sf):
    return _diff(spark, sf).updates()


@query(_WIDE.format(body=S.DIFF_SQL, verdict="conflict"))
def cell_diff_overwrites(spark, sf):
    return _diff(spark, sf).overwrites()


@query(_WIDE.format(body=S.DIFF_SQL, verdict="orphan"))
def cell_diff_orphans(spark, sf):
    return _diff(spark, sf).orphans()


@query(f"""WITH {S.DIFF_SQL} SELECT record_id FROM study ANTI JOIN computed USING (record_id)""")
def cell_diff_gaps(spark, sf):
    return _diff(spark, sf).gaps()


@query(f"""WITH {S.DIFF_SQL}
SELECT count(DISTINCT record_id) FILTER (verdict = 'fill') AS update_records,
  count(DISTINCT record_id) FILTER (verdict = 'conflict') AS overwrite_records,
  count(DISTINCT record_id) FILTER (verdict = 'orphan') AS orphan_records,
  (SELECT count(*) FROM study ANTI JOIN computed USING (record_id)) AS gap_records
FROM verdicts""")
def cell_diff_records(spark, sf):
    return _diff(spark, sf).record_counts()


_LIVE = """WITH {body},
planned AS (SELECT record_id, field, value FROM (
    SELECT record_id, CASE WHEN k % 14 = 0 THEN '0' ELSE status END AS status,
           CASE WHEN k % 15 = 0 THEN '3' ELSE priority END AS priority FROM study)
  UNPIVOT (value FOR field IN (status, priority))),
live AS (SELECT record_id, field, value AS live FROM (SELECT record_id, status, priority FROM study)
  UNPIVOT (value FOR field IN (status, priority)))
SELECT record_id, field, value AS planned, live,
  CASE WHEN live = value THEN 'already_current' WHEN {differs} THEN 'conflict'
       ELSE 'keep' END AS outcome
FROM planned JOIN live USING (record_id, field) WHERE value <> ''"""


def _planned(spark, sf):
    k = F.col("record_id").cast("long")
    return S.study(spark, sf).select(
        "record_id", F.when(k % 14 == 0, "0").otherwise(F.col("status")).alias("status"),
        F.when(k % 15 == 0, "3").otherwise(F.col("priority")).alias("priority"))


@query(_LIVE.format(body=S.STUDY_SQL, differs="live <> ''"))
def verify_live(spark, sf):
    return D.verify_live(_planned(spark, sf), S.study(spark, sf), "record_id", unique=True)


@query(_LIVE.format(body=S.STUDY_SQL, differs="live <> '' AND value <> '0'"))
def verify_live_reference(spark, sf):
    return D.verify_live(_planned(spark, sf), S.study(spark, sf), "record_id", "reference",
                         unique=True)


_LINES = """lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS record_id, l_returnflag AS status,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS price,
    CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS status_now,
    CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END
      AS price_now,
    l_linenumber * 10000000000 + l_partkey AS seq, l_suppkey * 10000000000 + l_partkey AS seq_now
  FROM lineitem),
new AS (SELECT record_id, status, price FROM lines QUALIFY row_number() OVER (
  PARTITION BY record_id ORDER BY seq DESC, status DESC, price DESC) = 1),
old AS (SELECT record_id, status_now AS status, price_now AS price FROM lines QUALIFY row_number()
  OVER (PARTITION BY record_id ORDER BY seq_now DESC, status_now DESC, price_now DESC) = 1),
cells AS (SELECT record_id, 'status' AS field, new.status AS n, old.status AS o
  FROM new JOIN old USING (record_id)
  UNION ALL SELECT record_id, 'price', new.price, old.price FROM new JOIN old USING (record_id))"""


def _lines(spark, sf):
    """Order lines as two tables in which record ids repeat, each with its own input order."""
    lines = table(spark, sf, "lineitem")
    price = S.text(F.col("l_quantity").cast("int"))
    key, line = S.text("l_orderkey").alias("record_id"), F.col("l_linenumber")
    order = lambda c: (F.col(c).cast("long") * 10**10 + F.col("l_partkey")).alias("seq")
    new = lines.select(key, F.col("l_returnflag").alias("status"), price.alias("price"),
                       order("l_linenumber"))
    old = lines.select(key, F.when(line % 3 == 0, "").otherwise(F.col("l_linestatus")).alias("status"),
                       F.when(line % 2 == 0, "").otherwise(price).alias("price"),
                       order("l_suppkey"))
    return new, old


@query(f"""WITH {_LINES} SELECT field, CASE WHEN o = n OR n = '' THEN 'noop' WHEN o = '' THEN 'fill'
  ELSE 'conflict' END AS verdict, count(*) AS cells FROM cells GROUP BY ALL""")
def cell_diff_repeats(spark, sf):
    """Of rows with one id the last of each table counts."""
    return D.CellDiff(*_lines(spark, sf), "record_id", seq="seq").counts()


@query(f"""WITH {_LINES} SELECT field, CASE WHEN o = n THEN 'already_current' WHEN o <> '' THEN 'conflict'
  ELSE 'keep' END AS outcome, count(*) AS cells FROM cells WHERE n <> '' GROUP BY ALL""")
def verify_live_repeats(spark, sf):
    """One plan for each record against live rows whose ids repeat."""
    new, old = _lines(spark, sf)
    planned = last_per_key(new, ["record_id"], ["seq"]).drop("seq")
    return D.verify_live(planned, old, "record_id", seq="seq").groupBy("field", "outcome").agg(
        F.count(F.lit(1)).alias("cells"))


@query("""SELECT o_orderkey, o_orderstatus AS old, CASE WHEN o_totalprice > 200000 THEN 'F'
  ELSE o_orderstatus END AS new FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'""")
def changed_values(spark, sf):
    pairs = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("old"),
        F.when(F.col("o_totalprice") > 200000, "F").otherwise(F.col("o_orderstatus")).alias("new"))
    return D.changed_values(pairs)


@query("""WITH h AS (
  SELECT md5(concat_ws(chr(30), concat_ws(chr(31), 'p_brand', p_brand),
    concat_ws(chr(31), 'p_name', p_name), concat_ws(chr(31), 'p_partkey', CAST(p_partkey AS VARCHAR)),
    concat_ws(chr(31), 'p_size', CAST(p_size AS VARCHAR)))) AS d FROM part),
n AS (SELECT CAST('0x' || substr(d, 1, 15) AS BIGINT) AS a,
             CAST('0x' || substr(d, 17, 15) AS BIGINT) AS b FROM h),
f AS (SELECT count(*) AS n, bit_xor(a) AS xa, bit_xor(b) AS xb, sum(CAST(a AS HUGEINT)) AS sa,
             sum(CAST(b AS HUGEINT)) AS sb FROM n)
SELECT n AS rows, substr(md5(concat_ws('|', 'parts', CAST(n AS VARCHAR), CAST(xa AS VARCHAR),
  CAST(xb AS VARCHAR), CAST(sa AS VARCHAR), CAST(sb AS VARCHAR))), 1, 16) AS code FROM f""")
def fingerprint(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return D.fingerprint(part, "parts")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS record_id,
  CAST(max(l_partkey * 100 + l_linenumber) AS BIGINT) AS seq,
  arg_max(l_returnflag, l_partkey * 100 + l_linenumber) AS flag FROM
  (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber,
     max(l_returnflag) OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber) AS l_returnflag
   FROM lineitem) GROUP BY l_orderkey""")
def last_wins(spark, sf):
    """A keyed file in which most ids occur several times."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit(" "), S.text("l_orderkey")).alias("record_id"),
        (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.col("l_returnflag").alias("flag"))
    return R.keyed(lines, "record_id", "seq")


@query("""SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem
  GROUP BY l_suppkey""")
def first_label(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return first_per_key(lines, ["l_suppkey"], ["pos"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_name AS name, c_mktsegment AS segment,
  '' AS account FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '',
  CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) FROM supplier""")
def payload_union(spark, sf):
    customers = table(spark, sf, "customer").select(
        S.text("c_custkey").alias("record_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf, "supplier").select(
        S.text(F.floor("s_acctbal")).alias("account"), S.text("s_suppkey").alias("record_id"),
        F.col("s_name").alias("name"))
    return R.union_payloads([customers, suppliers])
