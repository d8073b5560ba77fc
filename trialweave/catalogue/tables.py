"""Descriptive tables and exports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import stats as T
from ..plans.dictionary import Dictionary, Field
from ..sources import export as E
from . import shapes as S
from .registry import query, table

CLIENTS = Dictionary([
    Field("client_id", "base", field_label="Client"),
    Field("balance", "base", field_label="Balance",
          text_validation_type_or_show_slider_number="number"),
    Field("region", "base", field_type="radio", field_label="Region",
          select_choices_or_calculations="0, North | 1, East | 2, South | 3, West | 9, Nowhere | "
                                         "-999, Other missing"),
    Field("member", "base", field_type="yesno", field_label="Member"),
])


def _clients(spark, sf):
    """Customers as records: blanks, missing codes and a region code the dictionary lacks."""
    k = "c_custkey"
    return table(spark, sf, "customer").select(
        S.text(k).alias("client_id"),
        F.when(S.every(k, 9), "").otherwise(F.col("c_mktsegment")).alias(K.SITE_FIELD),
        F.when(S.every(k, 8), "").when(S.every(k, 12), "-888").when(S.every(k, 31), "n.d.")
        .otherwise(S.text(F.floor("c_acctbal"))).alias("balance"),
        F.when(S.every(k, 10), "-999").when(S.every(k, 13), "").otherwise(
            S.text(F.col("c_nationkey") % 5)).alias("region"),
        F.when(S.every(k, 6), "666").otherwise(S.text(F.col(k) % 2)).alias("member"))


_CLIENTS_SQL = """clients AS (
  SELECT CAST(c_custkey AS VARCHAR) AS client_id,
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END AS site,
    CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 12 = 0 THEN '-888'
         WHEN c_custkey % 31 = 0 THEN 'n.d.'
         ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS balance,
    CASE WHEN c_custkey % 10 = 0 THEN '-999' WHEN c_custkey % 13 = 0 THEN ''
         ELSE CAST(c_nationkey % 5 AS VARCHAR) END AS region,
    CASE WHEN c_custkey % 6 = 0 THEN '666' ELSE CAST(c_custkey % 2 AS VARCHAR) END AS member
  FROM customer),
clean AS (
  SELECT site, CASE WHEN balance NOT IN ('', '-888') THEN TRY_CAST(balance AS DOUBLE) END AS x,
    CASE WHEN region NOT IN ('', '-999') THEN region END AS r,
    CASE WHEN member <> '666' THEN member END AS m FROM clients),
grouped AS (
  SELECT CASE WHEN grouping(site) = 1 THEN 'overall' ELSE site END AS "column", grouping(site) AS a,
    count(*) AS n, count(x) AS xn, avg(x) AS mean, stddev_samp(x) AS sd, count(r) AS rn,
    count(*) FILTER (r = '0') AS r0, count(*) FILTER (r = '1') AS r1,
    count(*) FILTER (r = '2') AS r2, count(*) FILTER (r = '3') AS r3,
    count(*) FILTER (r = '9') AS r9, count(m) AS mn, count(*) FILTER (m = '0') AS m0,
    count(*) FILTER (m = '1') AS m1
  FROM clean GROUP BY GROUPING SETS ((site), ())),
sited AS (SELECT * FROM grouped WHERE a = 1 OR "column" <> ''),
lines AS (
  SELECT 'records' AS variable, '' AS level, 'n' AS statistic, "column", n::DOUBLE AS value FROM sited
  UNION ALL SELECT 'balance', '', 'n', "column", xn FROM sited
  UNION ALL SELECT 'balance', '', 'missing', "column", n - xn FROM sited
  UNION ALL SELECT 'balance', '', 'mean', "column", mean FROM sited
  UNION ALL SELECT 'balance', '', 'sd', "column", sd FROM sited""" + "".join(f"""
  UNION ALL SELECT '{v}', '{label}', 'n', "column", {c} FROM sited
  UNION ALL SELECT '{v}', '{label}', 'pct', "column", 100.0::DOUBLE * {c} / nullif({n}, 0) FROM sited"""
    for v, n, levels in (
        ("region", "rn", (("r0", "North"), ("r1", "East"), ("r2", "South"), ("r3", "West"),
                          ("r9", "Nowhere"))),
        ("member", "mn", (("m0", "No"), ("m1", "Yes")))) for c, label in levels) + """
  UNION ALL SELECT 'region', '', 'missing', "column", n - rn FROM sited
  UNION ALL SELECT 'member', '', 'missing', "column", n - mn FROM sited)"""


def _table1(spark, sf):
    return T.table1(_clients(spark, sf), CLIENTS, ["balance"], ["region", "member"])


@query(f"""WITH {_CLIENTS_SQL}
SELECT variable, level, statistic, "column", round(value, 6) AS value FROM lines""")
def table1_by_site(spark, sf):
    return _table1(spark, sf).select("variable", "level", "statistic", "column",
                                     F.round("value", 6).alias("value"))


@query(f"""WITH {_CLIENTS_SQL}
SELECT variable, level, statistic, round(max(value) FILTER ("column" = 'overall'), 6) AS overall,
  round(max(value) FILTER ("column" = 'AUTOMOBILE'), 6) AS automobile FROM lines
GROUP BY variable, level, statistic""")
def table1_sheet(spark, sf):
    wide = T.table1_wide(_table1(spark, sf))
    return wide.select("variable", "level", "statistic", F.round("overall", 6).alias("overall"),
                       F.round("AUTOMOBILE", 6).alias("automobile"))


@query(f"""WITH {S.STUDY_SQL},
long AS (UNPIVOT (SELECT site_raw AS {K.SITE_FIELD}, status, priority, price, order_date, review,
    flags___1, flags___2, flags____999, flag_detail, recheck, lost_reason, mixed, record_id FROM study)
  ON * INTO NAME field VALUE value)
SELECT field, count(*) FILTER (trim(value) IN ('', '666', '-666', '-777', '-888', '-999')) AS missing,
  count(*) AS records, round(count(*) FILTER (trim(value) IN
    ('', '666', '-666', '-777', '-888', '-999')) / count(*), 6) AS rate
FROM long GROUP BY field ORDER BY rate DESC, field LIMIT 15""")
def missingness_profile(spark, sf):
    """Every column of the study; a report of the fifteen worst."""
    return T.most_missing(T.missingness(S.study(spark, sf))).withColumn("rate", F.round("rate", 6))


@query("""WITH d AS (SELECT text, lang, source, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'text' AS field, count(*) FILTER (trim(text) = '') AS missing, count(*) AS records FROM d
UNION ALL SELECT 'lang', count(*) FILTER (trim(lang) = ''), count(*) FROM d
UNION ALL SELECT 'source', count(*) FILTER (trim(source) = ''), count(*) FROM d
UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), count(*) FROM d""")
def missing_labels(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return T.missingness(docs, ["text", "lang", "source", "quality"]).drop("rate")


def _nation_dictionary(spark, sf):
    """Nations as fields: regions are forms, some have choices."""
    region = F.col("n_regionkey")
    return Dictionary.from_frame(table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("pos"), F.concat(F.lit("f"), S.text("n_nationkey")).alias("field_name"),
        F.concat(F.lit("form"), S.text("n_regionkey")).alias("form_name"),
        F.when(region == 1, "radio").when(region == 2, "checkbox").otherwise("text").alias("field_type"),
        F.when(S.every("n_nationkey", 3), "").otherwise("1, Yes | 0, No")
        .alias("select_choices_or_calculations")))


@query("""SELECT (SELECT count(*) FROM customer) AS records,
  (SELECT count(*) FROM (DESCRIBE customer)) AS fields,
  (SELECT 'f' || min(n_nationkey) FROM nation) AS id_field,
  (SELECT count(*) FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey % 3 <> 0) AS coded_fields""")
def dataset_shape(spark, sf):
    return T.dataset_shape(table(spark, sf, "customer"), _nation_dictionary(spark, sf))


@query("""SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM nation) AS fields,
  (SELECT count(DISTINCT n_regionkey) FROM nation) AS forms""")
def overview(spark, sf):
    return E.overview(table(spark, sf, "orders"), _nation_dictionary(spark, sf))


_PRICES_SQL = S.STUDY_SQL + """,
p AS (SELECT status, priority, TRY_CAST(price AS DOUBLE) AS x FROM study),
q AS (SELECT * FROM p WHERE x IS NOT NULL)"""


@query(f"""WITH {_PRICES_SQL}
SELECT priority AS "group", count(*) AS n, round(quantile_cont(x, 0.25), 6) AS q1,
  round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3
FROM q GROUP BY priority""")
def group_quartiles(spark, sf):
    out = T.quartiles(S.study(spark, sf), "priority", "price")
    return out.select("group", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query(f"""WITH {_PRICES_SQL},
two AS (SELECT * FROM q WHERE status IN ('F', 'O')),
v AS (SELECT x, count(*) AS t, count(*) FILTER (status = 'F') AS t1 FROM two GROUP BY x),
r AS (SELECT *, sum(t) OVER (ORDER BY x) - (t - 1) / 2.0 AS rank FROM v),
s AS (SELECT sum(t1 * rank) AS r1, sum(t1)::DOUBLE AS n1, sum(t)::DOUBLE - sum(t1)::DOUBLE AS n2,
        sum(t::DOUBLE * t * t - t) AS ties FROM r)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(r1 - n1 * (n1 + 1) / 2, 3) AS u1,
  round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2)
    / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s""")
def mann_whitney(spark, sf):
    out = T.mann_whitney(S.study(spark, sf), "status", "price", "F", "O")
    return out.select("n1", "n2", F.round("u1", 3).alias("u1"), F.round("z", 6).alias("z"))


_TWO_WAY = S.STUDY_SQL + """,
t AS (SELECT status AS r, priority AS c FROM study WHERE status <> '' AND
  priority NOT IN ('', '-999'))"""


@query(f"""WITH {_TWO_WAY},
o AS (SELECT r, c, count(*) AS o FROM t GROUP BY ALL),
full_table AS (SELECT r, c, coalesce(o, 0) AS o,
    (SELECT count(*) FROM t x WHERE x.r = a.r) * (SELECT count(*) FROM t x WHERE x.c = b.c)
      / (SELECT count(*) FROM t)::DOUBLE AS e
  FROM (SELECT DISTINCT r FROM t) a CROSS JOIN (SELECT DISTINCT c FROM t) b
  LEFT JOIN o USING (r, c))
SELECT sum(o)::BIGINT AS n, round(sum((o - e) * (o - e) / e), 6) AS chi2,
  (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM full_table""")
def chi_square(spark, sf):
    out = T.chi_square(S.study(spark, sf), "status", "priority")
    return out.withColumn("chi2", F.round("chi2", 6))


@query(f"""WITH {_TWO_WAY}
SELECT r AS "group", c AS level, count(*) AS n,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY r), 6) AS pct
FROM t GROUP BY r, c""")
def counts_and_shares(spark, sf):
    filled = S.study(spark, sf).where(F.col("status") != "")
    out = T.counts_and_shares(filled, "status", "priority")
    return out.withColumn("pct", F.round("pct", 6))


def _drug_dictionary(spark, sf):
    """One dictionary row per part; brands stand for projects and part types for forms."""
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("pos"),
        F.col("p_type").alias("form_name"), F.col("p_name").alias("field_label"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("field_name"))


@query("""SELECT p_brand AS project_id, p_type AS form_name, min(p_partkey) AS first_pos,
  count(*) AS fields FROM part GROUP BY p_brand, p_type""")
def form_list(spark, sf):
    return T.form_list(_drug_dictionary(spark, sf), ["project_id"])


@query("""WITH a AS (SELECT DISTINCT p_name AS f FROM part WHERE p_brand = 'Brand#1'),
b AS (SELECT DISTINCT p_name AS f FROM part WHERE p_brand = 'Brand#2')
SELECT coalesce(a.f, b.f) AS form_name, CASE WHEN b.f IS NULL THEN 'left' ELSE 'right' END
  AS only_in FROM a FULL JOIN b ON a.f = b.f WHERE a.f IS NULL OR b.f IS NULL""")
def form_differences(spark, sf):
    """Two sister projects, a form for each name of a part."""
    part = table(spark, sf, "part").select(
        F.col("p_brand").alias("b"), F.col("p_name").alias("form_name"))
    return T.form_differences(part.where(F.col("b") == "Brand#1"),
                              part.where(F.col("b") == "Brand#2"))


@query("""WITH a AS (SELECT p_brand AS project_id, p_type AS form_name, p_name AS field_label,
    replace(p_name, ' ', '_') AS field_name FROM part),
b AS (SELECT project_id, form_name, CASE WHEN p_size = 5 THEN field_label || '?' ELSE field_label END
    AS field_label, field_name FROM (SELECT p_brand AS project_id, p_type AS form_name,
    p_name AS field_label, replace(p_name, ' ', '_') AS field_name, p_size FROM part))
SELECT *, 'local' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'remote' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def dictionary_changes(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), "p_size")
    local = _drug_dictionary(spark, sf)
    remote = local.join(part, "pos").withColumn("field_label", F.when(
        F.col("p_size") == 5, F.concat("field_label", F.lit("?"))).otherwise(
        F.col("field_label"))).drop("p_size")
    return E.dictionary_changes(local, remote)


@query(f"""WITH {S.STUDY_SQL}
SELECT record_id, priority, status FROM study""")
def eav_roundtrip(spark, sf):
    records = S.study(spark, sf).select("record_id", "status", "priority")
    # A record with no filled cell has no rows, so its id is carried as a cell of its own.
    long = E.to_eav(records.withColumn("_id", F.col("record_id")), ["record_id"])
    return E.from_eav(long, ["record_id"], ["status", "priority"])


@query(f"""WITH {S.STUDY_SQL},
long AS (FROM study SELECT record_id, status, priority, price) SELECT record_id, field, value
FROM long UNPIVOT (value FOR field IN (status, priority, price)) WHERE value <> ''""")
def export_eav(spark, sf):
    return E.to_eav(S.study(spark, sf), ["record_id"], ["status", "priority", "price"])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderpriority AS redcap_event_name,
  strftime(o_orderdate, '%Y-%m-%d') AS last_modified, o_orderstatus AS status
FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate <= '1998-12-31'
  AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT user_id FROM events)""")
def export_filtered(spark, sf):
    """Chosen events, modification dates, ids and fields, all pushed to the scan where possible."""
    records = table(spark, sf, "orders").select(
        S.text("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("redcap_event_name"),
        F.col("o_orderdate").alias("last_modified"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("person"))
    people = table(spark, sf, "events").select("user_id").distinct()
    records = records.join(people, records["person"] == people["user_id"], "left_semi")
    out = E.export_records(
        records, S.STUDY, forms=["intake"], events=["1-URGENT", "2-HIGH"],
        modified=("1997-01-01", "1998-12-31"), keep=["redcap_event_name", "last_modified"])
    return out.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd"))


@query(f"""WITH {S.STUDY_SQL}
SELECT record_id, CASE status WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' WHEN 'P'
    THEN 'Pending, partly' ELSE status END AS status,
  CASE WHEN flags___2 = '1' THEN 'Checked' ELSE 'Unchecked' END AS flags___2,
  CASE recheck WHEN '1' THEN 'Yes' ELSE recheck END AS recheck FROM study""")
def export_labels(spark, sf):
    out = E.export_records(S.study(spark, sf), S.STUDY, fields=["status", "flags", "recheck"],
                           labels=True)
    return out.select("record_id", "status", "flags___2", "recheck")
