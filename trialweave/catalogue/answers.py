"""Returned worklists and typed answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import audit as A
from ..operators import changes as C
from ..operators import ingest as I
from ..plans.dictionary import Dictionary, Field
from . import shapes as S
from .registry import query, table

_SHOWN = ("status", "priority", "price")


def _sent(spark, sf):
    """Every shown cell with its flag: blanks and codes are gaps, text prices are uncertain."""
    long = S.study(spark, sf).select("record_id", *_SHOWN).unpivot(
        ["record_id"], list(_SHOWN), "field", "value")
    flag = F.when(F.col("value").isin("", *K.SENTINELS), "gap").when(
        F.col("value") == "unknown", "uncertain")
    return long.withColumn("flag", flag)


def _returned(spark, sf):
    k = F.col("record_id").cast("long")
    reply = F.when(k % 5 == 0, "7").when(k % 8 == 0, "").otherwise(F.col("value"))
    return _sent(spark, sf).select("record_id", "field", reply.alias("value"))


def _notes(spark, sf):
    k = F.col("record_id").cast("long")
    return S.study(spark, sf).select(
        "record_id", F.when(k % 10 == 0, "Resolved").when(k % 6 == 0, "patient died")
        .otherwise("").alias("note"))


_SHEET_SQL = S.STUDY_SQL + """,
sent AS (SELECT record_id, k, field, value,
    CASE WHEN value IN ('', '666', '-666', '-777', '-888', '-999') THEN 'gap'
         WHEN value = 'unknown' THEN 'uncertain' END AS flag
  FROM (SELECT record_id, k, status, priority, price FROM study)
  UNPIVOT (value FOR field IN (status, priority, price))),
back AS (SELECT record_id, field, value AS sent, flag,
    CASE WHEN k % 5 = 0 THEN '7' WHEN k % 8 = 0 THEN '' ELSE value END AS returned FROM sent),
changes AS (SELECT record_id, field, sent, flag, returned,
    CASE WHEN flag = 'gap' THEN 'answer' WHEN flag = 'uncertain' THEN 'uncertain_answer'
         ELSE 'out_of_scope' END AS outcome
  FROM back WHERE returned <> sent AND (returned <> '' OR flag IS NULL)),
notes AS (SELECT record_id, CASE WHEN k % 10 = 0 THEN 'Resolved' WHEN k % 6 = 0
    THEN 'patient died' ELSE '' END AS note FROM study),
alone AS (SELECT * FROM notes WHERE note <> '' AND record_id NOT IN
  (SELECT record_id FROM changes WHERE outcome <> 'out_of_scope'))"""


def _changes(spark, sf):
    return A.returned_audit(_sent(spark, sf), _returned(spark, sf), unique=True)


@query(f"WITH {_SHEET_SQL} SELECT record_id, field, sent, flag, returned, outcome FROM changes")
def returned_audit(spark, sf):
    return _changes(spark, sf)


@query(f"WITH {_SHEET_SQL} SELECT record_id, note FROM alone")
def note_only(spark, sf):
    return A.note_only(_notes(spark, sf), _changes(spark, sf))


@query(f"""WITH {_SHEET_SQL}
SELECT record_id, field, returned FROM changes WHERE outcome = 'out_of_scope'""")
def out_of_scope(spark, sf):
    return _changes(spark, sf).where(F.col("outcome") == "out_of_scope").select(
        "record_id", "field", "returned")


@query(f"WITH {_SHEET_SQL} SELECT outcome, count(*) AS cells FROM changes GROUP BY outcome")
def audit_counts(spark, sf):
    return A.audit_counts(_changes(spark, sf))


@query(f"""WITH {_SHEET_SQL}
SELECT record_id, field, CASE WHEN field = 'price' THEN 'READY' ELSE 'QUESTION' END AS bucket
FROM changes WHERE outcome <> 'out_of_scope'
UNION ALL SELECT record_id, '', CASE WHEN note = 'Resolved' THEN 'VERIFY' ELSE 'NO_ACTION' END
FROM alone""")
def triage(spark, sf):
    """Replies that are no choice of a coded field are questions."""
    changes = _changes(spark, sf)
    coded = changes.where(F.col("field").isin("status", "priority"))
    return A.triage(changes, coded, A.note_only(_notes(spark, sf), changes))


@query("""WITH shown AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(l_linenumber AS VARCHAR) AS field,
    l_returnflag AS value, CASE l_linestatus WHEN 'O' THEN 'gap' END AS flag,
    CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus ELSE l_returnflag END AS reply, l_partkey AS p
  FROM lineitem),
sent AS (SELECT record_id, field, value AS sent, flag FROM shown WHERE p % 10 <> 0
  QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY value DESC, flag DESC NULLS LAST) = 1),
back AS (SELECT record_id, field, max(reply) AS returned FROM shown GROUP BY ALL),
found AS (SELECT CASE WHEN sent IS NULL THEN 'not_sent' WHEN flag = 'gap' THEN 'answer'
    ELSE 'out_of_scope' END AS outcome
  FROM back LEFT JOIN sent USING (record_id, field) WHERE sent IS NULL OR returned <> sent)
SELECT outcome, count(*) AS cells FROM found GROUP BY outcome""")
def audit_repeats(spark, sf):
    """Cells that occur several times on either side, and cells that were never sent."""
    shown = table(spark, sf, "lineitem").select(
        S.text("l_orderkey").alias("record_id"), S.text("l_linenumber").alias("field"),
        F.col("l_returnflag").alias("value"),
        F.when(F.col("l_linestatus") == "O", "gap").alias("flag"), "l_partkey",
        F.when(S.every("l_suppkey", 2), F.col("l_linestatus")).otherwise(F.col("l_returnflag"))
        .alias("reply"))
    sent = shown.where(F.col("l_partkey") % 10 != 0).select("record_id", "field", "value", "flag")
    back = shown.select("record_id", "field", F.col("reply").alias("value"))
    return A.audit_counts(A.returned_audit(sent, back))


VISIT = Dictionary([
    Field("visit_id", "visit", field_label="Visit"),
    Field("outcome", "visit", field_type="radio", field_label="Order  status?",
          select_choices_or_calculations="1, Filled | 2, Open | 3, Pending, partly"),
    Field("urgent", "visit", field_type="yesno", field_label="Urgent"),
    Field("seen_on", "visit", field_label="Visit date",
          text_validation_type_or_show_slider_number="date_dmy"),
    Field("findings", "visit", field_type="checkbox", field_label="Findings",
          select_choices_or_calculations="1, Late | 2, Damaged | -888, Missing in case notes"),
    Field("remarks", "visit", field_type="notes", field_label="Remarks"),
    Field("remarks2", "visit", field_type="notes", field_label="remarks"),
])
ALIASES = {"outcome": {"ALL  done": "Open", "All done": "Filled"}, "findings": {"broken": "2", "tardy": "late"}}


def _answers(spark, sf):
    """Five typed answers per order, some under a heading with marks, and one nobody knows."""
    k = "o_orderkey"
    cell = lambda header, value: F.struct(F.lit(header).alias("header"), value.alias("value"))
    outcome = (
        F.when(S.every(k, 9), "Case note NOT found").when(S.every(k, 10), "all  DONE")
        .when(F.col("o_orderstatus") == "F", " filled ").when(F.col("o_orderstatus") == "O", "OPEN")
        .otherwise("pending?"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "yes").when(
        S.every(k, 4), "maybe").otherwise("No")
    seen = (
        F.when(S.every(k, 12), "no case file").when(S.every(k, 5), "soon")
        .when(S.every(k, 3), F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    findings = (
        F.when(S.every(k, 8), "missing in case notes").when(S.every(k, 7), "Late, scorched")
        .when(S.every(k, 2), "late,broken").otherwise(""))
    remarks = F.when(S.every(k, 6), "12.00").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(S.text(k).alias("record_id"), F.explode(F.array(
        F.struct(F.when(S.every(k, 2), "Order  status?:").otherwise("Order status").alias("header"),
                 outcome.alias("value")), cell("URGENT", urgent), cell("Visit date", seen),
        cell("Findings", findings), cell("Remarks", remarks),
        cell("Mystery", F.lit("x")))).alias("c")).select("record_id", "c.*")


_ANSWERS_SQL = """answers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderkey AS k, o_orderstatus AS s,
    o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS d,
    strftime(o_orderdate, '%d/%m/%Y') AS dmy FROM orders),
moved AS (
  SELECT record_id, CASE WHEN k % 2 = 0 THEN 'Order  status?:' ELSE 'Order status' END AS header,
    'outcome' AS "column",
    CASE WHEN k % 9 = 0 THEN '-888' WHEN k % 10 = 0 OR s = 'F' THEN '1' WHEN s = 'O' THEN '2' END
      AS code,
    CASE WHEN k % 9 = 0 THEN 'Case note NOT found' WHEN k % 10 = 0 THEN 'all  DONE'
         WHEN s = 'F' THEN 'filled' WHEN s = 'O' THEN 'OPEN' ELSE 'pending?' END AS value,
    'value not in choice list' AS why FROM answers
  UNION ALL SELECT record_id, 'URGENT', 'urgent',
    CASE WHEN p = '1-URGENT' THEN '1' WHEN k % 4 = 0 THEN NULL ELSE '0' END,
    CASE WHEN p = '1-URGENT' THEN 'yes' WHEN k % 4 = 0 THEN 'maybe' ELSE 'No' END,
    'value not in choice list' FROM answers
  UNION ALL SELECT record_id, 'Visit date', 'seen_on',
    CASE WHEN k % 12 = 0 THEN '8888-08-08' WHEN k % 5 = 0 THEN NULL ELSE d END,
    CASE WHEN k % 12 = 0 THEN 'no case file' WHEN k % 5 = 0 THEN 'soon' WHEN k % 3 = 0 THEN dmy
         ELSE d END, 'unparseable date' FROM answers
  UNION ALL SELECT record_id, 'Remarks', 'remarks', CASE WHEN k % 6 = 0 THEN '12' ELSE p END,
    CASE WHEN k % 6 = 0 THEN '12.00' ELSE p END, NULL FROM answers
  UNION ALL SELECT record_id, 'Findings', 'findings____888', '1', 'missing in case notes', NULL
    FROM answers WHERE k % 8 = 0
  UNION ALL SELECT record_id, 'Findings', 'findings___1', '1',
    CASE WHEN k % 7 = 0 THEN 'Late, scorched' ELSE 'late,broken' END, NULL
    FROM answers WHERE k % 8 <> 0 AND (k % 7 = 0 OR k % 2 = 0)
  UNION ALL SELECT record_id, 'Findings', 'findings___2', '1', 'late,broken', NULL
    FROM answers WHERE k % 8 <> 0 AND k % 7 <> 0 AND k % 2 = 0
  UNION ALL SELECT record_id, 'Findings', NULL, NULL, 'Late, scorched',
    'checkbox option ''scorched'' not a choice' FROM answers WHERE k % 8 <> 0 AND k % 7 = 0
  UNION ALL SELECT record_id, 'Mystery', NULL, NULL, 'x', 'unknown heading' FROM answers),
headings AS (SELECT 'Order status' AS header UNION ALL SELECT 'Order  status?:' UNION ALL SELECT 'URGENT'
  UNION ALL SELECT 'Visit date' UNION ALL SELECT 'Findings' UNION ALL SELECT 'Remarks'
  UNION ALL SELECT 'Mystery'),
labels AS (SELECT unnest(['Visit', 'Order  status?', 'Urgent', 'Visit date', 'Findings', 'Remarks',
  'remarks']) AS label)"""


def _translated(spark, sf):
    return I.translate_cells(_answers(spark, sf), VISIT, ALIASES)


@query(f'WITH {_ANSWERS_SQL} SELECT record_id, "column", code FROM moved WHERE code IS NOT NULL')
def translate_cells(spark, sf):
    return I.payload(_translated(spark, sf))


@query(f"""WITH {_ANSWERS_SQL}
SELECT record_id, header, value, why AS issue FROM moved WHERE code IS NULL""")
def translate_issues(spark, sf):
    return I.issues(_translated(spark, sf))


@query("""SELECT record_id, 'outcome' AS "column", min(code) AS least, max(code) AS greatest, count(*) AS answers
FROM (SELECT CAST(l_orderkey AS VARCHAR) AS record_id,
    CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END AS code FROM lineitem)
GROUP BY record_id HAVING min(code) <> max(code)""")
def translate_contradictions(spark, sf):
    """Orders as records whose outcome every line answers: those whose lines do not agree."""
    flag = F.col("l_returnflag")
    answers = table(spark, sf, "lineitem").select(
        S.text("l_orderkey").alias("record_id"), F.lit("Order status").alias("header"),
        F.when(flag == "A", "filled ").when(flag == "N", "Open").otherwise("pending, PARTLY").alias("value"))
    return I.contradictions(I.translate_cells(answers, VISIT, ALIASES))


@query(f"""WITH {_ANSWERS_SQL},
given AS (SELECT 5 * count(*) + count(*) FILTER (k % 8 = 0 OR k % 7 = 0 OR k % 2 = 0) AS n
  FROM answers),
seen AS (SELECT record_id, header, bool_or(code IS NOT NULL) AS cell,
  bool_or(why = 'unknown heading') AS unknown FROM moved GROUP BY record_id, header)
SELECT (SELECT n FROM given) AS answers, count(*) FILTER (cell) AS with_cell,
  count(*) FILTER (NOT cell AND NOT coalesce(unknown, false)) AS with_issue_only,
  count(*) FILTER (unknown) AS under_unknown_heading FROM seen""")
def translate_balance(spark, sf):
    """Every filled answer is a cell, an issue or under an unknown heading: the four counts."""
    given = _answers(spark, sf).where(F.trim("value") != "").agg(F.count("*").alias("answers"))
    seen = _translated(spark, sf).groupBy("record_id", "header").agg(
        F.bool_or(F.col("issue").isNull()).alias("cell"),
        F.bool_or(F.coalesce(F.col("issue") == I.UNKNOWN_HEADER, F.lit(False))).alias("unknown"))
    counts = seen.agg(
        F.count_if("cell").alias("with_cell"),
        F.count_if(~F.col("cell") & ~F.col("unknown")).alias("with_issue_only"),
        F.count_if("unknown").alias("under_unknown_heading"))
    return given.crossJoin(counts)


_PAYLOAD_COLUMNS = ("outcome", "urgent", "seen_on", "findings___1", "findings___2",
                    "findings____888", "remarks")


@query(f"WITH {_ANSWERS_SQL} SELECT record_id AS visit_id, " + ", ".join(
    f"coalesce(max(CASE WHEN \"column\" = '{c}' THEN code END), '') AS {c}"
    for c in _PAYLOAD_COLUMNS) + ", '' AS remarks2 FROM moved WHERE code IS NOT NULL GROUP BY record_id")
def translate_payload(spark, sf):
    return I.payload_wide(_translated(spark, sf), VISIT)


@query(f"""WITH {_ANSWERS_SQL},
key_of AS (SELECT lower(regexp_replace(rtrim(trim(label), ' ?.:;'), '\\s+', ' ', 'g')) AS k FROM labels)
SELECT DISTINCT h.header FROM headings h JOIN (SELECT DISTINCT header FROM moved) m USING (header)
WHERE lower(regexp_replace(rtrim(trim(h.header), ' ?.:;'), '\\s+', ' ', 'g'))
  NOT IN (SELECT k FROM key_of)""")
def unknown_headers(spark, sf):
    return I.unknown_headers(_answers(spark, sf), VISIT)


@query(f"""WITH {_SHEET_SQL}
SELECT record_id, field AS header, returned AS value FROM back WHERE returned <> sent""")
def changed_answers(spark, sf):
    rename = lambda df: df.select("record_id", F.col("field").alias("header"), "value")
    return I.changed_answers(rename(_returned(spark, sf)), rename(_sent(spark, sf)))


def _drafts(spark, sf):
    """Staged updates: a few changed columns per order, by site and workbook."""
    k = "o_orderkey"
    return table(spark, sf, "orders").select(
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("site"),
        F.when(S.every("o_custkey", 2), "core").otherwise("").alias("workbook"),
        S.text(k).alias("record_id"),
        F.when(S.every(k, 3), F.col("o_orderstatus")).otherwise("").alias("status"),
        F.when(S.every(k, 4), "1").otherwise("").alias("flags___2"),
        F.when(S.every(k, 5), "0").when(S.every(k, 7), "2").otherwise("").alias("flags____999"),
        F.when(S.every(k, 11), "x").otherwise("").alias("extra"))


_DRAFTS_SQL = """drafts AS (
  SELECT lower(substr(o_orderpriority, 3)) AS site,
    CASE WHEN o_custkey % 2 = 0 THEN 'core' ELSE '' END AS workbook,
    CAST(o_orderkey AS VARCHAR) AS record_id, o_orderkey AS k, o_orderstatus AS s FROM orders),
lines AS (
  SELECT site, workbook, record_id,
    CASE WHEN k % 3 = 0 THEN 'status' WHEN k % 4 = 0 OR k % 5 = 0 OR k % 7 = 0 THEN 'flags'
         ELSE 'extra' END AS primary_field,
    list_filter([
      CASE WHEN k % 3 = 0 THEN 'Order status: → `' || s || '` (' || CASE s WHEN 'F' THEN 'Filled'
        WHEN 'O' THEN 'Open' ELSE 'Pending, partly' END || ')' END,
      CASE WHEN k % 4 = 0 THEN 'Flags raised: checked: `2` (Damaged)' END,
      CASE WHEN k % 5 = 0 THEN 'Flags raised: unchecked: `-999` (Other missing)'
           WHEN k % 7 = 0 THEN 'Flags raised: set to 2: `-999` (Other missing)' END,
      CASE WHEN k % 11 = 0 THEN '`extra` → `x` (field not in dictionary)' END],
      lambda x: x IS NOT NULL) AS changes
  FROM drafts WHERE k % 3 = 0 OR k % 4 = 0 OR k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0)"""


@query(f"""WITH {_DRAFTS_SQL}
SELECT site, workbook, record_id, primary_field, array_to_string(changes, ' | ') AS changes
FROM lines""")
def change_details(spark, sf):
    return C.change_details(_drafts(spark, sf), S.STUDY, "record_id").withColumn(
        "changes", F.array_join("changes", " | "))


@query(f"""WITH {_DRAFTS_SQL}
SELECT site, workbook, primary_field, count(*) AS records,
  CAST(sum(len(changes)) AS BIGINT) AS changes FROM lines GROUP BY ALL""")
def change_summary(spark, sf):
    return C.largest_first(C.change_groups(C.change_details(
        _drafts(spark, sf), S.STUDY, "record_id")))


@query(f"""WITH {_DRAFTS_SQL}
SELECT site, record_id, primary_field FROM lines ORDER BY primary_field, site, record_id LIMIT 20""")
def first_operations(spark, sf):
    """A trial run over the first operations of a stated order."""
    changes = C.change_details(_drafts(spark, sf), S.STUDY, "record_id").select(
        "site", "record_id", "primary_field")
    return C.first_operations(changes, ["primary_field", "site", "record_id"], 20)
