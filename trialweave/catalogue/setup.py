"""Study set-up operators over customers and orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import admin as A
from . import shapes as S
from .registry import query, table


def _intake(spark, sf):
    k = "c_custkey"
    return table(spark, sf, "customer").select(
        S.text(k).alias("rid"),
        F.col("c_mktsegment").alias("inst_name_1"),
        F.when(S.every(k, 2), F.concat(F.lit(" "), "c_name")).otherwise("").alias("inst_name_2"),
        F.when(S.every(k, 3), "protocol.pdf").otherwise("1").alias("sop"),
        F.when(S.every(k, 4), "consent.doc").otherwise("").alias("consent_file_1"),
        F.when(S.every(k, 5), "q.doc").otherwise("").alias("quest_univ_file"),
        F.when(S.every(k, 7), "").otherwise(F.col("c_name")).alias("pi_user_name"),
        F.lit("pi@x").alias("pi_user_email"),
        F.when(S.every(k, 6), "Ade").otherwise(" ").alias("ra_name"),
        F.lit("").alias("ra_email"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rid, 'inst_name_1' AS "column", c_mktsegment AS site
FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'inst_name_2', c_name FROM customer
WHERE c_custkey % 2 = 0""")
def repeated_columns(spark, sf):
    return A.repeated_to_rows(_intake(spark, sf), ["rid"], "inst_name_", "site")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rid, 'sop' AS "column", 'protocol.pdf' AS file,
  'Study Documents' AS folder FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'consent_file_1', 'consent.doc', 'IRB and Ethics'
  FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'quest_univ_file', 'q.doc', 'Study Documents'
  FROM customer WHERE c_custkey % 5 = 0""")
def attachments(spark, sf):
    return A.attachments(_intake(spark, sf), "rid")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rid, c_name AS name, 'pi@x' AS email,
  'Principal Investigator' AS role FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'Ade', '', 'Data Entry (RA)' FROM customer
WHERE c_custkey % 6 = 0""")
def personnel(spark, sf):
    return A.personnel(_intake(spark, sf), "rid", [
        ("pi_user_name", "pi_user_email", "Principal Investigator"),
        ("ra_name", "ra_email", "Data Entry (RA)")])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rid, c_custkey % 5 = 0 AND c_custkey % 7 <> 0 AS ready
FROM customer""")
def build_readiness(spark, sf):
    return _intake(spark, sf).select(
        "rid", A.ready_to_build(["quest_univ_file", "pi_user_name"]).alias("ready"))


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN '5' WHEN 'LARGE' THEN '1' WHEN 'PROMO'
  THEN '7' WHEN 'MEDIUM' THEN '2' END AS cancer_type FROM part""")
def recode(spark, sf):
    typed = F.when(F.col("p_type") == "SMALL", " hpb ").when(F.col("p_type") == "LARGE", "Colorectal") \
        .when(F.col("p_type") == "PROMO", "MIXED").when(F.col("p_type") == "MEDIUM", "breast") \
        .otherwise("unheard of")
    return table(spark, sf, "part").select(
        "p_partkey", A.recode(typed, K.CANCER_TYPES).alias("cancer_type"))


def _sheet(spark, sf):
    k = "o_orderkey"
    return table(spark, sf, "orders").select(
        S.text(k).alias("record_id"), F.concat(F.lit(" "), "o_orderpriority").alias("project_title"),
        F.when(S.every(k, 2), "1").when(S.every(k, 3), "0").otherwise("n/a").alias("sop_uploaded"),
        F.when(S.every(k, 5), "x").otherwise(S.text(F.col(k) % 4)).alias("study_status"),
        F.when(F.col("o_orderstatus") == "F", "Gastric").otherwise("zzz").alias("cancer"),
        F.when(S.every(k, 4), "pending").when(S.every(k, 3), F.concat(
            F.lit("Ife: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nOyo: 1/2/25"),
            F.when(S.every(k, 9), "; Ekiti: 3/4/26").otherwise("")))
        .otherwise("").alias("irb_raw"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderpriority AS project_title,
  CASE WHEN o_orderkey % 2 = 0 THEN '1' WHEN o_orderkey % 3 = 0 THEN '0' ELSE '' END AS sop_uploaded,
  CASE WHEN o_orderstatus = 'F' THEN '3' ELSE '' END AS cancer_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS study_status,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 >= 2 THEN '1' ELSE '' END AS study_production,
  CASE WHEN dated THEN CASE WHEN o_orderkey % 9 = 0 THEN '3' ELSE '2' END ELSE '' END
    AS irb_site_count,
  CASE WHEN dated AND o_orderkey % 9 = 0 THEN '1' ELSE '' END AS irb_sites_over,
  CASE WHEN dated THEN 'Ife' ELSE '' END AS irb_site_1,
  CASE WHEN dated THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS irb_site_1_expiry,
  CASE WHEN dated THEN 'Oyo' ELSE '' END AS irb_site_2,
  CASE WHEN dated THEN '2025-02-01' ELSE '' END AS irb_site_2_expiry,
  CASE WHEN o_orderkey % 4 = 0 THEN 'IRB expiry raw (verify): pending'
    WHEN dated THEN 'IRB expiry raw (verify): Ife: ' || strftime(o_orderdate, '%d/%m/%Y') || chr(10)
      || 'Oyo: 1/2/25' || CASE WHEN o_orderkey % 9 = 0 THEN '; Ekiti: 3/4/26' ELSE '' END
    ELSE '' END AS build_notes
FROM (SELECT *, o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 AS dated FROM orders)""")
def tracker_payload(spark, sf):
    return A.tracker_payload(
        _sheet(spark, sf), "record_id", copied=["project_title"], flags=["sop_uploaded"],
        recodes={"cancer_type": ("cancer", K.CANCER_TYPES)}, dated_sites="irb_raw", slots=2)


@query("""SELECT c_custkey, source AS source_raw, trim(split_part(source, ',', 1)) AS house,
  trim(split_part(source, ',', 2)) AS street,
  CASE WHEN len(string_split(source, ',')) > 2 THEN trim(array_to_string(string_split(source, ',')[3:], ','))
    ELSE '' END AS town
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN '-777'
    WHEN c_custkey % 11 = 0 THEN ' , ' WHEN c_custkey % 3 = 0 THEN c_custkey || ', ' || c_mktsegment
    ELSE c_custkey || ',' || c_name || ', Oke, Ife' END AS source, c_custkey % 8 = 0 AS filled
  FROM customer) WHERE NOT filled AND source NOT IN ('', '-777', ' , ')""")
def migration_candidates(spark, sf):
    k = "c_custkey"
    address = F.when(S.every(k, 9), "").when(S.every(k, 10), "-777").when(S.every(k, 11), " , ") \
        .when(S.every(k, 3), F.concat(S.text(k), F.lit(", "), "c_mktsegment")) \
        .otherwise(F.concat(S.text(k), F.lit(","), "c_name", F.lit(", Oke, Ife")))
    records = table(spark, sf, "customer").select(
        k, address.alias("address"), F.lit(" ").alias("house"),
        F.when(S.every(k, 8), "Broad").otherwise("").alias("street"), F.lit("").alias("town"))
    return A.migration_candidates(records, k, "address", ["house", "street", "town"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer""")
def json_roundtrip(spark, sf):
    records = table(spark, sf, "customer").select(
        S.text("c_custkey").alias("c_custkey"), "c_name", "c_mktsegment")
    return A.from_json_payload(A.to_json_payload(records, "c_custkey"), records.columns)


_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'radio' WHEN 1 THEN 'text' WHEN 2 THEN 'notes' " \
    "WHEN 3 THEN 'checkbox' WHEN 4 THEN 'calc' ELSE 'dropdown' END"
_MISSING = ", ".join(f"'{t}'" for t in K.MISSING_CHOICE_TEXT)


@query(f"""WITH f AS (
  SELECT p_brand AS project_id, p_partkey AS pos, {_KIND} AS field_type,
    CASE WHEN p_partkey % 6 IN (0, 3, 5) THEN CASE WHEN p_size % 3 = 0 THEN '1, Yes | -888, Missing in case notes'
      WHEN p_size % 3 = 1 THEN '1, Yes' ELSE '' END ELSE '' END AS choices,
    CASE WHEN p_size % 4 = 0 THEN p_name ELSE '' END AS note, p_size % 2 = 1 AS dated,
    p_partkey > min(p_partkey) OVER (PARTITION BY p_brand) AND p_partkey % 6 <> 4 AS due
  FROM part)
SELECT project_id, pos, CASE WHEN due AND field_type IN ('radio', 'dropdown', 'checkbox')
    THEN array_to_string(list_filter([choices] || list_filter([{_MISSING}],
      lambda t: NOT contains(choices, t)), lambda t: t <> ''), ' | ') ELSE choices END AS choices,
  CASE WHEN due AND field_type IN ('text', 'notes') AND note = '' THEN
    CASE WHEN dated THEN '{K.DATE_MISSING_NOTE}' ELSE '{K.TEXT_MISSING_NOTE}' END
    ELSE note END AS note FROM f""")
def missing_codes_added(spark, sf):
    """Parts as fields, brands as projects: what each field's choices and note become."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*map(F.lit, ("radio", "text", "notes", "checkbox", "calc", "dropdown")))
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("project_id"), k.alias("pos"),
        F.concat(F.lit("f"), S.text("p_partkey")).alias("field_name"),
        F.element_at(kinds, (k % 6 + 1).cast("int")).alias("field_type"),
        F.when((k % 6).isin(0, 3, 5), F.when(size % 3 == 0, "1, Yes | -888, Missing in case notes")
               .when(size % 3 == 1, "1, Yes").otherwise("")).otherwise("")
        .alias("select_choices_or_calculations"),
        F.when(size % 4 == 0, F.col("p_name")).otherwise("").alias("field_note"),
        F.when(size % 2 == 1, "date_dmy").otherwise("")
        .alias("text_validation_type_or_show_slider_number"))
    return A.with_missing_codes(rows).select(
        "project_id", "pos", F.col("select_choices_or_calculations").alias("choices"),
        F.col("field_note").alias("note"))
