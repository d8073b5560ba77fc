"""Column functions over whole tables, against the same written in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import constants as K
from ..functions import dates as D
from ..functions import text as X
from . import shapes as S
from .registry import query, table


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 12
    WHEN 0 THEN '  00' || o_custkey WHEN 1 THEN o_custkey || '.0' WHEN 2 THEN 'NaN'
    WHEN 3 THEN '+' || o_custkey WHEN 4 THEN '-0' WHEN 5 THEN o_custkey || '.50'
    WHEN 6 THEN '1e3' WHEN 7 THEN ' text ' WHEN 8 THEN '' WHEN 9 THEN '123456789012345678901.0'
    WHEN 10 THEN '1_000' ELSE '.25' END AS v, o_custkey AS c FROM orders)
SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN CAST(c AS VARCHAR) WHEN 1 THEN CAST(c AS VARCHAR)
  WHEN 2 THEN '' WHEN 3 THEN CAST(c AS VARCHAR) WHEN 4 THEN '0' WHEN 5 THEN c || '.5'
  WHEN 6 THEN '1000' WHEN 7 THEN 'text' WHEN 8 THEN '' WHEN 9 THEN '123456789012345678901'
  WHEN 10 THEN '1_000' ELSE '0.25' END AS norm FROM v""")
def norm_values(spark, sf):
    k, c = F.col("o_orderkey"), S.text("o_custkey")
    forms = [F.concat(F.lit("  00"), c), F.concat(c, F.lit(".0")), F.lit("NaN"),
             F.concat(F.lit("+"), c), F.lit("-0"), F.concat(c, F.lit(".50")), F.lit("1e3"),
             F.lit(" text "), F.lit(""), F.lit("123456789012345678901.0"), F.lit("1_000"),
             F.lit(".25")]
    value = F.element_at(F.array(*forms), (k % 12 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", C.norm_value(value).alias("norm"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'One, or more' WHEN 2 THEN 'Two' ELSE
  CAST(p_size % 4 AS VARCHAR) END AS label, 2 AS n, 'One, or more' AS first FROM part""")
def choice_decode(spark, sf):
    """A choice text parsed in each row, and a code decoded with a literal map."""
    choices = F.concat(F.lit("1, One, or more |2,Two|"), "p_name")
    code = S.text(F.col("p_size") % 4)
    parsed = X.choice_map(choices)
    return table(spark, sf, "part").select(
        "p_partkey", X.decode(code, {"1": "One, or more", "2": "Two"}).alias("label"),
        F.size(parsed).cast("long").alias("n"), parsed["1"].alias("first"))


@query("""SELECT o_orderkey,
  concat_ws(', ', CASE WHEN o_orderkey % 2 = 0 THEN 'Pain' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Fever, high' END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Other missing' END) AS labels,
  concat_ws('|', CASE WHEN o_orderkey % 2 = 0 THEN '1' END, CASE WHEN o_orderkey % 3 = 0 THEN '2' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '-999' END) AS codes FROM orders""")
def ticked_labels(spark, sf):
    k = "o_orderkey"
    bit = lambda n: F.when(S.every(k, n), "1").otherwise("0")
    wide = table(spark, sf, "orders").select(
        k, bit(2).alias("s___1"), bit(3).alias("s___2"), bit(5).alias("s____999"))
    columns = {c: X.checkbox_column("s", c) for c in ("1", "2", "-999")}
    choices = {"1": "Pain", "2": "Fever, high", "-999": "Other missing"}
    return wide.select(k, X.ticked_labels(columns, choices).alias("labels"),
                       F.array_join(X.ticked_codes(columns), "|").alias("codes"))


@query("""SELECT p_partkey, trim(regexp_replace(v, '[ ?.:;]+$', '')) AS label FROM (
  SELECT p_partkey, trim(regexp_replace('  ' || p_name || chr(10) || chr(9) || p_type ||
    CASE p_size % 3 WHEN 0 THEN ' ?: ' WHEN 1 THEN '.' ELSE '' END, '\\s+', ' ', 'g')) AS v FROM part)""")
def clean_labels(spark, sf):
    tail = F.when(S.every("p_size", 3), " ?: ").when(F.col("p_size") % 3 == 1, ".").otherwise("")
    raw = F.concat(F.lit("  "), "p_name", F.lit("\n\t"), "p_type", tail)
    return table(spark, sf, "part").select("p_partkey", X.clean_label(raw).alias("label"))


@query("""SELECT c_custkey, nullif(regexp_replace(h, '^0+', ''), '') AS hospital FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE
    regexp_replace(lower('00-' || CAST(c_nationkey AS VARCHAR) || ' /AB'
      || CAST(c_custkey AS VARCHAR)), '[^a-z0-9]', '', 'g') END AS h FROM customer)""")
def hospital_keys(spark, sf):
    raw = F.concat(F.lit("00-"), S.text("c_nationkey"), F.lit(" /AB"), S.text("c_custkey"))
    raw = F.when(S.every("c_custkey", 7), F.when(S.every("c_custkey", 2), "NYR").otherwise("-999")) \
        .otherwise(raw)
    return table(spark, sf, "customer").select("c_custkey", X.hospital_key(raw).alias("hospital"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 2, 3, 5, 6)
  THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def date_parse(spark, sf):
    """Seven spellings of the same date; the fifth is not one."""
    d = F.col("o_orderdate")
    forms = [F.date_format(d, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy", "d MMM yyyy")]
    forms += [F.lit("31/31/2024"), F.upper(F.date_format(d, "d MMMM yyyy")),
              F.date_format(d, "MMMM d yyyy")]
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", D.parse_any(raw).alias("parsed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '' WHEN 3 THEN '8888-08-08'
  WHEN 4 THEN NULL ELSE '' END AS stored,
  CASE WHEN o_orderkey % 6 < 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 6 = 3
    THEN '08/08/8888' WHEN o_orderkey % 6 = 4 THEN 'soon' ELSE '(not provided)' END AS shown,
  coalesce(o_orderkey % 6 < 2 AND o_orderdate < '1998-01-01', false) AS expired FROM orders""")
def import_dates(spark, sf):
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "d/M/yyyy"), F.date_format(d, "yyyy/MM/dd"), F.lit("N/A"),
             F.lit("08-08-8888"), F.lit("soon"), F.lit(" ")]
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    stored = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn(
        "stored", D.parse_import("raw"))
    return stored.select("o_orderkey", "stored",
                         D.shown_date(F.coalesce("stored", "raw")).alias("shown"),
                         D.is_expired("stored", "1998-01-01").alias("expired"))


@query("""SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 5 = 0 THEN ['Ife', 'Ibadan'] ELSE ['Ife']
  END) AS site, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [strftime(o_orderdate, '%Y-%m-%d'),
    '2024-02-29'] ELSE [strftime(o_orderdate, '%Y-%m-%d')] END) AS date FROM orders""")
def site_dates(spark, sf):
    raw = F.concat(
        F.lit("Ife: "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("\nno date here; Lagos: 31/02/24"),
        F.when(S.every("o_orderkey", 5), ";Ibadan: 29.2.24 renewed").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(D.site_dates(raw)).alias("s")) \
        .select("o_orderkey", "s.site", "s.date")


@query("""SELECT doc_id, CASE
  WHEN regexp_matches(lower(source || ' ' || text), '\\b(biobank|repository|biorepository|specimen.collection|tissue.bank)\\b') THEN 'R'
  WHEN regexp_matches(lower(source || ' ' || text), '\\b(those|thing|that)\\b') THEN 'T'
  WHEN regexp_matches(lower(source || ' ' || text), '(^|[^\\p{L}\\p{N}_])(le|la).(en|de)($|[^\\p{L}\\p{N}_])') THEN 'F'
  ELSE 'none' END AS kind FROM documents""")
def classify_text(spark, sf):
    """Ordered patterns over whole document texts."""
    rules = ((r"\b(biobank|repository|biorepository|specimen.collection|tissue.bank)\b", "R"),
             (r"\b(those|thing|that)\b", "T"), (r"\b(le|la).(en|de)\b", "F"))
    return table(spark, sf, "documents").select(
        "doc_id", X.keyword_class("source", "text", rules=rules, default="none").alias("kind"))


_STUDIES = ("a tissue-bank of {}", "Focus group on {}", "RANDOMISED use of {}", "deep  learning for {}",
            "deep learning for {}", "capacity-building with {}", "prevalence of {}",
            "single-cell {}", "the price of {}", "Phase 2 of {}, a cohort study", "brinterviewing {}")


@query("SELECT p_partkey, CASE " + " ".join(
    f"WHEN regexp_matches(t, '{pattern}') THEN '{label}'" for pattern, label in K.SUBCATEGORIES)
    + f" ELSE '{K.SUBCATEGORY_UNCLEAR}' END AS subcategory FROM (SELECT p_partkey, lower(CASE "
    + " ".join(f"WHEN p_partkey % {len(_STUDIES)} = {i} THEN '{t.split('{}')[0]}' || p_name || "
               f"'{t.split('{}')[1]}'" for i, t in enumerate(_STUDIES))
    + " END || ' ' || p_type) AS t FROM part)")
def study_subcategories(spark, sf):
    """The seven research sub-categories, first pattern first, over titles made of part names."""
    titles = F.array(*[F.concat(F.lit(t.split("{}")[0]), "p_name", F.lit(t.split("{}")[1]))
                       for t in _STUDIES])
    return table(spark, sf, "part").select(
        "p_partkey", F.element_at(titles, (F.col("p_partkey") % len(_STUDIES) + 1).cast("int"))
        .alias("title"), "p_type").select(
        "p_partkey", X.keyword_class("title", "p_type").alias("subcategory"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'as cited' WHEN c_custkey % 3 = 0
  THEN c_mktsegment ELSE c_mktsegment || ' F' END AS cited, CASE WHEN c_custkey % 3 = 0 THEN ''
  ELSE 'Funmilola A' END AS first FROM customer""")
def cite_name(spark, sf):
    k = "c_custkey"
    people = table(spark, sf, "customer").select(
        k, F.when(S.every(k, 4), "").otherwise(F.col("c_mktsegment")).alias("surname"),
        F.when(S.every(k, 3), "Dr.").when(S.every(k, 2), "DR. prof  Funmilola A")
        .otherwise("Funmilola A").alias("first"), F.lit("as cited").alias("fallback"))
    return people.select(k, X.cite_name("surname", "first", "fallback").alias("cited"),
                         X.strip_honorifics("first").alias("first"))


@query("""SELECT doc_id, contains(lower(t), 'not found') OR contains(lower(t), 'no case note') AS missing
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' Not  found' WHEN 1 THEN 'NO case note ' || text
  ELSE text END AS t0, regexp_replace(t0, '\\s+', ' ', 'g') AS t FROM documents)""")
def missing_phrases(spark, sf):
    t = F.when(S.every("doc_id", 3), F.concat("text", F.lit(" Not  found"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("NO case note "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.is_missing_phrase(t).alias("missing"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '0' ELSE '0'
  END AS bit, CASE c_custkey % 4 WHEN 1 THEN '1' ELSE '' END AS answer,
  CASE WHEN c_nationkey < 5 THEN CAST(c_nationkey AS VARCHAR) ELSE '99' END AS code,
  CASE WHEN c_nationkey < 5 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS verbatim FROM customer""")
def null_words(spark, sf):
    raw = F.element_at(F.array(F.lit("Nil"), F.lit(" 1"), F.lit("NaN"), F.lit("n/a")),
                       (F.col("c_custkey") % 4 + 1).cast("int"))
    codes = [str(i) for i in range(5)]
    return table(spark, sf, "customer").select(
        "c_custkey", C.clear_null_words(raw, "checkbox").alias("bit"),
        C.clear_null_words(raw, "radio").alias("answer"),
        C.other_code(S.text("c_nationkey"), codes).alias("code"),
        C.other_text(S.text("c_nationkey"), codes).alias("verbatim"))


@query("""SELECT column_name AS name, regexp_replace(column_name, '___.*$', '') AS base,
  CASE WHEN column_name LIKE '%\\_\\_\\_\\_%' ESCAPE '\\' THEN '-' || regexp_replace(column_name, '^.*____', '')
       WHEN column_name LIKE '%\\_\\_\\_%' ESCAPE '\\' THEN regexp_replace(column_name, '^.*___', '') END AS code
FROM (SELECT replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '___' || p_size
  WHEN 1 THEN '____' || p_size ELSE '' END AS column_name FROM part)""")
def checkbox_names(spark, sf):
    size = S.text("p_size")
    name = F.concat(
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.when(S.every("p_size", 3), F.concat(F.lit("___"), size))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("____"), size)).otherwise(""))
    return table(spark, sf, "part").select(name.alias("name")).select(
        "name", X.checkbox_base("name").alias("base"), X.checkbox_code("name").alias("code"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
  ELSE printf('%.2f', floor(value) + 0.25) END AS shown,
  CASE WHEN event_id % 4 = 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
  ELSE 'x' || event_id END AS whole FROM events""")
def display_numbers(spark, sf):
    base = F.floor("value").cast("double")
    count = S.every("event_id", 4)
    return table(spark, sf, "events").select(
        "event_id", count.alias("c"), base.alias("v")).select(
        "event_id", C.display_number(F.when(F.col("c"), F.col("v")).otherwise(F.col("v") + 0.25),
                                     F.col("c")).alias("shown"),
        C.whole_as_integer(F.when(F.col("c"), F.concat(S.text(F.col("v").cast("long")), F.lit(".0")))
                           .otherwise(F.concat(F.lit("x"), S.text("event_id")))).alias("whole"))
