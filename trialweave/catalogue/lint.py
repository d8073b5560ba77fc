"""Dictionary and import linting. Parts stand for dictionary rows, brands for projects."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import rules as R
from . import shapes as S
from .registry import query, table

_FULL = "1, Yes | 0, No | " + " | ".join(K.MISSING_CHOICE_TEXT)


def _dictionaries(spark, sf):
    """One dictionary per brand, with something wrong wherever the part's size says so."""
    size = F.col("p_size")
    at = lambda n, value, other: F.when(size == n, value).otherwise(other)
    slug = F.replace("p_name", F.lit(" "), F.lit("_"))
    name = F.concat(slug, F.lit("_"), S.text(size % 3))
    kind = F.col("p_type")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("pos"),
        F.when(size == 7, F.concat(F.lit("1"), name)).when(size == 9, F.upper(name))
        .when(size == 11, "").when(size == 14, F.concat(name, F.lit("_with_a_very_long_suffix")))
        .when(size == 10, "hospital_number").otherwise(name).alias("field_name"),
        F.when(size == 15, "").when(size == 16, "Bad Form").when(size == 17, "tracking")
        .otherwise("visit").alias("form_name"),
        F.when(kind == "ECONOMY", "text").when(kind == "SMALL", "radio")
        .when(kind == "MEDIUM", "checkbox").when(kind == "STANDARD", "notes")
        .when(kind == "PROMO", F.when(size % 2 == 0, "yesno").otherwise("dropdown"))
        .otherwise(F.when(size % 5 == 0, "dropdwn").otherwise("calc")).alias("field_type"),
        at(20, "", F.col("p_name")).alias("field_label"),
        F.when(size % 4 == 0, "").when(size % 4 == 1, "1, Yes").when(size % 4 == 2, _FULL)
        .otherwise("1, Yes | 0, No").alias("select_choices_or_calculations"),
        F.when(size % 3 == 0, K.TEXT_MISSING_NOTE).when(size % 3 == 1, K.DATE_MISSING_NOTE)
        .otherwise("").alias("field_note"),
        F.when(size % 6 == 0, "date_dmy").when(size % 6 == 1, "integer")
        .when(size % 6 == 2, "wrong").when(size % 6 == 3, "datetime_ymd").otherwise("")
        .alias("text_validation_type_or_show_slider_number"),
        at(21, "x", F.when(size % 2 == 0, "y").otherwise("")).alias("identifier"),
        at(22, "maybe", F.lit("Y")).alias("required_field"),
        at(23, "XX", F.lit("LV")).alias("custom_alignment"),
        F.when(size == 24, "m" * 61).when(size == 25, "Bad!").when(size == 26, "grp")
        .otherwise("").alias("matrix_group_name"),
        at(27, "q", F.lit("")).alias("matrix_ranking"),
        F.when(size == 28, "[a = '1'").when(size.between(29, 40), F.concat(
            F.lit("["), slug, F.lit("_"), S.text((size + 1) % 3), F.lit("] = '1' or [nope(2)] = 1")))
        .otherwise("").alias("branching_logic"),
        (size == 41).alias("short_row"))


_DICTIONARIES_SQL = f"""raw AS (
  SELECT p_brand AS project_id, p_partkey AS pos, p_size AS z, p_type AS t, p_name AS label0,
    replace(p_name, ' ', '_') AS slug FROM part),
named AS (
  SELECT *, slug || '_' || CAST(z % 3 AS VARCHAR) AS name FROM raw),
dict AS (
  SELECT project_id, pos, z = 41 AS bad,
    CASE z WHEN 7 THEN '1' || name WHEN 9 THEN upper(name) WHEN 11 THEN ''
      WHEN 14 THEN name || '_with_a_very_long_suffix' WHEN 10 THEN 'hospital_number' ELSE name END AS field_name,
    CASE z WHEN 15 THEN '' WHEN 16 THEN 'Bad Form' WHEN 17 THEN 'tracking' ELSE 'visit' END AS form,
    CASE t WHEN 'ECONOMY' THEN 'text' WHEN 'SMALL' THEN 'radio' WHEN 'MEDIUM' THEN 'checkbox'
      WHEN 'STANDARD' THEN 'notes' WHEN 'PROMO' THEN CASE WHEN z % 2 = 0 THEN 'yesno' ELSE 'dropdown' END
      ELSE CASE WHEN z % 5 = 0 THEN 'dropdwn' ELSE 'calc' END END AS kind,
    CASE WHEN z = 20 THEN '' ELSE label0 END AS label,
    CASE z % 4 WHEN 0 THEN '' WHEN 1 THEN '1, Yes' WHEN 2 THEN '{_FULL}'
      ELSE '1, Yes | 0, No' END AS choices,
    CASE z % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'date' ELSE '' END AS note,
    CASE z % 6 WHEN 0 THEN 'date_dmy' WHEN 1 THEN 'integer' WHEN 2 THEN 'wrong'
      WHEN 3 THEN 'datetime_ymd' ELSE '' END AS validation,
    CASE WHEN z = 21 THEN 'x' WHEN z % 2 = 0 THEN 'y' ELSE '' END AS identifier,
    z, slug
  FROM named),
well AS (SELECT * FROM dict WHERE NOT bad),
heads AS (SELECT project_id, min(pos) AS head FROM dict GROUP BY project_id),
owners AS (SELECT project_id, field_name, min(pos) AS owner FROM well GROUP BY ALL),
r AS (SELECT well.*, owner, pos = head AS is_first,
    pos <> head AND kind NOT IN ('descriptive', 'calc', 'file') AND field_name <> 'hospital_number'
      AND form <> 'tracking' AS due, kind IN ('radio', 'dropdown', 'checkbox') AS coded,
    kind IN ('text', 'notes') AS written, validation LIKE 'date%' AS dated
  FROM well JOIN heads USING (project_id) JOIN owners USING (project_id, field_name)),
found AS (""" + "\nUNION ALL ".join(
    f"SELECT project_id, pos, field_name, '{sev}' AS severity, '{rule}' AS rule FROM r WHERE {cond}"
    for sev, rule, cond in (
        ("error", "first_field_not_text", "is_first AND kind <> 'text'"),
        ("error", "empty_variable_name", "field_name = ''"),
        ("error", "variable_name_starts_with_digit", "z = 7"),
        ("error", "variable_name_invalid_chars", "z = 9"),
        ("warning", "variable_name_too_long", "length(field_name) > 26"),
        ("error", "duplicate_variable_name", "pos > owner"),
        ("error", "form_name_empty", "z = 15"),
        ("error", "form_name_invalid_chars", "z = 16"),
        ("error", "invalid_field_type", "kind = 'dropdwn'"),
        ("error", "yesno_field_type_prohibited", "kind = 'yesno' AND form <> 'tracking'"),
        ("warning", "field_label_empty", "label = ''"),
        ("error", "choices_required", "coded AND choices = ''"),
        ("warning", "single_choice_select", "kind IN ('radio', 'dropdown') AND choices = '1, Yes'"),
        ("error", "invalid_validation_type", "validation = 'wrong'"),
        ("error", "validation_on_non_text_field", "validation <> '' AND kind <> 'text'"),
        ("error", "invalid_identifier_value", "z = 21"),
        ("error", "invalid_required_value", "z = 22"),
        ("error", "invalid_custom_alignment", "z = 23"),
        ("error", "matrix_group_name_too_long", "z = 24"),
        ("error", "matrix_group_name_invalid_chars", "z = 25"),
        ("error", "matrix_group_wrong_field_type",
         "z IN (24, 25, 26) AND kind NOT IN ('radio', 'checkbox')"),
        ("error", "invalid_matrix_ranking_value", "z = 27"),
        ("error", "branching_unbalanced_brackets", "z = 28"),
        ("error", "mdc_missing_in_choices", "due AND coded AND z % 4 <> 2"),
        ("warning", "redundant_mdc_in_field_note", "due AND coded AND note <> ''"),
        ("error", "mdc_date_field_has_text_format", "due AND written AND dated AND note = 'text'"),
        ("error", "mdc_date_field_missing", "due AND written AND dated AND note = ''"),
        ("error", "mdc_text_field_has_date_format",
         "due AND written AND NOT dated AND note = 'date'"),
        ("error", "mdc_text_field_missing", "due AND written AND NOT dated AND note = ''"),
    )) + """
UNION ALL SELECT project_id, pos, field_name, 'error', 'wrong_column_count' FROM dict WHERE bad
UNION ALL SELECT r.project_id, r.pos, r.field_name, 'warning', 'branching_undefined_reference'
  FROM r LEFT JOIN owners o ON o.project_id = r.project_id
    AND o.field_name = r.slug || '_' || CAST((r.z + 1) % 3 AS VARCHAR)
  WHERE r.z BETWEEN 29 AND 40 AND (o.owner IS NULL OR o.owner > r.pos)
UNION ALL SELECT project_id, pos, field_name, 'warning', 'branching_undefined_reference'
  FROM r WHERE z BETWEEN 29 AND 40)"""


def _findings(spark, sf):
    return R.lint_dictionary(_dictionaries(spark, sf), malformed="short_row")


@query(f"WITH {_DICTIONARIES_SQL} SELECT * FROM found")
def dictionary_lint(spark, sf):
    return _findings(spark, sf)


@query(f"""WITH {_DICTIONARIES_SQL}
SELECT project_id, severity, count(*) AS findings FROM found GROUP BY ALL""")
def dictionary_lint_counts(spark, sf):
    return R.lint_counts(_findings(spark, sf), ["project_id", "severity"])


@query(f"""WITH {_DICTIONARIES_SQL},
h AS (SELECT project_id, arg_min(kind, pos) AS kind, arg_min(identifier, pos) AS identifier,
    min(pos) AS pos FROM well WHERE field_name = 'hospital_number' GROUP BY project_id),
p AS (SELECT project_id, h.kind, h.identifier, h.pos FROM (SELECT DISTINCT project_id FROM well)
  LEFT JOIN h USING (project_id))
SELECT project_id, coalesce(pos, 0) AS pos, 'hospital_number' AS field_name, 'error' AS severity,
  unnest(CASE WHEN pos IS NULL THEN ['hospital_number_missing'] ELSE list_filter([
    CASE WHEN kind <> 'text' THEN 'hospital_number_not_text' END,
    CASE WHEN identifier <> 'y' THEN 'hospital_number_not_identifier' END],
    lambda x: x IS NOT NULL) END) AS rule FROM p""")
def dictionary_lint_patient_level(spark, sf):
    found = R.lint_dictionary(_dictionaries(spark, sf), patient_level=True, malformed="short_row")
    return found.where(F.col("rule").startswith("hospital_number_"))


# Fields whose logic fits the import grammar: lost_reason and mixed do not, price logic neither.
_IMPORT_LOGIC = {
    "review": "[status] = 'F' or [status] = 'O'",
    "flags": "[priority] = '1'",
    "flag_detail": "[flags(2)] = '1'",
    "mixed": "[flags(-999)] = '1'",
}


def _import_dictionary():
    from dataclasses import replace
    from ..plans.dictionary import Dictionary
    return Dictionary([replace(f, branching_logic=_IMPORT_LOGIC.get(f.field_name, ""))
                       for f in S.STUDY.fields])


_HIDDEN_SQL = S.STUDY_SQL + """,
ticks AS (SELECT *, concat_ws(',', CASE WHEN flags___1 = '1' THEN '1' END,
    CASE WHEN flags___2 = '1' THEN '2' END, CASE WHEN flags____999 = '1' THEN '-999' END) AS flags
  FROM study),
hidden AS (
  SELECT record_id, 'review' AS field, 'error' AS severity, 'hidden_value' AS rule,
    'condition is false but the value is ' || review AS note FROM ticks
  WHERE status NOT IN ('F', 'O') AND review NOT IN ('', '-888')
  UNION ALL SELECT record_id, 'flags', 'error', 'hidden_checkbox',
    'condition is false but options are ticked: ' || flags FROM ticks
  WHERE priority <> '1' AND flags <> ''
  UNION ALL SELECT record_id, 'flag_detail', 'error', 'hidden_value',
    'condition is false but the value is ' || flag_detail FROM ticks
  WHERE flags___2 <> '1' AND flag_detail <> ''
  UNION ALL SELECT record_id, 'mixed', 'error', 'hidden_value',
    'condition is false but the value is ' || mixed FROM ticks
  WHERE flags____999 <> '1' AND mixed <> ''),
codes AS (
  SELECT record_id, field, 'warn' AS severity, 'missing_code_written' AS rule,
    'missing code ' || value || ' in import; prefer blank' AS note
  FROM (SELECT record_id, status, priority, price, order_date, review, lost_reason FROM study)
  UNPIVOT (value FOR field IN (status, priority, price, order_date, review, lost_reason))
  WHERE value IN ('-666', '-777', '-888', '-999', '8888-08-08'))"""


@query(f"WITH {_HIDDEN_SQL} SELECT * FROM hidden")
def hidden_values(spark, sf):
    return R.hidden_values(S.study(spark, sf), _import_dictionary())


@query(f"WITH {_HIDDEN_SQL} SELECT * FROM codes")
def missing_code_written(spark, sf):
    return R.missing_code_written(S.study(spark, sf), "record_id")


@query(f"""WITH {_HIDDEN_SQL}
SELECT severity, rule, count(*) AS findings FROM (
  SELECT severity, rule FROM hidden UNION ALL SELECT severity, rule FROM codes
  UNION ALL SELECT 'warn', 'priced_without_date' FROM study
  WHERE price NOT IN ('', 'unknown') AND order_date = '') GROUP BY ALL""")
def import_lint_counts(spark, sf):
    """All import rules, with a rule of the study's own."""
    def own(rows):
        odd = rows.where(~F.col("price").isin("", "unknown") & (F.col("order_date") == ""))
        return odd.select("record_id", F.lit("price").alias("field"),
                          F.lit("warn").alias("severity"),
                          F.lit("priced_without_date").alias("rule"), F.lit("").alias("note"))
    found = R.lint_import(S.study(spark, sf), _import_dictionary(), semantic=own)
    return R.lint_counts(found, ["severity", "rule"])


@query(f"""WITH {S.STUDY_SQL}
SELECT record_id, 'price' AS field, 'error' AS severity, 'out_of_range' AS rule,
  'value ' || price AS note FROM study
WHERE TRY_CAST(price AS DOUBLE) < 20000 OR TRY_CAST(price AS DOUBLE) > 450000""")
def out_of_range(spark, sf):
    return R.errors_first(R.out_of_range(S.study(spark, sf), S.STUDY))
