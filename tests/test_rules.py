import csv
import io
from collections import Counter

import pytest

from trialweave.functions import constants as K
from trialweave.operators import ingest as I
from trialweave.operators import rules as R
from trialweave.plans.dictionary import Dictionary, Field
from trialweave.sources.readers import read_dictionary

TEXT, DATE = K.TEXT_MISSING_NOTE, K.DATE_MISSING_NOTE
FULL = "1, Yes | 0, No | " + " | ".join(K.MISSING_CHOICE_TEXT)
H = {v: k for k, v in K.DICTIONARY_HEADERS.items()}


def row(name, kind="text", form="visit", label="A label", **more):
    base = dict(field_name=name, form_name=form, field_type=kind, field_label=label)
    if kind in ("text", "notes"):
        base["field_note"] = TEXT
    if kind in ("radio", "dropdown", "checkbox"):
        base["select_choices_or_calculations"] = FULL
    return {**base, **more}


CHECK = "text_validation_type_or_show_slider_number"
DIRTY = [
    (row("reg_id", "radio"), ["first_field_not_text"]),
    (row(""), ["empty_variable_name"]), (row("1st"), ["variable_name_starts_with_digit"]),
    (row("Upper"), ["variable_name_invalid_chars"]),
    (row("a_name_that_is_far_too_long"), ["variable_name_too_long"]),
    (row("twice"), []), (row("twice"), ["duplicate_variable_name"]),
    (row("f1", form=""), ["form_name_empty"]), (row("f2", form="Bad Form"), ["form_name_invalid_chars"]),
    (row("t1", "dropdwn"), ["invalid_field_type"]), (row("t2", "yesno"), ["yesno_field_type_prohibited"]),
    (row("t3", "yesno", form="tracking"), []), (row("l1", label=""), ["field_label_empty"]),
    (row("c1", "radio", select_choices_or_calculations=""),
     ["choices_required", "mdc_missing_in_choices"]),
    (row("c2", "dropdown", form="tracking", select_choices_or_calculations="1, One"),
     ["single_choice_select"]),
    (row("v1", **{CHECK: "datex", "field_note": DATE}), ["invalid_validation_type"]),
    (row("v2", "notes", **{CHECK: "integer"}), ["validation_on_non_text_field"]),
    (row("i1", identifier="x"), ["invalid_identifier_value"]),
    (row("r1", required_field="maybe"), ["invalid_required_value"]),
    (row("a1", custom_alignment="XX"), ["invalid_custom_alignment"]),
    (row("m1", "radio", matrix_group_name="m" * 61), ["matrix_group_name_too_long"]),
    (row("m2", "radio", matrix_group_name="Bad!"), ["matrix_group_name_invalid_chars"]),
    (row("m3", matrix_group_name="grp"), ["matrix_group_wrong_field_type"]),
    (row("m4", "radio", matrix_ranking="q"), ["invalid_matrix_ranking_value"]),
    (row("b1", branching_logic="[twice = '1'"), ["branching_unbalanced_brackets"]),
    (row("b2", branching_logic="[later] = '1' or [b2(3)] = '1'"), ["branching_undefined_reference"]),
    (row("later"), []),
    (row("n1", "checkbox", select_choices_or_calculations="1, A | 2, B"), ["mdc_missing_in_choices"]),
    (row("n2", "radio", field_note=TEXT), ["redundant_mdc_in_field_note"]),
    (row("n3", **{CHECK: "date_dmy"}), ["mdc_date_field_has_text_format"]),
    (row("n4", **{CHECK: "date_dmy", "field_note": ""}), ["mdc_date_field_missing"]),
    (row("n5", field_note=DATE), ["mdc_text_field_has_date_format"]),
    (row("n6", field_note="see 12-666"), ["mdc_text_field_missing"]),
    (row("hospital_number", field_note="", identifier="y"), []),
    (row("x1", "calc", field_note=""), []),
]


def write(path, rows, extra=None):
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(K.DICTIONARY_HEADERS)
    for r in rows:
        w.writerow([r.get(c, "") for c in K.DICTIONARY_COLUMNS])
    if extra:
        w.writerow(extra)
    path.write_text(out.getvalue())


def test_every_rule_fires_exactly_where_engineered(spark, tmp_path):
    write(tmp_path / "dd.csv", [r for r, _ in DIRTY], ["short", "row"])
    from pyspark.sql import functions as F
    df = read_dictionary(spark, str(tmp_path / "dd.csv")).withColumn("project_id", F.lit("p"))
    assert df.columns[1:19] == list(K.DICTIONARY_COLUMNS)
    found = R.lint_dictionary(df, malformed="malformed").collect()
    got = sorted((r.pos, r.rule) for r in found)
    want = sorted([(i, rule) for i, (_, rules) in enumerate(DIRTY) for rule in rules]
                  + [(len(DIRTY), "wrong_column_count")])
    assert got == want
    severity = Counter(r.severity for r in found)
    assert severity["warning"] == 5


def test_patient_level(spark):
    from pyspark.sql import functions as F
    make = lambda rows: Dictionary.from_rows(rows).to_frame(spark).withColumn("project_id", F.lit("p"))
    rules = lambda rows: sorted(r.rule for r in R.lint_dictionary(make(rows), patient_level=True).collect())
    assert rules([row("id")]) == ["hospital_number_missing"]
    assert rules([row("id"), row("hospital_number", "notes")]) == [
        "hospital_number_not_identifier", "hospital_number_not_text"]


def test_enriched_dictionary_lints_clean(spark):
    from pyspark.sql import functions as F
    plain = Dictionary([
        Field("synb_id", "s", field_label="ID"), Field("seen", "s", field_label="Seen",
              text_validation_type_or_show_slider_number="datetime_ymd"),
        Field("sex", "s", field_type="radio", field_label="Sex", select_choices_or_calculations="1, M | 2, F"),
        Field("notes", "s", field_type="notes", field_label="Notes"),
        Field("tick", "s", field_type="checkbox", field_label="Tick"),
        Field("hospital_number", "s", field_label="HN")])
    df = plain.with_missing_codes().to_frame(spark).withColumn("project_id", F.lit("p"))
    assert R.lint_dictionary(df).count() == 0
    one = spark.createDataFrame([("x",)], "a string")
    rules = lambda rows, width: [r.rule for r in R.lint_file(rows, range(width)).collect()]
    assert rules(one, 18) == [] and rules(one, 1) == ["wrong_header_count"]
    assert rules(one.where("a is null"), 3) == ["wrong_header_count", "no_data_rows"]


def test_import_rules(spark, rows):
    d = Dictionary([
        Field("id"), Field("p", field_type="radio", select_choices_or_calculations="1, A | 2, B"),
        Field("c", branching_logic="[p] = '1'"),
        Field("k", field_type="checkbox", select_choices_or_calculations="1, X | -999, O",
              branching_logic="[p] = '2' or [k(1)] = 'never'"),
        Field("skipped", branching_logic="[p] = '1' and [c] = '2'"),
        Field("n", text_validation_type_or_show_slider_number="integer", text_validation_min="0",
              text_validation_max="10")])
    df = spark.createDataFrame(
        [("1", "1", "v", "1", "0", "x", "11"), ("2", "2", "v", "1", "0", "x", "-999"),
         ("3", "2", "-888", "0", "1", "", "5"), ("4", "2", "8888-08-08", "0", "0", "", "-1")],
        "id string, p string, c string, k___1 string, `k___-999` string, skipped string, n string")
    assert rows(R.hidden_values(df, d), "record_id", "field", "rule") == [
        ("1", "k", "hidden_checkbox"), ("2", "c", "hidden_value"), ("4", "c", "hidden_value")]
    assert rows(R.missing_code_written(df, "id"), "record_id", "field") == [
        ("2", "n"), ("3", "c"), ("4", "c")]
    assert rows(R.out_of_range(df, d), "record_id", "note") == [("1", "value 11"), ("4", "value -1")]
    assert R.rejected_columns(df.columns) == ["k___-999"]
    own = lambda r: r.selectExpr("id as record_id", "'p' as field", "'warn' as severity",
                                 "'own' as rule", "'' as note")
    found = R.lint_import(df, d, semantic=own)
    assert Counter(r.rule for r in found.collect()) == {
        "hidden_checkbox": 1, "hidden_value": 2, "missing_code_written": 3, "rejected_column": 1, "own": 4}
    first = R.errors_first(found).first()
    assert first.severity == "error" and first.record_id == "(header)"


def test_labels_and_aliases(spark, rows):
    d = Dictionary([Field("id", field_label="ID"), Field("a", field_label="Same label?"),
                    Field("b", field_label=" same  label", field_type="yesno")])
    assert rows(I.label_clashes(spark, d), "field", "owner") == [("b", "a")]
    with pytest.raises(ValueError):
        Dictionary([Field("x", field_label="L"), Field("y", field_label="L?")]).label_map()
    d2 = Dictionary([Field("id"), Field("c", field_label="C", field_type="checkbox",
                     select_choices_or_calculations="1, Late | -9, Other")])
    answers = spark.createDataFrame([("1", "c", "late, other,,nope"), ("2", "C", "tardy"), ("3", "C", " , ")],
                                    "record_id string, header string, value string")
    out = I.translate_cells(answers, d2, {"c": {"Tardy": "late"}})
    assert rows(I.payload(out)) == [("1", "c___1", "1"), ("1", "c____9", "1"), ("2", "c___1", "1")]
    assert rows(I.issues(out)) == [("1", "c", "late, other,,nope", "checkbox option 'nope' not a choice")]


def test_contradictory_answers_are_reported_and_never_guessed(spark, rows):
    d = Dictionary([Field("id"), Field("sex", field_type="radio", field_label="Sex",
                                       select_choices_or_calculations="1, Male | 2, Female"),
                    Field("note", field_label="Note")])
    said = [("1", "Sex", "male"), ("1", "Sex", "Female"), ("1", "Note", "seen"), ("1", "Note", "seen"),
            ("2", "Sex", "female"), ("2", "Sex", "Female "), ("3", "Sex", "male"), ("3", "Sex", "female")]
    out = I.translate_cells(spark.createDataFrame(said, "record_id string, header string, value string"), d)
    assert rows(I.contradictions(out)) == [("1", "sex", "1", "2", 2), ("3", "sex", "1", "2", 2)]
    assert rows(I.payload(out)) == [("1", "note", "seen"), ("2", "sex", "2")]
    assert rows(I.payload_wide(out, d), "id", "sex", "note") == [("1", "", "seen"), ("2", "2", "")]
    assert I.contradictions(out.limit(0)).count() == 0
