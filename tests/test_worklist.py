import pytest
import study_fixture as fixture
from pyspark.sql import functions as F

from trialweave.operators import audit as A
from trialweave.operators import stats as T
from trialweave.operators import worklist as W
from trialweave.plans.dictionary import Dictionary, Field
from trialweave.sources import sinks


def cells(spark):
    return W.worklist_cells(fixture.frame(spark), fixture.DICTIONARY, fixture.WORKBOOKS)


def test_engineered_counts(spark):
    counts = W.worklist_counts(fixture.frame(spark), fixture.DICTIONARY, fixture.WORKBOOKS)
    got = {(r.workbook, r.site, r["mode"]): (r.gap_cells, r.uncertain_cells)
           for r in counts.collect()}
    assert got == fixture.EXPECTED


def test_counts_agree_with_cells(spark, rows):
    long = cells(spark).groupBy("workbook", "site", "mode").agg(
        F.countDistinct("syn_id").alias("rows_with_work"),
        F.count_if(F.col("flag") == "gap").alias("gap_cells"),
        F.count_if(F.col("flag") == "uncertain").alias("uncertain_cells"))
    counts = W.worklist_counts(fixture.frame(spark), fixture.DICTIONARY, fixture.WORKBOOKS)
    assert rows(long) == rows(counts, *long.columns)


def test_unreadable_logic_is_reported_once(spark):
    report = W.uncertain_logic(cells(spark), fixture.DICTIONARY).collect()
    assert [(r.field, r.cells) for r in report] == [("adjuvant_therapy", 15)]


def test_last_duplicate_is_the_record(spark):
    d = Dictionary([Field("id"), Field("a")])
    df = spark.createDataFrame([("1", "", 1), ("1", "x", 2), ("2", "y", 1), ("2", " ", 2)],
                               "id string, a string, seq int")
    out = W.worklist_cells(df, d, [W.Workbook("w", ("a",))], seq="seq")
    assert {(r.id, r.site) for r in out.collect()} == {("2", "unassigned")}


def test_checkbox_flags(spark):
    d = Dictionary([Field("id"), Field("c", field_type="checkbox",
                                       select_choices_or_calculations="1, A | -999, Other")])
    df = spark.createDataFrame([("none", "0", "0"), ("code", "0", "1"), ("real", "1", "1")],
                               "id string, c___1 string, c____999 string")
    out = W.worklist_cells(df, d, [W.Workbook("w", ("c", "unknown_field"))])
    assert sorted((r.id, r["mode"], r.reason) for r in out.collect()) == [
        ("code", "with_MDC", "sentinel"), ("none", "no_MDC", "blank"), ("none", "with_MDC", "blank")]


def test_sheet_puts_gates_first_in_dictionary_order(spark):
    sheet = W.worklist_sheet(fixture.frame(spark), fixture.DICTIONARY, fixture.WORKBOOKS[1],
                             W.WITH_CODES)
    assert sheet.columns == ["syn_id", "site", "Sex", "Follow-up status", "Pregnancy status",
                             "Recurrence site", "flags", "RESPONSE"]
    assert sheet.where("site = 'site_alpha'").count() <= 13


def test_rewriting_a_round_replaces_only_that_round(spark, tmp_path):
    path, long = str(tmp_path / "worklists"), cells(spark)
    sinks.write_worklists(long, path, "r1")
    sinks.write_worklists(long.where("site = 'site_alpha'"), path, "r2")
    sinks.write_worklists(long, path, "r1")
    back = spark.read.parquet(path)
    got = {r["round"]: r["count"] for r in back.groupBy("round").count().collect()}
    assert got == {"r1": long.count(), "r2": long.where("site = 'site_alpha'").count()}
    one = spark.read.parquet(path).where("round = 'r1' and site = 'site_beta'")
    assert "PartitionFilters: [isnotnull(round" in one._jdf.queryExecution().toString()


def test_round_trip_of_a_returned_worklist(spark, rows):
    """Answers in gaps, in uncertain cells and out of scope are all reported; notes alone too."""
    sent = spark.createDataFrame([
        ("1", "Grade", "", "gap"), ("1", "Margin", "Clear", None), ("2", "Grade", "", "gap"),
        ("2", "Therapy", "", "uncertain"), ("3", "Grade", "", "gap"), ("4", "Margin", "Close", None)],
        "record_id string, field string, value string, flag string")
    back = spark.createDataFrame([
        ("1", "Grade", " Well "), ("1", "Margin", "Clear"), ("2", "Grade", ""),
        ("2", "Therapy", "Yes"), ("3", "Grade", ""), ("4", "Margin", "")],
        "record_id string, field string, value string")
    notes = spark.createDataFrame([("1", "ok"), ("3", "resolved"), ("2", ""), ("4", "care elsewhere")],
                                  "record_id string, note string")
    changes = A.returned_audit(sent, back)
    assert rows(changes, "record_id", "field", "returned", "outcome") == [
        ("1", "Grade", "Well", "answer"), ("2", "Therapy", "Yes", "uncertain_answer"),
        ("4", "Margin", "", "out_of_scope")]
    alone = A.note_only(notes, changes)
    assert rows(alone) == [("3", "resolved"), ("4", "care elsewhere")]
    triaged = A.triage(changes, spark.createDataFrame([("2", "Therapy")], "record_id string, field string"), alone)
    assert rows(triaged) == [("1", "Grade", "READY"), ("2", "Therapy", "QUESTION"),
                             ("3", "", "VERIFY"), ("4", "", "NO_ACTION")]


def test_single_id_column_sheet(spark, rows):
    sheet = spark.createDataFrame([("7", "x", " n ")], "id string, `Clinical notes` string, RESPONSE string")
    assert rows(A.sheet_cells(sheet, ["id"])) == [("7", "Clinical notes", "x")]
    assert rows(A.sheet_notes(sheet, ["id"])) == [("7", "n")]
    assert A.response_columns(sheet.columns) == ["RESPONSE"]
    assert A.response_columns(sheet.columns, loose=True) == ["Clinical notes", "RESPONSE"]


def test_table1_invariants(spark):
    long = T.table1(fixture.frame(spark), fixture.DICTIONARY, [], ["sex", "histology_grade"])
    value = {(r.variable, r.level, r.statistic, r.column): r.value for r in long.collect()}
    for column, n in (("site_alpha", 120), ("site_beta", 80), ("overall", 200)):
        assert value["records", "", "n", column] == n
        levels = [v for (var, lvl, s, c), v in value.items()
                  if (var, s, c) == ("histology_grade", "n", column)]
        assert sum(levels) + value["histology_grade", "", "missing", column] == n
    assert [value["histology_grade", "", "missing", c]
            for c in ("site_alpha", "site_beta", "overall")] == [15, 9, 24]
    wide = T.table1_wide(long)
    assert wide.columns == ["variable", "level", "statistic", "site_alpha", "site_beta", "overall"]


def test_blank_site_counts_overall_only(spark):
    d = Dictionary([Field("id"), Field("x"), Field("y", field_type="yesno")])
    df = spark.createDataFrame([("1", "", "2", "1"), ("2", "s", "4", "5"), ("3", "s", "bad", "666")],
                               "id string, redcap_data_access_group string, x string, y string")
    value = {(r.variable, r.level, r.statistic, r.column): r.value
             for r in T.table1(df, d, ["x"], ["y"]).collect()}
    assert {k[3] for k in value} == {"s", "overall"}
    assert value["x", "", "n", "overall"] == 2 and value["x", "", "missing", "s"] == 1
    assert value["x", "", "sd", "s"] is None
    # The denominator holds every usable value, also a code the dictionary does not list.
    assert value["y", "Yes", "pct", "overall"] == 50.0 and value["y", "Yes", "pct", "s"] == 0.0


@pytest.mark.parametrize("counts", [False, True])
def test_wide_dictionaries_keep_methods_small(spark, counts):
    """No method of 96 conditioned fields passes the 8,000 bytes that the JVM compiles."""
    logic = lambda i: f"[c{i // 2}] = '1' and [c{i // 3}] <> '2' or [c{i // 4}] > 3" if i else ""
    fields = [Field("record_id", "f")] + [Field(f"c{i}", "f", branching_logic=logic(i)) for i in range(96)]
    # rows that Spark has to compute, so that nothing is folded before code is generated
    records = spark.range(8).select(F.col("id").cast("string").alias("record_id"), *[
        (F.col("id") % (i % 5 + 2)).cast("string").alias(f"c{i}") for i in range(96)])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        books = [W.Workbook("w", tuple(f.field_name for f in fields[1:]))]
        plan = (W.worklist_counts if counts else W.worklist_cells)(records, Dictionary(fields), books)._jdf
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        found = debug.codegenStringSeq(plan.queryExecution().executedPlan())
        sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
        assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
