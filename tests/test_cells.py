import pytest
from pyspark.sql import functions as F

from trialweave.functions import cells as C, dates as D, text as X


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("x")).first().x


@pytest.mark.parametrize("value, want", [
    ("1", "1"), ("1.0", "1"), (" 2 ", "2"), ("01", "1"), ("000", "0"), ("-0", "0"), ("+7.", "7"),
    ("-5.00", "-5"), ("nan", ""), ("NaN", ""), (None, ""), ("   ", ""), ("  Ibadan  ", "Ibadan"),
    ("1.50", "1.5"), (".5", "0.5"), ("1e3", "1000"), ("12345678.9", "12345678.9"),
    ("123456789012345678901", "123456789012345678901"), ("inf", "inf"), ("1_000", "1_000"),
    ("1d", "1d"), ("0x10", "0x10"), ("1e400", "1e400"), ("\t3\n", "3"), ("0.00", "0"),
])
def test_norm(spark, value, want):
    assert one(spark, value, C.norm_value) == want


@pytest.mark.parametrize("current, computed, want", [
    ("", "X", "fill"), ("E", "N", "conflict"), ("same", "same", "noop"), ("REAL", "", "noop"),
    ("", "", "noop"), ("1", "1.0", "noop"), ("nan", "X", "fill"), ("1", "2", "conflict"),
])
def test_classify(spark, current, computed, want):
    df = spark.createDataFrame([(current, computed)], "a string, b string")
    assert df.select(C.classify("a", "b")).first()[0] == want


def test_keys_keep_zeros_unless_asked(spark):
    assert one(spark, " 007 ", C.norm_key) == "007"
    assert one(spark, " 007 ", lambda c: C.norm_key(c, "numeric")) == "7"
    with pytest.raises(ValueError):
        C.norm_key("v", "other")


@pytest.mark.parametrize("value, want", [
    ("2024-02-29", "2024-02-29"), ("1/2/2024", "2024-02-01"), ("13/12/2024", "2024-12-13"),
    ("12/13/2024", "2024-12-13"), ("5 mar 2024", "2024-03-05"), ("5 March 2024", "2024-03-05"),
    ("Mar 5 2024", "2024-03-05"), ("MAY 5 2024", "2024-05-05"), ("31.12.2023", "2023-12-31"),
    ("2024/1/2", "2024-01-02"), ("31/31/2024", None), ("30-02-2024", None), ("soon", None),
    ("13-12-24", None), ("5 Marc 2024", None), ("2024", None), ("1-2/2024", None),
])
def test_parse_any(spark, value, want):
    assert one(spark, value, D.parse_any) == want


@pytest.mark.parametrize("value, want", [
    ("", ""), ("N/A", ""), ("nil", ""), ("1-8-2015", "2015-08-01"), ("2015/8/1", "2015-08-01"),
    ("08-08-8888", "8888-08-08"), ("tomorrow", None),
])
def test_parse_import(spark, value, want):
    assert one(spark, value, D.parse_import) == want


def test_sentinels_never_become_dates(spark):
    assert one(spark, "8888-08-08", D.stored_date) is None
    assert one(spark, "08-08-8888", D.sentinel_to_import) == "8888-08-08"
    assert one(spark, "2020-01-01", lambda c: D.is_expired(c, "2020-01-02")) is True
    assert one(spark, "bad", lambda c: D.is_expired(c, "2020-01-02")) is False


def test_site_dates(spark):
    raw = "Ife: 1/2/24\nLagos: 31/02/2024; Oyo : 03.04.2025 renewed\nno date\nJos: 1/1/1850"
    got = one(spark, raw, D.site_dates)
    assert [(r.site, r.date) for r in got] == [("Ife", "2024-02-01"), ("Oyo", "2025-04-03")]
    assert one(spark, raw, D.site_dates_rejected) == 2
    many = ";".join(f"S{i}: 1/1/20" for i in range(12))
    assert len(one(spark, many, D.site_dates)) == 12
    assert len(one(spark, many, lambda c: D.site_dates(c, keep=10))) == 10


def test_choices(spark):
    got = one(spark, "1, Yes, of course | 0,No|bare| 1, Again", X.choice_map)
    assert got == {"1": "Again", "0": "No"}
    assert one(spark, "1, Yes, of course", X.choice_map) == {"1": "Yes, of course"}


def test_names_and_labels(spark):
    assert one(spark, "  Age \n at visit ?: ", X.clean_label) == "Age at visit"
    assert one(spark, "Dr. PROF  Ada B", X.strip_honorifics) == "Ada B"
    assert one(spark, "Drew", X.strip_honorifics) == "Drew"
    assert one(spark, "H-00 12/a", X.hospital_key) == "h0012a"
    assert one(spark, "-0999", X.hospital_key) is None
    assert one(spark, "case not CAN  not be found", X.is_missing_phrase) is True
    assert one(spark, "a____99", X.checkbox_code) == "-99"
    assert one(spark, "a___9", X.checkbox_code) == "9"
    assert one(spark, "plain", X.checkbox_code) is None
    assert one(spark, "A retrospective review", X.keyword_class) == "Epidemiology"
    assert one(spark, "Éai", X.keyword_class) == "(unclear — ask user)"


def test_literal_split_keeps_what_is_written(spark):
    df = spark.createDataFrame([("12, Broad St",), ("a,b,c,d",)], "v string")
    got = [tuple(r) for r in df.select(*X.literal_parts("v", ["x", "y", "z"])).collect()]
    assert got == [("12", "Broad St", ""), ("a", "b", "c,d")]


def test_null_words(spark):
    assert one(spark, "Nil", lambda c: C.clear_null_words(c, "checkbox")) == "0"
    assert one(spark, "NaN", lambda c: C.clear_null_words(c, "text")) == ""
    assert one(spark, "x", lambda c: C.other_code(c, ["1"])) == "99"
    assert one(spark, "x", lambda c: C.other_text(c, ["1"])) == "x"
    assert one(spark, "2.5", lambda c: C.display_number(F.col(c).cast("double"), False)) == "2.50"
