import pytest

from trialweave.functions.cells import norm_value
from trialweave.operators import diff as D
from trialweave.operators import linkage as L
from trialweave.operators import matching as M
from trialweave.sources import readers as R
from trialweave.sources import sinks


def make(spark, cols, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in cols))


@pytest.fixture()
def diff(spark):
    computed = make(spark, ("id", "redcap_data_access_group", "a", "b", "extra"),
                    ("1", "x", "X", "NEW", "q"), ("2", "x", "same", "", "q"),
                    ("3", "x", "1.0", "OLD2", "q"), ("9", "x", "Y", "Z", "q"))
    current = make(spark, ("id", "redcap_data_access_group", "b", "a"),
                   ("1", "z", "OLD", ""), ("2", "z", "keep", "same"), (" 3", "z", "OLD", "01"),
                   ("4", "z", "k", "k"))
    return D.CellDiff(computed, current, "id")


def test_payloads(diff, rows):
    assert diff.fields == ["a", "b"]
    assert rows(diff.updates()) == [("1", "X", "")]
    assert rows(diff.conflicts()) == [("1", "b", "OLD", "NEW"), ("3", "b", "OLD", "OLD2")]
    assert rows(diff.overwrites()) == [("1", "", "NEW"), ("3", "", "OLD2")]
    assert rows(diff.orphans()) == [("9", "Y", "Z")]
    assert rows(diff.gaps()) == [("4",)]
    assert tuple(diff.record_counts().first()) == (1, 2, 1, 1)


def test_every_cell_is_counted_once(diff):
    counts = {(r.field, r.verdict): r.cells for r in diff.counts().collect()}
    assert sum(counts.values()) == 8
    assert counts["a", "orphan"] == counts["b", "orphan"] == 1


def test_last_row_of_a_repeated_id_wins(spark, rows):
    old = spark.createDataFrame([("1", "", 1), ("1", "kept", 2)], "id string, a string, seq int")
    new = spark.createDataFrame([("1", "first", 1), ("1", "kept", 2)], "id string, a string, seq int")
    d = D.CellDiff(new, old, "id", seq="seq")
    assert rows(d.cells()) == [("1", "a", "kept", "kept", "noop")]


def test_repeated_ids_do_not_multiply(spark, rows):
    old = make(spark, ("id", "a"), *[("1", str(i)) for i in range(9)])
    new = make(spark, ("id", "a"), *[("1", str(i)) for i in range(7)])
    assert rows(D.CellDiff(new, old, "id").cells()) == [("1", "a", "8", "6", "conflict")]
    assert D.verify_live(new, old, "id").count() == 7


def test_no_shared_fields_is_refused(spark):
    with pytest.raises(ValueError):
        D.CellDiff(make(spark, ("id", "a"), ("1", "x")), make(spark, ("id", "b"), ("1", "x")), "id")


def test_triplet_files(spark, diff, tmp_path, rows):
    paths = sinks.write_triplet(diff, str(tmp_path), "link")
    back = R.read_export(spark, paths["update"])
    assert back.columns == ["id", "a", "b"] and rows(back) == [("1", "X", "")]


def test_verify_live_modes(spark, rows):
    planned = make(spark, ("id", "a", "b"), ("1", "0", "1.0"), ("2", "", "x"), ("3", "v", "w"))
    live = make(spark, ("id", "a"), ("1", "1"), ("2", "1"))
    take = lambda m: rows(D.verify_live(planned, live, "id", m), "id", "field", "outcome")
    safe = take("safe")
    assert ("1", "a", "conflict") in safe and ("2", "b", "keep") in safe and len(safe) == 5
    assert ("1", "a", "keep") in take("reference")


def test_fingerprint_ignores_order_and_sees_every_edit(spark):
    data = [(str(i), f"v{i}") for i in range(50)]
    df = spark.createDataFrame(data, "id string, v string")
    code = lambda d, target="t": D.fingerprint(d, target).first().code
    base = code(df)
    assert base == code(df.repartition(7)) == code(df.orderBy("v"))
    assert base != code(df, "u")
    assert base != code(spark.createDataFrame(data[:-1] + [("49", "v50")], "id string, v string"))
    assert base != code(df.union(df.limit(1)))


def test_master_has_one_row_per_entity_even_with_repeats_on_both_sides(spark, rows):
    left = make(spark, ("k", "v"), *[("hot", str(i)) for i in range(30)], ("only_left", "1"), ("", "z"))
    right = make(spark, ("key", "w"), *[("hot", str(i)) for i in range(20)], ("only_right", "2"))
    a, b = L.Source("a", left, ["k"], ["v"]), L.Source("b", right, ["key"], ["w"])
    master = L.link_master([a, b], ["id"])
    assert rows(master, "id", "a_linked", "b_linked", "a_rows", "b_rows") == [
        ("hot", True, True, 30, 20), ("only_left", True, False, 1, 0),
        ("only_right", False, True, 0, 1)]
    assert rows(L.missing_link(a, ["id"])) == [("", "z")]
    assert rows(L.orphan_rows(a, b, ["id"])) == [("only_left", "a"), ("only_right", "b")]
    worst = [tuple(r) for r in L.worst_first(L.integrity(master, ["id"], ["a", "b"]), ["id"]).collect()]
    assert worst[0] == ("hot", "duplicate", "a", 30)
    plan = master._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Join" not in plan


def test_csv_sources(spark, tmp_path, rows):
    (tmp_path / "r.csv").write_text('id,code,note\n1,01,"two\nlines"\n2,,"say ""hi"""\n3,"",  x \n')
    df = R.read_export(spark, str(tmp_path / "r.csv"))
    assert rows(df) == [("1", "01", "two\nlines"), ("2", "", 'say "hi"'), ("3", "", "  x ")]
    (tmp_path / "ids.csv").write_text("anything,b\n 7 ,x\n8,y\n")
    assert rows(R.read_scope_ids(spark, str(tmp_path / "ids.csv"))) == [("7",), ("8",)]
    (tmp_path / "t.json").write_text('[{"record_id": 1, "done": null}, {"record_id": "2", "done": "Yes"}]')
    assert rows(R.read_json_records(spark, str(tmp_path / "t.json"), ["record_id", "done"])) == [
        ("1", ""), ("2", "Yes")]


def test_drafts_with_different_columns(spark, tmp_path, rows):
    (tmp_path / "Ife_core_one.csv").write_text("id,a\n1,x\n")
    (tmp_path / "oyo.csv").write_text("id,b\n2,y\n")
    df = R.read_drafts(spark, str(tmp_path))
    assert df.columns == ["site", "workbook", "id", "a", "b"]
    assert rows(df) == [("ife", "core_one", "1", "x", ""), ("oyo", "", "2", "", "y")]


def test_snapshots(spark, tmp_path, rows):
    from trialweave.operators.queues import latest_before
    path = str(tmp_path / "snaps")
    for stamp, v in (("2024-01-01T00", "a"), ("2024-01-08T00", "b"), ("2024-01-15T00", "c")):
        sinks.write_snapshot(make(spark, ("v",), (v,)), path, stamp)
    snaps = sinks.read_snapshots(spark, path)
    assert rows(latest_before(snaps), "v") == [("c",)]
    assert rows(latest_before(snaps, before="2024-01-15T00"), "v") == [("b",)]


def test_a_round_written_again_loses_sites_without_work(spark, tmp_path):
    cells = lambda *sites: make(spark, ("mode", "workbook", "site", "record_id"),
                                *[("m", "w", s, "1") for s in sites])
    path = str(tmp_path / "lists")
    sinks.write_worklists(cells("007", "008"), path, "r1")
    sinks.write_worklists(cells("009"), path, "r 2/b")
    sinks.write_worklists(cells("007"), path, "r1")
    back = sinks.read_snapshots(spark, path)
    assert sorted((r["round"], r.site) for r in back.collect()) == [("r 2/b", "009"), ("r1", "007")]
    assert dict(back.dtypes)["site"] == "string"


def test_snapshots_are_replaced_by_stamp(spark, tmp_path, rows):
    path = str(tmp_path / "snaps")
    frame = lambda *sites: make(spark, ("site", "v"), *[(s, "x") for s in sites])
    sinks.write_snapshot(frame("01", "02"), path, "2024-01-01", ["site"])
    sinks.write_snapshot(frame("01"), path, "2024-01-02", ["site"])
    sinks.write_snapshot(frame("02"), path, "2024-01-01", ["site"])
    assert rows(sinks.read_snapshots(spark, path), "snapshot_ts", "site", "v") == [
        ("2024-01-01", "02", "x"), ("2024-01-02", "01", "x")]


def test_input_order_of_a_file(spark, tmp_path, rows):
    path = tmp_path / "records.csv"
    path.write_text("id,a\n1,first\n2,only\n1,\"la\nst\"\n")
    records = R.read_export(spark, str(path), seq="seq")
    assert rows(R.keyed(records, "id", "seq"), "id", "a") == [("1", "la\nst"), ("2", "only")]
    plain = tmp_path / "plain.csv"
    plain.write_text("id,a\n" + "".join(f"{i % 50},{i}\n" for i in range(500)))
    split = R.read_export(spark, str(plain), multiline=False, seq="seq")
    assert {r.id: r.a for r in R.keyed(split, "id", "seq").collect()} == {
        str(i): str(450 + i) for i in range(50)}


def test_drafts_take_names_as_written(spark, tmp_path):
    (tmp_path / "My Site_core.csv").write_text("record_id,a\n1,x\n")
    (tmp_path / "b+c_more_parts.csv").write_text("record_id,b\n2,y\n")
    got = R.read_drafts(spark, str(tmp_path))
    assert got.columns[:3] == ["site", "workbook", "record_id"]
    assert sorted((r.site, r.workbook, r.record_id, r.a, r.b) for r in got.collect()) == [
        ("b+c", "more_parts", "2", "", "y"), ("my site", "core", "1", "x", "")]


def test_text_ids_are_kept_and_repeats_numbered(spark):
    df = spark.createDataFrame([("A1", 1), ("7", 2), ("A1", 3), ("7", 4)], "id string, at long")
    got = {r["at"]: (r["new_id"], r.renumbered) for r in M.renumber_duplicates(df, "id", ["at"]).collect()}
    assert got == {1: (None, False), 2: (7, False), 3: (8, True), 4: (9, True)}


@pytest.mark.parametrize("text, want", [
    ("1e16", "10000000000000000"), ("-2.50e15", "-2500000000000000"), ("1e38", "1e38"),
    ("1234567890123456.50", "1234567890123456.5"), ("0.10", "0.1"), ("00012345678901234567890", "12345678901234567890"),
])
def test_wide_numbers(spark, text, want):
    got = make(spark, ("a",), (text,)).select(norm_value("a").alias("x")).first().x
    assert got == want
