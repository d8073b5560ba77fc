import numpy as np
import pytest


from trialweave.catalogue.queues import QUEUES
from trialweave.functions import constants as K
from trialweave.operators import admin, queues as Q, stats as T


def snap(spark, *rows):
    return spark.createDataFrame(list(rows), "queue string, record_id string, status string")


def test_snapshot_changes(spark, rows):
    before = snap(spark, ("q", "1", "open"), ("q", "2", "done"), ("q", "3", "open"), ("q", "4", "done"),
                  ("q", "5", "open"), ("only_before", "1", "open"))
    now = snap(spark, ("q", "1", "open"), ("q", "2", "open"), ("q", "3", "done"), ("q", "4", "done"),
               ("q", "6", "open"), ("q", "7", "done"), ("only_now", "1", "open"))
    assert rows(Q.queue_diff(before, now)) == [
        ("q", "1", "still_open", False), ("q", "2", "reopened", False), ("q", "3", "newly_done", False),
        ("q", "4", "still_done", False), ("q", "5", "vanished", False), ("q", "6", "new_open", False),
        ("q", "7", "newly_done", True)]


def test_open_and_progress(spark):
    cols = ["queue", "completed", *K.BUILD_STEPS]
    data = [("build", "Yes", *["Yes"] * 3, "Prospective study, not required", "", "No", ""),
            ("build", "", *[""] * 7),
            ("build", "", *["Yes"] * 6, " Yes "),
            ("extract", " Yes", *[""] * 7)]
    df = Q.with_status(spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols)),
                       tuple(QUEUES.values()))
    got = [(r.status, r.s, r.l) for r in df.select(
        "status", Q.progress(strict=True).alias("s"), Q.progress().alias("l")).collect()]
    assert got == [("open", "3/7", "4/7"), ("open", "0/7", "0/7"), ("done", "7/7", "7/7"),
                   ("done", "0/7", "0/7")]
    counts = {r.queue: (r.total, r.open, r.done) for r in Q.queue_counts(df, ["queue"]).collect()}
    assert counts == {"build": (3, 2, 1), "extract": (1, 0, 1)}
    hist = {(r.rule, r.steps): r.records for r in Q.progress_histogram(df).collect()}
    assert hist["strict", 3] == hist["lenient", 4] == 1 and hist["strict", 0] == 2


@pytest.mark.parametrize("text, want", [("1-108", (1, 108)), (" 5 - 7 ", (5, 7))])
def test_id_range(text, want):
    assert Q.parse_id_range(text) == want


@pytest.mark.parametrize("text", ["9-3", "abc", "", "1", "1-2-3", "-4"])
def test_bad_id_range(text):
    with pytest.raises(ValueError):
        Q.parse_id_range(text)


def test_queue_lines(spark):
    df = spark.createDataFrame([("Ada", "B", "UCH", "PI")],
                               "first_name string, last_name string, institution string, user_role string")
    line = lambda q: df.select(Q.queue_summary(QUEUES[q], df.columns)).first()[0]
    assert line("people") == "Ada B → UCH (PI)"
    assert line("linkage") == "For ? — needed by ?"


def test_quartiles_and_ranks_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    values = {"a": np.where(rng.random(300) < 0.4, 7.0, rng.integers(0, 30, 300)),
              "b": rng.integers(0, 25, 250).astype(float)}
    data = [(g, f"{v:g}") for g, vs in values.items() for v in vs] + [("a", ""), ("b", "-999")]
    df = spark.createDataFrame(data, "g string, v string").repartition(6)
    for r in T.quartiles(df, "g", "v").collect():
        assert r.n == len(values[r.group])
        assert np.allclose([r.q1, r.median, r.q3], np.percentile(values[r.group], [25, 50, 75]))
    out = T.mann_whitney(df, "g", "v", "a", "b").first()
    a, b = values["a"], values["b"]
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    assert out.u1 == pytest.approx(u) and (out.n1, out.n2) == (300, 250)


def test_migration_never_touches_filled_records(spark, rows):
    df = spark.createDataFrame(
        [("1", "12, Broad, Ife", "", ""), ("2", "3, Main", "x", ""), ("3", "-777", "", ""),
         ("4", "", "", ""), ("5", " , ", "", "")], "id string, address string, house string, town string")
    assert rows(admin.migration_candidates(df, "id", "address", ["house", "town"])) == [
        ("1", "12, Broad, Ife", "12", "Broad, Ife")]


def test_recode_and_readiness(spark):
    df = spark.createDataFrame([(" hpb ", "a"), ("?", " ")], "c string, r string")
    got = [tuple(r) for r in df.select(admin.recode("c", K.CANCER_TYPES),
                                       admin.ready_to_build(["c", "r"])).collect()]
    assert got == [("5", True), (None, False)]

