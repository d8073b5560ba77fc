"""Intervals over many rounds against a walk through the rounds."""
import random

import pytest

from trialweave.operators import history as H

SCHEMA = "site string, record string, stamp string, status string"


def _walk(rows):
    stamps = {}
    for site, record, stamp, status in rows:
        stamps.setdefault(site, set()).add(stamp)
    state = {}
    for site, record, stamp, status in rows:
        known = state.setdefault((site, record), {})
        known[stamp] = max(known.get(stamp, ""), status or "")
    out = []
    for (site, record), known in state.items():
        last = None
        for stamp in sorted(stamps[site]):
            status = known.get(stamp)
            if last and status != last[0]:
                out.append((site, record, last[0] or None, last[1], stamp))
                last = None
            if last is None and status is not None:
                last = (status, stamp)
        if last:
            out.append((site, record, last[0] or None, last[1], None))
    return sorted(out, key=repr)


def _random(seed, records=25, rounds=10):
    rng = random.Random(seed)
    rows = []
    for r in range(rounds):
        unread = rng.choice(["a", "b", None, "-"])
        for i in range(records):
            site, record = ("a", "b", None)[i % 3], f"r{i}" if i % 5 else None
            if site != unread and rng.random() < 0.8:
                rows += [(site, record, f"2024-01-{r + 1:02d}", rng.choice(["open", "done", None]))
                         ] * rng.randint(1, 2)
    return rows


def _got(df):
    return sorted(((r["site"], r["record"], r["status"], r["from_stamp"], r["to_stamp"])
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_a_walk(spark, seed):
    rows = _random(seed)
    frame = spark.createDataFrame(rows + [("a", "x", None, "open")], SCHEMA).repartition(5)
    assert _got(H.fold_rounds(frame, ["site", "record"], "site")) == _walk(rows)


def test_rounds_added_one_by_one_give_the_same(spark):
    rows = _random(7)
    frame = spark.createDataFrame(rows, SCHEMA)
    days = sorted({r[2] for r in rows})
    history = H.fold_rounds(frame.where(f"stamp = '{days[0]}'"), ["site", "record"], "site")
    for day in days[1:]:
        history = H.add_round(history, frame.where(f"stamp = '{day}'"), ["site", "record"], "site",
                              day)
        history = spark.createDataFrame(history.collect(), history.schema)
        assert _got(history) == _walk([r for r in rows if r[2] <= day])
    for day in days:
        shown = {(r["site"], r["record"]) for r in H.status_at(history, day).collect()}
        there = {r[:2] for r in rows if r[2] == day}
        read = {r[0] for r in rows if r[2] == day}
        assert {k for k in shown if k[0] in read} == there


def test_no_rounds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    history = H.fold_rounds(empty, ["site", "record"], "site")
    assert history.count() == 0
    one = spark.createDataFrame([("a", "r", "x", "open")], SCHEMA)
    assert _got(H.add_round(history, one, ["site", "record"], "site", "2024-01-01")) == [
        ("a", "r", "open", "2024-01-01", None)]
    assert H.add_round(history, empty, ["site", "record"], "site", "2024-01-01").count() == 0


def test_one_key_in_every_row_stays_small(spark):
    """A repeated key is combined before the shuffle: one entry for each round and status."""
    rows = spark.range(60_000).selectExpr(
        "'a' as site", "cast(null as string) as record", "'2024-01-0' || (id % 3 + 1) as stamp",
        "if(id % 2 = 0, 'open', 'done') as status")
    assert _got(H.fold_rounds(rows, ["site", "record"], "site")) == [
        ("a", None, "open", "2024-01-01", None)]
