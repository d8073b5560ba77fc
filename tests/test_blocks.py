"""Exports read block by block against the reader that takes a file in one task."""
import csv
import random

import pytest

from trialweave.sources.blocks import read_blocks
from trialweave.sources.readers import read_export

PIECES = ["a", "é", " ", ",", "\n", "\r\n", '"', '""', "x,y", "\n\n", "long " * 9, "1"]


def _write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_whole_file_reader(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [[str(i), "".join(rng.choices(PIECES, k=rng.randrange(9))), rng.choice(["", "z", "q\nr" * rng.randrange(60)])]
                for i in range(150)]
        _write(tmp_path / name, [["id", "note", "more"], *rows], end)
        want += rows
    got = read_blocks(spark, str(tmp_path), seq="place")
    assert got.columns == ["id", "note", "more", "place"]
    rows = got.orderBy("place").collect()
    assert [list(r)[:3] for r in rows] == want
    assert len({r["place"]["start"] for r in rows}) > 50
    other = [list(r) for r in read_export(spark, str(tmp_path)).collect()]
    assert sorted(other) == sorted([list(r)[:3] for r in rows]) or end == "\r\n"  # that reader alters \r\n in cells


def test_a_cell_over_many_blocks(spark, tmp_path, small_splits):
    rows = [["1", "start"], ["2", "line\n" * 500 + 'said "so"'], ["3", "end"]]
    _write(tmp_path / "one.csv", [["id", "text"], *rows])
    assert sorted(list(r) for r in read_blocks(spark, str(tmp_path / "one.csv")).collect()) == rows


def test_no_rows(spark, tmp_path):
    _write(tmp_path / "none.csv", [["id", "text"]])
    got = read_blocks(spark, str(tmp_path / "none.csv"))
    assert got.columns == ["id", "text"] and got.count() == 0
