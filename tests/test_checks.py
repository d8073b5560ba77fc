"""Outliers, units, rules across forms, tail probabilities and gates against plain computations."""
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from trialweave.functions.pvalues import chi_square_p, gamma_tail, normal_p
from trialweave.operators import checks as C, gates as G


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    rows = [(str(i), rng.choice(["a", "b", "hot", "hot", "hot"]), f, round(rng.gauss(50, 9), 2))
            for i in range(3000) for f in ("x", "y")]
    rows += [("odd", "a", "x", 500.0), ("low", "hot", "y", -300.0)] + [(str(i), "flat", "x", 7.0) for i in range(9)]
    return spark.createDataFrame(rows + [("far", "flat", "x", 8.0)], "record_id string, site string, field string, value double")


def _brute(values):
    groups = {}
    for r in values.collect():
        groups.setdefault((r["site"], r["field"]), []).append(r["value"])
    return {k: (statistics.median(v), statistics.median([abs(x - statistics.median(v)) for x in v])) for k, v in groups.items()}


def test_exact_limits(values):
    got = {(r["site"], r["field"]): (r["median"], r["mad"]) for r in C.exact_limits(values).collect()}
    want = _brute(values)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_sketches_merge_and_come_near(values):
    want = _brute(values)
    sketches = C.value_sketches(values)
    for r in C.sketch_limits(sketches).collect():
        median, mad = want[r["site"], r["field"]]
        assert abs(r["median"] - median) < 1 and abs(r["mad"] - mad) < 1
    merged = C.sketch_limits(C.merge_sketches(sketches), ["field"]).collect()
    assert {r["field"]: r["n"] for r in merged} == {"x": 3011, "y": 3001}
    assert all(abs(r["median"] - 50) < 1.5 for r in merged)


def test_outliers(values):
    found = {(r["record_id"], r["side"]) for r in C.outlier_cells(values, C.exact_limits(values)).collect()}
    assert {("odd", "high"), ("low", "low")} <= found and not any(i == "far" for i, _ in found)  # a flat group has no limits
    assert C.outlier_cells(values.where("false"), C.exact_limits(values)).count() == 0


def test_units_compose(spark):
    given = [("km", "m", 1000.0, None), ("m", "cm", 100.0, 0.0), ("in", "cm", 2.54, 0.0), ("ft", "in", 12.0, 0.0),
             ("C", "F", 1.8, 32.0), ("K", "C", 1.0, -273.15), (None, "m", 1.0, 0.0), ("m", "x", 0.0, 0.0)]
    conversions = spark.createDataFrame(given, "from_unit string, to_unit string, factor double, offset double")
    paths = C.unit_paths(conversions)
    way = {(r[0], r[1]): r[2:] for r in paths.collect()}
    assert way["km", "ft"][0] == pytest.approx(1000 / 0.3048) and way["km", "ft"][2] == 4
    assert 300 * way["K", "F"][0] + way["K", "F"][1] == pytest.approx(80.33)
    assert way["C", "C"] == (1.0, 0.0, 0) and ("km", "F") not in way and len(way) == 25 + 9
    assert C.unit_conflicts(conversions.where("factor <> 0"), paths).count() == 0
    wrong = spark.createDataFrame([*given[:4], ("ft", "m", 0.4, 0.0)], conversions.schema)
    assert C.unit_conflicts(wrong.unionByName(spark.createDataFrame([("km", "m", 900.0, 0.0)], conversions.schema)), paths).count() == 2


def test_rules_across_forms(spark):
    one = spark.createDataFrame([("1", "2020-01-05", "7"), ("2", "2020-01-01", "-999"), ("3", "", "9"), ("3", "", "8")],
                                "id string, day string, size string")
    two = spark.createDataFrame([("1", "2020-01-04", 8), ("2", "2020-01-02", 1), ("4", "2020-01-01", 1)],
                                "id string, day string, size long")
    rules = [C.CrossRule("later", "two.day", ">=", "one.day", "date"), C.CrossRule("fits", "two.size", "<=", "one.size")]
    found = _rows(C.cross_form_findings(C.side_by_side({"one": one, "two": two}, "id"), rules))
    assert found == [("1", "fits", "error", "8 <= 7"), ("1", "later", "error", "2020-01-04 >= 2020-01-05"),
                     ("3", "missing_form", "warn", "two"), ("3", "repeated_form", "warn", "one"),
                     ("4", "missing_form", "warn", "one")]


def test_tails(spark):
    rows = [(z / 7,) for z in range(-60, 61)]
    for r in spark.createDataFrame(rows, "z double").select("z", normal_p(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=1e-12)
    cases = [(d, x / 3) for d in (2, 4, 10, 60, 400) for x in (0, 1, 5, 20, 100, 900, 1300)]
    for d, x, p in spark.createDataFrame(cases, "d int, x double").select(
            "d", "x", chi_square_p(F.col("x"), F.col("d")).alias("p")).collect():
        want = math.exp(-x / 2 + math.log(sum(math.exp(i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(d // 2)))) if x else 1
        assert p == pytest.approx(want, rel=1e-9, abs=1e-14)
    odd = spark.range(1).select(gamma_tail(F.lit(3), F.lit(2.0)).alias("p"), gamma_tail(F.lit(0), F.lit(2.0)).alias("n"),
                                normal_p(F.lit(None).cast("double")).alias("z")).first()
    assert odd["p"] == pytest.approx(math.erfc(math.sqrt(2)) + 2 * math.sqrt(2 / math.pi) * math.exp(-2))
    assert odd["n"] is None and odd["z"] is None


def test_gates(spark):
    rng, rows = random.Random(8), []
    for project in range(6):
        for i in range(14):
            logic = " and ".join(f"[f{j}(1)] = '1'" for j in rng.sample(range(14), rng.randrange(3)))
            rows.append((str(project), f"f{i}", (logic or None) if rng.random() < 0.9 else f"[other] = 1 or [f{i}] = 2"))
    fields = spark.createDataFrame(rows, "project_id string, field_name string, branching_logic string")
    edges = G.gate_edges(fields)
    closure = G.gate_closure(edges)
    near = {}
    for project, field, gate in edges.collect():
        near.setdefault((project, field), set()).add(gate)
    want = set()
    for project, field in {(r[0], r[1]) for r in rows}:
        depth, seen, now = 0, {}, {field}
        while now:
            depth += 1
            now = {g for f in now for g in near.get((project, f), ())} - set(seen)
            seen |= dict.fromkeys(now, depth)
        want |= {(project, field, g, d) for g, d in seen.items()}
    assert {tuple(r) for r in closure.collect()} == want
    back = {(p, f): g for p, f, g, d in want if f == g}
    found = {(r["project_id"], r["field"]): (r["cycle"], r["length"]) for r in G.logic_cycles(closure).collect()}
    assert found.keys() == back.keys()
    steps = {(p, f, g): d for p, f, g, d in want}
    for (p, f), (cycle, length) in found.items():
        assert length == steps[p, f, f]
        assert cycle == min(g for q, h, g in steps if (q, h) == (p, f) and (p, g, f) in steps)
    assert G.gate_closure(edges.where("false")).count() == 0


def test_gates_of_a_long_chain(spark, monkeypatch):
    """Paths are walked, not joined with each other: the plan shuffles edges only. Nulls are kept as they were."""
    monkeypatch.setattr(G, "PART", 40)  # a project in several parts
    rows = [("p", f"f{i}", f"f{i - 1}") for i in range(1, 120)] + [("p", "f0", "f119"), ("q", None, "b"), ("q", "b", "c"),
            ("q", "c", None), (None, "x", "y"), (None, "y", "z")]
    edges = spark.createDataFrame(rows, "project_id string, field string, gate string").repartition(3)
    closure = G.gate_closure(edges)
    got = closure.collect()
    assert not closure.isEmpty() and len(got) == len(set(got)) == 120 * 120 + 8
    assert {tuple(r) for r in got if r["project_id"] == "p"} == {
        ("p", f"f{i}", f"f{(i - d) % 120}", d) for i in range(120) for d in range(1, 121)}
    assert {tuple(r) for r in got if r["project_id"] != "p"} == {
        ("q", None, "b", 1), ("q", None, "c", 2), ("q", None, None, 3), ("q", "b", "c", 1), ("q", "b", None, 2),
        ("q", "c", None, 1), (None, "x", "y", 1), (None, "y", "z", 1)}
    cycles = G.logic_cycles(closure)
    for df in (closure, cycles):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and plan.count("Join") == 1
    assert {tuple(r) for r in cycles.collect()} == {("p", f"f{i}", "f0", 120) for i in range(120)}


def test_gates_folded_where_they_are_walked(spark, monkeypatch):
    """Circles of a folded closure are those of its rows; a task hands on a row a field, not one a path."""
    rng = random.Random(3)
    rows = [(f"p{p}" if p else None, f"f{rng.randrange(n)}" if rng.random() > 0.02 else None,
             f"f{rng.randrange(n)}" if rng.random() > 0.03 else None)
            for p, n in enumerate([30, 1, 5, 20, 50, 50, 60]) for _ in range(int(n * (0.5 + p / 3)))]
    rows += [("long", f"f{i}", f"f{(i + 1) % 300}") for i in range(300)] + [("long", f"f{i}", "f7") for i in (90, 200)]
    edges = spark.createDataFrame(rows, "project_id string, field string, gate string").distinct().cache()
    want = sorted(tuple(r) for r in G.logic_cycles(G.gate_closure(edges)).collect())
    assert len({r[2] for r in want}) > 2 and sum(r[0] == "long" for r in want) == 300
    for part, held, rounds in ((1 << 12, 1 << 24, 32), (40, 1 << 14, 32), (40, 1 << 14, 1)):
        for name, value in (("PART", part), ("HELD", held), ("ROUNDS", rounds)):
            monkeypatch.setattr(G, name, value)
        folded = G.gate_closure(edges, folded=True)
        assert sorted(tuple(r) for r in G.logic_cycles(folded).collect()) == want
        assert folded.count() == len(want)
