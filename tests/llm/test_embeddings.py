"""Links and components against all cosines."""
import math

import numpy as np
import pytest

from trialweave.llm import catalogue, embeddings


def _brute(rows, threshold=0.98):
    """(id, links, component, kept) of each row (id, vector, label), by every pair."""
    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * n

    def unit(v):
        v = np.array(v, float) / np.abs(v).max()  # squares of the extremes would not be finite
        return v / np.linalg.norm(v)
    units = [unit(v) if good(v) else None for _, v, _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if (a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None
                    and rows[i][2] == rows[j][2] and a @ b >= threshold):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(vec, least.get(find(i), vec))
    return sorted(((v, links[i], least.get(find(i)), v is not None and v == least.get(find(i)))
                   for i, (v, _, _) in enumerate(rows)), key=str)


def _got(df, **more):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df, **more).collect()), key=str)


def _rows(seed, n=400, d=16, groups=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        if i % 3 == 0:
            c = centres[rng.integers(groups)]
            v = c + rng.normal(size=d) * rng.choice([0.01, 0.08, 0.15])
        rows.append((int(i), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


HARD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None] + [1.0] * 15, 1),
        (904, [math.nan] * 16, 1), (905, [math.inf] * 16, 1), (906, [1.0] * 16, None),
        (907, [1.0] * 16, 1), (908, [2.0] * 16, 1), (909, [1.0] * 8, 1), (907, [1.0] * 16, 1),
        (None, [1.0] * 16, 1), (910, [1e300] * 16, 1), (911, [1e-300] * 16, 1),
        (912, [-1.0] * 16, 1), (None, [0.5, -0.5] * 8, 0)]
SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("seed,leaf,block", [(1, 10_000, 1024), (2, 40, 1024), (3, 40, 16)])
def test_all_links_by_brute_force(spark, seed, leaf, block):
    rows = _rows(seed) + HARD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _got(df, leaf=leaf, block=block) == _brute(rows)


def test_a_dense_group_larger_than_a_block(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * 0.02], 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _got(df, leaf=30, block=32) == _brute(rows)


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert _got(df) == []
    extra = spark.createDataFrame([(1, [1.0, 2.0], 3, 9, "x")],
                                  SCHEMA + ", n_links int, key string")
    assert _got(extra) == [(1, 0, 1, True)]


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in catalogue.op3_embeddings(spark, sf).collect()),
                  key=str) == _brute(rows)
