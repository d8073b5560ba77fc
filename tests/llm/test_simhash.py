"""Fingerprints and components against plain loops; Golay keys against all close pairs."""
import collections
import random
import re

import numpy as np
import pytest
import xxhash

from trialweave.llm import catalogue, simhash
from trialweave.llm.components import components


def _fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps):
    """Smallest id reachable by links of at most two bits, over (id, fingerprint) pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_by_plain_loop(pairs):
    for _, text in pairs:
        assert simhash.fingerprint(text) == _fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_words_within_two_bits_share_a_codeword():
    rng = random.Random(1)
    words = np.array([rng.getrandbits(23) for _ in range(200)])
    flipped = np.array([w ^ 1 << rng.randrange(23) ^ 1 << rng.randrange(23) for w in words])
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for found, some in zip(keys, (words, flipped)):
        for row, key in zip(*simhash.golay_keys(some)):
            found[int(row)].add(int(key))
    assert all(keys[0][i] & keys[1][i] for i in range(len(words)))
    assert {len(v) for v in keys[0].values()} <= {1, 6}


def test_the_code_is_perfect():
    counts = simhash.codeword_keys()[1]
    assert collections.Counter(counts.tolist()) == {1: 277, 6: 1771}


def test_every_close_pair_meets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    close = [b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base for _ in range(3)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in base + close})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.near_fingerprints(df).collect()}
    assert got == {(a, b) for a in fps for b in fps
                   if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_documents(spark, docs, empty, pairs):
    got = simhash.near_duplicates(docs).collect()
    fps = [(i, _fingerprint(t)) for i, t in pairs]
    want = [(i, f, c) for (i, f), c in zip(fps, _components(fps))]
    key = str
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got),
                  key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_component_stays(docs, empty, pairs):
    fps = [(i, _fingerprint(t)) for i, t in pairs]
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    kept = collections.Counter(r["doc_id"] for r in got.collect())
    assert kept == collections.Counter({c: 1 for c in set(_components(fps))})
    assert simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("edges", [
    [], [(5, 5)], [(1, 2), (2, 3), (None, 4)], [(i, i + 1) for i in range(300)],
    [(0, i) for i in range(1, 200)] + [(500, 501)],
    [(i * 7 % 101, i * 13 % 101) for i in range(60)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    want = {}
    for x in nodes:
        seen, todo = {x}, [x]
        while todo:
            at = todo.pop()
            for a, b in edges:
                for y in ([b] if a == at else []) + ([a] if b == at else []):
                    if y is not None and y not in seen:
                        seen.add(y)
                        todo.append(y)
        if min(seen) != x:
            want[x] = min(seen)
    assert {k: v for k, v in got.items() if k != v} == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [(r["doc_id"], _fingerprint(r["text"] or "")) for r in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(fps, _components(fps)))
    assert sorted(tuple(r) for r in catalogue.op9_simhash(spark, sf).collect()) == want
