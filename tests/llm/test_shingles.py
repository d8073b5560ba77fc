"""Near duplicates by five-word shingles against every pair compared in a plain loop."""
import collections
import random
import re

import numpy as np
from conftest import prose

from trialweave.llm import shingles


def _set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _kept(pairs):
    """Smallest id of every component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = [_set(t) for _, t in pairs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return collections.Counter(least.get(r) for r in range(len(sets)) if parent[r] == r)


def _edited(seed, text, places):
    rng = random.Random(seed)
    words = text.split()
    for at in rng.sample(range(len(words)), places):
        words[at] = f"edit{seed}x{at}"
    return " ".join(words)


def test_stage_against_every_pair(spark):
    rng = random.Random(7)
    texts = [prose(900 + i, 30 + 9 * i) for i in range(30)]
    texts += [_edited(1000 * i + k, t, 1 + rng.randrange(max(2, len(t.split()) // 25)))
              for i, t in enumerate(texts) for k in range(4)]
    page = prose(77, 150)  # a large group, a passage all texts share, and chains
    texts += [_edited(50_000 + i, page, 3) for i in range(60)]
    texts = [f"{t} {prose(5, 8)}" for t in texts]
    chain = prose(78, 120).split()
    texts += [" ".join(chain[i:i + 80]) for i in range(0, 40, 4)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in range(1, 40)]  # 0.8 exactly and below
    order = list(range(len(texts)))
    rng.shuffle(order)
    pairs = [(i, texts[i]) for i in order]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = shingles.keep_first(df)
    want = _kept(pairs)
    assert 30 < len(want) < len(texts) - 90
    assert collections.Counter(r["doc_id"] for r in got.collect()) == want


def test_hard_documents(spark, docs, empty, pairs):
    got = shingles.keep_first(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == _kept(pairs)
    assert shingles.keep_first(empty).count() == 0


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = collections.Counter(r["doc_id"] for r in shingles.keep_first(rows).collect())
    assert got == _kept([(r["doc_id"], r["text"] or "") for r in rows.collect()])


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(3)
    for _ in range(500):
        both = rng.integers(-2**62, 2**62, rng.integers(0, 40))
        one, two = (np.unique(np.concatenate((both, rng.integers(-2**62, 2**62, rng.integers(0, 6)))))
                    for _ in range(2))
        often = np.unique(rng.choice(np.concatenate((one, two, [1])), 10))
        counts = rng.integers(3, 9, len(often))
        if len(one) and len(two) and shingles.similar(one, two):
            first = [shingles.first_shingles(x, often, counts) for x in (one, two)]
            assert len(np.intersect1d(*first))
