"""Ranked search against a plain loop over all documents, and against SQL."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect
from conftest import prose

from trialweave.llm import catalogue, search

SF = "/root/testdata/sf0.001"


def _terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute(docs, items):
    every = [(i, Counter(_terms(t))) for i, t in docs]
    every = [(i, c, sum(c.values())) for i, c in every if c]
    count, length = len(every), sum(n for _, _, n in every)
    held = Counter(t for _, c, _ in every for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, counts, n in every:
            m = 100 - 75 + (75 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * held[t] + 1)))
                        * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
                        for t in _terms(text) if t in counts)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if no_id else doc, -score)
                for rank, (score, no_id, doc) in enumerate(sorted(found)[:10], 1)]
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def items(pairs):
    rng = random.Random(2)
    texts = [" ".join(rng.sample(t.split(), min(8, len(t.split())))) for _, t in pairs if len(t.split()) > 2]
    return [*enumerate(texts), (900, None), (901, ""), (902, "the THE the nowhere"), (None, "the tion"),
            (3, texts[3]), (903, "日本語 Kelvin K ÉRÉ ré")]


def test_against_every_document(spark, docs, pairs, items, monkeypatch):
    asked = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id long, text string, rank int, score double")
    want = _brute(pairs, items)
    assert _rows(search.search(docs, asked)) == want
    monkeypatch.setattr(search, "ASKED_CHARS", 200)  # items in many groups
    few = asked.limit(12)
    assert _rows(search.search(docs, few)) == _brute(pairs, [(r[0], r[1]) for r in few.collect()])


def test_empty_tables(spark, docs, empty, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(empty, asked).count() == 0
    assert search.search(docs, asked.where("item_id < 0")).count() == 0
    assert search.search(docs.where("doc_id = 0"), asked).count() == 0  # a document without a term


@pytest.mark.parametrize("block, step, cells", [(4, 2, 2000), (32, 16, 1 << 23), (1, 1, 1)])
def test_blocks_are_skipped_and_nothing_is_lost(block, step, cells, monkeypatch):
    for name, value in (("BLOCK", block), ("STEP", step), ("CELLS", cells)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(block)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(6)]
    texts = [" ".join(rng.choices(rng.choice(topics), k=rng.randrange(3, 30)) + ["every"]) for _ in range(800)]
    texts += [texts[0]] * 30
    asked = [" ".join(rng.sample(topic, 6) + ["every"]) for topic in topics] + [texts[0]]
    words = sorted({w for t in asked for w in t.split()})
    number = {w: i for i, w in enumerate(words)}
    counts = [Counter(t.split()) for t in texts]
    known = [sorted((number[w], c) for w, c in x.items() if w in number) for x in counts]
    scoring = search.Scoring(len(texts), sum(len(t.split()) for t in texts), [sum(w in c for c in counts) for w in words])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "n": [len(t.split()) for t in texts],
                                        "terms": [[t for t, _ in k] for k in known],
                                        "times": [[c for _, c in k] for k in known]})
    queries = [(np.array(sorted(number[w] for w in set(t.split()))), np.array(
        [n for _, n in sorted((number[w], n) for w, n in Counter(t.split()).items())])) for t in asked]
    best, skipped = [search.Best() for _ in asked], 0
    for part in search.Documents(batch, scoring).chunks():
        skipped += search.search_chunk(part, queries, best)
    got = sorted(((i, rank, row[2], -row[0]) for i, b in enumerate(best) for rank, row in enumerate(b.rows, 1)), key=str)
    assert got == _brute(list(enumerate(texts)), list(enumerate(asked)))
    assert skipped > 0 or block == 1  # chunks of one document leave out whole lists


def test_terms_of_long_texts(monkeypatch):
    text = prose(4, 4000) + " x" * 3000 + "y" * 9000
    whole = _terms(text)
    monkeypatch.setattr(search, "PIECE", 100)
    assert [t.decode() for piece in search.terms_of(text) for t in piece] == whole


def test_query(spark):
    assert compare(spark, connect(SF), SF, catalogue.op11_search, catalogue.ORACLES["op11_search"]) is None
