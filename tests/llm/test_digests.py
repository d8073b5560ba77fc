"""Digests of whole texts, and edits against a plain loop over the id order."""
import hashlib

import numpy as np
import pytest

from trialweave.llm import catalogue, digests


def _plain(rows):
    """(id, n_chars, edited text) by walking the rows in descending id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        out.append((doc, len(text), text[:len(text) - half] + after[:half], text, after))
    return out


def _want(rows):
    out = []
    for doc, n, edited, text, after in _plain(rows):
        mark, other, third = (digests.digest(t.encode()) for t in (text, edited, after))
        out.append((doc, n, edited, mark, other, digests.likeness(mark, other),
                    digests.likeness(mark, third)))
    return sorted(out, key=str)


def test_counts_cover_the_whole_text(monkeypatch, pairs):
    for _, text in pairs:
        data = text.encode()
        counts = digests.bucket_counts(data)
        assert counts.sum() == sum(max(0, len(data) - k) for _, _, k in digests.TRIPLETS)
        monkeypatch.setattr(digests, "BLOCK", 11)
        assert (digests.bucket_counts(data) == counts).all()
        monkeypatch.undo()


def test_score_is_bounded_and_symmetric():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 1, 5, 80, 900, 9000)]
    marks = [digests.digest(t) for t in texts]
    for a in marks:
        assert digests.likeness(a, a) == 1.0 and digests.difference(a, a) == 0
        for b in marks:
            assert 0 <= digests.likeness(a, b) == digests.likeness(b, a) <= 1
            assert digests.difference(a, b) <= 6 * digests.BUCKETS + digests.MAX_LENGTH_DIFFERENCE


def test_small_edits_stay_near():
    text = " ".join(f"w{i * i % 97}" for i in range(400)).encode()
    near = digests.likeness(digests.digest(text), digests.digest(text[:900] + b"zz" + text[903:]))
    rng = np.random.default_rng(1)
    far = digests.likeness(digests.digest(text), digests.digest(bytes(
        rng.integers(33, 127, len(text), dtype=np.uint8))))
    assert near > 0.9 > 0.5 > far


@pytest.mark.parametrize("slice_rows", [1, 3, 1000])
def test_edits_by_plain_loop(docs, pairs, monkeypatch, slice_rows):
    monkeypatch.setattr(digests, "SLICE_ROWS", slice_rows)
    got = digests.with_edits(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == _want(pairs)


def test_one_row_follows_itself_and_none_gives_none(spark, empty):
    one = spark.createDataFrame([(7, "abcd")], "doc_id long, text string")
    assert [r["edited"] for r in digests.with_edits(one).collect()] == ["abab"]
    nulls = spark.createDataFrame([(None, None), (None, "xy")], "doc_id long, text string")
    assert sorted(r["edited"] for r in digests.with_edits(nulls).collect()) == ["", "x"]
    assert digests.with_edits(empty).count() == 0
    assert digests.fingerprints(empty).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"] or "")
            for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, n, hashlib.sha256(e.encode()).hexdigest(), *rest)
                  for d, n, e, *rest in _want(rows))
    got = sorted(tuple(r) for r in catalogue.op7_digests(spark, sf).collect())
    assert got == want
    assert np.mean([r[5] > r[6] for r in got]) > 0.95
