"""Repeated strings against a dictionary of all of them; sorted orders against sorted()."""
import collections
import hashlib
import os
import random
import tracemalloc

import numpy as np
import pytest
from shuffle_files import left_by

from trialweave.llm import catalogue, suffixes


def _brute(texts, length=200):
    """(bytes, removed, spans, kept) of each text, by counting every string."""
    data = [t.encode() for t in texts]
    counts = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if counts[d[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), spans, kept))
    return out


def _texts(seed):
    rng = random.Random(seed)

    def prose(n):
        return " ".join("".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(1, 9)))
                        for _ in range(n))
    passages = [prose(60) for _ in range(6)] + ["a" * 700, "ab" * 300, prose(10) * 12]
    out = []
    for _ in range(60):
        text = " ".join(rng.choice(passages) if rng.random() < .5 else prose(rng.randint(1, 80))
                        for _ in range(rng.randint(0, 5)))
        if rng.random() < .4 and text:
            k = rng.randrange(len(text))
            text = text[:k] + "ZQ" + text[k + rng.randint(0, 3):]
        out.append(text)
    return out + [out[3], out[3], "", "x" * 199, "x" * 200, prose(50)[:199].ljust(200, "k")]


@pytest.mark.parametrize("seed", range(40))
def test_both_ways_to_compare_contexts_agree(monkeypatch, seed):
    """Contexts of one anchor cut from texts that share it, near copies of each other."""
    rng = random.Random(seed)
    anchor = bytes(rng.choice(b"acgt") for _ in range(suffixes.GRAM))
    before = bytes(rng.choice(b"acgt") for _ in range(152))
    after = bytes(rng.choice(b"acgt") for _ in range(152))
    found = set()
    for _ in range(rng.randint(3, 40)):
        a, b = list(before[rng.randint(0, 152):]), list(after[:rng.randint(0, 152)])
        for side in (a, b):
            if side and rng.random() < .7:
                side[rng.randrange(len(side))] = ord("z")
        if len(a) + len(b) + len(anchor) >= 200:
            found.add((bytes(a) + anchor + bytes(b), len(a), rng.choice([1, 1, 1, 2])))
    contexts = sorted(found)
    if len(contexts) < 3:
        return
    plain = suffixes.repeated_starts(contexts)
    monkeypatch.setattr(suffixes, "MATRIX", 0)
    assert suffixes.repeated_starts(contexts) == plain
    strings = collections.Counter()
    for data, at, times in contexts:
        for k in range(len(data) - 199):
            strings[at - k, data[k:k + 200]] += times
    for (data, at, times), spans in zip(contexts, plain):
        got = {k for a, b in spans for k in range(a, b + 1)}
        assert got == {k for k in range(len(data) - 199) if strings[at - k, data[k:k + 200]] > 1}


@pytest.mark.parametrize("seed", range(60))
def test_deep_shallow_is_a_sort(seed):
    rng = random.Random(seed)
    strings = [b"x" * rng.choice([0, 3, 80]) * (seed % 2) + bytes(
        rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 30))]
    order, shared = suffixes.deep_shallow(strings, rng.choice([0, 2, 5, 64]))
    assert [strings[i] for i in order] == sorted(strings)
    assert sorted(order) == list(range(len(strings)))
    for k in range(1, len(order)):
        assert shared[k] == len(os.path.commonprefix([strings[order[k - 1]], strings[order[k]]]))


@pytest.mark.parametrize("largest,matrix", [
    (suffixes.LARGEST, suffixes.MATRIX), (suffixes.LARGEST, 2), (2, 2)])
def test_documents(spark, monkeypatch, largest, matrix):
    monkeypatch.setattr(suffixes, "MATRIX", matrix)
    if largest != suffixes.LARGEST:  # anchors with more contexts take the other way
        plain = suffixes.repeated_ranges
        monkeypatch.setattr(suffixes, "repeated_ranges",
                            lambda docs, length: plain(docs, length, largest))
    texts = list(enumerate(_texts(5)))
    rows = texts + [(1000, None), (5, texts[5][1]), (None, texts[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffixes.removed(df).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, _brute([t or "" for _, t in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hard_documents(docs, empty, pairs):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffixes.removed(docs).collect()]
    want = [(i, *w) for (i, _), w in zip(pairs, _brute([t for _, t in pairs]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.removed(empty).count() == 0
    assert suffixes.without_repeats(empty).columns == empty.columns


def test_frames_keep_columns_and_valid_text(docs, pairs):
    got = suffixes.without_repeats(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    want = [(i, w[3].decode("utf-8", "ignore")) for (i, _), w in
            zip(pairs, _brute([t for _, t in pairs]))]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["text"] or "") for r in rows), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] in (None, len(r["text"] or "")) for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r["doc_id"], *w[:3], hashlib.sha256(w[3]).hexdigest())
                  for r, w in zip(rows, _brute([r["text"] or "" for r in rows])))
    assert sorted(tuple(r) for r in catalogue.op6_suffixes(spark, sf).collect()) == want


@pytest.mark.parametrize("starts", [1, 7, 333])
def test_runs_do_not_depend_on_the_parts_they_are_found_in(monkeypatch, starts):
    texts = [t.encode() for t in _texts(5)[-25:]]
    whole = suffixes.runs(texts)
    assert len(whole["doc"]) > 100
    monkeypatch.setattr(suffixes, "STARTS", starts)
    parts = suffixes.runs(texts)
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)


@pytest.mark.parametrize("texts", [1, 1000])
def test_memory_of_runs_does_not_grow_with_the_text(texts):
    size = 4_000_000
    data = np.random.default_rng(1).integers(32, 120, size, dtype=np.uint8).tobytes()
    step = size // texts
    cut = [data[i:i + step] for i in range(0, size, step)]
    tracemalloc.start()
    suffixes.runs(cut)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * size


@pytest.mark.parametrize("largest", [suffixes.LARGEST, 2])
def test_steps_leave_no_shuffle_files(spark, docs, monkeypatch, largest):
    """All that is on the disk when the texts are shuffled with their ranges are stored rows."""
    plain = suffixes.repeated_ranges
    monkeypatch.setattr(suffixes, "repeated_ranges", lambda d, length: plain(d, length, largest))
    assert not left_by(spark, lambda: suffixes.without_repeats(docs))
