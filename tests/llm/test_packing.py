"""Plans hold every piece once, as few sequences as brute force finds, and whole documents."""
import array
import collections
import itertools
import random
import zlib

import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from trialweave.llm import catalogue, packing

PATH, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


def _fewest(lengths, capacity):
    """Smallest number of sequences, by trying all assignments with pruning."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1:])
        place(i + 1, rooms + [capacity - lengths[i]])
    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_as_few_as_brute_force(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 25, 60])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
    steps = packing.plan(collections.Counter(lengths), capacity)
    assert sum(t for _, t in steps) == _fewest(lengths, capacity)


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_whole(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 200): rng.randint(1, 10 ** rng.randint(0, 7)) for _ in range(40)}
    steps = packing.plan(counts, 200)
    used = collections.Counter()
    for pattern, times in steps:
        assert sum(pattern) <= 200 and times > 0
        for n in pattern:
            used[n] += times
    assert used == counts
    assert packing.lower_bound(counts, 200) <= sum(t for _, t in steps)


def test_no_pieces_and_bad_lengths():
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({2000: 1})


def test_fillings_are_undominated():
    counts = {7: 1, 5: 1, 4: 2, 3: 1}
    assert packing.fillings([7, 5, 4, 3], counts, 8, 10)[0] in [(5, 3), (4, 4)]
    assert (3,) not in packing.fillings([7, 5, 4, 3], counts, 8, 10)  # 7 or 5 fits in its place


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]),
                                    (2048, [(0, 1024), (1024, 1024)])])
def test_cut(n, want):
    assert packing.cut(n) == want


def _check(rows, texts):
    model = Tokenizer.from_file(PATH)
    for doc, text in texts.items():
        ids = model.encode(text, add_special_tokens=False).ids + [2]
        mine = sorted(rows[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in mine] == [
            (k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids)))]
        for r in mine:
            part = array.array("I", ids[r["start"]:r["start"] + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    sequences = collections.defaultdict(list)
    for r in itertools.chain(*rows.values()):
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = collections.defaultdict(list)
    for r in catalogue.op1_packing(spark, sf).collect():
        rows[r["doc_id"]].append(r)
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    used = _check(rows, texts)
    total = sum(r["length"] for r in itertools.chain(*rows.values()))
    assert used <= -(-total // 1024) + 1


def test_hard_documents(spark, docs, empty, pairs):
    pieces = packing.tokenize(docs, PATH, RANKS, public.PATTERN, with_ids=True)
    got = packing.pack(pieces).collect()
    model = Tokenizer.from_file(PATH)
    want = sorted(array.array("I", model.encode(t, add_special_tokens=False).ids + [2]).tobytes()
                  for _, t in pairs)
    whole, docs_of = [], collections.defaultdict(list)
    for r in got:
        docs_of[r["doc_id"]].append(r)
    assert sum(len(r["ids"]) for r in got) == sum(map(len, want))
    for doc, parts in docs_of.items():
        if sum(1 for i, _ in pairs if i == doc) == 1:
            whole.append(b"".join(bytes(p["ids"]) for p in sorted(parts, key=lambda p: p["piece"])))
    assert not set(whole) - set(want)
    assert packing.pack(packing.tokenize(empty, PATH, RANKS, public.PATTERN)).count() == 0


def test_special_strings_are_left_to_the_tokenizer():
    text = "plain <|endoftext|> plain"
    model = Tokenizer.from_file(PATH)
    assert packing.token_ids(text, PATH, RANKS, public.PATTERN) == model.encode(
        text, add_special_tokens=False).ids
