"""SimHash near duplicates of five-word shingles: links against every pair, and recall."""
import collections
import random

import numpy as np
from conftest import prose
from shuffle_files import left_by
from test_shingles import _edited, _kept, _set

from trialweave.llm import near_texts, shingles
from trialweave.llm.components import components


def _links(spark, pairs):
    """Links found, as pairs of texts, and all pairs of different texts with a similarity of 0.8."""
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    told = near_texts._told(df, "doc_id", "text").cache()
    of = {shingles._node(shingles.words_of(t)): _set(t) for _, t in pairs}
    found = {frozenset((r["a"], r["b"])) for r in near_texts.links(df, told).collect()}
    for a, b in map(tuple, found):
        assert 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])
    return told, of


def test_groups_chains_and_passages(spark):
    rng = random.Random(7)
    texts = [prose(900 + i, 30 + 9 * i) for i in range(30)]
    texts += [_edited(1000 * i + k, t, 1 + rng.randrange(max(2, len(t.split()) // 25)))
              for i, t in enumerate(texts) for k in range(4)]
    page = prose(77, 150)
    texts += [_edited(50_000 + i, page, 3) for i in range(60)]
    texts = [f"{t} {prose(5, 8)}" for t in texts]
    chain = prose(78, 120).split()
    texts += [" ".join(chain[i:i + 80]) for i in range(0, 40, 4)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    pairs = [(i, texts[i]) for i in order]
    _links(spark, pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = collections.Counter(r["doc_id"] for r in near_texts.keep_first(df).collect())
    want = _kept(pairs)
    assert not want - got  # nothing goes that has no link
    dropped, all_dropped = len(texts) - sum(got.values()), len(texts) - sum(want.values())
    assert dropped >= 0.97 * all_dropped, (dropped, all_dropped)


def test_tables_against_every_pair(spark):
    """On both given tables what stays equals the comparison of every pair, or misses a tenth at most."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = collections.Counter(r["doc_id"] for r in near_texts.keep_first(rows).collect())
    want = _kept([(r["doc_id"], r["text"] or "") for r in rows.collect()])
    assert not want - got
    assert sum((got - want).values()) <= 0.1 * (rows.count() - sum(want.values()))


def test_keys_meet_at_the_least_similarity():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        both, rest = rng.integers(-2**62, 2**62, 178), 22
        one, two = (np.unique(np.concatenate((both, rng.integers(-2**62, 2**62, rest)))) for _ in range(2))
        (a, x), (b, y) = near_texts.sketch(one), near_texts.sketch(two)
        met += len(np.intersect1d(x, y)) > 0 and ((a ^ b) & (2**64 - 1)).bit_count() <= near_texts.MOST_BITS
    assert met >= 0.9 * 400


def test_hard_documents(spark, docs, empty, pairs):
    got = near_texts.keep_first(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == _kept(pairs)
    assert near_texts.keep_first(empty).count() == 0


def test_every_pair_that_shares_a_key_is_compared(spark):
    """Loosely alike texts of one page: more than the rounds draw, and still linked when rounds add little."""
    rng, page = random.Random(1), prose(78, 200)
    texts = [_edited(50_000 + i, page, rng.randrange(2, 14)) for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    told = near_texts._told(df, "doc_id", "text").cache()
    found = components(near_texts.links(df, told)).collect()
    component = {r["node"]: r["component"] for r in found}
    sets = [(shingles._node(words), shingles.shingles(words)) for words in map(shingles.words_of, texts)]
    told_of = [(node, held, set(near_texts.sketch(held)[1].tolist())) for node, held in sets]
    met = [(a, b) for i, (a, x, k) in enumerate(told_of) for b, y, m in told_of[:i]
           if k & m and shingles.similar(x, y)]
    assert len(met) > 100
    assert [(a, b) for a, b in met if component.get(a, a) != component.get(b, b)] == []


def test_rounds_leave_no_shuffle_files(spark, docs):
    """Rounds make hundreds of small shuffles, whose files must not wait for the driver's garbage."""
    assert not left_by(spark, lambda: near_texts.keep_first(docs))
