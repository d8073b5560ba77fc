"""Held-out accuracy of the learned operators, and what they do with hard documents."""
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as public
from trialweave.llm import catalogue, langid, quality, toxicity
from trialweave.llm.common import fold

SF = "/root/testdata/sf0.01"
PIECES = public.path("piece_bpe_32k.model")


def _held_out(spark, query, label, parts, rest):
    """(scores, predictions, labels) of the labelled rows of the held-out fold."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} is not null")
    got = query(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    assert got.where((fold(F.col("doc_id"), parts) == rest) != F.col("held_out")).count() == 0
    rows = got.join(labels, "doc_id").where("held_out").collect()
    return (np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]),
            np.array([r[label] for r in rows]))


def _auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2)


def test_toxicity_held_out(spark):
    score, predicted, label = _held_out(spark, catalogue.op2_toxicity, "toxic", 5, 0)
    assert (predicted == (score >= 0.5)).all()
    assert (predicted == label).mean() > 0.85


def test_quality_held_out(spark):
    score, predicted, label = _held_out(spark, catalogue.op10_quality, "quality", 4, 2)
    assert (predicted == (score >= 0.7)).all()
    assert _auc(score, label) > 0.9 and (predicted == label).mean() > 0.9


def test_language_held_out(spark):
    got = catalogue.op5_langid(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


# -- toxicity ---------------------------------------------------------------------------------

def test_term_buckets_are_the_same_in_blocks(monkeypatch, pairs):
    whole = [toxicity.buckets(t) for _, t in pairs]
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    for (_, text), (terms, words) in zip(pairs, whole):
        again, count = toxicity.buckets(text)
        assert count == words == len(re.findall(r"[^\W\d_]+", text.lower())) or not text.isascii()
        assert sorted(again.tolist()) == sorted(terms.tolist())


def _plain_buckets(text):
    """Terms of a text and their buckets, run by run and letter by letter."""
    mask = 0xFFFFFFFF

    def bucket(letters, size):
        value = 0
        for c in letters:
            value = (value * 0x01000193 + ord(c)) & mask
        value = (value + size) & mask if size else value ^ 0x5BD1E995
        value = (value ^ value >> 15) * 0x2C1B3C6D & mask
        value ^= value >> 12
        return (value * 0x297A2D39 & mask) >> (32 - toxicity.BUCKET_BITS)
    out = []
    for run in re.findall(r"[^\W\d_]+", text.lower()):
        out.append(bucket(run, 0))
        for size in toxicity.BEGINNINGS:
            last = len(run) - size if len(run) > toxicity.LONGEST else min(0, len(run) - size)
            out += [bucket(run[i:i + size], size) for i in range(last + 1)]
    return sorted(out)


@pytest.mark.parametrize("text", [
    "", "short words only", "a" * 16, "a" * 17 + " " + "bcd" * 40, "日本語" * 30 + " end",
    "x" * 29 + "insult" + "y" * 900, "𝒳yz" * 9])
def test_every_letter_of_a_long_run_is_hashed(text):
    assert sorted(toxicity.buckets(text)[0].tolist()) == _plain_buckets(text)


def test_a_term_deep_inside_a_run_counts():
    inside = set(toxicity.buckets("qwrtzpqwrtzpqwrtzpqwrtzpqwrtzp" + "insult" + "kkkkkkkk")[0].tolist())
    assert set(toxicity.buckets("insult")[0].tolist()) & inside
    one, other = "abcdefghijklmnopqr" + "insultnow", "abcdefghijklmnopqr" + "flowerbed"
    assert sorted(toxicity.buckets(one)[0]) != sorted(toxicity.buckets(other)[0])


def test_machine_learns_a_pair_that_weights_alone_miss():
    """Labels are the exclusive or of two features, which no sum of weights can tell."""
    machine = toxicity.Machine(np.array([5, 9]))
    rows = []
    for a in (0, 1):
        for b in (0, 1):
            n = [0] * a + [1] * b + [2]
            rows += [(a ^ b, n, [1.0] * len(n))] * 200
    machine = toxicity.fit(machine, rows, epochs=400)

    def score(a, b):
        number = np.array([0] * a + [1] * b + [2])
        v = machine.factors[number]
        z = machine.bias + machine.weights[number].sum() + 0.5 * (
            v.sum(0) @ v.sum(0) - (v * v).sum())
        return z
    assert score(0, 1) > 0 and score(1, 0) > 0 and score(1, 1) < 0 and score(0, 0) < 0


def test_toxicity_of_hard_documents(spark, docs, empty, pairs):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(pairs) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, machine)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r["score"] < 0.5 for r in got)
    assert toxicity.score(empty, machine).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_toxicity_without_both_labels(spark, docs, rows):
    machine = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    scores = {r["score"] for r in toxicity.score(docs, machine).collect()}
    assert len(scores) == 1


# -- quality ----------------------------------------------------------------------------------

def test_features_are_the_same_in_blocks(monkeypatch, pairs):
    whole = [quality.features(t) for _, t in pairs]
    monkeypatch.setattr(quality, "BLOCK", 37)
    for (_, text), want in zip(pairs, whole):
        assert np.allclose(quality.features(text), want)
    assert not quality.features(None).any()


def test_line_length_has_one_formula():
    line = "Some words of a line.\n"
    below, above = (quality.features(line * (n // len(line))) for n in (999_970, 1_000_050))
    assert np.allclose(below, above, atol=1e-4)


def test_risk_stays_unbiased_without_negatives():
    """Unlabelled rows hold the positives too; the boundary must still fall between the kinds."""
    rng = np.random.default_rng(3)
    n = quality.N_FEATURES
    good, bad = rng.normal(0, 1, (3000, n)), rng.normal(0, 1, (1000, n))
    good[:, 12:], bad[:, 12:] = 0, 0
    good[:, 0] += 3
    bad[:, 0] -= 3
    net = quality.fit(good[:1500], np.concatenate((good[1500:], bad)), 0.6, epochs=30)
    assert (net.score(good) > 0.5).mean() > 0.97 and (net.score(bad) < 0.5).mean() > 0.97


def test_quality_of_hard_documents(spark, docs, empty, pairs):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    network = quality.train(docs, labels)
    got = quality.score(docs, network).collect()
    assert len(got) == len(pairs)
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    assert quality.score(empty, network).count() == 0
    nothing = quality.train(empty, labels.where("quality = 5"))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


# -- language ---------------------------------------------------------------------------------

def _all_segmentations(word, probs, number, longest):
    """Sum over every way to cut the word, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, min(len(word), longest) + 1):
        piece = word[:size]
        if piece in number:
            p = probs[number[piece]]
        elif size == 1:
            p = probs[len(number) + (ord(piece) >> 7)]
        else:
            continue
        total += p * _all_segmentations(word[size:], probs, number, longest)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "c"]
    vocab = langid.Vocabulary(pieces)
    number = {p: i for i, p in enumerate(sorted(pieces))}
    rng = np.random.default_rng(1)
    probs = rng.random((vocab.total, 2)) + 1e-3
    words = ["a", "ab", "abab", "cab", "xab", "bébab", "ababab"]
    got = langid.word_scores(vocab, words, probs)
    for row, word in zip(got, words):
        for k in (0, 1):
            want = _all_segmentations("▁" + word, probs[:, k], number, vocab.longest)
            assert row[k] == pytest.approx(math.log(want), rel=1e-9)


def _forward_and_counts(word, probs, number, total):
    """Log probability of a word and expected counts of its pieces, letter by letter in fractions."""
    def steps(start):
        for end in range(start + 1, len(word) + 1):
            if word[start:end] in number:
                yield end, number[word[start:end]]
            elif end == start + 1:
                yield end, len(number) + (ord(word[start]) >> 7)
    exact = [Fraction(float(p)) for p in probs]
    ahead, behind = [Fraction(0)] * (len(word) + 1), [Fraction(0)] * (len(word) + 1)
    ahead[0] = behind[-1] = Fraction(1)
    for start in range(len(word)):
        for end, piece in steps(start):
            ahead[end] += ahead[start] * exact[piece]
    counts = np.zeros(total)
    for start in range(len(word) - 1, -1, -1):
        for end, piece in steps(start):
            behind[start] += exact[piece] * behind[end]
            counts[piece] += float(ahead[start] * exact[piece] * behind[end] / ahead[-1])
    return math.log(ahead[-1].numerator) - math.log(ahead[-1].denominator), counts


@pytest.mark.parametrize("letters", [1 << 16, 7, 16])
def test_long_words_are_summed_whole(monkeypatch, letters):
    monkeypatch.setattr(langid, "LETTERS", letters)
    pieces = ["▁", "▁a", "a", "b", "ab", "aba", "b" * 9, "abcabcabcabcabca", "c"]
    vocab = langid.Vocabulary(pieces)
    assert vocab.longest == 16
    number = {p: i for i, p in enumerate(sorted(pieces))}
    probs = np.random.default_rng(2).integers(1, 64, (vocab.total, 1)) / 256
    for word in ["abc" * 34, "b" * 30 + "é" + "ab" * 20, "a" * 24, "abcabcabcabcabca"]:
        log, counts = _forward_and_counts("▁" + word, probs[:, 0], number, vocab.total)
        assert langid.word_scores(vocab, [word, "ab"], probs)[0, 0] == pytest.approx(log, rel=1e-9)
        got = langid._long_counts(vocab, word, langid._log_table(probs))
        assert np.allclose(got, counts)
    assert langid.word_scores(vocab, ["ab" * 5000], probs)[0, 0] < -1000


def test_the_longest_pieces_count():
    vocab = langid.vocabulary(PIECES)
    assert vocab.longest == 16
    probs = np.full((vocab.total, 1), 1e-5)
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    piece = next(p for p in map(model.id_to_piece, range(model.get_piece_size()))
                 if len(p) == 16 and p[0] == "▁" and p[1:].isalpha())
    assert langid.word_scores(vocab, [piece[1:].lower()], probs)[0, 0] >= math.log(1e-5)


def test_too_many_languages_are_refused(spark):
    many = spark.range(langid.MAX_LANGUAGES + 1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias("lang"),
        F.lit("some words").alias("text"))
    with pytest.raises(ValueError, match="different values"):
        langid.train(many, PIECES)


def test_fitting_raises_the_likelihood():
    vocab = langid.Vocabulary(["▁", "a", "b", "ab", "ba", "▁ab"])
    counts = {"ab": 50, "abab": 20, "ba": 5}

    def likelihood(rounds):
        probs = langid.fit_pieces(vocab, counts, rounds)[:, None]
        return sum(n * s[0] for n, s in zip(counts.values(),
                                            langid.word_scores(vocab, list(counts), probs)))
    assert likelihood(6) > likelihood(1)


def test_words_are_whole():
    text = "Ab " + "x" * 100 + " 12 _ ß日本"
    runs = langid.words(text)
    assert runs == {"ab": 1, "x" * 100: 1, "ß日本": 1}
    assert langid.words(None) == langid.words("12 !") == {}


def test_language_of_hard_documents(docs, empty, pairs):
    model = langid.train(docs, PIECES)
    got = langid.predict(docs, model, PIECES).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "und")
    want = sum(not any(c.isalpha() for c in t) for _, t in pairs)
    assert sum(r["lang_pred"] == "und" for r in got) == want
    none = langid.train(empty, PIECES)
    assert {r["lang_pred"] for r in langid.predict(docs, none, PIECES).collect()} == {"und"}
    assert langid.predict(empty, model, PIECES).count() == 0


def test_remembered_words_do_not_change_scores(docs, monkeypatch):
    model = langid.train(docs, PIECES)
    want = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9))
                  for r in langid.predict(docs, model, PIECES).collect())
    monkeypatch.setattr(langid, "REMEMBERED", 7)
    got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9))
                 for r in langid.predict(docs, model, PIECES).collect())
    assert got == want
