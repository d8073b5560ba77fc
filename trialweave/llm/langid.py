"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language gives every vocabulary piece a probability. A word's probability is the sum over all
ways to cut it into pieces, found by the forward algorithm; expectation-maximisation fits the piece
probabilities with the same sums. A text's score is the sum of its words' log probabilities, so
words are scored once per distinct word, many at a time.
"""
from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow

#: Words of fewer letters are summed over many at a time; longer ones in logarithms, which cannot
#: underflow, with the forward values of the last letters carried from block to block.
MAX_RUN, LETTERS = 24, 1 << 16
#: Languages that a model may have; a column with more distinct values is refused.
MAX_LANGUAGES = 256
#: Documents per language that the piece probabilities are fitted on, picked by a hash of the id.
DOCS_PER_LANG = 500
ROUNDS = 4
#: Distinct words whose scores a task remembers; the store is emptied when it is full.
REMEMBERED = 200_000
WORD_START = "▁"
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


class Vocabulary:
    """Pieces by number, with a vectorised look-up of all substrings of many words.

    Besides the vocabulary's lower-cased letter pieces there is one piece per block of 128 code
    points, which stands for any single character that has no piece of its own.
    """

    def __init__(self, pieces: list[str]):
        kept = sorted({p.lower() for p in pieces
                       if p == WORD_START or p.replace(WORD_START, "", 1).isalpha()})
        self.longest = max(map(len, kept), default=1)
        self.size = len(kept)
        self.total = self.size + 0x110000 // 128
        hashes = np.array([_hash(p) for p in kept], dtype=np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.ids = hashes[order], order.astype(np.int32)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.sorted >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece number of each hash, -1 where it is none."""
        out = np.full(hashes.shape, -1, np.int32)
        maybe = np.nonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        some = hashes[maybe]
        at = np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)
        out[maybe] = np.where(self.sorted[at] == some, self.ids[at], -1)
        return out


def _hash(piece: str) -> int:
    value = 0
    for char in piece:
        value = (value * int(_BASE) + ord(char) + 1) & 0xFFFFFFFFFFFFFFFF
    return value * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece model file, loaded once in a process."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([model.id_to_piece(i) for i in range(model.get_piece_size())])


def words(text: str | None) -> Counter:
    """Counts of the runs of letters of a whole text, lower-cased."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _lattice(vocab: Vocabulary, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers [word, start, length - 1] of all substrings (-1: none), and lengths, of words
    with their word-start marks."""
    lengths = np.array([len(w) for w in marked])
    width = int(lengths.max())
    codes = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le"),
                          np.uint32).reshape(len(marked), width).astype(np.uint64)
    deepest = min(vocab.longest, width)
    found = np.full((len(marked), width, deepest), -1, np.int32)
    rolling = np.zeros((len(marked), width), np.uint64)
    for size in range(1, deepest + 1):
        last = width - size + 1
        rolling = rolling[:, :last] * _BASE + codes[:, size - 1:] + np.uint64(1)
        ids = vocab.find(rolling * np.uint64(0xD6E8FEB86659FD93))
        inside = np.arange(last)[None, :] + size <= lengths[:, None]
        found[:, :last, size - 1] = np.where(inside, ids, -1)
    single = found[:, :, 0]
    blank = (single < 0) & (np.arange(width)[None, :] < lengths[:, None])
    single[blank] = vocab.size + (codes[blank] >> np.uint64(7)).astype(np.int32)
    return found, lengths


def _forward(found: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: summed probability of all segmentations up to ``end``."""
    n, width, deepest = found.shape
    alpha = np.zeros((n, width + 1, probs.shape[1]))
    alpha[:, 0] = 1.0
    for start in range(width):
        for size in range(1, min(deepest, width - start) + 1):
            ids = found[:, start, size - 1]
            rows = np.nonzero(ids >= 0)[0]
            if len(rows):
                alpha[rows, start + size] += alpha[rows, start] * probs[ids[rows]]
    return alpha


def _log_steps(found: np.ndarray, logs: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """Log of the forward values before and after every letter of a stretch of one word.

    ``found`` [start, size - 1] covers the last ``deepest`` letters before the stretch and the
    stretch; ``carried`` holds the values at those letters. ``logs`` ends with a row of -inf, which
    the piece number -1 picks.
    """
    deepest = found.shape[1]
    alpha = np.full((len(found) + 1, logs.shape[1]), -np.inf)
    alpha[:deepest + 1] = carried
    sizes = np.arange(deepest, 0, -1)
    for end in range(deepest + 1, len(alpha)):
        terms = alpha[end - deepest:end] + logs[found[np.arange(end - deepest, end), sizes - 1]]
        most = terms.max(axis=0)
        alpha[end] = most + np.log(np.exp(terms - most).sum(axis=0))
    return alpha


def _long_word(vocab: Vocabulary, word: str, logs: np.ndarray):
    """Yields (piece numbers, log forward values) of one word, stretch by stretch, over all segmentations.

    The values start at the stretch's first letter but ``longest``; the last one is the last letter's.
    """
    deepest = vocab.longest
    marked = "\0" * deepest + WORD_START + word
    carried = np.full((deepest + 1, logs.shape[1]), -np.inf)
    carried[deepest] = 0.0
    for at in range(deepest, len(marked), LETTERS):
        stretch = marked[at - deepest:at + LETTERS]
        found = _lattice(vocab, [stretch])[0][0]
        if at == deepest:
            found[:deepest] = -1
        alpha = _log_steps(found, logs, carried)
        carried = alpha[-deepest - 1:]
        yield found, alpha


def _log_table(probs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.vstack((probs, np.zeros((1, probs.shape[1])))))


def _shorter(items, limit: int = MAX_RUN) -> tuple[list[str], list[str]]:
    """Words below ``limit`` letters, by length, and the others."""
    order = sorted(items, key=len)
    cut = next((i for i, w in enumerate(order) if len(w) >= limit), len(order))
    return order[:cut], order[cut:]


def word_scores(vocab: Vocabulary, batch: list[str], probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations of the whole word."""
    out = np.zeros((len(batch), probs.shape[1]))
    place = {w: i for i, w in enumerate(batch)}
    short, long = _shorter(place)
    for at in range(0, len(short), 8192):
        some = short[at:at + 8192]
        found, lengths = _lattice(vocab, [WORD_START + w for w in some])
        alpha = _forward(found, probs)
        out[[place[w] for w in some]] = np.log(alpha[np.arange(len(some)), lengths] + 1e-300)
    logs = _log_table(probs) if long else None
    for word in long:
        for _, alpha in _long_word(vocab, word, logs):
            out[place[word]] = alpha[-1]
    return out


def _long_counts(vocab: Vocabulary, word: str, logs: np.ndarray) -> np.ndarray:
    """Expected piece counts of one long word: forward stretch by stretch, then backward."""
    deepest, out = vocab.longest, np.zeros(vocab.total)
    stretches = list(_long_word(vocab, word, logs))
    total = stretches[-1][1][-1, 0]
    after = np.full(deepest + 1, -np.inf)  # log backward values at a stretch's last letters
    after[deepest] = 0.0
    for found, alpha in reversed(stretches):
        n = len(found)
        beta = np.full(n + 1, -np.inf)
        beta[n - deepest:] = after
        for start in range(n - 1, -1, -1):
            # pieces that end before the stretch's own letters are counted in the one before
            first, last = max(start, deepest) + 1, min(start + deepest, n)
            ids = found[start, first - start - 1:last - start]
            steps = logs[ids, 0] + beta[first:last + 1]
            out[ids[ids >= 0]] += np.exp(alpha[start, 0] + steps - total)[ids >= 0]
            beta[start] = np.logaddexp.reduce(steps, initial=beta[start])
        after = beta[:deepest + 1]
    return out


def fit_pieces(vocab: Vocabulary, counts: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation, smoothed."""
    probs = np.full((vocab.total, 1), 1.0 / vocab.size)
    probs[vocab.size:] = 1e-7
    short, long = _shorter(counts)
    lattices = []
    for at in range(0, len(short), 8192):
        some = short[at:at + 8192]
        found, lengths = _lattice(vocab, [WORD_START + w for w in some])
        lattices.append((found, lengths, np.array([counts[w] for w in some], float)))
    for _ in range(rounds):
        expected = np.zeros(vocab.total)
        for found, lengths, weight in lattices:
            alpha = _forward(found, probs)[:, :, 0]
            n, width, deepest = found.shape
            beta = np.zeros((n, width + 1))
            beta[np.arange(n), lengths] = 1.0
            scale = weight / np.maximum(alpha[np.arange(n), lengths], 1e-300)
            for start in range(width - 1, -1, -1):
                for size in range(1, min(deepest, width - start) + 1):
                    ids = found[:, start, size - 1]
                    rows = np.nonzero(ids >= 0)[0]
                    if not len(rows):
                        continue
                    step = probs[ids[rows], 0] * beta[rows, start + size]
                    beta[rows, start] += step
                    expected += np.bincount(ids[rows], alpha[rows, start] * step * scale[rows],
                                            vocab.total)
        logs = _log_table(probs) if long else None
        for word in long:
            expected += counts[word] * _long_counts(vocab, word, logs)
        smoothed = expected + 0.01
        smoothed[vocab.size:] = expected[vocab.size:] + 1e-4
        probs = (smoothed / smoothed.sum())[:, None]
    return probs[:, 0]


def train(df: DataFrame, vocab_path: str, lang: str = "lang", text: str = "text",
          doc_id: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG):
    """(languages, piece probabilities [piece, language], log priors), fitted on rows of ``df``.

    Languages are the non-null values of ``lang``; priors are their shares of all rows, and the
    pieces are fitted on ``docs_per_lang`` documents each, one task per language over that bounded
    sample. Null and empty texts teach nothing. No rows, or no letters: no languages. More than
    ``MAX_LANGUAGES`` values are refused, since a model of them would not fit the driver.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"),
                     F.col(text).alias("text")).where("lang is not null and text is not null")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different values in {lang}")
    if not shares:
        return [], np.zeros((0, 0)), np.zeros(0)
    # of a frequent language only ids with a low hash are ranked, several times as many as needed
    bounds = F.create_map(*[F.lit(x) for name, n in shares.items()
                            for x in (name, min(1.0, 4.0 * docs_per_lang / n))])
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "lang"), 1)
    by = Window.partitionBy("lang").orderBy("key", "doc_id")
    picked = (rows.select("doc_id", "lang", key.alias("key"))
              .where(F.col("key") <= F.element_at(bounds, F.col("lang")) * float(1 << 63))
              .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= docs_per_lang)
              .select("doc_id", "lang").distinct())  # at most docs_per_lang rows a language
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")

    def count():
        def run(batch):
            langs, found, times = [], [], []
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counts = words(value.as_py())
                langs += [name] * len(counts)
                found += counts.keys()
                times += counts.values()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(found, pa.string()),
                 pa.array(times, pa.int64())], ["lang", "word", "n"])
        return run

    counted = (map_arrow(sample, count, "lang string, word string, n long", "text")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab = vocabulary(vocab_path)
        probs = fit_pieces(vocab, dict(zip(pdf["word"], pdf["n"])))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "probs": [probs.tobytes()]})

    fitted = {r["lang"]: np.frombuffer(r["probs"]) for r in counted.groupBy("lang").applyInPandas(
        fit, "lang string, probs binary").collect()}
    langs = sorted(fitted)
    if not langs:
        return [], np.zeros((0, 0)), np.zeros(0)
    share = np.array([shares[x] for x in langs], float)
    return langs, np.stack([fitted[x] for x in langs], axis=1), np.log(share / share.sum())


def predict(df: DataFrame, model, vocab_path: str, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred`` and ``score``, the language's posterior share.

    A null text, one without a letter, or a model without languages gives ``und`` with score 0.
    Ties go to the first language by name. Repeated rows stay repeated, other columns are not read.
    """
    langs, probs, priors = model
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = probs.astype(np.float32)

    def build():
        vocab, table = vocabulary(vocab_path), packed.astype(float)
        known: dict[str, int] = {}
        scores = np.zeros((REMEMBERED, len(langs)))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            counted = [words(v.as_py()) if langs else {} for v in batch.column("text")]
            new = {w for c in counted for w in c if w not in known}
            extra = {}
            if new:
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = {w for c in counted for w in c}
                short, long = _shorter(new)  # long words are not remembered
                new = short + long
                fresh = word_scores(vocab, new, table)
                room = min(len(short), REMEMBERED - len(known))
                base = len(known)
                scores[base:base + room] = fresh[:room]
                known.update(zip(new[:room], range(base, base + room)))
                extra = dict(zip(new[room:], fresh[room:]))
            preds, shares = [], []
            for counts in counted:
                if not counts:
                    preds.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                at = np.fromiter((known.get(w, -1) for w in counts), np.int64, len(counts))
                times = np.fromiter(counts.values(), float, len(counts))
                inside = at >= 0
                total = priors + times[inside] @ scores[at[inside]]
                if not inside.all():
                    total = total + sum(n * extra[w] for w, n in counts.items() if w not in known)
                best = int(np.argmax(total))
                preds.append(langs[best])
                shares.append(float(1.0 / np.exp(total - total[best]).sum()))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(preds, pa.string()),
                 pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])
        return run
    return map_arrow(rows, build, f"doc_id {kind}, lang_pred string, score double", "text")
