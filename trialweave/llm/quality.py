"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text are told apart by a small network over shape features of
the whole text. The risk of unlabelled text as negatives, less the positives' share of it under an
estimated class prior, is held at zero from below, which keeps a flexible model from fitting the
unlabelled positives as negatives.
"""
from __future__ import annotations

import functools
import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

#: Most documents of either kind that the network learns from, picked by a hash of the id.
MAX_POSITIVE, MAX_UNLABELLED = 20_000, 20_000
HIDDEN, EPOCHS, BATCH = 24, 60, 256
BLOCK = 1 << 18
CLASSES = 9
N_FEATURES = CLASSES * CLASSES + 14


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character class by code point: lower, upper, digit, space, newline, stop, quote, bang, rest."""
    out = np.full(0x10000, 8, np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if char.isupper():
            out[code] = 1
        elif char.isalpha():
            out[code] = 0
        elif char.isdigit():
            out[code] = 2
        elif char == "\n":
            out[code] = 4
        elif char.isspace():
            out[code] = 3
        elif char in ".,;:":
            out[code] = 5
        elif char in "'\"()-?":
            out[code] = 6
        elif char == "!":
            out[code] = 7
    return out


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: class-pair shares, repetition, lengths. Zeros for no text."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    pairs, last = np.zeros(CLASSES * CLASSES), None
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _classes()[np.minimum(codes, 0xFFFF)].astype(np.int64)
        if last is not None:
            kinds = np.concatenate(([last], kinds))
        last = kinds[-1]
        pairs += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[:CLASSES * CLASSES] = np.sqrt(pairs / max(1.0, pairs.sum()))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    repeated = sum(map(eq, words, words[1:]))
    apart = sum(map(eq, words, words[2:]))
    out[CLASSES * CLASSES:] = (
        math.log1p(len(text)) / 10, math.log1p(n) / 10, lengths.mean() / 10,
        min(lengths.max(), 200) / 100, repeated / max(1, n - 1), apart / max(1, n - 2),
        distinct / max(1, n), math.log1p(distinct) / math.log1p(max(1, n)),
        len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)) / 10,
        len(text) / max(1, len(lines)) / 1000,
        float((lengths == 1).mean()), float((lengths > 12).mean()),
        float((lengths[:-1] == lengths[1:]).mean()) if n > 1 else 0.0)
    return np.clip(out, -10, 10)


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean, scale, params):
        self.mean, self.scale, self.params = mean, scale, params

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -35, 35)))


def class_prior(labels: DataFrame, label: str = "quality") -> float:
    """The share of positives among the labelled rows, kept off 0 and 1; a half without rows."""
    row = labels.where(F.col(label).isin(0, 1)).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    return ((row["p"] or 0) + 1.0) / (row["n"] + 2.0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS,
        rate: float = 0.003, decay: float = 1e-4, seed: int = 11) -> Network:
    """Minimise the non-negative unbiased risk with the logistic loss.

    Where the negative part of a batch's risk falls below zero, the step goes up that part instead.
    """
    both = np.concatenate((positive, unlabelled)).astype(float)
    if not len(both):
        both = np.zeros((1, N_FEATURES))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / math.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    net = Network(mean, scale, params)
    if not len(positive) or not len(unlabelled):
        params[2][:] = 0.0
        params[3][0] = math.log(prior / (1 - prior))
        return net
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    first, second, step = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    parts = max(1, len(u) // BATCH)
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for xp, xu in zip(np.array_split(order_p, parts), np.array_split(order_u, parts)):
            if not len(xp) or not len(xu):
                continue
            x = np.concatenate((p[xp], u[xu]))
            w1, b1, w2, b2 = params
            hidden = np.maximum(x @ w1 + b1, 0)
            z = hidden @ w2 + b2[0]
            zp, zu = z[:len(xp)], z[len(xp):]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp = prior * (-sigmoid(-zp)) / len(xp)   # positives as positives
            np_, nu = -prior * sigmoid(zp) / len(xp), sigmoid(zu) / len(xu)
            g = np.concatenate((gp + np_, nu) if negative >= 0 else (-np_, -nu))
            gh = np.outer(g, w2) * (hidden > 0)
            grads = (x.T @ gh + decay * w1, gh.sum(0), hidden.T @ g + decay * w2,
                     np.array([g.sum()]))
            step += 1
            for q, grad, m, s in zip(params, grads, first, second):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad ** 2 - s)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
          text: str = "text", positives: int = MAX_POSITIVE,
          unlabelled: int = MAX_UNLABELLED) -> Network:
    """Learn from at most ``positives`` documents labelled 1 and ``unlabelled`` documents whose
    labels are not looked at, both picked by a hash of the id; documents labelled 0 serve only the
    class prior. Features are taken in one pass of Spark over those documents.
    """
    known = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y")))
    prior = class_prior(known, "_y")
    good = (known.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(positives)
            .select("_id", F.lit(1).alias("_p"), F.lit(0).alias("_u")))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    web = (rows.select("_id").where("_id is not null").distinct()
           .orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(unlabelled)
           .select("_id", F.lit(0).alias("_p"), F.lit(1).alias("_u")))
    picked = good.unionByName(web).groupBy("_id").agg(F.max("_p").alias("_p"), F.max("_u").alias("_u"))
    sample = rows.join(F.broadcast(picked), "_id").select("_p", "_u", "text")

    def build():
        def run(batch):
            x = [features(v.as_py()).tobytes() for v in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("_p"), batch.column("_u"), pa.array(x, pa.binary())], ["p", "u", "x"])
        return run

    got = map_arrow(sample, build, "p int, u int, x binary", "text").toArrow()
    x = np.array([np.frombuffer(v, np.float32) for v in got.column("x").to_pylist()]).reshape(
        -1, N_FEATURES)
    order = np.lexsort(x.T[::-1]) if len(x) else np.zeros(0, int)  # the same whatever the partitions
    p, u = got.column("p").to_numpy()[order] == 1, got.column("u").to_numpy()[order] == 1
    return fit(x[order][p], x[order][u], prior)


def score(df: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``score`` (0 to 1, higher: more likely of good quality).

    Null and empty texts get the score of a text whose features are all zero. Repeated rows stay
    repeated, other columns are not read. One pass, no shuffle.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build():
        def run(batch):
            x = np.array([features(v.as_py()) for v in batch.column("text")]).reshape(-1, N_FEATURES)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(network.score(x.astype(float)))],
                ["doc_id", "score"])
        return run
    return map_arrow(rows, build, f"doc_id {kind}, score double", "text")
