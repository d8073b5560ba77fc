"""Toxicity by a factorization machine over hashed terms.

Terms are the words of the lower-cased text (runs of letters) and their beginnings of four to seven
letters, hashed into a fixed number of buckets, so that words never seen in training still count by
their stems. In a run of more than sixteen letters, as glued words and unspaced scripts have, every
window of four to seven letters is a term like a beginning. The buckets that best tell the two labels apart become features, valued by how often
they occur; the length of the text, in powers of two words, is a feature too. The machine adds a
weight for each feature and, for each pair of features, the product of their factor vectors: two
terms together, or a term in a short text, can say more than each alone.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, give_back, map_arrow, ship, small_batches

BUCKET_BITS = 20
#: Lengths of the beginnings that are terms; of runs of more than LONGEST letters all windows are.
BEGINNINGS, LONGEST = (4, 5, 6, 7), 16
#: Labelled documents the machine learns from at most, picked by a hash of the id.
MAX_LABELLED = 40_000
FEATURES, FACTORS, EPOCHS = 1024, 8, 12
#: A feature must tell the labels apart by this chi-square at least.
MIN_CHI_SQUARE = 15.0
LENGTHS = 24
BLOCK = 1 << 18
PRIME, WHOLE = np.uint32(0x01000193), np.uint32(0x5BD1E995)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def buckets(text: str | None) -> tuple[np.ndarray, int]:
    """Buckets of the terms of a whole text, repeats included, and its number of words.

    A null or empty text has neither.
    """
    out, count, start = [], 0, 0
    text = text.lower() if text else ""
    while start < len(text):
        end = min(len(text), start + BLOCK)
        while end < len(text) and text[end - 1].isalpha():  # never inside a word
            end += 1
        codes = np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        start = end
        letter = (codes > 0xFFFF) | _letters()[np.minimum(codes, 0xFFFF)]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
        first, length = edge[::2], edge[1::2] - edge[::2]
        count += len(first)
        glued = length > LONGEST
        if glued.any():
            out += _glued(codes, first[glued], length[glued])
        value = np.zeros(len(first), np.uint32)
        for k in range(min(LONGEST, int(length.max(initial=0)))):
            alive = length > k
            first, length, value = first[alive], length[alive], value[alive]
            value = value * PRIME + codes[first + k]
            if k + 1 in BEGINNINGS:
                out.append(_mixed(value + np.uint32(k + 1)))
            out.append(_mixed(value[length == k + 1] ^ WHOLE))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), count


def _glued(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Buckets of the windows after the beginning of each run, and of each run as a whole."""
    start = length.cumsum() - length
    place = np.arange(length.sum()) - np.repeat(start, length)
    left = np.repeat(length, length) - place
    letters = codes[np.repeat(first, length) + place]
    powers = np.full(int(length.max()), PRIME, np.uint32)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint32)
    out = [_mixed(np.add.reduceat(letters * powers[left - 1], start, dtype=np.uint32) ^ WHOLE)]
    value = np.zeros(len(letters), np.uint32)
    for k in range(max(BEGINNINGS)):
        value = value[:len(letters) - k] * PRIME + letters[k:]
        if k + 1 in BEGINNINGS:
            inside = (left[:len(value)] > k) & (place[:len(value)] > 0)
            out.append(_mixed(value[inside] + np.uint32(k + 1)))
    return out


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    return value * np.uint32(0x297A2D39) >> np.uint32(32 - BUCKET_BITS)


def _sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str,
            bound: int) -> DataFrame:
    """Text and label of at most ``bound`` labelled documents; one label (the larger) per id."""
    picked = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
              .where("_id is not null and _y in (0, 1)")
              .groupBy("_id").agg(F.max("_y").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(bound))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(picked), "_id").select("text", "_y")


def select_features(sample: DataFrame, features: int = FEATURES) -> np.ndarray:
    """The buckets whose presence differs most between the labels, by chi-square, best first."""
    ship(sample.sparkSession)
    small_batches(sample.sparkSession)

    def run(batches):
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        totals = np.zeros(2, np.int64)
        for batch in batches:
            for value, y in zip(batch.column("text"), batch.column("_y").to_pylist()):
                seen[y, np.unique(buckets(value.as_py())[0])] += 1
                totals[y] += 1
        used = np.nonzero(seen.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int32()),
             pa.array(np.append(seen[0, used], totals[0]), pa.int64()),
             pa.array(np.append(seen[1, used], totals[1]), pa.int64())], ["b", "n0", "n1"])
        del seen
        give_back()

    counts = checkpointed(sample.mapInArrow(run, "b int, n0 long, n1 long").groupBy("b")
                          .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    totals = counts.where("b < 0").first()
    if totals is None or not totals["n0"] or not totals["n1"]:
        return np.zeros(0, np.int64)
    n0, n1 = float(totals["n0"]), float(totals["n1"])
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    cross = a * (n0 - b) - b * (n1 - a)
    best = (counts.where("b >= 0")
            .withColumn("chi", cross * cross * (n0 + n1)
                        / ((a + b) * (n0 + n1 - a - b) * n0 * n1 + 1e-9))
            .where(F.col("chi") >= MIN_CHI_SQUARE)
            .orderBy(F.desc("chi"), "b").limit(features))
    return np.array([r["b"] for r in best.collect()], np.int64)


class Machine:
    """A trained machine: bucket of each feature, bias, weights and factors.

    Features after the chosen buckets are the lengths of texts.
    """

    def __init__(self, chosen, bias=0.0, weights=None, factors=None):
        self.chosen, self.bias, self.weights, self.factors = chosen, bias, weights, factors
        self.numbers = np.full(1 << BUCKET_BITS, -1, np.int32)
        self.numbers[chosen] = np.arange(len(chosen))

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and values of the features of a whole text."""
        terms, words = buckets(text)
        found = self.numbers[terms]
        number, times = np.unique(found[found >= 0], return_counts=True)
        length = len(self.chosen) + min(words.bit_length(), LENGTHS - 1)
        return (np.append(number, length),
                np.append(np.log2(1.0 + np.minimum(times, 7)), 1.0))

    def score(self, text: str | None) -> float:
        """Probability of label 1 for a whole text."""
        number, value = self.features(text)
        v = self.factors[number] * value[:, None]
        total = v.sum(axis=0)
        z = (self.bias + float(self.weights[number] @ value)
             + 0.5 * float(total @ total - (v * v).sum()))
        return float(1.0 / (1.0 + np.exp(-min(max(z, -35.0), 35.0))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id",
          text: str = "text", bound: int = MAX_LABELLED) -> Machine:
    """Learn from at most ``bound`` labelled documents (Spark counts terms and extracts features
    over them; the bounded matrix is fitted on the driver). Null labels and labels without a
    document teach nothing; without both labels the machine scores every text alike.
    """
    sample = _sample(docs, labels, label, doc_id, text, bound)
    machine = Machine(select_features(sample))

    def build():
        def run(batch):
            rows = [machine.features(v.as_py()) for v in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("_y"), pa.array([n.tolist() for n, _ in rows], pa.list_(pa.int32())),
                 pa.array([x.tolist() for _, x in rows], pa.list_(pa.float64()))], ["y", "n", "x"])
        return run

    got = map_arrow(sample, build, "y int, n array<int>, x array<double>", "text").toArrow()
    rows = sorted(zip(got.column("y").to_pylist(), got.column("n").to_pylist(),
                      got.column("x").to_pylist()), key=lambda r: (len(r[1]), r))
    return fit(machine, rows)


def fit(machine: Machine, rows: list[tuple], epochs: int = EPOCHS, rate: float = 0.02,
        decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss over (label, feature numbers, values) in a given order, so the
    result does not depend on partitions. Without both labels the machine knows only their share.
    """
    k = len(machine.chosen) + LENGTHS
    ys = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)
    share = min(max(float(ys.mean()) if len(ys) else 0.5, 1e-3), 1 - 1e-3)
    bias, w, v = (np.array([np.log(share / (1 - share))]), np.zeros(k + 1),
                  rng.normal(0, 0.05, (k + 1, FACTORS)))
    params = [bias, w, v]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batches = []
    for at in range(0, len(rows), 256):
        some = rows[at:at + 256]
        width = max(len(r[1]) for r in some)
        number, value = np.full((len(some), width), k), np.zeros((len(some), width))
        for i, (_, n, x) in enumerate(some):
            number[i, :len(n)], value[i, :len(n)] = n, x
        batches.append((number, value, ys[at:at + 256]))
    for _ in range(epochs if len(machine.chosen) else 0):
        for at in rng.permutation(len(batches)):
            number, value, y = batches[at]
            vx = v[number] * value[:, :, None]
            total = vx.sum(axis=1)
            z = (bias[0] + (w[number] * value).sum(axis=1)
                 + 0.5 * ((total ** 2).sum(1) - (vx ** 2).sum((1, 2))))
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(y)
            flat = number.ravel()
            gw = np.bincount(flat, (g[:, None] * value).ravel(), k + 1) + decay * w
            per = ((g[:, None] * value)[:, :, None] * (total[:, None, :] - vx)).reshape(-1, FACTORS)
            gv = np.stack([np.bincount(flat, per[:, f], k + 1) for f in range(FACTORS)], 1)
            gv += decay * v
            step += 1
            for p, grad, m, s in zip(params, (np.array([g.sum()]), gw, gv), first, second):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad ** 2 - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    if not len(machine.chosen):
        v[:] = 0.0
    return Machine(machine.chosen, float(bias[0]), w[:k], v[:k])


def score(df: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``score`` (0 to 1, higher: more likely toxic) of the whole text.

    Null and empty texts get the score of a text without features. Repeated rows stay repeated,
    other columns are not read. One pass, no shuffle.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build():
        def run(batch):
            scores = [machine.score(v.as_py()) for v in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
        return run
    return map_arrow(rows, build, f"doc_id {kind}, score double", "text")


def drop_toxic(df: DataFrame, machine: Machine, text: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """The rows of the frame, all columns as they are, whose text scores below ``threshold``.

    Null and empty texts have the score of a text without features, and stay or go by it. Repeated
    rows stay repeated.
    """
    def build():
        def run(batch):
            keep = [machine.score(v.as_py()) < threshold for v in batch.column(text)]
            return batch.filter(pa.array(keep, pa.bool_()))
        return run
    return map_arrow(df, build, df.schema, text)
