"""Near duplicates by the Jaccard similarity of five-word shingles, none left out.

Shingles are put into one order, those frequent in a sample last and the rest by hash. Two sets with
a similarity of at least 0.8 share a shingle among the first fifth (and one) of either, whatever the
order is; a join on these shingles therefore meets every pair, and each pair that meets is verified
on its whole sets. The sample only decides how many pairs meet for nothing.

A large group is linked in two rounds: first the texts of a shingle against the smallest and the
largest of them, then only pairs of texts that the first round has not brought together.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, map_arrow
from .components import components
from .simhash import SEED, first_rows, row_hash

SHINGLE_WORDS = 5
#: The least similarity of a link, as a fraction: 4 / 5.
ALIKE, OF = 4, 5
#: Texts whose shingles are counted for the order, and how many frequent shingles are kept of them.
SAMPLE, FREQUENT = 5_000, 100_000
#: A shingle is frequent if so many texts of the sample hold it.
OFTEN = 3


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending; fewer words than ``width`` are one shingle, and no
    words have none."""
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())),
        np.uint64, len(starts)).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= ALIKE * (len(a) + len(b) - both)


def _node(words: list[bytes]) -> int:
    """A hash of the words: texts with the same words are one node."""
    value = xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)
    return value - (1 << 64) if value >> 63 else value


def _marked(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: ``doc_id``, ``row`` and ``node``."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(doc_id, text).alias("row"),
                     F.col(text).alias("text"))

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes = [_node(words_of(v.as_py())) for v in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(nodes, pa.int64())],
                ["doc_id", "row", "node"])
        return run
    return map_arrow(rows, build, "doc_id long, row long, node long", "text")


def _frequent(texts: DataFrame, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in the nodes whose hash ``every`` divides, ascending, and their counts."""
    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [np.zeros(0, np.int64)]
            for value in batch.column("text"):
                words = words_of(value.as_py())
                if (node := _node(words)) % every == 0 and node not in seen:
                    seen.add(node)
                    keys.append(shingles(words))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], ["k"])
        seen: set[int] = set()  # copies within a task are read once
        return run
    counted = (map_arrow(texts, build, "k long", "text")
               .groupBy("k").count().where(F.col("count") >= OFTEN)
               .orderBy(F.desc("count"), "k").limit(FREQUENT).collect())
    found = np.array(sorted((r["k"], r["count"]) for r in counted), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def first_shingles(keys: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those shingles of a set, in the common order, of which a similar set must share one."""
    weight = np.zeros(len(keys), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        weight = np.where(frequent[at] == keys, counts[at], 0)
    least = -(-ALIKE * len(keys) // OF)  # what a similar set shares at least
    return keys[np.lexsort((keys, weight))[:len(keys) - least + 1]] if len(keys) else keys


def _keyed(texts: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """For every leading shingle of a text: ``k``, ``node``, ``n`` (size of the set) and ``at``.
    Copies within a task give one."""
    def build():
        seen: set[int] = set()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            none = np.zeros(0, np.int64)
            keys, nodes, sizes, places = [none], [none], [none], [none]
            for value in batch.column("text"):
                words = words_of(value.as_py())
                if (node := _node(words)) in seen:
                    continue
                seen.add(node)
                found = shingles(words)
                first = first_shingles(found, frequent, counts)
                keys.append(first)
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), len(found)))
                places.append(np.arange(len(first)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(t)) for x, t in
                 ((keys, "i8"), (nodes, "i8"), (sizes, "i4"), (places, "i4"))],
                ["k", "node", "n", "at"])
        return run
    return map_arrow(texts, build, "k long, node long, n int, at int", "text")


def _may_be_alike(n, at, m, to):
    """Whether sets of ``n`` and ``m`` shingles can reach the similarity if the shingles at these
    places are the first they share; the first that a similar pair shares always passes."""
    return ((OF * F.least(n, m) >= ALIKE * F.greatest(n, m))
            & ((ALIKE + OF) * F.least(n - at, m - to) >= ALIKE * (n + m)))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))

    def build():
        known = functools.lru_cache(maxsize=64)(lambda text: shingles(words_of(text)))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.select(["a", "b"]).filter(pa.array(
                [similar(known(x.as_py()), known(y.as_py()))
                 for x, y in zip(batch.column("ta"), batch.column("tb"))], pa.bool_()))
        return run
    return checkpointed(map_arrow(both, build, "a long, b long", "ta"))


def links(df: DataFrame, marked: DataFrame, text: str = "text") -> DataFrame:
    """Pairs (a, b) of nodes with a similarity of 0.8 or more, enough of them that every such pair
    is connected. ``marked`` is the checkpointed ``_marked`` of the frame."""
    raw = df.select(F.col(text).alias("text"))
    keyed = _keyed(raw, *_frequent(raw, max(1, marked.count() // SAMPLE)))
    same = Window.partitionBy("k")  # one shuffle finds the shingles of several texts
    shared = checkpointed(
        keyed.withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same))
        .where("low < high").select("k", "node", "n", "at").distinct())
    place = F.struct("node", "n", "at")
    ends = shared.join(shared.groupBy(F.col("k").alias("_k")).agg(
        F.min(place).alias("low"), F.max(place).alias("high")), F.col("k") == F.col("_k"))
    wanted = shared.select(F.col("node").alias("_node")).distinct()

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes = [_node(words_of(v.as_py())) for v in batch.column("text")]
            new = [node not in seen and not seen.add(node) for node in nodes]
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), batch.column("text")], ["node", "text"]).filter(
                    pa.array(new, pa.bool_()))
        seen: set[int] = set()
        return run
    texts = checkpointed(map_arrow(raw, build, "node long, text string", "text")
                         .join(wanted, F.col("node") == F.col("_node"), "left_semi")
                         .dropDuplicates(["node"]))

    def against(end):
        return ends.where((F.col("node") != F.col(f"{end}.node")) & _may_be_alike(
            F.col("n"), F.col("at"), F.col(f"{end}.n"), F.col(f"{end}.at"))).select(
                F.least("node", f"{end}.node").alias("a"),
                F.greatest("node", f"{end}.node").alias("b"))
    near = _verified(against("low").unionByName(against("high")).distinct(), texts)
    known = components(near).withColumnRenamed("node", "_node")
    told = shared.join(known, F.col("node") == F.col("_node"), "left").select(
        "k", "node", "n", "at", F.coalesce("component", "node").alias("c"))
    mixed = told.groupBy(F.col("k").alias("_k")).agg(
        F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("_k")
    told = checkpointed(told.join(mixed, F.col("k") == F.col("_k"), "left_semi"))
    left, right = (told.select("k", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "at", "c")))
                   for side in ("l", "r"))
    far = left.join(right.hint("merge"), "k").where(
        (F.col("l_node") < F.col("r_node")) & (F.col("l_c") != F.col("r_c"))
        & _may_be_alike(F.col("l_n"), F.col("l_at"), F.col("r_n"), F.col("r_at"))).select(
            F.col("l_node").alias("a"), F.col("r_node").alias("b")).distinct()
    return near.unionByName(_verified(far, texts))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of texts with a similarity of 0.8 or more, all columns as they are:
    the one with the smallest id (rows without an id come last; of rows with equal ids one stays).

    Texts of the same words are copies; null texts and texts without a word are copies of each
    other.
    """
    marked = checkpointed(_marked(df, doc_id, text))
    linked = components(links(df, marked, text)).withColumnRenamed("node", "_node")
    rooted = marked.join(linked, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "row", F.coalesce("component", "node").alias("root"))
    return first_rows(df, rooted, doc_id, text)
