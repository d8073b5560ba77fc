"""Near-duplicate texts by SimHash over five-word shingles, Golay keys and exact verification.

Texts with a Jaccard similarity of 0.8 differ in about ten of 64 SimHash bits, too many for the two-bit
keys of ``simhash``. Here two seeds give two fingerprints, of which each of five segments of 23 bits is
decoded to the nearby codewords of the Golay code: their indices agree for most similar texts although
bits differ. An index alone has twelve bits, so it is joined to the least shingle hash under a seed of
its own, which similar texts share with the probability of their similarity. Each of the ``TABLES``
tables is such a pair; a similar pair has to meet in one of them.

Texts that meet are compared by size and by all bits, then their whole shingle sets are: a link is a
similarity of 0.8 or more and nothing else. A round compares each text with texts that it meets and is
not yet connected with: first the least under its keys, then the most alike of the texts that the round
draws, one for each key. So a round compares a few pairs for each text, however large a group is, and
rounds go on until one adds less than a twentieth to the links. What the rounds leave is then compared
whole: every two texts that share a key and are not connected yet, however many and however their bits
differ. So no text that meets another is left out by the number drawn, the end of the rounds or the bits;
only pairs that share no key at all are not seen. Recall against every pair is measured in
``test_near_texts.py``.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, map_arrow, releasing
from .components import components
from .shingles import _node, shingles, similar, words_of
from .simhash import first_rows, golay_keys, row_hash

#: Tables of keys, and bits of a segment of a fingerprint; one segment for each table.
TABLES, SEGMENT = 5, 23
#: Most differing bits, of the 64 of the first fingerprint, of two texts that are compared in the rounds.
#: Similar texts differ in 9.7 on average with a standard deviation of 2.9.
MOST_BITS = 24
#: Texts that a text is compared with in a round, the most alike of those drawn; others wait for a later one
#: or for the comparison of all that is left.
DRAWN = 16
#: Rounds end with the first that finds at most this part of the links known before it; what is left is
#: compared whole.
TAIL = 20
#: Longs of the map of a set's shingles, by which most unlike texts are told apart without their words.
WORDS = 16
#: Odd multipliers that make independent hashes of the shingle hashes.
_MIX = [int.from_bytes(xxhash.xxh64_digest(f"table {i}"), "big") | 1 for i in range(4 * TABLES)]


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes * np.uint64(_MIX[2 * seed])
        return (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[2 * seed + 1])


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The 64 SimHash bits of a set of hashes, counted in blocks that bound the memory."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return (2 * total > len(hashes)).astype(np.int64)


def sketch(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """The first fingerprint (signed) and the join keys of a set of shingle hashes."""
    hashes = keys.view(np.uint64)
    bits = np.concatenate([_bits(_mixed(hashes, s)) for s in range(2)])
    fp = int.from_bytes(np.packbits(bits[:64]).tobytes(), "big", signed=True)
    segments = bits[:TABLES * SEGMENT].reshape(TABLES, SEGMENT) @ (1 << np.arange(SEGMENT))
    least = np.array([_mixed(hashes, 2 + t).min() for t in range(TABLES)])
    row, index = golay_keys(segments)
    with np.errstate(over="ignore"):
        key = (least[row] ^ (row * 4096 + index).astype(np.uint64) * np.uint64(_MIX[-1])) * np.uint64(_MIX[-2])
    return fp, key.view(np.int64)


def held_bits(keys: np.ndarray) -> np.ndarray:
    """A map of ``WORDS`` longs with a bit set for each shingle hash. A bit that only one of two maps has
    stands for at least one shingle that only its set holds."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(_mixed(keys.view(np.uint64), 2 + TABLES) >> np.uint64(32)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def _told(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: ``doc_id``, ``row``, ``node`` (a hash of the words), ``n`` (different shingles), ``fp``,
    ``keys`` and ``held`` (``held_bits``). Texts without a word have no key."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(doc_id, text).alias("row"),
                     F.col(text).alias("text"))

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for value in batch.column("text"):
                words = words_of(value.as_py())
                found = shingles(words)
                fp, keys = sketch(found) if len(found) else (0, np.zeros(0, np.int64))
                out.append((_node(words), len(found), fp, keys, held_bits(found)))
            ends = np.cumsum([0, *(len(o[3]) for o in out)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(
                np.concatenate([np.zeros(0, np.int64), *(o[3] for o in out)])))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *(pa.array([o[i] for o in out], t) for i, t in (
                    (0, pa.int64()), (1, pa.int32()), (2, pa.int64()))), keys,
                 pa.array([o[4] for o in out], pa.list_(pa.int64()))],
                ["doc_id", "row", "node", "n", "fp", "keys", "held"])
        return run
    return map_arrow(
        rows, build, "doc_id long, row long, node long, n int, fp long, keys array<long>, held array<long>", "text")


def _sizes_fit(n, m):
    """Whether sets of ``n`` and ``m`` shingles can have a similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _maps_fit(n, held, m, other):
    """Whether sets with these maps can: shingles that only one set holds cannot be shared."""
    alone = lambda x, y: reduce(lambda p, q: p + q, [
        F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in range(WORDS)])
    return 9 * F.least(n - alone(held, other), m - alone(other, held)) >= 4 * (n + m)


def _may_be_alike(n, fp, m, other):
    return _sizes_fit(n, m) & (F.bit_count(fp.bitwiseXOR(other)) <= MOST_BITS)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a similarity of 0.8 or more. The text of ``a`` travels with each
    pair, that of ``b`` once for all pairs that it is in."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))

    def build():
        held = [None, None]  # the text of the last b and its shingles

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                if (other := y.as_py()) != held[0]:
                    held[:] = other, shingles(words_of(other))
                keep.append(similar(shingles(words_of(x.as_py())), held[1]))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        return run
    return checkpointed(map_arrow(both, build, "a long, b long", "ta"))


def _left_over(met: DataFrame, links: DataFrame, told: DataFrame) -> DataFrame:
    """Every two nodes (a, b) that share a key and that the links do not connect, once each, but for those
    whose sizes or maps rule out a similarity of 0.8."""
    known = components(links).withColumnRenamed("node", "_node")
    apart = met.join(known, F.col("node") == F.col("_node"), "left").select(
        "k", "node", "n", F.coalesce("component", "node").alias("c"))
    mixed = apart.groupBy(F.col("k").alias("_k")).agg(
        F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("_k")
    maps = told.groupBy(F.col("node").alias("_node")).agg(F.first("held").alias("held"))
    apart = checkpointed(apart.join(mixed, F.col("k") == F.col("_k"), "left_semi")
                         .join(maps, F.col("node") == F.col("_node")).drop("_node"))
    left, right = (apart.select("k", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "c", "held")))
                   for side in ("l", "r"))
    return left.join(right.hint("merge"), "k").where(  # adaptive execution splits a large key
        (F.col("l_node") < F.col("r_node")) & (F.col("l_c") != F.col("r_c"))
        & _sizes_fit(F.col("l_n"), F.col("r_n"))
        & _maps_fit(F.col("l_n"), F.col("l_held"), F.col("r_n"), F.col("r_held"))).select(
            F.col("l_node").alias("a"), F.col("r_node").alias("b")).distinct()


def links(df: DataFrame, told: DataFrame, text: str = "text") -> DataFrame:
    """Pairs (a, b) of nodes with a similarity of 0.8 or more, enough of them that every such pair that
    shares a key is connected. ``told`` is the checkpointed ``_told`` of the frame. Copies are one node; a
    node meets the others under a key through the least of them, then through drawn ones, then all."""
    nodes = told.where(F.size("keys") > 0).groupBy("node").agg(
        F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", "n", "fp", F.explode(F.array_distinct("keys")).alias("k"))
    place = F.struct("node", "n", "fp")
    shared = (keyed.groupBy(F.col("k").alias("_k")).agg(F.min(place).alias("low"), F.count("*").alias("held"))
              .where("held > 1").select("_k", "low"))
    met = checkpointed(keyed.join(shared, F.col("k") == F.col("_k")).drop("_k"))
    wanted = met.select(F.col("node").alias("_node")).distinct()

    def build():
        seen: set[int] = set()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_node(words_of(v.as_py())) for v in batch.column("text")]
            new = [node not in seen and not seen.add(node) for node in found]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column("text")],
                                              ["node", "text"]).filter(pa.array(new, pa.bool_()))
        return run
    texts = checkpointed(map_arrow(df.select(F.col(text).alias("text")), build, "node long, text string", "text")
                         .join(wanted, F.col("node") == F.col("_node"), "left_semi").dropDuplicates(["node"]))
    one = (met.where((F.col("node") != F.col("low.node")) & _may_be_alike(
        F.col("n"), F.col("fp"), F.col("low.n"), F.col("low.fp")))
        .groupBy(F.col("node").alias("a")).agg(F.min("low.node").alias("b")))
    links, turn = _verified(one, texts), 0
    while True:
        known = checkpointed(components(links)).withColumnRenamed("node", "_node")
        turn += 1
        apart = met.join(known, F.col("node") == F.col("_node"), "left").select(
            "k", "node", "n", "fp", F.coalesce("component", "node").alias("c"))
        pivots = (apart.groupBy(F.col("k").alias("_k")).agg(
            F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "fp", "c")).alias("pivot"),
            F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("_k", "pivot"))
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot.fp")))
        one = (apart.join(pivots, F.col("k") == F.col("_k")).where((F.col("c") != F.col("pivot.c")) & _may_be_alike(
            F.col("n"), F.col("fp"), F.col("pivot.n"), F.col("pivot.fp")))
            .groupBy(F.col("node").alias("a")).agg(  # no more structs than the node has keys
                F.array_sort(F.collect_set(F.struct(far, F.col("pivot.node").alias("b")))).alias("best"))
            .select("a", F.explode(F.slice("best", 1, DRAWN)).alias("best")).select("a", "best.b"))
        more = _verified(one, texts)
        with releasing(df.sparkSession):
            found, before = more.count(), links.count()
        links = links.unionByName(more)
        if TAIL * found <= before:
            break
    return links.unionByName(_verified(_left_over(met, links, told), texts))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of linked texts, all columns as they are: the one with the smallest id
    (rows without an id come last; of rows with equal ids one stays).

    Texts of the same words are copies; null texts and texts without a word are copies of each other.
    Texts are read whole, an empty table gives no rows.
    """
    told = checkpointed(_told(df, doc_id, text))
    linked = components(links(df, told, text)).withColumnRenamed("node", "_node")
    rooted = told.select("doc_id", "row", "node").join(linked, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "row", F.coalesce("component", "node").alias("root"))
    return first_rows(df, rooted, doc_id, text)
