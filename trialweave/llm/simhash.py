"""SimHash near duplicates found by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at
most two bits agree on one segment outright (pigeonhole), and differ in at most two bits on the
segment after it. That second segment, padded to 23 bits, is decoded by the perfect binary Golay
code: its keys are the indices of all codewords within four bits, which are one or six. Words at
distance two have a word between them, whose nearest codeword lies within three bits of it and so
within four of both; they share a key. A join on (which segment agrees, its bits, codeword index)
therefore meets every pair, and each pair that meets is verified.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, fresh, map_arrow
from .components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Bits of the three segments, lowest first.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the (23, 12) Golay code.
GOLAY = 0b101011100011
#: Shingle hashes are counted in blocks of so many, which bounds the memory for a long text.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text's word shingles; 0 where there is no word.

    A-Z are lower-cased, words are runs without ASCII white space, repeats count, and fewer words
    than ``width`` are one shingle. A bit is set if more than half of the shingles' hashes set it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist())],
                          dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 width: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` (the 64 bits as a signed long) and ``row``, a hash of id and text
    that tells rows apart. Null and empty texts get fingerprint 0.

    Other columns are not read; repeated rows stay repeated. One pass, no shuffle.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(doc_id, text).alias("row"),
                     F.col(text).alias("text"))

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(v.as_py(), width) for v in batch.column("text")],
                           dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps), batch.column("row")],
                ["doc_id", "fp", "row"])
        return run
    return map_arrow(rows, build, "doc_id long, fp long, row long", "text")


def row_hash(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


@functools.lru_cache(maxsize=1)
def codeword_keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How to find the codewords within four bits of a 23-bit word.

    Returns the syndrome of each of the 23 bits, and by syndrome the number of correction patterns
    and the patterns themselves (up to six): the word plus a pattern is a codeword within four bits.
    """
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    unit = np.array([remainder(1 << bit) for bit in range(23)], np.int64)
    counts, patterns = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64)

    def extend(pattern: int, syndrome: int, first: int, left: int):
        patterns[syndrome, counts[syndrome]] = pattern
        counts[syndrome] += 1
        if left:
            for bit in range(first, 23):
                extend(pattern | 1 << bit, syndrome ^ int(unit[bit]), bit + 1, left - 1)
    extend(0, 0, 0, 4)
    return unit, counts, patterns


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for every codeword within four bits of each segment."""
    unit, counts, patterns = codeword_keys()
    segment = segment.astype(np.int64)
    syndrome = np.zeros(len(segment), np.int64)
    for bit in range(23):
        syndrome ^= np.where(segment >> bit & 1, unit[bit], 0)
    rows = np.repeat(np.arange(len(segment)), counts[syndrome])
    at = np.arange(len(rows)) - np.repeat(
        np.cumsum(counts[syndrome]) - counts[syndrome], counts[syndrome])
    word = segment[rows] ^ patterns[syndrome[rows], at]
    return rows, word >> 11  # the code is systematic: its upper twelve bits number the codeword


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of signed 64-bit fingerprints; see the module's account."""
    fps = fps.view(np.uint64)
    offsets = np.concatenate(([0], np.cumsum(SEGMENTS)[:-1])).astype(np.uint64)
    parts = [((fps >> off) & np.uint64((1 << bits) - 1)).astype(np.int64)
             for off, bits in zip(offsets, SEGMENTS)]
    rows, keys = [], []
    for i in range(3):
        row, index = golay_keys(parts[(i + 1) % 3])
        rows.append(row)
        keys.append(i << 40 | parts[i][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame) -> DataFrame:
    def build():
        def run(batch):
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fps)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["k", "fp"])
        return run
    return map_arrow(distinct, build, "k long, fp long")


def near_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most two bits.

    A pair may be met more than once. Both sides of the join are one shuffle, and its skewed keys
    are split by adaptive execution, pair blocks and all, without leaving any out.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys reach differences of at most {MAX_BITS} bits")
    keys = _keyed(distinct)
    left, right = keys.select("k", F.col("fp").alias("a")), keys.select("k", F.col("fp").alias("b"))
    return left.join(right.hint("merge"), "k").where(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id``, the smallest id reachable by links between
    fingerprints at most ``max_bits`` bits apart, its own included.

    Null and empty texts have fingerprint 0 and link like any other; a row without an id counts
    with its fingerprint but names no component unless it is in one with an id. Repeated rows stay
    repeated, an empty table gives no rows, other columns are not read.

    Only distinct fingerprints are compared, so copies cost nothing; ids join back by fingerprint,
    a join whose large side can be split.
    """
    return _linked(df, doc_id, text, max_bits).select("doc_id", "fp", "component_id")


def _linked(df: DataFrame, doc_id: str, text: str, max_bits: int) -> DataFrame:
    marked = checkpointed(fingerprints(df, doc_id, text))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(near_fingerprints(distinct.select("fp"), max_bits))
    roots = distinct.join(linked, distinct.fp == linked.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    smallest = roots.groupBy(F.col("root").alias("_root")).agg(
        F.min("first").alias("component_id"))
    named = roots.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), "root", "component_id")
    return marked.join(named, marked.fp == named._fp).drop("_fp")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
               max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, all columns as they are: the one with the smallest id (rows
    without an id come last; of rows with equal ids one, whichever text hashes lowest, stays).
    """
    return first_rows(df, _linked(df, doc_id, text, max_bits), doc_id, text)


def first_rows(df: DataFrame, linked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows that ``keep_first`` keeps; ``linked`` has their ``doc_id``, ``row`` and ``root``."""
    at, row, id0, picked_id, nth = fresh(df, "_row", "_at", "_id0", "_picked_id", "_nth")
    best = (linked.groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("b"))
            .select(F.coalesce("b.doc_id", F.lit(0)).alias(picked_id), F.col("b.row").alias(row)))
    marked = df.withColumn(at, row_hash(doc_id, text)).withColumn(
        id0, F.coalesce(F.col(doc_id).cast("long"), F.lit(0)))
    kept = marked.join(best.hint("shuffle_hash"),
                       (F.col(id0) == F.col(picked_id)) & (F.col(at) == F.col(row)), "left_semi")
    same = Window.partitionBy(id0, at).orderBy(F.lit(0))  # rows alike but for other columns
    return kept.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*df.columns)
