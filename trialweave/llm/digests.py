"""Document fingerprints: a quartile bucket digest that changes little when a text does.

All byte triplets taken from windows of five bytes are hashed into 512 buckets. A bucket is encoded
by the quartile its count falls into among all buckets (two bits), and the whole by a length code in
front. Two digests differ by the sum of their buckets' quartile steps (three steps count six) and a
bounded share for length; likeness is one less the difference over what unrelated digests have.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, ship

BUCKETS = 512
#: Offsets of the triplets inside a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
STEPS = np.array([0, 1, 2, 6], np.int64)
LENGTH_STEP, MAX_LENGTH_DIFFERENCE = 4, 32
#: Mean difference of two digests with independent quartiles: (6 * 1 + 4 * 2 + 2 * 6) / 16 a bucket.
UNRELATED = BUCKETS * 26 // 16 + MAX_LENGTH_DIFFERENCE
BLOCK = 1 << 16
#: Rows in a slice of the id order, and most slices, whose bounds are sent to all tasks.
SLICE_ROWS, MAX_SLICES = 500, 1 << 16

_PAIRS = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3

def bucket_counts(data: bytes) -> np.ndarray:
    """How many of the byte triplets of the whole text fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(raw) - 2), BLOCK):
        block = raw[at:at + BLOCK + 4].astype(np.uint32)
        a = block * np.uint32(0x9E3779B1)
        b = block * np.uint32(0x85EBCA77)
        c = block * np.uint32(0xC2B2AE3D)
        starts = min(BLOCK, len(block))
        for salt, (i, j, k) in enumerate(TRIPLETS):
            n = min(starts, len(block) - k)
            if n <= 0:
                continue
            mixed = a[i:i + n] + b[j:j + n] + c[k:k + n] + np.uint32(0x27D4EB2F * salt & 0xFFFFFFFF)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x165667B1)
            counts += np.bincount(mixed >> np.uint32(23), minlength=BUCKETS)
    return counts

def digest(data: bytes) -> str:
    """The digest in hexadecimal: two digits of length, then two bits for each bucket."""
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    cuts = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts[:, None] > cuts[None, :]).sum(axis=1).reshape(-1, 4)
    body = (quartile << np.array([6, 4, 2, 0])).sum(axis=1).astype(np.uint8).tobytes()
    length = min(255, int(round(8 * np.log2(1 + len(data)))))
    return bytes([length]).hex() + body.hex()

def difference(one: str, other: str) -> int:
    """Bounded difference score of two digests; 0 for equal ones."""
    a, b = bytes.fromhex(one), bytes.fromhex(other)
    x, y = _PAIRS[np.frombuffer(a[1:], np.uint8)], _PAIRS[np.frombuffer(b[1:], np.uint8)]
    return int(STEPS[np.abs(x - y)].sum()) + min(MAX_LENGTH_DIFFERENCE,
                                                 abs(a[0] - b[0]) * LENGTH_STEP // 4)

def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 for those that differ as much as unrelated ones, or more."""
    return max(0.0, 1.0 - difference(one, other) / UNRELATED)

def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``fingerprint`` of the whole text; null counts as empty.

    Equal texts have equal fingerprints. Other columns are not read. One pass, no shuffle.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build():
        def run(batch):
            found = [digest(v.as_py().encode()) for v in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])
        return run
    return map_arrow(rows, build, f"doc_id {kind}, fingerprint string", "text")

def _slice(column: str, cuts: list[int]) -> Column:
    """How many cuts are at or below the id, by binary search; null ids are below all cuts."""
    if not cuts:
        return F.lit(0)
    bounds = F.lit(cuts)
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col(column)), at + step)
        .otherwise(at))

def in_id_order(df: DataFrame) -> DataFrame:
    """Rows (``doc_id``, ``text``) dealt into slices of the id order, sorted in each partition by
    ``slice``, ``helper`` and descending id, each slice followed by helper copies of the row that
    starts the next slice, so every row's successor is in its own partition. The last slice is
    followed by the first row of all.

    The text is shuffled once. Only the slices' bounds and first ids, of which there are at most
    ``MAX_SLICES``, pass the driver.
    """
    total = df.count()
    slices = max(1, min(MAX_SLICES, total // SLICE_ROWS))
    cuts = sorted({int(x) for x in df.where("doc_id is not null").approxQuantile(
        "doc_id", [i / slices for i in range(1, slices)], 0.2 / slices)}) if slices > 1 else []
    sliced = df.withColumn("slice", _slice("doc_id", cuts).cast("int"))
    heads = sliced.groupBy("slice").agg(F.max("doc_id").alias("head")).collect()
    down = sorted(heads, key=lambda r: -r["slice"])
    size = len(cuts) + 1
    head, target = [None] * size, [0] * size
    for i, r in enumerate(down):
        head[r["slice"]] = r["head"]
        target[r["slice"]] = down[i - 1]["slice"]  # the slice above; the first row goes last
    if down and all(h is None for h in head):
        first = F.lit(True)
    else:
        heads_of = F.array(*[F.lit(h).cast("long") for h in head]) if size < 3 else F.lit(
            [h if h is not None else -(1 << 63) for h in head])
        first = F.coalesce(F.get(heads_of, F.col("slice")) == F.col("doc_id"), F.lit(False))
        if head[0] is None:
            first = first | ((F.col("slice") == 0) & F.col("doc_id").isNull())
    main = F.struct(F.col("slice").alias("slice"), F.lit(0).alias("helper"))
    copy = F.struct(F.get(F.lit(target), F.col("slice")).alias("slice"), F.lit(1).alias("helper"))
    return (sliced.select("doc_id", "text", F.explode(
                F.when(first, F.array(main, copy)).otherwise(F.array(main))).alias("to"))
            .select("doc_id", "text", "to.slice", "to.helper")
            .repartition("slice")
            .sortWithinPartitions("slice", "helper", F.desc_nulls_last("doc_id"), "text"))

def with_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row beside its edited text: ``doc_id``, ``n_chars``, ``edited`` (the text with its last
    half, rounded down, replaced by the first as many code points of the next row's),
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Rows follow each other by descending id; null ids come last, equal ids by text, and the last row
    is followed by the first (a single row by itself). Null texts count as empty. No rows give none.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"),
                     F.coalesce(text, F.lit("")).alias("text"))

    ship(df.sparkSession)

    def run(batches):
        waiting = None  # (slice, id, text, fingerprint) of the row whose successor comes next
        for batch in batches:
            out = []
            for row, text_, slice_, helper in zip(
                    batch.column("doc_id").to_pylist(), batch.column("text"),
                    batch.column("slice").to_pylist(), batch.column("helper").to_pylist()):
                if helper and (waiting is None or waiting[0] != slice_):
                    continue  # a tie of the row that followed already
                value = text_.as_py()
                mark = digest(value.encode())
                if waiting is not None and waiting[0] == slice_:
                    _, id_, own, own_mark = waiting
                    keep = len(own) - len(own) // 2
                    edited = own[:keep] + value[:len(own) // 2]
                    edited_mark = digest(edited.encode())
                    out.append((id_, len(own), edited, own_mark, edited_mark,
                                likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                waiting = None if helper else (slice_, row, value, mark)
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
    return in_id_order(rows).mapInArrow(
        run, "doc_id long, n_chars long, edited string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")

def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
             pa.float64())
    names = ("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited",
             "near_next")
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], list(names))
