"""Repeated byte strings found and removed by suffix sorting around content-chosen anchors.

Every string of ``length`` bytes holds one anchor: its 48-byte gram with the smallest hash, the
leftmost of equals. Equal strings have equal anchors at equal offsets, so only suffixes that start
before the same anchor need ordering. Neighbouring starts with one anchor form a run, which is one
row. Anchors that occur once in the corpus are dropped; runs equal as a whole are repeats outright;
the few that share an anchor but differ are ordered by deep-shallow sorting: multikey quicksort to a
shallow depth, then blind tries for groups with long common prefixes. Common prefixes to the right
of the anchor and, reversed, to its left tell exactly which starts are repeated.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, fresh, give_back, map_arrow, small_batches

LENGTH, GRAM = 200, 48
#: Window starts whose anchors are found at once: about 13 MB of numbers, whatever the texts' length.
STARTS = 1 << 17
#: Depth to which multikey quicksort orders suffixes before blind tries take over.
SHALLOW = GRAM + 16
#: Distinct contexts of one anchor up to which common prefixes are put side by side in a matrix, and
#: up to which they are ordered in one task at all; beyond, windows are hashed instead.
MATRIX, LARGEST = 48, 50_000

_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 48 bytes from each position, by doubling: 2, 4, 8, 16, 32, then 32 and 16."""
    value, size, sixteen = _BYTES[raw], 1, None
    for odd in _ODD[:5]:
        value = value[:len(value) - size] * odd + value[size:]
        value ^= value >> np.uint64(29)
        size *= 2
        if size == 16:
            sixteen = value
    value = value[:len(value) - 16] * _ODD[5] + sixteen[32:]
    value ^= value >> np.uint64(31)
    return value * _ODD[3]


def anchors(raw: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position and hash of the anchor of every ``length``-byte string, ``STARTS`` of them at a time,
    each part with its first start."""
    count, width = len(raw) - length + 1, length - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    for at in range(0, count, STARTS):
        n = min(STARTS, count - at)
        grams = gram_hashes(raw[at:at + n + length - 1])
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        padded = -(-len(key) // width) * width
        rows = np.full(padded, np.uint64(0xFFFFFFFFFFFFFFFF))
        rows[:len(key)] = key
        rows = rows.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
        where = (least & low).astype(np.int64)
        yield at, where + at, grams[where]


def runs(texts: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of neighbouring starts with one anchor: document number, ``start`` in its document,
    ``before`` (bytes from start to anchor), ``more`` (further starts), anchor hash ``h`` and
    hash ``sh`` of all bytes that the run's strings cover.

    What is held beside the texts is a few numbers for each run and for ``STARTS`` starts, however
    long a text is."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    open_: tuple[int, int, int] | None = None  # document, anchor and last start of the newest run
    for at, position, hashed in anchors(np.frombuffer(data, np.uint8), length):
        starts = np.arange(at, at + len(position))
        doc = np.searchsorted(ends, starts, side="right")
        whole = np.flatnonzero(starts + length <= ends[doc])
        if not len(whole):
            continue
        starts, doc, position, hashed = starts[whole], doc[whole], position[whole], hashed[whole]
        new = np.ones(len(starts), bool)
        # a text of exactly ``length`` bytes may touch the next: a run never spans two documents
        new[1:] = (np.diff(starts) != 1) | (np.diff(position) != 0) | (np.diff(doc) != 0)
        new[0] = open_ != (doc[0], position[0], starts[0] - 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        if not new[0]:  # the newest run goes on
            parts[-1][1][-1] = starts[first[0] - 1 if len(first) else -1]
        if len(first):
            parts.append((starts[first], starts[last], doc[first], position[first], hashed[first]))
        open_ = (doc[-1], position[-1], starts[-1])
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "before", "more", "h", "sh")}
    lo, hi, doc, position, hashed = (np.concatenate(c) for c in zip(*parts))
    digest = xxhash.xxh3_64_intdigest
    sh = np.fromiter((digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())),
                     np.uint64, len(lo))
    begins = np.concatenate(([0], ends[:-1]))
    return {"doc": doc, "start": lo - begins[doc], "before": position - lo, "more": hi - lo,
            "h": hashed.view(np.int64), "sh": sh.view(np.int64)}


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Trie:
    """A blind trie: nodes keep only their depth and branching bytes; -1 is the end of a string."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list | int = first
        self.same: dict[int, list[int]] = {first: [first]}

    def insert(self, new: int) -> None:
        text, node = self.strings[new], self.root
        while isinstance(node, list):  # descend blindly, by branching bytes alone
            depth, branches = node
            byte = text[depth] if depth < len(text) else -1
            node = branches[byte] if byte in branches else next(iter(branches.values()))
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        other = self.strings[node]
        shared = common_prefix(text, other)
        if shared == len(text) == len(other):
            self.same[node].append(new)
            return
        self.same[new] = [new]
        parent, edge, node = None, None, self.root
        while isinstance(node, list) and node[0] < shared:
            parent, edge = node, (text[node[0]] if node[0] < len(text) else -1)
            node = node[1][edge]
        mine = text[shared] if shared < len(text) else -1
        if isinstance(node, list) and node[0] == shared:
            node[1][mine] = new
            return
        theirs = other[shared] if shared < len(other) else -1
        split = [shared, {theirs: node, mine: new}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the string before it) in sorted order; 0 for the first."""
        stack, shared = [(self.root, 0)], 0
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                depth, branches = node
                for i, byte in enumerate(sorted(branches, reverse=True)):
                    last = i == len(branches) - 1
                    stack.append((branches[byte], shared if last else depth))
                continue
            for k, string in enumerate(self.same[node]):
                yield string, shared if k == 0 else len(self.strings[node])


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and each one's common prefix with the one before it (0 for the first).

    Ties keep their order of insertion. Groups that agree to the shallow depth go to a blind trie.
    """
    order: list[int] = []
    shared: list[int] = []
    # (strings, depth they agree to, common prefix of the first with what came before)
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, before = stack.pop()
        if not group:
            continue
        if len(group) == 1 or depth >= shallow:
            trie = _Trie(strings, group[0])
            for i in group[1:]:
                trie.insert(i)
            for k, (string, common) in enumerate(trie.ordered()):
                order.append(string)
                shared.append(before if k == 0 else common)
            continue
        middle = strings[group[len(group) // 2]]
        if depth == 0:  # what all agree on need not be looked at byte by byte
            low, high = min(strings[i] for i in group), max(strings[i] for i in group)
            depth = min(common_prefix(low, high), shallow)
            if depth == shallow:
                stack.append((group, depth, before))
                continue
        pivot = middle[depth] if depth < len(middle) else -1
        less, equal, more = [], [], []
        for i in group:
            text = strings[i]
            byte = text[depth] if depth < len(text) else -1
            (less if byte < pivot else more if byte > pivot else equal).append(i)
        parts = [(less, depth), (equal, depth + 1 if pivot >= 0 else shallow), (more, depth)]
        parts = [p for p in parts if p[0]]
        for k in range(len(parts) - 1, -1, -1):
            stack.append((*parts[k], before if k == 0 else depth))
    return order, shared


def _prefix_matrix(strings: list[bytes]) -> np.ndarray:
    """Common prefix of every two strings of one group, from their sorted neighbours."""
    order, shared = deep_shallow(strings)
    n = len(strings)
    sorted_ = np.zeros((n, n), np.int16)
    neighbour = np.array(shared, np.int16)
    for i in range(n - 1):
        sorted_[i, i + 1:] = np.minimum.accumulate(neighbour[i + 1:])
    sorted_ = np.maximum(sorted_, sorted_.T)
    out = np.empty_like(sorted_)
    out[np.ix_(order, order)] = sorted_
    return out


def _starts_by_class(left: list[bytes], right: list[bytes], length: int
                     ) -> list[list[tuple[int, int]]]:
    """Ranges (nearest, farthest) of offsets to the anchor that are repeated, for each context.

    In sorted order a new class begins where the common prefix falls short, so strings with one
    start offset are equal exactly if their classes to the left and to the right are.
    """
    n = len(left)
    ranks, shared, lengths = [], [], []
    for strings in (left, right):
        order, common = deep_shallow(strings)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        shared.append(np.array(common))
        lengths.append(np.array([len(s) for s in strings]))
    repeated = np.zeros((n, length - GRAM + 3), bool)  # with an empty column on either side
    for offset in range(length - GRAM + 1):
        rows = np.flatnonzero((lengths[0] >= offset) & (lengths[1] >= length - offset))
        if len(rows) < 2:
            continue
        before = np.cumsum(shared[0] < offset)[ranks[0][rows]] if offset else 0
        after = np.cumsum(shared[1] < length - offset)[ranks[1][rows]]
        _, member, size = np.unique(before * (n + 1) + after, return_inverse=True,
                                    return_counts=True)
        repeated[rows[size[member] > 1], offset + 1] = True
    edges = np.diff(repeated.astype(np.int8), axis=1)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for (i, a), (_, b) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist()):
        spans[i].append((a, b - 1))
    return spans


def repeated_starts(contexts: list[tuple[bytes, int, int]], length: int = LENGTH
                    ) -> list[list[tuple[int, int]]]:
    """For contexts (bytes, bytes before the anchor, times it occurs) of one anchor: the ranges
    (first, last) of starts in each whose string of ``length`` bytes also starts elsewhere."""
    if len(contexts) == 1:
        data, _, times = contexts[0]
        return [[(0, len(data) - length)] if times > 1 else []]
    left = [data[:before][::-1] for data, before, _ in contexts]
    right = [data[before:] for data, before, _ in contexts]
    if len(contexts) > MATRIX:
        found = _starts_by_class(left, right, length)
        return [[(0, len(data) - length)] if times > 1 else
                [(before - b, before - a) for a, b in reversed(spans)]
                for (data, before, times), spans in zip(contexts, found)]
    if len(contexts) == 2:
        lefts = rights = None
        pair = common_prefix(*left), common_prefix(*right)
    else:
        lefts, rights = _prefix_matrix(left), _prefix_matrix(right)
    out = []
    for i, (data, before, times) in enumerate(contexts):
        if times > 1:
            out.append([(0, len(data) - length)])
            continue
        if lefts is None:
            spans = [(length - pair[1], pair[0])]
        else:
            near, far = length - rights[i].astype(np.int64), lefts[i].astype(np.int64)
            some = near <= far
            some[i] = False
            spans = sorted(set(zip(near[some].tolist(), far[some].tolist())))
        merged: list[list[int]] = []
        for a, b in spans:  # offsets from a start to the anchor
            if a > b:
                continue
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out.append([(before - b, before - a) for a, b in reversed(merged)])
    return out


_RUN = "h long, sh long"
_PLACE = "doc_id long, th long, pos long"


def _place(start, before, more):
    return start << 16 | before << 8 | more


def _runs_of(docs: DataFrame, length: int, with_place: bool) -> DataFrame:
    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = runs(batch.column("data").to_pylist(), length)
            columns, names = [pa.array(found["h"]), pa.array(found["sh"])], ["h", "sh"]
            if with_place:
                doc = pa.array(found["doc"])
                columns += [batch.column("doc_id").take(doc), batch.column("th").take(doc),
                            pa.array(_place(found["start"], found["before"], found["more"]))]
                names += ["doc_id", "th", "pos"]
            return pa.RecordBatch.from_arrays(columns, names)
        return run
    return map_arrow(docs, build, f"{_RUN}, {_PLACE}" if with_place else _RUN, "data")


def _slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs, fetched from their documents."""
    per_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(
        F.struct("h", "sh", "pos", "times", "classes")).alias("wanted"))
    joined = docs.join(per_doc.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"),
                                      "wanted").hint("shuffle_hash"),
                       F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for data, doc_id, th, wanted_ in zip(
                    batch.column("data"), batch.column("doc_id").to_pylist(),
                    batch.column("th").to_pylist(), batch.column("wanted").to_pylist()):
                data = data.as_py()
                for w in wanted_:
                    start, more = w["pos"] >> 16, w["pos"] & 255
                    out.append((w["h"], w["times"], w["classes"], doc_id, th, w["pos"],
                                data[start:start + more + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                     pa.binary())
            columns = zip(*out) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["h", "times", "classes", "doc_id", "th", "pos", "slice"])
        return run
    return map_arrow(joined.select("data", "doc_id", "th", "wanted"), build,
                     "h long, times long, classes long, doc_id long, th long, pos long, "
                     "slice binary", "data")


def _ordered(slices: DataFrame, length: int) -> DataFrame:
    """Repeated starts of the contexts that occur once, anchor by anchor, each group in one task."""
    def run(batches):
        group: list[tuple] = []

        def finish():
            if len(group) < 2:
                return []
            found = repeated_starts(
                [(s, pos >> 8 & 255, times) for _, times, _, _, pos, s in group], length)
            return [(doc_id, th, (pos >> 16) + a, (pos >> 16) + b)
                    for (_, times, doc_id, th, pos, _), spans in zip(group, found) if times == 1
                    for a, b in spans]

        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist()
                             for c in ("h", "times", "doc_id", "th", "pos", "slice")]):
                if group and group[0][0] != row[0]:
                    out += finish()
                    group = []
                group.append(row)
            yield _spans(out)
        yield _spans(finish())
        group = []
        give_back()
    small_batches(slices.sparkSession)
    return (slices.drop("classes").repartition("h").sortWithinPartitions("h")
            .mapInArrow(run, "doc_id long, th long, first long, last long"))


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      ["doc_id", "th", "first", "last"])


def _hashed(slices: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more contexts than one task should order: each string of
    ``length`` bytes becomes a 128-bit hash, and hashes that occur twice are counted by Spark."""
    def build():
        def run(batch):
            out = []
            for times, doc_id, th, pos, data in zip(*[
                    batch.column(c).to_pylist() for c in ("times", "doc_id", "th", "pos", "slice")]):
                for k in range(len(data) - length + 1):
                    out.append((xxhash.xxh3_128_digest(data[k:k + length]), times, doc_id, th,
                                (pos >> 16) + k))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out) if out else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["w", "times", "doc_id", "th", "first"])
        return run
    windows = map_arrow(slices, build, "w binary, times long, doc_id long, th long, first long",
                        "slice")
    repeated = windows.groupBy("w").agg(F.sum("times").alias("n")).where("n > 1").select("w")
    return windows.where("times = 1").join(repeated, "w").select(
        "doc_id", "th", "first", F.col("first").alias("last"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, largest: int = LARGEST) -> DataFrame:
    """Ranges (``first``, ``last``) of starts, by ``doc_id`` and ``th``, of repeated strings.

    ``docs`` has ``doc_id`` (long), ``th`` (a hash of the text) and ``data`` (its bytes). Ranges of
    one document may touch or overlap. Text is read twice for runs and shuffled once for contexts,
    twice if some anchor has more of them than ``largest``; counts are partial aggregates and hot
    anchors sit on the side of a join that can be split. Each step is stored by itself, so that the
    shuffles of the one are off the disk before the next begins.
    """
    once = _runs_of(docs, length, False).groupBy("h").agg(
        F.count("*").alias("n"), F.min("sh").alias("low"), F.max("sh").alias("high"))
    # stored, so that the join below reads plain shuffles, whose hot anchors can be split
    shared = checkpointed(once.where("n > 1").select(
        F.col("h").alias("_h"), (F.col("low") == F.col("high")).alias("single")))
    kept = checkpointed(_runs_of(docs, length, True).join(shared.hint("merge"), F.col("h") == F.col("_h"))
                        .drop("_h"))

    def ranges(rows):
        start = F.shiftright("pos", 16)
        return rows.select("doc_id", "th", start.alias("first"),
                           (start + F.col("pos").bitwiseAND(255)).alias("last"))

    equal = ranges(kept.where("single"))
    mixed = kept.where("not single")
    classes = mixed.groupBy("h", "sh").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "pos")).alias("one"))
    number = classes.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("classes"))
    wanted = checkpointed(classes.join(number, F.col("h") == F.col("_h")).select(
        "h", "sh", "times", "classes", "one.*"))
    again = wanted.where("times > 1").select(F.col("h").alias("_h"), F.col("sh").alias("_sh"))
    copies = ranges(mixed.join(again.hint("merge"), (F.col("h") == F.col("_h"))
                               & (F.col("sh") == F.col("_sh"))))
    few, many = wanted.where(F.col("classes") <= largest), wanted.where(F.col("classes") > largest)
    out = equal.unionByName(copies).unionByName(checkpointed(_ordered(_slices(docs, few, length), length)))
    if not many.isEmpty():
        out = out.unionByName(_hashed(checkpointed(_slices(docs, many, length)), length))
    return out


def merged(ranges: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte spans (start, end) covered by strings that start in the ranges."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [tuple(s) for s in out]


def with_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 length: int = LENGTH, name: str = "repeats") -> tuple[DataFrame, str]:
    """The frame, all columns and rows as they are, with one more: ``name`` (or the next free name,
    which is returned), an array of (``first``, ``last``) ranges of starts whose string of
    ``length`` bytes of UTF-8 also starts elsewhere in the corpus; null where there are none.

    Null texts count as empty. Texts shorter than ``length`` have no such strings. Repeated rows
    are documents of their own, so each repeats the other. An empty table gives no rows.
    """
    column, th, other_id, other_th = fresh(df, name, "_th", "_other_id", "_other_th")
    value: Column = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(value).alias("th"),
                     value.cast("binary").alias("data"))
    per_doc = checkpointed(  # the shuffles of the ranges go before those of the text come
        repeated_ranges(docs, length).groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct("first", "last")).alias(column))
        .select(F.col("doc_id").alias(other_id), F.col("th").alias(other_th), column))
    joined = (df.withColumn(th, F.xxhash64(value))
              .join(per_doc.hint("shuffle_hash"),
                    F.col(doc_id).cast("long").eqNullSafe(F.col(other_id))
                    & (F.col(th) == F.col(other_th)), "left"))
    return joined.drop(th, other_id, other_th), column


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def removed(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
            length: int = LENGTH) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left."""
    rows, column = with_repeats(
        df.select(F.col(doc_id).cast("long").alias("doc_id"),
                  F.coalesce(text, F.lit("")).alias("text")), "doc_id", "text", length)

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, gone, number, kept = [], [], [], []
            for value, ranges in zip(batch.column("text"), batch.column(column).to_pylist()):
                data = value.as_py().encode()
                spans = merged([(r["first"], r["last"]) for r in ranges], length) if ranges else []
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in spans))
                number.append(len(spans))
                kept.append(cut_out(data, spans) if spans else data)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(number, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        return run
    return map_arrow(rows, build, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                  "kept binary", "text")


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    length_column: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """The frame, all columns and rows, with repeated strings cut out of ``text``.

    A character that a cut leaves in part goes as well, so the text stays valid; ``length_column``,
    where the frame has it, becomes the number of code points left. Null texts stay null.
    """
    rows, column = with_repeats(df, doc_id, text, length)
    names, at = df.columns, df.columns.index(text)
    counted = names.index(length_column) if length_column in names else None

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [batch.column(c) for c in names]
            changed = {}
            for i, ranges in enumerate(batch.column(column).to_pylist()):
                if ranges:
                    data = batch.column(text)[i].as_py().encode()
                    spans = merged([(r["first"], r["last"]) for r in ranges], length)
                    changed[i] = cut_out(data, spans).decode("utf-8", "ignore")
            if changed:
                texts = columns[at].to_pylist()
                lengths = columns[counted].to_pylist() if counted is not None else None
                for i, value in changed.items():
                    texts[i] = value
                    if lengths is not None:
                        lengths[i] = len(value)
                columns[at] = pa.array(texts, columns[at].type)
                if lengths is not None:
                    columns[counted] = pa.array(lengths, columns[counted].type)
            return pa.RecordBatch.from_arrays(columns, names)
        return run
    return map_arrow(rows, build, df.schema, text)
