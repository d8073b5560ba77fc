"""Best-fit packing of token pieces into sequences, by bin completion.

What a packing costs depends only on how many pieces there are of each length, so the search runs
over counts by length: at most ``capacity`` numbers, whatever the corpus. It takes the longest
length left, enumerates the undominated ways to fill the rest of its sequence, and applies one to
as many sequences at once as the counts allow; fillings are tried best fit first, so the first
descent is a best-fit packing and the incumbent, and a branch is cut when its waste so far proves
that it cannot beat the incumbent. The plan, a bounded table of rank intervals, is then applied to
all pieces in parallel by their rank among pieces of their length.
"""
from __future__ import annotations

import functools
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .byte_bpe import encode, encoding
from .common import checkpointed, map_arrow

CAPACITY, END = 1024, 2
#: Fillings tried at each level of the search, and levels entered in all.
WIDTH, EFFORT = 4, 2_000
#: Multiples of the waste that the bound leaves each sequence, tried in turn.
EASE = (0.0, 0.5, 1.0, 2.0, 4.0)
#: Pieces whose ranks one window task counts, about.
RANKED = 200_000

# Text in these characters splits and merges alike in both libraries: plain ASCII and the letters
# and signs up to U+024F, whose classes have been the same in every Unicode version they follow.
_PLAIN = {**{c: None for c in range(32, 127)}, 9: None, 10: None, 13: None,
          **{c: None for c in range(0xA1, 0x250)}}


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def token_ids(text: str, path: str, ranks: str | None, pattern: str) -> list[int]:
    """Ids of a text by the tokenizer file at ``path``, without special tokens added.

    ``ranks`` names the same vocabulary as a rank file. Plain text without the string of a special
    token is encoded by it, which gives the same ids several times faster; the rest is not.
    """
    if (ranks and not text.translate(_PLAIN)
            and not any(special in text for special in _specials(path))):
        return encode(encoding(ranks, pattern), text)
    return _tokenizer(path).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, the remainder first."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def tokenize(df: DataFrame, path: str, ranks: str | None, pattern: str, doc_id: str = "doc_id",
             text: str = "text", capacity: int = CAPACITY, end: int = END,
             with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, on request,
    ``ids`` (little-endian 32 bits). Null and empty texts are the end token alone.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
              + (", ids binary" if with_ids else ""))

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc, raws = [], [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                ids = array("I", token_ids(value.as_py(), path, ranks, pattern))
                ids.append(end)
                if sys.byteorder == "big":
                    ids.byteswap()
                raw = memoryview(ids).cast("B")
                for k, (at, size) in enumerate(cut(len(ids), capacity)):
                    part = raw[4 * at:4 * (at + size)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raws.append(bytes(part))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())),
                       pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(raws, pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)
        return run
    return map_arrow(rows, build, schema, "text")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the larger of the filled volume and, for each threshold,
    the pieces too long to share plus what the middling ones cannot put beside them."""
    lengths = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for t in {0, *(n for n in lengths if 2 * n <= capacity)}:
        alone = sum(counts[n] for n in lengths if n > capacity - t)
        half = [n for n in lengths if capacity < 2 * n <= 2 * (capacity - t)]
        room = sum(counts[n] * (capacity - n) for n in half)
        small = sum(counts[n] * n for n in lengths if t <= n and 2 * n <= capacity)
        best = max(best, alone + sum(counts[n] for n in half)
                   + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over counts: each piece, longest first, goes where least room is left."""
    rooms: dict[int, list] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r, some in rooms.items() if r >= n and some), default=capacity)
            pattern, bins = rooms[room].pop() if rooms.get(room) else ((), left)
            each = min(room // n, left)
            used = min(bins, left // each)
            if pattern and bins > used:
                rooms[room].append((pattern, bins - used))
            rooms.setdefault(room - n * each, []).append((pattern + (n,) * each, used))
            left -= each * used
    return [step for some in rooms.values() for step in some]


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int,
             slack: int = 0) -> list[tuple]:
    """Up to ``width`` undominated fillings of ``room``. ``lengths`` are those with counts left,
    longest first.

    First comes the filling with the longest pieces among those that waste at most ``slack``, which
    saves short pieces for later; then fillings by waste, longest pieces first. One is dominated if
    some of its pieces could be swapped for one longer piece that is left over and still fits, or
    several for one of the same length.
    """
    if room <= 0 or not lengths or lengths[-1] > room:
        return [()]
    fits = [n for n in lengths if n <= room]
    # which sums can be made of the pieces at and after each position, as bits of an integer
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for n in reversed(fits):
        sums, left, take = reach[-1], min(counts[n], room // n), 1
        while left > 0:  # a count as parts of 1, 2, 4, ... pieces
            take = min(take, left)
            sums |= sums << (take * n) & mask
            left -= take
            take *= 2
        reach.append(sums)
    reach.reverse()
    present = sum(1 << n for n in fits)
    found: list[tuple] = []
    budget = [50 * width]

    def dominated(chosen: tuple, waste: int) -> bool:
        spare = present
        for n in set(chosen):
            if chosen.count(n) >= counts[n]:
                spare &= ~(1 << n)
        sums = {0: 0}
        for n in chosen[:12]:
            for s, k in list(sums.items()):
                sums[s + n] = max(sums.get(s + n, 0), k + 1)
        for s, k in sums.items():
            low = s if k > 1 else s + 1  # one piece for several, or a longer one for one
            if k and s + waste >= low and (spare >> low) & ((1 << (s + waste - low + 1)) - 1):
                return True
        return False

    def descend(at: int, target: int, spread: int, chosen: tuple, waste: int):
        """Pieces from position ``at`` on that sum to ``target``, or up to ``spread`` less."""
        budget[0] -= 1
        if target <= spread and not reach[at] >> 1 & ((1 << target) - 1):
            if chosen not in found and not dominated(chosen, waste + target):
                found.append(chosen)
            return
        low = max(0, target - spread)
        for i in range(at, len(fits)):
            if (len(found) >= limit[0] or budget[0] <= 0
                    or not reach[i] >> low & ((1 << (target - low + 1)) - 1)):
                return
            n = fits[i]
            spare = counts[n] - chosen.count(n)
            again = i if spare > 1 else i + 1
            after, least = target - n, max(0, low - n)
            if after >= 0 and spare > 0 and reach[again] >> least & ((1 << (after - least + 1)) - 1):
                descend(again, after, spread, chosen + (n,), waste)
        if target <= spread and len(found) < limit[0] and chosen not in found:
            if not dominated(chosen, waste + target):
                found.append(chosen)

    limit = [1]
    if slack:
        descend(0, room, min(slack, room), (), 0)
    limit[0] = width
    for total in range(room, -1, -1):
        if len(found) >= width or budget[0] <= 0:
            break
        if reach[0] >> total & 1:
            descend(0, total, 0, (), room - total)
    return found or [()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH,
         effort: int = EFFORT) -> list[tuple[tuple, int]]:
    """(lengths of one sequence, number of such sequences) holding every piece exactly once.

    Best-fit decreasing is the first incumbent. Descents that allow a sequence some multiple of the
    waste there is to spare then take the first filling everywhere; after them the most promising of
    the fillings passed over are followed, depth first. A branch is cut when its sequences so far
    and the volume left cannot beat the incumbent. The search ends when the lower bound is met or
    ``effort`` levels have been entered; the best plan found is whole in any case.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c > 0}
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    if not counts:
        return []
    goal = lower_bound(counts, capacity)
    volume = sum(n * c for n, c in counts.items())
    best = best_fit(counts, capacity)
    fewest = sum(times for _, times in best)
    entered = 0
    later: list[tuple] = []

    def descend(left, made, steps, rest, ease):
        nonlocal best, fewest, entered
        while left:
            entered += 1
            if made + -(-rest // capacity) >= fewest:
                return
            lengths = sorted(left, reverse=True)
            longest = lengths[0]
            spare = max(0, (goal - made) * capacity - rest)
            slack = int(ease * spare / max(1, goal - made))
            left[longest] -= 1
            options = fillings([n for n in lengths if left[n] > 0], left, capacity - longest,
                               width, slack)
            left[longest] += 1
            later.extend((*_applied(left, made, steps, rest, (longest, *other)), ease)
                         for other in options[1:])
            left, made, steps, rest = _applied(left, made, steps, rest, (longest, *options[0]))
        if made < fewest:
            fewest, best = made, []
            while steps:
                steps, pattern, times = steps
                best.append((pattern, times))

    for ease in EASE:
        if fewest > goal:
            descend(dict(counts), 0, (), volume, ease)
    while later and fewest > goal and entered < effort:
        later.sort(key=lambda node: (-(node[1] + -(-node[3] // capacity)), node[1]))
        del later[:-effort]
        descend(*later.pop())
    return best


def _applied(left: dict, made: int, steps, rest: int, pattern: tuple):
    """Use a pattern for as many sequences as the counts allow."""
    need: dict[int, int] = {}
    for n in pattern:
        need[n] = need.get(n, 0) + 1
    times = min(left[n] // k for n, k in need.items())
    after = dict(left)
    for n, k in need.items():
        after[n] -= k * times
        if not after[n]:
            del after[n]
    return after, made + times, (steps, pattern, times), rest - times * sum(pattern)


def intervals(steps: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """The plan as rank intervals: pieces of ``length`` with ranks from ``rank`` on, ``times`` of
    them, go to sequences from ``sequence`` on at ``offset``. At most one row per step and piece."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in steps:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns))


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Add ``rank``, from 0, among the pieces of each length.

    Pieces of a length are cut into slices by a hash; a slice is ranked alone and shifted by the
    sizes of the slices before it, so a length that a third of all pieces have is many small tasks.
    """
    slices = max(1, -(-total // RANKED)) * 4
    cut_up = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                               F.lit(slices)).cast("int"))
    sizes = cut_up.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("length").alias("_l"), F.col("slice").alias("_s"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    local = cut_up.withColumn("local", F.row_number().over(inside) - 1)
    return (local.join(shifts, (local.length == shifts._l) & (local.slice == shifts._s))
            .withColumn("rank", F.col("local") + F.col("shift")))


def pack(pieces: DataFrame, capacity: int = CAPACITY, width: int = WIDTH,
         effort: int = EFFORT) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: every piece in one sequence, gapless from 0.

    ``pieces`` has ``doc_id``, ``piece``, ``length`` (1 to ``capacity``) and ``ids_crc32`` among
    its columns. Repeated rows are pieces of their own. An empty table gives no rows.
    """
    kept = checkpointed(pieces)  # tokenizing is dear, and ranks must not change under a retry
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(
        F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = intervals(plan(counts, capacity, width, effort))
    shift = np.int64(1 << 48)
    keys = table["length"] * shift + table["rank"] if len(table["length"]) else np.zeros(0, np.int64)
    ranked = _ranked(kept, sum(counts.values())).select(*kept.columns, "rank")
    names = kept.columns
    schema = kept.schema.add("sequence_id", "long").add("offset", "long")

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(keys, length * shift + rank, side="right") - 1
            sequence = table["sequence"][row] + rank - table["rank"][row]
            return pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(sequence), pa.array(table["offset"][row])],
                [*names, "sequence_id", "offset"])
        return run
    return map_arrow(ranked, build, schema)
