"""P4 and W4 beyond direct references: everything a field's visibility rests on, and circles in it.

Dictionaries may be many, one for each project; nothing of them reaches the driver.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .similarity import spread

# Workers get these small functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A field in skip logic, with or without a checkbox code or an event before it.
REFERENCE = r"\[([A-Za-z][A-Za-z0-9_]*)(?:\([^)]*\))?\]"
#: Edges of a project for each part that its fields are dealt into.
PART = 1 << 12
#: Most pairs of field and gate that a task marks at a time, and rows of a batch that it hands on.
MARKED, ROWS = 1 << 22, 1 << 15
#: Bytes of the steps that a task holds at a time, and rounds over the fields before it walks step by step.
HELD, ROUNDS = 1 << 24, 32
#: Columns of a field's folded gates: their number and two sums of hashes.
FOLDS = ("_n", "_h", "_i")


def gate_edges(fields: DataFrame, project: str = "project_id", field: str = "field_name",
               logic: str = "branching_logic") -> DataFrame:
    """(project_id, field, gate): the fields that each field's logic names and its project has."""
    own = fields.select(F.col(project).alias("project_id"), F.col(field).alias("field"), F.col(logic).alias("logic"))
    named = own.select("project_id", "field", F.explode(F.array_distinct(F.regexp_extract_all(
        F.coalesce("logic", F.lit("")), F.lit(REFERENCE), F.lit(1)))).alias("gate"))
    known = own.select("project_id", F.col("field").alias("gate")).distinct()
    return named.distinct().join(known, ["project_id", "gate"], "left_semi").select("project_id", "field", "gate")


def _steps(starts: np.ndarray, first: np.ndarray, gates: np.ndarray, nodes: int, follow: bool):
    """Every node met from each start, nearest first: (place of the start, node, steps) a step.

    The gates of node ``i`` are ``gates[first[i]:first[i + 1]]``.
    """
    met = np.zeros(len(starts) * nodes, np.bool_)
    at, node, depth = np.arange(len(starts)), starts, 0
    while len(at):
        count = first[node + 1] - first[node]
        ends = np.cumsum(count)
        inside = np.arange(ends[-1]) - np.repeat(ends - count, count)
        reached = np.repeat(at, count) * nodes + gates[np.repeat(first[node], count) + inside]
        reached = np.unique(reached[~met[reached]])
        met[reached] = True
        at, node, depth = reached // nodes, reached % nodes, depth + 1
        if len(at):
            yield at, node, depth
        if not follow:
            return


def _graph(edges: pa.Table):
    """A project's edges by number: names, gates, where each node's gates begin, and the part's own starts."""
    both = pa.chunked_array(edges.column("field").chunks + edges.column("gate").chunks).combine_chunks() \
        .dictionary_encode()
    names = both.dictionary
    # a null is no field that others could name, but may itself have gates: it is the last node
    codes = both.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    field, gate = codes[:len(edges)], codes[len(edges):]
    order = np.argsort(field, kind="stable")
    nodes = len(names) + 2
    gate = np.where(gate == len(names), nodes - 1, gate)  # a gate that is null leads nowhere
    first = np.searchsorted(field[order], np.arange(nodes + 1))
    return pa.concat_arrays([names, pa.nulls(2, names.type)]), gate[order], first, \
        np.unique(field[edges.column("_own").to_numpy()])


def _closed(batches: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What a part's own fields of a project rest on; the batches hold all edges of the project."""
    edges = pa.Table.from_batches(batches)
    project = edges.column("project_id")
    names, gates, first, starts = _graph(edges)
    nodes = len(names)
    size = max(1, MARKED // nodes)
    held, waiting = [], 0

    def rows():
        at, node, depth = (np.concatenate(x) for x in zip(*held))
        for i in range(0, len(at), ROWS):
            cut = slice(i, i + ROWS)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(project[0], len(at[cut])), names.take(pa.array(at[cut])),
                names.take(pa.array(node[cut])), pa.array(depth[cut], pa.int32())], schema=schema)

    for i in range(0, len(starts), size):
        block = starts[i:i + size]
        for at, node, depth in _steps(block, first, gates, nodes, project[0].is_valid):
            held.append((block[at], node, np.full(len(at), depth)))
            waiting += len(at)
            if waiting >= ROWS:
                yield from rows()
                held, waiting = [], 0
    if held:
        yield from rows()


def _order(first: np.ndarray, gates: np.ndarray) -> list[int]:
    """The nodes, each before its gates as far as circles allow: a depth-first walk's ends, last first."""
    first, gates = first.tolist(), gates.tolist()
    at, seen, ended = first[:-1], bytearray(len(first) - 1), []
    for root in range(len(at)):
        if seen[root]:
            continue
        seen[root], path = 1, [root]
        while path:
            node = path[-1]
            if at[node] == first[node + 1]:
                ended.append(path.pop())
                continue
            gate = gates[at[node]]
            at[node] += 1
            if not seen[gate]:
                seen[gate] = 1
                path.append(gate)
    return ended[::-1]


def _least_steps(starts: np.ndarray, first: np.ndarray, gates: np.ndarray, nodes: int, order: list[int],
                 kind: type) -> np.ndarray:
    """Least steps from each start (a column) to each node (a row), 0 to itself; the type's largest number if
    the node is not met. All starts take an edge at once, edges in the order of their fields; a circle takes
    further rounds over the nodes that changed. What is not settled after some rounds is walked instead."""
    far = np.iinfo(kind).max - 1  # one step more is no overflow
    steps = np.full((nodes, len(starts)), far, kind)
    steps[starts, np.arange(len(starts))] = 0
    ends, to = first.tolist(), gates.tolist()
    more, less = np.empty(len(starts), kind), np.empty(len(starts), np.bool_)
    # every field has its turn in the first round, later only one whose steps became fewer
    waits, done = bytearray(b"\1") * nodes, bytearray(nodes)
    for _ in range(ROUNDS):
        again = False
        done[:] = bytes(nodes)
        for node in order:
            done[node] = 1
            if not waits[node]:
                continue
            waits[node] = 0
            np.add(steps[node], 1, out=more)
            for gate in to[ends[node]:ends[node + 1]]:
                row = steps[gate]
                np.less(more, row, out=less)
                if less.any():
                    np.minimum(more, row, out=row)
                    waits[gate] = 1
                    again |= done[gate]
        if not again:
            return steps
    for at, node, depth in _steps(starts, first, gates, nodes, True):
        steps[node, at] = depth
    steps[starts, np.arange(len(starts))] = 0
    return steps


def _circled(batches: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What ``logic_cycles`` folds of the part's paths, a row for each own field that rests on itself."""
    edges = pa.Table.from_batches(batches)
    project = edges.column("project_id")
    names, gates, first, starts = _graph(edges)
    nodes = len(names)
    starts = starts[starts < nodes - 2]  # a null rests on no null
    if not (project[0].is_valid and len(starts)):
        return
    # two 64-bit hashes of each name, and of a gate that is null, in pieces whose sums are exact as doubles
    pieces = np.frombuffer(b"".join(blake2b(repr(x).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                                    for x in names.to_pylist()), np.uint32).reshape(-1, 4).T.astype(np.float64)
    kind = np.int16 if nodes < 1 << 14 else np.int32
    order, size = _order(first, gates), max(1, HELD // (nodes * kind().itemsize))
    field = np.repeat(np.arange(nodes), np.diff(first))
    for i in range(0, len(starts), size):
        block = starts[i:i + size]
        steps = _least_steps(block, first, gates, nodes, order, kind)
        far = np.iinfo(kind).max - 1
        # back to the start: one step more than to a field that names it
        length = np.full(len(block), far, np.int64)
        last = np.flatnonzero(np.isin(gates, block))
        column = np.searchsorted(block, gates[last])
        np.minimum.at(length, column, steps[field[last], column].astype(np.int64) + 1)
        back = np.flatnonzero(length < far)
        if not len(back):
            continue
        count, sums = np.zeros(len(back), np.int64), np.zeros((4, len(back)), np.uint64)
        rows = max(1, HELD // (16 * len(back)))
        for j in range(0, nodes, min(rows, 1 << 20)):
            met = (steps[j:j + min(rows, 1 << 20)] < far)[:, back]
            count += met.sum(axis=0)
            sums += (pieces[:, j:j + len(met)] @ met.astype(np.float64)).astype(np.uint64)
        folds = sums[::2] + (sums[1::2] << np.uint64(32))  # wraps around
        yield pa.RecordBatch.from_arrays([
            pa.repeat(project[0], len(back)), names.take(pa.array(block[back])),
            pa.array(length[back], pa.int32()), pa.array(count), *(pa.array(h.view(np.int64)) for h in folds)],
            schema=schema)


def gate_closure(edges: DataFrame, folded: bool = False) -> DataFrame:
    """(project_id, field, gate, depth): every field that a field rests on, directly or through others, and
    the least number of steps. A field in a circle rests on itself.

    The fields of a project are dealt into parts, more for a larger project; each part gets the project's
    edges and walks them from all its fields at once, step by step. So edges are shuffled and no path is:
    the rows, which may be as many as the square of a project's fields, go straight to whoever reads them.
    A project without an id has no paths, only its edges.

    ``folded`` finds the same steps between every two fields, but hands on what ``logic_cycles`` makes of the
    rows, folded by the task that finds them: (project_id, field, length, _n, _h, _i), a row for each field that
    rests on itself.
    """
    edges = edges.select("project_id", "field", "gate")
    own = list(edges.schema)
    schema = StructType([*own[:2], StructField("length", IntegerType()), *(StructField(n, LongType()) for n in FOLDS)]
                        if folded else [*own, StructField("depth", IntegerType())])
    parts = edges.groupBy(F.col("project_id").alias("_p")).agg(
        F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    dealt = edges.join(parts, F.col("project_id").eqNullSafe(F.col("_p"))).drop("_p").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn(
        "_own", F.pmod(F.xxhash64("field"), F.col("_parts")) == F.col("_part")).drop("_parts")

    def closed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        names = held[0].schema
        if folded:
            yield from _circled(held, pa.schema([names.field("project_id"), names.field("field"), pa.field(
                "length", pa.int32()), *(pa.field(n, pa.int64()) for n in FOLDS)]))
        else:
            yield from _closed(held, pa.schema([*(names.field(n) for n in ("project_id", "field", "gate")),
                                                pa.field("depth", pa.int32())]))
    return spread(dealt, "project_id", "_part").groupBy("project_id", "_part").applyInArrow(closed, schema)


def logic_cycles(closure: DataFrame) -> DataFrame:
    """(project_id, field, cycle, length): fields that rest on themselves. ``cycle`` is the least field of
    those that rest on each other, ``length`` the number of steps back to the field.

    Two fields in circles rest on each other exactly if they rest on the same fields, so each field's gates
    are folded to their number and two sums of hashes, and fields are grouped by those. A closure of rows is
    read once and folded before it is shuffled; with many fields in a project take a ``folded`` one, whose
    rows are folded where they are made.
    """
    if "gate" in closure.columns:
        total = lambda h: F.sum(h.cast("decimal(38,0)"))
        closure = closure.where("project_id is not null and field is not null").groupBy("project_id", "field").agg(
            F.min(F.when(F.col("field") == F.col("gate"), F.col("depth"))).alias("length"),
            F.count(F.lit(1)).alias("_n"), total(F.xxhash64("gate")).alias("_h"),
            total(F.xxhash64(F.lit("gates"), "gate")).alias("_i")).where("length is not null")
    return closure.withColumn("cycle", F.min("field").over(Window.partitionBy("project_id", *FOLDS))).select(
        "project_id", "field", "cycle", "length")
