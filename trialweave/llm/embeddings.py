"""Embedding near duplicates by a forest of random-projection trees with spill.

Vectors with one label start in one node. A node that is too large is split by recursive random
hyperplanes fitted on a bounded sample of its rows; rows close to a hyperplane go to both sides.
Several independent trees start at each label, so a pair that one tree parts is met in another.
Splitting is repeated until every leaf is small, or so dense that no plane parts it; leaves that
stay large are compared block against block, whole. Within a leaf every pair is verified by its
cosine, and counted only in the first leaf that it shares, so no pair is ever written out: a leaf
returns a count for each vector and one edge to the smallest vector it connects to.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, map_arrow
from .components import components

THRESHOLD = 0.98
TREES, LEAF, BLOCK = 6, 256, 1024
#: Rows of a node that its subtree is fitted on, least rows of the sample in a leaf, planes tried.
SAMPLE, LEAST, TRIED = 4096, 24, 8
#: Half the spill band, in standard deviations of the projected difference of a pair at the threshold.
SPILL = 0.5
#: A node whose best plane has more than this share of its rows in the spill band is dense.
DENSE = 0.45
ROUNDS = 12


def _units(column: pa.Array) -> list[bytes | None]:
    """Each vector scaled to length one, as doubles; None where it links with nothing."""
    out = []
    for value in column:
        items = value.as_py()
        if not items or any(x is None for x in items):
            out.append(None)
            continue
        vector = np.asarray(items, np.float64)
        largest = np.abs(vector).max()
        if not np.isfinite(largest) or largest == 0.0:
            out.append(None)
            continue
        vector = vector / largest  # so that squares neither overflow nor vanish
        out.append((vector / np.sqrt(vector @ vector) + 0.0).tobytes())
    return out


def _prepared(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                     F.col(embedding).alias("embedding"))
    kind = rows.schema["label"].dataType.simpleString()

    def build():
        def run(batch):
            return pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array(_units(batch.column("embedding")), pa.binary())],
                ["vec_id", "label", "unit"])
        return run
    return map_arrow(rows, build, f"vec_id long, label {kind}, unit binary").withColumn(
        "unit", F.when(F.col("label").isNotNull(), F.col("unit")))


def fit_subtree(units: np.ndarray, total: int, trees: int, seed: int, threshold: float,
                leaf: int) -> list[dict]:
    """``trees`` random subtrees over a node of ``total`` rows, from a sample of them.

    A tree is arrays by inner node: plane, offset and two children; a child below zero is the leaf
    ``-1 - child``, and ``final`` tells which leaves cannot be split further.
    """
    n, d = units.shape
    scale = total / max(1, n)
    band = SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(d)
    out = []
    for tree in range(trees):
        rng = np.random.default_rng((seed & 0x7FFFFFFFFFFFFFFF, tree))
        planes, offsets, children, final = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) * scale <= leaf or len(rows) < LEAST:
                final.append(False)
                return -len(final)
            best = None
            for _ in range(TRIED):
                a, b = units[rng.choice(rows, 2, replace=False)]
                plane = a - b
                length = np.sqrt(plane @ plane)
                if length < 1e-9:
                    plane, length = rng.normal(size=d), np.sqrt(d)
                plane = plane / length
                at = units[rows] @ plane
                offset = float(np.median(at))
                near = float((np.abs(at - offset) <= band).mean())
                if best is None or near < best[0]:
                    best = near, plane, offset, at
            near, plane, offset, at = best
            if near > DENSE:
                final.append(True)
                return -len(final)
            here = len(planes)
            planes.append(plane)
            offsets.append(offset)
            children.append(None)
            left = grow(rows[at <= offset + band])
            right = grow(rows[at > offset - band])
            children[here] = (left, right)
            return here

        root = grow(np.arange(n))
        out.append({"root": root, "planes": np.array(planes, np.float64).reshape(-1, d),
                    "offsets": np.array(offsets), "band": band,
                    "children": np.array(children, np.int64).reshape(-1, 2),
                    "final": np.array(final, bool)})
    return out


def route(units: np.ndarray, tree: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs of the rows in a tree; a row in a spill band is in several leaves."""
    rows, nodes = np.arange(len(units)), np.full(len(units), tree["root"], np.int64)
    out_rows, out_leaves = [], []
    while len(rows):
        done = nodes < 0
        out_rows.append(rows[done])
        out_leaves.append(-1 - nodes[done])
        rows, nodes = rows[~done], nodes[~done]
        if not len(rows):
            break
        at = np.einsum("ij,ij->i", units[rows], tree["planes"][nodes]) - tree["offsets"][nodes]
        left, right = at <= tree["band"], at > -tree["band"]
        rows, nodes = (np.concatenate((rows[left], rows[right])),
                       np.concatenate((tree["children"][nodes[left], 0],
                                       tree["children"][nodes[right], 1])))
    return np.concatenate(out_rows), np.concatenate(out_leaves)


def _leaf_id(node: int, tree: int, leaf: int, final: bool) -> int:
    """An id for a leaf below a node; odd ids cannot be split further."""
    value = (node ^ (tree + 1) * 0x9E3779B97F4A7C15 ^ (leaf + 1) * 0xC2B2AE3D27D4EB4F)
    value = (value & 0xFFFFFFFFFFFFFFFF) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    value ^= value >> 32
    value = value * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return ((value >> 2) << 1) | int(final)


def _split(state: DataFrame, large: DataFrame, first: bool, threshold: float, leaf: int,
           trees: int) -> DataFrame:
    """One round: the leaves of every row in a large node are replaced by leaves below it."""
    rows = state.select("uid", "unit", F.explode("leaves").alias("node"))
    ranked = Window.partitionBy("node").orderBy("key", "uid")
    # of a large node only low hashes are ranked, several times as many rows as the sample needs
    sample = (rows.join(large, "node")
              .withColumn("key", F.shiftrightunsigned(F.xxhash64("uid", "node"), 1))
              .where(F.col("key") <= F.least(F.lit(1.0), 4.0 * SAMPLE / F.col("n")) * float(1 << 63))
              .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= SAMPLE))

    def fit(key, table):
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64)
        units = units.reshape(table.num_rows, -1)
        order = np.argsort(table.column("uid").to_numpy())
        node = key[0].as_py()
        model = fit_subtree(units[order], table.column("n")[0].as_py(), trees if first else 1,
                            node, threshold, leaf)
        return pa.table({"node": pa.array([node], pa.int64()),
                         "model": pa.array([pickle.dumps(model)], pa.binary())})

    models = sample.groupBy("node").applyInArrow(fit, "node long, model binary")

    def build():
        known: dict = {}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            uids = batch.column("uid").to_numpy()
            nodes = batch.column("node").to_numpy()
            units = batch.column("unit").to_pylist()
            models_of = batch.column("model")
            out_uid, out_leaf = [], []
            for node in np.unique(nodes):
                rows_of = np.nonzero(nodes == node)[0]
                if node not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[node] = pickle.loads(models_of[int(rows_of[0])].as_py())
                matrix = np.frombuffer(b"".join([units[i] for i in rows_of]), np.float64)
                matrix = matrix.reshape(len(rows_of), -1)
                for number, tree in enumerate(known[node]):
                    at, leaves = route(matrix, tree)
                    names = np.array([_leaf_id(int(node), number, i, bool(f))
                                      for i, f in enumerate(tree["final"])], np.int64)
                    out_uid.append(uids[rows_of[at]])
                    out_leaf.append(names[leaves])
            empty = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_uid or [empty])),
                 pa.array(np.concatenate(out_leaf or [empty]))], ["uid", "leaf"])
        return run

    moved = map_arrow(rows.join(models, "node").select("uid", "node", "unit", "model"), build,
                      "uid long, leaf long")
    stayed = rows.join(large.select("node"), "node", "left_anti").select(
        "uid", F.col("node").alias("leaf"))
    leaves = moved.unionByName(stayed).groupBy("uid").agg(
        F.collect_set("leaf").alias("leaves"))  # a few leaves for each tree
    return state.drop("leaves").join(leaves, "uid")


def _compare(key, table: pa.Table, threshold: float) -> pa.Table:
    """Links of the rows of one leaf, or of one pair of blocks of it, counted where first met."""
    leaf, one, other = (k.as_py() for k in key)
    order = np.argsort(table.column("uid").to_numpy(), kind="stable")
    uid = table.column("uid").to_numpy()[order]
    copies = table.column("copies").to_numpy()[order]
    block = table.column("block").to_numpy()[order]
    units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64)
    units = units.reshape(len(uid), -1)[order]
    near = units @ units.T >= threshold
    np.fill_diagonal(near, False)
    if one != other:
        near &= block[:, None] != block[None, :]
    rows = np.nonzero(near.any(axis=1))[0]
    near = near[np.ix_(rows, rows)]
    lists = table.column("leaves").take(pa.array(order[rows])).to_pylist()
    earlier = sorted({x for some in lists for x in some if x < leaf})
    number = {x: i for i, x in enumerate(earlier)}
    member = np.zeros((len(rows), max(1, len(earlier))), np.float32)
    for i, some in enumerate(lists):
        for x in some:
            if x < leaf:
                member[i, number[x]] = 1.0
    first = near & ~(member @ member.T > 0)
    links = first.astype(np.float64) @ copies[rows].astype(np.float64)
    root = np.arange(len(rows))
    while len(rows):
        low = np.where(near, root[None, :], len(rows)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pa.table({"uid": pa.array(uid[rows]), "links": pa.array(links.astype(np.int64)),
                     "root": pa.array(uid[rows][root] if len(rows) else uid[rows])})


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", threshold: float = THRESHOLD, trees: int = TREES,
                    leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (other vectors met with an equal label and a cosine of at
    least ``threshold``), ``component_id`` (smallest id reachable by links) and ``kept``
    (``vec_id = component_id``).

    Vectors that are null, empty, zero, or hold null or non-finite components, and those with a
    null label, link with nothing; vectors of different lengths never link. Repeated rows and equal
    vectors are compared once and counted as many times as they occur. A row without an id counts
    as a link; its component is named by the smallest id there is, null if there is none. An empty
    table gives no rows; other columns are not read.
    """
    rows = _prepared(df, vec_id, embedding, label).withColumn("key", F.sha2("unit", 256))
    classes = (rows.where("unit is not null").groupBy("label", "key")
               .agg(F.first("unit").alias("unit"), F.min("vec_id").alias("smallest"),
                    F.count("*").alias("copies"))
               .withColumn("uid", F.monotonically_increasing_id()))
    classes = checkpointed(classes)  # ids given here must not change under a retry
    state = classes.select("uid", "unit", "copies", F.array(F.shiftleft(F.shiftright(
        F.xxhash64("label", F.length("unit")), 2), 1).bitwiseAND((1 << 62) - 1)).alias("leaves"))
    for turn in range(ROUNDS):
        sizes = state.select(F.explode("leaves").alias("node")).groupBy("node").agg(
            F.count("*").alias("n"))
        large = sizes.where((F.col("n") > leaf) & (F.col("node") % 2 == 0))
        if turn:
            large = large.where(F.col("n") > block)  # small enough: compared as it is
        large = checkpointed(large)
        if large.isEmpty():
            break
        state = checkpointed(_split(state, large, turn == 0, threshold, leaf, trees))
    blocks = (state.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(
        F.count("*").alias("n")).where("n > 1")
        .select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = (state.select("uid", "unit", "copies", "leaves", F.explode("leaves").alias("leaf"))
             .join(blocks, "leaf")
             .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("one", F.least("block", "with"))
             .withColumn("other", F.greatest("block", "with")))
    met = checkpointed(dealt.select("leaf", "one", "other", "uid", "unit", "copies", "leaves", "block")
                       .groupBy("leaf", "one", "other")
                       .applyInArrow(lambda key, table: _compare(key, table, threshold),
                                     "uid long, links long, root long"))
    linked = components(met.select("uid", "root"))
    counted = met.groupBy("uid").agg(F.sum("links").alias("links"))
    known = (classes.select("uid", "label", "key", "smallest", "copies")
             .join(linked.withColumnRenamed("node", "uid"), "uid", "left")
             .join(counted, "uid", "left")
             .withColumn("component", F.coalesce("component", "uid")))
    names = known.groupBy("component").agg(F.min("smallest").alias("component_id"))
    found = known.join(names, "component").select(
        F.col("label").alias("_label"), F.col("key").alias("_key"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    return (rows.drop("unit").join(found, (rows.label == found._label) & (rows.key == found._key),
                                   "left")
            .select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("_key").isNull(), F.col("vec_id"))
                    .otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
