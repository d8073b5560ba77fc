"""Ranked lexical search with geometric blocks of every term's posting list.

Documents become vectors over the asked terms. They are dealt into ranges of similar ones (each goes
by the sample document it is most like) and indexed in chunks. In a chunk every term has a posting
list; a list is clustered by the similarity of its documents, and a cluster is cut into blocks. A block
keeps the greatest weight of each term among its documents, so that the product of a query with that
summary bounds the score of all of them. A block is skipped only if its bound is below the tenth best
score known; so are lists that cannot lift a document to it even together. Bounds and scores are
integers: what is skipped could not have been in the result.

Scores known early only save work: they come from a sample of ``SAMPLE`` documents, which a task adds
its own to. Nothing else is sampled, and every document with an asked term is in the index.
"""
from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, map_arrow, ship

# The constants of the score, as the contract has them.
UNIT, SLOPE, PIVOT, FACTOR, ROUND = 1_000_000_000, 75, 100, 8, 1000
TOP = 10
#: Documents of the sample, and how many of them stand for regions of similar documents.
SAMPLE, REGIONS = 2000, 64
#: Documents of a chunk at most and cells of its matrix, documents of a block, dimensions of the sketch
#: that clusters lists, and blocks scored between two looks at the least score.
CHUNK, CELLS, BLOCK, SKETCH, STEP = 2048, 1 << 23, 32, 32, 16
#: Items are searched in groups with about so many characters of text.
ASKED_CHARS = 1 << 18
#: Texts are split into words in pieces of about so many bytes.
PIECE = 4 << 20

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b in _SEPARATORS else b for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in pieces: A-Z lower-cased, split at ASCII other than letters and digits."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        yield data[start:len(data) if end < 0 else end].split()
        start = len(data) if end < 0 else end


def vectors(df: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (its terms with repeats), ``terms`` (numbers of those in the vocabulary,
    ascending) and ``times`` of every document that has a term."""
    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes, ends, terms, times = [], [], [0], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts, n = Counter(), 0
                for piece in terms_of(value.as_py()):
                    counts.update(piece)
                    n += len(piece)
                if n:
                    found = sorted((vocabulary[w], c) for w, c in counts.items() if w in vocabulary)
                    ids.append(doc)
                    sizes.append(n)
                    terms += [t for t, _ in found]
                    times += [c for _, c in found]
                    ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
                     for x in (terms, times))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists],
                                              ["doc_id", "n", "terms", "times"])
        return run
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, build, "doc_id long, n long, terms array<int>, times array<int>", "text")


class Scoring:
    """Weights of the asked terms: ``count`` documents hold ``length`` terms, ``held`` of them each."""

    def __init__(self, count: int, length: int, held: np.ndarray):
        self.count, self.length = count, length
        self.weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1)))
                                for d in held], np.int64)

    def impact(self, n: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What an entry adds to a score for each unit of its term's weight; at most a million."""
        m = PIVOT - SLOPE + (SLOPE * n.astype(np.int64) * self.count) // self.length
        times = times.astype(np.int64)
        return ((UNIT * times) // (ROUND * times + FACTOR * m)).astype(np.int32)


class Documents:
    """Vectors of some documents: entry after entry the ``row``, the ``term`` and its ``impact``."""

    def __init__(self, batch: pa.RecordBatch, scoring: Scoring):
        lists = batch.column("terms")
        sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
        self.ids = batch.column("doc_id").to_pylist()
        self.row = np.repeat(np.arange(len(self.ids)), sizes)
        self.term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
        self.impact = scoring.impact(batch.column("n").to_numpy(zero_copy_only=False)[self.row], times)
        self.weight = scoring.weight

    def sketch(self) -> np.ndarray:
        """Unit vectors of few dimensions whose products are like the cosines of the rows."""
        mixed = (self.term.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
        cell = self.row * SKETCH + (mixed >> np.uint64(40)).astype(np.int64) % SKETCH
        worth = np.where(mixed >> np.uint64(63), 1.0, -1.0) * self.impact * self.weight[self.term]
        out = np.bincount(cell, worth, len(self.ids) * SKETCH).reshape(-1, SKETCH)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    def chunks(self) -> Iterator[Documents]:
        """The documents in order, so many at a time that the matrix of each part stays small."""
        step = max(BLOCK, min(CHUNK, CELLS // max(1, len(self.weight))))
        cuts = np.searchsorted(self.row, np.arange(0, len(self.ids) + step, step))
        for first, (lo, hi) in zip(range(0, len(self.ids), step), zip(cuts, cuts[1:])):
            part = copy.copy(self)
            part.ids, part.row = self.ids[first:first + step], self.row[lo:hi] - first
            part.term, part.impact = self.term[lo:hi], self.impact[lo:hi]
            yield part


class Index:
    """The posting lists of some documents with the summaries of their blocks."""

    def __init__(self, docs: Documents):
        self.docs = docs
        self.terms, self.column = np.unique(docs.term, return_inverse=True)
        self.matrix = np.zeros((len(docs.ids), len(self.terms)), np.int32)
        self.matrix[docs.row, self.column] = docs.impact
        order = np.argsort(self.column, kind="stable")
        ends = np.searchsorted(self.column[order], np.arange(1, len(self.terms)))
        self.lists = np.split(docs.row[order], ends)
        self.greatest = self.matrix.max(axis=0, initial=0).astype(np.int64)
        self.weight = docs.weight[self.terms]

    def asked(self, query: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Columns of a query's terms that stand here, and the worth of one unit of impact in each."""
        at = np.minimum(np.searchsorted(self.terms, query[0]), max(0, len(self.terms) - 1))
        here = self.terms[at] == query[0] if len(self.terms) else np.zeros(len(at), bool)
        return at[here], query[1][here] * self.weight[at[here]]

    def scores(self, columns: np.ndarray, worth: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return (self.matrix[chosen[:, None], columns] * worth).sum(axis=1)

    def summarise(self, columns: list[int]) -> None:
        """Cluster the lists of these columns by similarity, cut the clusters into blocks of ``BLOCK``
        documents and keep the greatest impact of each term in each block."""
        sketch, blocks, self.first = self.docs.sketch(), [], {}
        for column in columns:
            docs = self.lists[column]
            self.first[column] = len(blocks)
            if len(docs) <= BLOCK:
                blocks.append(docs)
            else:
                own = sketch[docs]
                nearest = np.argmax(own @ own[::BLOCK].T, axis=1)
                order = np.argsort(nearest, kind="stable")
                for part in np.split(docs[order], np.flatnonzero(np.diff(nearest[order])) + 1):
                    blocks += [part[i:i + BLOCK] for i in range(0, len(part), BLOCK)]
            self.first[-1 - column] = len(blocks)
        self.blocks = blocks
        self.summary = np.empty((len(blocks), len(self.terms)), np.int32)
        for b, docs in enumerate(blocks):
            self.matrix[docs].max(axis=0, out=self.summary[b])

    def blocks_of(self, columns: list[int]) -> np.ndarray:
        return np.concatenate([np.arange(self.first[c], self.first[-1 - c]) for c in columns])

    def bounds(self, columns: np.ndarray, worth: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return (self.summary[chosen[:, None], columns] * worth).sum(axis=1)


class Best:
    """The best ``TOP`` documents so far; ``least`` is the score below which none can enter."""

    def __init__(self, least: int = 1):
        self.rows: list[tuple] = []  # (-score, no id, id)
        self.least = least

    def add(self, scores: np.ndarray, ids: list, chosen: np.ndarray) -> None:
        """Scores of the chosen documents, whose ids are those of all."""
        take = np.flatnonzero(scores >= self.least)
        if not len(take):
            return
        for i in take.tolist():
            doc = ids[chosen[i]]
            self.rows.append((-int(scores[i]), doc is None, doc or 0))
        self.rows = sorted(self.rows)[:TOP]
        if len(self.rows) == TOP:
            self.least = max(self.least, -self.rows[-1][0])


def search_chunk(docs: Documents, queries: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> int:
    """Add to ``best`` what each query (term numbers, how often each is asked) finds in a chunk.

    Returns how many of the blocks met were skipped by their summaries.
    """
    index, asked, wanted, skipped = Index(docs), [], {}, 0
    for q, query in enumerate(queries):
        columns, worth = index.asked(query)
        most = worth * index.greatest[columns]
        by = np.argsort(most, kind="stable")
        # the lists before the first that can lift a document to the least score are left out
        essential = columns[by[np.cumsum(most[by]) >= best[q].least]]
        if len(essential):
            wanted[q] = essential.tolist()
        asked.append((columns, worth))
    index.summarise(sorted({c for columns in wanted.values() for c in columns}))
    for q, essential in wanted.items():
        columns, worth = asked[q]
        chosen = index.blocks_of(essential)
        bound = index.bounds(columns, worth, chosen)
        by = np.argsort(-bound, kind="stable")
        chosen, bound, seen = chosen[by], bound[by], np.zeros(len(docs.ids), bool)
        for first in range(0, len(chosen), STEP):
            here = chosen[first:first + STEP][bound[first:first + STEP] >= best[q].least]
            if not len(here):
                skipped += len(chosen) - first
                break
            skipped += len(chosen[first:first + STEP]) - len(here)
            new = np.unique(np.concatenate([index.blocks[b] for b in here.tolist()]))
            new = new[~seen[new]]
            seen[new] = True
            best[q].add(index.scores(columns, worth, new), docs.ids, new)
    return skipped


def search(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``TOP`` highest-scoring documents of each
    item with a score above 0, equal scores by ascending id (rows without an id last).

    Null and empty texts have no terms: such documents are not counted, such items find nothing. Each
    row is a document or an item of its own, repeated or not. Empty tables give no rows. Columns other
    than those named are not read. Items are read in groups of about ``ASKED_CHARS`` characters, each
    of which makes its own index.
    """
    found, group, chars = [], [], 0
    rows = items.select(F.col(item_id), F.col(item_text)).toLocalIterator(prefetchPartitions=False)
    for item in rows:
        group.append((item[0], item[1] or ""))
        chars += len(group[-1][1])
        if chars >= ASKED_CHARS:
            found.append(_search(df, group, doc_id, text))
            group, chars = [], 0
    found.append(_search(df, group, doc_id, text))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    kind = items.schema[item_id].dataType
    return out.withColumn("item_id", F.col("item_id").cast(kind))


def _search(df: DataFrame, items: list[tuple], doc_id: str, text: str) -> DataFrame:
    asked = [Counter(t for piece in terms_of(x) for t in piece) for _, x in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for counts in asked for t in counts}))}
    size = max(1, len(vocabulary))
    queries = [(np.array([vocabulary[t] for t in counts], np.int64), np.array(list(counts.values()), np.int64))
               for counts in asked]
    spark = df.sparkSession
    ship(spark)
    rows = checkpointed(vectors(df, vocabulary, doc_id, text))
    count, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(size, np.int64)
    for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        held[term] = n  # one row for each asked term
    scoring = Scoring(count, length or 1, held)
    with_terms = rows.where(F.size("terms") > 0)
    sample = with_terms.orderBy(F.xxhash64("doc_id", "n", "terms"), "doc_id").limit(SAMPLE).toArrow()
    least, regions = [1] * len(queries), np.zeros((1, SKETCH))
    if sample.num_rows:
        first = Documents(sample.combine_chunks().to_batches()[0], scoring)
        regions, best = first.sketch()[:REGIONS], [Best() for _ in queries]
        for part in first.chunks():
            search_chunk(part, queries, best)
        least = [b.least for b in best]

    def near(batches):
        for batch in batches:
            region = np.argmax(Documents(batch, scoring).sketch() @ regions.T, axis=1)
            yield batch.append_column("region", pa.array(region, pa.int32()))

    def run(batches):
        best = [Best(x) for x in least]
        for batch in batches:
            for part in Documents(batch, scoring).chunks():
                search_chunk(part, queries, best)
        out = [(i, None if no_id else doc, -score) for i, b in enumerate(best) for score, no_id, doc in b.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.int64())], ["item", "doc_id", "score"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (with_terms.mapInArrow(near, "doc_id long, n long, terms array<int>, times array<int>, region int")
             .repartitionByRange(parts, "region", F.xxhash64("doc_id", "terms")).drop("region"))
    ranked = dealt.mapInArrow(run, "item int, doc_id long, score long").withColumn(
        "rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    names = F.array(*(F.lit(None if i is None else str(i)) for i, _ in items)) if items else F.array(F.lit(""))
    return ranked.where(F.col("rank") <= TOP).select(
        F.get(names, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def oracle_sql() -> str:
    """The same ranking in DuckDB's SQL, by joining every asked term with every document that holds it."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{upper}', '{lower}'), '{words}') AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(
        translate(coalesce(text, ''), '{upper}', '{lower}'), '{words}') AS w FROM benchmark),
total AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
asked AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(w) AS term FROM i) GROUP BY iid, term),
held AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
         WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT big_n FROM total) + 2) / (2 * count(*) + 1)))
                             AS BIGINT) AS x FROM held GROUP BY term),
part AS (SELECT rid, term, x * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * big_n) // big_l))) AS s
         FROM held JOIN weight USING (term) JOIN d USING (rid), total),
scored AS (SELECT iid, rid, CAST(sum(times * s) AS BIGINT) AS score FROM asked JOIN part USING (term)
           GROUP BY iid, rid HAVING sum(times * s) > 0),
ranked AS (SELECT iid, doc_id, score, row_number() OVER (
               PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) AS r FROM scored JOIN d USING (rid))
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (iid) WHERE r <= {TOP}
"""
