"""S1 and S5 in parallel: a text export whose cells may hold line breaks, read block by block.

A block is the part of a file that Spark reads as one split. Quotes are doubled inside cells, so whether a
block begins inside a cell is the parity of the quotes before it. One pass counts the quotes of each
block; the second reads the blocks in parallel, each from its first record on. What a block holds of a
record that began before it, or that ends after it, is put together by file and block, a row or two for
each block. Files are read by Spark's own text reader, wherever it can read.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.lineage import LOOKUP_ROWS, checkpointed
from .readers import CSV, blanks


def _records(batches):
    """Text of the records of each block in order; what belongs to a record of another block is marked."""
    now, inside, held, number, fresh = None, False, [], 0, True

    for batch in batches:
        out = []
        for file, start, line, opened in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != now:
                if held:
                    out.append((*now, number, "whole" if fresh and began else "tail", "\n".join(held)))
                now, inside, held, number = (file, start), bool(opened), [], 0
                began = fresh = inside  # the block begins inside a cell, and no line has closed it yet
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                out.append((*now, number, "head" if fresh and began else "record", "\n".join(held)))
                held, number, fresh = [], number + 1, False
        yield _batch(out)
    if held:
        yield _batch([(*now, number, "whole" if fresh and began else "tail", "\n".join(held))])


def _batch(rows):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["file", "start", "number", "kind", "text"])


def read_blocks(spark: SparkSession, path, sep: str = ",", seq: str | None = None) -> DataFrame:
    """The same rows as ``read_export``, with line breaks inside cells and yet as many tasks as splits.

    The first row of each file is its header, and all files have the columns of the first one read. Empty
    lines are left out, blank cells are ``''``. Lines end in ``\\n`` or ``\\r\\n``; inside a cell both stay as they are.
    ``seq`` names a column that orders rows as the files do. Files without a row give none.
    """
    columns = spark.read.options(**CSV).option("sep", sep).csv(path).columns
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = checkpointed(lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = counted.select(F.col("file").alias("_file"), F.col("start").alias("_start"),
                            (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("opened"))
    # a join by shuffle would take lines out of their order, so blocks go to the lines whatever their number;
    # one row stands for a split of megabytes
    if counted.count() > LOOKUP_ROWS:
        raise ValueError(f"more than {LOOKUP_ROWS} splits: raise spark.sql.files.maxPartitionBytes")
    found = checkpointed(
        lines.join(F.broadcast(opened), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
        .select("file", "start", "value", "opened")
        .mapInArrow(_records, "file string, start long, number long, kind string, text string"))
    parts = found.where("kind <> 'record'")
    back = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a piece belongs to the last block before it in which a record was left open
    owner = F.last(F.when(F.col("kind") == "tail", F.col("start")), ignorenulls=True).over(back)
    number = F.last(F.when(F.col("kind") == "tail", F.col("number")), ignorenulls=True).over(back)
    joined = (parts.select("file", owner.alias("owner"), number.alias("at"), "start", "number", "text")
              .groupBy("file", "owner", "at").agg(F.array_sort(F.collect_list(F.struct("start", "number", "text"))).alias("p"))
              .select("file", F.col("owner").alias("start"), F.col("at").alias("number"),
                      F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    whole = (found.where("kind = 'record'").select("file", "start", "number", "text").unionByName(joined)
             .withColumn("text", F.regexp_replace("text", "\r\\z", "")).where("text <> ''"))
    first = whole.groupBy(F.col("file").alias("_file")).agg(F.min(F.struct("start", "number")).alias("_first"))
    rows = whole.join(first, F.col("file") == F.col("_file")).where(F.struct("start", "number") != F.col("_first"))
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))])
    options = {**CSV, "sep": sep, "header": "false"}
    cells = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    place = [F.struct("file", "start", F.col("number").alias("row")).alias(seq)] if seq else []
    return blanks(rows.select(cells.alias("c"), *place).select(
        *(F.col(f"c.c{i}").alias(name) for i, name in enumerate(columns)), *([seq] if seq else [])))
