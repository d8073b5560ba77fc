"""Readers: every column is text, blank is ``''``, nothing is inferred."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import constants as K
from ..functions.cells import norm_key, strip
from ..operators.ordering import last_per_key

# Records may hold line breaks inside quotes, and quotes are doubled.
CSV = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "false",
       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def blanks(df: DataFrame) -> DataFrame:
    """Null to blank in every text column."""
    return df.fillna("")


def read_export(spark: SparkSession, path, sep: str = ",", multiline: bool = True,
                seq: str | None = None) -> DataFrame:
    """A record export or an external source as text columns.

    With line breaks allowed inside cells, the default, one task reads each file; write the result
    to Parquet once if files are large. ``multiline=False`` lets Spark split files that have no line
    breaks inside cells. ``seq`` names a column to add that orders rows as the files do, for
    operators where the last row of a repeated id counts.
    """
    options = {**CSV, "multiLine": str(multiline).lower()}
    rows = spark.read.options(**options).option("sep", sep).csv(path)
    if seq is None:
        return blanks(rows)
    # ids rise within a split of a file, and splits are ordered by where they start
    place = F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"))
    return blanks(rows.select(*rows.columns, place.alias(seq)))


def read_dictionary(spark: SparkSession, path) -> DataFrame:
    """A dictionary in either header dialect, with ``pos`` and ``malformed``.

    ``malformed`` marks rows that do not have exactly the file's number of columns. A dictionary
    file is small and is read whole, which keeps its row order.
    """
    header = spark.read.options(**CSV).csv(path).columns
    names = [K.DICTIONARY_HEADERS.get(h, h) for h in header]
    schema = StructType([StructField(n, StringType()) for n in [*names, "_bad"]])
    rows = spark.read.options(**CSV).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", "true") \
        .schema(schema).csv(path)
    return blanks(rows.select(
        F.monotonically_increasing_id().alias("pos"), *names,
        F.col("_bad").isNotNull().alias("malformed")))


def read_json_records(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """S3: a JSON list of records; values as text, absent keys blank."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return blanks(spark.read.schema(schema).option("multiLine", "true")
                  .option("primitivesAsString", "true").json(path))


def keyed(df: DataFrame, id_field: str, seq: str, key_mode: str = "trim") -> DataFrame:
    """One row per normalised id, the last one in ``seq`` order."""
    normal = df.withColumn(id_field, norm_key(id_field, key_mode))
    return last_per_key(normal, [id_field], [seq])


def union_payloads(frames: list[DataFrame]) -> DataFrame:
    """Rows of many payloads over the union of their columns, absent cells blank.

    Columns keep the order in which they are first seen.
    """
    if not frames:
        raise ValueError("there are no payloads to unite")
    order = list(dict.fromkeys(c for f in frames for c in f.columns))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return blanks(stacked.select(*order))


def _unescaped(path: Column) -> Column:
    """A file's path as it is named; Spark escapes it, but for the plus sign, which stays itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_drafts(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``<site>_<workbook>.csv`` of a folder, with both names taken from the file name.

    Files may differ in their columns: one job finds the headers, files that share a header are
    read together, and the parts are united.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).where(
        "_metadata.file_block_start = 0").select(
        _unescaped(F.col("_metadata.file_path")).alias("path"), "value",
        F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("head"))
    groups: dict[str, list[str]] = {}
    for row in heads.orderBy("path").collect():
        groups.setdefault(row.head.strip(), []).append(row.path)
    if not groups:
        raise ValueError(f"no drafts in {folder}")
    return union_payloads([with_draft_names(read_export(spark, paths))
                           for paths in groups.values()])


def with_draft_names(df: DataFrame) -> DataFrame:
    """Site (lower case) and workbook from the input file's name."""
    stem = F.regexp_extract(_unescaped(F.input_file_name()), r"([^/]+)\.csv$", 1)
    return df.select(
        F.lower(F.substring_index(stem, "_", 1)).alias("site"),
        F.when(stem.contains("_"), F.regexp_replace(stem, "^[^_]*_", "")).otherwise("")
        .alias("workbook"), *df.columns)


def read_scope_ids(spark: SparkSession, path) -> DataFrame:
    """The first column of a file, trimmed."""
    df = read_export(spark, path)
    return df.select(strip(F.col(f"`{df.columns[0]}`")).alias("id")).distinct()
