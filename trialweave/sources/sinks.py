"""Writers. Output is partitioned by what readers filter on; hot partitions are split, not funnelled."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _balanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a partition value together, in as many tasks as its size asks for."""
    return df.hint("rebalance", *keys)


def _folder(path: str, key: str, value: str) -> str:
    """The folder of one partition value, escaped the way Spark's readers undo."""
    safe = "".join(c if c.isalnum() and c.isascii() or c in "-_. " else "".join(
        f"%{b:02X}" for b in c.encode()) for c in str(value))
    return f"{path.rstrip('/')}/{key}={safe}"


def write_worklists(cells: DataFrame, path: str, round_tag: str | None = None,
                    fmt: str = "parquet") -> None:
    """K1 and K2: worklist cells by round, mode, workbook and site.

    Combinations without work have no rows, so nothing is written for them. Writing a round again
    replaces all of that round, sites that have no work any more included, and leaves the other
    rounds alone.
    """
    keys = ["mode", "workbook", "site"]
    target = path if round_tag is None else _folder(path, "round", round_tag)
    _balanced(cells, keys).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy(*keys).format(fmt).save(target)


def write_triplet(diff, path: str, prefix: str = "linkage", fmt: str = "csv") -> dict[str, str]:
    """K3: the update, conflicts and overwrite payloads of a diff.

    The compared rows are written once, beside the payloads, and the three are read from there.
    """
    compared = f"{path}/{prefix}_compared"
    diff.joined.write.mode("overwrite").parquet(compared)
    diff = diff.over(diff.joined.sparkSession.read.parquet(compared))
    parts = {"update": diff.updates(), "conflicts": diff.conflicts(),
             "overwrite": diff.overwrites()}
    paths = {}
    for name, frame in parts.items():
        paths[name] = f"{path}/{prefix}_{name}"
        frame.write.mode("overwrite").option("header", "true").format(fmt).save(paths[name])
    return paths


def write_snapshot(df: DataFrame, path: str, stamp: str, by: list[str] = ()) -> None:
    """K4 and K5: a stamped copy; other snapshots in the folder are kept. Writing a stamp again
    replaces all of it."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(_folder(path, "snapshot_ts", stamp))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Rounds or snapshots of a folder. Columns that folders stand for are text, as written."""
    reader = spark.read.option("basePath", path)
    found = reader.parquet(path)
    folders = {part.split("=", 1)[0] for name in found.inputFiles()[:1]
               for part in name.split("/")[:-1] if "=" in part}
    schema = StructType([StructField(f.name, StringType() if f.name in folders else f.dataType)
                         for f in found.schema.fields])
    return reader.schema(schema).parquet(path)
