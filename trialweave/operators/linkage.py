"""Exact linkage of two or more sources on declared keys."""
from __future__ import annotations

from dataclasses import dataclass, field as dataclass_field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import norm_key


@dataclass
class Source:
    """One side of a linkage: its rows, key columns (in shared key order) and carried fields."""

    name: str
    frame: DataFrame
    keys: list[str]
    carry: list[str] = dataclass_field(default_factory=list)
    seq: str | None = None


def _key_names(names, sources):
    if any(len(s.keys) != len(names) for s in sources):
        raise ValueError("every source needs one key column per shared key name")
    return list(names)


def _keyed(source: Source, names: list[str], key_mode: str) -> DataFrame:
    return source.frame.select(
        *[norm_key(source.frame[k], key_mode).alias(n) for k, n in zip(source.keys, names)],
        *[F.col(c) for c in source.carry],
        *([F.col(source.seq)] if source.seq else []))


def _has_key(names):
    return reduce(lambda a, b: a & b, [F.col(n) != "" for n in names])


def link_master(sources: list[Source], key: list[str], key_mode: str = "trim") -> DataFrame:
    """One row per linked entity with flags, row counts and carried fields.

    All sources go into one aggregate by key, which gives what a chain of full outer joins would
    with a single shuffle, and each task sends at most one row per key and source. A repeated
    key in a source therefore never multiplies rows: ``<name>_rows`` counts the repeats and the
    row with the highest ``seq`` (or the greatest values) is the one carried. Rows whose key is
    blank cannot be linked and are left to :func:`missing_link`.
    """
    names = _key_names(key, sources)
    parts = []
    for s in sources:
        body = F.struct(*([F.col(s.seq).alias("_seq")] if s.seq else []),
                        *[F.col(c).alias(c) for c in s.carry], F.lit(1).alias("_present"))
        parts.append(_keyed(s, names, key_mode).where(_has_key(names))
                     .select(*names, body.alias(f"_{s.name}")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = stacked.groupBy(*names).agg(
        *[F.max(f"_{s.name}").alias(f"_{s.name}") for s in sources],
        *[F.count(f"_{s.name}").alias(f"{s.name}_rows") for s in sources])
    return merged.select(
        *names,
        *[(F.col(f"{s.name}_rows") > 0).alias(f"{s.name}_linked") for s in sources],
        *[F.col(f"{s.name}_rows") for s in sources],
        *[F.col(f"_{s.name}.{c}").alias(f"{s.name}_{c}") for s in sources for c in s.carry])


def missing_link(source: Source, key: list[str], key_mode: str = "trim") -> DataFrame:
    """Rows of a source that carry no usable key."""
    keyed = [norm_key(source.frame[k], key_mode) == "" for k in source.keys]
    return source.frame.where(reduce(lambda a, b: a | b, keyed))


def orphan_rows(left: Source, right: Source, key: list[str], key_mode: str = "trim") -> DataFrame:
    """Rows on either side whose key the other side does not have."""
    names = _key_names(key, [left, right])
    a = _keyed(left, names, key_mode).where(_has_key(names)).select(*names)
    b = _keyed(right, names, key_mode).where(_has_key(names)).select(*names)
    only = lambda x, y, side: x.join(y.distinct(), names, "left_anti").withColumn(
        "side", F.lit(side))
    return only(a, b, left.name).unionByName(only(b, a, right.name))


def overlap(master: DataFrame, sources: list[str]) -> DataFrame:
    """How many entities each combination of sources holds."""
    flags = [f"{s}_linked" for s in sources]
    return master.groupBy(*flags).agg(F.count(F.lit(1)).alias("entities"))


def integrity(master: DataFrame, key: list[str], sources: list[str]) -> DataFrame:
    """Repeated and one-sided keys, as findings; order by ``severity`` descending."""
    findings = []
    for s in sources:
        findings.append(F.when(
            F.col(f"{s}_rows") > 1,
            F.struct(F.lit("duplicate").alias("issue"), F.lit(s).alias("source"),
                     F.col(f"{s}_rows").alias("severity"))))
        findings.append(F.when(
            ~F.col(f"{s}_linked"),
            F.struct(F.lit("orphan").alias("issue"), F.lit(s).alias("source"),
                     F.lit(1).cast("long").alias("severity"))))
    return master.select(*key, F.explode(F.array_compact(F.array(*findings))).alias("f")) \
        .select(*key, "f.*")


def worst_first(findings: DataFrame, key: list[str]) -> DataFrame:
    return findings.orderBy(F.desc("severity"), "issue", "source", *key)
