"""Diff-only write-back: what may be filled, what conflicts, what has nowhere to go."""
from __future__ import annotations

from copy import copy
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.cells import norm_key, norm_value, strip, verdict
from .ordering import last_per_key


def shared_fields(computed: DataFrame, current: DataFrame, id_field: str,
                  exclude=(K.SITE_FIELD,)) -> list[str]:
    """Columns of both sides, in computed order, without the id and the site."""
    skip = {id_field, *exclude}
    return [c for c in computed.columns if c in current.columns and c not in skip]


def _one_per_key(df: DataFrame, unique: bool) -> DataFrame:
    """One row per ``_key``, so that repeated ids never multiply in a join.

    Without an input order the row with the greatest values stands for the id. The aggregate
    leaves the rows partitioned the way the join needs them.
    """
    if unique:
        return df
    rest = [c for c in df.columns if c != "_key"]
    if not rest:
        return df.distinct()
    return df.groupBy("_key").agg(F.max(F.struct(*rest)).alias("_row")).select(
        "_key", *[F.col(f"_row.{c}").alias(c) for c in rest])


class CellDiff:
    """Computed against current, cell by cell, from one equi-join.

    Every frame below is a projection or a filter of that join. ``seq`` names the input order
    column on both sides; with it the last row of a repeated id is the record. ``unique`` says
    that no id repeats, which saves looking.
    """

    def __init__(self, computed: DataFrame, current: DataFrame, id_field: str,
                 fields: list[str] | None = None, key_mode: str = "trim",
                 exclude=(K.SITE_FIELD,), seq: str | None = None, unique: bool = False):
        self.unique = unique
        skip = (*exclude, seq) if seq else exclude
        self.id_field = id_field
        self.fields = list(fields or shared_fields(computed, current, id_field, skip))
        if not self.fields:
            raise ValueError("the two tables have no fields in common to compare")
        new = self._side(computed, seq, "n", key_mode)
        old = self._side(current, seq, "c", key_mode)
        self.joined = new.join(old, "_key", "full_outer")

    def _side(self, df, seq, tag, key_mode):
        key = norm_key(df[self.id_field], key_mode)
        names = [f"_{tag}_{i}" for i in range(len(self.fields))]
        side = df.select(key.alias("_key"), *[
            (strip(F.col(f"`{f}`")) if f in df.columns else F.lit("")).alias(n)
            for f, n in zip(self.fields, names)], *([F.col(seq)] if seq else []))
        if seq:
            side = last_per_key(side, ["_key"], [seq]).drop(seq)
        else:
            side = _one_per_key(side, self.unique)
        return side.select("_key", *[norm_value(n, trimmed=True).alias(n) for n in names],
                           F.lit(True).alias(f"_in_{tag}"))

    def over(self, joined: DataFrame) -> CellDiff:
        """The same comparison over a stored copy of its join."""
        other = copy(self)
        other.joined = joined
        return other

    def _verdict(self, i):
        return verdict(F.coalesce(F.col(f"_c_{i}"), F.lit("")), F.col(f"_n_{i}"))

    @property
    def _matched(self):
        return self.joined.where(F.col("_in_n") & F.col("_in_c"))

    def cells(self) -> DataFrame:
        """Every computed cell with its verdict; ids absent from current are ``orphan``."""
        long = self.joined.where("_in_n").select(
            F.col("_key").alias(self.id_field), F.col("_in_c"),
            F.explode(F.array(*[
                F.struct(F.lit(f).alias("field"),
                         F.coalesce(F.col(f"_c_{i}"), F.lit("")).alias("existing"),
                         F.col(f"_n_{i}").alias("computed"))
                for i, f in enumerate(self.fields)])).alias("cell"))
        cell = long.select(self.id_field, "_in_c", "cell.*")
        return cell.select(
            self.id_field, "field", "existing", "computed",
            F.when(F.col("_in_c").isNull(), "orphan")
            .otherwise(verdict("existing", "computed")).alias("verdict"))

    def _wide(self, wanted: str) -> DataFrame:
        picked = self._matched.select(
            F.col("_key").alias(self.id_field),
            *[F.when(self._verdict(i) == wanted, F.col(f"_n_{i}")).alias(f)
              for i, f in enumerate(self.fields)])
        return picked.where(F.coalesce(*[F.col(f"`{f}`") for f in self.fields]).isNotNull()) \
            .fillna("", self.fields)

    def updates(self) -> DataFrame:
        """Safe fills only, wide; records with nothing to fill are left out."""
        return self._wide("fill")

    def overwrites(self) -> DataFrame:
        """Conflicting cells only, wide, for use after sign-off."""
        return self._wide("conflict")

    def conflicts(self) -> DataFrame:
        return self.cells().where(F.col("verdict") == "conflict").drop("verdict")

    def orphans(self) -> DataFrame:
        """Computed ids with no current record; filling them would create records."""
        return self.joined.where(F.col("_in_c").isNull()).select(
            F.col("_key").alias(self.id_field),
            *[F.col(f"_n_{i}").alias(f) for i, f in enumerate(self.fields)])

    def gaps(self) -> DataFrame:
        """Current ids that nothing was computed for."""
        return self.joined.where(F.col("_in_n").isNull()).select(
            F.col("_key").alias(self.id_field))

    def counts(self) -> DataFrame:
        """A1: cells per field and verdict."""
        return self.cells().groupBy("field", "verdict").agg(F.count(F.lit(1)).alias("cells"))

    def record_counts(self) -> DataFrame:
        """A1: records in each payload, in one row; no distinct count is needed."""
        per = lambda wanted: reduce(
            lambda a, b: a | b, [self._verdict(i) == wanted for i in range(len(self.fields))])
        both = F.col("_in_n") & F.col("_in_c")
        return self.joined.agg(
            F.count_if(both & per("fill")).alias("update_records"),
            F.count_if(both & per("conflict")).alias("overwrite_records"),
            F.count_if(F.col("_in_c").isNull()).alias("orphan_records"),
            F.count_if(F.col("_in_n").isNull()).alias("gap_records"))


def verify_live(planned: DataFrame, live: DataFrame, id_field: str, mode: str = "safe",
                fields: list[str] | None = None, unique: bool = False,
                seq: str | None = None) -> DataFrame:
    """Planned cells against the live state: ``already_current``, ``conflict`` or ``keep``.

    Blank planned cells are skipped. ``safe`` compares normalised values and treats a planned 0
    like any other value; ``reference`` compares raw text and never calls a planned 0 a conflict.
    Several drafts may plan for one record. Of live rows with one id the last in the order of their
    column ``seq`` counts, or without it the one with the greatest values; ``unique`` says that no
    live id repeats.
    """
    if mode not in ("safe", "reference"):
        raise ValueError(f"mode {mode!r} is neither 'safe' nor 'reference'")
    names = fields or [c for c in planned.columns if c not in (id_field, seq)]
    if seq:
        live = last_per_key(live.withColumn("_key", strip(live[id_field])), ["_key"], [seq]).drop(
            "_key", seq)
    present = [n for n in names if n in live.columns]
    safe = mode == "safe"

    def side(df, tag, chosen, trim):
        cells = df.select(strip(df[id_field]).alias("_key"), *[
            (strip(F.col(f"`{n}`")) if trim else F.coalesce(F.col(f"`{n}`"), F.lit("")))
            .alias(f"_{tag}_{names.index(n)}") for n in chosen])
        if not safe:
            return cells
        return cells.select("_key", *[norm_value(c, trimmed=True).alias(c)
                                      for c in cells.columns if c != "_key"])

    left = side(planned, "p", names, trim=safe).where(F.col("_key") != "")
    joined = left.join(_one_per_key(side(live, "l", present, trim=True), unique), "_key", "left")
    cells = joined.select(F.col("_key").alias(id_field), F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"_p_{i}").alias("planned"),
                 (F.coalesce(F.col(f"_l_{i}"), F.lit("")) if n in present else F.lit(""))
                 .alias("live")) for i, n in enumerate(names)])).alias("c")) \
        .select(id_field, "c.*")
    differs = F.col("live") != ""
    if mode == "reference":
        differs = differs & (F.col("planned") != "0")
    return cells.where(F.col("planned") != "").withColumn(
        "outcome",
        F.when(F.col("live") == F.col("planned"), "already_current")
        .when(differs, "conflict").otherwise("keep"))


def changed_values(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Keep only assignments that would change the stored value."""
    return pairs.where(~F.col(old).eqNullSafe(F.col(new)))


def fingerprint(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """One short code for these rows going to this target; any edited cell changes it.

    Rows are hashed alone and folded with order-free sums, so neither file order nor partitioning
    matters. ``code`` is the hash of the row count, two xor folds and two sums.
    """
    names = sorted(columns or df.columns)
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    text = F.concat_ws("\u001e", *[F.concat_ws("\u001f", F.lit(c), cell(c)) for c in names])
    digest = F.md5(text)
    part = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    halves = df.select(part(1).alias("a"), part(17).alias("b"))
    folded = halves.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"),
        F.sum(F.col("a").cast("decimal(38,0)")).alias("sa"),
        F.sum(F.col("b").cast("decimal(38,0)")).alias("sb"))
    zero = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    return folded.select(
        F.col("n").alias("rows"),
        F.substring(F.md5(F.concat_ws("|", F.lit(target), zero("n"), zero("xa"), zero("xb"),
                                      zero("sa"), zero("sb"))), 1, 16).alias("code"))
