"""Q11: robust outliers by field and site, units composed along a graph, rules across forms."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.cells import number, usable
from .lineage import LOOKUP_ROWS, checkpointed
from .ordering import running_total

#: A median absolute deviation times this is a standard deviation, for a normal distribution.
NORMAL = 1.4826
#: Limits lie so many such deviations from the median, by default.
CUTOFF = 3.5
#: Ranks that a sketch is read at to find the deviation from its own median.
STEPS = 400


def field_values(records: DataFrame, fields: Sequence[str], id_field: str,
                 site_field: str = K.SITE_FIELD, sentinels=K.SENTINELS) -> DataFrame:
    """(record_id, site, field, value) of every usable number; one narrow pass."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), number(usable(f, sentinels)).alias("value"))
                      for f in fields))
    return (records.select(F.col(id_field).alias("record_id"),
                           F.coalesce(F.col(site_field), F.lit("")).alias("site"), F.explode(cells).alias("c"))
            .select("record_id", "site", "c.field", "c.value").where("value is not null and not isnan(value)"))


def _medians(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """Exact medians of ``value`` counted ``n`` times; the order is dealt into ranges, so a group that
    holds a third of all rows is not one task's."""
    ranked = running_total(counts, ["value"], {"upto": "n"}, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    middle = (F.col("_total") - 1) / 2

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))
    return ranked.join(totals, by).groupBy(*by).agg(
        F.max("_total").alias("n"), ((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias(name))


def _limits(found: DataFrame, cutoff: float) -> DataFrame:
    reach = F.col("mad") * F.lit(NORMAL * cutoff)
    return found.withColumn("low", F.col("median") - reach).withColumn("high", F.col("median") + reach)


def exact_limits(values: DataFrame, by: Sequence[str] = ("site", "field"), cutoff: float = CUTOFF) -> DataFrame:
    """Per group: ``n``, ``median``, ``mad`` (median absolute deviation), ``low`` and ``high``.

    Everything after the first aggregate works on different values with their counts.
    """
    by = list(by)
    counts = checkpointed(values.groupBy(*by, "value").agg(F.count("*").alias("n")))
    middle = _medians(counts, by, "median")
    apart = (counts.join(middle.drop("n"), by)
             .select(*by, F.abs(F.col("value") - F.col("median")).alias("value"), "n")
             .groupBy(*by, "value").agg(F.sum("n").alias("n")))
    return _limits(middle.join(_medians(apart, by, "mad").drop("n"), by), cutoff)


def value_sketches(values: DataFrame, by: Sequence[str] = ("site", "field"), k: int = 800) -> DataFrame:
    """Per group ``n`` and a quantile ``sketch`` of fixed size, in one pass with partial aggregation.
    Sketches of more data, or of other rounds, merge with ``merge_sketches``."""
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("field",)) -> DataFrame:
    """Sketches of larger groups from those of smaller ones, without the values."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_limits(sketches: DataFrame, by: Sequence[str] = ("site", "field"), cutoff: float = CUTOFF) -> DataFrame:
    """The same columns as ``exact_limits`` from sketches alone: the deviation is that of evenly spaced
    ranks from the median, so the error is that of the sketch's ranks."""
    ranks = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    read = sketches.select(*by, "n", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"),
                           F.kll_sketch_get_quantile_double("sketch", ranks).alias("_at"))
    apart = F.array_sort(F.transform("_at", lambda x: F.abs(x - F.col("median"))))
    return _limits(read.select(*by, "n", "median", F.get(apart, F.lit(STEPS // 2)).alias("mad")), cutoff)


def outlier_cells(values: DataFrame, limits: DataFrame, by: Sequence[str] = ("site", "field")) -> DataFrame:
    """Cells outside their group's limits: (record_id, site, field, value, median, mad, side).
    Groups whose deviation is 0 have no limits, since more than half of their values are equal."""
    found = values.join(_small(limits.where("mad > 0").drop("n")), list(by)).where("value < low or value > high")
    return found.select("record_id", "site", "field", "value", "median", "mad",
                        F.when(F.col("value") < F.col("low"), "low").otherwise("high").alias("side"))


def _small(df: DataFrame) -> DataFrame:
    """The frame checkpointed, with a broadcast hint only if it is small."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else kept


def unit_paths(conversions: DataFrame) -> DataFrame:
    """Every pair of units that conversions lead between: (from_unit, to_unit, factor, offset, hops), with
    ``to = from * factor + offset``, composed along a shortest path.

    ``conversions`` has from_unit, to_unit, factor and offset, each of use both ways. Paths double in
    length each round, so rounds grow with the logarithm of the longest. Rows with a null or with
    factor 0 are not read. A unit leads to itself in 0 hops.
    """
    given = conversions.select("from_unit", "to_unit", F.col("factor").cast("double").alias("factor"),
                               F.coalesce(F.col("offset").cast("double"), F.lit(0.0)).alias("offset")).where(
        "from_unit is not null and to_unit is not null and factor <> 0")
    back = given.select(F.col("to_unit").alias("from_unit"), F.col("from_unit").alias("to_unit"),
                        (1 / F.col("factor")).alias("factor"), (-F.col("offset") / F.col("factor")).alias("offset"))
    edges = given.unionByName(back).withColumn("hops", F.lit(1))
    own = edges.select("from_unit", F.col("from_unit").alias("to_unit"), F.lit(1.0).alias("factor"),
                       F.lit(0.0).alias("offset"), F.lit(0).alias("hops")).distinct()
    known, size = checkpointed(_shortest(edges.unionByName(own))), 0
    while (count := known.count()) != size:
        size = count
        left = known.select("from_unit", F.col("to_unit").alias("via"), *(F.col(c).alias(f"l_{c}") for c in ("factor", "offset", "hops")))
        right = known.withColumnRenamed("from_unit", "via")
        known = checkpointed(_shortest(left.join(right, "via").select(
            "from_unit", "to_unit", (F.col("l_factor") * F.col("factor")).alias("factor"),
            (F.col("l_offset") * F.col("factor") + F.col("offset")).alias("offset"),
            (F.col("l_hops") + F.col("hops")).alias("hops"))))
    return known


def _shortest(paths: DataFrame) -> DataFrame:
    best = F.min(F.struct("hops", "factor", "offset")).alias("best")
    return paths.groupBy("from_unit", "to_unit").agg(best).select(
        "from_unit", "to_unit", "best.factor", "best.offset", "best.hops")


def unit_conflicts(conversions: DataFrame, paths: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Given conversions that another path contradicts: (from_unit, to_unit, factor, path_factor)."""
    told = conversions.select("from_unit", "to_unit", F.col("factor").cast("double").alias("factor"),
                              F.coalesce(F.col("offset").cast("double"), F.lit(0.0)).alias("offset"))
    path = paths.select("from_unit", "to_unit", F.col("factor").alias("path_factor"), F.col("offset").alias("path_offset"))
    off = ((F.abs(F.col("factor") - F.col("path_factor")) > tolerance * F.abs("path_factor"))
           | (F.abs(F.col("offset") - F.col("path_offset")) > tolerance * F.greatest(F.lit(1.0), F.abs("path_offset"))))
    return told.join(path, ["from_unit", "to_unit"]).where(off).select("from_unit", "to_unit", "factor", "path_factor")


def harmonised(values: DataFrame, paths: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Values with ``standard``, in the target unit of their field, and ``status``: same, converted, no_unit
    (read as the target) or unknown_unit (null). ``values`` has field, value and unit as text; fields
    without a target are left out."""
    wanted = F.create_map(*(F.lit(x) for pair in targets.items() for x in pair))
    unit = F.btrim(F.coalesce("unit", F.lit("")))
    rows = values.withColumn("unit", unit).withColumn("target", F.try_element_at(wanted, F.col("field"))).where(
        "target is not null")
    way = _small(paths.select(F.col("from_unit").alias("_from"), F.col("to_unit").alias("_to"), "factor", "offset"))
    joined = rows.join(way, (F.col("unit") == F.col("_from")) & (F.col("target") == F.col("_to")), "left")
    status = (F.when(F.col("unit") == "", "no_unit").when(F.col("unit") == F.col("target"), "same")
              .when(F.col("factor").isNull(), "unknown_unit").otherwise("converted"))
    standard = (F.when(F.col("unit").isin("") | (F.col("unit") == F.col("target")), F.col("value"))
                .otherwise(F.col("value") * F.col("factor") + F.col("offset")))
    return joined.select(*rows.columns, standard.alias("standard"), status.alias("status"))


def unit_mismatches(rows: DataFrame, limits: DataFrame, paths: DataFrame) -> DataFrame:
    """Cells of ``harmonised`` outside their limits that lie inside them if the value is read in another
    unit: (record_id, site, field, value, unit, likely_unit), the likely unit being that which comes nearest to
    the median. Only cells outside their limits meet the units, so few rows are multiplied."""
    bounds = _small(limits.where("mad > 0").select("site", "field", "median", "low", "high"))
    outside = rows.where("standard is not null").join(bounds, ["site", "field"]).where(
        "standard < low or standard > high")
    way = _small(paths.select(F.col("from_unit").alias("likely_unit"), F.col("to_unit").alias("target"), "factor", "offset"))
    read = outside.join(way, "target").withColumn("other", F.col("value") * F.col("factor") + F.col("offset")).where(
        "likely_unit <> unit and other >= low and other <= high")
    best = F.min(F.struct(F.abs(F.col("other") - F.col("median")).alias("far"), "likely_unit")).alias("best")
    keys = ["record_id", "site", "field", "value", "unit"]
    return read.groupBy(*keys).agg(best).select(*keys, "best.likely_unit")


class CrossRule(NamedTuple):
    """``left`` and ``right`` are ``form.field``; a finding is a pair of usable values for which
    ``left op right + slack`` does not hold. ``kind`` is number or date, slack in its units or in days."""
    name: str
    left: str
    op: str
    right: str
    kind: str = "number"
    slack: float = 0
    severity: str = "error"


_OPS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
        "<": lambda a, b: a < b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


def side_by_side(forms: dict[str, DataFrame], id_field: str) -> DataFrame:
    """One row for each record: ``record_id``, a map ``rows`` from form to its number of rows, and every
    field as ``form.field``. All forms are stacked and grouped once, so no join can multiply rows; of a form that
    a record has several times the greatest row stands, and rules count it as repeated."""
    stacked = [df.select(F.col(id_field).alias("record_id"), F.lit(form).alias("form"),
                         F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns if c != id_field)).alias(form))
               for form, df in forms.items()]
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    grouped = all_rows.groupBy("record_id").agg(
        *(F.max(form).alias(form) for form in forms),
        *(F.count_if(F.col("form") == form).alias(f"_n_{form}") for form in forms))
    names = F.create_map(*(x for form in forms for x in (F.lit(form), F.col(f"_n_{form}"))))
    return grouped.select("record_id", names.alias("rows"), *(
        F.col(f"`{form}`.`{c}`").alias(f"{form}.{c}") for form, df in forms.items() for c in df.columns if c != id_field))


def cross_form_findings(records: DataFrame, rules: Sequence[CrossRule], sentinels=K.SENTINELS) -> DataFrame:
    """(record_id, rule, severity, message) of what ``side_by_side`` shows: rules that do not hold, forms that
    a rule needs and the record lacks (``missing_form``), and forms it has several times
    (``repeated_form``). Blank values and missing codes break no rule."""
    def read(name: str, kind: str) -> Column:
        text = usable(F.col(f"`{name}`"), sentinels)
        return number(text) if kind == "number" else F.date_diff(text.try_cast("date"), F.lit("1970-01-01").cast("date"))

    checks = []
    for rule in rules:
        a, b = read(rule.left, rule.kind), read(rule.right, rule.kind)
        said = F.concat_ws(" ", F.col(f"`{rule.left}`"), F.lit(rule.op), F.col(f"`{rule.right}`"))
        checks.append(F.when(~_OPS[rule.op](a, b + F.lit(rule.slack)), F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), said.alias("message"))))
    for form in sorted({side.split(".")[0] for rule in rules for side in (rule.left, rule.right)}):
        held = F.col("rows")[form]
        checks += [F.when(held == 0, F.struct(F.lit("missing_form").alias("rule"), F.lit("warn").alias("severity"),
                                              F.lit(form).alias("message"))),
                   F.when(held > 1, F.struct(F.lit("repeated_form").alias("rule"), F.lit("warn").alias("severity"),
                                             F.lit(form).alias("message")))]
    return records.select("record_id", F.explode(F.array_compact(F.array(*checks))).alias("f")).select(
        "record_id", "f.*")
