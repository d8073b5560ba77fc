"""Descriptive tables: Table 1, missingness, dataset shape, group comparison."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.cells import number, usable
from ..plans.dictionary import Dictionary
from .ordering import running_total

OVERALL = "overall"
#: Most sites that become columns of one table.
MOST_COLUMNS = 1000


def table1(records: DataFrame, dictionary: Dictionary, continuous: list[str],
           categorical: list[str], site_field: str = K.SITE_FIELD,
           sentinels=K.SENTINELS) -> DataFrame:
    """A3 to A5 in long form: (pos, variable, level, statistic, column, value).

    One scan and one aggregate over the grouping sets (site) and (): level counts, usable counts
    and moments are all partial aggregates. Levels and their order come from the dictionary, so a
    level nobody has is still a zero; percentages are of all usable values, codes the dictionary
    does not list included. Rows without a site count in ``overall`` only. Values stay unrounded.
    """
    columns = [F.coalesce(F.col(site_field), F.lit("")).alias("_site")]
    for i, v in enumerate(continuous):
        columns.append(number(usable(v, sentinels)).alias(f"_x{i}"))
    for j, v in enumerate(categorical):
        columns.append(usable(v, sentinels).alias(f"_c{j}"))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i in range(len(continuous)):
        x = f"_x{i}"
        aggs += [F.count(x).alias(f"{x}_n"), F.avg(x).alias(f"{x}_mean"),
                 F.stddev_samp(x).alias(f"{x}_sd")]
    levels = [list(dictionary.levels(v, sentinels).items()) for v in categorical]
    for j, codes in enumerate(levels):
        aggs.append(F.count(f"_c{j}").alias(f"_c{j}_n"))
        aggs += [F.count_if(F.col(f"_c{j}") == code).alias(f"_c{j}_l{k}")
                 for k, (code, _) in enumerate(codes)]
    grouped = records.select(*columns).groupingSets([["_site"], []], "_site").agg(
        F.grouping("_site").alias("_all"), *aggs)
    named = grouped.where((F.col("_all") == 1) | (F.trim("_site") != "")).withColumn(
        "column", F.when(F.col("_all") == 1, OVERALL).otherwise(F.col("_site")))

    lines: list[Column] = []

    def line(variable, level, statistic, value):
        lines.append(F.struct(
            F.lit(len(lines)).alias("pos"), F.lit(variable).alias("variable"),
            F.lit(level).alias("level"), F.lit(statistic).alias("statistic"),
            value.cast("double").alias("value")))

    line("records", "", "n", F.col("_n"))
    for i, v in enumerate(continuous):
        line(v, "", "n", F.col(f"_x{i}_n"))
        line(v, "", "missing", F.col("_n") - F.col(f"_x{i}_n"))
        line(v, "", "mean", F.col(f"_x{i}_mean"))
        line(v, "", "sd", F.col(f"_x{i}_sd"))
    for j, v in enumerate(categorical):
        for k, (_, label) in enumerate(levels[j]):
            line(v, label, "n", F.col(f"_c{j}_l{k}"))
            line(v, label, "pct", F.try_divide(F.col(f"_c{j}_l{k}") * 100.0, F.col(f"_c{j}_n")))
        line(v, "", "missing", F.col("_n") - F.col(f"_c{j}_n"))
    return named.select("column", F.explode(F.array(*lines)).alias("l")).select(
        "l.pos", "l.variable", "l.level", "l.statistic", "column", "l.value")


def table1_wide(long: DataFrame) -> DataFrame:
    """Table 1 with one column per site plus ``overall``. Sites are looked up first; more of them
    than a table can have as columns are refused."""
    found = long.select("column").distinct().limit(MOST_COLUMNS + 2).collect()
    sites = sorted(r[0] for r in found if r[0] != OVERALL)
    if len(sites) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} sites; keep the long table instead")
    return long.groupBy("pos", "variable", "level", "statistic").pivot(
        "column", [*sites, OVERALL]).agg(F.first("value")).orderBy("pos").drop("pos")


def missingness(df: DataFrame, columns: list[str] | None = None, sentinels=K.SENTINELS) -> DataFrame:
    """The share of cells that are blank or a missing code, per column, in one pass."""
    names = columns or df.columns
    gone = lambda c: usable(F.col(f"`{c}`"), sentinels).isNull()
    totals = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(gone(c)).alias(f"_m{i}") for i, c in enumerate(names)])
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"_m{i}").alias("missing"),
                 F.col("_n").alias("records"),
                 F.try_divide(F.col(f"_m{i}"), F.col("_n")).alias("rate"))
        for i, c in enumerate(names)])).alias("r")).select("r.*")


def most_missing(profile: DataFrame, n: int = 15) -> DataFrame:
    """O2: the columns with the highest missing rate."""
    return profile.orderBy(F.desc("rate"), "field").limit(n)


def dataset_shape(records: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Records, columns, id field, coded fields with a choice map."""
    coded = sum(1 for f in dictionary.fields
                if f.field_type in ("radio", "dropdown", "checkbox") and f.choices)
    return records.agg(F.count(F.lit(1)).alias("records")).select(
        "records", F.lit(len(records.columns)).cast("long").alias("fields"),
        F.lit(dictionary.id_field).alias("id_field"),
        F.lit(coded).cast("long").alias("coded_fields"))


def form_list(dictionaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Forms with their first position and number of fields."""
    return dictionaries.groupBy(*(by or []), "form_name").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("fields"))


def form_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Forms that only one of two sister studies has."""
    mark = lambda df, name: df.select("form_name").distinct().withColumn(name, F.lit(True))
    both = mark(left, "_l").join(mark(right, "_r"), "form_name", "full_outer")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        "form_name", F.when(F.col("_r").isNull(), "left").otherwise("right").alias("only_in"))


def _value_counts(df: DataFrame, group: str, value: str, sentinels) -> DataFrame:
    """Rows per group and distinct number; everything below works on this much smaller table."""
    return df.select(F.col(group).alias("group"), number(usable(value, sentinels)).alias("value")) \
        .where(F.col("value").isNotNull()).groupBy("group", "value").agg(
        F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, group: str, value: str, sentinels=K.SENTINELS) -> DataFrame:
    """N, median and quartiles per group, exact, interpolated between order statistics."""
    counts = _value_counts(df, group, value, sentinels)
    ranked = running_total(counts, ["value"], {"upto": "n"}, ["group"])
    sizes = counts.groupBy("group").agg(F.sum("n").alias("total"))
    placed = ranked.join(sizes, "group")
    aggs = []
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (F.col("total") - 1) * q
        holds = lambda rank: (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        aggs += [F.max(F.when(holds(F.floor(at)), F.col("value"))).alias(f"_{name}_lo"),
                 F.max(F.when(holds(F.ceil(at)), F.col("value"))).alias(f"_{name}_hi"),
                 F.max(at - F.floor(at)).alias(f"_{name}_w")]
    edges = placed.groupBy("group").agg(F.max("total").alias("n"), *aggs)
    mix = lambda name: (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
                        * F.col(f"_{name}_w")).alias(name)
    return edges.select("group", "n", mix("q1"), mix("median"), mix("q3"))


def mann_whitney(df: DataFrame, group: str, value: str, first, second,
                 sentinels=K.SENTINELS) -> DataFrame:
    """U of the first group, with the tie-corrected normal score, from average ranks."""
    counts = _value_counts(df, group, value, sentinels).where(
        F.col("group").isin(first, second))
    side = lambda g, name: F.sum(F.when(F.col("group") == g, F.col("n")).otherwise(0)).alias(name)
    pooled = counts.groupBy("value").agg(
        F.sum("n").alias("t"), side(first, "t1"), side(second, "t2"))
    ranked = running_total(pooled, ["value"], {"upto": "t"})
    rank = F.col("upto") - (F.col("t") - 1) / 2.0
    sums = ranked.agg(
        F.sum(F.col("t1") * rank).alias("r1"), F.sum("t1").alias("n1"), F.sum("t2").alias("n2"),
        F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    spread = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return sums.select("n1", "n2", u.alias("u1"),
                       F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, F.sqrt(spread)).alias("z"))


def chi_square(df: DataFrame, row: str, column: str, sentinels=K.SENTINELS) -> DataFrame:
    """Pearson's statistic and degrees of freedom of a two-way table of usable values."""
    cells = df.select(usable(row, sentinels).alias("r"), usable(column, sentinels).alias("c")) \
        .where(F.col("r").isNotNull() & F.col("c").isNotNull()) \
        .groupBy("r", "c").agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("r").agg(F.sum("o").alias("rt"))
    cols = cells.groupBy("c").agg(F.sum("o").alias("ct"))
    # Sum over cells of (o - e)^2 / e equals n * (sum of o^2 / (rt * ct)) - n, so cells nobody
    # is in add nothing and need not be made up.
    filled = cells.join(rows, "r").join(cols, "c")
    part = filled.agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * F.col("o") / (F.col("rt").cast("double") * F.col("ct"))).alias("s"),
        F.countDistinct("r").alias("nr"), F.countDistinct("c").alias("nc"))
    return part.select(
        "n", (F.col("n") * F.col("s") - F.col("n")).alias("chi2"),
        ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"))


def counts_and_shares(df: DataFrame, group: str, value: str, sentinels=K.SENTINELS) -> DataFrame:
    """N and percent of each level within each group."""
    cells = df.select(F.col(group).alias("group"), usable(value, sentinels).alias("level")) \
        .where(F.col("level").isNotNull()).groupBy("group", "level").agg(
        F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("group").agg(F.sum("n").alias("total"))
    return cells.join(totals, "group").select(
        "group", "level", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))
