"""Completeness worklists: cells that apply to a record and still need an answer."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.cells import number, site_or_default, strip
from ..functions.text import decode, ticked_labels
from ..plans.dictionary import CODED, Dictionary
from ..plans.logic import DOES_NOT, ClauseBits, LogicCompiler, compared_as_numbers, gates
from .lineage import lookup
from .ordering import last_per_key

WITH_CODES, WITHOUT_CODES = "with_MDC", "no_MDC"
MODES = (WITH_CODES, WITHOUT_CODES)


@dataclass(frozen=True)
class Workbook:
    name: str
    fields: tuple[str, ...]
    title: str = ""

    @classmethod
    def from_config(cls, config: dict) -> list["Workbook"]:
        return [cls(w["name"], tuple(w["fields"]), w.get("title", w["name"]))
                for w in config.get("workbooks") or []]


def scope(records: DataFrame, ids: DataFrame, id_field: str) -> DataFrame:
    """P5: keep the records whose trimmed id is listed in the first column of ``ids``."""
    wanted = ids.select(strip(ids.columns[0]).alias("_id")).distinct()
    return records.join(wanted, strip(records[id_field]) == wanted["_id"], "left_semi")


def with_site(records: DataFrame, site_field: str = K.SITE_FIELD,
              default: str = K.UNASSIGNED) -> DataFrame:
    """The site column, blank or absent becoming the default."""
    value = site_or_default(site_field, default) if site_field in records.columns \
        else F.lit(default)
    return records.withColumn(site_field, value)


NUMBERS, BITS, WHY, STATES = "_numbers", "_bits", "_why", "_states"
BLANK, ONLY_CODES = 1, 3


class _Cells:
    """The per-cell verdicts of one prepared record table, as Columns."""

    def __init__(self, records: DataFrame, numbers: dict[str, Column], dictionary: Dictionary, sentinels,
                 order_free: bool):
        self.columns = records.columns
        self.dictionary = dictionary
        self.sentinels = sentinels
        self.order_free = order_free
        self.compiler = LogicCompiler(records.columns, trimmed=True, numbers=numbers)

    def value(self, name: str) -> Column:
        field = self.dictionary[name]
        if field.is_checkbox:
            options = self.dictionary.option_columns(name, self.columns)
            marks = [F.when(F.col(f"`{c}`") == "1", F.lit(code)) for code, c in options.items()]
            return F.concat_ws(",", *marks) if marks else F.lit("")
        return F.col(f"`{name}`") if name in self.columns else F.lit("")

    def held(self, name: str) -> Column:
        """What tells whether a field is answered: its value; of checkboxes null where an option is
        ticked, a missing code where only such codes are."""
        field = self.dictionary[name]
        if not field.is_checkbox:
            return self.value(name)
        options = self.dictionary.option_columns(name, self.columns)
        ticked = [(code, F.col(f"`{c}`") == "1") for code, c in options.items()]
        any_of = lambda marks: reduce(lambda a, b: a | b, marks, F.lit(False))
        real = any_of([t for code, t in ticked if code not in self.sentinels])
        code = any_of([t for code, t in ticked if code in self.sentinels])
        return F.when(real, None).when(code, next(iter(self.sentinels), None)).otherwise("")

    def staged(self, table: DataFrame, names: list[str]) -> DataFrame:
        """Add an array with each field's state, read by ``state``: 0 nothing to do; 1 and 2 blank, 3 and
        4 only missing codes; odd when the condition was certain.

        Fields are elements of arrays and conditions masks over the bits of their clauses, so a step is
        one column whatever the number of fields, and Spark splits its code into small methods.
        """
        names = list(dict.fromkeys(names))
        self.places = {n: i for i, n in enumerate(names)}
        logic = [self.dictionary[n].branching_logic for n in names]
        bits = ClauseBits(self.compiler, logic, self.order_free)
        why = F.transform(F.array(*map(self.held, names)), lambda v: F.when(v == "", BLANK).when(
            v.isin(*self.sentinels), ONLY_CODES).otherwise(0))
        words = [word.alias(f"{BITS}{i}") for i, word in enumerate(bits.words())]
        parts = table.select("*", *words, why.alias(WHY))
        held = [F.col(f"{BITS}{i}") for i in range(len(words))]
        applies = F.array(*[bits.state(text, held) for text in logic])
        return parts.withColumn(STATES, F.zip_with(WHY, applies, lambda w, a: F.when(
            (w > 0) & (a != DOES_NOT), w + a - 1).otherwise(0)))

    def state(self, name: str) -> Column:
        return F.col(STATES)[self.places[name]]

    def cell(self, workbook: str, name: str) -> Column:
        """The flagged cell as a struct, or null when there is nothing to do."""
        state = self.state(name)
        return F.when(
            state > 0,
            F.struct(F.lit(workbook).alias("workbook"), F.lit(name).alias("field"),
                     self.value(name).alias("value"),
                     F.when(state <= 2, "blank").otherwise("sentinel").alias("reason"),
                     F.when(state % 2 == 1, "gap").otherwise("uncertain").alias("flag")))


def _prepared(records, dictionary, workbooks, id_cols, site_field, seq):
    """Site filled, columns pruned to what the workbooks read and stripped once, last duplicate kept.

    Fields that some condition puts in order are kept as doubles too, in one array; where they lie in it
    is the second result. (A column for each would make Spark infer a constraint for every subset of them.)
    """
    records = with_site(records, site_field)
    wanted = [f for w in workbooks for f in w.fields if f in dictionary]
    logic = [dictionary[f].branching_logic for f in wanted]
    read = list(dict.fromkeys(wanted + [g for text in logic for g in gates(text)]))
    cells = [c for c in dictionary.columns_for(read, records.columns)
             if c not in (*id_cols, site_field)]
    ordered = list(dict.fromkeys(f for text in logic for f in compared_as_numbers(text) if f in cells))
    texts = F.array(*[F.col(f"`{f}`").cast("string") for f in ordered]).cast("array<string>")
    table = records.select(
        *id_cols, site_field, *[strip(F.col(f"`{c}`")).alias(c) for c in cells],
        F.transform(texts, lambda v: number(v)).alias(NUMBERS), *([seq] if seq else []))
    if seq:
        table = last_per_key(table, [id_cols[0]], [seq]).drop(seq)
    return table, {f: F.col(NUMBERS)[i] for i, f in enumerate(ordered)}


def worklist_cells(records: DataFrame, dictionary: Dictionary, workbooks: list[Workbook],
                   id_cols: list[str] | None = None, site_field: str = K.SITE_FIELD,
                   sentinels=K.SENTINELS, seq: str | None = None,
                   order_free: bool = False) -> DataFrame:
    """One row per flagged cell and mode, from a single narrow pass over the records.

    A blank cell is in both modes; a cell holding only missing codes is in ``with_MDC`` alone.
    Give ``seq`` when ids may repeat: the row with the highest value is the record.
    """
    ids = list(id_cols or [dictionary.id_field])
    table, numbers = _prepared(records, dictionary, workbooks, ids, site_field, seq)
    cells = _Cells(table, numbers, dictionary, sentinels, order_free)
    pairs = [(w.name, f) for w in workbooks for f in w.fields if f in dictionary]
    if not pairs:
        raise ValueError("no workbook names a field of the dictionary")
    staged = cells.staged(table, [f for _, f in pairs])
    listed = staged.select(*ids, F.col(site_field).alias("site"),
                           F.array_compact(F.array(*[cells.cell(w, f) for w, f in pairs])).alias("_cells"))
    # A plain explode would push a size check of the whole array below.
    one = listed.select(*ids, "site", F.explode_outer("_cells").alias("cell")).where(
        F.col("cell").isNotNull())
    modes = F.when(F.col("cell.reason") == "blank", F.array(*map(F.lit, MODES))) \
        .otherwise(F.array(F.lit(WITH_CODES)))
    return one.select(*ids, "site", F.explode(modes).alias("mode"), "cell.workbook", "cell.field",
                      "cell.value", "cell.reason", "cell.flag")


def worklist_counts(records: DataFrame, dictionary: Dictionary, workbooks: list[Workbook],
                    id_cols: list[str] | None = None, site_field: str = K.SITE_FIELD,
                    sentinels=K.SENTINELS, seq: str | None = None,
                    order_free: bool = False) -> DataFrame:
    """A2: rows with work, gap and uncertain cells per workbook, site and mode.

    Cells are counted inside each record and summed by site, so nothing is exploded before the
    only shuffle, which carries one row per site from each task.
    """
    ids = list(id_cols or [dictionary.id_field])
    table, numbers = _prepared(records, dictionary, workbooks, ids, site_field, seq)
    cells = _Cells(table, numbers, dictionary, sentinels, order_free)
    staged = cells.staged(table, [f for w in workbooks for f in w.fields if f in dictionary])
    # One number per record and workbook holds four 16-bit tallies, one per state, so each field
    # costs one addition whatever the modes need.
    packed, tallies, totals, lines = [], [], [], []
    for i, w in enumerate(workbooks):
        states = [cells.state(f) for f in w.fields if f in dictionary]
        if not states:
            continue
        if len(states) > 0x7FFF:
            raise ValueError(f"workbook {w.name!r} has more fields than a tally can hold")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        packed.append(F.aggregate(F.array(*states), none, lambda total, s: total + F.when(
            s > 0, F.call_function("shiftleft", one, (s - 1) * 16)).otherwise(none)).alias(f"_p{i}"))
        held = lambda state: F.shiftrightunsigned(f"_p{i}", (state - 1) * 16).bitwiseAND(0xFFFF)
        for mode in MODES:
            gap, doubt = f"_g{i}{mode}", f"_u{i}{mode}"
            with_codes = mode == WITH_CODES
            tallies += [(held(1) + held(3) if with_codes else held(1)).alias(gap),
                        (held(2) + held(4) if with_codes else held(2)).alias(doubt)]
            totals += [F.count_if(F.col(gap) + F.col(doubt) > 0).alias(f"_r{gap}"),
                       F.sum(gap).alias(f"_s{gap}"), F.sum(doubt).alias(f"_s{doubt}")]
            lines.append(F.struct(
                F.lit(w.name).alias("workbook"), F.lit(mode).alias("mode"),
                F.col(f"_r{gap}").alias("rows_with_work"), F.col(f"_s{gap}").alias("gap_cells"),
                F.col(f"_s{doubt}").alias("uncertain_cells")))
    per_record = staged.select(F.col(site_field).alias("site"), *packed)
    by_site = per_record.select("site", *tallies).groupBy("site").agg(*totals)
    return by_site.select("site", F.explode(F.array(*lines)).alias("l")).where(
        F.col("l.rows_with_work") > 0).select(
        "l.workbook", "site", "l.mode", "l.rows_with_work", "l.gap_cells", "l.uncertain_cells")


def field_counts(cells: DataFrame) -> DataFrame:
    """A2 by field: gap and uncertain cells per workbook, site, mode and field."""
    return cells.groupBy("workbook", "site", "mode", "field").agg(
        F.count_if(F.col("flag") == "gap").alias("gap_cells"),
        F.count_if(F.col("flag") == "uncertain").alias("uncertain_cells"))


def gate_table(spark, dictionary: Dictionary) -> DataFrame:
    """Field to controlling field, in dictionary order (P4, dictionary side)."""
    rows = [(f.field_name, g) for f in dictionary.fields for g in gates(f.branching_logic)]
    return lookup(spark.createDataFrame(rows, "field string, gate string"), rows)


def display_fields(cells: DataFrame, dictionary: Dictionary) -> DataFrame:
    """What each worklist shows: its flagged fields, and the gates that control them."""
    keys = ["workbook", "site", "mode"]
    flagged = cells.select(*keys, "field").distinct()
    pairs = gate_table(cells.sparkSession, dictionary)
    context = (
        flagged.join(pairs, "field").select(*keys, F.col("gate").alias("field")).distinct()
        .join(flagged, [*keys, "field"], "left_anti")
    )
    return flagged.withColumn("role", F.lit("flagged")).unionByName(
        context.withColumn("role", F.lit("gate")))


def _shown(dictionary: Dictionary, name: str, columns) -> Column:
    field = dictionary.get(name)
    if field is not None and field.is_checkbox:
        return ticked_labels(dictionary.option_columns(name, columns), field.choices)
    value = F.col(f"`{name}`") if name in columns else F.lit("")
    if field is not None and field.field_type in CODED and field.choices:
        return decode(value, field.choices)
    return value


def worklist_sheet(records: DataFrame, dictionary: Dictionary, workbook: Workbook, mode: str,
                   id_cols: list[str] | None = None, site_field: str = K.SITE_FIELD,
                   sentinels=K.SENTINELS, response: str = "RESPONSE") -> DataFrame:
    """One workbook as a wide table: ids, gates, fields under cleaned labels, flags, a note column.

    Gates stand before the fields, both in dictionary order. ``flags`` maps a field to ``gap`` or
    ``uncertain``. Rows without work are left out; filter on ``site`` for one site's sheet.
    """
    ids = list(id_cols or [dictionary.id_field])
    fields = [f for f in workbook.fields if f in dictionary]
    controls = {g for f in fields for g in gates(dictionary[f].branching_logic)} - set(fields)
    order = [f.field_name for f in dictionary.fields if f.field_name in controls] + fields
    table, numbers = _prepared(records, dictionary, [workbook], ids, site_field, None)
    cells = _Cells(table, numbers, dictionary, sentinels, False)
    staged = cells.staged(table, fields)
    flagged = F.array_compact(F.array(*[cells.cell(workbook.name, f) for f in fields]))
    if mode == WITHOUT_CODES:
        flagged = F.filter(flagged, lambda c: c["reason"] == "blank")
    labels = dictionary.label_map(order)
    shown = staged.withColumn("_flagged", flagged).where(
        F.size("_flagged") > 0)
    return shown.select(
        *ids, F.col(site_field).alias("site"),
        *[_shown(dictionary, f, table.columns).alias(labels[f]) for f in order],
        F.map_from_entries(F.transform(
            "_flagged", lambda c: F.struct(c["field"], c["flag"]))).alias("flags"),
        F.lit("").alias(response))


def uncertain_logic(cells: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Logic that could not be settled, with how many cells it left uncertain."""
    rows = [(f.field_name, f.branching_logic.strip()) for f in dictionary.fields
            if f.branching_logic.strip()]
    logic = cells.sparkSession.createDataFrame(rows, "field string, logic string")
    doubtful = cells.where((F.col("flag") == "uncertain") & (F.col("mode") == WITH_CODES))
    return doubtful.groupBy("field").agg(F.count(F.lit(1)).alias("cells")) \
        .join(lookup(logic, rows), "field")


def round_diff(previous: DataFrame, current: DataFrame, id_cols: list[str]) -> DataFrame:
    """Every worklist cell of two rounds as ``closed``, ``still_open`` or ``new``."""
    keys = [*id_cols, "site", "workbook", "mode", "field"]
    before = previous.select(*keys).distinct().withColumn("_before", F.lit(True))
    after = current.select(*keys).distinct().withColumn("_after", F.lit(True))
    return before.join(after, keys, "full_outer").select(
        *keys,
        F.when(F.col("_after").isNull(), "closed")
        .when(F.col("_before").isNull(), "new")
        .otherwise("still_open").alias("status"))
