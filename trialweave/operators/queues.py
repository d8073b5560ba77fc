"""Request queues: what is open, what is done, how far builds are, what changed."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.cells import strip


def is_done(marker, done: str = K.DONE_VALUE) -> Column:
    """Done when the marker equals the done value; blank is open."""
    return strip(marker) == done


@dataclass(frozen=True)
class Part:
    """One column in a queue's line: cut to ``cut`` characters, padded to ``width`` (on the right,
    or on the left), ``blank`` where the cell is empty and ``absent`` where the table lacks the
    column; ``instead`` is another part to show in both cases."""
    column: str
    cut: int | None = None
    width: int = 0
    right: bool = False
    blank: str = ""
    absent: str = "?"
    instead: Part | None = None


@dataclass(frozen=True)
class Steps:
    """The number of settled build steps in a queue's line, as ``3/7``."""
    width: int = 0
    steps: tuple[str, ...] = K.BUILD_STEPS


@dataclass(frozen=True)
class Queue:
    """A request queue as its owner describes it: name, column that marks a request as done, and the
    parts of its one-line summary (text, ``Part`` or ``Steps``)."""
    name: str
    marker: str
    template: tuple = ()


def with_status(records: DataFrame, queues: list[Queue], queue: str = "queue") -> DataFrame:
    """Add ``status`` (open or done), the marker column depending on the queue.

    A queue that is not listed, or whose marker the table lacks, has only open requests.
    """
    done = reduce(lambda acc, q: F.when(
        F.col(queue) == q.name,
        is_done(q.marker) if q.marker in records.columns else F.lit(False)).otherwise(acc),
        queues, F.lit(False))
    return records.withColumn("status", F.when(done, "done").otherwise("open"))


def queue_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """Total, open and done per queue (and snapshot)."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "done").alias("done"))


def steps_done(steps=K.BUILD_STEPS, strict: bool = False) -> Column:
    """Completed build steps.

    Lenient counts any value but blank, no and 0; strict counts only Yes.
    """
    def settled(c):
        value = strip(c)
        return value == K.DONE_VALUE if strict else ~F.lower(value).isin("", "no", "0")
    return reduce(lambda a, b: a + b, [F.when(settled(s), 1).otherwise(0) for s in steps])


def progress(steps=K.BUILD_STEPS, strict: bool = False) -> Column:
    return F.concat(steps_done(steps, strict).cast("string"), F.lit(f"/{len(steps)}"))


def progress_histogram(records: DataFrame, steps=K.BUILD_STEPS) -> DataFrame:
    """Records per step count under both readings, from one pass."""
    both = records.select(F.explode(F.array(
        F.struct(F.lit("strict").alias("rule"), steps_done(steps, True).alias("steps")),
        F.struct(F.lit("lenient").alias("rule"), steps_done(steps).alias("steps")))).alias("p"))
    return both.groupBy(F.col("p.rule").alias("rule"), F.col("p.steps").alias("steps")).agg(
        F.count(F.lit(1)).alias("records"))


def queue_diff(previous: DataFrame, current: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Each record's change between two snapshots of (queue, record_id, status).

    ``new_open``, ``newly_done``, ``still_open``, ``still_done``, ``reopened`` and ``vanished``.
    ``unseen_before`` marks records first met already done. Queues missing on either side, because
    they could not be read, are left out.
    """
    keys = key or ["queue", "record_id"]
    head = keys[0]
    none = F.lit(None).cast("string")
    both = previous.select(*keys, F.col("status").alias("before"), none.alias("after")).unionByName(
        current.select(*keys, none.alias("before"), F.col("status").alias("after"))).groupBy(
        *keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    # read from the same shuffle: which queues have rows on both sides
    readable = both.groupBy(F.col(head).alias("_head")).agg(
        F.count("before").alias("_b"), F.count("after").alias("_a")).where("_b > 0 and _a > 0")
    before, after = F.col("before"), F.col("after")
    change = (
        F.when(after.isNull(), "vanished")
        .when((after == "open") & before.isNull(), "new_open")
        .when((after == "open") & (before == "done"), "reopened")
        .when(after == "open", "still_open")
        .when(before == "done", "still_done")
        .otherwise("newly_done"))
    return both.join(readable, both[head] == readable["_head"], "left_semi").select(
        *keys, change.alias("change"),
        ((after == "done") & before.isNull()).alias("unseen_before")).fillna(
        False, ["unseen_before"])


def latest_before(snapshots: DataFrame, stamp: str = "snapshot_ts", before=None) -> DataFrame:
    """The rows of the latest snapshot, or of the latest one earlier than ``before``.

    The stamp is looked up first, so a partitioned table prunes to one partition.
    """
    eligible = snapshots if before is None else snapshots.where(F.col(stamp) < F.lit(before))
    last = eligible.agg(F.max(stamp)).first()[0]
    return snapshots.where(F.col(stamp) == F.lit(last)) if last is not None \
        else snapshots.limit(0)


def summary_from_fields(fields: list[tuple[str, str]], id_field: str) -> Column:
    """The first three filled descriptive fields as ``label: value``."""
    bits = []
    for name, label in fields:
        if name == id_field or name in K.BOOKKEEPING_FIELDS or name.endswith("_complete"):
            continue
        short = " ".join((label or name).split())[:40]
        value = strip(F.col(f"`{name}`"))
        bits.append(F.when(value != "", F.concat(F.lit(short + ": "),
                                                 F.substring(value, 1, 60))))
    text = F.concat_ws("; ", F.slice(F.array_compact(F.array(*bits)), 1, 3)) if bits else F.lit("")
    return F.when(text == "", "(no details filled in)").otherwise(text)


def queue_summary(queue: Queue, columns) -> Column:
    """a queue's own one-line template over the columns that the table has."""
    have = set(columns)

    def padded(text, width, right):
        if not width:
            return text
        fill = F.lpad(text, width, " ") if right else F.rpad(text, width, " ")
        return F.when(F.length(text) >= width, text).otherwise(fill)

    def shown(part):
        if isinstance(part, str):
            return F.lit(part)
        if isinstance(part, Steps):
            known = have >= set(part.steps)
            return padded(progress(part.steps) if known else F.lit("?"), part.width, True)
        other = shown(part.instead) if part.instead else None
        if part.column not in have:
            text = F.lit(part.absent) if other is None else other
        else:
            text = F.coalesce(F.col(part.column), F.lit(""))
            text = F.when(text == "", F.lit(part.blank) if other is None else other).otherwise(text)
        if part.cut:
            text = F.substring(text, 1, part.cut)
        return padded(text, part.width, part.right)
    return F.concat(*[shown(p) for p in queue.template]) if queue.template else F.lit("")


def record_detail(records: DataFrame, id_field: str, labels: dict[str, str]) -> DataFrame:
    """P10: every filled field of each record under its label, completion flags hidden."""
    names = [c for c in records.columns if not c.endswith("_complete")]
    cells = F.array_compact(F.array(*[
        F.when(strip(F.col(f"`{c}`")) != "", F.struct(
            F.lit(i).alias("pos"), F.lit(labels.get(c, c)).alias("label"),
            strip(F.col(f"`{c}`")).alias("value")))
        for i, c in enumerate(names)]))
    return records.select(F.col(id_field).alias("record_id"), F.explode(cells).alias("c")) \
        .select("record_id", "c.*")


def in_id_range(records: DataFrame, id_col: str, low: int, high: int) -> DataFrame:
    """Rows whose number lies in the allowed range."""
    if low > high:
        raise ValueError(f"the range {low}-{high} runs backwards")
    return records.where(strip(id_col).try_cast("long").between(low, high))


def id_range_report(records: DataFrame, id_col: str, low: int, high: int) -> DataFrame:
    """How many rows the range keeps and how many it skips."""
    inside = F.coalesce(strip(id_col).try_cast("long").between(low, high), F.lit(False))
    return records.agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("skipped"))


def parse_id_range(text: str) -> tuple[int, int]:
    """``1-108`` as (1, 108)."""
    low, dash, high = (text or "").partition("-")
    low, high = low.strip(), high.strip()
    if not dash or not (low.isascii() and low.isdigit() and high.isascii() and high.isdigit()):
        raise ValueError(f"{text!r} is not a range such as 1-108")
    if int(low) > int(high):
        raise ValueError(f"the range {text!r} runs backwards")
    return int(low), int(high)

