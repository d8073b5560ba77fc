"""Repair of conversation structure through an automaton that conversations share from their ends.

Every row gets a letter for its role and its first fault; a conversation is the word of its letters.
Different words are read from their ends: sorted by the reversed word, words with a common ending
follow each other, so a stack of nodes holds the ending they share, and a node (a different ending) is
made once in a range of words. It has the cost to go and the best next edit for each state of the
grammar ``(s?(ua)+)?``. The edits open to a state differ in their initials, so the least initial of
the cheapest is the least audit, and audits are read off the nodes without comparing texts.

Equal rows are counted first, and rows are dealt by ranges of (conversation, turn, role, text), so a
large conversation is spread while faults and letters are found. Its letters come together in one
value, as long as its audit, which is one value too; its texts never do: repaired rows are streamed in
order, one conversation after the other.
"""
from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, ship

# Costs of the edits, white space and sentence ends, as the contract has them.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
VISIBLE = r"[^\x20\x09-\x0D]"
ENDS = "[.!?]"
ROLES = {"u": "user", "a": "assistant"}
#: Initials of roles that the grammar knows; any other role counts as the last.
INITIALS = "uas-"
#: Letters by fault (none, blank, duplicate, truncated) and initial.
LETTERS = ("uas-", "bcde", "fghi", "UAS_")
#: Letters of a conversation are handed on in runs of about so many rows.
RUN = 1 << 14

_FAULT = {letter: (fault, at) for fault, row in enumerate(LETTERS) for at, letter in enumerate(row)}
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60
#: States of the grammar by what stands before: nothing, s, u, a. Where an initial leads, if it may.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What a changed role or a new row is in each state.
_WRITES = "uuau"
_KEYS = ("conv_id", "turn", "role", "text")


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` of the rows, damaged by the remainder of crc32 of
    ``conv_id:turn`` by 20: 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats
    it and 4 makes its role user. A null is read as one space; null ids and turns stay null."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn))), F.lit(20))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                      said(role).alias("role"), said(text).alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "")
                    .when(F.col("kind") == 2, F.regexp_replace("text", ENDS, ""))
                    .otherwise(F.col("text")).alias("text"), F.explode(times).alias("time")).drop("time"))


def counted(rows: DataFrame) -> DataFrame:
    """Different rows with ``n``, how often each stands, and ``fault`` of the first of them: 0 none, 1 blank,
    2 said in an earlier turn, 3 truncated. Null roles and texts are one space."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    cells = checkpointed(rows.groupBy(*_KEYS).agg(F.count("*").alias("n")).withColumn("said", said))
    first = (cells.groupBy("conv_id", "said")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"),
                  F.count("*").alias("turns")).where("turns > 1")
             .select(F.col("conv_id").alias("_conv_id"), F.col("said").alias("_said"), "first"))
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    last = F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(~F.col("text").rlike(VISIBLE), 1).when(again, 2)
             .when(last.rlike(ENDS), 0).otherwise(3))
    return cells.join(first, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("said") == F.col("_said")),
                      "left").select(*_KEYS, "n", fault.alias("fault"))


def letter(role: str, fault: int) -> str:
    return LETTERS[fault][INITIALS.find(role[0]) if role and role[0] in INITIALS[:3] else 3]


def words(cells: DataFrame) -> DataFrame:
    """``conv_id`` and ``word``, the letters of its rows in order, of each conversation of ``counted``."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (cells.repartitionByRange(parts, *_KEYS).sortWithinPartitions(*_KEYS)
             .select("conv_id", F.substring("role", 1, 1).alias("role"), "n", "fault",
                     F.spark_partition_id().alias("part")))
    ship(cells.sparkSession)

    def run(batches):
        kind = None
        now, part, number, held, size = None, 0, 0, [], 0

        def made(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], pa.int32()),
                 pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.string())],
                ["conv_id", "part", "number", "word"])
        for batch in batches:
            kind, found = batch.schema.field("conv_id").type, []
            for conv, role, n, fault, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (conv != now or size >= RUN):
                    found.append((now, part, number, "".join(held)))
                    number, held, size = number + 1, [], 0
                now, more = conv, letter(role, 1 if fault == 1 else 2)
                held.append(letter(role, fault))
                while n > 1:  # copies of one row may be any number
                    held.append(more * min(n - 1, RUN))
                    n -= min(n - 1, RUN)
                    size += len(held[-1])
                size += 1
            yield made(found)
        if held:
            yield made([(now, part, number, "".join(held))])
    kind = cells.schema["conv_id"].dataType.simpleString()
    runs = dealt.mapInArrow(run, f"conv_id {kind}, part int, number long, word string")
    return runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "number", "word"))).alias("runs")).select(
        "conv_id", F.array_join(F.transform("runs", lambda r: r["word"]), "").alias("word"))


class Endings:
    """The nodes of one word's endings, shortest first; a further word keeps those they share."""

    def __init__(self):
        self.word = ""  # reversed
        self.cost, self.edit, self.counts = array("q"), bytearray(), array("q")
        self._push([0, _FAR, _FAR, 0], ["", "", "", ""], [0, 0, 0, 0])

    def _push(self, cost: list[int], edit: list[str], counts: list[int]) -> None:
        best = [(c, e) for c, e in zip(cost, edit)]
        by_insert = [(best[n][0] + INSERT, "I") for n in (2, 2, 3, 2)]
        best[2:] = min(best[2], by_insert[2]), min(best[3], by_insert[3])
        best[:2] = (min(best[p], (best[2][0] + INSERT, "I")) for p in (0, 1))
        self.cost.extend(c for c, _ in best)
        self.edit.extend(ord(e) if e else 0 for _, e in best)
        self.counts.extend(counts)

    def _grow(self, mark: str) -> None:
        fault, at = _FAULT[mark]
        initial, base = INITIALS[at], len(self.cost) - 4
        cost, edit = [], []
        for state in range(4):
            options = [(DELETE + self.cost[base + state], "D")]
            if fault in (0, 3):
                extra = TRUNCATED if fault == 3 else 0
                if initial in _NEXT[state]:
                    options.append((extra + self.cost[base + _NEXT[state][initial]], "K"))
                written = _NEXT[state][_WRITES[state]]
                options.append((extra + REROLE + self.cost[base + written], "R"))
            best = min(options)
            cost.append(best[0])
            edit.append(best[1])
        counts = list(self.counts[-4:])
        if fault:
            counts[fault - 1] += 1
        if self.word and initial + INITIALS[_FAULT[self.word[-1]][1]] not in _LEGAL:
            counts[3] += 1
        self.word += mark
        self._push(cost, edit, counts)

    def read(self, word: str) -> tuple[int, int, int, int, int, str]:
        """Counts (blank, duplicate, truncated, illegal), cost and audit of a word."""
        back, same = word[::-1], 0
        for x, y in zip(back, self.word):
            if x != y:
                break
            same += 1
        self.word = self.word[:same]
        for held in (self.cost, self.edit, self.counts):
            del held[4 * (same + 1):]
        fresh = back[same:]
        marks = self.word
        for mark in fresh:
            self.word = marks[-1:]  # the neighbour is all that a new node looks at
            self._grow(mark)
            marks = mark
        self.word = back
        audit, state, depth = [], 0, len(word)
        while True:
            edit = chr(self.edit[4 * depth + state])
            if edit == "\0":
                break
            audit.append(edit)
            if edit != "I":
                depth -= 1
            if edit == "K":
                state = _NEXT[state][INITIALS[_FAULT[back[depth]][1]]]
            elif edit in "RI":
                state = _NEXT[state][_WRITES[state]]
        return (*self.counts[-4:], self.cost[4 * len(word)], "".join(audit))


def audits(of_words: DataFrame) -> DataFrame:
    """``word``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` of each
    different word of a frame, in ranges of reversed words."""
    parts = int(of_words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship(of_words.sparkSession)
    dealt = (of_words.select("word").distinct().withColumn("back", F.reverse("word"))
             .repartitionByRange(parts, "back").sortWithinPartitions("back").select("word"))
    names = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        nodes = Endings()
        for batch in batches:
            found = [nodes.read(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[i] for f in found], pa.int64()) for i in range(5)),
                 pa.array([f[5] for f in found], pa.string())], ["word", *names, "audit"])
    return dealt.mapInArrow(run, "word string, " + ", ".join(f"{n} long" for n in names) + ", audit string")


def plan(cells: DataFrame) -> DataFrame:
    """One row for each conversation of ``counted``: ``conv_id``, ``gaps`` (turns left out between its
    least and greatest), the counts of faults and of illegal neighbours, ``cost`` and ``audit``. A row
    without a conversation id belongs to the conversation null. An empty frame gives no rows."""
    told = words(cells)
    turns = cells.groupBy(F.col("conv_id").alias("_conv_id")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    told = checkpointed(told.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id"))
    found = audits(told).withColumnRenamed("word", "_word")
    return told.join(found, F.col("word") == F.col("_word")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair(cells: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired rows of each conversation, in order within a partition that holds the whole of it:
    ``conv_id``, ``place`` (from 0), ``edit`` (K, R or I), ``role`` and ``text``.

    A conversation is streamed: its audit is held, its rows are not. One conversation is one task's,
    since its rows are repaired, and its digest taken, one after the other.
    """
    kind = cells.schema["conv_id"].dataType.simpleString()
    ship(cells.sparkSession)
    heads = planned.select("conv_id", F.lit(0).alias("after"), F.lit(None).cast("long").alias("turn"),
                           F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    both = heads.unionByName(cells.select("conv_id", F.lit(1).alias("after"), "turn", "role", "text", "n"))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "role", "text")

    def run(batches):
        arrow, audit, at, state, place = None, "", 0, 0, 0
        now, out = None, []

        def write(edit, role, text):
            nonlocal place
            out.append((now, place, edit, role, text))
            place += 1

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                initial = _WRITES[state]
                write("I", ROLES[initial], "")
                state, at = _NEXT[state][initial], at + 1

        def made():
            found = pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate(
                    (arrow, pa.int64(), pa.string(), pa.string(), pa.string()))],
                ["conv_id", "place", "edit", "role", "text"])
            out.clear()
            return found
        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for conv, after, _, role, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if not after:
                    inserted()  # what the conversation before ends with
                    now, audit, at, state, place = conv, text, 0, 0, 0
                    continue
                for _ in range(n):
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit == "D":
                        continue
                    initial = _WRITES[state] if edit == "R" else role[0]
                    write(edit, ROLES[initial] if edit == "R" else role, text)
                    state = _NEXT[state][initial]
            yield made()
        inserted()
        if out:
            yield made()
    return dealt.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256`` of the rows of ``repair``, written ``role:text`` and joined by
    line ends, as they stream by; conversations without a row left have none."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        arrow, now, digest = None, None, None

        def made(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], arrow),
                                               pa.array([x[1] for x in found], pa.string())],
                                              ["conv_id", "repaired_sha256"])
        for batch in batches:
            arrow, found = batch.schema.field("conv_id").type, []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest:
                        found.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield made(found)
        if digest:
            yield made([(now, digest.hexdigest())])
    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(originals: DataFrame, damaged: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``originals``: what ``plan`` has on its rows in ``damaged`` and
    the digest of its repaired rows. Without rows it has zeros, no audit and the digest of nothing.
    Null ids are one conversation, null turns come first, null roles and texts are one space; rows of
    equal turns are taken in the order of role and text; repeated rows count as duplicates; empty
    tables give no rows; of other columns nothing is read."""
    cells = checkpointed(counted(damaged))
    planned = checkpointed(plan(cells))
    hashes = digests(repair(cells, planned)).withColumnRenamed("conv_id", "_conv_id")
    everything = planned.withColumnRenamed("conv_id", "_conv_id")
    ids = originals.select(F.col(conv_id).alias("conv_id")).distinct()
    told = (ids.join(everything, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id")
            .join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return told.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
