"""Skip-logic text compiled once on the driver into Columns that Spark evaluates."""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.cells import NUMBER, col, number, strip
from ..functions.text import checkbox_spellings
from .dictionary import Dictionary

DOES_NOT, APPLIES, PERHAPS = 0, 1, 2
#: Bits of clauses in one long number.
WORD = 62
COMPARE = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Clause:
    field: str
    option: str | None
    op: str
    value: str


@dataclass(frozen=True)
class Grammar:
    """What a clause may look like: its operators, quotes and blanks, and whether a value may stand
    without quotes and a name may use letters beyond ASCII."""
    operators: tuple[str, ...]
    quotes: str
    blanks: str | None
    bare_values: bool
    ascii_names: bool


#: Skip logic in full, and the narrower shape that import linting reads. Two-sign operators first.
FULL = Grammar(("<=", ">=", "<>", "!=", "=", "<", ">"), "'\"", " \t\n\r\f\v", True, True)
IMPORT = Grammar(("=",), "'", None, False, False)


def _is_name(text: str, grammar: Grammar) -> bool:
    plain = text.replace("_", "a")
    return plain.isalnum() and (plain.isascii() or not grammar.ascii_names)


def read_clause(text: str, grammar: Grammar) -> tuple[Clause, str] | None:
    """The clause at the start of the text and what follows it; None if there is none."""
    inside, closed, rest = text[1:].partition("]")
    if not text.startswith("[") or not closed:
        return None
    field, opened, option = inside.partition("(")
    if opened:
        if not option.endswith(")") or not _is_name(option[:-1].removeprefix("-"), grammar):
            return None
        option = option[:-1]
    if not _is_name(field, grammar):
        return None
    rest = rest.lstrip(grammar.blanks)
    op = next((o for o in grammar.operators if rest.startswith(o)), None)
    if op is None:
        return None
    rest = rest[len(op):].lstrip(grammar.blanks)
    if rest[:1] and rest[0] in grammar.quotes:
        value, closed, rest = rest[1:].partition(rest[0])
        if not closed:
            return None
    elif grammar.bare_values:
        size = next((i for i, c in enumerate(rest) if c.isspace() or c in grammar.quotes), len(rest))
        value, rest = rest[:size], rest[size:]
        if not value:
            return None
    else:
        return None
    return Clause(field, option if opened else None, op, value), rest


def parse_clause(text: str) -> Clause | None:
    """One clause, or None when any part of the text is not understood."""
    found = read_clause(text.strip(), FULL)
    return found[0] if found and not found[1] else None


def branches(text: str) -> list[list[str]]:
    """OR-parts, each a list of AND-clauses, in the order they are written."""
    if not text or not text.strip():
        return []
    ors = re.split(r"\s+or\s+", text, flags=re.I)
    return [re.split(r"\s+and\s+", part, flags=re.I) for part in ors]


def gates(text: str) -> list[str]:
    """Fields the logic reads, in order of first use."""
    parsed = (parse_clause(c) for part in branches(text) for c in part)
    return list(dict.fromkeys(c.field for c in parsed if c))


def unreadable(text: str) -> bool:
    return any(parse_clause(c) is None for part in branches(text) for c in part)


def import_clauses(text: str) -> list[Clause] | None:
    """The import grammar: quoted equality joined by OR; None when it is anything more.

    A part may hold other text around its clause; its first clause counts.
    """
    lowered = (text or "").lower()
    if " and " in lowered or "<>" in lowered:
        return None
    out = []
    for part in filter(None, re.split(r"\s+or\s+", (text or "").strip(), flags=re.I)):
        starts = (i for i, c in enumerate(part) if c == "[")
        found = next((f for f in (read_clause(part[i:], IMPORT) for i in starts) if f), None)
        if found is None:
            return None
        out.append(found[0])
    return out


def compared_as_numbers(text: str) -> list[str]:
    """Fields that the logic puts in order rather than testing for equality."""
    parsed = (parse_clause(c) for part in branches(text) for c in part)
    return list(dict.fromkeys(c.field for c in parsed if c and c.op in COMPARE and not c.option))


class LogicCompiler:
    """Builds applicability Columns against a known set of record columns.

    ``trimmed`` says the columns are stripped already, and ``numbers`` maps a column to an expression
    that holds it as a double, so that many conditions can share one conversion.
    """

    def __init__(self, columns, trimmed: bool = False, numbers: dict[str, Column] | None = None):
        self.columns = set(columns)
        self.trimmed = trimmed
        self.numbers = numbers or {}

    def cell(self, clause: Clause) -> Column:
        names = (clause.field,) if clause.option is None \
            else checkbox_spellings(clause.field, clause.option)
        hit = next((n for n in names if n in self.columns), None)
        if hit is None:
            return F.lit("")
        return F.col(f"`{hit}`") if self.trimmed else strip(F.col(f"`{hit}`"))

    def clause(self, text: str) -> tuple[Column, Column | None]:
        """(holds, cannot be told), the second None when the clause always can be told."""
        parsed = parse_clause(text)
        if parsed is None:
            return F.lit(False), F.lit(True)
        actual = self.cell(parsed)
        want = parsed.value.strip()
        if parsed.op == "=":
            return actual == want, None
        if parsed.op in ("<>", "!="):
            return actual != want, None
        if not re.fullmatch(NUMBER.strip("^$"), want):
            return F.lit(False), actual != ""
        ready = self.numbers.get(parsed.field) if parsed.option is None else None
        value = number(actual, trimmed=True) if ready is None else ready
        holds = F.coalesce(COMPARE[parsed.op](value, F.lit(float(want))), F.lit(False))
        return holds, (actual != "") & value.isNull()

    def applicability(self, text: str, order_free: bool = False) -> Column:
        """``APPLIES``, ``PERHAPS`` or ``DOES_NOT``, never null.

        By default clauses are read left to right: an AND part stops at its first false clause,
        so an unknown clause only counts when it comes before that. ``order_free`` uses plain
        three-valued logic instead, where a false clause settles its part wherever it stands.
        """
        bits = ClauseBits(self, [text], order_free)
        return bits.state(text, bits.words())

    def parent_true(self, clauses: list[Clause]) -> Column:
        return reduce(lambda a, b: a | b, [self.cell(c) == c.value.strip() for c in clauses])


class ClauseBits:
    """Many conditions as masks over the bits of their distinct clauses.

    A clause is evaluated once, however many conditions hold it: one bit says that it holds and, where
    it can be in doubt, one that it cannot be told and one that it is not false. ``words`` has the bits;
    keep each word in a column of its own and give those to ``state``, so that the code of a condition is
    a few comparisons of long numbers whatever its clauses are. (An array of the words would be
    optimised away, and every clause be repeated in each condition.)
    """

    def __init__(self, compiler: LogicCompiler, texts, order_free: bool = False):
        self.order_free = order_free
        self.tests: list[Column] = []
        self._clauses: dict = {}
        self.parts = {text: [[self._clause(compiler, c) for c in part] for part in branches(text)]
                      for text in dict.fromkeys(texts)}

    def _clause(self, compiler: LogicCompiler, text: str) -> tuple[int, int | None, int]:
        """Bits of a clause: holds, cannot be told (None where it always can), is not false."""
        key = parse_clause(text) or text.strip()
        if key not in self._clauses:
            holds, unknown = compiler.clause(text)
            at = len(self.tests)
            self.tests += [holds] if unknown is None else [holds, unknown, holds | unknown]
            self._clauses[key] = (at, None, at) if unknown is None else (at, at + 1, at + 2)
        return self._clauses[key]

    def words(self) -> list[Column]:
        """The bits, as long numbers."""
        none = F.lit(0).cast("long")
        marks = [F.when(test, F.lit(1 << i % WORD).cast("long")).otherwise(none)
                 for i, test in enumerate(self.tests)]
        return [reduce(lambda a, b: a.bitwiseOR(b), marks[i:i + WORD])
                for i in range(0, len(marks), WORD)]

    @staticmethod
    def _all_set(bits, words: list[Column]) -> Column:
        masks: dict[int, int] = {}
        for bit in bits:
            masks[bit // WORD] = masks.get(bit // WORD, 0) | 1 << bit % WORD
        tests = [words[w].bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long")
                 for w, m in masks.items()]
        return reduce(lambda a, b: a & b, tests)

    def _doubts(self, part) -> list[list[int]]:
        """Sets of bits, one of which is set as a whole where the part cannot be settled."""
        if self.order_free:  # an unknown clause, and no clause that is false
            alive = [c[2] for c in part]
            return [alive + [c[1]] for c in part if c[1] is not None]
        return [[c[0] for c in part[:i]] + [c[1]]  # it is reached before any false one
                for i, c in enumerate(part) if c[1] is not None]

    def state(self, text: str, words: list[Column]) -> Column:
        """``LogicCompiler.applicability`` of one of the conditions, out of the ``words``."""
        if not self.parts[text]:
            return F.lit(APPLIES)
        some = lambda sets: reduce(lambda a, b: a | b, [self._all_set(s, words) for s in sets])
        out = F.when(some([[c[0] for c in part] for part in self.parts[text]]), APPLIES)
        if doubts := [d for part in self.parts[text] for d in self._doubts(part)]:
            out = out.when(some(doubts), PERHAPS)
        return out.otherwise(DOES_NOT)


def logic_report(spark, dictionary: Dictionary):
    """Every logic string with what was made of it: one row per branched field."""
    rows = [
        (f.field_name, f.branching_logic.strip(), unreadable(f.branching_logic),
         import_clauses(f.branching_logic) is None, gates(f.branching_logic))
        for f in dictionary.fields if f.branching_logic.strip()
    ]
    return spark.createDataFrame(
        rows, "field string, logic string, unreadable boolean, skipped_by_import boolean, "
              "gates array<string>")
