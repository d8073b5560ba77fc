"""Cell-level normalisation, comparison and recoding."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K

# Characters trimmed from both ends of a cell.
SPACE = " \t\n\r\u000b\u000c "
INTEGER = r"^\+?(-?)0*([0-9]+)(?:\.0*)?$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trimmed text; null becomes blank."""
    return F.btrim(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(SPACE))


def number(c, trimmed: bool = False) -> Column:
    """The cell as a double, or null when it is not plain numeric text."""
    s = col(c) if trimmed else strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def norm_value(c, trimmed: bool = False) -> Column:
    """F1: trim, text ``nan`` to blank, numeric spellings collapsed (1, 1.0 and 01 are ``1``).

    Whole numbers are collapsed as text, so identifiers of any length keep every digit. Other
    numbers go through a double, from 1e15 on through a wide decimal, and come back in plain
    notation; what 38 digits cannot hold stays text. Pass ``trimmed`` for a column
    that an earlier projection has already stripped, so it is stripped once and not per use.
    """
    s = col(c) if trimmed else strip(c)
    whole = F.regexp_replace(s, INTEGER, "$1$2")
    d = s.try_cast("double")
    size = F.abs(d)
    plain = F.regexp_replace(d.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.lower(s) == "nan", "")
        .when(s.rlike(INTEGER), F.when(whole == "-0", "0").otherwise(whole))
        .when(s.rlike(NUMBER),
              F.when(d == 0, "0").when((size >= 1e-6) & (size < 1e15), plain)
              .when(size >= 1e15, F.coalesce(
                  F.when(size < 1e20, F.regexp_replace(
                      s.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")),
                  s.try_cast("decimal(38,0)").cast("string"), s))
              .otherwise(s))
        .otherwise(s)
    )


def norm_key(c, mode: str = "trim") -> Column:
    """A join key: ``trim`` keeps 007 apart from 7, ``numeric`` collapses them like values."""
    if mode not in ("trim", "numeric"):
        raise ValueError(f"key mode {mode!r} is neither 'trim' nor 'numeric'")
    return norm_value(c) if mode == "numeric" else strip(c)


def verdict(current, computed) -> Column:
    """F2 on already normalised values: noop, fill or conflict. Never erases a value."""
    cur, new = col(current), col(computed)
    return (
        F.when((cur == new) | (new == ""), "noop")
        .when(cur == "", "fill")
        .otherwise("conflict")
    )


def classify(current, computed) -> Column:
    return verdict(norm_value(current), norm_value(computed))


def usable(c, sentinels=K.SENTINELS) -> Column:
    """The trimmed value, or null when blank or a missing code."""
    s = strip(c)
    return F.when((s != "") & ~s.isin(*sentinels), s)


def is_gap(c, sentinels=()) -> Column:
    s = strip(c)
    return (s == "") | s.isin(*sentinels) if sentinels else s == ""


def whole_as_integer(c) -> Column:
    """3.0 is written 3; anything else stays as typed."""
    s = strip(c)
    return F.when(s.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)


def display_number(c, is_count) -> Column:
    """Counts as integers, everything else with two decimals; null is blank."""
    v = col(c)
    flag = F.lit(is_count) if isinstance(is_count, bool) else col(is_count)
    return F.coalesce(
        F.when(flag, v.cast("long").cast("string")).otherwise(F.format_string("%.2f", v)),
        F.lit(""),
    )


def clear_null_words(c, field_type: str) -> Column:
    """Nil, NaN, n/a and kin become 0 for a checkbox bit and blank for every other type."""
    s = strip(c)
    gone = (s == "") | F.lower(s).isin(*K.NULL_WORDS)
    return F.when(gone, "0" if field_type == "checkbox" else "").otherwise(s)


def other_code(c, codes, other: str = "99") -> Column:
    """A value outside the code list is routed to the *other* code."""
    s = strip(c)
    return F.when(s == "", "").when(s.isin(*codes), s).otherwise(other)


def other_text(c, codes) -> Column:
    """The verbatim text that goes beside the *other* code."""
    s = strip(c)
    return F.when((s != "") & ~s.isin(*codes), s).otherwise("")


def site_or_default(c, default: str = K.UNASSIGNED) -> Column:
    """P6."""
    value = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(value == "", default).otherwise(value)


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """A literal map lookup; constant-folded, no join. Meant for dictionary-sized maps."""
    if not mapping:
        return default if default is not None else F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(found, default) if default is not None else found
