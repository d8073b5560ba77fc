"""Text keys, labels, choice strings and one-line renderings."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .cells import SPACE, col, lookup, strip

# Java's \s is ASCII only without the (?U) switch.
SPACES = r"(?U)\s+"


def clean_label(c) -> Column:
    """collapse white space, trim, drop trailing `` ?.:;``."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACES, " ")
    return F.rtrim(F.btrim(text, F.lit(SPACE)), F.lit(" ?.:;"))


def text_key(c, trimmed: bool = False) -> Column:
    """trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(col(c) if trimmed else strip(c)), SPACES, " ")


def title_key(c) -> Column:
    """F8: lower case, anything but a-z and 0-9 is a space, single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def title_match(expected, actual) -> Column:
    """exact, contains or mismatch, on title keys."""
    want, got = title_key(expected), title_key(actual)
    return (
        F.when(want == got, "exact")
        .when((want != "") & got.contains(want), "contains")
        .otherwise("mismatch")
    )


def is_missing_phrase(c, keyed: bool = False) -> Column:
    """the text contains one of the 'not in the chart' fragments; ``keyed`` takes a text key."""
    return (col(c) if keyed else text_key(c)).rlike("|".join(K.MISSING_PHRASES))


def hospital_key(c, neutral=("nyr", "666", "777", "888", "999")) -> Column:
    """lower case alphanumerics without leading zeros; null when blank or a stand-in code."""
    key = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]", "")
    key = F.regexp_replace(key, "^0+", "")
    return F.when((key != "") & ~key.isin(*neutral), key)


def name_tokens(c) -> Column:
    """Distinct words of a name, in order of first use."""
    return F.array_distinct(F.filter(F.split(title_key(c), " "), lambda t: t != ""))


def choice_pairs(c) -> Column:
    """``1, Yes | 0, No`` as array<struct<code,label>>; split on the first comma only."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"\|")
    return F.transform(
        F.filter(parts, lambda p: p.contains(",")),
        lambda p: F.struct(
            strip(F.substring_index(p, ",", 1)).alias("code"),
            strip(F.regexp_replace(p, r"^[^,]*,", "")).alias("label"),
        ),
    )


def choice_map(c) -> Column:
    """F3 as a map; the later of two equal codes wins."""
    pairs = choice_pairs(c)
    codes = F.transform(pairs, lambda p: p["code"])
    last = F.filter(
        pairs,
        lambda p, i: F.array_position(
            F.slice(codes, i + F.lit(2), F.size(codes)), p["code"]) == 0,
    )
    return F.map_from_entries(last)


def decode(c, choices: dict) -> Column:
    """code to label; an unknown code stays as it is."""
    value = col(c)
    return lookup(dict(choices), value, value)


def checkbox_column(field: str, code: str) -> str:
    """the 0/1 column of one option. A negative code takes four underscores."""
    code = str(code)
    return f"{field}____{code[1:]}" if code.startswith("-") else f"{field}___{code}"


def checkbox_spellings(field: str, code: str) -> tuple[str, ...]:
    """Every spelling in use for one option's column; the first is ours."""
    if not code.startswith("-"):
        return (f"{field}___{code}",)
    return (f"{field}____{code[1:]}", f"{field}___{code}")


def checkbox_base(c) -> Column:
    """F6 back: the field an option column belongs to; other names stay as they are."""
    name = col(c)
    base = F.regexp_extract(name, r"^(.+?)___.+$", 1)
    return F.when(base != "", base).otherwise(name)


def checkbox_code(c) -> Column:
    """F6 back: the option code; null when the name is not an option column."""
    name = col(c)
    negative = F.regexp_extract(name, r"^.+?____([0-9]+)$", 1)
    plain = F.regexp_extract(name, r"^.+?___(.+)$", 1)
    return (
        F.when(negative != "", F.concat(F.lit("-"), negative))
        .when(plain != "", plain)
    )


def ticked_labels(columns_by_code: dict[str, str], choices: dict[str, str],
                  separator: str = ", ") -> Column:
    """Labels of the ticked options, in option order, joined."""
    return F.concat_ws(separator, *[
        F.when(strip(c) == "1", F.lit(choices.get(code, code)))
        for code, c in columns_by_code.items()
    ])


def ticked_codes(columns_by_code: dict[str, str]) -> Column:
    """The ticked option codes as an array; the internal form of a checkbox."""
    marks = [F.when(strip(c) == "1", F.lit(code)) for code, c in columns_by_code.items()]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def keyword_class(*texts, rules=K.SUBCATEGORIES, default=K.SUBCATEGORY_UNCLEAR) -> Column:
    """the label of the first rule whose pattern occurs in the joined lower-case text.

    Word boundaries and the dot follow Unicode words and plain line feeds.
    """
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(col(t), F.lit("")) for t in texts]))
    out = None
    for pattern, label in rules:
        hit = hay.rlike("(?Ud)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def strip_honorifics(c) -> Column:
    """drop leading titles such as Dr or Prof."""
    words = "|".join(K.HONORIFICS)
    bare = rf"(?i)^(?:(?:{words})(?:\.(?=\s|$)|(?=\s|$))\s*)+"
    return F.regexp_replace(F.regexp_replace(strip(c), SPACES, " "), bare, "")


def cite_name(surname, first, fallback=None) -> Column:
    """``Surname I``; the fallback column when there is no surname."""
    last = strip(surname)
    initial = F.upper(F.substring(strip_honorifics(first), 1, 1))
    other = F.coalesce(col(fallback), F.lit("")) if fallback is not None else F.lit("")
    return F.when(last == "", other).otherwise(F.rtrim(F.concat_ws(" ", last, initial)))


def literal_parts(c, names: list[str], separator: str = ",") -> list[Column]:
    """split free text literally into named columns; what is not written stays blank."""
    parts = F.split(strip(c), separator)
    last = len(names) - 1
    out = []
    for i, name in enumerate(names):
        piece = F.get(parts, F.lit(i))
        if i == last:
            piece = F.array_join(F.slice(parts, i + 1, 2**31 - 1 - i), separator)
        out.append(F.coalesce(strip(piece), F.lit("")).alias(name))
    return out
