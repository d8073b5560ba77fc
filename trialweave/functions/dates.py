"""Date parsing. Missing-date codes are legal dates, so they are handled before any parse."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .cells import col, strip
from .text import text_key

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december")
_MONTH = "(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + ")"
# Shapes with the places of year, month and day among their three parts. Numeric months come
# first, day-first before month-first; the first shape that makes a real date wins.
SHAPES = (
    (r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})$", (1, 3, 4)),
    (r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})$", (4, 3, 1)),
    (r"^([0-9]{1,2})(/)([0-9]{1,2})/([0-9]{4})$", (4, 1, 3)),
)
NAMED_SHAPES = (
    (rf"^([0-9]{{1,2}}) {_MONTH} ([0-9]{{4}})$", (3, 2, 1)),
    (rf"^{_MONTH} ([0-9]{{1,2}}) ([0-9]{{4}})$", (3, 1, 2)),
)


def real_date(text: Column) -> Column:
    """``y-m-d`` text as a date, null when there is no such day; a cast, so nothing is thrown."""
    return text.try_cast("date")


def parse_any(c, keyed: bool = False) -> Column:
    """Ten spellings, as ``yyyy-MM-dd`` text; null when none fits.

    Pass ``keyed`` for a column that holds text keys, so the key is worked out once.
    """
    s = col(c) if keyed else text_key(c)
    tries = []
    for shape, (y, m, d) in SHAPES:
        tries.append(F.when(s.rlike(shape), real_date(
            F.regexp_replace(s, shape, f"${y}-${m}-${d}"))))
    for shape, (y, m, d) in NAMED_SHAPES:
        month = F.substring(F.regexp_extract(s, shape, m), 1, 3)
        number = (F.instr(F.lit("".join(n[:3] for n in MONTHS)), month) + 2) / 3
        tries.append(F.when(s.rlike(shape), real_date(F.concat_ws(
            "-", F.regexp_extract(s, shape, y), number.cast("int").cast("string"),
            F.regexp_extract(s, shape, d)))))
    return F.coalesce(*tries).cast("string")


def parse_import(c) -> Column:
    """Blank words give ``''``; D-M-Y and Y-M-D are re-spelt; anything else gives null.

    Dates are re-spelt, not validated, so missing-date codes pass through reversed (D3).
    """
    s = strip(c)
    dmy = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$"
    ymd = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"

    def spelt(pattern, year, month, day):
        part = lambda i: F.regexp_extract(s, pattern, i)
        return F.concat_ws("-", part(year), F.lpad(part(month), 2, "0"), F.lpad(part(day), 2, "0"))

    return (
        F.when((s == "") | F.lower(s).isin(*K.DATE_NULL_WORDS), "")
        .when(s.rlike(dmy), spelt(dmy, 3, 2, 1))
        .when(s.rlike(ymd), spelt(ymd, 1, 2, 3))
    )


def sentinel_to_import(c) -> Column:
    """D3: a displayed missing-date code in its import spelling; other values unchanged."""
    s = strip(c)
    out = s
    for shown, stored in zip(K.DATE_SENTINELS_DISPLAY, K.DATE_SENTINELS_IMPORT):
        out = F.when(s == shown, stored).otherwise(out)
    return out


def is_date_sentinel(c) -> Column:
    return strip(c).isin(*K.DATE_SENTINELS_DISPLAY, *K.DATE_SENTINELS_IMPORT)


def stored_date(c) -> Column:
    """A stored ``yyyy-MM-dd`` cell as a date; missing codes and bad text give null."""
    s = strip(c)
    return F.when(~is_date_sentinel(s) & s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), real_date(s))


def shown_date(c, placeholder: str = "(not provided)") -> Column:
    """``yyyy-MM-dd`` as ``dd/MM/yyyy``; blank as a placeholder; other text unchanged."""
    s = F.coalesce(col(c), F.lit(""))
    turned = F.regexp_replace(s, r"^([0-9]{4})-([0-9]{2})-([0-9]{2}).*$", "$3/$2/$1")
    return F.when(s == "", placeholder).otherwise(turned)


def is_expired(c, as_of) -> Column:
    """The date parses and lies before ``as_of``."""
    when = F.lit(as_of).cast("date") if isinstance(as_of, str) else col(as_of)
    return F.coalesce(stored_date(c) < when, F.lit(False))


LINE = r"^\s*([^:]+):\s*([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})(?![0-9]).*$"


def site_dates(c, keep: int | None = None) -> Column:
    """``Site: dd/mm/yy`` lines as array<struct<site,date>>; impossible dates are dropped.

    A two-digit year is 20xx. All entries are returned, or the first ``keep``.
    """
    lines = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"[\n;]+"), lambda x: x.rlike(LINE))

    def entry(line):
        part = lambda i: F.regexp_extract(line, LINE, i)
        year = F.when(F.length(part(4)) == 2, F.concat(F.lit("20"), part(4))).otherwise(part(4))
        text = F.concat_ws("-", year, F.lpad(part(3), 2, "0"), F.lpad(part(2), 2, "0"))
        good = year.between("1900", "2100") & real_date(text).isNotNull()
        return F.struct(strip(part(1)).alias("site"), F.when(good, text).alias("date"))

    dated = F.filter(F.transform(lines, entry), lambda e: e["date"].isNotNull())
    return dated if keep is None else F.slice(dated, 1, keep)


def site_dates_rejected(c) -> Column:
    """How many lines looked like a dated site but held an impossible date."""
    lines = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"[\n;]+"), lambda x: x.rlike(LINE))
    return F.size(lines) - F.size(site_dates(c))
