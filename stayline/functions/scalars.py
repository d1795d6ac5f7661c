"""Parsing of text cells. Every function maps a string Column to a Column; blank cells give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import ACTIVE_WORDS, CHURN_WORDS

# The date formats, and the order of their parts as year, month, day.
DATE_FORMATS = (
    (r"(\d{4}-\d{2}-\d{2})", "$1"),
    (r"(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?", "$1"),
    (r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
    (r"(\d{4})\.(\d{1,2})\.(\d{1,2})", "$1-$2-$3"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    (r"(\d{1,2})-(\d{1,2})-(\d{4})", "$3-$2-$1"),
    (r"([A-Za-z]{3}) (\d{1,2}), (\d{4})", "$3-$1-$2"),
    (r"(\d{1,2}) ([A-Za-z]{3}) (\d{4})", "$3-$2-$1"),
)
#: What all of them become: the month as a number or as a name.
ORDERED = "yyyy-[MMM][M]-d"
NUMBER = r"^(?:[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"


def clean(c: Column) -> Column:
    """Trimmed text; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def is_blank(c: Column) -> Column:
    """Without a character that is not white space."""
    return ~F.coalesce(c.cast("string").rlike(r"\S"), F.lit(False))


def parse_date(c: Column) -> Column:
    """The date of a cell in one of DATE_FORMATS, else NULL; ISO week dates are not read.

    Each format is put in the order year, month, day by one replacement, so the expression grows with the number of
    formats and not with its square, and the text is parsed once.
    """
    t = clean(c)
    known = t.rlike("^(?:" + "|".join(p for p, _ in DATE_FORMATS) + ")$")
    for pattern, order in DATE_FORMATS[1:]:
        t = F.regexp_replace(t, f"^{pattern}$", order)
    return F.when(known, F.try_to_timestamp(t, F.lit(ORDERED)).cast("date"))


def to_float(c: Column) -> Column:
    """Strict number; commas only where they group in threes; infinite values and words give NULL."""
    t = clean(c)
    n = F.when(t.rlike(NUMBER), F.translate(t, ",", "").try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def to_int(c: Column) -> Column:
    n = to_float(c)
    return F.when((n == F.floor(n)) & (F.abs(n) < 9e18), n.try_cast("bigint"))


def status_to_event(c: Column) -> Column:
    """1 for a churn word, 0 for an active word, else NULL; the text "1" is no status word."""
    t = F.lower(clean(c))
    return F.when(t.isin(*CHURN_WORDS), 1).when(t.isin(*ACTIVE_WORDS), 0)


def map_values(c: Column, values: dict[str, str]) -> Column:
    """The exact key, else the first key that is equal without case and outer spaces, else NULL."""
    exact, loose = F.lit(None).cast("string"), F.lit(None).cast("string")
    folded = F.lower(clean(c))
    for key, value in reversed(values.items()):
        exact = F.when(c == key, value).otherwise(exact)
        loose = F.when(folded == key.strip().lower(), value).otherwise(loose)
    return F.coalesce(exact, loose)


def months_before(c: Column, ref: str, midpoint: bool = False) -> Column:
    """Reference date less the months (of 30.4375 days), rounded half to even; ``c`` is numeric."""
    months = c + 0.5 if midpoint else c
    return F.date_sub(F.lit(ref).cast("date"), F.bround(months * 30.4375).cast("int"))


def coerce_feature(c: Column, kind: str) -> Column:
    """``number``: finite double; ``category``: trimmed text, integral numbers without ``.0``."""
    if kind == "number":
        return to_float(c)
    t = clean(c)
    return F.when(t.rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def half_even(c: Column, digits: int = 3) -> Column:
    """Rounded half to even as SQL's ``round_even``: ties are told after scaling, so that 0.65 * 0.53 is one."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def exact(c: Column) -> Column:
    """The double nearest to a decimal of few digits, without what adding and multiplying doubles left on it."""
    return F.round(c, 9)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into the range; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def lookup(c: Column, values: dict, default=None) -> Column:
    """A small fixed table as a CASE expression."""
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out
