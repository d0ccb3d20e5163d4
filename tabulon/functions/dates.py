"""Date scalars: text in several written forms to dates, ages and windows. Bad text gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digits(c: Column, shape: str, form: str) -> Column:
    return F.when(c.rlike(f"^{shape}$"), F.try_to_date(c, form))


def iso_date(c: Column | str) -> Column:
    """YYYY-MM-DD, alone or before a time."""
    t = F.trim(_c(c).cast("string"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))


def strict_iso_date(c: Column | str) -> Column:
    """YYYY-MM-DD and nothing else."""
    return _digits(F.trim(_c(c).cast("string")), r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd")


def compact_date(c: Column | str) -> Column:
    """MMddyyyy."""
    return _digits(F.trim(_c(c)), r"\d{8}", "MMddyyyy")


def slash_date(c: Column | str) -> Column:
    """M/d/yyyy."""
    return _digits(F.trim(_c(c)), r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy")


def _month_number(name: Column) -> Column:
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    return F.nullif(F.array_position(short, F.lower(F.substring(name, 1, 3))), F.lit(0))


#: Names of months and their short forms.
MONTH_NAMES = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
MONTH_FIRST = rf"(?i)\b({MONTH_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
DAY_FIRST = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})\.?,?\s+(\d{{4}})\b"


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%s-%02d-%02d", year, month, day.try_cast("int")), "yyyy-MM-dd")


def text_date(c: Column | str) -> Column:
    """First date in prose: month first (with ordinals, Sept), day first, M/D/YYYY or ISO."""
    t = _c(c)
    one = F.when(t.rlike(MONTH_FIRST), _made(F.regexp_extract(t, MONTH_FIRST, 3), _month_number(F.regexp_extract(t, MONTH_FIRST, 1)), F.regexp_extract(t, MONTH_FIRST, 2)))
    two = F.when(t.rlike(DAY_FIRST), _made(F.regexp_extract(t, DAY_FIRST, 3), _month_number(F.regexp_extract(t, DAY_FIRST, 2)), F.regexp_extract(t, DAY_FIRST, 1)))
    three = slash_date(F.regexp_extract(t, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1))
    four = strict_iso_date(F.regexp_extract(t, r"\b(\d{4}-\d{2}-\d{2})\b", 1))
    return F.coalesce(one, two, three, four)


def document_date(c: Column | str) -> Column:
    """A date as notices write it: month first, or M/D/Y or M-D-Y with two or four digits of the year (69 to 99: 1900s)."""
    t = F.trim(_c(c))
    shape = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$"
    year = F.regexp_extract(t, shape, 4)
    full = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year < "69", "20").otherwise("19"), year))
    numeric = F.when(t.rlike(shape), _made(full, F.regexp_extract(t, shape, 1).try_cast("int"), F.regexp_extract(t, shape, 3)))
    return F.coalesce(numeric, text_date(t))


def feed_date(c: Column | str) -> Column:
    """RFC 822 (``Mon, 06 Jul 2026 ...``) or ISO."""
    t = F.regexp_replace(F.trim(_c(c)), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(iso_date(t), text_date(t))


def eastern_date(c: Column | str) -> Column:
    """Date in New York of a UTC time ``MM/dd/yyyy HH:mm:ss``."""
    return F.to_date(F.from_utc_timestamp(F.try_to_timestamp(_c(c), F.lit("M/d/yyyy H:m:s")), "America/New_York"))


def slash_dates(c: Column | str) -> Column:
    """All valid M/D/YYYY of a text in order."""
    found = F.regexp_extract_all(_c(c), F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.try_to_date(x, "M/d/yyyy")), lambda d: d.isNotNull())


def clock_time(c: Column | str) -> Column:
    """First clock time of a text, as written."""
    return F.nullif(F.trim(F.regexp_extract(_c(c), r"(?i)\b(\d{1,2}(?::\d{2})?\s*[ap]\.?m\b\.?)", 1)), F.lit(""))


def age_days(as_of: Column, *candidates: Column) -> Column:
    """Days since the first known date; null when unknown or in the future."""
    first = F.coalesce(*candidates)
    return F.when(first <= as_of, F.datediff(as_of, first))


def is_new_since(since: Column, *candidates: Column) -> Column:
    """Whether the first known date is at or after the watermark."""
    return F.coalesce(F.coalesce(*candidates) >= since, F.lit(False))
