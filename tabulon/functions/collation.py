"""Natural order of texts: case, accents and runs of digits as a browser's comparator takes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the length that stands before each run of digits.
WIDTH = 4


def natural_key(text: Column | str) -> Column:
    """A sort key in the UNICODE collation, null for null and empty texts.

    Each run of digits gets its length in front and loses its leading zeros, so
    that 2 comes before 10. Letters compare by base letter, then accent, then
    case. Sorting, paging and range partitioning all take this one expression.
    """
    c = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(c.cast("string"), F.lit(r"\d+|\D+"), F.lit(0))

    def padded(run: Column) -> Column:
        digits = F.coalesce(F.nullif(F.ltrim(run, F.lit("0")), F.lit("")), F.lit("0"))
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), WIDTH, "0"), digits)).otherwise(run)

    return F.collate(F.nullif(F.array_join(F.transform(runs, padded), ""), F.lit("")), "UNICODE")


def natural_order(text: Column | str, descending: bool = False) -> Column:
    """Sort column of ``natural_key``; missing values come last in either direction."""
    key = natural_key(text)
    return key.desc_nulls_last() if descending else key.asc_nulls_last()
