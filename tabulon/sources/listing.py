"""Listings: pages that repeat a linked title and labelled lines, as records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import text_date
from tabulon.functions.text import squeeze, strip_markup, unescape

LINK = r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)"


def keep_links(html: Column) -> Column:
    """Markup as text lines in which links stay as [text](address)."""
    marked = F.regexp_replace(html, r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)")
    return unescape(strip_markup(marked))


def entries(pages: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, nth, title, url, body): a listing cut at its lines that begin with a linked title."""
    cuts = F.filter(F.split(text, rf"(?m)^(?=\s*{LINK})"), lambda c: c.rlike(rf"^\s*{LINK}"))
    spread = pages.select(key, F.posexplode(cuts).alias("nth", "cut"))
    return spread.select(key, "nth", squeeze(F.regexp_extract("cut", LINK, 1)).alias("title"), F.regexp_extract("cut", LINK, 2).alias("url"), F.regexp_replace("cut", rf"^\s*{LINK}", "").alias("body"))


def field(body: Column, labels: Sequence[str]) -> Column:
    """First non-empty value behind one of the labels, on its line."""
    names = "|".join(labels)
    return F.nullif(squeeze(F.regexp_extract(body, rf"(?im)^\W*(?:{names})\s*:\W*(\S[^\n]*)$", 1)), F.lit(""))


def records(pages: DataFrame, key: str, text: Column, labels: Mapping[str, Sequence[str]], date_fields: Sequence[str] = ()) -> DataFrame:
    """Entries with a column for each labelled field; those in ``date_fields`` as dates."""
    rows = entries(pages, key, text)
    values = [(text_date(field(F.col("body"), names)) if name in date_fields else field(F.col("body"), names)).alias(name) for name, names in labels.items()]
    return rows.select(key, "nth", "title", "url", *values)
