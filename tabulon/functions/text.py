"""Text scalars as column expressions."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are never indexed.
STOP_WORDS = (
    "a about after all also an and any application applications are as at award awards be been being by can for from funding grant grants has "
    "have in including is it may more must new not of on opportunities opportunity or other program project projects proposal proposals research "
    "shall should support than that the their these this through to under use using was we which will with"
).split()
TOKEN = r"[a-z0-9][a-z0-9+.-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case with the sharp s written out."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def normalize_token(c: Column | str) -> Column:
    """One suffix rule at most: ies -> y, ing, ed, s; short tokens keep their ending."""
    t = F.btrim(_col(c), F.lit(".-"))
    n = F.length(t)

    def cut(k: int) -> Column:
        return F.substring(t, F.lit(1), n - k)

    return (
        F.when((n > 5) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.endswith("ed"), cut(2))
        .when((n > 4) & t.endswith("s") & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


def tokens(c: Column | str) -> Column:
    """Normalised index terms of a text in order, repeats included; null gives none."""
    raw = F.regexp_extract_all(fold(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(raw, normalize_token), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def token_rows(rows: DataFrame, text: Column | str, *keep: str | Column) -> DataFrame:
    """(keep, term): a row for each token of ``tokens``, repeats included.

    Raw tokens are exploded first and normalised in generated code, which a
    function of a whole array is not.
    """
    raw = F.regexp_extract_all(fold(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    each = rows.select(*keep, F.explode(raw).alias("term"))
    each = each.select(*each.columns[:-1], normalize_token("term").alias("term"))
    return each.where((F.length("term") > 1) & ~F.col("term").isin(*STOP_WORDS))


def squeeze(c: Column | str) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def clean_string(c: Column | str, most: int = 20_000) -> Column:
    """Text without NULs, with plain line ends, trimmed and cut; null is ''."""
    t = F.replace(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("\u0000"), F.lit(""))
    return F.substring(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"^\s+|\s+$", ""), 1, most)


def cv_text(c: Column | str, most: int) -> Column:
    """struct<text, truncated>: blanks collapsed, runs of empty lines as one, at most so many characters."""
    t = F.regexp_replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\u0000"), F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"(?m)^ | $", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.struct(F.substring(t, 1, most).alias("text"), (F.length(t) > most).alias("truncated"))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def title_key(c: Column | str) -> Column:
    """Title reduced to letters and digits, for matching across sources."""
    return F.trim(F.regexp_replace(fold(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " "))


def slug(c: Column | str, default: str = "other") -> Column:
    made = F.btrim(F.regexp_replace(fold(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", F.lit(default)).otherwise(made)


def truncate(c: Column | str, most: int) -> Column:
    """Squeezed text, cut to ``most`` characters with an ellipsis as the last."""
    t = squeeze(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


@F.pandas_udf(T.StringType())
def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded; Spark has no built-in for it."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else html.unescape(t))


def strip_markup(c: Column | str) -> Column:
    """Tags removed, block ends as line breaks; references are left as they are."""
    t = F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol|section|article)\s*>", "\n")
    return F.regexp_replace(t, r"(?s)<[^>]*>", "")


def clean_text(c: Column | str) -> Column:
    """Markup and (doubly escaped) references resolved, blanks collapsed, empty lines dropped; null if nothing is left."""
    t = unescape(unescape(strip_markup(c)))
    t = F.regexp_replace(F.replace(t, F.lit(" "), F.lit(" ")), r"[ \t\r\f\x0B]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def clean_document_text(c: Column | str) -> Column:
    """NULs and soft hyphens removed, words joined across line breaks, blanks collapsed."""
    t = F.regexp_replace(_col(c), "[\u0000­]", "")
    t = F.regexp_replace(t, r"(?U)(\w)-[ \t]*\r?\n[ \t]*(\w)", "$1$2")
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(t, r"\s*\n\s*", "\n"))


def context_quote(text: Column, start: Column, end: Column, around: int = 180, most: int = 360) -> Column:
    """Excerpt around [start, end) with an ellipsis at each cut side; offsets count code points from 0."""
    lo = F.greatest(F.lit(0), start - around)
    hi = F.least(F.length(text), end + around)
    body = squeeze(F.substring(text, lo + 1, hi - lo))
    body = F.when(F.length(body) > most, F.substring(body, 1, most)).otherwise(body)
    return F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(hi < F.length(text), F.lit("…")).otherwise(F.lit("")))


def escape_html(c: Column | str) -> Column:
    t = _col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def csv_cell(c: Column | str) -> Column:
    """Quoted cell: quotes doubled, line breaks as spaces, null empty."""
    t = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"\r\n|\r|\n", " ")
    return F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))


def ics_escape(c: Column | str) -> Column:
    t = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for raw, safe in ((";", "\\;"), (",", "\\,")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return F.regexp_replace(t, r"\r\n|\r|\n", r"\\\\n")


def mask_email(c: Column | str) -> Column:
    """First two characters and the domain."""
    t = _col(c)
    return F.when(t.contains("@"), F.concat(F.substring(t, 1, 2), F.lit("…@"), F.substring_index(t, "@", -1)))


def safe_email(c: Column | str) -> Column:
    t = F.trim(_col(c))
    return F.when(t.rlike(r"^[^\s@<>]+@[^\s@<>]+\.[^\s@<>]+$"), t)


def safe_http_url(c: Column | str, upgrade: tuple[str, ...] = (".gov", ".mil")) -> Column:
    """Absolute http(s) URL or null; a bare www. gets https, http on the named domains too."""
    t = F.trim(_col(c))
    t = F.when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)
    host = F.lower(F.regexp_extract(t, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    known = F.lit(False)
    for end in upgrade:
        known = known | host.endswith(end)
    t = F.when(known & F.lower(t).startswith("http://"), F.concat(F.lit("https"), F.substring(t, F.lit(5), F.length(t)))).otherwise(t)
    return F.when((host != "") & ~t.rlike(r"\s"), t)


def url_host(c: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_col(c), r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_within(c: Column | str, domain: str) -> Column:
    """Whether a URL's host is ``domain`` or below it."""
    h = url_host(c)
    return F.coalesce((h == domain) | h.endswith("." + domain), F.lit(False))


def extract_json(c: Column | str) -> Column:
    """The outermost JSON object or array of a reply, code fences and talk around it removed."""
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?i)```(?:json)?", "")
    return F.nullif(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits."""
    return _fnv(_col(c))


@F.pandas_udf(T.StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        h, data = 0x811C9DC5, t.encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = ((h ^ (data[i] | data[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    return texts.map(one)
