"""Exchange pages: a flat run of number links, title links, announcement types and dates.

Nothing on the page holds a row together, so its spans are matched by place: a
row is a number with everything up to the next one, its title the first link
behind, its type what directly follows the title, and its dates those within
``REACH`` characters behind the type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import squeeze, strip_markup, unescape
from tabulon.operators.spans import first_after, last_before, spans

#: Forms of ids, numbers, types and dates, and the reach of a type.
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
NUMBER = r"(?:[A-Z]{2,4}-)?[A-Z0-9]{2,8}-[A-Z0-9]{3,}"
TYPE = r"notice of funding opportunity\s*\(NOFO\)"
DATE = r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+(\d{1,2}:\d{2}\s*(?:AM|PM))\s*ET)?"
REACH = 200
LEAST_ROWS = 3

_ROW, _LINK = "\u0001", "\u0002"
_PATTERNS = {
    "number": (f"{_ROW}[^{_ROW}]*{_ROW}", 0),
    "title": (f"{_LINK}[^{_LINK}]*{_LINK}", 0),
    "type": (rf"(?i){_LINK}\s*{TYPE}(?=([^{_ROW}]{{0,{REACH}}}))", 1),
    "date": (rf"(?i){DATE}", 0),
}


def marked(html: Column) -> Column:
    """The page as text with number links and other links between marks."""
    rows = F.regexp_replace(html, rf"""(?is)<a\b[^>]*[?#]foaid=?({GUID})"[^>]*>\s*({NUMBER})\s*</a>""", f"{_ROW}$1 $2{_ROW}")
    links = F.regexp_replace(rows, r"(?is)<a\b[^>]*>(.*?)</a>", f"{_LINK}$1{_LINK}")
    return squeeze(F.regexp_replace(unescape(strip_markup(links)), r"(?U)\s+", " "))


def _dates(found: Column, after: Column, window: Column) -> Column:
    """array<struct<date, time>> of the dates (start, end, found) within reach, each day once, in order."""
    here = F.filter(found, lambda d: (d["start"] >= after) & (d["start"] < after + F.length(window)))

    def read(d: Column) -> Column:
        part = lambda g: F.regexp_extract(d["found"], rf"(?i){DATE}", g)
        day = F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd")
        time = F.when(d["end"] <= after + F.length(window), F.nullif(F.upper(squeeze(part(4))), F.lit("")))
        return F.struct(day.alias("date"), time.alias("time"))

    read_ones = F.filter(F.transform(F.array_sort(here), read), lambda d: d["date"].isNotNull())
    days = F.array_sort(F.array_distinct(F.transform(read_ones, lambda d: d["date"])))
    return F.transform(days, lambda day: F.struct(day.alias("date"), F.get(F.filter(read_ones, lambda d: d["date"] == day), F.lit(0))["time"].alias("time")))


def rows_of(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, start, guid, number, title, office, dates, funding) of every row of the pages."""
    found = spans(pages, key, marked(F.col(html)), _PATTERNS)
    placed = found.withColumn("row", last_before(key, "number"))
    placed = placed.withColumn("title", F.when(F.col("kind") == "number", first_after(key, "title")))
    placed = placed.withColumn("type", F.when(F.col("kind") == "number", first_after(key, "type"))).where("row is not null")
    dates = F.collect_list(F.when(F.col("kind") == "date", F.struct("start", "end", "found")))
    titles = F.count_if(F.col("kind") == "title")
    # one shuffle more than the windows' is spared: they are partitioned by the key alone
    met = placed.groupBy(key, "row").agg(
        F.first(F.when(F.col("kind") == "number", F.col("found")), ignorenulls=True).alias("number"),
        F.first("title", ignorenulls=True).alias("title"),
        F.first("type", ignorenulls=True).alias("type"),
        dates.alias("dates"),
        titles.alias("titles"),
    )
    # a row without a link of its own would find the next one's
    title = F.when(F.col("titles") > 0, squeeze(F.translate("title.found", _LINK, "")))
    funding = (F.col("titles") > 0) & (F.col("type.start") == F.col("title.end") - 1)
    window, after = F.col("type.found"), F.col("type.end")
    read = _dates(F.col("dates"), after, window)
    first = F.regexp_extract(window, rf"(?is)^(?:\s*\(NOFO\))?(.*?)(?:{DATE}|$)", 1)
    office = F.nullif(F.regexp_replace(first, r"^[\s\-–|]+|[\s\-–|]+$", ""), F.lit(""))
    parts = F.split(F.translate("number", _ROW, ""), " ")
    kept = F.coalesce(funding, F.lit(False)) & (F.coalesce(title, F.lit("")) != "")
    return met.select(key, F.col("row").alias("start"), parts[0].alias("guid"), F.upper(parts[1]).alias("number"), F.nullif(title, F.lit("")).alias("title"), F.when(kept, office).alias("office"), F.when(kept, read).alias("dates"), kept.alias("funding"))


def opportunities(rows: DataFrame, key: str, as_of: Column, agency: str) -> DataFrame:
    """Funding rows as records: the next open date is the deadline (the last one, if all are past); later ones are additional."""
    future = F.filter("dates", lambda d: d["date"] >= as_of)
    primary = F.coalesce(F.get(future, F.lit(0))["date"], F.element_at(F.when(F.size("dates") > 0, F.col("dates")), F.lit(-1))["date"])
    later = F.transform(F.slice(future, 2, F.greatest(F.size(future), F.lit(1))), lambda d: F.struct(F.lit("application").alias("kind"), d["date"].alias("date"), d["time"].alias("time"), F.when(d["time"].isNotNull(), "ET").alias("timezone")))
    note = F.when(F.size(future) > 1, F.concat(F.lit("Next of "), F.size(future).cast("string"), F.lit(" open submission dates; later dates are in the details.")))
    out = rows.where("funding")
    return out.select(key, F.col("number").alias("external_id"), "title", F.coalesce("office", F.lit(agency)).alias("agency"), F.concat(F.lit("#FoaId"), F.col("guid")).alias("anchor"), primary.alias("close_date"), note.alias("deadline_note"), later.alias("additional_deadlines"))


def health(pages: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, n_funding, error) of each page: too few rows, or none of a type that is known."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("funding").alias("n_funding"))
    met = pages.select(key).join(counts, key, "left").na.fill(0, ["n_rows", "n_funding"])
    error = F.when(F.col("n_rows") < LEAST_ROWS, "no plausible structure of rows").when(F.col("n_funding") == 0, "rows but no known funding type")
    return met.withColumn("error", error)
