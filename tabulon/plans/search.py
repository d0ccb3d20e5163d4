"""Ranked search over records: score, gate, filter, boost, sort, page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.functions.dates import age_days
from tabulon.operators.facets import passes_filters
from tabulon.operators.gates import reason_is_current, runtime_reason
from tabulon.plans.index import Index, bm25
from tabulon.session import written

TITLE_BOOST, NUMBER_BOOST, PHRASE_CHARS = 12.0, 30.0, 4
FRESH_DAYS, FRESH_SHARE, FRESH_LEAST, FRESH_PART = 14, 0.2, 8.0, 0.15
SORTS = ("relevance", "deadline", "posted", "award", "agency", "title")


@dataclass(frozen=True)
class Request:
    """What a search asks for."""

    query: str = ""
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    sort: str = "relevance"
    page: int = 1
    page_size: int = 20
    close_from: str | None = None
    close_to: str | None = None
    least_award: int | None = None


def phrase_boost(query: str, title: str = "title", number: str = "opportunity_number") -> Column:
    """Added where the title has the whole query, or the number is the query."""
    phrase = query.strip().lower()
    if len(phrase) < PHRASE_CHARS:
        return F.lit(0.0)
    in_title = F.contains(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(phrase))
    same = F.lower(F.coalesce(F.col(number).cast("string"), F.lit(""))) == phrase
    return F.when(in_title, TITLE_BOOST).otherwise(0.0) + F.when(same, NUMBER_BOOST).otherwise(0.0)


def freshness_boost(score: Column, peak: Column, age: Column) -> Column:
    """Lifts recent records above the peak if they reach a fifth of it by themselves."""
    lifted = peak + F.greatest(F.lit(FRESH_LEAST), peak * FRESH_PART * (1 - age / (FRESH_DAYS + 1)))
    return F.when((score > 0) & (peak > 0) & (score >= peak * FRESH_SHARE) & (age <= FRESH_DAYS), lifted).otherwise(0.0)


def range_filters(request: Request) -> Column:
    """Deadline range and least award (the higher of ceiling and floor)."""
    ok = F.lit(True)
    if request.close_from:
        ok = ok & (F.col("close_date") >= request.close_from)
    if request.close_to:
        ok = ok & (F.col("close_date") <= request.close_to)
    if request.least_award is not None:
        ok = ok & (F.greatest("award_ceiling", "award_floor") >= request.least_award)
    return F.coalesce(ok, F.lit(False))


def order(sort: str) -> list[Column]:
    """Sort columns; missing values come last whatever the direction, the id decides ties."""
    by = {
        "relevance": [F.desc(F.round("score", 6)), F.col("close_date").asc_nulls_last()],
        "deadline": [F.col("close_date").asc_nulls_last()],
        "posted": [F.col("posted_date").desc_nulls_last()],
        "award": [F.greatest("award_ceiling", "award_floor").desc_nulls_last()],
        "agency": [F.nullif(F.lower("agency"), F.lit("")).asc_nulls_last()],
        "title": [F.nullif(F.lower("title"), F.lit("")).asc_nulls_last()],
    }
    if sort not in by:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    return [*by[sort], F.col("opportunity_id")]


def search(records: DataFrame, index: Index | None, request: Request, as_of: Column) -> DataFrame:
    """All matching records with ``score``, before sorting.

    Scores use the statistics of all records; the gate and the filters come
    afterwards, and the peak for the freshness boost is that of what they leave.
    A request without a text needs no index.
    """
    text = request.query.strip()
    rows = records.where(reason_is_current(runtime_reason(as_of))).where(passes_filters(records, request.filters)).where(range_filters(request))
    if not text:
        return rows.withColumn("score", F.lit(0.0))
    queries = records.sparkSession.createDataFrame([(0, text)], "query_id int, text string")
    scores = bm25(index, queries).select(F.col("doc_id").alias("_doc"), F.col("score").alias("_bm25"))
    rows = rows.join(scores, F.col("opportunity_id") == F.col("_doc"), "left")
    rows = rows.withColumn("score", F.coalesce("_bm25", F.lit(0.0)) + phrase_boost(text)).drop("_doc", "_bm25").where("score > 0")
    peak = rows.agg(F.max("score").alias("_peak"))
    age = age_days(as_of, F.col("posted_date"), F.col("source_first_seen_date"))
    rows = rows.join(F.broadcast(peak))
    return rows.withColumn("score", F.col("score") + freshness_boost(F.col("score"), F.col("_peak"), age)).drop("_peak")


def ranked(found: DataFrame, limit: int | None = None) -> DataFrame:
    """The plain ranking: score, recency, title, id."""
    recency = F.coalesce("posted_date", "last_updated")
    out = found.orderBy(F.desc(F.round("score", 6)), recency.desc_nulls_last(), F.coalesce("title", F.lit("")), "opportunity_id")
    return out.limit(limit) if limit else out


def page(found: DataFrame, request: Request) -> DataFrame:
    """The rows of one page."""
    return found.orderBy(*order(request.sort)).offset((request.page - 1) * request.page_size).limit(request.page_size)


def numbered(found: DataFrame, by: list[Column], name: str) -> DataFrame:
    """Adds the place of every row in an order, from 1: places in sorted ranges, plus the sizes of the ranges before."""
    placed = found.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # one row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", "_first", before.alias("_before"))
    return placed.join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")).drop("_range", "_at", "_first", "_before")


def containing(docs: DataFrame, passages: DataFrame, key: str, text: str = "text", passage: str = "passage") -> DataFrame:
    """Pairs of a document (``key`` is unique) and a passage that stands in it.

    They meet on the longest word inside the passage (its first and last words
    may be parts of words in a document): keys and words only, and the texts of
    those that met are then fetched and compared. Passages of fewer than three
    words have no such word and are looked for in every document.
    """
    words = F.split(F.col(passage), r"\s+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = written(passages.withColumn("_anchor", longest), "passages")
    spread = docs.select(key, F.explode(F.array_distinct(F.split(F.col(text), r"\s+"))).alias("_word"))
    held = F.contains(F.col(text), F.col(passage))
    hits = spread.join(keyed.where("_anchor is not null"), F.col("_word") == F.col("_anchor")).drop("_word", "_anchor")
    met = hits.join(docs, key).where(held).select(*docs.columns, *passages.columns)
    few = keyed.where("_anchor is null").drop("_anchor")
    return met.unionByName(docs.join(few, held).select(*met.columns)) if few.limit(1).count() else met


def page_numbers(current: int, total: int) -> list[int | None]:
    """Page buttons: the ends, the current page and its neighbours; None for a gap."""
    shown = sorted({1, total, *(p for p in range(current - 1, current + 2) if 1 <= p <= total)}) if total else []
    out: list[int | None] = []
    for p in shown:
        if out and p - out[-1] > 1:
            out.append(None)
        out.append(p)
    return out


def compare(records: DataFrame, ids: Sequence[str], fields: Sequence[str], most: int = 4) -> DataFrame:
    """At most four records side by side: a row a field, a column a record."""
    chosen = list(dict.fromkeys(ids))[:most]
    some = records.where(F.col("opportunity_id").isin(chosen)).select("opportunity_id", *[F.col(f).cast("string").alias(f) for f in fields])
    long = some.unpivot(["opportunity_id"], list(fields), "field", "value")
    return long.groupBy("field").pivot("opportunity_id", chosen).agg(F.first("value"))


def fit_bonus(kinds: Column, wanted: str) -> Column:
    """Applicant fit: listed, unrestricted, not listed, or unknown."""
    return F.when(F.size(kinds) == 0, 0.0).when(F.array_contains(kinds, wanted), 2.4).when(F.exists(kinds, lambda k: F.lower(k).startswith("unrestricted")), 0.8).otherwise(-0.8)


def personal_score(direct: Column, profile: Column, bonus: Column, preference: Column) -> Column:
    """Score of a personal ranking: direct hits count double, likes scale it."""
    base = 2 * direct + profile + bonus
    return F.when(base == 0, preference).otherwise(base * (1 + preference))
