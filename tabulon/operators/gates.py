"""Currentness gates: which records count as open on a day, each with its reason.

All gates are single expressions, so they are pushed into any scan or join
that they stand on. ``as_of`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import iso_date, strict_iso_date

#: Statuses that end a record, and titles and sentences that mark notices without funding.
CLOSED = ("closed", "archived", "cancelled", "canceled", "withdrawn", "expired")
OPEN = ("posted", "forecasted")
NOTICE_TITLE = r"(?i)^(?:[A-Z0-9-]+\s+)?(?:notice\s+of\s+intent(?:\s+to\s+issue)?\b|request\s+for\s+information\b|RFI\s*[-:])"
NOT_ACCEPTING = r"(?i)\b(?:not|isn't|is\s+not)\s+accepting\s+applications?\b|\bno\s+applications?\s+(?:are|will\s+be)\s+accepted\b"
ROLLING = r"(?i)\brolling\b|\bopen\s+until\s+filled\b|\bcontinuous(?:ly)?\s+(?:open|accepted)\b"
#: Fixed values of the pages' own gate, which also looks at the deadline note and takes strict dates only.
PAGE_TITLE = r"(?i)^(?:[A-Z0-9_.-]+\s+)?(?:notice of intent\b|request for information\b|rfi\s*[-:])"
PAGE_NOT_ACCEPTING = r"(?i)\bnot accepting applications?\b"
STALE_DAYS = 548
FAR_DAYS = 366 * 6


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def non_funding_reason(title: str = "title", description: str = "description", instruments: str = "funding_instruments") -> Column:
    """informational_notice, not_accepting_applications or null."""
    kinds = F.transform(F.coalesce(F.col(instruments), F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    only_other = (F.size(kinds) > 0) & F.forall(kinds, lambda v: v.isin("o", "other"))
    closed = only_other & F.substring(_text(description), 1, 2500).rlike(NOT_ACCEPTING)
    return F.when(F.trim(_text(title)).rlike(NOTICE_TITLE), "informational_notice").when(closed, "not_accepting_applications")


def runtime_reason(as_of: Column, status: str = "status", close: str = "close_date", archive: str = "archive_date", rolling: str = "rolling", **names: str) -> Column:
    """Reason of the runtime gate; ``reason_is_current`` tells the passing ones."""
    state, notice = F.lower(_text(status)), non_funding_reason(**names)
    closes, archives = iso_date(close), iso_date(archive)
    return (
        F.when(state.isin(*CLOSED), state)
        .when(~state.isin(*OPEN), "invalid_status")
        .when(notice.isNotNull(), notice)
        .when((_text(close) != "") & closes.isNull(), "invalid_close_date")
        .when(closes < as_of, "expired")
        .when(closes.isNotNull(), "current_by_close_date")
        .when((_text(archive) != "") & archives.isNull(), "invalid_archive_date")
        .when(archives < as_of, "archived")
        .when(F.coalesce(F.col(rolling), F.lit(False)), "rolling")
        .otherwise("undated_verify_status")
    )


def reason_is_current(reason: Column) -> Column:
    return reason.isin("current_by_close_date", "rolling", "undated_verify_status")


def split_current(records: DataFrame, as_of: Column, **names: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded), both with ``currentness_reason``."""
    marked = records.withColumn("currentness_reason", runtime_reason(as_of, **names))
    good = reason_is_current(F.col("currentness_reason"))
    return marked.where(good), marked.where(~good)


def ingest_is_current(as_of: Column, fiscal_year: str = "fiscal_year", award: str = "estimated_award_date", start: str = "estimated_project_start", updated: str = "last_updated", **names: str) -> Column:
    """Gate at ingest: as the runtime gate, and undated forecasts must not be from a past year, past their milestones or stale."""
    closes, archives = F.col(names.get("close", "close_date")), F.col(names.get("archive", "archive_date"))
    notice = non_funding_reason(**{k: v for k, v in names.items() if k in ("title", "description", "instruments")})
    year = F.when(F.col(fiscal_year).cast("string").rlike(r"^\d+$"), F.col(fiscal_year).try_cast("int"))
    old = (year < F.year(as_of)) | (F.greatest(award, start) < as_of) | (F.datediff(as_of, F.col(updated)) > STALE_DAYS)
    forecast = F.lower(_text(names.get("status", "status"))) == "forecasted"
    dated = F.when(closes.isNotNull(), closes >= as_of).when(archives.isNotNull(), archives >= as_of)
    return F.when(notice.isNotNull(), False).when(dated.isNotNull(), dated).when(forecast, ~F.coalesce(old, F.lit(False))).otherwise(True)


def page_reason(title: str = "title", description: str = "description", note: str = "close_date_note", instruments: str = "funding_instruments") -> Column:
    """Why a page shows no record of its own: ``informational notice``, ``not accepting applications`` or ''."""
    kinds = F.transform(F.coalesce(F.col(instruments), F.array().cast("array<string>")), lambda v: F.lower(v))
    only_other = (F.size(kinds) > 0) & F.forall(kinds, lambda v: F.coalesce(v == "other", F.lit(False)))
    said = F.concat(_text(description), F.lit(" "), _text(note)).rlike(PAGE_NOT_ACCEPTING)
    return F.when(F.trim(_text(title)).rlike(PAGE_TITLE), "informational notice").when(only_other & said, "not accepting applications").otherwise("")


def page_is_current(as_of: Column, status: str = "status", close: str = "close_date", archive: str = "archive_date", **names: str) -> Column:
    """The pages' gate on texts: open statuses only; a close date has to be YYYY-MM-DD and not over, else the archive date decides."""
    state, day = F.lower(_text(status)), as_of.cast("string")
    closes, archives = F.nullif(_text(close), F.lit("")), F.nullif(_text(archive), F.lit(""))
    dated = F.when(closes.isNotNull(), closes.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (closes >= day)).when(archives < day, False).otherwise(True)
    return state.isin(*OPEN) & (page_reason(**names) == "") & dated


def publish_reason(as_of: Column, title: str = "title", urls: tuple[str, ...] = ("detail_page", "funding_opportunity_url", "primary_document_url"), close: str = "close_date", posted: str = "posted_date") -> Column:
    """Why an external record may not be published; null if it may. Any one of ``urls`` is enough."""
    closes, some = strict_iso_date(close), F.coalesce(*[F.nullif(F.col(u).cast("string"), F.lit("")) for u in urls])
    return (
        F.when(_text(title) == "", "missing_title")
        .when(some.isNull(), "missing_official_url")
        .when((_text(close) != "") & closes.isNull(), "unparseable_close_date")
        .when(closes < as_of, "expired")
        .when(F.datediff(closes, as_of) > FAR_DAYS, "implausible_future_date")
        .when((_text(posted) != "") & strict_iso_date(posted).isNull(), "unparseable_posted_date")
    )


def within_bounds(n: Column, low: Column, high: Column) -> Column:
    """Whether a count lies within bounds; a null bound is none."""
    return F.coalesce(n >= low, F.lit(True)) & F.coalesce(n <= high, F.lit(True))
