"""Detail answers of an API to records: nested JSON read as VARIANT, attachments ranked, signals found in texts.

Everything but the decoding of character references is one projection of
expressions, so a table of answers needs no shuffle before its join with the
records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import document_date, iso_date, slash_date, text_date
from tabulon.functions.money import positive_whole
from tabulon.functions.text import clean_text, safe_http_url, squeeze, unescape
from tabulon.operators.codes import first_match, preliminary_kind
from tabulon.sources.exports import at, kind_of, strict_json

#: Addresses of the API's pages, and limits of lists.
RECORD_PAGE = "https://www.grants.gov/search-results-detail/"
DOWNLOAD = "https://grants.gov/grantsws/rest/opportunity/att/download/"
HOME = "https://www.grants.gov/"
MOST_URLS = 12
#: Patterns of the API's texts and of attachment names.
STAGE = r"(?i)(concept\s+paper|pre[\s-]?proposal|pre[\s-]?application|preliminary\s+proposal|letter\s+of\s+intent|white\s+paper)"
STAGE_DATE = r"(?i)(concept\s+paper|pre[\s-]?proposal|pre[\s-]?application|preliminary\s+proposal|letter\s+of\s+intent|LOI|white\s+paper)[^.\n]{0,200}?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})"
REQUIRED = r"(?i)\b(is\s+required|are\s+required|mandatory|must\s+submit)\b"
LIMITED = r"(?i)((?:only\s+)?(?:one|two|three|1|2|3)\s+(?:application|proposal|submission)s?[^.\n]{0,120}?per\s+(?:institution|organization|applicant|university)|limit(?:ed|s)?\s+(?:to\s+)?(?:one|two|three|1|2|3)\s+(?:application|proposal|submission)[^.\n]{0,120})"
SHARE = r"(?i)(cost\s+shar\w+|matching\s+funds?|non[\s-]?federal\s+share)[^.\n]{0,180}?(\d{1,3}\s?(?:%|percent))"
CLOCK = r"(?i)(\d{1,2}:\d{2}(?::\d{2})?\s*(?:[APap]\.?[Mm]\.?)?)[\s,]*(?:(?:submitter|applicant|proposer|your|organization)'?s?\s+){0,2}((?:Eastern|Central|Mountain|Pacific|ET|CT|MT|PT|EST|EDT|CST|CDT|MST|MDT|PST|PDT|local)\s*(?:[Tt]ime|[Dd]aylight|[Ss]tandard)?(?:\s*[Tt]ime)?)"
CAREER = r"(?i)(early[\s-]?career|no\s+more\s+than\s+(\w+)\s+years?[^.\n]{0,60}(?:doctora|PhD|Ph\.D)|within\s+(\w+)\s+years?\s+of[^.\n]{0,40}(?:doctora|PhD|Ph\.D)|untenured|new\s+investigator|tenure[\s-]track\s+assistant)"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
ROLLING = r"(?i)\brolling\b|open\s+until\s+superseded"
LOOKS_LIKE_NOTICE = r"\b(nofo|foa|rfa|baa)\b|funding opportunity announcement|full announcement|solicitation|full text"
LOOKS_SUPPLEMENTAL = "faq|frequently asked|appendix|addendum|sample|template|webinar|questions|special notice|topics"
NOTICE = r"(?i)\b(nofo|foa|rfa|baa|funding opportunity announcement|full announcement|full solicitation|solicitation)\b"
SUPPLEMENTAL = r"(?i)\b(faq|frequently asked|appendix|addendum|sample|template|webinar|questions?|special notice|topic list|budget worksheet|cover sheet|instructions? for (?:applicants?|submission))\b"
REVISED = r"(?i)\b(revised|updated|final|amended)\s+(?:nofo|foa|rfa|baa|funding opportunity announcement|solicitation)\b"
DRAFT = r"(?i)\bdraft\b"
FULL_FOLDER = r"(?i)\b(full announcement|full solicitation|current nofo|current foa)\b"

ATTACHMENT = ("id", "file_name", "description", "mime_type", "size_bytes", "created_date", "folder_type", "folder_name", "download_url")


def filled(value: Column) -> Column:
    """Null for ''."""
    return F.nullif(value, F.lit(""))


def api_date(text: Column) -> Column:
    """Date of ``Sep 30, 2026 12:00:00 AM EDT``, of an ISO form, or of M/D/YYYY at the start."""
    words = F.regexp_extract(text, r"^\s*([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}, \d{4})", 1)
    day = F.concat_ws(" ", words, F.regexp_extract(text, r"^\s*[A-Z][a-z]+\.? (\d{1,2}, \d{4})", 1))
    return F.coalesce(iso_date(text), F.when(words != "", F.try_to_date(day, "MMM d, yyyy")), slash_date(F.regexp_extract(text, r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1)))


def attachments(detail: Column) -> Column:
    """array<struct> of all attachments of a detail (VARIANT): notices that are PDF first, supplements and amendments behind, then by name."""
    folders = F.coalesce(at(detail, "$.synopsisAttachmentFolders", "array<variant>"), F.array().cast("array<variant>"))

    def in_folder(folder: Column) -> Column:
        own = F.coalesce(at(folder, "$.synopsisAttachments", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(own, lambda a: attachment(a, folder))

    def attachment(a: Column, folder: Column) -> Column:
        number = F.nullif(filled(at(a, "$.id")), F.lit("0"))
        values = [at(a, "$.id"), F.coalesce(at(a, "$.fileName"), F.lit("")), *[at(a, f"$.{n}") for n in ("fileDescription", "mimeType", "fileLobSize", "createdDate")], at(folder, "$.folderType"), at(folder, "$.folderName"), F.concat(F.lit(DOWNLOAD), number)]
        return F.struct(*[v.alias(n) for n, v in zip(ATTACHMENT, values)])

    def ranked(a: Column, i: Column) -> Column:
        name = F.lower(a["file_name"])
        text = F.concat(name, F.lit(" "), F.lower(F.coalesce(a["description"], F.lit(""))))
        order = [~is_pdf(a), ~text.rlike(LOOKS_LIKE_NOTICE), text.rlike(LOOKS_SUPPLEMENTAL), F.contains(text, F.lit("amendment")), name, i, a]
        return F.struct(*[c.alias(f"c{n}") for n, c in enumerate(order)])

    every = F.flatten(F.transform(folders, in_folder))
    return F.transform(F.array_sort(F.transform(every, ranked)), lambda r: r["c6"])


def is_pdf(attachment: Column) -> Column:
    return F.lower(F.coalesce(attachment["file_name"], F.lit(""))).endswith(".pdf") | F.coalesce(attachment["mime_type"] == "application/pdf", F.lit(False))


def searchable(*texts: Column) -> Column:
    """Texts in one, with separators of file names as blanks."""
    return F.regexp_replace(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]), r"[_/\\-]+", " ")


def scored(found: Column) -> Column:
    """``attachments`` with what tells a notice: array<struct<named, foldered, score, draft, url, name>>."""

    def one(a: Column, i: Column) -> Column:
        content, folder = searchable(a["file_name"], a["description"]), searchable(a["folder_name"], a["folder_type"])
        usable = is_pdf(a) & ~F.concat_ws(" ", content, folder).rlike(SUPPLEMENTAL)
        full, draft = folder.rlike(FULL_FOLDER), content.rlike(DRAFT)
        day = F.coalesce(api_date(a["created_date"]).cast("string"), F.lit(""))
        score = F.struct(content.rlike(REVISED).cast("int").alias("a"), (~draft).cast("int").alias("b"), full.cast("int").alias("c"), day.alias("d"), (-i).alias("e"))
        return F.struct((usable & content.rlike(NOTICE)).alias("named"), (usable & ~content.rlike(NOTICE) & full).alias("foldered"), score.alias("score"), draft.alias("draft"), a["download_url"].alias("url"), a["file_name"].alias("name"))

    return F.transform(found, one)


def primary_document(each: Column, urls: Column) -> Column:
    """struct<url, name, source, confidence> of the one document of ``scored`` ones that is surely the notice, or null.

    Names that say so come first: revised, no draft, in the folder of full
    announcements, the newest. A single PDF in that folder, or among the
    record's addresses, is of medium confidence.
    """

    named = F.filter(each, lambda x: x["named"])
    top = F.array_max(F.transform(named, lambda x: F.struct(x["score"].alias("score"), x["draft"].alias("draft"), x["url"].alias("url"), x["name"].alias("name"))))
    foldered = F.filter(each, lambda x: x["foldered"])
    pdfs = F.filter(urls, lambda u: u.rlike(r"(?i)\.pdf(?:[?#]|$)"))

    def document(url: Column, name: Column, source: str, confidence: Column) -> Column:
        return F.struct(url.alias("url"), name.alias("name"), F.lit(source).alias("source"), confidence.alias("confidence"))

    attached, medium = "Grants.gov attachment", F.lit("medium")
    only = F.get(foldered, F.lit(0))
    return (
        F.when(F.size(named) > 0, document(safe_http_url(top["url"]), squeeze(top["name"]), attached, F.when(top["draft"], "medium").otherwise("high")))
        .when(F.size(foldered) == 1, document(safe_http_url(only["url"]), squeeze(only["name"]), attached, medium))
        .when(F.size(pdfs) == 1, document(F.get(pdfs, F.lit(0)), F.lit(None).cast("string"), "Grants.gov document URL", medium))
    )


def _size(value: Column) -> Column:
    return F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")), F.lit(0))


def compact(rows: DataFrame, key: str, detail: str, title: str, record_close: str) -> DataFrame:
    """Details (JSON texts) as entries: key, api_*, deadline, preliminary_deadline, award, addresses, primary_document, contacts, history, and flags.

    ``title`` and ``record_close`` are the record's own, used where the answer has none.
    """
    v = rows.select(key, F.col(title).alias("_title"), F.col(record_close).cast("string").alias("_close"), strict_json(F.col(detail)).alias("_d"))
    d = F.col("_d")
    has = kind_of(at(d, "$.synopsis", "variant")) == "OBJECT"
    own = F.when(F.coalesce(has & (F.size(F.try_variant_get(d, "$.synopsis", "map<string,variant>")) > 0), F.lit(False)), at(d, "$.synopsis", "variant")).otherwise(at(d, "$.forecast", "variant"))
    v = v.withColumn("_s", own)
    s = F.col("_s")

    def first(*names: str) -> Column:
        return F.coalesce(*[filled(at(s, f"$.{n}")) for n in names], F.lit(None).cast("string"))

    note = F.coalesce(first("responseDateDesc", "estApplicationResponseDateDesc", "responseDateNote"), F.lit(""))
    parts = [first("synopsisDesc", "forecastDesc"), first("applicantEligibilityDesc"), filled(note), first("agencyContactDesc"), first("fundingDescLinkDesc"), filled(F.col("_title"))]
    email_text = F.concat_ws(" ", F.coalesce(at(s, "$.agencyContactEmail"), F.lit("")), F.coalesce(at(s, "$.agencyContactDesc"), F.lit("")))
    # behind an explode, so that what is read often below is made once
    made = F.struct(note.alias("note"), F.concat_ws(" \n ", *parts).alias("text"), email_text.alias("mail"), attachments(d).alias("files"))
    v = v.select(key, "_close", "_d", "_s", F.explode(F.array(made)).alias("_m"))
    v = v.select(key, "_close", "_d", "_s", F.col("_m.note").alias("_note"), F.col("_m.text").alias("_text"), unescape("_m.mail").alias("_mail"), F.col("_m.files").alias("_files"), F.explode(F.array(scored(F.col("_m.files")))).alias("_scored"))
    text, note = F.col("_text"), F.col("_note")
    clocked = F.when(note.rlike(CLOCK), note).otherwise(text)
    raw_urls = F.coalesce(at(d, "$.synopsisDocumentURLs", "array<variant>"), F.array().cast("array<variant>"))
    urls = F.filter(F.transform(raw_urls, lambda u: safe_http_url(F.when(kind_of(u) == "OBJECT", at(u, "$.url")).otherwise(at(u, "$")))), lambda u: u.isNotNull())
    stage, dated = first_match(STAGE, text), first_match(STAGE_DATE, text)
    mail = F.nullif(F.regexp_replace(F.regexp_extract("_mail", EMAIL, 0), r"^[.,;:]+|[.,;:]+$", ""), F.lit(""))
    name, phone = first("agencyContactName"), first("agencyContactPhone")
    page = F.coalesce(F.concat(F.lit(RECORD_PAGE), F.nullif(filled(at(d, "$.id")), F.lit("0"))), F.lit(HOME))
    v = v.select(
        key,
        at(d, "$.revision", "long").alias("api_revision"),
        filled(at(s, "$.version")).alias("api_version"),
        api_date(at(s, "$.lastUpdatedDate")).alias("api_last_updated"),
        api_date(F.coalesce(first("responseDate", "estApplicationResponseDate"), F.col("_close"))).alias("_date"),
        filled(note).alias("_note"),
        first_match(CLOCK, clocked, 1).alias("_time"),
        first_match(CLOCK, clocked, 2).alias("_zone"),
        stage.alias("_stage"),
        F.when(stage.isNotNull(), dated).alias("_dated"),
        text.rlike(REQUIRED).alias("_required"),
        *[positive_whole(at(s, f"$.{n}")).alias(a) for n, a in (("awardFloor", "_floor"), ("awardCeiling", "_ceiling"), ("estimatedFunding", "_total"), ("numberOfAwards", "_awards"))],
        safe_http_url(first("fundingDescLinkUrl")).alias("funding_opportunity_url"),
        F.explode(F.array(urls)).alias("_urls"),
        "_files", "_scored",
        name.alias("_name"), mail.alias("_mail"), phone.alias("_phone"), page.alias("_page"),
        first_match(LIMITED, text).alias("limited_submission_criteria"),
        first_match(SHARE, text).alias("cost_share_detail"),
        first_match(CAREER, text).alias("career_stage_signal"),
        note.rlike(ROLLING).alias("rolling"),
        F.struct(
            F.coalesce(at(d, "$.synopsisHistCount", "long"), F.lit(0)).alias("synopsis_count"),
            F.coalesce(at(d, "$.forecastHistCount", "long"), F.lit(0)).alias("forecast_count"),
            F.when(_size(at(d, "$.synopsisModifiedFields", "variant")) > 0, _size(at(d, "$.synopsisModifiedFields", "variant"))).otherwise(_size(at(d, "$.forecastModifiedFields", "variant"))).cast("long").alias("modified_field_count"),
            _size(at(d, "$.synAttChangeComments", "variant")).cast("long").alias("change_comment_count"),
        ).alias("history"),
    )
    early = F.struct(
        preliminary_kind(F.coalesce("_dated", "_stage")).alias("kind"), F.coalesce(text_date("_dated"), document_date(F.regexp_extract("_dated", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", 0))).alias("date"),
        F.col("_dated").alias("text"), F.col("_required").alias("required"), F.lit("machine_extracted_needs_verification").alias("confidence"),
    )
    contact = F.struct(squeeze("_name").alias("name"), F.col("_mail").alias("email"), squeeze("_phone").alias("phone"), F.lit("Agency contact").alias("role"), F.col("_page").alias("source_url"))
    someone = F.coalesce("_name", "_mail", "_phone").isNotNull()
    return v.select(
        key, "api_revision", "api_version", "api_last_updated",
        F.struct(F.col("_date").alias("date"), clean_text("_note").alias("note"), F.col("_time").alias("time"), F.col("_zone").alias("timezone")).alias("deadline"),
        F.when(F.col("_stage").isNotNull(), early).alias("preliminary_deadline"),
        F.struct(F.col("_floor").alias("floor"), F.col("_ceiling").alias("ceiling"), F.col("_total").alias("program_total"), F.col("_awards").alias("expected_awards")).alias("award"),
        "funding_opportunity_url", primary_document(F.col("_scored"), F.col("_urls")).alias("primary_document"), F.slice("_urls", 1, MOST_URLS).alias("document_urls"), F.size("_files").alias("attachment_count"), F.col("_files").alias("attachments"),
        F.when(someone, F.array(contact)).otherwise(F.array().cast("array<struct<name:string,email:string,phone:string,role:string,source_url:string>>")).alias("contacts"),
        F.col("limited_submission_criteria").isNotNull().alias("limited_submission"), "limited_submission_criteria", "cost_share_detail", "career_stage_signal", "rolling", "history",
    )
