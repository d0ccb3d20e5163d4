"""What pages show of a record, as expressions: its address, main deadline and contact, audience, fit and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import blank_to_null, safe_http_url, truncate

# Where a record may be read, in order of preference, and words of titles that tell whom it is for.
URL_FIELDS = ("detail_page", "funding_opportunity_url", "url", "primary_document_url")
AUDIENCES = {
    "undergrad": r"\breu\b|research experiences for undergraduates|goldwater|\bundergraduate\b",
    "postdoc": r"post-?doctoral|\bpostdoc\b",
    "grad": r"graduate research fellowship|\bgrfp\b|pre-?doctoral|dissertation|doctoral fellowship|graduate fellowship|graduate student research|\bndseg\b|\bscgsr\b",
}
TRAINEE = r"\b(?:trainee|postdoc|postdoctoral|fellowship|graduate student)\b"
NOTICE_PAGE = "Official NSF funding page"


def _present(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def best_url(columns: list[str], home: str) -> Column:
    """The first address that the record has of URL_FIELDS, else ``home``."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in URL_FIELDS if c in columns], F.lit(home))


def audience(title: Column | str = "title") -> Column:
    """undergrad, postdoc, grad or faculty, by the title alone; the first that fits."""
    low = F.lower(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), name) for name, p in AUDIENCES.items()], F.lit("faculty"))


def career_fit(stage: Column, signal: Column, title: Column, description: Column) -> Column:
    """Bonus of a career stage: 2.6 for early careers where the record says so, 2.2 for trainees where its text does."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.when((stage == "early_career") & F.coalesce(signal, F.lit(False)), 2.6).when((stage == "trainee") & text.rlike(TRAINEE), 2.2).otherwise(0.0)


def primary_deadline(deadlines: Column, status: Column, close_date: Column, time: Column, zone: Column) -> Column:
    """struct<kind, date, time, zone>: the first application deadline, else the first of any kind, else the close date.

    ``deadlines``: array of structs kind, date, time, zone; null is empty.
    """
    due = F.filter(deadlines, lambda d: d["kind"].isin("application", "estimated_application"))
    own = F.struct(F.when(status == "forecasted", "estimated_application").otherwise("application").alias("kind"), close_date.cast("string").alias("date"), time.cast("string").alias("time"), zone.cast("string").alias("zone"))
    first = F.coalesce(F.get(due, F.lit(0)), F.get(deadlines, F.lit(0)))
    return F.when(first.isNotNull(), F.struct(*[first[k].cast("string").alias(k) for k in ("kind", "date", "time", "zone")])).otherwise(own)


def safe_email(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.trim(c))


def primary_contact(contacts: Column, name: Column, email: Column, phone: Column) -> Column:
    """struct<name, email, phone, role>: the first contact with an address, else with a name or phone; gaps filled from the record.

    ``contacts``: array of structs name, email, phone, role; null is empty.
    """
    reachable = F.filter(contacts, lambda c: safe_email(c["email"]).isNotNull())
    named = F.filter(contacts, lambda c: _present(c["name"]) | _present(c["phone"]))
    one = F.coalesce(F.get(reachable, F.lit(0)), F.get(named, F.lit(0)))

    def either(own: Column, other: Column) -> Column:
        return F.coalesce(F.nullif(own, F.lit("")), other, F.lit(""))

    address = F.coalesce(safe_email(F.coalesce(F.nullif(one["email"], F.lit("")), email)), F.lit(""))
    return F.struct(either(one["name"], name).alias("name"), address.alias("email"), either(one["phone"], phone).alias("phone"), F.coalesce(one["role"], F.lit("")).alias("role"))


def contact_label(contact: Column) -> Column:
    """Name, address or phone, whichever is first known."""
    return F.coalesce(*[blank_to_null(contact[k]) for k in ("name", "email", "phone")], F.lit("Not listed"))


def funding_label(conflicts: Column, source: Column, default: str = "Grants.gov XML extract") -> Column:
    """Where an amount comes from."""
    return F.when(F.coalesce(conflicts, F.lit(False)), "Conflicting Grants.gov amount fields — verify").otherwise(F.coalesce(F.nullif(source, F.lit("")), F.lit(default)))


def enrichment_metrics(records: DataFrame) -> DataFrame:
    """One row of counts of what the enrichment has reached, in one aggregate; columns that are missing count as absent."""

    def one(name: str) -> Column:
        kind = records.schema[name].dataType.typeName()
        c = F.col(name)
        if kind == "array":
            return F.coalesce(F.size(c) > 0, F.lit(False))
        if kind in ("string", "date", "timestamp", "struct"):
            return _present(c) if kind == "string" else c.isNotNull()
        return F.coalesce(c.cast("double") != 0, F.lit(False))

    def has(*names: str) -> Column:
        out = F.lit(False)
        for name in names:
            out = out | one(name) if name in records.columns else out
        return out

    current = F.coalesce(F.col("detail_enrichment_status") == "current", F.lit(False)) if "detail_enrichment_status" in records.columns else F.lit(False)
    synopsis = F.coalesce(F.col("description_source") == NOTICE_PAGE, F.lit(False)) if "description_source" in records.columns else F.lit(False)
    counts = {
        "detail_enriched_count": current,
        "detail_pending_count": ~current,
        "primary_document_count": has("primary_document_url"),
        "agency_notice_count": has("funding_opportunity_url"),
        "agency_synopsis_count": synopsis,
        "one_click_official_source_count": has("primary_document_url", "funding_opportunity_url", "detail_page"),
        "per_award_amount_count": has("award_floor", "award_ceiling"),
        "any_amount_count": has("award_floor", "award_ceiling", "total_program_funding"),
        "deadline_conflict_count": has("deadline_conflict"),
        "award_conflict_count": has("award_conflicts"),
        "preliminary_deadline_count": has("preliminary_deadline"),
        "contact_count": has("contacts"),
        "contact_email_count": F.exists("contacts", lambda c: _present(c["email"])) if "contacts" in records.columns else F.lit(False),
    }
    return records.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def is_degraded(sources: DataFrame, valid: Column, write_asked: Column, was_written: Column) -> DataFrame:
    """One row: whether a run did worse than it should: invalid, not written though asked, or a source not refreshed."""
    stale = F.coalesce(F.max(F.coalesce(F.col("status"), F.lit("")) != "refreshed"), F.lit(False))
    bad = ~F.coalesce(valid, F.lit(False)) | (F.coalesce(write_asked, F.lit(False)) & (F.coalesce(was_written, F.lit(True)) == F.lit(False)))
    return sources.agg(stale.alias("stale")).select((F.col("stale") | bad).alias("degraded"))


def official_actions(record: dict[str, Column]) -> Column:
    """struct<url, links, note>: where a record's own documents are, each address once, and what to make of them.

    ``links`` has kind (foa, agency, grants), label, url and whether it is the
    main one. ``record`` gives source, detail_page, primary_document_url,
    primary_document_confidence and funding_opportunity_url.
    """
    notice, agency, page = (safe_http_url(record[n]) for n in ("primary_document_url", "funding_opportunity_url", "detail_page"))
    source = F.coalesce(F.nullif(record["source"], F.lit("")), F.lit("Grants.gov"))

    def link(kind: str, label: Column, url: Column, main: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), url.alias("url"), F.lit(main).alias("main"))

    main = (
        F.when(notice.isNotNull(), link("foa", F.lit("Open official FOA"), notice, True))
        .when(agency.isNotNull(), link("agency", F.lit("Open agency notice"), agency, True))
        .when(page.isNotNull(), link("grants", F.concat(F.lit("Open "), source, F.lit(" record")), page, True))
    )
    first = F.coalesce(notice, agency, page)
    more_page = F.when(page.isNotNull() & (page != first), link("grants", F.concat(source, F.lit(" record")), page, False))
    more_agency = F.when(agency.isNotNull() & (agency != first) & ~F.coalesce(agency == page, F.lit(False)), link("agency", F.lit("Agency notice"), agency, False))
    links = F.filter(F.array(main, more_page, more_agency), lambda x: x.isNotNull())
    listing = F.when(source == "Grants.gov", "Grants.gov attachment metadata").otherwise(F.concat(source, F.lit(" listing")))
    confidence = F.coalesce(F.nullif(record["primary_document_confidence"], F.lit("")), F.lit("review"))
    note = (
        F.when(notice.isNotNull(), F.concat(F.lit("FOA selected from official "), listing, F.lit(" ("), confidence, F.lit(" confidence). Confirm that it is the current amended notice.")))
        .when(agency.isNotNull(), "No primary FOA attachment was identified automatically; this opens the agency notice.")
        .otherwise(F.concat(F.lit("No primary FOA attachment was identified automatically; use the official "), source, F.lit(" record.")))
    )
    return F.struct(first.alias("url"), links.alias("links"), note.alias("note"))


_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _days(*texts: Column) -> Column:
    return F.filter(F.array(*[F.substring(F.coalesce(t.cast("string"), F.lit("")), 1, 10) for t in texts]), lambda d: d.rlike(_DAY))


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, one).otherwise(many))


def amendment_overview(record: dict[str, Column]) -> Column:
    """struct<changed_on, summary> of a record whose notice or source has changed, else null.

    ``record`` gives document (name, changed_since_previous, last_seen_at),
    previous_name, facts and review_queue (arrays), modified_fields, comments,
    version, and the dates last_updated, api_last_updated, detail_enriched_at
    and posted_date.
    """
    document, facts = record["document"], record["facts"]
    by_notice = F.coalesce(document["changed_since_previous"], F.lit(False))
    fields, comments = F.coalesce(record["modified_fields"], F.lit(0)), F.coalesce(record["comments"], F.lit(0))
    by_source = (fields > 0) | (comments > 0)
    dates = _days(F.when(by_notice, document["last_seen_at"]), F.when(by_source, record["last_updated"]), F.when(by_source, record["api_last_updated"]))
    fallback = F.get(_days(record["detail_enriched_at"], record["posted_date"]), F.lit(0))
    changed_on = F.coalesce(F.array_max(dates), fallback, F.lit(""))
    old, new = truncate(record["previous_name"], 72), truncate(document["name"], 72)
    replaced = (F.coalesce(old, F.lit("")) != "") & (F.coalesce(new, F.lit("")) != "") & (old != new)
    file = F.when(replaced, F.concat(F.lit("Official notice replaced "), old, F.lit(" with "), new, F.lit("."))).otherwise("The official notice file changed.")
    ids = F.coalesce(F.get(F.filter(record["review_queue"], lambda q: q["type"] == "amendment"), F.lit(0))["evidence_ids"], F.array().cast("array<string>"))
    named = F.filter(facts, lambda f: F.array_contains(ids, f["id"]) & (F.coalesce(f["label"], F.lit("")) != ""))
    labels = F.coalesce(F.slice(F.array_distinct(F.transform(named, lambda f: f["label"])), 1, 3), F.array().cast("array<string>"))
    recheck = F.when(F.size(labels) > 0, F.concat(F.lit("Recheck "), F.lower(F.array_join(labels, ", ")), F.lit(" in the revised notice."))).otherwise(
        "No field-level difference was identified automatically; recheck the deadline, funding, eligibility, and application requirements."
    )
    changes = F.concat_ws(" and ", F.when(fields > 0, _plural(fields, " tracked field", " tracked fields")), F.when(comments > 0, _plural(comments, " agency change comment", " agency change comments")))
    version = F.coalesce(F.concat(F.lit(" ("), F.nullif(record["version"], F.lit("")), F.lit(")")), F.lit(""))
    source = F.concat(F.lit("The official source revised "), changes, version, F.lit("; a field-level diff was not provided."))
    summary = F.concat_ws(" ", F.when(by_notice, file), F.when(by_notice, recheck), F.when(by_source, source))
    return F.when(by_notice | by_source, F.struct(changed_on.alias("changed_on"), summary.alias("summary")))


def compact_evidence(status: Column, evidence: Column, notice_url: Column, most_facts: int = 16, most_items: int = 8, quote: int = 300) -> Column:
    """Evidence of a current record as it is sent along: some facts with short quotes and their places, and the open items."""
    document = evidence["document"]

    def fact(f: Column) -> Column:
        c = f["citation"]
        place = F.struct(c["location"].alias("location"), F.coalesce(F.nullif(c["citation_url"], F.lit("")), c["document_url"]).alias("url"), truncate(F.coalesce(c["quote"], F.lit("")), quote).alias("quote"))
        return F.struct(f["id"].alias("evidence_id"), *[f[n].alias(n) for n in ("type", "label", "value", "display_value", "confidence")], place.alias("citation"))

    own = F.struct(document["name"].alias("name"), F.coalesce(F.nullif(document["url"], F.lit("")), notice_url).alias("url"), document["version"].alias("version"), F.coalesce(document["changed_since_previous"], F.lit(False)).alias("changed_since_previous"))
    sent = F.struct(own.alias("document"), F.transform(F.slice(evidence["facts"], 1, most_facts), fact).alias("facts"), F.slice(evidence["review_queue"], 1, most_items).alias("review_queue"))
    return F.when(evidence.isNotNull() & (status == "current"), sent)


#: Joints where a text has lost its blanks.
SPACING = (r"[a-z][A-Z][a-z]", r"[.!?][A-Z][a-z]", r";[A-Za-z]", r"[a-z]\)[A-Za-z]", r"[a-z]\([A-Z]{2,}\)")


def spacing_issues(text: Column) -> Column:
    """How often blanks seem to be missing."""
    text = F.coalesce(text, F.lit(""))
    n = F.lit(0)
    for pattern in SPACING:
        n = n + F.regexp_count(text, F.lit(pattern))
    return n


def stable_external_id(external_id: Column, title: Column, url: Column) -> Column:
    """A source's own id without blanks, or a digest of title and address."""
    own = F.nullif(F.regexp_replace(external_id.cast("string"), r"\s+", ""), F.lit(""))
    seed = F.lower(F.concat_ws("|", F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(url, F.lit("")))))
    return F.when(F.coalesce(external_id.cast("string"), F.lit("")) != "", F.coalesce(own, F.lit(""))).otherwise(F.concat(F.lit("auto-"), F.substring(F.sha1(seed), 1, 16)))
