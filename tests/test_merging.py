"""Nested merges, packages, re-ranking, natural order, personal search, API details and page labels."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.functions.collation import natural_order
from tabulon.operators import codes, gates, merging, privacy, reranking, views
from tabulon.plans.personal import applicant_fit
from tabulon.sources import details

FACT_FIELDS = "id type label value display_value confidence citation date deadline_kind time timezone required status_signal".split()


def fact(**values):
    return {n: values.get(n) for n in FACT_FIELDS}


def records_of(spark, *rows):
    return spark.createDataFrame([(k, c, d, t) for k, c, d, t in rows], f"k string, close_date string, deadlines array<{merging.DEADLINE}>, topic_areas array<string>")


def entries_of(spark, *rows):
    schema = f"k string, status string, checked_at string, document {merging.DOCUMENT}, facts array<{merging.FACT}>, review_queue array<{merging.REVIEW}>, program_areas array<struct<label:string,topics:array<string>,quote:string>>"
    return spark.createDataFrame([tuple({"status": "current", **r}.get(n) for n in ("k", "status", "checked_at", "document", "facts", "review_queue", "program_areas")) for r in rows], schema)


def test_facts_meet_their_deadlines(spark):
    citation = {"quote": "due  soon", "document_url": "https://x"}
    have = [{"kind": "application", "date": "2026-09-30"}, {"kind": "application", "date": "2026-09-30"}, {"kind": None, "date": "2026-08-01"}]
    full = [{**dict.fromkeys([f.name for f in privacy.struct_of(f"x {merging.DEADLINE}")["x"].dataType]), **d} for d in have]
    facts = [
        fact(id="1", type="deadline", label="Full", display_value="Sep 30", deadline_kind="application", date="2026-09-30", citation=citation),
        fact(id="2", type="deadline", label="LOI", deadline_kind="letter_of_intent", date="2026-08-01"),
        fact(id="3", type="deadline", label="New", deadline_kind="concept_paper", date="2026-07-01", citation=citation, required=True),
        fact(id="4", type="deadline", label="Again", deadline_kind="concept_paper", date="2026-07-01"),
        fact(id="5", type="deadline", label="Own", deadline_kind="application", date="2026-08-01"),
        fact(id="6", type="status_signal", label="S", status_signal="superseded"), fact(id="7", type="limited_submission", label="L"), fact(id="8", type="status_signal", label="S2", status_signal="amended"),
    ]
    areas = [("Plasma", ["Physics", "Energy"], "plasmas here"), ("Blood", ["Health"], "no such word"), ("Odd", ["X"], "odd")]
    got = merging.merge_facts(records_of(spark, ("a", "2026-09-30", full, ["Energy"])), entries_of(spark, {"k": "a", "facts": facts, "program_areas": areas, "checked_at": "2026-07-25"}), "k", {"Plasma": r"\bplasmas?\b", "Blood": "blood"}).first()
    assert [(d["kind"], d["date"], d["evidence_id"], d["document_evidence_id"]) for d in got["deadlines"]] == [
        ("application", "2026-09-30", None, "1"), ("application", "2026-09-30", None, None), (None, "2026-08-01", None, "2"), ("concept_paper", "2026-07-01", "3", "4"), ("application", "2026-08-01", "5", None),
    ]
    assert (got["deadlines"][3]["note"], got["deadlines"][3]["source_url"], got["deadlines"][3]["required"], got["deadlines"][3]["estimated"]) == ("due  soon", "https://x", True, False)
    assert (got["has_preliminary_stage"], got["preliminary_stage_type"], got["limited_submission_review"]["evidence_id"], got["actionability_status"]) == (True, "letter_of_intent", "7", "document_status_needs_review")
    assert (got["document_status_signals"], got["topic_areas"], got["document_program_areas"]) == (["superseded", "amended"], ["Energy", "Physics"], ["Plasma"])
    assert got["document_search_text"] == "Full Sep 30 due soon LOI New due soon Again Own S L S2 Plasma"


def test_a_second_merge_changes_nothing(spark):
    facts = [fact(id="3", type="deadline", deadline_kind="concept_paper", date="2026-07-01"), fact(id="4", type="deadline", deadline_kind="concept_paper", date="2026-07-01")]
    entries = entries_of(spark, {"k": "a", "facts": facts})
    once = merging.merge_facts(records_of(spark, ("a", None, None, None)), entries, "k")
    twice = merging.merge_facts(once, entries, "k")
    assert [d["date"] for d in twice.first()["deadlines"]] == ["2026-07-01"]
    assert twice.first()["document_search_text"] == once.first()["document_search_text"]


def test_records_without_a_current_entry(spark):
    rows = records_of(spark, *[(k, None, None, None) for k in "abcd"])
    entries = entries_of(spark, {"k": "b", "status": "failed"}, {"k": "c", "status": ""}, {"k": "d", "facts": None})
    got = merging.merge_facts(rows, entries, "k")
    assert {r["k"]: (r["document_evidence_status"], r["document_search_text"], r["document_evidence"] is None) for r in got.collect()} == {"a": ("pending", None, True), "b": ("failed", None, True), "c": ("failed", None, True), "d": ("current", "", False)}
    counts = merging.document_metrics(got, runs=(2, 1, 0)).first().asDict()
    assert (counts["document_current_count"], counts["document_pending_count"], counts["document_failed_count"], counts["citation_fact_count"], counts["refreshed_count"]) == (1, 1, 2, 0, 2)
    assert merging.document_metrics(got.limit(0)).first()["review_queue_count"] == 0


def test_review_items(spark):
    facts = [fact(id=str(i), type=t, deadline_kind=k, date=d, status_signal=s) for i, (t, k, d, s) in enumerate([("limited_submission", None, None, None), ("status_signal", None, None, "amended"), ("status_signal", None, None, "cancelled"), ("deadline", "application", "2026-09-01", None), ("deadline", "application", "2026-09-30", None), ("deadline", "concept_paper", "2026-08-01", None)])]
    rows = spark.createDataFrame([("2026-09-30", facts, True, 100), (None, facts[:2], False, 300), (None, [], None, None)], f"c string, f array<{merging.FACT}>, ch boolean, n int")
    got = [[(q["type"], q["evidence_ids"]) for q in r["q"]] for r in rows.select(merging.review_items(F.col("c"), F.col("f"), F.col("ch"), F.col("n")).alias("q")).collect()]
    assert got[0] == [("limited_submission", ["0"]), ("status", ["2"]), ("deadline_conflict", ["3"]), ("amendment", ["1", "2", "3", "4", "5"]), ("document_unreadable", [])]
    assert got[1:] == [[("limited_submission", ["0"])], [("document_unreadable", [])]]


def test_ids_and_citations(spark):
    rows = spark.createDataFrame([("1", None, "sec", "", 'A "quote"\n…'), ("1", 7, None, None, "q"), ("1", None, None, None, None)], "k string, page int, section string, anchor string, quote string")
    document = F.struct(F.lit("https://x/n.pdf").alias("url"), F.lit("n").alias("name"), F.lit("ab").alias("sha256"))
    made = merging.citation(document, F.struct("page", "anchor", "section"), F.col("quote"), F.lit("now"))
    got = rows.select("*", made.alias("c"), merging.evidence_id(F.col("k"), F.lit("deadline"), F.lit("L"), F.lit('"2026"'), made).alias("id")).collect()
    for r in got:
        body = json.dumps({"opportunity_id": "1", "type": "deadline", "label": "L", "value": "2026", "page": r["page"], "section": r["section"], "quote": r["quote"]}, sort_keys=True, ensure_ascii=False)
        assert r["id"] == f"evidence-1-{hashlib.sha256(body.encode()).hexdigest()[:12]}"
    assert [(r["c"]["citation_url"], r["c"]["location"]) for r in got] == [("https://x/n.pdf", "section “sec”"), ("https://x/n.pdf#page=7", "page 7"), ("https://x/n.pdf", "section “Official notice”")]


def test_source_of_a_record(spark):
    names = ["primary_document_url", "primary_document_name", "funding_opportunity_url", "close_date", "award_floor", "award_ceiling"]
    rows = [("p", "n", "a", None, None, None), (None, None, "a", "2026", "1", None), (None, None, "a", None, "1", "1"), (None, None, None, None, None, None), ("", None, "a", "2026", "0", "0")]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    flags = {n: F.lit(None).cast("boolean") for n in ("status_verification_required", "has_preliminary_stage", "limited_submission")}
    got = [r["s"] and r["s"]["kind"] for r in frame.select(merging.source_of({n: F.col(n) for n in names} | flags).alias("s")).collect()]
    assert got == ["primary_notice", None, "agency_notice", None, "agency_notice"]


# --- packages


def test_no_unknown_field_leaves(spark):
    data = [{"k": 1, "secret": "s", "review": {"id": " long text ", "key": "s", "usage": {"a": {"n": 1, "raw": "s"}}, "items": [{"label": "x", "note": {"cv": "s"}}, None]}}]
    rows = spark.read.json(spark.sparkContext.parallelize([json.dumps(d) for d in data]), schema="k int, secret string, review struct<id:string,key:string,usage:map<string,struct<n:int,raw:string>>,items:array<struct<label:string,note:struct<cv:string>>>>")
    want = "review struct<id:string,gone:int,usage:map<string,struct<n:int>>,items:array<struct<label:string,note:string>>>"
    got = privacy.package(rows, "k", want, {"id": 4})
    payload = got.first()["payload"]
    assert json.loads(payload) == {"review": {"id": "long", "usage": {"a": {"n": 1}}, "items": [{"label": "x"}, None]}}
    assert '"s"' not in payload and "cv" not in payload  # a nested value doesn't slip into a plain field
    assert privacy.project(rows, want).schema.simpleString() == f"struct<{want.replace('review ', 'review:')}>"


# --- re-ranking


def test_answers_are_held_to_the_candidates(spark):
    own = spark.createDataFrame([("q", f"c{i}", i) for i in range(1, 6)] + [("empty", "c1", 1)], "q string, id string, candidate int")
    answers = spark.createDataFrame([("q", "c4", 1, "250", "Strong fit"), ("q", "zz", 2, "9", ""), ("q", "c2", 3, "41.5", ""), ("q", "c4", 4, "1", "Weak fit"), ("q", "c9", 5, "x", ""), ("q", "c1", 6, "none", None)], "q string, id string, place int, score string, verdict string")
    got = reranking.reranked(own, answers, ["q"], "id", most=4, fill=True).orderBy("q", "position").collect()
    assert [(r["q"], r["id"], r["position"], r["score"], r["verdict"], r["origin"]) for r in got] == [
        ("empty", "c1", 1, None, None, "own"), ("q", "c4", 1, 100, "Strong fit", "answer"), ("q", "c2", 2, 42, "Possible fit", "answer"), ("q", "c1", 3, 0, "Possible fit", "answer"), ("q", "c3", 4, None, None, "own"),
    ]
    assert {r["id"] for r in reranking.reranked(own, answers, ["q"], "id").collect()} == {"c4", "c2", "c1"}


def test_known_ids_and_citations(spark):
    rows = spark.createDataFrame([(["b", "x", "a", "b", None], ["a", "b", "c"], [("a", 1), ("b", 2), ("a", 3)]), (None, ["a"], [])], "asked array<string>, allowed array<string>, c array<struct<evidence_id:string,n:int>>")
    got = rows.select(reranking.known_ids(F.col("asked"), F.col("allowed")).alias("i"), reranking.known_citations(F.col("asked"), F.col("c"), 5).alias("c")).collect()
    assert (got[0]["i"], [x["n"] for x in got[0]["c"]]) == (["b", "a"], [2, 3])
    assert (got[1]["i"], got[1]["c"]) == ([], [])


def test_what_a_chat_may_know(spark):
    rows = spark.createDataFrame([(True, ["a", "b", "a", ""], ["x"], "cv text", True), (False, None, ["x", None, "y", "x"], "cv text", False)], "active boolean, ids array<string>, matched array<string>, cv string, ok boolean")
    profile = {"research_description": F.lit(""), "expertise_keywords": F.lit("k"), "applicant_context": F.lit("other"), "career_stage": F.lit("any"), "include_cv": F.col("ok"), "cv_text": F.col("cv")}
    got = rows.select(reranking.chat_ids(F.col("active"), F.col("ids"), F.col("matched"), 3).alias("i"), reranking.profile_context(profile, 4).alias("p")).collect()
    assert [r["i"] for r in got] == [["a", "b"], ["x", "y"]]
    assert tuple(got[0]["p"]) == (None, "k", "other", "any", "cv t", "First 4 characters of the locally extracted CV") and got[1]["p"]["cv_excerpt"] is None


def test_clean_texts(spark):
    rows = spark.createDataFrame([("  a\x00b\r\nc\rd  ",), (None,), ("x \t y  \n\n \n\n z ",)], "t string")
    assert [r[0] for r in rows.select(text.clean_string("t", 6)).collect()] == ["ab\nc\nd", "", "x \t y "]
    assert [tuple(r[0]) for r in rows.select(text.cv_text("t", 7)).collect()] == [("ab\nc\nd", False), ("", False), ("x y\n\nz", False)]


# --- order


@pytest.mark.parametrize("descending", [False, True])
def test_natural_order(spark, descending):
    want = ["2 b", "10 a", "A2", "a010", "A10", "a11", "álfa", "alfb", "b", "B", "Zoë 1", "zoé 2"]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in [*want, None, ""]], "t string").orderBy(natural_order("t", descending)).collect()]
    assert set(got[-2:]) == {None, ""}
    kept = [t for t in (got[:-2][::-1] if descending else got[:-2]) if t not in ("a010", "A10", "Zoë 1", "zoé 2")]
    assert kept == [t for t in want if t in kept]
    assert got.index("A2") < got.index("A10") if not descending else got.index("A2") > got.index("A10")


def test_applicant_fit(spark):
    kinds = [None, [], ["Private institutions of higher education"], ["Unrestricted"], ["Small businesses"], ["City or township governments"]]
    rows = spark.createDataFrame([(k,) for k in kinds], "k array<string>")
    assert [r[0] for r in rows.select(applicant_fit(F.col("k"), "higher_education")).collect()] == [0.0, 0.0, 2.4, 0.8, -0.8, -0.8]
    assert [r[0] for r in rows.select(applicant_fit(F.col("k"), "government")).collect()][-1] == 2.4
    assert [r[0] for r in rows.select(applicant_fit(F.col("k"), "none")).collect()][2] == -0.8


# --- details


DETAIL = {
    "id": 360001, "revision": 3,
    "synopsis": {
        "version": 3, "synopsisDesc": "Applicants must submit a letter of intent by August 1, 2026. Full applications support research.", "responseDate": "Sep 30, 2026 12:00:00 AM EDT",
        "responseDateDesc": "Applications are due by 5:00 p.m. Eastern Time.", "lastUpdatedDate": "Jul 24, 2026 12:00:00 AM EDT", "awardFloor": "500000", "awardCeiling": "1000000", "estimatedFunding": "5000000", "numberOfAwards": "5",
        "agencyContactName": "Program Officer", "agencyContactEmail": "program@example.gov", "agencyContactPhone": "202-555-0100", "fundingDescLinkUrl": "https://agency.example.test/program",
    },
    "synopsisAttachmentFolders": [{"folderType": "Full Announcement", "folderName": "Current NOFO", "synopsisAttachments": [
        {"id": 9001, "fileName": "Frequently_Asked_Questions.pdf", "fileDescription": "FAQ", "mimeType": "application/pdf", "createdDate": "Jul 20, 2026 12:00:00 AM EDT"},
        {"id": 9002, "fileName": "Revised_NOFO.pdf", "fileDescription": "Revised funding opportunity announcement", "mimeType": "application/pdf", "createdDate": "Jul 24, 2026 12:00:00 AM EDT"},
    ]}],
    "synopsisDocumentURLs": [], "synopsisHistCount": 2, "synAttChangeComments": [{"comment": "Revised NOFO posted"}],
}


def compacted(spark, *answers):
    rows = spark.createDataFrame([(str(i), "A title", "2026-01-01", a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)], "k string, t string, c string, d string")
    return {r["k"]: r for r in details.compact(rows, "k", "d", "t", "c").collect()}


def test_an_answer_as_an_entry(spark):
    e = compacted(spark, DETAIL)["0"]
    assert e["primary_document"].asDict() == {"url": "https://grants.gov/grantsws/rest/opportunity/att/download/9002", "name": "Revised_NOFO.pdf", "source": "Grants.gov attachment", "confidence": "high"}
    assert tuple(e["award"]) == (500_000, 1_000_000, 5_000_000, 5)
    assert (str(e["preliminary_deadline"]["date"]), e["preliminary_deadline"]["kind"], e["preliminary_deadline"]["required"]) == ("2026-08-01", "letter_of_intent", True)
    assert (str(e["deadline"]["date"]), e["deadline"]["time"], e["deadline"]["timezone"], e["deadline"]["note"]) == ("2026-09-30", "5:00 p.m.", "Eastern Time", "Applications are due by 5:00 p.m. Eastern Time.")
    assert [c.asDict() for c in e["contacts"]] == [{"name": "Program Officer", "email": "program@example.gov", "phone": "202-555-0100", "role": "Agency contact", "source_url": "https://www.grants.gov/search-results-detail/360001"}]
    assert (e["api_revision"], e["api_version"], str(e["api_last_updated"]), e["attachment_count"], tuple(e["history"]), e["funding_opportunity_url"]) == (3, "3", "2026-07-24", 2, (2, 0, 0, 1), "https://agency.example.test/program")
    assert [a["id"] for a in e["attachments"]] == ["9002", "9001"]


def test_answers_without_much(spark):
    forecast = {"synopsis": {}, "forecast": {"estApplicationResponseDate": "2026-05-01", "agencyContactDesc": "Mail &lt;a@b.org&gt;.", "forecastDesc": "Limited to one application here. Cost sharing of 20% is needed; untenured staff"}, "synopsisDocumentURLs": [{"url": "https://x.org/a.pdf?x=1"}, "https://x.org/b", "ftp://no"]}
    got = compacted(spark, forecast, "{broken", {"id": 0, "synopsis": None}, {"synopsis": {"synopsisDesc": "white paper"}, "synopsisAttachmentFolders": [{"folderName": "Full_Announcement", "synopsisAttachments": [{"id": 1, "fileName": "draft NOFO.PDF"}, {"id": 2, "fileName": "text.pdf"}]}]})
    one = got["0"]
    assert (str(one["deadline"]["date"]), one["contacts"][0]["email"], one["contacts"][0]["source_url"], one["document_urls"]) == ("2026-05-01", "a@b.org", "https://www.grants.gov/", ["https://x.org/a.pdf?x=1", "https://x.org/b"])
    assert (one["primary_document"]["url"], one["primary_document"]["confidence"], one["limited_submission"], one["cost_share_detail"], one["career_stage_signal"]) == ("https://x.org/a.pdf?x=1", "medium", True, "Cost sharing of 20%", "untenured")
    for k in "12":
        assert (str(got[k]["deadline"]["date"]), got[k]["contacts"], got[k]["primary_document"], got[k]["attachment_count"], got[k]["preliminary_deadline"]) == ("2026-01-01", [], None, 0, None)
    assert (got["3"]["primary_document"]["name"], got["3"]["primary_document"]["confidence"], got["3"]["preliminary_deadline"]["kind"], got["3"]["preliminary_deadline"]["date"]) == ("draft NOFO.PDF", "medium", "white_paper", None)


def test_signals(spark):
    texts = [None, "LOI due", "limited to one application; Early Career", "applications are reviewed on a rolling", "a pre application, then a white paper"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(codes.signals(F.col("t")).alias("s"), codes.preliminary_kind(F.col("t")).alias("k")).collect()
    assert [(*r["s"], r["k"]) for r in rows] == [(None, False, False, None, "preliminary"), ("LOI", False, False, None, "letter_of_intent"), (None, True, False, "Early Career", "preliminary"), (None, False, True, None, "preliminary"), ("pre application", False, False, None, "preapplication")]


# --- pages


def test_page_gate(spark):
    rows = [("ok", "posted", "2026-08-01", None, [], None), ("a_b.c RFI - x", "posted", None, None, [], None), ("t", "posted", "2026-8-1", None, [], None), ("t", "forecasted", None, "2026-07-01", [], None), ("t", "posted", None, None, ["OTHER"], "not accepting applications"), ("t", "posted", "2026-07-29", "2026-12-01", [], None), ("t", "Withdrawn", None, None, None, None)]
    frame = spark.createDataFrame(rows, "title string, status string, close_date string, archive_date string, funding_instruments array<string>, close_date_note string").withColumn("description", F.lit(None).cast("string"))
    got = frame.select(gates.page_reason().alias("r"), gates.page_is_current(F.to_date(F.lit("2026-07-30"))).alias("c")).collect()
    assert [(r["r"], r["c"]) for r in got] == [("", True), ("informational notice", False), ("", False), ("", False), ("not accepting applications", False), ("", False), ("", False)]


def test_compact_evidence(spark):
    citation = {"quote": "q" * 400, "location": "page 1", "document_url": "https://d", "citation_url": ""}
    entries = entries_of(spark, {"k": "a", "facts": [fact(id=str(i), type="t", citation=citation) for i in range(20)], "review_queue": [("x", "l", "s", [])] * 9, "document": {"name": "n", "url": None, "version": 2}})
    merged = merging.merge_facts(records_of(spark, ("a", None, None, None), ("b", None, None, None)), entries, "k")
    got = {r["k"]: r["e"] for r in merged.select("k", views.compact_evidence(F.col("document_evidence_status"), F.col("document_evidence"), F.lit("https://own")).alias("e")).collect()}
    assert got["b"] is None and (len(got["a"]["facts"]), len(got["a"]["review_queue"]), got["a"]["document"]["url"]) == (16, 8, "https://own")
    assert (got["a"]["facts"][0]["citation"]["url"], len(got["a"]["facts"][0]["citation"]["quote"]), got["a"]["document"]["changed_since_previous"]) == ("https://d", 300, False)
