"""Scalars, gates and metrics on hand-written rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tabulon.functions import dates, money, text
from tabulon.operators import changes, enrich, evidence, feedback, gates, views
from tabulon.operators import records as rec
from tabulon.plans import index as ix
from tabulon.plans.search import Request, compare, page_numbers, ranked, search
from tabulon.queries import ORACLE, QUERIES
from tabulon.schemas import RECORD, conform
from tabulon.sources import readers


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, "Studies of Straße funding, including the 3.5-kg rockets", text.tokens) == ["study", "strasse", "fund", "includ", "3.5-kg", "rocket"]
    assert one(spark, None, text.tokens) == []


def test_clean_text(spark):
    assert one(spark, "<p>A &amp;amp; B 2000</p><p> </p><script>x</script>C<br>D", text.clean_text) == "A & B 2000\nC\nD"
    assert one(spark, "  ", text.clean_text) is None
    assert one(spark, "co-\noperate", text.clean_document_text) == "cooperate"


def test_urls(spark):
    assert one(spark, "www.example.gov/a", text.safe_http_url) == "https://www.example.gov/a"
    assert one(spark, "http://x.gov/a", text.safe_http_url) == "https://x.gov/a"
    assert one(spark, "/relative", text.safe_http_url) is None
    assert one(spark, "javascript:alert(1)", text.safe_http_url) is None


def test_hash_and_json(spark):
    assert one(spark, "", text.fnv1a) == "811c9dc5"
    assert one(spark, "talk {\"a\": [1]} more", text.extract_json) == '{"a": [1]}'


def test_dates(spark):
    d = dt.date
    assert one(spark, "Sept. 3rd, 2026", dates.text_date) == d(2026, 9, 3)
    assert one(spark, "3 March 2027", dates.text_date) == d(2027, 3, 3)
    assert one(spark, "February 31, 2026", dates.text_date) is None
    assert one(spark, "2026-7-5", dates.iso_date) is None
    assert one(spark, "2026-07-05T10:00:00Z", dates.iso_date) == d(2026, 7, 5)
    assert one(spark, "2026-07-05T10:00:00Z", dates.strict_iso_date) is None
    assert one(spark, "08/25/2026 03:59:59", dates.eastern_date) == d(2026, 8, 24)


def test_money(spark):
    assert one(spark, "up to $1.25 million each", money.first_money) == 1_250_000
    assert one(spark, "$2.5", money.first_money) == 2
    assert one(spark, "1,500", money.positive_whole) == 1500
    assert one(spark, "0", money.positive_whole) is None
    assert one(spark, 1500, money.short_money, "long") == "$1.5K"


def frame(spark, rows):
    return conform(spark.createDataFrame(rows))


def test_runtime_gate(spark):
    day = F.to_date(F.lit("2026-07-30"))
    rows = [
        ("closed", None, None, False, "t", "closed"),
        ("draft", None, None, False, "t", "invalid_status"),
        ("posted", None, None, False, "Request for Information: x", "informational_notice"),
        ("posted", "soon", None, False, "t", "invalid_close_date"),
        ("posted", "2026-07-29", None, False, "t", "expired"),
        ("posted", "2026-07-30", "2020-01-01", False, "t", "current_by_close_date"),
        ("posted", None, "2026-07-01", False, "t", "archived"),
        ("forecasted", None, None, True, "t", "rolling"),
        ("forecasted", None, None, None, "t", "undated_verify_status"),
    ]
    df = spark.createDataFrame(rows, "status string, close_date string, archive_date string, rolling boolean, title string, want string")
    df = df.withColumns({"description": F.lit(""), "funding_instruments": F.lit(None).cast("array<string>")})
    assert all(r["want"] == r["got"] for r in df.withColumn("got", gates.runtime_reason(day)).collect())


def test_notice_titles(spark):
    titles = {"Notice of Intent to Issue a call": True, "DE-123 request for information": True, "RFI: x": True, "RFI - y": True, "RFI support": False, "Graduate awards after a request for information": False, "Sources sought for fellows": False, "A second notice of intent": False}
    df = spark.createDataFrame([(t, "", []) for t in titles], "title string, description string, funding_instruments array<string>")
    got = {r["title"]: r["got"] is not None for r in df.withColumn("got", gates.non_funding_reason()).collect()}
    assert got == {**titles, "A second notice of intent": False}


def test_publish_reasons(spark):
    day, none = F.to_date(F.lit("2026-07-30")), None
    rows = [
        ("t", "https://a", none, none, "2026-08-01", none, none),
        ("t", none, none, "https://d/x.pdf", none, "2026-01-01", none),
        ("", "https://a", none, none, none, none, "missing_title"),
        ("t", none, "", none, none, none, "missing_official_url"),
        ("t", none, "https://b", none, "soon", none, "unparseable_close_date"),
        ("t", "https://a", none, none, "2026-07-29", none, "expired"),
        ("t", "https://a", none, none, "2036-07-29", none, "implausible_future_date"),
        ("t", "https://a", none, none, none, "1 May", "unparseable_posted_date"),
    ]
    df = spark.createDataFrame(rows, "title string, detail_page string, funding_opportunity_url string, primary_document_url string, close_date string, posted_date string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", gates.publish_reason(day)).collect())


def test_dedup_keeps_first_of_equals(spark):
    df = spark.createDataFrame([("A 1", "1", "posted", 2), ("a1", "2", "posted", 1), ("", "3", "posted", 3)], "opportunity_number string, opportunity_id string, status string, o int")
    df = df.withColumns({"last_updated": F.lit("2026-01-01"), "version": F.lit("1")})
    kept = rec.keep_best(df, rec.identity(), rec.rank(), F.col("o"))
    assert sorted(r["opportunity_id"] for r in kept.collect()) == ["2", "3"]


def test_invalid_catalog_raises(spark):
    df = spark.createDataFrame([("1", "n", "t", "a"), ("2", "n", "t", "a")], "opportunity_id string, opportunity_number string, title string, agency string")
    try:
        rec.require_valid(df, 1, 10)
    except ValueError as e:
        assert "identity" in str(e)
    else:
        raise AssertionError


def test_ndcg(spark):
    rows = [("a", "not_relevant", 1), ("a", "strong", 2), ("b", "strong", 1)]
    df = spark.createDataFrame(rows, "q string, label string, r int")
    got = {r["q"]: round(r["ndcg"], 4) for r in feedback.ndcg(df, ["q"], "r", feedback.grade()).collect()}
    assert got == {"a": 0.6309, "b": 1.0}


def test_change_kinds(spark):
    def snap(rows):
        return frame(spark, [dict(zip(("opportunity_id", "title", "status", "close_date", "version"), r)) for r in rows])

    before = snap([("1", "a", "posted", "2026-09-01", "1"), ("2", "b", "posted", "2026-09-01", "1"), ("3", "c", "posted", "2026-12-01", "1")])
    after = snap([("1", "a", "posted", "2026-08-10", "1"), ("3", "c", "posted", "2026-12-01", "2"), ("4", "d", "posted", "2026-12-01", "1")])
    got = {(r["record_key"], r["kind"]) for r in changes.diff_snapshots(before, after, F.to_date(F.lit("2026-07-30"))).collect()}
    assert got == {("1", "deadline_changed"), ("1", "closing_soon"), ("3", "amended"), ("4", "new"), ("2", "closed_or_removed")}


def test_two_document_index_prunes_shared_terms(spark):
    rows = frame(spark, [{"opportunity_id": "1", "title": "alpha beta"}, {"opportunity_id": "2", "title": "alpha gamma"}])
    terms = {r["term"] for r in ix.build(rows, "opportunity_id").postings.collect()}
    assert terms == {"beta", "gamma"}


def test_search_phrase_and_freshness(spark):
    rows = frame(
        spark,
        [
            {"opportunity_id": "1", "title": "catalysis at surfaces", "status": "posted", "posted_date": "2025-01-01"},
            {"opportunity_id": "2", "title": "the catalysis of films", "status": "posted", "posted_date": "2026-07-20"},
            {"opportunity_id": "3", "title": "birds", "status": "posted", "posted_date": "2026-07-24", "opportunity_number": "catalysis"},
        ]
        + [{"opportunity_id": str(i), "title": f"other {i}", "status": "closed", "posted_date": "2026-07-20"} for i in range(10, 20)],
    )
    found = search(rows, ix.build(rows, "opportunity_id"), Request(query="catalysis"), F.to_date(F.lit("2026-07-25")))
    assert [r["opportunity_id"] for r in ranked(found).collect()][0] == "3"
    assert found.count() == 3


def test_compare_and_pages(spark):
    rows = frame(spark, [{"opportunity_id": str(i), "title": f"t{i}"} for i in range(6)])
    got = compare(rows, ["1", "2", "1", "3", "4", "5"], ["title"]).first()
    assert got["1"] == "t1" and "5" not in got.asDict()
    assert page_numbers(5, 9) == [1, None, 4, 5, 6, None, 9]


def test_pick_document(spark):
    df = spark.createDataFrame([([("b.docx", "x", "f"), ("NOFO final.pdf", "application/pdf", "f"), ("NOFO amendment.pdf", "application/pdf", "f")],)], "a array<struct<name:string,mime:string,folder:string>>")
    assert df.select(enrich.pick_document(F.col("a")).alias("x")).first()["x"]["name"] == "NOFO final.pdf"


def test_deadline_kinds(spark):
    body = "Letters of intent (LOI) are due August 1, 2026. " + "Something else is said here. " * 12 + "Full applications must be submitted by 9/30/26."
    df = spark.createDataFrame([(1, 0, body)], "k int, part int, text string")
    got = {(r["kind"], str(r["date"])) for r in evidence.deadlines(df, "k").collect()}
    assert got == {("letter_of_intent", "2026-08-01"), ("application", "2026-09-30")}


@pytest.mark.parametrize("body", ["due May 1, 2026 or 3/4/26", "May 1, 2026", "no date", "", "\x01 May 1, 2026\x02 ends 10-2-2027", "\U0001f600é June 2, 2027 and JUNE 3rd 2028."])
def test_matches_are_located_by_code_points(spark, body):
    pattern = re.compile(evidence.DATE)
    got = one(spark, body, lambda v: evidence.located(v, evidence.DATE))
    assert [tuple(m) for m in got] == [(m.start(), m.end(), m.group()) for m in pattern.finditer(body)]


@pytest.mark.parametrize("query, others", [("evidence_deadlines", (r"eligible\s", r"logic\s", "canceled")), ("evidence_labels", ("Sep(?:t", "canceled")), ("evidence_facts", ("Sep(?:t", r"eligible\s", r"logic\s")), ("evidence_review_queue", (r"eligible\s", r"logic\s", "cost["))])
def test_only_patterns_that_a_query_needs_are_looked_for(spark, sf_dir, query, others):
    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert [word for word in others if word in plan] == []


def test_places_and_documents_are_not_broadcast(spark, sf_dir):
    plan = QUERIES["cited_facts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_page_titles_of_odd_pages(spark, duck, tmp_path):
    odd = ["<h1>A &amp;&amp B &amp;lt; &eacute;</h1><p>x</p>", "<h1>Alone</h1>", "<h2>First</h2><h1>Main <b>b</b></h1>x", "<p>none</p>", "", None, "<h1>\u00a0 two\n\t lines \x0b \u3000</h1>x", "<h1></h1><h1>Second</h1>x", "<h1>open", "<script><h1>s</h1></script><h1>t</h1>x"]
    spark.createDataFrame([(i % 9, h) for i, h in enumerate(odd)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    own = ORACLE["page_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["page_titles"](spark, str(tmp_path)).collect())) == sorted(duck.sql(own).fetchall())


def test_facts_of_a_notice(spark):
    parts = [
        ("Dates", "A letter of intent is due August 1, 2026. Full application deadline: September 30, 2026 at 5:00 p.m. ET."),
        ("Funding", "Applicants need 10 years of experience. Individual awards: the award range is between $500,000 and $1 million. The agency anticipates making awards; we expect to fund 5 awards. There were 3 awards before."),
        ("Terms", "The period of performance is up to 36 months. The report has 40 pages. The narrative is limited to 20 pages. Cost sharing is not required. One application may be submitted per institution."),
        ("Eligibility", "Schools   and towns."),
        ("Contents", "Table of contents. Review criteria 7"),
        ("How", "The revised notice is superseded by another. A logic model and a work plan are needed. Selection criteria follow."),
    ]
    df = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(parts)] + [(2, 0, None, None), (3, 0, None, "Total available: $9 million. Each award is $5,000.")], "k int, part int, section string, text string")
    rows = evidence.facts(df, "k").collect()
    got = {(r["kind"], r["label"]): r for r in rows}
    assert {r["k"] for r in rows} == {1}  # the amount of 3 stands beside a total
    assert {(r["deadline_kind"], str(r["date"])) for r in rows if r["kind"] == "deadline"} == {("letter_of_intent", "2026-08-01"), ("application", "2026-09-30")}
    assert got["deadline", "Full application deadline"]["time"] == "5:00 p.m." and got["deadline", "Full application deadline"]["zone"] == "ET"
    award = got["award_range", "Per-award amount"]
    assert (award["minimum"], award["maximum"]) == (500_000, 1_000_000)
    assert [got[k]["value"] for k in (("expected_awards", "Expected number of awards"), ("project_duration", "Project duration"), ("page_limit", "Application page limit"), ("cost_share", "Cost sharing"))] == ["5", "36 months", "20", "false"]
    assert got["eligibility_excerpt", "Eligibility evidence"]["value"] == "Schools and towns." and got["review_criteria", "Review criteria"]["part"] == 5
    assert {label for kind, label in got if kind in ("application_component", "status_signal")} == {"Logic model", "Work plan", "Superseded notice language", "Amendment or revision language"}
    assert ("limited_submission", "Potential institutional submission limit") in got and all(r["quote"] for r in rows)


def test_primary_contact(spark):
    rows = [
        ([("A", "bad", "1", "r"), ("B", "b@x.org", "", "PI")], "own", "o@x.org", "9", ("B", "b@x.org", "9", "PI")),
        ([("", None, "5", None)], "own", "o@x.org", "9", ("own", "o@x.org", "5", "")),
        (None, None, "nobody", None, ("", "", "", "")),
    ]
    df = spark.createDataFrame(rows, "contacts array<struct<name:string,email:string,phone:string,role:string>>, n string, e string, p string, want struct<name:string,email:string,phone:string,role:string>")
    got = df.withColumn("got", views.primary_contact(F.col("contacts"), F.col("n"), F.col("e"), F.col("p"))).withColumn("label", views.contact_label(F.col("got"))).collect()
    assert all(tuple(r["got"]) == tuple(r["want"]) for r in got) and [r["label"] for r in got] == ["B", "own", "Not listed"]


def test_degraded_runs(spark):
    good, bad = (spark.createDataFrame([("a", s)], "slug string, status string") for s in ("refreshed", "kept"))
    yes, no = F.lit(True), F.lit(False)

    def degraded(*args):
        return views.is_degraded(*args).first()["degraded"]

    assert not degraded(good, yes, yes, yes) and not degraded(good.limit(0), yes, no, no)
    assert degraded(bad, yes, no, no) and degraded(good, no, no, no) and degraded(good, yes, yes, no)


def test_registry_isolates_failures(spark):
    class Bad(readers.SourceAdapter):
        def fetch(self, spark):
            raise RuntimeError("down")

    class Good(readers.SourceAdapter):
        def fetch(self, spark):
            return spark.createDataFrame([("1",)], "opportunity_id string")

        def parse(self, payload):
            return payload

    r = readers.Registry()
    r.register(Bad("bad", "Bad", "x"))
    r.register(Good("good", "Good", "x"))
    frames, runs = r.runs(spark)
    assert len(frames) == 1 and {x["slug"]: x["ok"] for x in runs.collect()} == {"bad": False, "good": True}


def test_sections(spark):
    html = "<script>no</script><h1>Top</h1><p>First text of the page here.</p><h2 id='b'>Next</h2><p>Second text of the page.</p>"
    got = readers.sections(spark.createDataFrame([(1, html)], "k int, h string"), "k", "h").orderBy("part").collect()
    assert [(r["section"], r["anchor"]) for r in got] == [("Top", None), ("Next", "b")]


def test_schema_conforms(spark):
    assert conform(spark.createDataFrame([("1",)], "opportunity_id string")).schema.simpleString() == RECORD.simpleString()


def test_long_sections_go_on(spark):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    html = "<p>" + "</p><p>".join(lines) + "</p><h2 id='b'>Next</h2><p>a short section of its own</p><h2>Long</h2><p>" + "y" * 70_000 + "</p>"
    got = readers.sections(spark.createDataFrame([(1, html)], "k int, h string"), "k", "h").orderBy("part", "piece").collect()
    first = [r["text"] for r in got if r["section"] == ""]
    assert len(first) > 1 and all(len(t) <= 30_000 for t in first)
    assert "\n".join(first).split() == " ".join(lines).split()
    assert [(r["part"], r["piece"]) for r in got] == [*((0, i) for i in range(len(first))), (1, 0), (2, 0)]
    assert [(r["section"], len(r["text"])) for r in got[len(first) :]] == [("Next", 26), ("Long", 70_000)]
