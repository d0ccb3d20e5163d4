"""Snapshot stores, digest runs, export loading, competition cards and exchange pages."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tabulon.operators.spans import first_after, last_before, spans
from tabulon.sources import cards, exchange, exports
from tabulon.sources.store import Conflict, Snapshot, Store, upsert
from tabulon.streaming import digests

TABLES = {"entries": "url string, status string"}


def entries(spark, **rows):
    return spark.createDataFrame(list(rows.items()), TABLES["entries"])


def held(frame):
    return {r["url"]: r["status"] for r in frame.collect()}


# --- store


def test_readers_pin_a_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    assert store.snapshot() == Snapshot() and store.read("entries").count() == 0
    one = store.commit(store.snapshot(), put={"entries": entries(spark, a="ok", b="ok")}, notes={"run": "1"})
    two = store.update(lambda at: {"entries": upsert(store.read("entries", at), entries(spark, b="gone", c="new"), ["url"])})
    assert held(store.read("entries", one)) == {"a": "ok", "b": "ok"}
    assert held(store.read("entries")) == {"a": "ok", "b": "gone", "c": "new"}
    assert (two.version, two.notes) == (2, {"run": "1"}) and store.snapshot(1) == one
    three = store.commit(two, add={"entries": entries(spark, d="late")})
    assert held(store.read("entries", three)) == {"a": "ok", "b": "gone", "c": "new", "d": "late"}
    with pytest.raises(KeyError):
        store.snapshot(9)


def test_of_two_writers_one_wins(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "s"), TABLES) for _ in range(2))
    base = store.snapshot()
    store.commit(base, put={"entries": entries(spark, a="first")})
    with pytest.raises(Conflict):
        other.commit(base, put={"entries": entries(spark, a="second")})
    assert held(store.read("entries")) == {"a": "first"}
    calls = []

    def change(at):
        calls.append(at.version)
        if len(calls) == 1:  # somebody else commits meanwhile
            store.commit(at, put={"entries": entries(spark, a="between")})
        return {"entries": upsert(other.read("entries", at), entries(spark, b="mine"), ["url"])}

    other.update(change)
    assert calls == [1, 2] and held(store.read("entries")) == {"a": "between", "b": "mine"}


def test_writers_that_die_leave_no_trace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    one = store.commit(store.snapshot(), put={"entries": entries(spark, a="ok")})
    bad = entries(spark, a="x").withColumn("status", F.raise_error(F.lit("dies while it writes")).cast("string"))
    with pytest.raises(Exception, match="dies while it writes"):
        store.commit(one, put={"entries": bad})
    assert store.snapshot() == one
    (tmp_path / "s/log/000000000002.json").write_text('{"version": 2, "tables": {"entries": ["half')
    assert store.snapshot() == one and held(store.read("entries")) == {"a": "ok"}
    with pytest.raises(Conflict):  # it might still be written
        store.commit(one, put={"entries": entries(spark, a="new")})
    assert "log/000000000002.json" in store.prune(grace_seconds=0)
    assert held(store.read("entries", store.commit(one, put={"entries": entries(spark, a="new")}))) == {"a": "new"}


def test_other_schema_versions_read_as_empty(spark, tmp_path):
    old = Store(spark, str(tmp_path / "s"), TABLES, 1)
    old.commit(old.snapshot(), put={"entries": entries(spark, a="ok")})
    new = Store(spark, str(tmp_path / "s"), {"entries": "url string, status string, n int"}, 2)
    assert new.read("entries").count() == 0 and new.read("entries").columns == ["url", "status", "n"]
    at = new.commit(new.snapshot(), put={"entries": entries(spark, b="ok").withColumn("n", F.lit(3))})
    assert at.version == 2 and new.read("entries").count() == 1 and old.read("entries").count() == 0


def test_pruning_keeps_what_is_used(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    for i in range(4):
        store.commit(store.snapshot(), put={"entries": entries(spark, a=str(i))})
    assert store.prune(keep=2) == []  # all of it is younger than the grace
    gone = store.prune(keep=2, grace_seconds=0)
    assert len(gone) == 4 and held(store.read("entries")) == {"a": "3"} and held(store.read("entries", store.snapshot(3))) == {"a": "2"}


# --- digests

EVENTS = "id string, kind string, record string, changed_at date"


def day(n):
    return datetime.date(2026, 7, n)


def runs_of(spark, ranked, run_day, **options):
    subs = spark.createDataFrame([("s", None, True), ("off", False, True), ("none", True, None), ("no", True, False)], "subscription string, active boolean, confirmed boolean")
    table = spark.createDataFrame(ranked, "subscription string, record string, position int, known_on date")
    return digests.Digests(subs, lambda _: table, lambda _: run_day, **options)


def outbox(into):
    return sorted((r["subscription"], r["kind"], r["id"], r["batch"]) for r in into.read("outbox").collect())


def test_a_replayed_batch_sends_nothing(spark, tmp_path):
    into = digests.store(spark, str(tmp_path / "d"))
    none = spark.createDataFrame([], EVENTS)
    ranked = [(s, r, p, day(20)) for s in ("s", "off", "none", "no") for p, r in enumerate("abc")]
    runs_of(spark, ranked, day(21), most=2).run(none, 0, into)
    assert outbox(into) == [("s", "new", "a", 0), ("s", "new", "b", 0)]  # consent is needed; the limit holds
    at = into.snapshot()
    assert runs_of(spark, ranked, day(21), most=2).run(none, 0, into) == at
    runs_of(spark, ranked, day(22), most=2).run(none, 1, into)
    assert len(outbox(into)) == 2  # c became known before the last run


def test_updates_follow_what_was_sent(spark, tmp_path):
    into = digests.store(spark, str(tmp_path / "d"))
    runs_of(spark, [("s", "a", 1, day(1))], day(2)).run(spark.createDataFrame([], EVENTS), 0, into)
    events = [("e1", "deadline_changed", "a", day(9)), ("e2", "closed_or_removed", "a", day(9)), ("e3", "closed_or_removed", "never", day(9)), ("e4", "deadline_changed", "other", day(9)), ("e5", "amended", "a", day(1)), ("e6", "new", "a", day(9)), ("e7", "amended", "b", day(9))]
    runs = runs_of(spark, [("s", "a", 1, day(1)), ("s", "b", 2, day(9))], day(9))
    runs.run(spark.createDataFrame(events, EVENTS), 1, into)
    assert [x[1:3] for x in outbox(into) if x[3] == 1] == [("closed_or_removed", "e2"), ("deadline_changed", "e1"), ("new", "b")]  # b's own change goes with it
    state = into.read("state").collect()
    assert [(r["subscription"], r["last_run"], r["records"], sorted(r["events"])) for r in state] == [("s", day(9), ["a", "b"], ["e1", "e2"])]
    runs.run(spark.createDataFrame(events, EVENTS), 2, into)
    assert [x[1:3] for x in outbox(into) if x[3] == 2] == [("amended", "e7")]  # it was not told yet


def test_watermarks_move_only_with_a_digest(spark, tmp_path):
    into = digests.store(spark, str(tmp_path / "d"))
    none = spark.createDataFrame([], EVENTS)
    runs_of(spark, [("s", "old", 1, day(1))], day(20)).run(none, 0, into)  # beyond the window
    assert outbox(into) == [] and into.read("state").count() == 0
    runs_of(spark, [("s", "b", 1, day(20))], day(20)).run(none, 1, into)
    runs_of(spark, [("s", "c", 1, day(19)), ("s", "d", 2, day(20))], day(22)).run(none, 2, into)
    assert [x[2] for x in outbox(into)] == ["b", "d"]


def test_remembered_ids_are_bounded(spark, tmp_path):
    into = digests.store(spark, str(tmp_path / "d"))
    for batch in range(3):
        runs_of(spark, [("s", f"{batch}{i}", i, day(20)) for i in range(3)], day(20), remembered=4).run(spark.createDataFrame([], EVENTS), batch, into)
    assert into.read("state").first()["records"] == ["12", "20", "21", "22"]


# --- exports


def written_files(tmp_path, files):
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(tmp_path)


def review(i, at="2026-07-01", **more):
    return {"schema_version": 1, "kind": exports.REVIEW_KIND, "exported_at": at, "review": {"review_id": i, **more}}


def test_good_and_broken_reviews_in_one_folder(spark, tmp_path):
    files = {
        "b/one.json": review("r1", participant_code="p", usage={"searches": 3, "odd": "x"}, deployment_checks={"loads": "no", "fast": "yes"}, source_reviews=[{"opportunity_id": "1", "status": "accurate", "evidence_ids": ["e1", "e2"]}, {"opportunity_id": "2"}]),
        "a.JSON": review("r1", at="2026-06-01"), "c.json": '{"schema_version": 1,', "d.json": review("r2") | {"schema_version": 2}, "e.json": review("r2") | {"kind": "other"},
        "f.json": review(""), "g.json": [1, 2], "h.json": review("r2") | {"schema_version": "1"}, "notes.txt": "no export", "i.json": review("r3", usage={"searches": "4"}),
    }
    found = exports.reviews(exports.files(spark, written_files(tmp_path, files)))
    errors = {r["file"].rsplit("/", 1)[1]: r["error"] for r in exports.failures(found).collect()}
    assert errors == {"c.json": "not valid JSON", "d.json": "unsupported review schema", "e.json": "not a review export", "f.json": "no review identifier", "g.json": "not an object", "h.json": "unsupported review schema"}
    newest = exports.newest_reviews(found)
    assert {r["review_id"]: r["file"].rsplit("/", 1)[1] for r in newest.collect()} == {"r1": "one.json", "r3": "i.json"}
    rows = exports.source_reviews(newest).orderBy("opportunity_id").collect()
    assert [(r["participant"], r["opportunity_id"], r["status"], r["field"], r["evidence_ids"]) for r in rows] == [("p", "1", "accurate", "overall", "e1;e2"), ("p", "2", "unknown", "overall", "")]
    assert {r["name"]: r["n"] for r in exports.usage(newest).collect()} == {"searches": 7, "odd": 0}
    assert {r["name"]: r["n"] for r in exports.failed_checks(newest).collect()} == {"loads": 1}


def test_equal_stamps_are_settled_by_the_path(spark, tmp_path):
    files = {"a/z.json": review("r", n=1), "a-b.json": review("r", n=2), "a/b/c.json": review("r", n=3)}
    newest = exports.newest_reviews(exports.reviews(exports.files(spark, written_files(tmp_path, files))))
    assert [r["file"].rsplit("/", 1)[1] for r in newest.collect()] == ["a-b.json"]  # "a" sorts before "a-b"


def test_evaluations(spark, tmp_path):
    entry = lambda i, label, **more: {"opportunity_id": i, "label": label, **more}
    files = {
        "one.json": {"schema_version": 1, "prompt_version": "v1", "session": {"candidate_ids": ["1", 2, "", None]}, "feedback": [entry("1", "useful", retrieval_rank=1, ai_rank=2), entry("2", "strong", retrieval_rank="3"), entry("3", "partial", retrieval_rank=0), entry("4", "odd"), 7]},
        "two.json": {"schema_version": 1, "feedback": {}}, "three.json": {"schema_version": 1, "feedback": [entry("9", "useful", retrieval_rank=40, reason="eligibility", provider="p")]},
    }
    found = exports.evaluations(exports.files(spark, written_files(tmp_path, files)))
    assert [r["error"] for r in exports.failures(found).collect()] == ["feedback must be a list"]
    rows = {r["opportunity_id"]: r for r in exports.judgments(found).collect()}
    assert set(rows) == {"1", "2", "3", "9"}
    assert [(rows[i]["retrieval_rank"], rows[i]["ai_rank"], rows[i]["in_candidates"]) for i in "1239"] == [(1, 2, True), (None, None, True), (None, None, False), (40, None, None)]
    assert (rows["9"]["reason"], rows["9"]["provider_model"], rows["1"]["prompt_version"], rows["9"]["prompt_version"]) == ("eligibility", "p / none", "v1", "unspecified")


def test_change_events(spark, tmp_path):
    event = {"id": "e1", "type": "new", "opportunity_id": 7, "changed_at": "2026-07-01T09:00:00Z", "label": "L", "record": {"title": "T"}}
    files = {"a.json": {"events": [event, {"id": "e2", "changed_at": "soon"}]}, "b.json": "{broken", "c.json": {"events": None}, "d.json": [1]}
    got = exports.change_events(exports.files(spark, written_files(tmp_path, files))).orderBy("id").collect()
    assert [(r["id"], r["opportunity_id"], str(r["changed_at"]), r["title"]) for r in got] == [("e1", "7", "2026-07-01", "T"), ("e2", None, "None", None)]


def test_verdict_counts(spark):
    rows = spark.createDataFrame([("accurate", "overall"), ("accurate", "deadline"), ("unknown", "overall")], "status string, field string")
    assert {(r["part"], r["name"]): r["n"] for r in exports.verdict_counts(rows).collect()} == {("status", "accurate"): 2, ("status", "unknown"): 1, ("field", "overall"): 2, ("field", "deadline"): 1}


# --- cards


@pytest.mark.parametrize("wrap", [lambda c: c, lambda c: {"total": 1, "Competitions": c}, lambda c: {"data": "none", "homepageItems": c}])
def test_three_forms_of_payloads_give_the_same_cards(spark, wrap):
    found = [{"opportunityId": 12, "title": "A", "dueDate": "08/01/2026 03:30:00", "description": "x"}, {"title": "", "name": "B", "deadline": "Aug 9, 2026"}, {"id": "no title"}, "text", {"cardId": 0, "Title": "C", "dueDate": "1/5/2026 17:00:00"}]
    rows = cards.competitions(spark.createDataFrame([(1, json.dumps(wrap(found)))], "k int, p string"), "k", "p", "https://x/").collect()
    assert sorted((r["external_id"], r["title"], r["url"], r["close_date"]) for r in rows) == [("12", "A", "https://x/#competitionDetail/12", "2026-07-31"), ("B", "B", "https://x/", "Aug"), ("C", "C", "https://x/", "2026-01-05")]


def test_a_single_card_and_no_card(spark):
    texts = [json.dumps({"cardId": "0", "title": "only"}), "{broken", None, "3", json.dumps({"cards": []})]
    rows = cards.competitions(spark.createDataFrame(list(enumerate(texts)), "k int, p string"), "k", "p", "https://x/").collect()
    assert [(r["k"], r["external_id"], r["close_date"]) for r in rows] == [(0, "0", None)]


# --- exchange pages


def item(i, number, title, rest):
    guid = "-".join([str(i) * 8, *[str(i) * 4] * 3, str(i) * 12])
    return f'<li><a href="#FoaId{guid}">{number}</a> <a class="t" href="#FoaId{guid}">{title}</a> {rest}</li>'


PAGE = "<ul>" + "".join(
    [
        item(1, "DE-FOA-0009001", "Carbon &amp; Capture", "Notice Of Funding Opportunity (NOFO) 9/15/2026 05:00 PM ET 12/1/2026 05:00 PM ET"),
        item(2, "RFI-0000200", "Information on Widgets", "Request for Information (RFI) 7/1/2026 05:00 PM ET"),
        item(3, "DE-FOA-0008000", "Closed Program", "Notice Of Funding Opportunity (NOFO) 2/1/2024 05:00 PM ET 4/1/2024"),
        item(4, "de-foa-0009050", "Geothermal", "Notice Of Funding Opportunity (NOFO) Geothermal Office (GTO) - 10/30/2026 05:00 PM ET TBD"),
        item(5, "DE-TA3-0003589", "Minerals", "<b>Notice Of  Funding Opportunity</b> (NOFO) Office 13/45/2026 11/30/2026" + " x" * 120 + " 12/30/2026"),
        item(6, "DE-FOA-0003588", "Notice of Intent to issue a Notice of Funding Opportunity", "Notice of Intent to Publish (NOI) Office TBD"),
    ]
) + "</ul>"


def test_exchange_page(spark):
    pages = spark.createDataFrame([("p", PAGE), ("few", item(1, "DE-FOA-0009001", "One", "Notice Of Funding Opportunity (NOFO)")), ("none", None), ("other", "".join(item(i, f"RFI-000020{i}", "Info", "Request (RFI) 7/1/2026") for i in range(1, 5)))], "k string, html string")
    rows = exchange.rows_of(pages, "k", "html")
    found = exchange.opportunities(rows.where("k = 'p'"), "k", F.to_date(F.lit("2026-07-25")), "DOE").collect()
    by = {r["external_id"]: r for r in found}
    assert set(by) == {"DE-FOA-0009001", "DE-FOA-0008000", "DE-FOA-0009050", "DE-TA3-0003589"}
    one = by["DE-FOA-0009001"]
    assert (one["title"], str(one["close_date"]), one["agency"], one["anchor"][:14]) == ("Carbon & Capture", "2026-09-15", "DOE", "#FoaId11111111")
    assert [(str(d["date"]), d["time"], d["timezone"]) for d in one["additional_deadlines"]] == [("2026-12-01", "05:00 PM", "ET")]
    assert one["deadline_note"].startswith("Next of 2 open")
    assert str(by["DE-FOA-0008000"]["close_date"]) == "2024-04-01"  # all past: the last one
    assert (by["DE-FOA-0009050"]["agency"], str(by["DE-FOA-0009050"]["close_date"])) == ("Geothermal Office (GTO)", "2026-10-30")
    assert (str(by["DE-TA3-0003589"]["close_date"]), by["DE-TA3-0003589"]["additional_deadlines"]) == ("2026-11-30", [])  # no such day; beyond the reach
    health = {r["k"]: (r["n_rows"], r["n_funding"], r["error"]) for r in exchange.health(pages, rows, "k").collect()}
    assert health == {"p": (6, 4, None), "few": (1, 1, "no plausible structure of rows"), "none": (0, 0, "no plausible structure of rows"), "other": (4, 0, "rows but no known funding type")}


def test_spans_and_their_neighbours(spark):
    rows = spark.createDataFrame([(1, "a1 b2 a33 b"), (2, "b a1"), (3, "")], "k int, t string")
    found = spans(rows, "k", F.col("t"), {"a": (r"a(\d+)", 1), "b": (r"b", 0)})
    got = found.withColumn("before", last_before("k", "a")).withColumn("after", first_after("k", "b")["start"]).orderBy("k", "start").collect()
    assert [(r["k"], r["kind"], r["start"], r["end"], r["found"], r["before"], r["after"]) for r in got] == [
        (1, "a", 0, 2, "1", 0, 3), (1, "b", 3, 4, "b", 0, 10), (1, "a", 6, 9, "33", 6, 10), (1, "b", 10, 11, "b", 6, None), (2, "b", 0, 1, "b", None, None), (2, "a", 2, 4, "1", 2, None),
    ]
