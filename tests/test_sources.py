"""Paged searches, sources that fail while they run, and tokens as rows."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions.text import token_rows, tokens
from tabulon.plans.search import containing
from tabulon.sources import paged, readers


def library(broken=(), counts_fail=()):
    """A paged search over made hits: 7 of "a", 3 of "b" (two of them also found by "a"), none of "c"."""
    found = {"a": [{"id": i, "oppStatus": "posted" if i % 2 else "forecasted", "title": f"t{i}"} for i in range(1, 8)], "b": [{"id": i, "oppStatus": "posted"} for i in (7, 2, 50)], "c": []}

    def fetch(request):
        word, start, rows = request["keyword"], request["startRecordNum"], request["rows"]
        if word in counts_fail or (word, start) in broken and rows > 1:
            raise OSError(f"page {start} of {word} is down")
        hits = [h for h in found[word] if request.get("oppStatuses", h["oppStatus"]) == h["oppStatus"]]
        return {"hitCount": len(hits), "oppHits": hits[start : start + rows]}

    return fetch


def test_pages_are_planned_and_read_twice_alike(spark):
    hits = paged.search_pages(spark, library(), ["a", "b", "c", "a"], page=3)
    once, twice = (sorted(map(tuple, hits.collect()), key=str) for _ in range(2))
    assert once == twice and len(once) == 10
    assert hits.rdd.getNumPartitions() == 4  # 3 + 1 + 0 pages
    assert {(r["keyword"], r["page"]): r["n"] for r in hits.groupBy("keyword", "page").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 0): 3, ("a", 1): 3, ("a", 2): 1, ("b", 0): 3}
    assert paged.search_pages(spark, library(), ["a"], page=3, most=4).count() == 4


def test_a_failed_page_is_a_row(spark):
    hits = paged.search_pages(spark, library(broken={("a", 3)}, counts_fail={"b"}), ["a", "b"], page=3)
    failed = sorted((r["keyword"], r["page"], r["error"]) for r in paged.failed_pages(hits).collect())
    assert failed == [("a", 1, "OSError: page 3 of a is down"), ("b", 0, "OSError: page 0 of b is down")]
    assert hits.where("ok").count() == 4


def test_filters_reach_the_requests(spark):
    hits = paged.search_pages(spark, library(counts_fail={"b"}), ["a", "b"], page=3).where("keyword = 'a' and status = 'posted'")
    assert {r["status"] for r in hits.collect()} == {"posted"} and hits.count() == 4
    assert hits.rdd.getNumPartitions() == 2  # of 4 hits; b is never asked


def test_each_id_once_with_its_keywords(spark):
    words = ["b", "a", "c"]
    got = {r["id"]: (r["matched_terms"], '"title"' in r["hit"]) for r in paged.stubs(paged.search_pages(spark, library(), words, page=3), words).collect()}
    assert got["7"] == (["b", "a"], False) and got["2"] == (["b", "a"], False) and got["50"] == (["b"], False) and got["3"] == (["a"], True)
    assert len(got) == 8


def test_a_source_that_fails_while_it_runs_stops_no_other(spark):
    class Late(readers.SourceAdapter):
        def fetch(self, spark):
            return spark.range(3)

        def parse(self, payload):
            return payload.select(F.when(F.col("id") == 2, F.raise_error(F.lit("third row is bad"))).otherwise(F.col("id").cast("string")).cast("string").alias("opportunity_id"))

    class Good(readers.SourceAdapter):
        def fetch(self, spark):
            return spark.range(2)

        def parse(self, payload):
            return payload.select(F.col("id").cast("string").alias("opportunity_id"))

    r = readers.Registry()
    for a in (Late("late", "Late", "x"), Good("good", "Good", "x")):
        r.register(a)
    frames, runs = r.runs(spark)
    assert {x["slug"]: (x["ok"], "third row is bad" in (x["error"] or "")) for x in runs.collect()} == {"late": (False, True), "good": (True, False)}
    assert [sorted(x["opportunity_id"] for x in f.collect()) for f in frames] == [["0", "1"]]
    with pytest.raises(ValueError):
        r.register(Good("good", "Again", "x"))


def test_token_rows_are_the_tokens(spark):
    texts = [None, "", "Studies of the Größe, ponies' riding--and C++ .x. passed; classes 3.5-4 a", "the and of", "x" * 30 + "ing " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    whole = {r["k"]: sorted(r["w"]) for r in rows.select("k", tokens("t").alias("w")).collect()}
    each = {}
    for r in token_rows(rows, "t", "k").collect():
        each.setdefault(r["k"], []).append(r["term"])
    assert {k: sorted(v) for k, v in each.items()} == {k: v for k, v in whole.items() if v}


def test_containing(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd", 5), (2, "xaa bb ccx", 6), (3, "aa cc bb", 7), (4, None, 8)], "doc_id int, text string, n int")
    passages = spark.createDataFrame([(10, "aa bb cc"), (11, "bb"), (12, "zz bb yy")], "item int, passage string")
    got = containing(docs, passages, "doc_id")
    assert got.columns == ["doc_id", "text", "n", "item", "passage"]
    assert sorted((r["doc_id"], r["item"]) for r in got.collect()) == [(1, 10), (1, 11), (2, 10), (2, 11), (3, 11)]


def test_intermediate_folders_are_cleared(spark):
    from tabulon.session import clear, written

    clear(spark)
    frame = written(spark.range(3), "cleared")
    assert frame.count() == 3 and clear(spark) == 1 and clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        frame.collect()
