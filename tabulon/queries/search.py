"""Index, search and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.text import STOP_WORDS, token_rows
from tabulon.operators.feedback import profile_terms
from tabulon.plans import index as ix
from tabulon.plans.search import Request, containing, numbered, order, page, ranked, search
from tabulon.queries.common import AS_OF, ORACLE, R, as_of, query, records, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _stem(t: str) -> str:
    n = f"length({t})"
    return (
        f"CASE WHEN {n} > 5 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y' WHEN {n} > 5 AND {t} LIKE '%ing' THEN {t}[:-4] "
        f"WHEN {n} > 4 AND {t} LIKE '%ed' THEN {t}[:-3] WHEN {n} > 4 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN {t}[:-2] ELSE {t} END"
    )


def _tokens(key: str, text: str, source: str, extra: str = "1") -> str:
    """SQL of (key, term, w): a row for each token of a text."""
    return f"""SELECT key, w, term FROM (
        SELECT key, w, {_stem("t")} AS term FROM (
            SELECT {key} AS key, {extra} AS w, trim(unnest(regexp_extract_all(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '[a-z0-9][a-z0-9+.-]+')), '.-') AS t FROM {source}))
        WHERE length(term) > 1 AND term NOT IN ({_STOP})"""


_DOC_INDEX = f"""
tok AS ({_tokens("doc_id", "text", "documents")}),
tf AS (SELECT key AS doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT d.doc_id, coalesce(sum(tf), 1) AS length FROM (SELECT doc_id FROM documents) d LEFT JOIN tf USING (doc_id) GROUP BY 1),
tot AS (SELECT count(*) AS n, round_even(avg(length), 3) AS avg_length FROM len),
voc AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) <= (SELECT greatest(1, floor(n * 0.8)) FROM tot)),
post AS (SELECT tf.*, df FROM tf JOIN voc USING (term))
"""
_FIELDS = [("text", 1)]


def _index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.build(table(spark, sf_dir, "documents"), "doc_id", _FIELDS)


@query("token_counts", f"WITH tok AS ({_tokens('doc_id', 'text', 'documents')}) SELECT key AS doc_id, count(*) AS n, count(DISTINCT term) AS n_distinct, min(term) AS first_term FROM tok GROUP BY 1")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: all, distinct ones, and the first in order."""
    terms = token_rows(table(spark, sf_dir, "documents"), "text", "doc_id").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return terms.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("term").alias("first_term"))


@query("index_lengths", f"WITH {_DOC_INDEX} SELECT doc_id, CAST(length AS BIGINT) AS length, n AS n_docs, avg_length FROM len, tot")
def index_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return i.lengths.join(F.broadcast(i.totals))


@query("index_vocabulary", f"WITH {_DOC_INDEX} SELECT term, df, CAST(sum(tf) AS BIGINT) AS total FROM post GROUP BY 1, 2")
def index_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark passages as exact queries (no prefixes)."""
    i = _index(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ix.top_documents(ix.bm25(i, asked), 32)


@query("bm25_top32")
def bm25_top32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 best documents of every benchmark passage, prefixes included."""
    return _bench(spark, sf_dir).select("query_id", "doc_id", "position", F.round("score", 6).alias("score"))


def _prefix_sql() -> str:
    return f"""WITH {_DOC_INDEX},
    q AS (SELECT DISTINCT key AS query_id, term AS asked FROM ({_tokens("item_id", "text", "benchmark")})),
    exact AS (SELECT query_id, asked, term, df, 1.0 AS weight FROM q JOIN voc ON asked = term),
    loose AS (SELECT DISTINCT asked FROM q WHERE length(asked) >= 3 AND asked NOT IN (SELECT term FROM voc)),
    found AS (SELECT asked, term, df, row_number() OVER (PARTITION BY asked ORDER BY term) AS nth FROM loose JOIN voc ON starts_with(term, asked)),
    terms AS (SELECT * FROM exact UNION ALL SELECT query_id, asked, term, df, 0.72 FROM q JOIN found USING (asked) WHERE nth <= 12)"""


@query("prefix_expansion", _prefix_sql() + " SELECT query_id, asked, term, df, CAST(weight AS DOUBLE) AS weight FROM terms")
def prefix_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ix.expand(asked, ix.vocabulary(_index(spark, sf_dir)))


ORACLE["bm25_top32"] = (
    _prefix_sql()
    + """, scored AS (SELECT query_id, doc_id, sum(weight * ln(1 + (n - t.df + 0.5) / (t.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score
           FROM terms t JOIN post USING (term) JOIN len USING (doc_id), tot GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS position FROM scored)
SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, round(score, 6) AS score FROM placed WHERE position <= 32"""
)


@query("recall_at_32")
def recall_at_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the (passage, document) containments, how many are among the 32 best."""
    top = _bench(spark, sf_dir).select("query_id", "doc_id")
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    held = containing(table(spark, sf_dir, "documents"), item, "doc_id").select("query_id", "doc_id")
    met = held.join(top.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


ORACLE["recall_at_32"] = (
    ORACLE["bm25_top32"].rsplit("SELECT query_id", 1)[0]
    + """, held AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT count(*) AS n, count(position) AS found, round(avg(CASE WHEN position IS NULL THEN 0 ELSE 1 END), 6) AS recall
FROM held LEFT JOIN (SELECT * FROM placed WHERE position <= 32) USING (query_id, doc_id)"""
)

_GATE = f"""lower(status) IN ('posted', 'forecasted') AND NOT regexp_matches(title, '^([A-Za-z0-9-]+\\s+)?notice\\s+of\\s+intent\\b', 'i')
  AND NOT (len(funding_instruments) = 1 AND description LIKE '%not accepting applications%')
  AND CASE WHEN close_date IS NOT NULL THEN close_date >= DATE '{AS_OF}' WHEN archive_date IS NOT NULL THEN archive_date >= DATE '{AS_OF}' ELSE true END"""


_REC_FIELDS = [("title", 7), ("opportunity_number", 7), ("agency", 3), ("topic_areas", 5), ("funding_instruments", 2), ("description", 1)]
_REQUEST = Request(query="building studies", filters={"agency": []}, sort="relevance")


def _search_sql(text: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT key, w, term FROM ({_tokens('opportunity_id', e, 'r', str(w))})"
        for e, w in (("title", 7), ("opportunity_number", 7), ("agency", 3), ("array_to_string(topic_areas, ' ')", 5), ("array_to_string(funding_instruments, ' ')", 2), ("description", 1))
    )
    low = text.lower()
    return f"""WITH {R},
    tf AS (SELECT key AS doc_id, term, sum(w) AS tf FROM ({parts}) GROUP BY 1, 2),
    len AS (SELECT r.opportunity_id AS doc_id, coalesce(sum(tf), 1) AS length FROM r LEFT JOIN tf ON doc_id = opportunity_id GROUP BY 1),
    tot AS (SELECT count(*) AS n, round_even(avg(length), 3) AS avg_length FROM len),
    voc AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) <= (SELECT greatest(1, floor(n * 0.8)) FROM tot)),
    q AS (SELECT DISTINCT term AS asked FROM ({_tokens("1", f"'{text}'", "(SELECT 1) one")})),
    terms AS (SELECT asked, term, df, 1.0 AS weight FROM q JOIN voc ON asked = term UNION ALL
              SELECT asked, term, df, 0.72 FROM (SELECT asked, term, df, row_number() OVER (PARTITION BY asked ORDER BY term) AS nth
                FROM q JOIN voc ON starts_with(term, asked) WHERE length(asked) >= 3 AND asked NOT IN (SELECT term FROM voc)) WHERE nth <= 12),
    bm AS (SELECT doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score
           FROM terms JOIN tf USING (term) JOIN len USING (doc_id), tot GROUP BY 1),
    base AS (SELECT r.*, coalesce(bm.score, 0) + CASE WHEN contains(lower(title), '{low}') THEN 12 ELSE 0 END
                    + CASE WHEN lower(coalesce(opportunity_number, '')) = '{low}' THEN 30 ELSE 0 END AS s
             FROM r LEFT JOIN bm ON doc_id = opportunity_id WHERE {_GATE}),
    hit AS (SELECT *, max(s) OVER () AS peak, date_diff('day', posted_date, DATE '{AS_OF}') AS age FROM base WHERE s > 0)
    SELECT opportunity_id, title, round(s + CASE WHEN s >= peak * 0.2 AND age BETWEEN 0 AND 14
             THEN peak + greatest(8, peak * 0.15 * (1 - age / 15)) ELSE 0 END, 4) AS score FROM hit"""


def _found(spark: SparkSession, sf_dir: str, request: Request) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("source_first_seen_date", F.lit(None).cast("date"))
    index = ix.build(rows, "opportunity_id", _REC_FIELDS) if request.query.strip() else None
    return search(rows, index, request, as_of())


@query("search_boosted", _search_sql("building studies"))
def search_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a text search with phrase and freshness boosts."""
    return _found(spark, sf_dir, _REQUEST).select("opportunity_id", "title", F.round("score", 4).alias("score"))


@query("search_prefix", _search_sql("furnit"))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that no record has, searched by its prefix expansions."""
    return _found(spark, sf_dir, Request(query="furnit")).select("opportunity_id", "title", F.round("score", 4).alias("score"))


@query(
    "search_filtered",
    f"""WITH {R} SELECT opportunity_id, agency, close_date, row_number() OVER (ORDER BY close_date NULLS LAST, opportunity_id) AS position FROM r
    WHERE {_GATE} AND list_has_any(topic_areas, ['BUILDING', '1-URGENT']) AND close_date BETWEEN DATE '1998-06-20' AND DATE '1998-08-31'
      AND greatest(award_ceiling, award_floor) >= 100000""",
)
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet, deadline and award filters without a text, in deadline order."""
    request = Request(filters={"topic_areas": ["BUILDING", "1-URGENT"]}, close_from="1998-06-20", close_to="1998-08-31", least_award=100_000, sort="deadline")
    found = numbered(_found(spark, sf_dir, request), order("deadline"), "position")
    return found.select("opportunity_id", "agency", "close_date", "position")


@query(
    "search_page_by_award",
    f"""WITH {R} SELECT opportunity_id, award_ceiling FROM r WHERE {_GATE}
    ORDER BY greatest(award_ceiling, award_floor) DESC NULLS LAST, opportunity_id LIMIT 20 OFFSET 20""",
)
def search_page_by_award(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page by award."""
    request = Request(sort="award", page=2)
    return page(_found(spark, sf_dir, request), request).select("opportunity_id", "award_ceiling")


@query(
    "newest_current",
    f"""WITH {R} SELECT opportunity_id, posted_date, title FROM r WHERE {_GATE}
    ORDER BY posted_date DESC NULLS LAST, title, opportunity_id LIMIT 50""",
)
def newest_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved search without a text: the newest current records."""
    return ranked(_found(spark, sf_dir, Request()), 50).select("opportunity_id", "posted_date", "title")


@query("profile_query_terms")
def profile_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile terms of every benchmark passage, weighted by rarity among the documents."""
    i = _index(spark, sf_dir)
    n = i.totals.first()["n_docs"]
    counts = ix.term_counts(table(spark, sf_dir, "benchmark"), "item_id", [("text", 1)]).select(F.col("doc_id").alias("item_id"), "term", F.col("tf").alias("count"), F.lit(2.2).alias("source_weight"))
    out = profile_terms(counts, ix.vocabulary(i), n, ["item_id"])
    return out.select("item_id", "term", F.round("weight", 6).alias("weight"), F.col("position").cast("long").alias("position"))


ORACLE["profile_query_terms"] = f"""WITH {_DOC_INDEX},
q AS (SELECT key AS item_id, term, count(*) AS c FROM ({_tokens("item_id", "text", "benchmark")}) GROUP BY 1, 2),
s AS (SELECT item_id, term, 2.2 * (1 + least(2.2, ln(1 + c))) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight FROM q JOIN voc USING (term), tot),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, term) AS position FROM s)
SELECT item_id, term, round(weight, 6) AS weight, position FROM p WHERE position <= 28"""
