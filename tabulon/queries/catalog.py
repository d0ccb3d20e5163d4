"""Gates, identity, merges, facets, changes and feeds over the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.text import slug, title_key
from tabulon.operators import changes, facets, gates
from tabulon.operators import records as rec
from tabulon.queries.common import AS_OF, R, as_of, query, records, table

#: Titles that begin with it, behind one code at most; elsewhere the words say nothing.
_NOTICE = r"regexp_matches(title, '^([A-Za-z0-9-]+\s+)?(notice\s+of\s+intent\b|request\s+for\s+information\b|RFI\s*[-:])', 'i')"
_OTHER = "list_sort(funding_instruments) = ['O'] AND description LIKE '%not accepting applications%'"
_REASON = f"""CASE WHEN lower(status) IN ('closed', 'archived', 'cancelled', 'canceled', 'withdrawn', 'expired') THEN lower(status)
  WHEN status NOT IN ('posted', 'forecasted') THEN 'invalid_status' WHEN {_NOTICE} THEN 'informational_notice' WHEN {_OTHER} THEN 'not_accepting_applications'
  WHEN close_date < DATE '{{d}}' THEN 'expired' WHEN close_date IS NOT NULL THEN 'current_by_close_date' WHEN archive_date < DATE '{{d}}' THEN 'archived'
  WHEN rolling THEN 'rolling' ELSE 'undated_verify_status' END"""
_NOW = _REASON.format(d=AS_OF)
_OK = "('current_by_close_date', 'rolling', 'undated_verify_status')"


@query("gate_runtime", f"WITH {R} SELECT opportunity_id, {_NOW} AS reason, {_NOW} IN {_OK} AS is_current FROM r")
def gate_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = gates.runtime_reason(as_of())
    return records(spark, sf_dir).select("opportunity_id", reason.alias("reason")).withColumn("is_current", gates.reason_is_current(F.col("reason")))


@query("gate_split_counts", f"WITH {R} SELECT {_NOW} AS reason, count(*) AS n FROM r WHERE {_NOW} NOT IN {_OK} GROUP BY 1")
def gate_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = gates.split_current(records(spark, sf_dir), as_of())
    return out.groupBy(F.col("currentness_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "gate_ingest",
    f"""WITH {R} SELECT opportunity_id, CASE WHEN {_NOTICE} OR {_OTHER} THEN false WHEN close_date IS NOT NULL THEN close_date >= DATE '{AS_OF}'
      WHEN archive_date IS NOT NULL THEN archive_date >= DATE '{AS_OF}'
      WHEN status = 'forecasted' THEN NOT (coalesce(CAST(fiscal_year AS INT) < 1998, false)
        OR coalesce(greatest(estimated_award_date, estimated_project_start) < DATE '{AS_OF}', false)
        OR coalesce(date_diff('day', last_updated, DATE '{AS_OF}') > 548, false)) ELSE true END AS is_current FROM r""",
)
def gate_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("opportunity_id", gates.ingest_is_current(as_of()).alias("is_current"))


@query(
    "gate_publish",
    f"""WITH {R} SELECT opportunity_id, CASE WHEN ordinal % 19 < 9 AND coalesce(funding_opportunity_url, primary_document_url) IS NULL THEN 'missing_official_url'
      WHEN close_date < DATE '{AS_OF}' THEN 'expired' WHEN date_diff('day', DATE '{AS_OF}', close_date) > 2196 THEN 'implausible_future_date' ELSE 'ok' END AS reason FROM r""",
)
def gate_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("detail_page", F.when(F.col("ordinal") % 19 >= 9, F.col("detail_page")))
    return rows.select("opportunity_id", F.coalesce(gates.publish_reason(as_of()), F.lit("ok")).alias("reason"))


_ID = "CASE WHEN opportunity_number IS NOT NULL THEN 'number:' || lower(replace(opportunity_number, ' ', '')) ELSE 'id:' || opportunity_id END"


@query(
    "dedup_best_rank",
    f"""WITH {R}, k AS (SELECT *, {_ID} AS key FROM r)
    SELECT key, opportunity_id FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY (status = 'posted') DESC, CAST(last_updated AS VARCHAR) DESC, version DESC, ordinal) = 1""",
)
def dedup_best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rec.keep_best(records(spark, sf_dir), rec.identity(), rec.rank(), F.col("ordinal"))
    return kept.select(rec.identity().alias("key"), "opportunity_id")


@query("dedup_last_wins", f"WITH {R} SELECT agency, opportunity_id FROM r QUALIFY row_number() OVER (PARTITION BY agency ORDER BY ordinal DESC) = 1")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.last_wins(records(spark, sf_dir), F.col("agency"), F.col("ordinal")).select("agency", "opportunity_id")


_SPLIT = f"""{R}, base AS (SELECT * FROM r WHERE ordinal % 3 <> 0), ext AS (SELECT *, {_ID} AS key FROM r WHERE ordinal % 3 = 0),
left_over AS (SELECT * FROM ext WHERE key NOT IN (SELECT {_ID} FROM base)
  AND coalesce(lower(opportunity_number), '') NOT IN (SELECT lower(opportunity_number) FROM base WHERE opportunity_number IS NOT NULL)
  AND trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) NOT IN (SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) FROM base)),
added AS (SELECT * FROM left_over QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal) = 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, sf_dir)
    # titles of the external side differ from all of base for one in six
    own = F.when(F.col("ordinal") % 18 == 0, F.concat(F.col("title"), F.lit(" "), F.col("opportunity_id"))).otherwise(F.col("title"))
    return rows.where("ordinal % 3 <> 0"), rows.where("ordinal % 3 = 0").withColumn("title", own)


_SPLIT = _SPLIT.replace("ext AS (SELECT *,", "ext AS (SELECT * REPLACE (CASE WHEN ordinal % 18 = 0 THEN title || ' ' || opportunity_id ELSE title END AS title),")


@query("merge_sources", f"WITH {_SPLIT} SELECT opportunity_id, 'base' AS origin FROM base UNION ALL SELECT opportunity_id, 'external' FROM added")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, external = _sides(spark, sf_dir)
    return rec.merge_sources(base, external, F.col("ordinal")).select("opportunity_id", "origin")


@query(
    "merge_summary",
    f"""WITH {_SPLIT} SELECT (SELECT count(*) FROM base) AS base_count, (SELECT count(*) FROM added) AS external_added,
      (SELECT count(*) FROM base) + (SELECT count(*) FROM added) AS final_count, (SELECT count(*) FROM ext) AS external_considered,
      (SELECT count(*) FROM ext WHERE key IN (SELECT {_ID} FROM base)) AS in_base_by_identity""",
)
def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, external = _sides(spark, sf_dir)
    return rec.merge_summary(base, external, rec.merge_sources(base, external, F.col("ordinal")))


_SOURCES = f"""{R}, s AS (SELECT *, agency AS slug, ordinal % 2 = 0 AS is_fetched FROM r),
runs AS (SELECT DISTINCT agency AS slug, ascii(agency) % 5 <> 0 AS ok, 20 + ascii(agency) % 7 * 5 AS low FROM r),
good AS (SELECT * FROM s WHERE is_fetched AND (close_date IS NULL OR close_date >= DATE '{AS_OF}')),
st AS (SELECT runs.slug, ok, coalesce(kept, 0) AS kept, ok AND coalesce(kept, 0) >= low AS healthy
       FROM runs LEFT JOIN (SELECT slug, count(*) AS kept FROM good GROUP BY 1) g USING (slug))"""


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, sf_dir).withColumn("slug", F.col("agency"))
    first = F.ascii("agency")
    runs = rows.select("slug", (first % 5 != 0).alias("ok"), (20 + first % 7 * 5).alias("min_records"), F.lit(None).cast("long").alias("max_records")).distinct()
    seen = F.date_sub("posted_date", 3)
    old = rows.where("ordinal % 2 <> 0 or ordinal % 4 = 0").withColumns({"source_first_seen_date": seen, "fetched_at": F.to_date(F.lit("1998-06-01"))})
    return rec.refresh_sources(rows.where("ordinal % 2 = 0"), runs, old, as_of())


@query(
    "source_status",
    f"WITH {_SOURCES} SELECT slug, CASE WHEN healthy THEN 'refreshed' WHEN ok THEN 'unhealthy_kept_last_good' ELSE 'failed_kept_last_good' END AS status, kept, healthy FROM st",
)
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[1]


@query(
    "source_refresh",
    f"""WITH {_SOURCES}, old AS (SELECT slug, min(posted_date) AS p, {_ID} AS key FROM s WHERE NOT is_fetched OR ordinal % 4 = 0 GROUP BY slug, key)
    SELECT g.opportunity_id, CAST(coalesce(o.p - INTERVAL 3 DAY, DATE '1998-06-01') AS DATE) AS first_seen FROM (SELECT *, {_ID} AS key FROM good) g JOIN st USING (slug)
      LEFT JOIN old o USING (slug, key) WHERE healthy
    UNION ALL SELECT opportunity_id, CAST(posted_date - INTERVAL 3 DAY AS DATE) FROM s JOIN st USING (slug)
      WHERE NOT healthy AND (NOT is_fetched OR ordinal % 4 = 0) AND (close_date IS NULL OR close_date >= DATE '{AS_OF}')""",
)
def source_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[0].select("opportunity_id", F.col("source_first_seen_date").alias("first_seen"))


_FACETS = {"agency": "agency", "status": "status", "topic": "topic_areas", "instrument": "funding_instruments"}


def _facet_sql(each: str) -> str:
    return f"""WITH {R}, p AS (SELECT 'agency' AS facet, agency AS value FROM r UNION ALL SELECT 'status', status FROM r
      UNION ALL SELECT 'topic', unnest({each}(topic_areas)) FROM r UNION ALL SELECT 'instrument', unnest({each}(funding_instruments)) FROM r)
      SELECT facet, value, count(*) AS n FROM p GROUP BY 1, 2"""


@query("facet_counts", _facet_sql(""))
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_counts(records(spark, sf_dir), _FACETS)


@query("facet_counts_distinct", _facet_sql("list_distinct"))
def facet_counts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_counts(records(spark, sf_dir), _FACETS, distinct=True)


@query(
    "facet_page",
    f"""WITH {R} SELECT 'topic' AS facet, v AS value, count(*) AS n, v = 'MACHINERY' AS chosen FROM (SELECT unnest(topic_areas) AS v FROM r)
      WHERE contains(lower(v), 'i') GROUP BY v ORDER BY v = 'MACHINERY' DESC, n DESC, v LIMIT 5""",
)
def facet_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_page(facets.facet_counts(records(spark, sf_dir), {"topic": "topic_areas"}), "topic", ["MACHINERY"], "i", 5)


@query("document_facets", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def document_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_counts(table(spark, sf_dir, "documents"), {"lang": "lang", "source": "source"})


@query(
    "quality_metrics",
    f"""WITH {R} SELECT agency, count(*) AS records, count(*) FILTER (close_date IS NOT NULL) AS dated, count(*) FILTER (award_floor IS NOT NULL OR award_ceiling IS NOT NULL) AS with_award,
      count(*) FILTER (rolling) AS rolling, count(*) FILTER (primary_document_url IS NOT NULL) AS route_direct,
      count(*) FILTER (primary_document_url IS NULL AND funding_opportunity_url IS NOT NULL) AS route_agency,
      count(*) FILTER (primary_document_url IS NULL AND funding_opportunity_url IS NULL) AS route_record FROM r GROUP BY 1""",
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = facets.routes()
    checks = {
        "dated": F.col("close_date").isNotNull(),
        "with_award": F.col("award_floor").isNotNull() | F.col("award_ceiling").isNotNull(),
        "rolling": F.col("rolling"),
        **{f"route_{k}": route == k for k in ("direct", "agency", "record")},
    }
    return facets.conditional_counts(records(spark, sf_dir), checks, ["agency"])


@query("title_keys", f"WITH {R} SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(agency), '[^a-z0-9]+', '-', 'g'), '-') AS agency_slug, count(*) AS n FROM r GROUP BY 1, 2")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy(title_key("title").alias("title_key"), slug("agency").alias("agency_slug")).agg(F.count(F.lit(1)).alias("n"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the records: some are missing, moved, updated or closed in the second."""
    rows = records(spark, sf_dir).where("status <> 'draft'").withColumn("last_updated", F.col("posted_date"))
    before = rows.where("ordinal % 19 <> 0")
    moved = F.when(F.col("ordinal") % 23 == 0, F.date_add("close_date", 10)).otherwise(F.col("close_date"))
    newer = F.when(F.col("ordinal") % 29 == 0, F.lit("99")).otherwise(F.col("version"))
    ended = F.when(F.col("ordinal") % 41 == 0, F.lit("closed")).otherwise(F.col("status"))
    return before, rows.where("ordinal % 17 <> 0").withColumns({"close_date": moved, "version": newer, "status": ended})


_DIFF = f"""WITH {R}, rows_ AS (SELECT * FROM r WHERE status <> 'draft'),
b AS (SELECT *, {_REASON.format(d="1998-06-14")} IN {_OK} AS was_open FROM rows_ WHERE ordinal % 19 <> 0),
c0 AS (SELECT * REPLACE (CASE WHEN ordinal % 23 = 0 THEN CAST(close_date + INTERVAL 10 DAY AS DATE) ELSE close_date END AS close_date,
                         CASE WHEN ordinal % 29 = 0 THEN '99' ELSE version END AS version, CASE WHEN ordinal % 41 = 0 THEN 'closed' ELSE status END AS status)
       FROM rows_ WHERE ordinal % 17 <> 0),
c AS (SELECT *, {_NOW} IN {_OK} AS is_open FROM c0),
j AS (SELECT coalesce(c.opportunity_id, b.opportunity_id) AS k, b.opportunity_id IS NOT NULL AS there, c.opportunity_id IS NOT NULL AS here, b.close_date AS oc, c.close_date AS nc,
             b.version AS ov, c.version AS nv, c.status AS ns, coalesce(was_open, false) AS was_open, coalesce(is_open, false) AS is_open
      FROM b FULL JOIN c ON b.opportunity_id = c.opportunity_id),
e AS (SELECT k, 'new' AS kind, 'First appeared in the public catalog' AS detail FROM j WHERE is_open AND NOT there
  UNION ALL SELECT k, 'deadline_changed', coalesce(strftime(oc, '%Y-%m-%d'), 'not listed') || ' → ' || coalesce(strftime(nc, '%Y-%m-%d'), 'not listed') FROM j WHERE is_open AND there AND oc IS DISTINCT FROM nc
  UNION ALL SELECT k, 'amended', 'Official source record changed' FROM j WHERE is_open AND there AND ov IS DISTINCT FROM nv
  UNION ALL SELECT k, 'closing_soon', 'Deadline ' || strftime(nc, '%Y-%m-%d') FROM j WHERE is_open AND nc BETWEEN DATE '1998-06-15' AND DATE '1998-07-15'
     AND NOT coalesce(oc BETWEEN DATE '1998-06-14' AND DATE '1998-07-14', false)
  UNION ALL SELECT k, 'closed_or_removed', CASE WHEN here THEN 'Official status is ' || ns ELSE 'No longer in the current catalog' END FROM j WHERE was_open AND NOT is_open)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff_snapshots(*_snapshots(spark, sf_dir), as_of())


@query("snapshot_diff", _DIFF + f" SELECT k AS record_key, kind, detail, substr(sha1(kind || '|' || k || '|{AS_OF}|' || detail), 1, 20) AS event_id FROM e")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("record_key", "kind", "detail", "event_id")


@query("change_counts", _DIFF + " SELECT kind, count(*) AS n FROM e GROUP BY 1")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "history_merge",
    """WITH prior AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS kind, CAST(ts AS DATE) AS changed_at FROM events WHERE event_id % 3 <> 0),
    new AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'rewritten' AS kind, CAST(ts AS DATE) AS changed_at FROM events WHERE event_id % 5 = 0)
    SELECT * FROM (SELECT * FROM new UNION ALL SELECT * FROM prior WHERE event_id NOT IN (SELECT event_id FROM new)) WHERE changed_at >= DATE '2024-01-11'""",
)
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of 20 days and upsert over the event table."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("changed_at"), F.col("event_id").alias("n"))
    prior = rows.where("n % 3 <> 0").drop("n")
    new = rows.where("n % 5 = 0").drop("n").withColumn("kind", F.lit("rewritten"))
    return changes.merge_history(prior, new, F.to_date(F.lit("2024-01-31")), 20)


@query(
    "feed_positions",
    f"""WITH {R}, s AS (SELECT *, unnest(list_distinct(topic_areas)) AS feed FROM r WHERE {_NOW} IN {_OK})
    SELECT feed, opportunity_id, row_number() OVER (PARTITION BY feed ORDER BY posted_date DESC NULLS LAST, opportunity_id) AS position FROM s QUALIFY position <= 60""",
)
def feed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = gates.split_current(records(spark, sf_dir), as_of())
    out = changes.feeds(kept, F.col("topic_areas"), F.col("posted_date"), F.col("opportunity_id"))
    return out.select("feed", "opportunity_id", F.col("position").cast("long").alias("position"))


@query(
    "digest_updates",
    _DIFF
    + f""", ranked AS (SELECT opportunity_id FROM r WHERE list_contains(topic_areas, 'BUILDING')), seen AS (SELECT opportunity_id FROM r WHERE ordinal % 2 = 0),
    ids AS (SELECT k AS record_key, kind, substr(sha1(kind || '|' || k || '|{AS_OF}|' || detail), 1, 20) AS event_id FROM e)
    SELECT event_id, record_key, kind FROM ids WHERE right(event_id, 1) <> '0'
      AND CASE WHEN kind = 'closed_or_removed' THEN record_key IN (SELECT opportunity_id FROM seen) ELSE record_key IN (SELECT opportunity_id FROM ranked) END
    ORDER BY event_id LIMIT 25""",
)
def digest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events for a subscription to one topic, some sent before."""
    events, rows = _events(spark, sf_dir), records(spark, sf_dir)
    matched = rows.where(F.array_contains("topic_areas", "BUILDING")).select(F.col("opportunity_id").alias("record_key"))
    seen = rows.where("ordinal % 2 = 0").select(F.col("opportunity_id").alias("record_key"))
    sent = events.where(F.col("event_id").endswith("0"))
    since = changes.digest_since(F.lit(None).cast("date"), as_of())
    return changes.select_updates(events, matched, seen, sent, since).select("event_id", "record_key", "kind")
