"""Labels, states, reviews and listings over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import display
from tabulon.operators import state
from tabulon.queries.common import AS_OF, R, as_of, query, records, table
from tabulon.sources import listing


@query(
    "display_labels",
    f"""WITH {R} SELECT opportunity_id, CASE WHEN rolling AND close_date IS NULL THEN 'Rolling' WHEN rolling THEN 'Rolling through ' || strftime(close_date, '%b %-d, %Y')
      WHEN status = 'forecasted' AND close_date IS NOT NULL THEN 'Estimated ' || strftime(close_date, '%b %-d, %Y') ELSE coalesce(strftime(close_date, '%b %-d, %Y'), 'Not listed') END AS deadline,
      CASE WHEN len(funding_instruments) = 1 THEN 'O' ELSE 'G +1 more' END AS instruments, topic_areas[1] || ',' || funding_instruments[1] AS tags,
      date_diff('day', DATE '{AS_OF}', close_date) AS days_left FROM r""",
)
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(
        "opportunity_id",
        display.deadline_label(F.col("close_date"), F.col("rolling"), F.col("status") == "forecasted").alias("deadline"),
        display.some_of(F.col("funding_instruments"), 1).alias("instruments"),
        F.array_join(display.card_tags(F.slice("topic_areas", 1, 1), F.slice("funding_instruments", 1, 1)), ",").alias("tags"),
        display.days_until(F.col("close_date"), as_of()).cast("long").alias("days_left"),
    )


@query(
    "label_toggles",
    """WITH s AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels WHERE doc_id % 3 <> 0), c AS (SELECT doc_id, CAST(toxic AS VARCHAR) AS new FROM labels WHERE doc_id % 2 = 0)
    SELECT doc_id, coalesce(new, label) AS label FROM s FULL JOIN c USING (doc_id) WHERE NOT coalesce(new = label, false)""",
)
def label_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as a state, toxicity labels as changes to it."""
    rows = table(spark, sf_dir, "labels").withColumn("at", F.col("doc_id"))
    old = rows.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").cast("string").alias("label"), "at")
    new = rows.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").cast("string").alias("label"), "at")
    return state.toggle_labels(old, new, ["doc_id"]).select("doc_id", "label")


@query(
    "usage_totals",
    """SELECT user_id, event_type, CAST(least(sum(CASE WHEN event_id % 2 = 0 THEN 40 ELSE greatest(0, event_id % 7 - 3) END), 500) AS BIGINT) AS n FROM events GROUP BY 1, 2""",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    old = events.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.sum(F.lit(40)).alias("n"))
    new = events.where("event_id % 2 <> 0").select("user_id", "event_type", (F.col("event_id") % 7 - 3).alias("by"))
    return state.add_usage(old, new, ["user_id", "event_type"], 500)


@query(
    "saved_newest",
    """WITH l AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS position FROM l QUALIFY position <= 3""",
)
def saved_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order of every priority, at most three."""
    out = state.newest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_orderkey"), 3)
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("long").alias("position"))


@query(
    "review_accuracy",
    """WITH v AS (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'accurate' WHEN quality = 0 THEN 'incorrect' ELSE 'unclear' END AS s FROM labels JOIN documents USING (doc_id))
    SELECT source, count(*) AS reviews, count(*) FILTER (s = 'accurate') AS accurate, count(*) FILTER (s = 'incorrect') AS incorrect,
      round(count(*) FILTER (s = 'accurate') / nullif(count(*) FILTER (s <> 'unclear'), 0), 6) AS accuracy FROM v GROUP BY 1""",
)
def review_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accurate").when(F.col("quality") == 0, "incorrect").otherwise("unclear")
    return state.review_summary(rows.withColumn("status", verdict), ["source"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "listing_entries",
    """SELECT c_custkey, c_name || ' ' || CAST(o_orderkey AS VARCHAR) AS title, 'https://lists.example.org/' || CAST(o_orderkey AS VARCHAR) AS url, CAST(o_orderdate AS DATE) AS due, o_orderpriority AS sponsor
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def listing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as one HTML listing a customer and read as records."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey").cast("string")
    item = F.concat(
        F.lit("<h3><a class='x' href='https://lists.example.org/"), k, F.lit("'>"), F.col("c_name"), F.lit(" "), k, F.lit("</a></h3><p>Sponsor: <b>"), F.col("o_orderpriority"),
        F.lit("</b></p><p>Deadline: "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</p>"),
    )
    pages = o.groupBy("c_custkey").agg(F.array_join(F.collect_list(item), "").alias("html"))
    out = listing.records(pages, "c_custkey", listing.keep_links(F.col("html")), {"due": ["deadline", "due date"], "sponsor": ["sponsor", "agency"]}, ["due"])
    return out.select("c_custkey", "title", "url", "due", "sponsor")
