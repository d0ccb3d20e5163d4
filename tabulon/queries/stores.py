"""Stores, runs and sources whose state or structure is their point: snapshots, digests, exports, cards, exchange pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.queries.common import AS_OF, as_of, query, table
from tabulon.session import new_folder, written
from tabulon.sources import cards, exchange, exports, sinks
from tabulon.sources.store import Store, upsert
from tabulon.streaming import digests


@query(
    "state_roundtrip",
    """WITH a AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT o_custkey, a.k AS pinned, coalesce(b.k, a.k) AS newest, CAST(2 AS BIGINT) AS version FROM a FULL JOIN b USING (o_custkey)""",
)
def state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order in a store: a reader pinned before the second commit beside one after it."""
    o = table(spark, sf_dir, "orders")
    rows = o.groupBy("o_custkey", (F.col("o_orderkey") % 3 == 0).alias("later")).agg(F.max("o_orderkey").alias("last"))
    store = Store(spark, new_folder(spark, "store"), {"last_orders": "o_custkey long, last long"})
    pinned = store.commit(store.snapshot(), put={"last_orders": rows.where("not later").drop("later")})
    changes = rows.where("later").drop("later")
    newest = store.update(lambda at: {"last_orders": upsert(store.read("last_orders", at), changes, ["o_custkey"])})
    old = store.read("last_orders", pinned).withColumnRenamed("last", "pinned")
    both = old.join(store.read("last_orders", newest).withColumnRenamed("last", "newest"), "o_custkey", "full_outer")
    return both.withColumn("version", F.lit(newest.version).cast("long"))


#: Days of one run of ``digest_stream``, and items of one digest.
RUN_DAYS, DIGEST_ITEMS = 8, 5


@query(
    "digest_stream",
    f"""WITH RECURSIVE e AS (
      SELECT CAST(user_id AS VARCHAR) AS s, CAST(event_id AS VARCHAR) AS id, event_type = 'error' AS changed, (day(ts) - 1) // {RUN_DAYS} AS batch,
             CAST(ts AS DATE) - CAST(CASE WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 10 ELSE 0 END AS INT) AS d, value
      FROM events),
    days AS (SELECT (day(ts) - 1) // {RUN_DAYS} AS batch, max(CAST(ts AS DATE)) AS run_day FROM events GROUP BY 1),
    run AS (
      SELECT DISTINCT s, CAST(-1 AS BIGINT) AS batch, CAST(NULL AS DATE) AS last_run FROM e
      UNION ALL
      SELECT r.s, y.batch, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.s = r.s AND e.batch = y.batch AND e.d >= greatest(coalesce(r.last_run, y.run_day - 7), y.run_day - 7)) THEN y.run_day ELSE r.last_run END
      FROM run r JOIN days y ON y.batch = r.batch + 1),
    due AS (SELECT e.*, y.run_day, row_number() OVER (PARTITION BY e.s, e.batch ORDER BY value DESC, id) AS place
            FROM e JOIN days y ON y.batch = e.batch),
    fresh AS (SELECT f.* FROM due f JOIN run r ON r.s = f.s AND r.batch = f.batch - 1 WHERE d >= greatest(coalesce(r.last_run, run_day - 7), run_day - 7)),
    numbered AS (SELECT s AS subscription, CASE WHEN changed THEN 'amended' ELSE 'new' END AS kind, id, run_day,
                        row_number() OVER (PARTITION BY s, batch, changed ORDER BY CASE WHEN changed THEN d END DESC, CASE WHEN NOT changed THEN place END, id) AS position FROM fresh)
    SELECT subscription, kind, id, CAST(position AS INT) AS position, CAST(run_day AS DATE) AS run_day FROM numbered WHERE position <= {DIGEST_ITEMS}""",
)
def digest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every user's events as they come in, a stream run for each span of days; the last run is then given once more and must send nothing."""
    late = F.when(F.col("event_id") % 5 == 0, 3).when(F.col("event_id") % 7 == 0, 10).otherwise(0)
    kind = F.when(F.col("event_type") == "error", "amended").otherwise("new")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), kind.alias("kind"), F.col("event_id").cast("string").alias("record"), F.date_sub(F.col("ts").cast("date"), late).alias("changed_at"),
        F.col("user_id").cast("string").alias("user"), "value", F.col("ts").cast("date").alias("day"), F.floor((F.dayofmonth("ts") - 1) / RUN_DAYS).alias("batch"),
    )

    def ranked(batch: DataFrame) -> DataFrame:
        place = W.partitionBy("user").orderBy(F.desc("value"), "record")
        known_on = F.when(F.col("kind") == "new", F.col("changed_at"))
        return batch.select(F.col("user").alias("subscription"), "record", F.row_number().over(place).alias("position"), known_on.alias("known_on"))

    root = new_folder(spark, "digests")
    into = digests.store(spark, f"{root}/store")
    users = written(events.select(F.col("user").alias("subscription"), F.lit(None).cast("boolean").alias("active"), F.lit(True).alias("confirmed")).distinct(), "subscriptions")
    runs = digests.Digests(users, ranked, lambda batch: batch.agg(F.max("day")).first()[0], most=DIGEST_ITEMS)
    last = -(-31 // RUN_DAYS) - 1
    for number in range(last + 1):
        events.where(F.col("batch") == number).write.mode("append").parquet(f"{root}/events")
        runs.stream(spark.readStream.schema(events.schema).parquet(f"{root}/events"), into, f"{root}/checkpoint")
    runs.run(events.where(F.col("batch") == last), last, into)
    return into.read("outbox").select("subscription", "kind", "id", "position", "run_day")


@query(
    "digest_html",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS position FROM events QUALIFY position <= 6),
    l AS (SELECT *, '<a href="https://x/?a=1&amp;b=' || event_id || '">' || CASE WHEN event_id % 4 = 0 THEN 'Untitled opportunity' ELSE 'A &lt;b&gt; &amp; &#39;' || event_type || '&#39;' END || '</a>' AS link FROM s),
    t AS (SELECT user_id, position, event_id % 3 = 0 AS changed, CASE WHEN event_id % 3 = 0 THEN '<li><strong>' || CASE WHEN event_id % 2 = 0 THEN 'Opportunity update' ELSE 'Amended' END || ':</strong> ' || link || '<br>' || repeat('d', 240) || '</li>'
            ELSE '<li>' || link || '<br>' || CASE WHEN event_id % 5 = 0 THEN event_type ELSE event_type || ' · closes ' || strftime(ts, '%Y-%m-%d') END || '<br>' || repeat('d', 240) || '</li>' END AS line FROM l)
    SELECT user_id, count(*) FILTER (NOT changed) AS n_new, count(*) FILTER (changed) AS n_changed,
      '<!doctype html><html><body>' || coalesce('<h3>New matches</h3><ul>' || string_agg(line, '' ORDER BY position) FILTER (NOT changed) || '</ul>', '') || coalesce('<h3>Changes to matches you follow</h3><ul>' || string_agg(line, '' ORDER BY position) FILTER (changed) || '</ul>', '') || '</body></html>' AS body
    FROM t GROUP BY 1""",
)
def digest_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best six events of every user as an HTML digest."""
    e = F.col("event_id")
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), e))
    items = table(spark, sf_dir, "events").withColumn("position", place).where("position <= 6").select(
        "user_id", "position", F.when(e % 3 == 0, "amended").otherwise("new").alias("kind"), F.when(e % 4 != 0, F.concat(F.lit("A <b> & '"), "event_type", F.lit("'"))).alias("title"), F.concat(F.lit("https://x/?a=1&b="), e.cast("string")).alias("url"),
        F.when(e % 2 != 0, "Amended").alias("label"), F.repeat(F.lit("d"), F.lit(300)).alias("detail"), F.array("event_type", F.when(e % 5 != 0, F.concat(F.lit("closes "), F.date_format("ts", "yyyy-MM-dd")))).alias("meta"),
    )
    return sinks.digest_html(items, "user_id")


@query(
    "export_reviews",
    """WITH f AS (SELECT doc_id // 10 AS file, count(*) AS n, min(doc_id) AS first FROM labels GROUP BY 1),
    e AS (SELECT *, file % 7 AS review, file % 3 AS stamp, CASE WHEN file % 5 = 1 THEN 'not valid JSON' WHEN file % 11 = 2 THEN 'unsupported review schema' WHEN file % 13 = 3 THEN 'no review identifier' END AS error FROM f),
    good AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY stamp DESC, lpad(CAST(file AS VARCHAR), 9, '0') DESC) AS back FROM e WHERE error IS NULL)
    SELECT error, CAST(NULL AS VARCHAR) AS review_id, count(*) AS files, CAST(NULL AS BIGINT) AS verdicts, CAST(NULL AS BIGINT) AS accurate FROM e WHERE error IS NOT NULL GROUP BY error
    UNION ALL
    SELECT NULL, 'r' || review, 1, (SELECT count(*) FROM labels WHERE doc_id // 10 = file), (SELECT count(*) FROM labels WHERE doc_id // 10 = file AND quality = 1) FROM good WHERE back = 1""",
)
def export_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels exported as review files, some of them broken, and loaded again: errors a kind, and the newest export of every review."""
    labels = table(spark, sf_dir, "labels").withColumn("file", F.floor(F.col("doc_id") / 10))
    verdict = F.struct(F.col("doc_id").cast("string").alias("opportunity_id"), F.when(F.col("quality") == 1, "accurate").otherwise("incorrect").alias("status"))
    per = labels.groupBy("file").agg(F.collect_list(verdict).alias("source_reviews"))
    n = F.col("file")
    review = F.struct(F.when(n % 13 != 3, F.concat(F.lit("r"), (n % 7).cast("string"))).alias("review_id"), "source_reviews")
    body = F.struct(F.when(n % 11 == 2, 2).otherwise(1).alias("schema_version"), F.lit(exports.REVIEW_KIND).alias("kind"), (n % 3).cast("string").alias("exported_at"), review.alias("review"))
    text = F.to_json(body)
    files = per.select(F.lpad(n.cast("string"), 9, "0").alias("part"), F.when(n % 5 == 1, F.substring(text, 1, 40)).otherwise(text).alias("value"))
    root = new_folder(spark, "exports")
    files.repartition("part").write.partitionBy("part").text(root)
    found = written(exports.reviews(exports.files(spark, root, "*.txt")).withColumn("value", F.to_json("value")), "reviews")
    found = found.withColumn("value", F.try_parse_json("value"))
    failed = exports.failures(found).groupBy("error").agg(F.count(F.lit(1)).alias("files"))
    verdicts = exports.source_reviews(exports.newest_reviews(found)).groupBy("review_id").agg(F.count(F.lit(1)).alias("verdicts"), F.count_if(F.col("status") == "accurate").alias("accurate"))
    return failed.withColumn("review_id", F.lit(None).cast("string")).unionByName(verdicts.withColumn("files", F.lit(1)), allowMissingColumns=True)


@query(
    "export_judgments",
    """WITH j AS (SELECT doc_id, doc_id // 20 AS file, CASE WHEN toxic = 1 THEN 'not_relevant' WHEN quality = 1 THEN 'useful' ELSE 'partial' END AS label, doc_id % 20 + 1 AS rank FROM labels WHERE doc_id % 9 <> 0)
    SELECT file, label, count(*) AS n, count(*) FILTER (doc_id % 4 <> 0) AS ranked, count(*) FILTER (file % 3 = 0 AND doc_id % 2 = 0) AS listed, count(*) FILTER (file % 3 = 0 AND file IN (SELECT doc_id // 20 FROM labels WHERE doc_id % 2 = 0)) AS with_list, CAST(sum(rank) FILTER (doc_id % 4 <> 0) AS BIGINT) AS ranks
    FROM j WHERE file % 8 <> 5 GROUP BY 1, 2""",
)
def export_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels exported as evaluations, with candidate lists in every third file, unknown labels and ranks that are text, loaded again."""
    labels = table(spark, sf_dir, "labels")
    n = F.col("doc_id")
    label = F.when(n % 9 == 0, "splendid").when(F.col("toxic") == 1, "not_relevant").when(F.col("quality") == 1, "useful").otherwise("partial")
    rank = F.when(n % 4 == 0, F.to_json(F.array((n % 20 + 1).cast("string")))).otherwise(F.to_json(F.array(n % 20 + 1)))
    entry = F.concat(F.lit('{"opportunity_id":"'), n.cast("string"), F.lit('","label":"'), label, F.lit('","retrieval_rank":'), F.regexp_replace(rank, r"[\[\]]", ""), F.lit("}"))
    per = labels.withColumn("file", F.floor(n / 20)).groupBy("file").agg(F.array_join(F.collect_list(entry), ",").alias("entries"), F.collect_list(F.when(n % 2 == 0, n.cast("string"))).alias("even"))
    listed = F.when(F.col("file") % 3 == 0, F.col("even")).otherwise(F.array().cast("array<string>"))
    feedback = F.when(F.col("file") % 8 == 5, F.lit('"none"')).otherwise(F.concat(F.lit("["), F.col("entries"), F.lit("]")))
    text = F.concat(F.lit('{"schema_version":1,"session":{"candidate_ids":'), F.to_json(listed), F.lit('},"feedback":'), feedback, F.lit("}"))
    root = new_folder(spark, "exports")
    per.select(F.col("file").cast("string").alias("part"), text.alias("value")).repartition("part").write.partitionBy("part").text(root)
    found = exports.judgments(exports.evaluations(exports.files(spark, root, "*.txt")))
    file = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    ranked = F.col("retrieval_rank")
    return found.groupBy(file.alias("file"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.count(ranked).alias("ranked"), F.count_if("in_candidates").alias("listed"), F.count("in_candidates").alias("with_list"), F.sum(ranked).alias("ranks")
    )


@query(
    "competition_cards",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_custkey % 4 AS form, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
    c AS (SELECT * FROM o WHERE form < 2 OR form = 2 AND nth = 1)
    SELECT o_custkey, CASE WHEN o_orderkey = 0 THEN 'Call 0' ELSE CAST(o_orderkey AS VARCHAR) END AS external_id, 'Call ' || o_orderkey AS title, 'https://calls.example.edu/' || CASE WHEN o_orderkey = 0 THEN '' ELSE '#competitionDetail/' || o_orderkey END AS url,
      strftime(CAST(o_orderdate AS DATE) - CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT), '%Y-%m-%d') AS close_date FROM c""",
)
def competition_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payloads of cards: lists, wrapped lists, single objects and broken texts. Times of 03:00 UTC are of the day before in New York."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    hour = F.when(k % 2 == 0, " 03:00:00").otherwise(" 17:00:00")
    due = F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), hour)
    title = F.concat(F.lit("Call "), k.cast("string"))
    card = F.when(k % 3 == 0, F.to_json(F.struct(k.alias("opportunityId"), title.alias("title"), due.alias("dueDate")))).otherwise(
        F.to_json(F.struct(F.lit("").alias("title"), k.cast("string").alias("cardId"), title.alias("Title"), due.alias("applicationDeadline")))
    )
    lists = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", card.alias("card")))), lambda x: x["card"]).alias("cards"))
    joined = F.concat(F.lit("["), F.array_join("cards", ","), F.lit("]"))
    form = F.col("o_custkey") % 4
    text = F.when(form == 0, joined).when(form == 1, F.concat(F.lit('{"total": 9, "cards": '), joined, F.lit("}"))).when(form == 2, F.get("cards", F.lit(0))).otherwise(F.concat(joined, F.lit("]")))
    found = cards.competitions(lists.withColumn("payload", text), "o_custkey", "payload", "https://calls.example.edu/")
    return found.drop("description")


@query(
    "exchange_rows",
    f"""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) + 60 AS d2 FROM orders WHERE o_orderkey % 3 <> 1)
    SELECT o_custkey, 'DE-FOA-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS external_id, 'Studies of ' || o_orderkey || ' & more' AS title,
      CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Exchange' END AS agency,
      CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN d1 >= DATE '{AS_OF}' THEN d1 ELSE d2 END ELSE d1 END AS close_date,
      CASE WHEN o_orderkey % 3 = 0 AND d1 >= DATE '{AS_OF}' THEN strftime(d2, '%Y-%m-%d') || ' 5:00 PM' ELSE '' END AS later FROM o""",
)
def exchange_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as exchange pages: two dates, one of them far behind the type, or announcements of other types."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    guid = F.concat(F.lpad(F.hex(k), 8, "0"), F.lit("-0000-0000-0000-"), F.lpad(F.hex(k), 12, "0"))
    link = F.concat(F.lit('<a href="#FoaId'), guid, F.lit('">'))
    day = lambda d: F.date_format(d, "M/d/yyyy")
    kind = F.when(k % 3 == 1, "Notice of Intent to Publish a Notice Of Funding Opportunity (NOFO)").otherwise("<b>Notice Of Funding\n Opportunity</b> (NOFO)")
    gap = F.when(k % 3 == 2, " text" * 50).otherwise(" ")
    item = F.concat(
        F.lit("<li>"), link, F.lit("DE-FOA-"), F.lpad(k.cast("string"), 9, "0"), F.lit("</a>\n"), link, F.lit("Studies of "), k.cast("string"), F.lit(" &amp; more</a> "), kind,
        F.lit(" "), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(""), F.lit(" "), day("o_orderdate"), gap, day(F.date_add("o_orderdate", 60)), F.lit(" 5:00&nbsp;pm ET</li>"),
    )
    pages = o.groupBy("o_custkey").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(item), ""), F.lit("</ul>")).alias("html"))
    found = exchange.opportunities(exchange.rows_of(pages, "o_custkey", "html"), "o_custkey", as_of(), "Exchange")
    later = F.array_join(F.transform("additional_deadlines", lambda d: F.concat_ws(" ", d["date"], d["time"])), ",")
    return found.select("o_custkey", "external_id", "title", "agency", "close_date", later.alias("later"))
