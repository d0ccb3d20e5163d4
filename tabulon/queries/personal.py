"""Personal search, outside rankings, natural order, packages, and evidence merged into records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.collation import natural_key
from tabulon.operators import feedback, merging, privacy, reranking
from tabulon.plans import index as ix
from tabulon.plans.personal import Profile, search_personal as personal
from tabulon.plans.search import Request, numbered
from tabulon.queries.common import AS_OF, as_of, query, records, table
from tabulon.queries.search import _GATE, _REC_FIELDS, _search_sql, _tokens

_PROFILE = Profile({"research_description": "Automobile and furniture, automobile training", "expertise_keywords": "machinery studies"}, "higher_education", "early_career")
_LABEL = "CASE WHEN ordinal % 40 = 3 THEN 'strong' WHEN ordinal % 40 = 7 THEN 'partial' WHEN ordinal % 40 IN (5, 9) THEN 'not_relevant' END"


def _personal_sql(text: str, profile_text: str) -> str:
    head = _search_sql(text).split("q AS (SELECT DISTINCT", 1)[0]

    def scored(name: str, words: str) -> str:
        return f"""{name}_q AS (SELECT DISTINCT term AS asked FROM ({_tokens("1", f"'{words}'", "(SELECT 1) one")})),
        {name} AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score
          FROM {name}_q JOIN voc ON asked = term JOIN tf USING (term) JOIN len USING (doc_id), tot GROUP BY 1)"""

    return f"""{head} {scored("direct", text)}, {scored("profile", profile_text)},
    labels_ AS (SELECT agency, unnest(['agency:' || agency, 'topic:' || topic_areas[1]]) AS feature, CASE WHEN ordinal % 40 = 3 THEN 2.0 WHEN ordinal % 40 = 7 THEN 0.3 ELSE -1.5 END AS w FROM r WHERE {_LABEL} IS NOT NULL),
    model AS (SELECT feature, sum(w) / 10 AS weight FROM labels_ GROUP BY 1),
    liked AS (SELECT opportunity_id, greatest(-0.5, least(1.0, sum(coalesce(weight, 0)) / 4)) AS pref
              FROM (SELECT opportunity_id, unnest(['agency:' || agency, 'topic:' || topic_areas[1]]) AS feature FROM r) LEFT JOIN model USING (feature) GROUP BY 1),
    base AS (SELECT r.*, pref, coalesce(d.score, 0) + CASE WHEN contains(lower(title), '{text.lower()}') THEN 12 ELSE 0 END AS ds, coalesce(p.score, 0) AS ps,
                    CASE ordinal % 4 WHEN 0 THEN 0 WHEN 1 THEN 2.4 WHEN 2 THEN 0.8 ELSE -0.8 END + CASE WHEN ordinal % 5 = 0 THEN 2.6 ELSE 0 END AS bonus
             FROM r JOIN liked USING (opportunity_id) LEFT JOIN direct d ON d.doc_id = opportunity_id LEFT JOIN profile p ON p.doc_id = opportunity_id WHERE {_GATE}),
    mixed AS (SELECT *, CASE WHEN 2 * ds + ps + bonus = 0 THEN pref ELSE (2 * ds + ps + bonus) * (1 + pref) END AS s FROM base WHERE ds > 0),
    hit AS (SELECT *, greatest(0, max(s) OVER ()) AS peak, date_diff('day', posted_date, DATE '{AS_OF}') AS age FROM mixed),
    lifted AS (SELECT *, CASE WHEN s > 0 AND peak > 0 AND s >= peak * 0.2 AND age BETWEEN 0 AND 14 THEN peak + greatest(8, peak * 0.15 * (1 - age / 15)) ELSE 0 END AS boost FROM hit)
    SELECT opportunity_id, round(ds, 4) AS direct, round(ps, 4) AS profile_score, CAST(bonus AS DOUBLE) AS bonus, CAST(round(pref, 6) AS DOUBLE) AS preference, round(s + boost, 4) AS score, boost > 0 AS is_boosted FROM lifted"""


@query("search_personal", _personal_sql("building studies", "Automobile and furniture, automobile training machinery studies"))
def search_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text search with a profile, likes by agency and topic, applicant and career fit."""
    n = F.col("ordinal")
    types = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("Public institutions of higher education"))).when(n % 4 == 2, F.array(F.lit("Unrestricted"))).otherwise(F.array(F.lit("Small business")))
    rows = records(spark, sf_dir).withColumns({"source_first_seen_date": F.lit(None).cast("date"), "applicant_types": types, "career_stage_signal": n % 5 == 0})
    facets = F.array(F.concat(F.lit("agency:"), "agency"), F.concat(F.lit("topic:"), F.get("topic_areas", F.lit(0))))
    model = feedback.preference_model(rows.withColumn("label", F.expr(_LABEL)).where("label is not null"), facets).withColumn("weight", F.col("weight") / 10)
    found = personal(rows, ix.build(rows, "opportunity_id", _REC_FIELDS), Request(query="building studies"), as_of(), _PROFILE, model, facets)
    return found.select("opportunity_id", F.round("direct", 4).alias("direct"), F.round("profile_score", 4).alias("profile_score"), "bonus", F.round("preference", 6).alias("preference"), F.round("score", 4).alias("score"), "is_boosted")


@query(
    "validated_ranking",
    """WITH own AS (SELECT user_id, CAST(event_id AS VARCHAR) AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS candidate FROM events QUALIFY candidate <= 32),
    named AS (SELECT user_id, CAST(event_id AS VARCHAR) AS id, event_id * 7919 % 1009 * 100000 + event_id AS place, event_id % 140 - 20 AS score, CASE WHEN event_id % 2 = 0 THEN 'Strong fit' ELSE '' END AS verdict FROM events WHERE event_id % 3 = 0
              UNION ALL SELECT user_id, CAST(event_id AS VARCHAR), 900000000 + event_id, 99, 'Weak fit' FROM events WHERE event_id % 6 = 0
              UNION ALL SELECT user_id, 'x' || event_id, event_id, 100, 'Strong fit' FROM events WHERE event_id % 5 = 0),
    firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY place) = 1),
    placed AS (SELECT o.user_id, o.id, row_number() OVER (PARTITION BY o.user_id ORDER BY place IS NULL, place, candidate) AS position, greatest(0, least(100, score)) AS score,
                      CASE WHEN place IS NOT NULL THEN coalesce(nullif(verdict, ''), 'Possible fit') END AS verdict, CASE WHEN place IS NULL THEN 'own' ELSE 'answer' END AS origin, place
               FROM own o LEFT JOIN firsts f ON f.user_id = o.user_id AND f.id = o.id)
    SELECT user_id, id, CAST(position AS INT) AS position, CASE WHEN place IS NOT NULL THEN CAST(score AS INT) END AS score, verdict, origin FROM placed WHERE position <= 12""",
)
def validated_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's best events, re-ranked by an answer with unknown, repeated and missing ids."""
    events, e = table(spark, sf_dir, "events"), F.col("event_id")
    own = reranking.candidates(events.select("user_id", e.cast("string").alias("id"), "value", "event_id"), ["user_id"], [F.desc("value"), e])
    parts = [
        events.where(e % 3 == 0).select("user_id", e.cast("string").alias("id"), (e * 7919 % 1009 * 100000 + e).alias("place"), (e % 140 - 20).cast("string").alias("score"), F.when(e % 2 == 0, "Strong fit").otherwise("").alias("verdict")),
        events.where(e % 6 == 0).select("user_id", e.cast("string").alias("id"), (e + 900000000).alias("place"), F.lit("99").alias("score"), F.lit("Weak fit").alias("verdict")),
        events.where(e % 5 == 0).select("user_id", F.concat(F.lit("x"), e.cast("string")).alias("id"), e.alias("place"), F.lit("100").alias("score"), F.lit("Strong fit").alias("verdict")),
    ]
    answers = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return reranking.reranked(own, answers, ["user_id"], "id", fill=True)


@query(
    "natural_positions",
    """WITH n AS (SELECT c_custkey, c_custkey // 4 AS number, c_custkey % 4 AS form FROM customer)
    SELECT c_custkey, ['item ', 'Item ', 'ítem ', 'Ítem 00'][form + 1] || number AS label, row_number() OVER (ORDER BY number, form) AS position FROM n""",
)
def natural_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with numbers, cases and accents in natural order, numbered over sorted ranges."""
    k = F.col("c_custkey")
    form = F.element_at(F.array(*map(F.lit, ("item ", "Item ", "ítem ", "Ítem 00"))), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(form, F.floor(k / 4).cast("string")).alias("label"))
    keyed = rows.withColumn("key", natural_key("label"))
    return numbered(keyed, [F.col("key").asc_nulls_last(), k], "position").drop("key")


#: What may leave of a customer's review.
_PACKAGE = "schema_version int, review struct<review_id:string,usage:map<string,struct<n:bigint>>,source_reviews:array<struct<opportunity_id:string,status:string>>>"


@query(
    "privacy_package",
    """SELECT o_custkey, CAST(to_json({'schema_version': 1, 'review': {'review_id': 'r' || o_custkey, 'usage': MAP {'searches': {'n': count(*)}},
      'source_reviews': list({'opportunity_id': CAST(o_orderkey AS VARCHAR), 'status': o_orderstatus} ORDER BY o_orderkey)}}) AS VARCHAR) AS payload FROM orders GROUP BY o_custkey""",
)
def privacy_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews with private fields at every depth, of which only the package's own fields leave."""
    o = table(spark, sf_dir, "orders")
    one = F.struct(F.col("o_orderkey").alias("opportunity_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("email"), F.struct("o_totalprice").alias("draft"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("v")))).alias("rows"), F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("secret"))
    use = F.create_map(F.lit("searches"), F.struct("n", F.col("secret").alias("last_query")))
    review = F.struct(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("review_id"), use.alias("usage"), F.transform("rows", lambda x: x["v"]).alias("source_reviews"), F.col("secret").alias("cv_text"))
    rows = per.select("o_custkey", F.lit(1).alias("schema_version"), review.alias("review"), F.col("secret").alias("api_key"))
    return privacy.package(rows, "o_custkey", _PACKAGE)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two deadlines each, and facts made of their lines."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = lambda n: F.date_add(F.col("o_orderdate").cast("date"), n).cast("string")
    own = F.array(F.struct(F.lit("application").alias("kind"), day(60).alias("date")), F.struct(F.lit(None).cast("string").alias("kind"), day(30).alias("date")))
    null = lambda d: [F.lit(None).cast(f.dataType).alias(f.name) for f in privacy.struct_of(f"x {d}")["x"].dataType.fields[2:]]
    whole = F.transform(own, lambda d: F.struct(d["kind"].alias("kind"), d["date"].alias("date"), *null(merging.DEADLINE)))
    rows = o.select("o_orderkey", day(60).alias("close_date"), whole.alias("deadlines"), F.array(F.lit("own topic")).alias("topic_areas"), "o_orderdate")
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_shipdate")]).join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == k)
    kind = F.when(n.isin(1, 7), "application").when(n.isin(2, 3, 5), "letter_of_intent")
    date = F.when(n == 1, day(60)).when(n.isin(2, 5), day(45)).when(n == 3, day(30)).when(n == 7, F.col("l_shipdate").cast("date").cast("string"))
    signal = F.when(n == 4, F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("amended"))
    fact = F.struct(
        F.concat_ws("-", F.lit("e"), k, n).alias("id"), F.when(n == 4, "status_signal").when(n == 6, "limited_submission").otherwise("deadline").alias("type"), F.concat(F.lit("label "), n.cast("string")).alias("label"), date.alias("value"),
        F.col("l_linestatus").alias("display_value"), F.lit(merging.CONFIDENCE).alias("confidence"), F.lit(None).cast(merging.CITATION).alias("citation"), date.alias("date"), kind.alias("deadline_kind"), F.lit(None).cast("string").alias("time"),
        F.lit(None).cast("string").alias("timezone"), F.lit(True).alias("required"), signal.alias("status_signal"),
    )
    facts = lines.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", fact.alias("f")))), lambda x: x["f"]).alias("facts"))
    facts = facts.withColumn("facts", F.col("facts").cast(f"array<{merging.FACT}>"))
    changed = k % 11 == 0
    document = F.struct(*[changed.alias(f.name) if f.name == "changed_since_previous" else F.lit(None).cast(f.dataType).alias(f.name) for f in privacy.struct_of(f"x {merging.DOCUMENT}")["x"].dataType])
    area = F.array(F.struct(F.lit("Plasma").alias("label"), F.array(F.lit("Physics"), F.lit("own topic")).alias("topics"), F.when(k % 2 == 0, "plasmas").otherwise("blood").alias("quote")))
    entries = rows.where(k % 7 != 1).join(facts, "o_orderkey", "left").select(
        "o_orderkey", F.when(k % 5 == 0, "failed").otherwise("current").alias("status"), F.lit("2026-07-01").alias("checked_at"), document.alias("document"), "facts",
        merging.review_items(F.col("close_date"), F.coalesce("facts", F.array().cast(f"array<{merging.FACT}>")), changed, F.when(k % 13 == 0, 100).otherwise(1000)).alias("review_queue"), area.alias("program_areas"),
    )
    return merging.merge_facts(rows.drop("o_orderdate"), entries, "o_orderkey", {"Plasma": r"\bplasmas?\b"})


_MERGE_SQL = """WITH h AS (
      SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 7 = 1 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'current' END AS status,
             coalesce(bool_or(l_linenumber = 1), false) AS l1, coalesce(bool_or(l_linenumber = 2), false) AS l2, coalesce(bool_or(l_linenumber = 3), false) AS l3, coalesce(bool_or(l_linenumber = 5), false) AS l5,
             coalesce(bool_or(l_linenumber = 6), false) AS l6, coalesce(bool_or(l_linenumber = 7), false) AS l7, max(l_returnflag) FILTER (l_linenumber = 4) AS flag, CAST(max(l_shipdate) FILTER (l_linenumber = 7) AS DATE) AS d7,
             count(*) FILTER (l_linenumber IN (1, 2, 3, 4, 5, 7)) AS decisive, count(l_linenumber) AS n_facts, count(*) FILTER (l_linenumber IN (1, 2, 3, 5, 7)) AS n_dated
      FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
    m AS (SELECT *, status = 'current' AS now, l7 AND d7 <> d + 60 AS own7, list_filter([
            CASE WHEN flag = 'R' THEN 'status:1' END, CASE WHEN l6 THEN 'limited_submission:1' END, CASE WHEN l7 AND d7 <> d + 60 THEN 'deadline_conflict:1' END,
            CASE WHEN k % 11 = 0 THEN 'amendment:' || least(6, decisive) END, CASE WHEN k % 13 = 0 THEN 'document_unreadable:0' END], lambda x: x IS NOT NULL) AS queue FROM h)"""


@query(
    "document_merge",
    _MERGE_SQL
    + """ SELECT k AS o_orderkey, status, 2 + CASE WHEN now THEN CAST(l2 OR l5 AS INT) + CAST(own7 AS INT) ELSE 0 END AS n_deadlines,
      CASE WHEN now THEN array_to_string(list_sort(list_filter([
        CASE WHEN l7 AND d7 = d + 60 THEN 'application:e-' || k || '-7' WHEN l1 THEN 'application:e-' || k || '-1' END, CASE WHEN l3 THEN 'none:e-' || k || '-3' END,
        CASE WHEN l2 AND l5 THEN 'letter_of_intent:e-' || k || '-5' END], lambda x: x IS NOT NULL)), ',') ELSE '' END AS marks,
      CASE WHEN now AND (l2 OR l3 OR l5) THEN 'letter_of_intent' END AS stage, CASE WHEN now AND l6 THEN 'e-' || k || '-6' END AS limited_by,
      CASE WHEN now THEN CASE flag WHEN 'R' THEN 'cancelled' ELSE CASE WHEN flag IS NULL THEN '' ELSE 'amended' END END END AS signals,
      coalesce(now AND flag = 'R', false) AS to_verify, CASE WHEN now THEN array_to_string(queue, ',') END AS queue,
      CASE WHEN now AND k % 2 = 0 THEN 'own topic,Physics' ELSE 'own topic' END AS topics, CASE WHEN now THEN CAST(n_facts AS INT) END AS n_facts FROM m""",
)
def document_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines marked or added, stages, limits, signals, topics and review items of records with notices."""
    marks = F.transform(F.filter("deadlines", lambda d: d["document_evidence_id"].isNotNull()), lambda d: F.concat_ws(":", F.coalesce(d["kind"], F.lit("none")), d["document_evidence_id"]))
    queue = F.transform("document_evidence.review_queue", lambda q: F.concat_ws(":", q["type"], F.size(q["evidence_ids"])))
    return _merged(spark, sf_dir).select(
        "o_orderkey", F.col("document_evidence_status").alias("status"), F.size("deadlines").alias("n_deadlines"), F.array_join(F.array_sort(marks), ",").alias("marks"), F.col("preliminary_stage_type").alias("stage"), F.col("limited_submission_review.evidence_id").alias("limited_by"),
        F.array_join("document_status_signals", ",").alias("signals"), F.coalesce("status_verification_required", F.lit(False)).alias("to_verify"), F.array_join(queue, ",").alias("queue"), F.array_join("topic_areas", ",").alias("topics"), F.size("document_evidence.facts").alias("n_facts"),
    )


@query(
    "document_metrics",
    _MERGE_SQL
    + """ SELECT count(*) FILTER (now) AS document_current_count, count(*) FILTER (status = 'pending') AS document_pending_count, count(*) FILTER (status = 'failed') AS document_failed_count,
      CAST(sum(n_facts) FILTER (now) AS BIGINT) AS citation_fact_count, CAST(sum(n_dated) FILTER (now) AS BIGINT) AS document_deadline_count, count(*) FILTER (now AND l6) AS limited_submission_review_count,
      CAST(sum(len(queue)) FILTER (now) AS BIGINT) AS review_queue_count, count(*) FILTER (now AND k % 11 = 0) AS changed_document_count, CAST(0 AS BIGINT) AS archived_cache_count,
      CAST(0 AS BIGINT) AS refreshed_count, CAST(0 AS BIGINT) AS not_modified_count, CAST(0 AS BIGINT) AS failed_request_count FROM m""",
)
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.document_metrics(_merged(spark, sf_dir))
