"""Personal search: a query, a profile, likes and fit in one plan.

Query and profile terms read the postings once: each term carries the weight
that it adds to the direct and to the profile score, and one aggregation gives
both. Fit and preference are columns of the records that remain.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import age_days
from tabulon.functions.text import tokens
from tabulon.operators.facets import passes_filters
from tabulon.operators.feedback import preference_scores, profile_terms
from tabulon.operators.gates import reason_is_current, runtime_reason
from tabulon.operators.views import career_fit
from tabulon.plans.index import FILTER_TERMS, B, Index, K1, expand, vocabulary
from tabulon.plans.search import Request, freshness_boost, personal_score, phrase_boost, range_filters
from tabulon.session import written

#: Weights of a profile's sources, terms that a career stage adds, and applicant types by context.
SOURCES = {"research_description": 2.2, "expertise_keywords": 5.0, "cv_text": 0.42}
STAGE_TERMS = {"early_career": "early career investigator new investigator", "trainee": "trainee postdoctoral fellowship training"}
STAGE_WEIGHT = 5.0
APPLICANTS = {
    "higher_education": r"institution(?:s)? of higher education",
    "nonprofit": "nonprofit",
    "small_business": "small business",
    "individual": "individual",
    "government": "government|county|city|township|school district|public housing|special district",
    "tribal": "tribal|native american",
    "other": "other|unrestricted",
}


@dataclass(frozen=True)
class Profile:
    """Who searches: texts by source name, applicant context and career stage."""

    texts: Mapping[str, str] = field(default_factory=dict)
    applicant_context: str = ""
    career_stage: str = ""


def applicant_fit(types: Column, context: str) -> Column:
    """0 without types, 0.8 where anybody may apply, 2.4 where the context is named, else -0.8."""
    text = F.lower(F.array_join(F.coalesce(types, F.array().cast("array<string>")), " "))
    named = text.rlike(APPLICANTS[context]) if context in APPLICANTS else F.lit(False)
    return F.when(text == "", 0.0).when(F.contains(text, F.lit("unrestricted")), 0.8).when(named, 2.4).otherwise(-0.8)


def profile_query(index: Index, profile: Profile) -> list[str]:
    """At most 28 terms of a profile, the heaviest first."""
    spark = index.words.sparkSession
    texts = [(profile.texts.get(name) or "", weight) for name, weight in SOURCES.items()]
    texts.append((STAGE_TERMS.get(profile.career_stage, ""), STAGE_WEIGHT))
    rows = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(texts)], "nth int, text string, source_weight double")
    counts = rows.select("nth", "source_weight", F.explode(tokens("text")).alias("term")).groupBy("nth", "source_weight", "term").agg(F.count(F.lit(1)).alias("count"))
    n = index.totals.first()["n_docs"]
    top = profile_terms(counts.withColumn("everyone", F.lit(0)), vocabulary(index), n, ["everyone"])
    return [r["term"] for r in top.orderBy("position").collect()]  # a bounded list


def fused_scores(index: Index, asked: Mapping[str, str], weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(doc_id, a column of BM25 for each of ``asked``): the postings are read once for all of them.

    ``asked``: name -> text; ``weights``: name -> query term -> its weight, 1 where none is named.
    """
    spark = index.words.sparkSession
    given = spark.createDataFrame([(name, text) for name, text in asked.items()], "query_id string, text string")
    own = spark.createDataFrame([(n, t, float(w)) for n, by in (weights or {}).items() for t, w in by.items()], "query_id string, asked string, own double")
    terms = expand(given, vocabulary(index)).join(F.broadcast(own), ["query_id", "asked"], "left")  # as short as the query itself
    parts = [F.sum(F.when(F.col("query_id") == name, F.col("weight") * F.coalesce("own", F.lit(1.0))).otherwise(0.0)).alias(name) for name in asked]
    terms = written(terms.groupBy("term", "df").agg(*parts), "asked-terms")
    some = [r["term"] for r in terms.select("term").limit(FILTER_TERMS + 1).collect()]
    counts = index.counts if len(some) > FILTER_TERMS else index.counts.where(F.col("term").isin(some))
    hits = counts.join(terms, "term").join(index.lengths, "doc_id").join(F.broadcast(index.totals))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return hits.groupBy("doc_id").agg(*[F.sum(F.col(name) * part).alias(name) for name in asked])


def search_personal(records: DataFrame, index: Index, request: Request, as_of: Column, profile: Profile | None = None, model: DataFrame | None = None, facets: Column | None = None) -> DataFrame:
    """Matching records with direct, profile_score, bonus, preference, score and is_boosted.

    A query with terms keeps what it hits; without one a profile with terms
    does. ``model``: (feature, weight) of liked ``facets``; an empty one changes
    nothing.
    """
    text = request.query.strip()
    profile_text = " ".join(profile_query(index, profile)) if profile else ""
    rows = records.where(reason_is_current(runtime_reason(as_of))).where(passes_filters(records, request.filters)).where(range_filters(request))
    scores = fused_scores(index, {"direct": text, "profile_score": profile_text}).withColumnRenamed("doc_id", "_doc")
    rows = rows.join(scores, F.col("opportunity_id") == F.col("_doc"), "left").drop("_doc")
    rows = rows.withColumn("direct", F.coalesce("direct", F.lit(0.0)) + phrase_boost(text)).withColumn("profile_score", F.coalesce("profile_score", F.lit(0.0)) + phrase_boost(profile_text))
    has_terms = index.words.sparkSession.createDataFrame([(text, profile_text)], "a string, b string").select(F.size(tokens("a")) > 0, F.size(tokens("b")) > 0).first()
    if has_terms[0]:
        rows = rows.where("direct > 0")
    elif has_terms[1]:
        rows = rows.where("profile_score > 0")
    bonus = F.lit(0.0)
    if profile:
        types = F.col("applicant_types") if "applicant_types" in records.columns else F.array().cast("array<string>")
        signal = F.col("career_stage_signal") if "career_stage_signal" in records.columns else F.lit(False)
        bonus = applicant_fit(types, profile.applicant_context) + career_fit(F.lit(profile.career_stage), signal, F.col("title"), F.col("description"))
    rows = rows.withColumn("bonus", bonus)
    if model is None:
        rows = rows.withColumn("preference", F.lit(0.0))
    else:
        liked = preference_scores(rows, "opportunity_id", facets, model).select("opportunity_id", F.col("factor").alias("preference"))
        rows = rows.join(liked, "opportunity_id")
    rows = rows.withColumn("score", personal_score(F.col("direct"), F.col("profile_score"), F.col("bonus"), F.col("preference")))
    if not (any(has_terms) or model is not None):
        return rows.withColumn("is_boosted", F.lit(False))
    rows = written(rows, "personal")
    peak = rows.agg(F.greatest(F.max("score"), F.lit(0.0)).alias("_peak"))
    first_seen = F.col("source_first_seen_date") if "source_first_seen_date" in records.columns else F.lit(None).cast("date")
    boost = freshness_boost(F.col("score"), F.col("_peak"), age_days(as_of, F.col("posted_date"), first_seen))
    rows = rows.join(F.broadcast(peak)).withColumn("_boost", F.coalesce(boost, F.lit(0.0)))
    return rows.withColumn("score", F.col("score") + F.col("_boost")).withColumn("is_boosted", F.col("_boost") > 0).drop("_peak", "_boost")
