"""Relevance judgments: ranking metrics, preference models, profile queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Grades of the labels, labels that count as useful, and weights of a preference model.
GRADES = {"strong": 3, "useful": 2, "partial": 1, "not_relevant": 0}
USEFUL = ("strong", "useful")
WEIGHTS = {"strong": 2.0, "useful": 1.0, "partial": 0.3, "not_relevant": -1.5, "needs_verification": 0.0}
LABELS_NEEDED = 3


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def grade(label: str = "label") -> Column:
    return _lookup(GRADES, F.col(label))


def ndcg(judgments: DataFrame, by: list[str], rank: str, gain: Column) -> DataFrame:
    """Linear-gain nDCG over the judged items of each group; 0 where the ideal is 0, no row where nothing is ranked."""
    rows = judgments.select(*by, F.col(rank).alias("_rank"), gain.alias("_gain")).where("_rank > 0 and _gain is not null")
    rows = rows.withColumn("_ideal", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_gain"))))
    sums = rows.groupBy(*by).agg(F.sum(F.col("_gain") / F.log2(F.col("_rank") + 1)).alias("_dcg"), F.sum(F.col("_gain") / F.log2(F.col("_ideal") + 1)).alias("_idcg"))
    return sums.select(*by, F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0).alias("ndcg"))


def summary(judgments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of judgments (label, retrieval_rank, ai_rank, and in_candidates: true, false, or null for no list)."""
    label, retrieved, reranked = F.col("label"), F.when(F.col("retrieval_rank") > 0, F.col("retrieval_rank")), F.when(F.col("ai_rank") > 0, F.col("ai_rank"))
    useful = label.isin(*USEFUL)
    found = F.coalesce(F.col("in_candidates"), retrieved <= 32)
    rows = judgments.where(label.isin(*WEIGHTS))
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(useful).alias("useful"),
        F.avg(grade()).alias("mean_grade"),
        F.try_divide(F.count_if(useful & found), F.count_if(useful & found.isNotNull())).alias("recall_at_32"),
        F.count_if(reranked <= 12).alias("ai_top_12"),
        F.try_divide(F.count_if(useful & (reranked <= 12)), F.count_if(reranked <= 12)).alias("precision_at_12"),
        F.avg(retrieved - reranked).alias("mean_rank_gain"),
        F.count_if(label == "not_relevant").alias("not_relevant"),
    )


def preference_model(labelled: DataFrame, facets: Column, by: list[str] | None = None) -> DataFrame:
    """(feature, weight): summed label weights of each facet value; only where enough labels are used."""
    by = by or []
    used = labelled.withColumn("_w", _lookup(WEIGHTS, F.col("label"))).where("_w <> 0")
    if by:
        ready = used.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LABELS_NEEDED).drop("_n")
        used = used.join(ready, by, "left_semi")
        return used.withColumn("feature", F.explode(F.array_distinct(facets))).groupBy(*by, "feature").agg(F.sum("_w").alias("weight"))
    if used.limit(LABELS_NEEDED).count() < LABELS_NEEDED:
        used = used.limit(0)
    return used.withColumn("feature", F.explode(F.array_distinct(facets))).groupBy("feature").agg(F.sum("_w").alias("weight"))


def preference_scores(records: DataFrame, key: str, facets: Column, model: DataFrame) -> DataFrame:
    """(key, raw, factor, reason): raw weight of each record, its factor in [-0.5, 1], its strongest feature."""
    spread = records.select(key, F.explode_outer(F.array_distinct(facets)).alias("feature"))
    met = spread.join(model, "feature", "left")
    best = F.max_by(F.when(F.col("weight") > 0, F.col("feature")), F.struct(F.when(F.col("weight") > 0, F.col("weight")).alias("w"), F.col("feature").alias("f")))
    out = met.groupBy(key).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("raw"), best.alias("reason"))
    return out.select(key, "raw", F.greatest(F.lit(-0.5), F.least(F.lit(1.0), F.col("raw") / 4)).alias("factor"), "reason")


def profile_terms(terms: DataFrame, df: DataFrame, n: int, by: list[str], limit: int = 28) -> DataFrame:
    """Weighted query terms of a profile: (term, count, source_weight) summed over sources and scaled by rarity."""
    rarity = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("source_weight") * (1 + F.least(F.lit(2.2), F.log(1 + F.col("count"))))
    scored = terms.join(df, "term").groupBy(*by, "term").agg(F.sum(part * rarity).alias("weight"))
    top = W.partitionBy(*by).orderBy(F.desc("weight"), "term")
    return scored.withColumn("position", F.row_number().over(top)).where(F.col("position") <= limit)


def explore(candidates: DataFrame, scores: DataFrame, shown: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """The best-liked candidates that were not shown."""
    return candidates.join(shown.select(key), key, "left_anti").join(scores, key).where("raw > 0").orderBy(F.desc("raw"), key).limit(limit)
