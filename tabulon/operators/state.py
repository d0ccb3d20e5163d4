"""Small keyed states as tables: labels that toggle, bounded counters and lists, health of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def toggle_labels(state: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """State (key, label, at) after changes of at most one a key: an equal label is taken off, another replaces it."""
    new = changes.select(*key, F.col("label").alias("_label"), F.col("at").alias("_at"))
    met = state.join(new, key, "full_outer")
    same = F.col("_label").eqNullSafe(F.col("label")) & F.col("_label").isNotNull()
    return met.where(~same).select(*key, F.coalesce("_label", "label").alias("label"), F.coalesce("_at", "at").alias("at"))


def add_usage(counters: DataFrame, events: DataFrame, key: list[str], most: int = 100_000) -> DataFrame:
    """Counters (key, n) raised by events (key, by); negative steps count as none, totals are capped."""
    both = counters.select(*key, F.col("n").alias("by")).unionByName(events.select(*key, F.greatest(F.lit(0), F.col("by")).alias("by")))
    return both.groupBy(*key).agg(F.least(F.sum("by"), F.lit(most)).alias("n"))


def newest(rows: DataFrame, owner: list[str], key: str, order: Column, most: int = 500) -> DataFrame:
    """Each owner's distinct keys, the newest first, at most so many; a later row of a key replaces earlier ones."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    last = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in owner], F.col(key).alias("_key")).agg(F.max_by(row, order).alias("row"), F.max(order).alias("_order"))
    place = W.partitionBy(*[f"_{c}" for c in owner]).orderBy(F.desc("_order"), "_key")
    return last.withColumn("position", F.row_number().over(place)).where(F.col("position") <= most).select("row.*", "position")


def review_summary(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Verdicts (status accurate, incorrect, unclear, ...) with the accuracy among the decided ones."""
    ok, bad = F.count_if(F.col("status") == "accurate"), F.count_if(F.col("status") == "incorrect")
    return reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("reviews"), ok.alias("accurate"), bad.alias("incorrect"), F.try_divide(ok, ok + bad).alias("accuracy"))


def usage_totals(sessions: DataFrame, usage: str = "usage") -> DataFrame:
    """Sums over the maps of counters of many sessions: (name, total)."""
    return sessions.select(F.explode(usage).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("total"))


def require_health(runs: DataFrame, ok: Column, least: int = 5, most_failed: float = 0.8) -> tuple[int, int]:
    """(attempts, failures), or ValueError when too many of enough attempts failed; null ``ok`` is undecided and no failure."""
    n, failed = runs.agg(F.count(F.lit(1)), F.count_if(~ok)).first()
    if n >= least and failed / n > most_failed:
        raise ValueError(f"{failed} of {n} attempts failed")
    return n, failed
