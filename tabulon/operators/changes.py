"""Differences between two snapshots, their history, and what a digest sends of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.operators.gates import reason_is_current, runtime_reason

#: Kinds of change and their labels.
LABELS = {
    "new": "New opportunity",
    "deadline_changed": "Deadline changed",
    "amended": "Opportunity amended",
    "closing_soon": "Closing soon",
    "closed_or_removed": "Closed or removed",
}
CLOSING_DAYS, RETENTION_DAYS = 30, 90


def record_key(df: DataFrame) -> Column:
    """Id, else number, else page."""
    names = [c for c in ("opportunity_id", "opportunity_number", "detail_page") if c in df.columns]
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names])


def event_id(kind: Column, key: Column, changed: Column, detail: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", kind, key, F.date_format(changed, "yyyy-MM-dd"), detail)), 1, 20)


def diff_snapshots(previous: DataFrame, current: DataFrame, as_of: Column, closing_days: int = CLOSING_DAYS) -> DataFrame:
    """(event_id, kind, label, record_key, detail, changed_at) of the changes between two snapshots of unique keys.

    Both sides are reduced to what the comparison reads before their one full join.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        today, yesterday = runtime_reason(as_of), runtime_reason(F.date_sub(as_of, 1))
        kept = F.struct(F.col("close_date").cast("date").alias("close"), F.col("last_updated").cast("string").alias("updated"), F.col("version").cast("string").alias("version"), "status", reason_is_current(today).alias("open"), reason_is_current(yesterday).alias("was_open"))
        return df.select(record_key(df).alias("record_key"), kept.alias(name)).where("record_key is not null")

    both = side(previous, "old").join(side(current, "new"), "record_key", "full_outer")
    old, new = (lambda f: F.col(f"old.{f}")), (lambda f: F.col(f"new.{f}"))
    here, there = F.col("new").isNotNull(), F.col("old").isNotNull()
    is_open = F.coalesce(new("open"), F.lit(False))
    yesterday = F.date_sub(as_of, 1)
    near = new("close").between(as_of, F.date_add(as_of, closing_days))
    was_near = F.coalesce(old("close").between(yesterday, F.date_add(yesterday, closing_days)), F.lit(False))

    def shown(d: Column) -> Column:
        return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("not listed"))

    def event(kind: str, when: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))

    changed = there & (~old("updated").eqNullSafe(new("updated")) | ~old("version").eqNullSafe(new("version")))
    kinds = F.array(
        event("new", is_open & ~there, F.lit("First appeared in the public catalog")),
        event("deadline_changed", is_open & there & ~old("close").eqNullSafe(new("close")), F.concat(shown(old("close")), F.lit(" → "), shown(new("close")))),
        event("amended", is_open & changed, F.lit("Official source record changed")),
        event("closing_soon", is_open & near & ~was_near, F.concat(F.lit("Deadline "), shown(new("close")))),
        event("closed_or_removed", F.coalesce(old("was_open"), F.lit(False)) & ~is_open, F.when(here, F.concat(F.lit("Official status is "), F.coalesce(new("status"), F.lit("None")))).otherwise(F.lit("No longer in the current catalog"))),
    )
    events = both.select("record_key", F.explode(F.filter(kinds, lambda e: e.isNotNull())).alias("e")).select("record_key", "e.kind", "e.detail")
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return events.select(event_id(F.col("kind"), F.col("record_key"), as_of, F.col("detail")).alias("event_id"), "kind", labels[F.col("kind")].alias("label"), "record_key", "detail", as_of.alias("changed_at"))


def merge_history(prior: DataFrame, new: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Events of the last ``days``; of one id the newer write stays."""
    both = prior.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    recent = both.where(F.col("event_id").isNotNull() & (F.col("changed_at") >= F.date_sub(as_of, days)))
    row = F.struct(*[F.col(c) for c in prior.columns])
    return recent.groupBy("event_id").agg(F.max_by(row, F.struct("_new", "changed_at")).alias("row")).select("row.*")


def feeds(records: DataFrame, facet: Column, entry_date: Column, key: Column, limit: int = 60) -> DataFrame:
    """The newest ``limit`` records of every facet value: (feed, slug columns of records, position)."""
    spread = records.withColumn("feed", F.explode(F.array_distinct(facet))).withColumns({"_date": entry_date, "_key": key})
    newest = W.partitionBy("feed").orderBy(F.col("_date").desc_nulls_last(), "_key")
    return spread.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit).drop("_date", "_key")


def digest_since(last_run: Column, today: Column, window_days: int = 7) -> Column:
    """Watermark of a subscription: its last run, but at most a window back."""
    return F.greatest(F.coalesce(last_run, F.date_sub(today, window_days)), F.date_sub(today, window_days))


def select_updates(events: DataFrame, ranked: DataFrame, seen: DataFrame, notified: DataFrame, since: Column, limit: int = 25) -> DataFrame:
    """Events to send: of matched records, or closures of records sent before; not sent yet and not before ``since``."""
    fresh = events.where(F.col("changed_at") >= since).join(notified.select("event_id"), "event_id", "left_anti")
    matched = fresh.where("kind <> 'closed_or_removed'").join(ranked.select("record_key").distinct(), "record_key", "left_semi")
    closed = fresh.where("kind = 'closed_or_removed'").join(seen.select("record_key").distinct(), "record_key", "left_semi")
    return matched.unionByName(closed).orderBy(F.desc("changed_at"), "event_id").limit(limit)


def select_new(ranked: DataFrame, seen: DataFrame, since: Column, first_known: Column, limit: int = 25) -> DataFrame:
    """Records to send: new since the watermark and not sent yet, in rank order (``position``)."""
    return ranked.where(first_known >= since).join(seen.select("record_key"), "record_key", "left_anti").orderBy("position").limit(limit)
