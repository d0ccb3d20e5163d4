"""Digest runs as a stream: state and sent list are one commit, so a replayed batch sends nothing twice.

Each micro-batch of change events is one run. What it sends and what its
subscriptions remember afterwards become a single version of a ``Store``, noted
with the batch number; a batch whose number is already noted has been sent, and
is left alone. A run that dies before the commit has sent nothing.

A subscription's watermark is its last run that sent anything, at most
``WINDOW_DAYS`` back. Records are sent if they are new since then and were not
sent before; events if their record matches, or, for closures, was sent before.
Events of records that are sent as new in the same run are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.session import written
from tabulon.sources.store import Snapshot, Store

#: Days that a watermark reaches back, items in one digest, ids that a subscription remembers.
WINDOW_DAYS, MOST_ITEMS, REMEMBERED = 7, 25, 500
CLOSED = "closed_or_removed"

TABLES = {
    "state": "subscription string, last_run date, records array<string>, events array<string>",
    "outbox": "subscription string, kind string, id string, position int, run_day date, batch long",
}


def store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES, schema_version=1)


def is_active(active: Column | str, confirmed: Column | str) -> Column:
    """Whether a subscription may be written to: not switched off, and its consent is on record."""
    return F.coalesce(active, F.lit(True)) & F.coalesce(confirmed, F.lit(False))


@dataclass(frozen=True)
class Digests:
    """``subscriptions`` (subscription, active, confirmed) and ``ranked``, which gives a batch's (subscription, record, position, known_on)."""

    subscriptions: DataFrame
    ranked: Callable[[DataFrame], DataFrame]
    run_day: Callable[[DataFrame], object]
    window_days: int = WINDOW_DAYS
    most: int = MOST_ITEMS
    remembered: int = REMEMBERED

    def _first(self, rows: DataFrame, *order: Column) -> DataFrame:
        place = F.row_number().over(W.partitionBy("subscription").orderBy(*order)).alias("position")
        return rows.select("*", place).where(F.col("position") <= self.most)

    def due(self, events: DataFrame, state: DataFrame, today: Column) -> DataFrame:
        """(subscription, kind, id, position) to send for ``events`` (id, kind, record, changed_at), given the state before."""
        floor = F.date_sub(today, self.window_days)
        none = F.array().cast("array<string>")
        active = self.subscriptions.where(is_active("active", "confirmed")).select("subscription").distinct()
        known = active.join(state, "subscription", "left").select(
            "subscription", F.greatest(F.coalesce("last_run", floor), floor).alias("since"), F.coalesce("records", none).alias("records"), F.coalesce("events", none).alias("events")
        )
        matched = self.ranked(events).select("subscription", "record", "position", "known_on")
        seen = F.array_contains("records", F.col("record"))
        fresh = matched.join(known, "subscription").where((F.col("known_on") >= F.col("since")) & ~seen).select("subscription", "record", F.col("position").alias("rank"))
        fresh = self._first(fresh, F.col("rank"), F.col("record")).select("subscription", F.lit("new").alias("kind"), F.col("record").alias("id"), "position")
        changes = events.where("kind <> 'new'").select(F.col("id").alias("event"), "kind", "record", "changed_at")
        open_ones = changes.where(F.col("kind") != CLOSED).join(matched.select("subscription", "record").distinct(), "record")
        sent_before = known.select("subscription", F.explode("records").alias("record"))
        closures = changes.where(F.col("kind") == CLOSED).join(sent_before, "record")
        relevant = open_ones.unionByName(closures).join(known.drop("records"), "subscription")
        relevant = relevant.where((F.col("changed_at") >= F.col("since")) & ~F.array_contains("events", F.col("event")))
        updates = self._first(relevant.select("subscription", "kind", "event", "record", "changed_at"), F.desc("changed_at"), F.col("event"))
        new = fresh.select("subscription", F.col("id").alias("record"))
        updates = updates.join(new, ["subscription", "record"], "left_anti").select("subscription", "kind", F.col("event").alias("id"), "position")
        return fresh.unionByName(updates)

    def remember(self, state: DataFrame, sent: DataFrame, today: Column) -> DataFrame:
        """State after ``sent``: only subscriptions that got something move on, and the newest ids stay."""

        def ids(kind: Column) -> Column:
            items = F.collect_list(F.when(kind, F.struct("position", "id")))
            return F.transform(F.array_sort(items), lambda x: x["id"])

        got = sent.groupBy(F.col("subscription").alias("s")).agg(ids(F.col("kind") == "new").alias("new_records"), ids(F.col("kind") != "new").alias("new_events"))
        met = state.join(got, F.col("subscription") == F.col("s"), "full_outer")
        none = F.array().cast("array<string>")

        def grown(old: str, new: str) -> Column:
            both = F.concat(F.coalesce(old, none), F.coalesce(new, none))
            return F.slice(both, F.greatest(F.lit(1), F.size(both) - self.remembered + 1), self.remembered)

        run = F.when(F.col("s").isNotNull(), today).otherwise(F.col("last_run"))
        return met.select(F.coalesce("subscription", "s").alias("subscription"), run.alias("last_run"), grown("records", "new_records").alias("records"), grown("events", "new_events").alias("events"))

    def run(self, events: DataFrame, batch: int, into: Store) -> Snapshot:
        """One run over a batch of events, unless it was committed before."""
        base = into.snapshot()
        if int(base.notes.get("batch", -1)) >= batch:
            return base
        day = self.run_day(events)
        if day is None:
            return into.commit(base, notes={"batch": str(batch)})
        today = F.lit(day).cast("date")
        state = into.read("state", base)
        sent = written(self.due(events, state, today), "digests")
        outbox = sent.select("*", today.alias("run_day"), F.lit(batch).cast("long").alias("batch"))
        return into.commit(base, put={"state": self.remember(state, sent, today)}, add={"outbox": outbox}, notes={"batch": str(batch)})

    def stream(self, events: DataFrame, into: Store, checkpoint: str) -> None:
        """Runs over all that a stream of events has now, a batch each."""

        def each(batch: DataFrame, number: int) -> None:
            rows = batch.persist()
            try:
                self.run(rows, number, into)
            finally:
                rows.unpersist()

        query = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
