"""Record identity, ranks, duplicates and merges across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.functions.text import fold, title_key
from tabulon.operators.gates import publish_reason, within_bounds


def identity(number: str = "opportunity_number", ident: str = "opportunity_id") -> Column:
    """``number:`` without white space, in lower case, else ``id:``; null with neither."""
    n = F.regexp_replace(fold(F.coalesce(F.col(number).cast("string"), F.lit(""))), r"\s+", "")
    i = F.nullif(F.col(ident).cast("string"), F.lit(""))
    return F.when(n != "", F.concat(F.lit("number:"), n)).otherwise(F.concat(F.lit("id:"), i))


def rank(status: str = "status", updated: str = "last_updated", version: str = "version") -> Column:
    """Posted before forecast, then the later update, then the higher version as text."""
    return F.struct(
        F.when(F.col(status) == "posted", 1).otherwise(0).alias("posted"),
        F.coalesce(F.col(updated).cast("string"), F.lit("")).alias("updated"),
        F.coalesce(F.col(version).cast("string"), F.lit("")).alias("version"),
    )


def keep_best(records: DataFrame, key: Column, best: Column, ordinal: Column) -> DataFrame:
    """One row a key: the highest ``best``, of equals the first by ``ordinal``.

    An aggregate rather than a window: partial results meet instead of rows.
    """
    row = F.struct(*[F.col(c) for c in records.columns])
    kept = records.groupBy(key.alias("_key")).agg(F.max_by(row, F.struct(best.alias("best"), (-ordinal).alias("first"))).alias("row"))
    return kept.select("row.*")


def last_wins(records: DataFrame, key: Column, ordinal: Column) -> DataFrame:
    """One row a non-null key: the last by ``ordinal``."""
    row = F.struct(*[F.col(c) for c in records.columns])
    return records.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.max_by(row, ordinal).alias("row")).select("row.*")


def merge_sources(base: DataFrame, external: DataFrame, ordinal: Column) -> DataFrame:
    """``base`` and those of ``external`` that it lacks, with ``origin`` base or external.

    An external record goes if its identity, its number or its reduced title is
    in base; of external records with one identity the first that has neither
    number nor title in base stays.
    """
    keyed = external.withColumns({"_identity": F.coalesce(identity(), F.lit("id:")), "_number": F.lower(F.trim(F.coalesce("opportunity_number", F.lit("")))), "_title": title_key("title")})
    ids = base.select(F.coalesce(identity(), F.lit("id:")).alias("_identity")).distinct()
    numbers = base.select(F.lower(F.trim("opportunity_number")).alias("_number")).where("_number <> ''").distinct()
    titles = base.where("title <> ''").select(title_key("title").alias("_title")).distinct()
    new = keyed.join(ids, "_identity", "left_anti").join(numbers, "_number", "left_anti").join(titles, "_title", "left_anti")
    new = keep_best(new, F.col("_identity"), F.lit(0), ordinal).drop("_identity", "_number", "_title")
    return base.withColumn("origin", F.lit("base")).unionByName(new.withColumn("origin", F.lit("external")), allowMissingColumns=True)


def merge_summary(base: DataFrame, external: DataFrame, merged: DataFrame) -> DataFrame:
    """Counts of a merge in one row."""
    ids = base.select(F.coalesce(identity(), F.lit("id:")).alias("_identity")).distinct().withColumn("_hit", F.lit(True))
    seen = external.withColumn("_identity", F.coalesce(identity(), F.lit("id:"))).join(ids, "_identity", "left")
    considered = seen.agg(F.count(F.lit(1)).alias("external_considered"), F.count("_hit").alias("in_base_by_identity"))
    total = merged.agg(F.count_if(F.col("origin") == "base").alias("base_count"), F.count_if(F.col("origin") == "external").alias("external_added"), F.count(F.lit(1)).alias("final_count"))
    return total.withColumn("_one", F.lit(1)).join(considered.withColumn("_one", F.lit(1)), "_one").drop("_one")


def refresh_sources(fetched: DataFrame, runs: DataFrame, snapshot: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(records to publish, one status row a source).

    ``fetched``: records with ``slug``; ``runs``: slug, ok, min_records,
    max_records; ``snapshot``: last good records with slug and fetched_at. A
    source is refreshed if its run is ok and its publishable records are within
    bounds, else its snapshot stays. Refreshed records keep the day on which
    they were first seen. Records that fail the publishing gate never appear.
    """
    good = fetched.where(publish_reason(as_of).isNull())
    counts = good.groupBy("slug").agg(F.count(F.lit(1)).alias("kept"))
    n = F.coalesce("kept", F.lit(0))
    status = runs.join(counts, "slug", "left").withColumn("healthy", F.col("ok") & within_bounds(n, F.col("min_records"), F.col("max_records")))
    label = F.when(F.col("healthy"), "refreshed").when(F.col("ok"), "unhealthy_kept_last_good").otherwise("failed_kept_last_good")
    status = status.select("slug", label.alias("status"), n.alias("kept"), "healthy")
    known = snapshot.select("slug", identity().alias("_identity"), F.col("source_first_seen_date").alias("_seen"), F.col("fetched_at").cast("date").alias("_fetched"))
    known = known.groupBy("slug", "_identity").agg(F.min("_seen").alias("_seen"))
    when = snapshot.groupBy("slug").agg(F.max(F.col("fetched_at").cast("date")).alias("_fetched"))
    fresh = good.join(status.where("healthy").select("slug"), "slug", "left_semi").withColumn("_identity", identity())
    fresh = fresh.join(known, ["slug", "_identity"], "left").join(when, "slug", "left")
    fresh = fresh.withColumn("source_first_seen_date", F.coalesce("_seen", "_fetched", as_of)).drop("_identity", "_seen", "_fetched")
    kept = snapshot.drop("fetched_at").join(status.where("not healthy").select("slug"), "slug", "left_semi").where(publish_reason(as_of).isNull())
    return fresh.unionByName(kept, allowMissingColumns=True), status


def require_valid(records: DataFrame, low: int, high: int, share: float = 0.01, floor: int = 5) -> DataFrame:
    """``records`` unchanged, or ValueError: count bounds, unique identities, few missing titles and agencies."""
    n, ids, titles, agencies = records.agg(
        F.count(F.lit(1)), F.count_distinct(F.coalesce(identity(), F.lit("id:"))), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == ""), F.count_if(F.coalesce(F.trim("agency"), F.lit("")) == "")
    ).first()
    missing = max(floor, -int(-n * share // 1))
    if not low <= n <= high:
        raise ValueError(f"{n} records; {low} to {high} are plausible")
    if ids != n:
        raise ValueError(f"{n - ids} records share an identity")
    if titles > missing or agencies > missing:
        raise ValueError(f"{titles} titles and {agencies} agencies are missing; at most {missing} may be")
    return records


def first_by(records: DataFrame, by: list[Column], limit: int, partition: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows in an order, per partition or overall."""
    if not partition:
        return records.orderBy(*by).limit(limit)
    return records.withColumn("position", F.row_number().over(W.partitionBy(*partition).orderBy(*by))).where(F.col("position") <= limit)
