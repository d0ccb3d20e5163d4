"""URL inventory, rotation of checks, and matching by shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Words that say nothing about a person's field.
PLAIN_WORDS = (
    "the and for with from this that are was into over out per via"
    " research program grants grant funding award awards project projects support"
    " science engineering national university institute department studies study"
    " development new using based their which will been more also may can under"
).split()


def word_bag(*parts: Column | str) -> Column:
    """Distinct words of three characters or more, without the plain ones."""
    text = F.lower(F.concat_ws(" ", *parts))
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))), lambda w: ~w.isin(*PLAIN_WORDS))


def url_inventory(records: DataFrame, key: str, urls: Column) -> DataFrame:
    """(url, n, first_id): how many records have each URL, and the smallest id as text; no list of them is made."""
    spread = records.select(F.col(key).alias("key"), F.explode(F.array_distinct(urls)).alias("url")).where("url is not null and url <> ''")
    once = spread.distinct()
    return once.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("key").cast("string")).alias("first_id"))


def due_urls(urls: DataFrame, state: DataFrame, limit: int) -> DataFrame:
    """URLs to check next: unknown ones, then the longest unchecked, then by URL."""
    known = state.select(F.col("url").alias("_url"), "checked_at")
    met = urls.join(known, F.col("url") == F.col("_url"), "left")
    return met.orderBy(F.col("_url").isNotNull(), F.coalesce("checked_at", F.lit("")), "url").limit(limit).drop("_url")


def carry_state(urls: DataFrame, checked: DataFrame, state: DataFrame) -> DataFrame:
    """New state of every URL: its check, else its old state, else unchecked."""
    now = checked.select(F.col("url"), F.struct(*[F.col(c) for c in checked.columns if c != "url"]).alias("now"))
    old = state.select(F.col("url"), F.struct(*[F.col(c) for c in checked.columns if c != "url"]).alias("old"))
    met = urls.join(now, "url", "left").join(old, "url", "left")
    return met.select(*urls.columns, F.coalesce("now", "old").alias("state")).select(*urls.columns, "state.*")


def shared_words(left: DataFrame, right: DataFrame, least: int = 3, most: int = 25) -> DataFrame:
    """(left_id, right_id, overlap): pairs sharing at least ``least`` words, the best ``most`` of each left row.

    ``left`` (id, words) and ``right`` (id, words) meet on their words, so no
    pair without a common word is ever formed.
    """
    a = left.select(F.col("id").alias("left_id"), F.explode(F.array_distinct("words")).alias("word"))
    b = right.select(F.col("id").alias("right_id"), F.explode(F.array_distinct("words")).alias("word"))
    pairs = a.join(b, "word").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
    best = W.partitionBy("left_id").orderBy(F.desc("overlap"), "right_id")
    return pairs.withColumn("position", F.row_number().over(best)).where(F.col("position") <= most)


def teams(pairs: DataFrame, members: int = 4, least: int = 2, most: int = 100) -> DataFrame:
    """(right_id, n, total, team): the best left rows of every right row that at least two match."""
    best = W.partitionBy("right_id").orderBy(F.desc("overlap"), "left_id")
    ranked = pairs.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= members)
    team = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "left_id"))), lambda x: x["left_id"].cast("string")), ",")
    out = ranked.groupBy("right_id").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("total"), team.alias("team")).where(F.col("n") >= least)
    return out.orderBy(F.desc("total"), F.desc("n"), "right_id").limit(most)
