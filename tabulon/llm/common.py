"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.session import new_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path under the shared folder."""
    return new_folder(spark, name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor
    costs a re-read instead of a re-computation.
    """
    return stored(df, new_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path``, an unused one, and read back; the caller may ``remove`` it when all that reads it is done."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or that with underscores in front until no column clashes with it."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, folds: int, fold: int):
    """True for rows whose crc32(id as text) falls on the held-out fold; null ids count as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def ranked(df: DataFrame, order: list, name: str = "ranked") -> DataFrame:
    """``df`` written in the order ``order``, with ``rank``: 0, 1, 2, ... along it over all rows.

    Range partitions are sorted and numbered apart; the sizes of the partitions
    before (one row a partition, so the broadcast is bounded by their number)
    are added. No window holds more than those sizes.
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank_id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("rank_id", 33)
    sizes = placed.groupBy(part.alias("rank_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("rank_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("rank_part", before.alias("rank_start")))
    rank = F.col("rank_start") + F.col("rank_id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("rank_part", part).join(starts, "rank_part").select(*df.columns, rank.alias("rank"))
