"""Mixing sources to target weights.

Each document gets a hash-random key; a source's documents are range-sorted by
that key, prefix sums of their word counts are taken, and the mix stops at the
source's exact budget, going round again (whole epochs) where the budget is
above the source's size. The document at the cut is taken in part.

Spark's range partitioning deals the rows out by source and key, so a source
with a third of all rows fills as many ranges as any third of the rows. Running
totals are taken inside each range as it streams by, and the totals of the
ranges before it are added. Rows that agree in id, source, size and text hash
are folded into one with a count, so an id that a third of the rows carry is
split by text, and copies cost no more than one row.

Rules: sources are ordered by code point, null last (null is a source of its
own); weights repeat along that order. Null and blank texts have size zero and
take zero. Rows with equal keys (repeated ids) are ordered by id, size and text
hash, so reruns agree; identical rows are interchangeable. A null id counts as
''. An empty table gives an empty result. Columns pass through whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import WORD, materialise

WEIGHTS = (3, 1, 2)
#: Copies that are written out from one folded row at once.
COPIES = 10_000
#: What makes rows interchangeable.
_SAME = ["id", "source", "size", "tie"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water filling.

    Targets are ``share`` of all sizes dealt by weight; a source stops at
    ``epochs`` times its size and its excess goes to the others by weight.
    Sources are taken by rising cap per weight, where those at their cap are a
    prefix; all comparisons are between whole numbers. One row a source.
    """
    up, down = share
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    every = W.partitionBy()
    rising = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(rising), F.lit(0)))
        .withColumn("w_left", F.col("all_w") - F.coalesce(F.sum("w").over(rising), F.lit(0)))
    )
    full = (F.col("cap").cast("decimal(38,0)") * F.col("w_left") * down) <= F.col("w").cast("decimal(38,0)") * (up * F.col("all_size") - down * F.col("cap_before"))
    ranked = ranked.withColumn("full", full)
    ranked = ranked.withColumn("cap_sum", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    ranked = ranked.withColumn("w_sum", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(every))
    level = (F.col("w") * (up * F.col("all_size") - down * F.col("cap_sum"))).cast("double") / (down * F.col("w_sum")).cast("double")
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range, and the words of the same source that stand before in it; rows come in order."""
    part, source, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        names = np.array([*batch.column("source").to_pylist(), None], object)[:-1]
        words_ = batch.column("size").to_numpy() * batch.column("n").to_numpy()
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
        inside = np.zeros(len(names), np.int64)
        for a, b in zip(starts, [*starts[1:], len(names)]):
            if names[a] != source:
                source, before = names[a], 0
            total = before + np.cumsum(words_[a:b])
            inside[a:b], before = total - words_[a:b], int(total[-1])
        yield batch.append_column("part", pa.array(np.full(len(names), part, np.int32))).append_column("inside", pa.array(inside))


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), epochs: int = 2, seed: str = "mix") -> DataFrame:
    """(id, source, size, tie, n, source_size, target, rounds, rest): the distinct rows of ``rows`` (id, source, size, tie), how often each occurs, whole epochs, and the words left for all its copies in the last round."""
    kind = rows.schema["source"].dataType.simpleString()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    folded = rows.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("n")).withColumn("key", key)
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("id").asc_nulls_last(), F.col("size"), F.col("tie")]
    ordered = folded.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, source {kind}, size long, tie long, n long, part int, inside long"
    placed = materialise(ordered.mapInArrow(_running, schema), "mix-ranges")
    sums = placed.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("part_size"))
    source_sizes = sums.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    before = F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sums.withColumn("part_start", before).alias("p").join(targets(source_sizes, weights, share, epochs).alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    parts = parts.select(F.col("p.source").alias("p_source"), F.col("p.part").alias("p_part"), "part_start", "source_size", "target")
    met = placed.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    budget = F.floor(F.col("target") + 0.5)
    met = met.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    rest = budget - F.col("rounds") * F.col("source_size") - F.col("part_start") - F.col("inside")
    rest = F.greatest(F.lit(0), F.least(F.col("size") * F.col("n"), rest)).cast("long")
    return met.select(*_SAME, "n", "source_size", "target", "rounds", rest.alias("rest"))


def _taken(copy: Column) -> Column:
    """Words taken of a copy, counted from 0, of a row of ``plan``."""
    size = F.col("size")
    return (F.col("rounds") * size + F.greatest(F.lit(0), F.least(size, F.col("rest") - copy * size))).cast("long")


def assign(rows: DataFrame, **options) -> DataFrame:
    """(id, source, size, tie, source_size, target, taken) of each of ``rows`` (id, source, size, tie).

    ``taken`` counts the words that the mix takes, repeats included: whole
    epochs first, then the hash-random prefix of the source up to the budget.
    """
    folded = plan(rows, **options)
    # copies of one row are written out by many tasks
    blocks = folded.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition(*_SAME, "from")
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + COPIES) - 1)))
    return copies.select(*_SAME, "source_size", "target", _taken(F.col("copy")).alias("taken"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_rows: bool = False) -> DataFrame:
    """(id, source, size, tie) of each document, and the whole ``row`` if asked."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), *row)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds copy: numbers from 0 among equal rows, which are counted in each task and then added up."""
    rows = materialise(rows.withColumn("part", F.spark_partition_id()), "mix-copies")
    counts = rows.groupBy(*_SAME, "part").agg(F.count(F.lit(1)).alias("here"))
    before = F.coalesce(F.sum("here").over(W.partitionBy(*_SAME).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*_SAME, "part", before.alias("before"))
    own = rows.withColumn("nth", F.row_number().over(W.partitionBy(*_SAME, "part").orderBy(F.lit(0))) - 1)
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*_SAME, "part"]]
    met = own.alias("o").join(counts.alias("c"), same[0] & same[1] & same[2] & same[3] & same[4])
    return met.select("o.*", (F.col("nth") + F.col("before")).alias("copy"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each time a document is taken.

    The document at a source's cut appears with its first words only; n_chars,
    where there is such a column, then follows the text.
    """
    folded = materialise(plan(measure(docs, id_col, text_col, source_col), **options).where("rounds > 0 or rest > 0").drop("source_size", "target"), "mix-plan")
    rows = measure(docs, id_col, text_col, source_col, keep_rows=True)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in _SAME]
    met = rows.alias("r").join(folded.alias("t"), same[0] & same[1] & same[2] & same[3])
    met = met.select("r.row", "r.size", *[f"t.{c}" for c in ("id", "source", "tie", "n", "rounds", "rest")])
    # copies differ only where the cut lies among them
    torn = (F.col("n") > 1) & (F.col("rest") > 0) & (F.col("rest") < F.col("size") * F.col("n"))
    alike = met.where(~torn).select("row", "size", _taken(F.lit(0)).alias("taken"))
    met = alike.unionByName(_numbered(met.where(torn)).select("row", "size", _taken(F.col("copy")).alias("taken"))).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    taken = met.withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    left = F.least(F.col("size"), F.col("taken") - (F.col("time") - 1) * F.col("size")).cast("int")
    pieces = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = left < F.col("size")
    text = F.when(cut, F.array_join(F.slice(pieces, 1, left), "")).otherwise(F.col(f"row.{text_col}"))
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = text
        elif c == "n_chars":
            value = F.when(cut, F.length(text)).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return taken.select(*columns)
