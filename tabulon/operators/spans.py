"""Spans of patterns in texts with their positions, and as-of matching between them.

All spans of a text share one partition, so positions (running sums) and
matches (the last or first span of a kind before or behind a row) come from
windows over one shuffle; no pair of spans is ever joined.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def spans(rows: DataFrame, key: str, text: Column, patterns: Mapping[str, tuple[str, int]]) -> DataFrame:
    """(key, kind, start, end, found) of all matches of ``patterns`` (kind -> pattern, group that is kept), 0-based, end exclusive."""
    per_kind = []
    for kind, (pattern, group) in patterns.items():
        whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("size"), part.alias("found"))
        per_kind.append(F.struct(F.lit(kind).alias("kind"), F.filter(zipped, lambda z: z["size"].isNotNull()).alias("hits")))
    each = rows.select(key, F.explode(F.array(*per_kind)).alias("_spans")).where(F.size("_spans.hits") > 0).repartition(key)
    each = each.select(key, "_spans.kind", F.posexplode("_spans.hits").alias("nth", "hit"))
    order = W.partitionBy(key, "kind").orderBy("nth")
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(order).cast("int")
    return each.select(key, "kind", (end - F.col("hit.size")).alias("start"), end.alias("end"), F.col("hit.found").alias("found"))


def last_before(key: str, kind: str) -> Column:
    """Start of the last span of ``kind`` that starts at or before a row's span; null where there is none."""
    up_to_here = W.partitionBy(key).orderBy("start", F.col("kind") != kind).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.last(F.when(F.col("kind") == kind, F.col("start")), ignorenulls=True).over(up_to_here)


def first_after(key: str, kind: str) -> Column:
    """struct<start, end, found> of the first span of ``kind`` behind a row's span in order of starts; null where there is none."""
    from_here = W.partitionBy(key).orderBy("start", F.col("kind") != kind).rowsBetween(1, W.unboundedFollowing)
    return F.first(F.when(F.col("kind") == kind, F.struct("start", "end", "found")), ignorenulls=True).over(from_here)
