"""Facet counts, facet filters and conditional metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(df: DataFrame, name: str) -> Column:
    """A scalar or list column as a list of strings; null and '' give none."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "array":
        return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))
    return F.filter(F.array(c.cast("string")), lambda v: v.isNotNull() & (v != ""))


def facet_counts(records: DataFrame, facets: Mapping[str, str], distinct: bool = False) -> DataFrame:
    """(facet, value, n) of several facets in one pass; ``distinct`` counts a record once a value."""

    def values(field: str) -> Column:
        found = as_list(records, field)
        found = F.array_distinct(found) if distinct else found
        return F.filter(found, lambda v: v.isNotNull() & (v != ""))

    pairs = F.concat(*[_named(values(field), name) for name, field in facets.items()])
    return records.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def _named(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))


def passes_filters(records: DataFrame, filters: Mapping[str, Sequence[str]] | None, fields: Mapping[str, str] | None = None) -> Column:
    """All facets must pass, any of a facet's chosen values will do; an unknown facet is a column's name."""
    ok = F.lit(True)
    for facet, chosen in (filters or {}).items():
        if chosen:
            field = (fields or {}).get(facet, facet)
            ok = ok & F.arrays_overlap(as_list(records, field), F.array(*[F.lit(str(v)) for v in chosen]))
    return ok


def facet_page(counts: DataFrame, facet: str, chosen: Sequence[str] = (), search: str = "", limit: int = 50) -> DataFrame:
    """Values of a facet to show: those containing ``search``, chosen ones first, then by count and name."""
    rows = counts.where(F.col("facet") == facet).where(F.contains(F.lower("value"), F.lit(search.lower())))
    rows = rows.withColumn("chosen", F.col("value").isin(*chosen) if chosen else F.lit(False))
    return rows.orderBy(F.desc("chosen"), F.desc("n"), "value").limit(limit)


def conditional_counts(records: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows that meet each condition, in one aggregate."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def routes(best: str = "primary_document_url", page: str = "funding_opportunity_url") -> Column:
    """direct, agency or record: where a record's main link leads."""
    return F.when(F.coalesce(F.col(best), F.lit("")) != "", "direct").when(F.coalesce(F.col(page), F.lit("")) != "", "agency").otherwise("record")
