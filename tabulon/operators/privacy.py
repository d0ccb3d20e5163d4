"""Packages that may leave: only what a schema names, at any depth.

A package's schema is its whitelist. The projection is built from the schema
and takes fields by name, so a field that the schema does not name can't get
out, wherever it turns up; one that is missing is null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an evaluation's session, its judgments, and a deployment review consist of.
SESSION = "query string, filters string, sort string, profile_active boolean, profile_fingerprint string, applicant_context string, career_stage string, cv_present boolean, ai_provider string, ai_model string, candidate_ids array<string>, original_shortlist_ids array<string>, shortlist_ids array<string>"
FEEDBACK = "opportunity_id string, opportunity_number string, title string, agency string, label string, reason string, retrieval_rank int, displayed_rank int, ai_rank int, ai_score double, provider string, model string, updated_at string"
LIMITS = {"opportunity_id": 120, "opportunity_number": 180, "title": 500, "agency": 300, "label": 40, "reason": 120, "provider": 40, "model": 120, "updated_at": 40}


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def allowed(value: Column, have: T.DataType, want: T.DataType, limits: Mapping[str, int] | None = None, name: str = "") -> Column:
    """``value`` of type ``have`` cut down to ``want``; texts are trimmed and cut to the length that ``limits`` names."""
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            return F.lit(None).cast(want)
        there = {f.name: f.dataType for f in have}
        fields = [(allowed(value[f.name], there[f.name], f.dataType, limits, f.name) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType):
        if not isinstance(have, T.ArrayType):
            return F.lit(None).cast(want)
        return F.transform(value, lambda x: allowed(x, have.elementType, want.elementType, limits, name))
    if isinstance(want, T.MapType):
        if not isinstance(have, T.MapType):
            return F.lit(None).cast(want)
        return F.transform_values(value, lambda _, x: allowed(x, have.valueType, want.valueType, limits, name))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(None).cast(want)  # a nested value where the schema has a plain one would be written out whole
    plain = value.try_cast(want)
    if isinstance(want, T.StringType) and limits and name in limits:
        plain = F.substring(F.trim(plain), 1, limits[name])
    return plain


def project(rows: DataFrame, schema: str | T.StructType, limits: Mapping[str, int] | None = None) -> DataFrame:
    """``rows`` with exactly the columns and nested fields of ``schema``."""
    want = struct_of(schema) if isinstance(schema, str) else schema
    there = {f.name: f.dataType for f in rows.schema}
    return rows.select(*[(allowed(F.col(f"`{f.name}`"), there[f.name], f.dataType, limits, f.name) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def package(rows: DataFrame, key: str, schema: str | T.StructType, limits: Mapping[str, int] | None = None) -> DataFrame:
    """(key, payload): the projected row as JSON."""
    want = struct_of(schema) if isinstance(schema, str) else schema
    both = T.StructType([rows.schema[key], *[f for f in want if f.name != key]])
    cut = project(rows, both, limits)
    return cut.select(key, F.to_json(F.struct(*[f.name for f in want])).alias("payload"))
