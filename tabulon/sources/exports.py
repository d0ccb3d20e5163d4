"""Exported evaluations and reviews: many JSON files read permissively, each good or with one error.

A file is one row. Its text becomes a VARIANT where it is JSON, and a chain of
checks gives the first thing that is wrong with it; good and bad files come out
of one scan. Files are ordered by their path's parts, so that ``a/b`` comes
before ``a-b`` and equal stamps are settled in the same way on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.dates import strict_iso_date

#: The supported schema, the kind of a review export, and the labels of judgments.
SCHEMA_VERSION = 1
REVIEW_KIND = "funding_finder_phase3_deployment_review"
LABELS = ("useful", "not_relevant", "needs_verification", "partial", "strong")


def kind_of(value: Column) -> Column:
    """The JSON type of a VARIANT: OBJECT, ARRAY, STRING, BIGINT, VOID, ...; null for what is absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def at(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def strict_json(text: Column) -> Column:
    """A text as VARIANT, null if it is not one whole JSON value: the parser by itself ignores what follows the first."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    return F.when(alone, F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant"))


def is_number(value: Column, path: str, number: int) -> Column:
    """Whether a JSON number (no text) has this value."""
    kinds = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    return F.coalesce(kind_of(at(value, path, "variant")).isin(*kinds) & (at(value, path, "double") == number), F.lit(False))


def files(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.[jJ][sS][oO][nN]") -> DataFrame:
    """(file, value) of all files below ``paths`` whose names match, each once; value is null where the text is no JSON."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(paths, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "value").dropDuplicates(["file"])
    return rows.select("file", strict_json(F.col("value")).alias("value"))


def checked(rows: DataFrame, checks: Sequence[tuple[Column, str | Column]]) -> DataFrame:
    """Adds error: of the first check (what has to hold, what is said otherwise) that fails, else null."""
    failed = F.lit(None).cast("string")
    for holds, said in reversed(checks):
        failed = F.when(~F.coalesce(holds, F.lit(False)), said if isinstance(said, Column) else F.lit(said)).otherwise(failed)
    return rows.withColumn("error", failed)


def _value() -> Column:
    return F.col("value")


def _whole(version_error: str) -> list[tuple[Column, str | Column]]:
    """What every export has to be: JSON, an object, of the supported schema."""
    return [(_value().isNotNull(), "not valid JSON"), (kind_of(_value()) == "OBJECT", "not an object"), (is_number(_value(), "$.schema_version", SCHEMA_VERSION), version_error)]


def reviews(rows: DataFrame) -> DataFrame:
    """Review files (file, value) with review_id, exported_at and error."""
    found = checked(
        rows,
        [
            *_whole("unsupported review schema"),
            (at(_value(), "$.kind") == REVIEW_KIND, "not a review export"),
            (F.coalesce(at(_value(), "$.review.review_id"), F.lit("")) != "", "no review identifier"),
        ],
    )
    return found.select("file", "value", "error", at(_value(), "$.review.review_id").alias("review_id"), F.coalesce(at(_value(), "$.exported_at"), F.lit("")).alias("exported_at"))


def newest_reviews(reviewed: DataFrame) -> DataFrame:
    """The newest good export of each review; of equal stamps the file that comes last."""
    order = F.struct("exported_at", F.split("file", "/").alias("parts"))
    text = F.to_json("value")  # a VARIANT can't be aggregated
    best = reviewed.where("error is null").groupBy("review_id").agg(F.max_by(F.struct("file", "exported_at", text.alias("value")), order).alias("best"))
    return best.select("review_id", "best.file", "best.exported_at", F.parse_json("best.value").alias("value"))


def failures(rows: DataFrame) -> DataFrame:
    """(file, error) of what could not be used."""
    return rows.where("error is not null").select("file", "error")


def source_reviews(newest: DataFrame) -> DataFrame:
    """One row a verdict: review_id, participant, opportunity_id, status, field, note, and the ids of its evidence."""
    each = newest.select("review_id", at(_value(), "$.review.participant_code").alias("participant"), F.explode(at(_value(), "$.review.source_reviews", "array<variant>")).alias("v"))
    v = F.col("v")

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.nullif(at(v, f"$.{name}"), F.lit("")), F.lit(default)).alias(name)

    ids = F.coalesce(at(v, "$.evidence_ids", "array<string>"), F.array().cast("array<string>"))
    kept = [text("opportunity_id"), text("opportunity_number"), text("title"), text("agency"), text("status", "unknown"), text("field", "overall"), text("note"), text("document_url"), text("document_sha256"), text("document_version")]
    return each.select("review_id", F.coalesce("participant", F.lit("")).alias("participant"), *kept, F.array_join(ids, ";").alias("evidence_ids"))


def change_events(rows: DataFrame) -> DataFrame:
    """Events of change files (file, value): id, type, opportunity_id, changed_at, label, detail and the record's title; files that are no such object give none."""
    each = rows.select(F.explode(at(_value(), "$.events", "array<variant>")).alias("v"))
    v = F.col("v")
    fields = [at(v, f"$.{c}").alias(c) for c in ("id", "type", "opportunity_id")]
    return each.select(*fields, strict_iso_date(F.substring(at(v, "$.changed_at"), 1, 10)).alias("changed_at"), at(v, "$.label").alias("label"), at(v, "$.detail").alias("detail"), at(v, "$.record.title").alias("title"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(part, name, n): verdicts of ``source_reviews`` by status and by field."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("name")) for c in ("status", "field")]))
    return verdicts.select(pair.alias("p")).groupBy("p.part", "p.name").agg(F.count(F.lit(1)).alias("n"))


def failed_checks(newest: DataFrame) -> DataFrame:
    """(name, n) of the checks answered with no."""
    each = newest.select(F.explode(at(_value(), "$.review.deployment_checks", "map<string,variant>")).alias("name", "v"))
    return each.where(at(F.col("v"), "$") == "no").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def usage(newest: DataFrame) -> DataFrame:
    """(name, n): counters of all reviews added up; what is no whole number counts as none."""
    each = newest.select(F.explode(at(_value(), "$.review.usage", "map<string,variant>")).alias("name", "v"))
    return each.groupBy("name").agg(F.sum(F.coalesce(F.floor(at(F.col("v"), "$", "double")), F.lit(0))).cast("long").alias("n"))


def evaluations(rows: DataFrame) -> DataFrame:
    """Evaluation files (file, value) with error."""
    is_list = kind_of(at(_value(), "$.feedback", "variant")) == "ARRAY"
    return checked(rows, [*_whole("unsupported evaluation schema"), (is_list, "feedback must be a list")])


def judgments(evaluated: DataFrame) -> DataFrame:
    """Judgments with a known label of good files: file, opportunity_id, label, reason, ranks, provider, model, prompt_version and in_candidates.

    ``in_candidates`` is null where the session names no candidates. A rank has
    to be a whole number above zero.
    """
    good = evaluated.where("error is null")
    named = F.filter(F.coalesce(at(_value(), "$.session.candidate_ids", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    each = good.select("file", F.coalesce(at(_value(), "$.prompt_version"), F.lit("unspecified")).alias("prompt_version"), named.alias("candidates"), F.explode(at(_value(), "$.feedback", "array<variant>")).alias("v"))
    v = F.col("v")

    def rank(name: str) -> Column:
        value = at(v, f"$.{name}", "long")
        return F.when((kind_of(at(v, f"$.{name}", "variant")) == "BIGINT") & (value > 0), value).alias(name)

    listed = F.when(F.size("candidates") > 0, F.array_contains("candidates", F.coalesce(at(v, "$.opportunity_id"), F.lit("None"))))
    fields = [at(v, f"$.{c}").alias(c) for c in ("opportunity_id", "label")]
    reason = F.coalesce(F.nullif(at(v, "$.reason"), F.lit("")), F.lit("unspecified"))
    model = F.concat_ws(" / ", *[F.coalesce(F.nullif(at(v, f"$.{c}"), F.lit("")), F.lit("none")) for c in ("provider", "model")])
    out = each.select("file", *fields, reason.alias("reason"), rank("retrieval_rank"), rank("ai_rank"), model.alias("provider_model"), "prompt_version", listed.alias("in_candidates"))
    return out.where(F.col("label").isin(*LABELS))
