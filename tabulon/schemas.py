"""The record schema: dated, multi-valued, text-heavy rows. Readers use it and never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = """opportunity_id opportunity_number title agency agency_code status source source_type version detail_page
funding_opportunity_url primary_document_url close_date_note fiscal_year eligibility_text opportunity_category description
document_search_text award_source""".split()
_DATE = "posted_date close_date archive_date last_updated source_first_seen_date estimated_award_date estimated_project_start".split()
_LIST = """funding_category_codes funding_categories funding_instrument_codes funding_instruments eligibility_codes
applicant_types disciplines topic_areas aln document_urls""".split()
_LONG = "award_floor award_ceiling total_program_funding expected_number_of_awards".split()
_FLAG = "rolling status_verification_required cost_share_required has_preliminary_stage limited_submission".split()

DEADLINE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "time", "timezone", "note", "source", "confidence")]
    + [T.StructField("date", T.DateType()), T.StructField("estimated", T.BooleanType())]
)

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.DateType()) for n in _DATE]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in _LIST]
    + [T.StructField(n, T.LongType()) for n in _LONG]
    + [T.StructField(n, T.BooleanType()) for n in _FLAG]
    + [T.StructField("deadlines", T.ArrayType(DEADLINE))]
)


def conform(df: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones null, others cast or dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
