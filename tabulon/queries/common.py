"""Shared tables of the registered queries.

``RECORDS`` turns orders, customers and nations into dated, multi-valued
records. The text is plain SQL that both engines read; only the array
constructor differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "1998-06-15"


def as_of() -> Column:
    return F.to_date(F.lit(AS_OF))


RECORDS = """
SELECT CAST(o_orderkey AS STRING) AS opportunity_id,
       o_orderkey AS ordinal,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'N ' || CAST(o_orderkey % 4000 AS STRING) END AS opportunity_number,
       CASE WHEN o_orderkey % 62 = 31 THEN 'NE-' || CAST(o_orderkey AS STRING) || ' Notice of Intent to issue ' ELSE '' END || o_orderpriority || ' ' || c_mktsegment || CASE WHEN o_orderkey % 62 = 0 THEN ' notice of intent' WHEN o_orderkey % 2 = 0 THEN ' studies' ELSE ' training' END AS title,
       n_name AS agency,
       CASE WHEN o_orderkey % 37 = 0 THEN 'draft' WHEN o_orderstatus = 'F' THEN 'posted' WHEN o_orderstatus = 'O' THEN 'forecasted' ELSE 'Archived' END AS status,
       CAST(o_orderkey % 12 AS STRING) AS version,
       CASE WHEN o_orderkey % 11 = 0 THEN 'We are not accepting applications now.' ELSE 'Support for ' || c_mktsegment || ' in ' || n_name || CASE WHEN o_orderkey % 13 = 0 THEN ', on a rolling basis' ELSE '' END END AS description,
       CASE WHEN o_orderkey % 9 = 0 THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 400 DAY AS DATE) ELSE CAST(o_orderdate AS DATE) END AS last_updated,
       CAST(o_orderdate AS DATE) AS posted_date,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAY AS DATE) END AS close_date,
       CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY AS DATE) END AS archive_date,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(year(CAST(o_orderdate AS DATE)) AS STRING) END AS fiscal_year,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 200 DAY AS DATE) END AS estimated_award_date,
       CASE WHEN o_orderkey % 8 = 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 300 DAY AS DATE) END AS estimated_project_start,
       o_orderkey % 13 = 0 AS rolling,
       CASE WHEN o_orderkey % 11 = 0 THEN ARRAY('O') ELSE ARRAY('G', 'CA') END AS funding_instruments,
       CASE WHEN o_orderkey % 10 = 0 THEN ARRAY(c_mktsegment, c_mktsegment) ELSE ARRAY(c_mktsegment, o_orderpriority) END AS topic_areas,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 2) AS BIGINT) END AS award_floor,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS award_ceiling,
       CASE WHEN o_orderkey % 3 = 1 THEN 'https://docs.example.gov/' || CAST(o_orderkey % 500 AS STRING) || '.pdf' END AS primary_document_url,
       CASE WHEN o_orderkey % 5 = 2 THEN 'http://agency' || CAST(n_nationkey AS STRING) || '.example.gov/calls' END AS funding_opportunity_url,
       'https://records.example.org/' || CAST(o_orderkey AS STRING) AS detail_page
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def duck(sql: str) -> str:
    return sql.replace("ARRAY(", "list_value(")


#: The same as a common table for oracles.
R = f"r AS ({duck(RECORDS)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over the named tables, given as arguments so that no view outlives the query."""
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, RECORDS, "orders", "customer", "nation")


def query(name: str, oracle: str | None = None):
    """Registers a query, and its DuckDB SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add
