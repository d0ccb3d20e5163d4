"""Field-weighted inverted index and BM25 over it, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.functions.text import token_rows, tokens
from tabulon.session import written

K1, B, PREFIX_WEIGHT, PREFIX_TERMS, PREFIX_CHARS, MOST_COMMON, FILTER_TERMS = 1.2, 0.75, 0.72, 12, 3, 0.8, 100

#: Weights of the record fields.
FIELDS = (
    ("title", 7),
    ("opportunity_number", 7),
    ("agency", 3),
    ("topic_areas", 5),
    ("disciplines", 4),
    ("funding_categories", 3),
    ("funding_instruments", 2),
    ("applicant_types", 1),
    ("eligibility_text", 1),
    ("description", 1),
    ("document_search_text", 1),
)


@dataclass(frozen=True)
class Index:
    """counts (doc_id, term, tf), words (term, df) of the terms that count, lengths (doc_id, length), totals (n_docs, avg_length: one row)."""

    counts: DataFrame
    words: DataFrame
    lengths: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(doc_id, term, tf) of the terms that count."""
        return self.counts.join(self.words.select("term"), "term", "left_semi")


def term_counts(records: DataFrame, key: str, fields: Sequence[tuple[str, int]] = FIELDS) -> DataFrame:
    """(doc_id, term, tf): weighted counts. A document's terms are all in one partition, so they are summed before the shuffle."""
    there = [(f, w) for f, w in fields if f in records.columns]

    def text(field: str) -> Column:
        kind = records.schema[field].dataType.typeName()
        return F.concat_ws(" ", field) if kind == "array" else F.col(field).cast("string")

    parts = F.array(*[F.struct(text(f).alias("text"), F.lit(w).cast("long").alias("w")) for f, w in there])
    spread = records.select(F.col(key).alias("doc_id"), F.explode(parts).alias("part")) if len(there) > 1 else records.select(F.col(key).alias("doc_id"), parts[0].alias("part"))
    return token_rows(spread, F.col("part.text"), "doc_id", F.col("part.w").alias("w")).groupBy("doc_id", "term").agg(F.sum("w").alias("tf"))


def build(records: DataFrame, key: str, fields: Sequence[tuple[str, int]] = FIELDS) -> Index:
    """The index of unique documents; terms in more than four fifths of them are left out of the postings.

    Term counts are written once, in ranges of terms, and everything else reads
    them; a term that most documents have fills several ranges.
    """
    counts = written(term_counts(records, key, fields).repartitionByRange("term", "doc_id"), "term-counts", "term")
    own = counts.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    lengths = records.select(F.col(key).alias("doc_id")).join(own, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(1)).alias("length"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.bround(F.avg("length"), 3).alias("avg_length"))
    common = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = written(common.join(F.broadcast(totals), F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n_docs") * MOST_COMMON))).select("term", "df"), "vocabulary", "term")
    return Index(counts, words, lengths, totals)


def vocabulary(index: Index) -> DataFrame:
    return index.words


def expand(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, asked, term, df, weight): exact terms, else up to twelve terms that begin with a query term.

    ``queries`` has query_id and text. Prefixes meet by equality on the cut
    term; only the lengths that occur among unmatched query terms are cut.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("asked"))
    exact = asked.join(words, F.col("asked") == F.col("term")).select("query_id", "asked", "term", "df", F.lit(1.0).alias("weight"))
    loose = asked.select("asked").distinct().join(words, F.col("asked") == F.col("term"), "left_anti").where(F.length("asked") >= PREFIX_CHARS)
    sizes = loose.agg(F.array_sort(F.collect_set(F.length("asked")))).first()[0]
    if not sizes:
        return exact
    cuts = F.filter(F.array(*map(F.lit, sizes)), lambda n: n < F.length("term"))
    starts = words.withColumn("n", F.explode(cuts)).withColumn("start", F.substring(F.col("term"), F.lit(1), F.col("n")))
    first = W.partitionBy("asked").orderBy("term")
    found = loose.join(starts, F.col("asked") == F.col("start")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PREFIX_TERMS)
    near = asked.join(found.select("asked", "term", "df"), "asked").select("query_id", "asked", "term", "df", F.lit(PREFIX_WEIGHT).alias("weight"))
    return exact.unionByName(near)


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of every document that has a term of a query.

    Few asked terms become a filter that reaches the scan of the counts, which
    lie sorted by term.
    """
    terms = written(expand(queries, vocabulary(index)), "asked-terms")
    asked = [r["term"] for r in terms.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
    counts = index.counts if len(asked) > FILTER_TERMS else index.counts.where(F.col("term").isin(asked))
    hits = terms.join(counts, "term").join(index.lengths, "doc_id").join(F.broadcast(index.totals))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    part = F.col("weight") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_documents(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of every query, ties by id, with ``position``."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return scores.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
