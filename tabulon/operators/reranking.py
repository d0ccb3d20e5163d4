"""Rankings from outside, held to what they were asked about.

An answer names ids in its own order: some unknown, some twice, some missing.
Its known ids keep that order, each once; own candidates fill what is left, in
theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Candidates that are sent, matches that are taken from an answer, ids and citations of a chat's answer.
MOST_CANDIDATES, MOST_MATCHES, MOST_IDS, MOST_CITATIONS = 32, 12, 8, 8


def known_ids(asked: Column, allowed: Column, most: int = MOST_IDS) -> Column:
    """Allowed ids of an array in its order, each once, at most ``most``."""
    known = F.filter(F.coalesce(asked, F.array().cast("array<string>")), lambda x: F.coalesce(F.array_contains(allowed, x), F.lit(False)))
    return F.slice(F.array_distinct(known), 1, most)


def known_citations(asked: Column, available: Column, most: int = MOST_CITATIONS) -> Column:
    """Citations (array of structs with evidence_id) that an answer names, in its order, each once; of equal ids the last."""
    ids = F.array_distinct(F.coalesce(asked, F.array().cast("array<string>")))
    found = F.transform(ids, lambda i: F.try_element_at(F.filter(available, lambda c: c["evidence_id"] == i), F.lit(-1)))
    return F.slice(F.filter(found, lambda c: c.isNotNull()), 1, max(1, min(20, most)))


def chat_ids(answer_active: Column, answered: Column, matched: Column, most: int = 20) -> Column:
    """Ids that a chat is about: those of the active answer, else the first matches, each once."""
    ids = F.when(answer_active, answered).otherwise(F.slice(matched, 1, most))
    return F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.coalesce(i != "", F.lit(False))))


def profile_context(profile: dict[str, Column], most: int = 12_000) -> Column:
    """struct of what an answer may know of a profile; the CV only where its owner allows it, cut, with a note on the cut."""
    cv = F.when(F.coalesce(profile["include_cv"], F.lit(False)), F.nullif(profile["cv_text"], F.lit("")))
    note = F.when(F.length(cv) > most, f"First {most:,} characters of the locally extracted CV").when(cv.isNotNull(), "Complete locally extracted CV text")
    texts = [F.nullif(profile[n], F.lit("")).alias(n) for n in ("research_description", "expertise_keywords")]
    return F.struct(*texts, *[profile[n].alias(n) for n in ("applicant_context", "career_stage")], F.substring(cv, 1, most).alias("cv_excerpt"), note.alias("cv_excerpt_note"))


def candidates(ranked: DataFrame, by: list[str], order: list[Column], most: int = MOST_CANDIDATES) -> DataFrame:
    """The first ``most`` rows of each group, with ``candidate`` from 1."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return ranked.withColumn("candidate", place).where(F.col("candidate") <= most)


def reranked(own: DataFrame, answers: DataFrame, by: list[str], key: str, most: int = MOST_MATCHES, fill: bool = False) -> DataFrame:
    """(by, key, position, score, verdict, origin) of each group's final order.

    ``own``: candidates (by, key, candidate); ``answers``: (by, key, place,
    score, verdict). An id counts where it is named first, and only if it is a
    candidate; scores are rounded into 0 to 100. With ``fill`` the candidates
    that are not named follow in their own order; at most ``most`` rows a group.
    """
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)) + 0.5))).cast("int")
    verdict = F.coalesce(F.nullif("verdict", F.lit("")), F.lit("Possible fit"))
    first = answers.select(*by, F.col(key).cast("string").alias(key), "place", score.alias("score"), verdict.alias("verdict"))
    first = first.groupBy(*by, key).agg(F.min_by(F.struct("place", "score", "verdict"), "place").alias("a"))
    mine = own.select(*by, F.col(key).cast("string").alias(key), "candidate")
    met = mine.join(first, [*by, key], "left" if fill else "inner")
    named = F.col("a").isNotNull()
    place = F.row_number().over(W.partitionBy(*by).orderBy(~named, F.col("a.place"), "candidate"))
    out = met.withColumn("position", place).where(F.col("position") <= most)
    return out.select(*by, key, "position", "a.score", "a.verdict", F.when(named, "answer").otherwise("own").alias("origin"))
