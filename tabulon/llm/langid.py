"""Language identification by the nearest of several centroids per language.

A text's vector holds hashed byte n-grams (2 to 4, lower case, anything but
letters as one space), weighted log(1 + tf) * idf and normalised. Each
language's training vectors are clustered (spherical k-means); a text gets the
language of the centroid with the highest cosine. It is marked ``rejected``
where that cosine lies below the centroid's radius, the ``REJECT`` quantile of
its own training cosines.

Training uses at most ``SAMPLE`` different (id, text) rows a language, in hash
order of both, so no language is lost to repeated ids. Texts of any length are
learnt from whole: each becomes its n-gram counts (16 KB) where it is read, and
only those meet in one Spark group a language. Prediction reads whole texts.
Every task holds all centroids, 80 KB a language.

Null texts and texts without any letter are ``und`` with score 0. Rows with a
null language are not learnt from; without any to learn from all texts are
``und``. Repeated rows get equal answers; ties go to the first language in
code-point order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import held_out, materialise

DIM, SAMPLE, CLUSTERS, ROUNDS, REJECT = 1 << 12, 800, 5, 8, 0.005
FOLDS, FOLD = 4, 2
BROADCAST_LANGS = 10_000
#: Groups in which the document frequencies of all languages are added up.
SUMS = 64
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_PIECE = 4_000_000


def counts(text: str | None) -> np.ndarray:
    """n-gram counts of a whole text; long texts are worked off in pieces."""
    out = np.zeros(DIM, np.float32)
    data = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    for at in range(0, len(data), _PIECE):
        x = np.frombuffer(data[at : at + _PIECE + 3], np.uint8).astype(np.uint32)
        h = x * np.uint32(0x9E3779B1)
        for n in range(2, 5):
            if len(x) < n:
                break
            h = (h[:-1] ^ x[n - 1 :]) * np.uint32(0x85EBCA6B)
            own = h[: min(len(h), _PIECE)]  # a piece's last three bytes belong to the next
            out += np.bincount((own ^ (own >> np.uint32(15))) >> np.uint32(3) & np.uint32(DIM - 1), minlength=DIM)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a text without n-grams gives zeros."""
    return weighted(np.array([counts(t) for t in texts], np.float32).reshape(len(texts), DIM), idf)


def weighted(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The same of rows of counts."""
    x = np.log1p(grams) * idf
    length = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: (centroids, each row's cosine to its own)."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-9)
    return centres.astype(np.float32), (x @ centres.T)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, h, grams): n-gram counts of at most SAMPLE training texts a language."""
    text = F.col(text_col).cast("string")
    rows = docs.where(~held_out(id_col, FOLDS, FOLD)).select(F.col(lang_col).alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # different rows, within a few percent; twice as many as are needed pass
    counts_ = materialise(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "langid-counts")
    share = counts_.select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("n")).alias("share"))
    if counts_.count() <= BROADCAST_LANGS:  # so that only thinned rows are dealt by language
        share = F.broadcast(share)
    thinned = rows.join(share, F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000)

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([counts(t).tobytes() for t in texts], dtype=object)

    once = thinned.select("lang", "h", grams("text").alias("grams")).dropDuplicates(["lang", "h"])
    first = W.partitionBy("lang").orderBy("h")
    return once.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE).select("lang", "h", "grams")


def _rows(grams: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(grams), np.float32).reshape(len(grams), DIM)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple | None:
    """(idf, languages of the centroids, centroids, radii); None without training rows."""
    chosen = materialise(sample(docs, id_col, text_col, lang_col), "langid-sample")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({"n": [len(rows)], "df": [(_rows(rows["grams"]) > 0).sum(axis=0).astype(np.float64).tobytes()]})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [rows["n"].sum()], "df": [sum(np.frombuffer(b, np.float64) for b in rows["df"]).tobytes()]})

    parts = chosen.select("grams").mapInPandas(seen, "n long, df binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SUMS)))
    found = parts.groupBy("part").applyInPandas(summed, "n long, df binary").toPandas()  # SUMS rows at most
    if found.empty:
        return None
    df = sum(np.frombuffer(b, np.float64) for b in found["df"])
    idf = (np.log((1 + found["n"].sum()) / (1 + df)) + 0.05).astype(np.float32)

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        x = weighted(_rows(rows.sort_values("h")["grams"]), idf)
        centres, cos = cluster(x, CLUSTERS)
        own, best = cos.argmax(axis=1), cos.max(axis=1)
        radius = [float(np.quantile(best[own == c], REJECT)) if (own == c).any() else 0.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "nth": range(len(centres)), "centre": [c.tobytes() for c in centres], "radius": radius})

    made = chosen.groupBy("lang").applyInPandas(centroids, "lang string, nth int, centre binary, radius double").toPandas()
    made = made.sort_values(["lang", "nth"])
    return idf, made["lang"].tolist(), np.array([np.frombuffer(b, np.float32) for b in made["centre"]]), made["radius"].to_numpy()


def predict(docs: DataFrame, model: tuple | None, text_col: str = "text"):
    """Column struct(lang_pred, score, rejected) for ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        idf, langs, centres, radii = held.value
        names = np.array(langs, dtype=object)
        for texts in batches:
            parts = []
            for at in range(0, len(texts), 256):
                cos = vectors(texts.iloc[at : at + 256].tolist(), idf) @ centres.T
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(cos)), best].astype(float)
                parts.append(pd.DataFrame({"lang_pred": names[best], "score": np.clip(top, 0, 1), "rejected": top < radii[best]}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return unknown
    text = F.col(f"`{text_col}`").cast("string")
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), nearest(text)).otherwise(unknown)
