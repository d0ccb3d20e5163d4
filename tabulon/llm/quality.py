"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (lower case, white space as one space) with
n-grams up to ``ORDER``, named by 64-bit hashes. Distinct n-grams are counted
per block, a run of ``BLOCK_ROWS`` rows of an input file, and summed in Spark; continuation counts, discounts, back-off
weights and probabilities come from joins on the hashes, which shard them.
For scoring, the distinct n-grams of every block are joined with the model,
which gives each block just the probabilities that its own documents need; the
tasks that read its rows again look them up. Blocks go by the rows' places in
their files, so they stay the same however the input is split. Texts are never shuffled, and the
model is never held whole by one task.

A document is kept if its perplexity is at most its language's threshold: the
``QUANTILE`` of the perplexities of that language's trusted documents in a fold
(one of ``FOLDS``) that the model is not trained on; of all languages' where it
has none there, and of those trained on where no language has.

Null, empty and blank texts have a null perplexity and are not kept. A null
language is a language of its own. Without trusted text all characters are
equally likely, thresholds are null and nothing is kept. Repeated rows count
and are returned as often as they occur; a trusted id makes all its rows
trusted. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import held_out, materialise, new_path

ORDER, QUANTILE, BLOCK_ROWS = 4, 0.995, 8192
FOLDS, FOLD = 5, 0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE, _HELD = 500_000, 500_000
_GRAM = "ord int, block long, h long, ctx long, suf long, n long"


def symbols(text: str | None) -> np.ndarray:
    """Code points of the normalised text behind ORDER - 1 starts (0)."""
    return np.concatenate([np.zeros(ORDER - 1, np.uint64), np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)])


def hashes(x: np.ndarray) -> list[np.ndarray]:
    """For n = 0..ORDER: the hash of the n symbols that end at each position from ORDER - 2 on.

    The first entry ends before the first real symbol; it is needed as a context.
    """
    size = len(x) - ORDER + 2
    out = [np.full(size, 1, np.uint64)]
    for n in range(1, ORDER + 1):
        h = np.full(size, n, np.uint64)
        for back in range(n):  # the symbol itself first, then those before it
            at = ORDER - 2 - back
            part = x[at : at + size] if at >= 0 else np.concatenate([np.zeros(-at, np.uint64), x[: size + at]])
            h = (h ^ (part + np.uint64(1))) * _MIX
            h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    x = symbols(text)
    for at in range(0, len(x) - ORDER + 1, _PIECE):
        yield x[at : at + _PIECE + ORDER - 1]


class _Side:
    """Small arrays of each block in the shared folder, the last one kept."""

    def __init__(self, uri: str):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(uri)
        self.block, self.arrays = None, {}

    def write(self, block: int, **arrays: np.ndarray) -> None:
        data = io.BytesIO()
        np.savez(data, **arrays)
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(f"{self.folder}/{block}.npz") as f:
            f.write(data.getvalue())

    def read(self, block: int, must: bool = False) -> dict[str, np.ndarray]:
        if block != self.block:
            path = f"{self.folder}/{block}.npz"
            there = self.fs.get_file_info(path).type == pyarrow.fs.FileType.File
            if must and not there:
                raise FileNotFoundError(f"the model of block {block} is missing: {path}")
            self.arrays = {}
            if there:
                with self.fs.open_input_stream(path) as f:
                    self.arrays = dict(np.load(io.BytesIO(f.read())))
            self.block = block
        return self.arrays


def _store(rows: DataFrame, uri: str, columns: list[str]) -> None:
    """One side file a block from (block, columns), sorted by the first column."""

    def save(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(columns[0])
        block = int(part["block"].iloc[0])
        _Side(uri).write(block, **{c: part[c].to_numpy() for c in columns})
        return pd.DataFrame({"block": [block], "n": [len(part)]})

    materialise(rows.groupBy("block").applyInPandas(save, "block long, n long"), "side-files")


class _Counter:
    """Distinct n-grams of one block, folded every ``_HELD`` symbols so that memory follows the distinct ones."""

    def __init__(self):
        self.seen: list[np.ndarray] = []
        self.trusted: list[pd.DataFrame] = []
        self._texts: list[list[np.ndarray]] = []
        self._good: list[list[np.ndarray]] = []
        self._mass = 0

    def add(self, hs: list[np.ndarray], trusted: bool) -> None:
        self._texts.append(hs)
        if trusted:
            self._good.append(hs)
        self._mass += len(hs[0])
        if self._mass > _HELD:
            self.fold()

    def fold(self) -> None:
        if self._texts:
            self.seen = [pd.unique(np.concatenate([*self.seen, *(h for hs in self._texts for h in hs)]))]
        if self._good:
            part = {f"h{n}": np.concatenate([hs[n][1:] for hs in self._good]) for n in range(ORDER + 1)}
            part |= {f"c{n}": np.concatenate([hs[n][:-1] for hs in self._good]) for n in range(ORDER)}
            self.trusted.append(_summed(pd.DataFrame(part).assign(n=np.int64(1))))
            if len(self.trusted) > 8:
                self.trusted = [_summed(pd.concat(self.trusted, ignore_index=True))]
        self._texts, self._good, self._mass = [], [], 0

    def rows(self, block: int) -> Iterator[pd.DataFrame]:
        self.fold()
        if self.seen:
            h = self.seen[0].view(np.int64)
            yield pd.DataFrame({"ord": np.zeros(len(h), np.int32), "block": np.int64(block), "h": h, "ctx": np.int64(0), "suf": np.int64(0), "n": np.int64(1)})
        if self.trusted:
            own = _summed(pd.concat(self.trusted, ignore_index=True))
            for n in range(ORDER, 0, -1):
                columns = {k: own[c].to_numpy().view(np.int64) for k, c in (("h", f"h{n}"), ("ctx", f"c{n - 1}"), ("suf", f"h{n - 1}"))}
                out = pd.DataFrame({"ord": np.int32(n), "block": np.int64(0), **columns, "n": own["n"].to_numpy()})
                yield out if n == ORDER else out.drop_duplicates("h")


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a highest-order n-gram with its summed count."""
    codes, _ = pd.factorize(rows[f"h{ORDER}"].to_numpy())
    count = np.bincount(codes, weights=rows["n"].to_numpy()).astype(np.int64)
    first = np.empty(len(count), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return rows.iloc[first].assign(n=count)


def _grams(batches: Iterator[pd.DataFrame], trusted_uri: str) -> Iterator[pd.DataFrame]:
    """ord 0: (block, h) of every n-gram of all texts; ord n: n-grams of trusted texts with context, suffix and, for the highest order, count."""
    side, block, found = _Side(trusted_uri), None, _Counter()
    for batch in batches:
        for doc_id, text, own in zip(batch["id"].tolist(), batch["text"], batch["block"].tolist()):
            if own != block:
                if block is not None:
                    yield from found.rows(block)
                block, found = own, _Counter()
            ids = side.read(own).get("id", np.array([], np.int64))
            known = doc_id is not None and doc_id == doc_id
            at = np.searchsorted(ids, doc_id) if known else len(ids)
            for x in _pieces(text):
                found.add(hashes(x), bool(at < len(ids) and ids[at] == doc_id))
    if block is not None:
        yield from found.rows(block)


def model(trusted: DataFrame) -> tuple[DataFrame, int]:
    """((h, logp, back): log-probability of each n-gram, log back-off weight of each context; number of characters)."""
    grams = materialise(trusted.groupBy("ord", "h").agg(F.first("ctx").alias("ctx"), F.first("suf").alias("suf"), F.sum("n").alias("n")), "trusted-grams")
    follows = grams.where("ord > 1").groupBy(F.col("suf").alias("of")).agg(F.count(F.lit(1)).alias("m"))
    adjusted = grams.join(follows, (F.col("h") == F.col("of")) & (F.col("ord") < ORDER), "left")
    adjusted = materialise(adjusted.select("ord", "h", "ctx", "suf", F.when(F.col("ord") == ORDER, F.col("n")).otherwise(F.col("m")).alias("a")), "adjusted-counts")
    shape = adjusted.groupBy("ord").agg(*[F.count_if(F.col("a") == i).alias(f"n{i}") for i in range(1, 5)], F.count(F.lit(1)).alias("types")).collect()
    if not shape:
        return adjusted.select("h", F.lit(0.0).alias("logp"), F.lit(0.0).alias("back")), 0
    discount: dict[int, list[float]] = {}
    for row in shape:
        n = [max(1, row[f"n{i}"]) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        discount[row["ord"]] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
    alphabet = next(r["types"] for r in shape if r["ord"] == 1)

    def cut(a):
        by_order = [F.when(F.col("ord") == o, F.when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])) for o, d in discount.items()]
        return F.coalesce(*by_order)

    a = F.col("a")
    stats = adjusted.groupBy("ord", "ctx").agg(F.sum("a").alias("total"), F.sum(cut(a)).alias("freed"))
    stats = materialise(stats.select(F.col("ord").alias("s_ord"), F.col("ctx").alias("s_ctx"), "total", (F.col("freed") / F.col("total")).alias("weight")), "contexts")
    rows = adjusted.join(stats, (F.col("ord") == F.col("s_ord")) & (F.col("ctx") == F.col("s_ctx")))
    rows = materialise(rows.select("ord", "h", "suf", ((a - cut(a)) / F.col("total")).alias("own"), "weight"), "own-shares")
    known = rows.where("ord = 1").select("h", (F.col("own") + F.col("weight") / (alphabet + 1)).alias("p"))
    every = known
    for n in range(2, ORDER + 1):
        lower = known.select(F.col("h").alias("l_h"), F.col("p").alias("l_p"))
        known = materialise(rows.where(F.col("ord") == n).join(lower, F.col("suf") == F.col("l_h")).select("h", (F.col("own") + F.col("weight") * F.col("l_p")).alias("p")), "probabilities")
        every = every.unionByName(known)
    backs = stats.select(F.col("s_ctx").alias("h"), F.log("weight").alias("back"))
    return every.select("h", F.log("p").alias("logp")).join(backs, "h", "full_outer"), alphabet


def _scores(batches: Iterator[pd.DataFrame], model_uri: str, trusted_uri: str, alphabet: int) -> Iterator[pd.DataFrame]:
    models, ids_of = _Side(model_uri), _Side(trusted_uri)

    def look(table: dict, name: str, h: np.ndarray) -> np.ndarray:
        keys = table.get("h")
        if keys is None or not len(keys):
            return np.full(len(h), np.nan)
        h = h.view(np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, table[name][at], np.nan)

    for batch in batches:
        out = []
        for doc_id, text, block in zip(batch["id"].tolist(), batch["text"], batch["block"].tolist()):
            total, size = 0.0, 0
            for x in _pieces(text):
                table = models.read(block, must=True)
                hs = hashes(x)
                todo, spent = np.arange(len(hs[0]) - 1), np.zeros(len(hs[0]) - 1)
                for n in range(ORDER, 0, -1):
                    found = look(table, "logp", hs[n][1:][todo])
                    hit = ~np.isnan(found)
                    total += float((found[hit] + spent[todo[hit]]).sum())
                    todo = todo[~hit]
                    if not len(todo):
                        break
                    back = look(table, "back", hs[n - 1][:-1][todo])
                    spent[todo] += np.where(np.isnan(back), 0, back)
                total += float((spent[todo] - np.log(alphabet + 1)).sum())
                size += len(hs[0]) - 1
            ids = ids_of.read(block).get("id", np.array([], np.int64))
            at = np.searchsorted(ids, doc_id) if doc_id is not None and doc_id == doc_id else len(ids)
            out.append((np.exp(-total / size) if size else None, size, bool(at < len(ids) and ids[at] == doc_id)))
        part = pd.DataFrame(out, columns=["perplexity", "n_symbols", "trusted"])
        yield pd.concat([batch[["id", "lang"]].reset_index(drop=True), part], axis=1).astype({"id": "Int64", "perplexity": float})


def score(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, perplexity, n_symbols, trusted) of every document; ``trusted_ids`` has an ``id`` column."""
    spark = docs.sparkSession
    place = F.col("_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:  # not the rows of Parquet files as they lie there
        docs = materialise(docs.select(id_col, text_col, lang_col), "quality-documents")
    split = F.xxhash64("_metadata.file_path", F.floor(place / BLOCK_ROWS)).alias("block")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), split)
    trusted_uri, model_uri = new_path(spark, "trusted-ids"), new_path(spark, "split-models")
    own = rows.select("id", "block").join(trusted_ids.select("id").where("id is not null").distinct(), "id").distinct()
    _store(own.select("block", "id"), trusted_uri, ["id"])
    grams = materialise(rows.select("id", "text", "block").mapInPandas(lambda b: _grams(b, trusted_uri), _GRAM), "grams")
    table, alphabet = model(grams.where("ord > 0"))
    seen = grams.where("ord = 0").select("block", "h").distinct()
    # with a row for each block, so that none without a known n-gram lacks its file
    nothing = F.lit(None).cast("double")
    every = seen.select("block").distinct().select("block", F.lit(-(1 << 63)).alias("h"), nothing.alias("logp"), nothing.alias("back"))
    _store(seen.join(table, "h").select("block", "h", "logp", "back").unionByName(every), model_uri, ["h", "logp", "back"])
    return rows.mapInPandas(lambda b: _scores(b, model_uri, trusted_uri, alphabet), "id long, lang string, perplexity double, n_symbols long, trusted boolean")


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(doc id, lang, perplexity, threshold, keep) of every document."""
    ids = trusted_ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    scored = materialise(score(docs, ids.where(~held_out("id", FOLDS, FOLD)), id_col, text_col, lang_col), "perplexities")
    left_out = scored.join(ids.where(held_out("id", FOLDS, FOLD)), "id", "left_semi").where("perplexity is not null")
    by_lang = left_out.groupBy(F.col("lang").alias("t_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    overall = left_out.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    if overall is None:
        overall = scored.where("trusted and perplexity is not null").agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    met = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("t_lang")), "left")
    out = met.select(F.col("id").alias(id_col), "lang", "perplexity", F.coalesce("own", F.lit(overall).cast("double")).alias("threshold"))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
