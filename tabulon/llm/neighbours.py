"""Nearest neighbours by inner product over shifted Hilbert curves, completed exactly.

Vectors are projected to a few dimensions by seeded rotations, shifted, and put
on Hilbert curves. Spark range-partitions each ordering; within it every query
is compared with its neighbouring key window, and the windows of all curves are
merged and reranked: these are the candidates. On vectors without structure
windows alone find too few neighbours (see README), so a second step makes them
complete. The first ordering is cut into blocks of neighbouring keys; where a
block's centre and radius do not prove that nothing in it can beat the last of
a query's ``k + 1`` candidates, block and query meet and are scored in full.
Only centres are dealt to all queries; vectors are shuffled for pairs that
remain. The result is exact whatever the curves gave.

Equal vectors are one candidate that keeps its ``k + 1`` smallest ids, so a
vector that fills a third of the table costs no more than any other.

Rows take no part whose id is null, whose vector is null, zero, or holds null
or non-finite components, or whose length is not the most frequent one (the
larger of two equally frequent). Repeated ids are one row each. Ties go to the
smaller id. A query without candidates gives no rows; an empty table an empty
result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import materialise

CURVES, DIMS, BITS, REACH = 4, 8, 7, 250
BLOCK, GROUP, BALLS = 2048, 512, 4096
SEED = 11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell coordinates on the Hilbert curve (Skilling, 2004)."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for row in x:
            key = key << 1 | row >> b & 1
    return key


def curve_keys(vectors: np.ndarray, curves: int = CURVES) -> np.ndarray:
    """(rows, curves) keys: directions, rotated, shifted by a part of the grid, on ``DIMS`` axes."""
    unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    size, out = unit.shape[1], []
    for c in range(curves):
        rng = np.random.default_rng((SEED, c))
        axes = np.linalg.qr(rng.standard_normal((size, size)))[0][:, : min(DIMS, size)]
        spread = np.clip(unit @ axes * np.sqrt(size) / 6 + 0.5, 0, 1)
        out.append(hilbert(((spread + rng.random(axes.shape[1])) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS))
    return np.stack(out, axis=1)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).select("n")
    return rows.join(F.broadcast(common), F.size("vec") == F.col("n")).drop("n")


def distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """(vec, first, ids, asked): each vector with its k + 1 smallest ids; whether a query has it."""
    salted = W.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    some = rows.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k + 1)
    ids = some.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.collect_list("id").alias("ids"))
    ids = ids.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    asked = rows.where(F.col("id") % every == 0).select(F.col("vec").alias("q_vec")).distinct()
    met = ids.join(asked, F.col("vec") == F.col("q_vec"), "left")
    return met.select("vec", F.element_at("ids", 1).alias("first"), "ids", F.col("q_vec").isNotNull().alias("asked"))


def _window_scores(batches: Iterator[pd.DataFrame], reach: int, k: int) -> Iterator[pd.DataFrame]:
    """Best scores of each query within ``reach`` places before and behind it; rows come in curve order."""
    kept = None
    for batch in _ended(batches):
        frame = batch if kept is None else kept if batch is None else pd.concat([kept, batch], ignore_index=True)
        if frame is None or frame.empty:
            continue
        done = int(frame["done"].sum())
        until = len(frame) if batch is None else max(done, len(frame) - reach)
        x = _matrix(frame["vec"])
        curve, asked, first = frame["curve"].to_numpy(), frame["asked"].to_numpy(), frame["first"].to_numpy()
        for a in range(done, until, 512):
            b = min(a + 512, until)
            at = np.flatnonzero(asked[a:b]) + a
            if not len(at):
                continue
            lo, hi = max(0, a - reach), min(len(frame), b + reach)
            scores = x[at] @ x[lo:hi].T
            far = (np.abs(at[:, None] - np.arange(lo, hi)) > reach) | (curve[at][:, None] != curve[lo:hi])
            scores[far] = -np.inf
            n = min(k + 1, hi - lo)
            top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            there = np.isfinite(np.take_along_axis(scores, top, axis=1)).ravel()
            q, other = np.repeat(at, n)[there], lo + top.ravel()[there]
            yield pd.DataFrame({"query": first[q], "other": first[other], "score": _products(x[q], x[other])})
        kept = frame.iloc[max(0, until - reach) :].copy()
        kept["done"] = [True] * min(until, reach) + [False] * (len(frame) - until)


def _ended(batches):
    yield from batches
    yield None


def window_candidates(curves: DataFrame, k: int, reach: int = REACH) -> DataFrame:
    """(query, other, score, nth): the k + 1 best that the windows of all curves give each query, merged and reranked."""
    ordered = curves.repartitionByRange("curve", "key", "first").sortWithinPartitions("curve", "key", "first").withColumn("done", F.lit(False))
    near = ordered.mapInPandas(lambda b: _window_scores(b, reach, k), "query long, other long, score double").groupBy("query", "other").agg(F.max("score").alias("score"))
    ranked = near.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "other")))
    return ranked.where(F.col("nth") <= k + 1)


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield batch.assign(part=part, place=np.arange(at, at + len(batch)))
        at += len(batch)


def in_blocks(ordered: DataFrame) -> DataFrame:
    """``ordered`` (sorted, range-partitioned) with ``block``: runs of BLOCK neighbouring rows."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    rows = materialise(ordered.mapInPandas(_numbered, f"{schema}, part int, place long"), "curve-order")
    sizes = rows.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("p", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.join(starts, F.col("part") == F.col("p"))
    return numbered.withColumn("block", F.floor((F.col("before") + F.col("place")) / BLOCK).cast("int")).drop("part", "p", "place", "before")


def _ball(rows: pd.DataFrame) -> pd.DataFrame:
    """Centre and radius of one block."""
    x = _matrix(rows["vec"])
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "centre": [centre.tolist()], "radius": [radius]})


def _reached(queries: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
    """(first, blocks): the blocks in which something may reach a query's bar; BALLS at most in one row."""
    if queries.empty or balls.empty:
        return pd.DataFrame({"first": np.array([], np.int64), "blocks": np.array([], object)})
    q, c = _matrix(queries["vec"]), _matrix(balls["centre"])
    most = q @ c.T + np.sqrt((q**2).sum(axis=1))[:, None] * balls["radius"].to_numpy() * (1 + 1e-9) + 1e-12
    blocks = balls["block"].to_numpy()
    return pd.DataFrame({"first": queries["first"].to_numpy(), "blocks": [blocks[met] for met in most >= queries["bar"].to_numpy()[:, None]]})


def _rest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of some queries and one block: at most k + 1 candidates a query, none below its bar."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"query": np.array([], np.int64), "other": np.array([], np.int64), "score": np.array([], float)})
    q, x, bar = _matrix(queries["vec"]), _matrix(rows["vec"]), queries["bar"].to_numpy()
    scores = q @ x.T
    n = min(k + 1, len(x))
    if n < len(x):  # ties with the last that counts stay, so that ids decide later
        last = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
        bar = np.maximum(bar, last - np.abs(last) * 1e-12)
    i, j = np.nonzero(scores >= bar[:, None])
    return pd.DataFrame({"query": queries["first"].to_numpy()[i], "other": rows["first"].to_numpy()[j], "score": _products(q[i], x[j])})


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order."""
    return np.cumsum(a * b, axis=1)[:, -1]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vector_col)

    @F.pandas_udf("array<long>")
    def keys(vecs: pd.Series) -> pd.Series:
        return pd.Series(list(curve_keys(_matrix(vecs)))) if len(vecs) else pd.Series([], dtype=object)

    singles = materialise(distinct_vectors(rows, k, every).withColumn("keys", keys("vec")), "distinct-vectors")
    curves = singles.select("vec", "first", "asked", F.posexplode("keys").alias("curve", "key"))
    near = materialise(window_candidates(curves, k), "window-candidates")
    # a hair's breadth below: the two passes may round a product differently
    bars = near.where(F.col("nth") == k + 1).select("query", (F.col("score") - F.abs("score") * 1e-9 - 1e-12).alias("bar"))

    blocks = in_blocks(singles.withColumn("key", F.element_at("keys", 1)).select("vec", "first", "key").repartitionByRange("key", "first").sortWithinPartitions("key", "first"))
    blocks = materialise(blocks.select("vec", "first", "block"), "blocks")
    balls = blocks.groupBy("block").applyInPandas(_ball, "block int, centre array<double>, radius double").withColumn("chunk", F.floor(F.col("block") / BALLS).cast("int"))
    n = singles.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    n_chunks, n_groups = max(1, -(-n[0] // (BLOCK * BALLS))), max(1, -(-n[1] // GROUP))
    asked = singles.where("asked").select("vec", "first").join(bars, F.col("first") == F.col("query"), "left")
    asked = asked.select("vec", "first", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"), F.pmod(F.xxhash64("first"), F.lit(n_groups)).cast("int").alias("group"))
    asked = materialise(asked, "queries")
    spread = balls.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    spread = spread.select(F.col("group").alias("g"), F.col("chunk").alias("c"), "block", "centre", "radius")
    met = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).groupBy("group", "chunk")
    open_ = materialise(met.cogroup(spread.groupBy("g", "c")).applyInPandas(_reached, "first long, blocks array<int>"), "open-pairs")
    # the file packs the pairs so well that its size says nothing of their number: they are never to be broadcast
    left = asked.join(open_.hint("merge"), "first").select("group", F.explode("blocks").alias("block"), "vec", "first", "bar")
    groups = open_.select(F.pmod(F.xxhash64("first"), F.lit(n_groups)).cast("int").alias("g"), F.explode("blocks").alias("b")).distinct()
    against = blocks.join(groups.hint("merge"), F.col("block") == F.col("b")).select("g", "b", "vec", "first")
    found = left.groupBy("group", "block").cogroup(against.groupBy("g", "b")).applyInPandas(lambda a, b: _rest(a, b, k), "query long, other long, score double")
    # what both steps found counts once, as the windows scored it
    both = near.select("query", "other", "score", F.lit(0).alias("step")).unionByName(found.withColumn("step", F.lit(1)))
    both = both.groupBy("query", "other").agg(F.min_by("score", "step").alias("score"))
    best = both.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "other"))).where(F.col("nth") <= k + 1)
    best = best.join(singles.select(F.col("first").alias("other"), "ids"), "other")
    lists = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    owners = singles.where("asked").select(F.col("first").alias("query"), F.col("vec").alias("q_vec"))
    asking = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("own_vec"))
    answered = lists.join(owners, "query").join(asking, F.col("q_vec") == F.col("own_vec")).select("query_id", "found")
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("low"), i.alias("vec_id")))))
    others = F.filter(flat, lambda s: s["vec_id"] != F.col("query_id"))
    top = F.slice(F.array_sort(others), 1, k)
    out = answered.select("query_id", F.posexplode(top).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.low")).alias("score"))
