"""Toxicity: a bidirectional GRU with attention pooling, trained in numpy.

Each word enters as two embeddings: one of the whole word (hashed) and one of
its characters (the mean over hashed character 3- to 5-grams with word ends).
Two GRUs run over a window of ``LENGTH`` words, attention pools their states,
and a logistic unit scores the window. Windows overlap by half and cover every
word; a document's score is its highest window's, calibrated on documents.

Training is multiple-instance: a document's label is taken to be that of its
highest-scoring window, chosen anew each epoch (before the first one by the
log-odds of its n-grams). It sees a bounded sample: at most ``MAX_DOCS`` labelled
rows of each label, in hash order of their ids, those of at most ``MAX_CHARS``
characters first. Of a longer one, which counts where too few are shorter, a
run of ``LONG_CHARS`` characters is taken from a hash-random place. Scoring runs over whole texts of any length, in chunks of
bounded size.

Null, empty and blank texts score 0. A null label is no label. With no usable
labels of both kinds every score is 0. Repeated rows get equal scores and are
one row of the sample. An empty
table gives an empty result; columns pass through ``keep_clean`` untouched
whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import held_out, pick_name

LENGTH, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 14
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 16, 8, 8
MAX_DOCS, MAX_CHARS, LONG_CHARS, EPOCHS, BATCH = 2000, 6000, 24_000, 14, 96
FOLDS, FOLD = 5, 0
_CHUNK_WORDS = 150_000


def _split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words' table, rows of the n-grams' table, and the first n-gram of each word."""
    data = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    rows, owners = [], []
    h = data * np.uint32(0x9E3779B1)
    for n in range(2, 6):
        if len(data) < n:
            break
        h = (h[: len(data) - n + 1] ^ (data[n - 1 :] + np.uint32(n))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        if n > 2:
            inside = owner[: len(h)] == owner[n - 1 :]
            rows.append(h[inside])
            owners.append(owner[: len(h)][inside])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(len(words)))
    place = np.arange(len(data), dtype=np.uint32) - np.repeat(end - size, size).astype(np.uint32)
    mixed = (data + np.uint32(1)) * (place * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B))
    mixed ^= mixed >> np.uint32(15)
    whole = np.add.reduceat(mixed, end - size) * np.uint32(0xC2B2AE35)
    return (whole >> np.uint32(7)) % WORD_ROWS, (rows[order] >> np.uint32(5)) % GRAM_ROWS, first


def _windows(n_words: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(word positions of each window, -1 where it has no word; its document) for documents laid end to end."""
    starts, owner, base, limit = [], [], 0, []
    for d, n in enumerate(n_words):
        if n:
            s = list(range(0, max(n - LENGTH, 0) + 1, STRIDE))
            if n > LENGTH and s[-1] + LENGTH < n:
                s.append(n - LENGTH)
            starts += [base + x for x in s]
            owner += [d] * len(s)
            limit += [base + n] * len(s)
        base += n
    at = np.array(starts, np.int64)[:, None] + np.arange(LENGTH)
    return np.where(at < np.array(limit, np.int64)[:, None], at, -1), np.array(owner, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Parameters by name, with a forward and a backward pass over windows."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + GRAM_DIM

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"words": normal(WORD_ROWS, WORD_DIM, scale=0.1), "grams": normal(GRAM_ROWS, GRAM_DIM, scale=0.3)}
        for way in "fb":
            self.p |= {f"{way}W": normal(d, 3 * HIDDEN, scale=d**-0.5), f"{way}U": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"{way}b": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": normal(2 * HIDDEN, ATTEND, scale=0.5), "a": np.zeros(ATTEND, np.float32), "v": normal(ATTEND, scale=0.5), "o": normal(2 * HIDDEN, scale=0.5), "c": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def embed(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words."""
        return self.embed_hashed(_hashed(words))[0]

    def embed_hashed(self, hashed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple]:
        """The same from the words' hashes, and what the backward pass needs."""
        whole, grams, first = hashed
        count = np.diff(np.append(first, len(grams))).astype(np.float32)
        mean = np.add.reduceat(self.p["grams"][grams], first) / count[:, None]
        return np.hstack([self.p["words"][whole], mean]), (whole, grams, first, count)

    def _gru(self, way: str, gates: np.ndarray, there: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States of one direction; gates: (steps, windows, 3 * HIDDEN)."""
        u, h = self.p[f"{way}U"], np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        for t in range(len(gates)) if way == "f" else reversed(range(len(gates))):
            inner = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates[t, :, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
            step = new + z * (h - new)
            if there is not None:
                step = np.where(there[t][:, None], step, h)
            if keep is not None:
                keep.append((t, h, z, r, new, inner[:, 2 * HIDDEN :]))
            out[t] = h = step
        return out

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates of either direction."""
        return {w: inputs @ self.p[f"{w}W"] + self.p[f"{w}b"] for w in "fb"}

    def logits(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; at: rows of ``gates`` (windows, steps), -1 for none."""
        p, at = self.p, np.ascontiguousarray(at.T)
        there = None if at.min() >= 0 else at >= 0
        traces: dict[str, list | None] = {w: [] if keep is not None else None for w in "fb"}
        states = np.concatenate([self._gru(w, gates[w][at], there, traces[w]) for w in "fb"], axis=2)
        act = np.tanh(states @ p["A"] + p["a"])
        weight = act @ p["v"]
        if there is not None:
            weight = np.where(there, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        if keep is not None:
            keep |= {"states": states, "act": act, "weight": weight, "pooled": pooled, "traces": traces, "at": at, "there": there}
        return pooled @ p["o"] + p["c"][0]

    def gradients(self, inputs: np.ndarray, made: tuple, keep: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p, (states, act, weight) = self.p, (keep[k] for k in ("states", "act", "weight"))
        g = {"o": keep["pooled"].T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["o"]
        d_weight = np.einsum("tnd,nd->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_score, act)
        d_act = d_score[:, :, None] * p["v"] * (1 - act**2)
        g["A"], g["a"] = np.einsum("tnd,tna->da", states, d_act), d_act.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled + d_act @ p["A"].T
        d_inputs, at, there = np.zeros_like(inputs), keep["at"], keep["there"]
        flat = at.ravel()
        for i, way in enumerate("fb"):
            u, d_u = p[f"{way}U"], np.zeros_like(p[f"{way}U"])
            d_gates, d_h = np.zeros((*at.shape, 3 * HIDDEN), np.float32), np.zeros((at.shape[1], HIDDEN), np.float32)
            for t, h, z, r, new, inner in reversed(keep["traces"][way]):
                d = d_states[t, :, i * HIDDEN : (i + 1) * HIDDEN] + d_h
                live = d if there is None else np.where(there[t][:, None], d, 0)
                d_new = live * (1 - z) * (1 - new**2)
                d_z, d_r = live * (h - new) * z * (1 - z), d_new * inner * r * (1 - r)
                d_gates[t] = np.hstack([d_z, d_r, d_new])
                d_inner = np.hstack([d_z, d_r, d_new * r])
                d_u += h.T @ d_inner
                d_h = live * z + d_inner @ u.T + (0 if there is None else d - live)
            g[f"{way}U"], flat_gates = d_u, d_gates.reshape(-1, 3 * HIDDEN)
            per_word = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            np.add.at(per_word, flat[flat >= 0], flat_gates[flat >= 0])
            g[f"{way}W"], g[f"{way}b"] = inputs.T @ per_word, per_word.sum(axis=0)
            d_inputs += per_word @ p[f"{way}W"].T
        whole, grams, first, count = made
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], whole, d_inputs[:, :WORD_DIM])
        g["grams"] = np.zeros_like(p["grams"])
        np.add.at(g["grams"], grams, np.repeat(d_inputs[:, WORD_DIM:] / count[:, None], count.astype(int), axis=0))
        return g

    def score_words(self, texts: list[list[bytes]]) -> np.ndarray:
        """Highest window logit of each text; -inf without words."""
        out = np.full(len(texts), -np.inf)
        index: dict[bytes, int] = {}
        flat = np.array([index.setdefault(w, len(index)) for words in texts for w in words], np.int64)
        if not len(flat):
            return out
        gates = self.gates(self.embed(list(index)))
        at, owner = _windows([len(w) for w in texts])
        for k in range(0, len(at), 512):
            some = at[k : k + 512]
            np.maximum.at(out, owner[k : k + 512], self.logits(gates, np.where(some >= 0, flat[some], -1)))
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated score of each whole text, worked off in chunks of bounded size."""
        out, chunk, size = np.full(len(texts), -np.inf), [], 0

        def flush():
            found = self.score_words([w for _, w in chunk])
            np.maximum.at(out, [i for i, _ in chunk], found)
            chunk.clear()

        for i, t in enumerate(texts):
            words = _split(t)
            for a in range(0, len(words), _CHUNK_WORDS):  # parts of a long text overlap by a window's half
                part = words[max(0, a - LENGTH + STRIDE) : a + _CHUNK_WORDS]
                if size + len(part) > _CHUNK_WORDS and chunk:
                    flush()
                    size = 0
                chunk.append((i, part))
                size += len(part)
        if chunk:
            flush()
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-(self.scale * np.where(np.isneginf(out), 0, out) + self.shift))))


def _some(hashed: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of some of the words."""
    whole, grams, first = hashed
    count = np.diff(np.append(first, len(grams)))[rows]
    start = np.cumsum(count) - count
    return whole[rows], grams[np.arange(count.sum()) + np.repeat(first[rows] - start, count)], start


def _first_choice(texts: list[list[bytes]], labels: np.ndarray, at: np.ndarray, flat: np.ndarray, hashed: tuple) -> np.ndarray:
    """Windows' scores before any training: the log-odds of the most telling n-gram in each."""
    _, grams, first = hashed
    count = np.diff(np.append(first, len(grams)))
    seen = np.zeros((2, GRAM_ROWS))
    base = 0
    for t, y in zip(texts, labels):
        own = np.unique(flat[base : base + len(t)])
        base += len(t)
        if len(own):
            seen[y, np.unique(np.concatenate([grams[first[w] : first[w] + count[w]] for w in own.tolist()]))] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    per_word = np.maximum.reduceat(odds[grams], first)
    return np.where(at >= 0, per_word[flat[at]], -np.inf).max(axis=1)


def train(texts: list[str | None], labels: list[int], prior: float | None = None, seed: int = 7) -> Model | None:
    """Fit on labelled texts; ``prior`` is the share of label 1 for which scores are calibrated. None without both labels."""
    kept = [(w, y) for w, y in ((_split(t), int(y)) for t, y in zip(texts, labels)) if w]
    y = np.array([k[1] for k in kept], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    docs, rng, model = [k[0] for k in kept], np.random.default_rng(seed), Model(seed)
    index: dict[bytes, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for t in docs for w in t], np.int64)
    hashed = _hashed(list(index))
    at, owner = _windows([len(t) for t in docs])
    ids = np.where(at >= 0, flat[at], -1)
    scores = _first_choice(docs, y, at, flat, hashed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    balance = np.array([0.5 / (y == 0).mean(), 0.5 / (y == 1).mean()], np.float32)
    epochs, step = max(EPOCHS, min(30, 300 * BATCH // len(docs))), 0
    for epoch in range(epochs):
        order = np.lexsort((scores, owner))
        top = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
        other = np.flatnonzero(y[owner] == 0)
        chosen = rng.permutation(np.concatenate([top, rng.choice(other, min(len(other), len(top) // 2), replace=False)]))
        rate = 6e-3 * (1 - epoch / epochs) + 2e-4
        for k in range(0, len(chosen), BATCH):
            some = chosen[k : k + BATCH]
            used, local = np.unique(ids[some], return_inverse=True)
            local = local.reshape(len(some), -1) - (1 if used[0] < 0 else 0)
            inputs, made = model.embed_hashed(_some(hashed, used[used >= 0]))
            keep: dict = {}
            label = y[owner[some]]
            error = (_sigmoid(model.logits(model.gates(inputs), local, keep)) - label) * balance[label] / len(some)
            step += 1
            for name, grad in model.gradients(inputs, made, keep, error.astype(np.float32)).items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                model.p[name] -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        if 4 < epoch < epochs - 1 and epoch % 2:
            continue
        gates = model.gates(model.embed_hashed(hashed)[0])
        scores = np.concatenate([model.logits(gates, ids[k : k + 512]) for k in range(0, len(ids), 512)])
    best = np.full(len(docs), -np.inf)
    np.maximum.at(best, owner, scores)
    _calibrate(model, best, y, prior)
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray, prior: float | None) -> None:
    """Logistic fit of the labels on the documents' highest logits, weighted to the prior."""
    share = y.mean() if prior is None else min(max(prior, 0.01), 0.99)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    target = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    s, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(s * logits + b)
        err, curve = weight * (q - target), weight * q * (1 - q) + 1e-6
        grad = np.array([(err * logits).sum() + 0.05 * (s - 1), err.sum()])
        hess = np.array([[(curve * logits**2).sum() + 0.05, (curve * logits).sum()], [(curve * logits).sum(), curve.sum()]])
        move = np.linalg.solve(hess, grad)
        s, b = s - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -1, 1)
    model.scale, model.shift = (max(float(s), 0.05), float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model | None:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, FOLDS, FOLD)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).distinct()
    n = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    text = F.col(text_col).cast("string")
    long, tie = (F.length(text) > max_chars).alias("long"), F.xxhash64(text).alias("tie")
    sizes = docs.select(F.col(id_col).alias("id"), long, tie).where("long is not null").join(usable, "id").distinct()
    order = [F.col("long"), F.xxhash64("id"), F.col("id"), F.col("tie")]
    picked = sizes.where("y = 0").orderBy(*order).limit(max_docs).unionByName(sizes.where("y = 1").orderBy(*order).limit(max_docs))
    # bounded: at most max_docs rows of each label
    texts = docs.select(F.col(id_col).alias("id"), tie, text.alias("text")).join(F.broadcast(picked), ["id", "tie"]).dropDuplicates(["id", "tie", "y"])
    start = F.pmod("tie", F.greatest(F.length("text") - LONG_CHARS, F.lit(0)) + 1).cast("int")
    some = F.when(F.col("long"), F.substring("text", start + 1, F.lit(LONG_CHARS))).otherwise(F.col("text"))
    rows = texts.select(F.lit(0).alias("all"), "id", some.alias("text"), "y")
    prior = n.get(1, 0) / max(1, sum(n.values()))

    def trained(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["id", "text", "y"])
        return pd.DataFrame({"model": [pickle.dumps(train(sample["text"].tolist(), sample["y"].tolist(), prior))]})

    # one task of bounded size, so that the driver only sees the parameters
    made = rows.groupBy("all").applyInPandas(trained, "model binary").first()
    return pickle.loads(made["model"]) if made else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text"):
    """Column of scores for ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        for texts in batches:
            yield pd.Series(np.zeros(len(texts)) if own is None else own.probabilities(texts.tolist()))

    return scored(F.col(f"`{text_col}`").cast("string"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    name = pick_name(docs.columns, "toxicity")
    scored = docs.withColumn(name, score(docs, fit(docs, labels, id_col, text_col), text_col))
    return scored.where(F.col(name) < threshold).drop(name)
