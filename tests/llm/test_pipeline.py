"""The corpus pipeline: each stage against a brute-force version on its own input."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tabulon.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_records"]
    assert all(after.columns == COLUMNS for _, after in stages[:-1])


def shingled(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    """Jaccard similarity over distinct five-word shingles; texts without words are copies."""
    shared = len(a & b)
    return shared >= 0.8 * (len(a) + len(b) - shared)


def test_one_of_each_class_stays(stages):
    before, after = stages[1]
    rows = before.collect()
    sets, root = [shingled(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(best.values())
    assert len(best) < len(rows)


def plain_score(m, text):
    """Highest window of a text, one word after another."""
    words = [w.encode() for w in "".join(c.lower() for c in text or "").split()]
    x = [m.embed([w])[0] for w in words]
    starts = [*range(0, max(len(x) - toxicity.LENGTH, 0) + 1, toxicity.STRIDE)]
    if len(x) > toxicity.LENGTH and starts[-1] + toxicity.LENGTH < len(x):
        starts.append(len(x) - toxicity.LENGTH)
    n, best = toxicity.HIDDEN, -np.inf

    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    for at in starts if x else []:
        window, states = x[at : at + toxicity.LENGTH], {}
        for way in "fb":
            h, out = np.zeros(n), []
            for v in window if way == "f" else window[::-1]:
                g, u = v @ m.p[f"{way}W"] + m.p[f"{way}b"], h @ m.p[f"{way}U"]
                z, r = sigmoid(g[:n] + u[:n]), sigmoid(g[n : 2 * n] + u[n : 2 * n])
                h = (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :]) + z * h
                out.append(h)
            states[way] = out if way == "f" else out[::-1]
        both = np.array([np.concatenate(s) for s in zip(states["f"], states["b"])])
        weight = np.exp(np.tanh(both @ m.p["A"] + m.p["a"]) @ m.p["v"])
        best = max(best, float(weight / weight.sum() @ both @ m.p["o"] + m.p["c"][0]))
    return float(sigmoid(m.scale * best + m.shift)) if x else 0.0


def test_toxic_documents_go_by_a_plain_forward_pass(spark, sf_dir, stages):
    before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in after.collect()}
    rows = sorted(before.collect(), key=lambda r: (r["doc_id"] in kept, len(r["text"] or "")))[:60]
    assert any(r["doc_id"] not in kept for r in rows)
    for r in rows:
        score = plain_score(model, r["text"])
        assert abs(score - 0.5) < 1e-4 or (r["doc_id"] in kept) == (score < 0.5)


def test_leaks_go_and_the_rest_stays(spark, sf_dir, stages):
    def plain(text):
        return " " + " ".join(re.findall(r"\w+", text.lower())) + " "

    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = stages[2]
    clean = {r["doc_id"] for r in before.collect() if not any(i in plain(r["text"]) for i in items)}
    assert {r["doc_id"] for r in after.collect()} == clean


def test_mix_takes_whole_rows_or_starts(stages):
    before, after = stages[3]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert all(texts[r["doc_id"]].startswith(r["text"]) and len(r["text"]) == r["n_chars"] for r in rows)
    words = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r["text"].split()) for r in rows) - 1.5 * words) <= 20


def test_every_mixed_row_is_written(stages):
    before, after = stages[4]
    rows = after.orderBy("start").collect()
    assert len(rows) == before.count()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in before.collect())
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
