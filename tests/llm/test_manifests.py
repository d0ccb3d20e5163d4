"""Merkle manifest, conversation repair and fingerprints: against DuckDB SQL on odd tables, and against brute force."""

import random
import re
from hashlib import sha256
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon.llm import dialogue, fingerprints, merkle
from tabulon.llm.queries import ORACLE, QUERIES
from tests.compare import rows as compared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
OURS = ["op11_merkle_manifest", "op12_dialogue_repair", "op13_fingerprints"]


def same_as_sql(spark, tmp_path, name, table, frame):
    """The query over a folder with this table alone, next to its SQL."""
    frame.write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert compared(got) == compared(con.sql(ORACLE[name]).df())
    return got


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, line feeds, repeated rows and ids, an extra column with a clashing name."""
    rng = random.Random(5)
    long = "\n".join(" ".join(rng.choice(["aa", "bb b", "Ärger", "x1", "中文"]) for _ in range(30)) for _ in range(400))
    rows = [(1, None, None, None, None), (None, "a b\nc", "en", "s", 5), (2, "", "en", "s", 0), (3, " \n ", "en", None, 3), (4, long, "en", "s", len(long)), (5, "same text\nhere now", "en", "s", 18)]
    rows += [rows[-1], (5, "another text under the same id", "en", "s", 30), (-6, "é ñ 中文 😀!", "es", "t", 9), (20, "same text\nhere now", "de", "", 18), (40, "!!!", "de", "", 3)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", leaf string, rank string")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_fingerprints"])
def test_odd_documents(spark, tmp_path, odd, name):
    got = same_as_sql(spark, tmp_path, name, "documents", odd)
    assert len(got) == odd.count()


@pytest.mark.parametrize("name, table, schema", [(OURS[0], "documents", DOCS), (OURS[1], "conversations", TURNS), (OURS[2], "documents", DOCS)])
def test_empty_tables(spark, tmp_path, name, table, schema):
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert got.count() == 0 and len(got.columns) >= 7


# --- manifest


def slow_tree(leaves):
    """(root, proof of each leaf) by plain hashing."""
    h, at = (lambda s: sha256(s.encode()).hexdigest()), list(range(len(leaves)))
    row, proofs = leaves, ["" for _ in leaves]
    while len(row) > 1:
        for i, a in enumerate(at):
            start = a - a % 3
            proofs[i] += "".join(d for k, d in enumerate(row[start : start + 3], start) if k != a)
            at[i] = a // 3
        row = [h("".join(row[k : k + 3])) for k in range(0, len(row), 3)]
    return row[0], proofs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_folding_resumes_the_states(n):
    leaves = [sha256(str(i).encode()).hexdigest() for i in range(n)]
    tree = merkle.Subtree(list(leaves), merkle.levels_of(n))
    root, proofs = slow_tree(leaves)
    assert tree.top == root
    for i in range(n):
        assert tree.fold(i, leaves[i]) == root
        assert "".join(a + b for a, b in tree.siblings(i)) == proofs[i]
        changed = [*leaves]
        changed[i] = "0" * 64
        assert tree.fold(i, "0" * 64) == slow_tree(changed)[0]


def test_several_tiers_and_a_hot_source(spark):
    """A source of 3,000 rows fills several subtrees; others have one or two rows; identical rows abound."""
    rows = [(i // 2 if i < 40 else i, f"text {i // 2 if i < 40 else i}\n", "en", "hot", 5) for i in range(3000)] + [(i, "t\n", "en", s, 1) for i, s in enumerate(["a", "b", "b", None, "ü", "zz"])]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    h = lambda s: sha256(s.encode()).hexdigest()
    enc = lambda *v: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    by = {}
    for i, text, lang, source, n in rows:
        by.setdefault(source, []).append((i, enc(i, source, lang, n, text)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(v), *slow_tree([d for _, d in sorted(v)])) for s, v in by.items()}
    root, high = slow_tree([trees[s][1] for s in names])
    expected = sorted((i, d, trees[s][1], root, h(proof + high[k])) for k, s in enumerate(names) for (i, d), proof in zip(trees[s][0], trees[s][2]))
    assert sorted((r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == expected
    assert {r["verified"] for r in got} == {True, False}
    assert all(r["verified"] == (r["folded_root"] == root) for r in got)


# --- conversations


def slow_repair(signature):
    """(cost, audit) by trying every edit of every row and all rows put in between."""
    best = None
    gaps, legal = ["", "u", "a", "ua", "au"], re.compile(r"(s?(ua)+)?")
    for edits in product(*[["D"] if c == "d" else ["D", "K", "u", "a"] for c in signature]):
        cost = sum({"D": 3, "K": 0}.get(e, 2) + (e != "D" and c.isupper()) for c, e in zip(signature, edits))
        for put in product(gaps, repeat=len(signature) + 1):
            roles = "".join(p + ("" if e == "D" else c.lower() if e == "K" else e) for p, c, e in zip(put, [*signature, ""], [*edits, "D"]))
            if legal.fullmatch(roles):
                audit = "".join("I" * len(p) + {"u": "R", "a": "R"}.get(e, e) for p, e in zip(put, [*edits, ""]))
                found = (cost + 2 * sum(map(len, put)), audit)
                best = min(best or found, found)
    return best


def audited(signature):
    nodes = [dialogue.END]
    for symbol in reversed(signature):
        nodes.append(dialogue.node(symbol, nodes[-1]))
    return nodes[-1][dialogue.START][0], dialogue.best_audit(signature, nodes)


def test_audits_are_the_cheapest():
    for n in range(3):
        for signature in map("".join, product("suaxdUA", repeat=n)):
            assert audited(signature) == slow_repair(signature)
    rng = random.Random(7)
    for _ in range(25):
        signature = "".join(rng.choice("suaxdSUAX") for _ in range(3))
        assert audited(signature) == slow_repair(signature)


def test_shared_ends_change_nothing(spark):
    rng = random.Random(8)
    found = {"".join(rng.choice("suuaaadUA") for _ in range(rng.randint(0, 9))) for _ in range(300)}
    got = dialogue.audits(spark.createDataFrame([(s,) for s in found], "signature string")).collect()
    assert {r["signature"]: (r["cost"], r["audit"]) for r in got} == {s: audited(s) for s in found}


def test_odd_conversations(spark, tmp_path):
    """Nulls in every column, tied turns, repeated rows, odd roles, negative turns, and one long conversation."""
    rng = random.Random(9)
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, 0, 1, -3) for r in (None, "user", "assistant", "", "système", "tool") for x in (None, "", "Yes.", "No", "\n", "A b!  \n")]
    rows += [(77, None, None, None)] * 3 + [(c, 0, "user", "Hm.") for c in range(100, 140)]
    rows += [(9, t, ["user", "assistant"][t % 2], rng.choice(["One.", "Two", "Three?", f"{t}."])) for t in range(3000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", digest string")
    got = same_as_sql(spark, tmp_path, "op12_dialogue_repair", "conversations", frame)
    assert len(got) == len({r[0] for r in rows})
    none = got[(got.audit == "") & (got.cost == 0)]
    assert len(none) and set(none.repaired_sha256) == {sha256(b"").hexdigest()}


# --- fingerprints


@pytest.mark.parametrize("cell", [4, 512])
def test_tables_find_all_within_the_radius(spark, monkeypatch, cell):
    monkeypatch.setattr(fingerprints, "CELL", cell)
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps[:10] for _ in range(12)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    stored = spark.createDataFrame([(f, i % 3 + 1) for i, f in enumerate(signed)], "fp long, n long")
    got = {r["fp"]: r["n"] for r in fingerprints.within(spark.createDataFrame([(f,) for f in signed[::2]], "fp long"), stored).collect()}
    near = lambda a: sum(i % 3 + 1 for i, b in enumerate(fps) if bin(a ^ b).count("1") <= 3)
    assert got == {signed[i]: near(fps[i]) for i in range(0, len(fps), 2)}


def test_every_choice_of_blocks_has_a_table():
    for blocks, radius in ((4, 3), (6, 3), (5, 2)):
        masks = [m % (1 << 64) for m in fingerprints.tables(blocks, radius)]
        rng = random.Random(1)
        for _ in range(500):
            differ = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & differ == 0 for m in masks)


def test_rows_that_are_no_scan_have_places(spark, odd):
    """A derived table gives the same result as the file that holds it."""
    shuffled = odd.repartition(3, "text")
    got = fingerprints.compare(shuffled).select("id", "fingerprint", "edited_sha256").collect()
    again = fingerprints.compare(odd.orderBy(F.rand(3))).select("id", "fingerprint", "edited_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


def test_edits_stay_nearer_than_the_next(spark, sf_dir):
    got = QUERIES["op13_fingerprints"](spark, sf_dir).where("n_chars > 400").agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.97 and got[1] > 0.68 and got[2] < 0.6
