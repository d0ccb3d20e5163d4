"""Merkle manifest of a dataset, with proofs that are folded from hash midstates.

A row's leaf is the SHA-256 of its fields, each ``-`` where null and otherwise
its UTF-8 length, ``:`` and its value. Leaves of one source stand by id; runs
of three become the SHA-256 of their digests (as hex text) until one is left,
the subroot. Subroots, by source, become the root in the same way.

A parent keeps a copy of its hash state from before each child's slot. To see
what the root becomes when a child is replaced, folding takes up the state of
that child's slot and feeds the replacement and the siblings to its right; what
stands to the left is never hashed again.

Spark deals whole subtrees of ``DEPTH`` levels (3^DEPTH consecutive leaves of a
source) to tasks, so a source of any size is spread over all of them, and no
task holds more than one subtree at once. Roots of subtrees are the nodes of
the next tier, some 700 times fewer. Paths come back tier by tier: a subtree
gets its root's path in one row and hands each of its nodes a longer one. Texts
are hashed where they are read and never shuffled.

Rules: a null source is a source of its own and comes first; null ids come
first. Rows that share source and id stand by leaf, and identical rows are
interchangeable. An empty table gives an empty result. Fields are read by name;
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import materialise, ranked

FAN = 3
#: Levels of a subtree that one task builds at once.
DEPTH = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "path array<struct<left:string,right:string>>, top string, root string"
_NODE = "tree string, pos long, n long, digest string"


def field(value: Column) -> Column:
    """``-`` where null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**values: Column) -> Column:
    """Digest of ``values`` in their order."""
    return F.sha2(F.concat(*map(field, values.values())), 256)


def leaves(docs: DataFrame, key_col: str = "doc_id", tree_col: str = "source", fields: tuple[str, ...] = FIELDS, replaced: dict[str, Column] | None = None) -> DataFrame:
    """(tree, key, digest, other) of each row: its leaf, and its leaf with the columns ``replaced`` put in."""
    values = {c: F.col(f"`{c}`") for c in fields}
    other = leaf(**values | (replaced or {}))
    return docs.select(F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{key_col}`").alias("key"), leaf(**values).alias("digest"), other.alias("other"))


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """Consecutive nodes and the levels above them; keeps the hash state before every child's slot."""

    def __init__(self, digests: list[str], levels: int):
        self.rows, self.states = [digests], []
        for _ in range(levels):
            states, above, below = [], [], self.rows[-1]
            for at in range(0, len(below), FAN):
                run = sha256()
                for child in below[at : at + FAN]:
                    states.append(run.copy())
                    run.update(child.encode())
                above.append(run.hexdigest())
            self.states.append(states)
            self.rows.append(above)

    @property
    def top(self) -> str:
        return self.rows[-1][0]

    def siblings(self, at: int) -> Iterator[tuple[str, str]]:
        """Digests to the left and to the right, level by level, of node ``at``."""
        for row in self.rows[:-1]:
            start = at - at % FAN
            yield "".join(row[start:at]), "".join(row[at + 1 : start + FAN])
            at //= FAN

    def fold(self, at: int, digest: str) -> str:
        """The top when node ``at`` is replaced by ``digest``."""
        for row, states in zip(self.rows, self.states):
            run = states[at].copy()
            run.update(digest.encode())
            run.update("".join(row[at + 1 : at - at % FAN + FAN]).encode())
            digest, at = run.hexdigest(), at // FAN
        return digest


class Path:
    """What stands above a subtree, with the hash states before its own slots."""

    def __init__(self, steps: list[dict]):
        self.steps = [(s["left"], s["right"]) for s in steps]
        self.states = [(sha256(left.encode()), right.encode()) for left, right in self.steps]
        self.text = "".join(left + right for left, right in self.steps).encode()

    def fold(self, digest: str) -> str:
        for state, right in self.states:
            run = state.copy()
            run.update(digest.encode())
            run.update(right)
            digest = run.hexdigest()
        return digest


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in range(0, batch.num_rows, 1024):
            yield from batch.slice(part, 1024).to_pylist()


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[dict], Subtree]]:
    """(row of the path or None, rows of the nodes, subtree) of each block; rows come in order."""
    for _, block in groupby(_rows(batches), key=lambda r: (r["tree"], r["block"])):
        rows = list(block)  # FAN ** DEPTH nodes and a path at most
        above = rows.pop(0) if rows[0]["digest"] is None else None
        yield above, rows, Subtree([r["digest"] for r in rows], min(DEPTH, levels_of(rows[0]["n"])))


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_NODE_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_PATH_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", _STEPS), ("top", pa.string()), ("root", pa.string())])


def _tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top of each block, a node of the next tier."""
    found = ({"tree": rows[0]["tree"], "pos": rows[0]["block"], "n": -(-rows[0]["n"] // FAN**DEPTH), "digest": tree.top} for _, rows, tree in _subtrees(batches))
    yield from _batched(found, _NODE_ARROW)


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's path to the root: that in its block, then that of the block."""

    def found() -> Iterator[dict]:
        for above, rows, tree in _subtrees(batches):
            for at, row in enumerate(rows):
                steps = [{"left": left, "right": right} for left, right in tree.siblings(at)]
                yield {"tree": row["tree"], "pos": row["pos"], "path": steps + above["path"], "top": above["top"], "root": above["root"]}

    yield from _batched(found(), _PATH_ARROW)


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf with its subroot, root, digest of its proof, and the root that its other digest folds to."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    kind = first.schema.field("key").type
    texts = ("digest", "top", "root", "proof", "folded")
    schema = pa.schema([("key", kind), *((c, pa.string()) for c in texts)])

    def found() -> Iterator[dict]:
        for above, rows, tree in _subtrees(_joined(first, batches)):
            path = Path(above["path"])
            for at, row in enumerate(rows):
                proof = sha256("".join(left + right for left, right in tree.siblings(at)).encode())
                proof.update(path.text)
                yield {"key": row["key"], "digest": row["digest"], "top": above["top"], "root": above["root"], "proof": proof.hexdigest(), "folded": path.fold(tree.fold(at, row["other"]))}

    yield from _batched(found(), schema)


def _joined(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _dealt(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Nodes by block, in order; the block's path, if given, before them."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FAN**DEPTH))
    if above is not None:
        rows = rows.unionByName(above.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


@dataclass(frozen=True)
class Tree:
    """Tiers of nodes (tree, pos, n, digest) from the leaves, which may have more columns, up to one node a tree."""

    tiers: list[DataFrame]

    def paths(self, above: DataFrame, to: int = 0) -> DataFrame:
        """Paths (tree, pos, path, top, root) of the nodes of tier ``to``, from those of the top ones."""
        for nodes in self.tiers[-2 : -len(self.tiers) - 1 + to : -1]:
            rows = _dealt(nodes.select("tree", "pos", "n", "digest"), above)
            above = materialise(rows.mapInArrow(_paths, "tree string, pos long, " + _PATH), "merkle-paths")
        return above


def tree(nodes: DataFrame) -> Tree:
    """All tiers above ``nodes``, whose number follows from the largest tree."""
    tiers, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tiers.append(materialise(_dealt(tiers[-1].select("tree", "pos", "n", "digest")).mapInArrow(_tops, _NODE), "merkle-tier"))
        most = -(-most // FAN**DEPTH)
    return Tree(tiers)


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with pos, their place in their tree, and n, its size."""
    placed = ranked(rows, [F.col("tree").asc_nulls_first(), *order], "merkle-leaves")
    sizes = placed.groupBy("tree").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n")).withColumnRenamed("tree", "in_tree")
    met = placed.join(sizes, F.col("tree").eqNullSafe(F.col("in_tree")))
    return met.select(*rows.columns, (F.col("rank") - F.col("start")).alias("pos"), "n")


def verify(leaf_rows: DataFrame) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of rows of ``leaves``.

    The folded root is that of the row's ``other`` digest with the original
    siblings; it is verified if it equals the root.
    """
    # written before it is ranged, as that looks at its rows twice
    rows = materialise(leaf_rows.withColumn("uid", F.monotonically_increasing_id()), "merkle-rows")
    placed = materialise(_placed(rows, F.col("key").asc_nulls_first(), F.col("digest"), F.col("uid")).drop("uid"), "merkle-placed")
    by_source = tree(placed)
    subroots = materialise(by_source.tiers[-1].select("tree", "digest"), "merkle-subroots")
    sources = subroots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = materialise(_placed(sources, F.col("name").asc_nulls_first()), "merkle-sources")
    above_all = tree(sources)
    no_steps = F.array().cast("array<struct<left:string,right:string>>")
    root = above_all.tiers[-1].select("tree", "pos", no_steps.alias("path"), F.col("digest").alias("top"), F.col("digest").alias("root"))
    ways = above_all.paths(root).select("pos", "path", "root")
    tops = sources.join(ways, "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("top"), "root")
    above = by_source.paths(tops, 1) if len(by_source.tiers) > 1 else tops
    key = leaf_rows.schema["key"].dataType.simpleString()
    done = _dealt(placed, above).mapInArrow(_folded, f"key {key}, digest string, top string, root string, proof string, folded string")
    return done.select("key", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def manifest(docs: DataFrame, key_col: str = "doc_id", tree_col: str = "source", text_col: str = "text") -> DataFrame:
    """``verify`` of all documents, where each second one (by crc32 of its id as text, null as empty) has lost its line feeds."""
    text = F.col(f"`{text_col}`")
    even = F.crc32(F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))) % 2 == 0
    tampered = F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return verify(leaves(docs, key_col, tree_col, replaced={text_col: tampered}))
