"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has eight bytes. Two fingerprints at ``max_bits`` = 3 or fewer
differing bits differ in at most three bytes, so at least five positional bytes
are shared: that is the guaranteed minimum of the count filter. The index does
not post single bytes, whose 2,048 lists would each hold 1/256 of the corpus;
it posts *sets* of byte positions chosen so that any five positions contain one
of the sets (a covering design). Two disjoint halves of four positions give
eight triples (any five positions put three into one half); for corpora too
large for 24-bit keys 14 sets of four serve, no two of which share three. Every pair that can
pass the filter therefore meets in at least one list, and no list is cut.

Lists longer than ``cell`` are dealt into square cells of chunk pairs, so that
no task ever holds an unbounded list; a cell returns a spanning star for each
of its linked sets, never all pairs. Components come from alternating
large-star / small-star rounds, each written to the shared folder.

Nulls, empty texts: a text without words has fingerprint zero and links like
any other. Repeated rows and copies collapse to their fingerprint before the
index. Null ids are kept; a component takes its smallest non-null id (null if
it has none). An empty table gives an empty result. Other columns pass through
``drop_duplicates`` untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import materialise, new_path, pick_name, stored
from tabulon.session import remove

SEED = 42


def simhash64(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles; repeats count, majority must be strict."""
    return _simhash(_words(text), shingle)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower touches A-Z only


def _simhash(words: list[bytes], shingle: int = 3) -> int:
    return int(_majority(_shingle_hashes(b" ".join(words), words, shingle))) if words else 0


def fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprint


def covering_sets(k: int) -> list[tuple[int, ...]]:
    """Sets of k byte positions such that any five of eight positions contain one."""
    if k == 3:
        return [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
    chosen: list[tuple[int, ...]] = []
    for some in combinations(range(8), k):  # for k = 4: no two share three positions, so each five hold one
        if all(len({*some} & {*other}) < 3 for other in chosen):
            chosen.append(some)
    return chosen


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _stars(batches: Iterator[pd.DataFrame], max_bits: int, shared: int) -> Iterator[pd.DataFrame]:
    """Spanning stars of the linked fingerprints of each cell; rows come sorted by cell."""
    rest = None
    for batch in _with_end(batches):
        frame = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
        if frame is None or frame.empty:
            continue
        cell = frame["cell"].to_numpy()
        if batch is None:
            done = len(cell)
        else:
            done = int(np.flatnonzero(cell == cell[-1])[0])
        rest = frame.iloc[done:]
        if done:
            yield _link(cell[:done], frame["fp"].to_numpy()[:done], max_bits, shared)


def _with_end(batches):
    yield from batches
    yield None


def _link(cell: np.ndarray, fp: np.ndarray, max_bits: int, shared: int) -> pd.DataFrame:
    left, right = [], []
    for step in range(1, len(cell)):
        same = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(same):
            break
        x = (fp[same] ^ fp[same + step]).view(np.uint64)
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # shared positional bytes
        keep = (tally >= shared) & (x != 0)
        same, x = same[keep], x[keep]
        same = same[np.bitwise_count(x) <= max_bits]
        left.append(same)
        right.append(same + step)
    if not left:
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    node, root = _spanning(np.concatenate(left), np.concatenate(right), len(fp))
    return pd.DataFrame({"a": fp[node], "b": fp[root]})


def _spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links (u, v) between n nodes connect: each node but the first with the first of its set."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def linked(fps: DataFrame, max_bits: int = 3, cell: int = 512) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``max_bits``.

    ``fps`` has one distinct ``fp`` a row.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the byte count filter guarantees shared bytes for at most 3 differing bits")
    n = fps.count()
    k = 3 if n < 1 << 23 else 4
    sets = covering_sets(k)
    postings = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(sets)])).alias("p"),
    ).select("fp", "p.s", "p.key")
    lists = postings.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = postings.join(lists, ["s", "key"]).withColumn("g", F.ceil(F.col("n") / cell).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    cells = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("fp", F.xxhash64("s", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInPandas(lambda b: _stars(b, max_bits, 8 - max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): alternating large-star and small-star rounds."""
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == last or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = materialise(small.select("e.u", F.col("e.m").alias("v")).where("u != v").distinct(), "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: id, ``fp`` (signed long) and ``component_id``."""
    marked = materialise(docs.select(F.col(id_col).alias("id"), fingerprint_udf(shingle)(F.col(text_col).cast("string")).alias("fp")), "fingerprints")
    firsts = materialise(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(linked(firsts.select("fp"), max_bits))
    owner = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lowest = owner.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = owner.join(lowest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# Near copies by Jaccard similarity over distinct five-word shingles.
#
# The texts are fingerprinted, posted in the byte-position index, filtered by
# shared bytes and linked at three differing bits as above: the components are
# *families*, and texts of one family are candidates. Pairs at a similarity of
# at least s may differ in more bits; between families, and only there, a
# prefix index completes the candidates: with all shingles in one global order,
# two texts at a similarity of at least s share one of the first
# n - ceil(s n) + 1 of their n shingles, whatever the order. Shingles that are
# common in a sample come last in it, which only shortens the lists; texts of
# one family are not compared. Postings are shuffled once, to the list of
# their shingle, and those alone in it end there; only the others meet families
# and judging bits. A list that a sample shows to be long is dealt before that
# shuffle, and what is still long after it is dealt by its exact length. Pairs
# far apart in 512 SimHash bits (``LOOSE`` standard deviations beyond those
# expected at s for sets of their size) are set aside; the components of all candidates are then
# compared by their shingles themselves, and only pairs at s or more are linked.
# A component is dealt into square cells of about ``CELL_SHINGLES`` a side.
#
# Whole texts are joined twice, with those to compare and with those that stay.
# A map of ``MAP_BITS`` bits, of bounded size whatever the table, goes to the
# rows before: only rows on it are shuffled to the exact join.
#
# For large sets of equal size the share of differing bits at similarity J is
# arccos(2 J / (1 + J)) / pi, for others less; in small sets ties of the votes
# add to it, by about ``TIES`` / sqrt(n) in sets of n (measured at 8 and 9
# shingles: 0.036, of which 0.057 are allowed). ``wide_signature`` also has the
# 64 index bytes of three-word shingles.

LANES, SHARED_BYTES, CELL, SMALL_CELL = 8, 8, 4096, 48
TIES = 0.16
LOOSE, CELL_SHINGLES, SAMPLE, COMMON = 6.0, 500_000, 5_000, 100_000
MAP_BITS = 1 << 23
_TRIPLES = np.array([[4 * g + i for i in t] for g in range(2 * LANES) for t in combinations(range(4), 3)])


def _lanes(h: np.ndarray) -> np.ndarray:
    """LANES independent SimHashes of the same hashes."""
    out = np.empty(LANES, np.uint64)
    for lane in range(LANES):
        x = h + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        out[lane] = _majority(x)
    return out


def _majority(h: np.ndarray) -> np.uint64:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255 * 64):
        bits = np.unpackbits(h[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]


def _shingle_hashes(joined: bytes, words: list[bytes], k: int) -> np.ndarray:
    n = len(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip((end - size)[: n - k + 1].tolist(), end[k - 1 :].tolist())], dtype="<u8")


def wide_signature(text: str | None) -> tuple[int, list[int], bytes, bytes]:
    """(digest of the words, keys of the index, index bytes, judging bytes); equal words give equal rows."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    content = xxhash.xxh64_intdigest(joined, 1)
    if not words:
        return content - (1 << 64) if content >> 63 else content, [], bytes(8 * LANES), bytes(8 * LANES)
    index = _lanes(_shingle_hashes(joined, words, 3)).view(np.uint8)
    judge = _lanes(np.unique(_shingle_hashes(joined, words, 5)))
    keys = (index[_TRIPLES].astype(np.int64) * np.array([1 << 16, 1 << 8, 1])).sum(axis=1)
    return content - (1 << 64) if content >> 63 else content, keys.tolist(), index.tobytes(), judge.tobytes()


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; none for a text without words."""
    return _distinct(_words(text), k)


def _distinct(words: list[bytes], k: int = 5) -> np.ndarray:
    return np.unique(_shingle_hashes(b" ".join(words), words, k)) if words else np.array([], "<u8")


def prefix(h: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first shingles, one of which any set at this similarity shares; ``common`` ones, sorted by hash with their counts, come last."""
    most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    weight = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common["h"], h), len(common) - 1)
        weight = np.where(common["h"][at] == h, common["n"][at], 0)
    return h[np.lexsort((h, weight))[:most]]


def common_shingles(texts: DataFrame) -> np.ndarray:
    """(h, n), by hash: the shingles that most often occur in a bounded sample of distinct texts."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"h": shingles(text).view(np.int64)})

    counts = sample.mapInPandas(spread, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    out = np.empty(len(rows), np.dtype([("h", "<u8"), ("n", "<i8")]))
    out["h"], out["n"] = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"]
    return np.sort(out, order="h")


def prefix_signatures(similarity: float, common: np.ndarray):
    @F.pandas_udf("content long, fp long, keys array<long>, size int, judge binary")
    def signatures(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = _words(text)
            content = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 1)).view(np.int64))
            fp = int(np.uint64(_simhash(words)).view(np.int64))
            h = _distinct(words)
            keys = prefix(h, similarity, common) if len(h) else h
            rows.append((content, fp, keys.view(np.int64), len(h), _lanes(h).tobytes()))
        return pd.DataFrame(rows, columns=["content", "fp", "keys", "size", "judge"])

    return signatures


def most_bits(similarity: float, size: np.ndarray, slack: float = LOOSE) -> np.ndarray:
    """Differing judging bits allowed at a similarity to sets of ``size``, with so many standard deviations of slack."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi + TIES / np.sqrt(np.maximum(size, 1))
    n = 64 * LANES
    return p * n + slack * np.sqrt(n * p * (1 - p))


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in runs of whole cells; they come sorted by cell."""
    parts: list[pd.DataFrame] = []
    for batch in _with_end(batches):
        if batch is not None and batch.empty:
            continue
        if batch is None:
            if parts:
                yield pd.concat(parts, ignore_index=True)
            return
        cell = batch["cell"].to_numpy()
        cut = int(np.flatnonzero(cell == cell[-1])[0])
        if parts and (cut or parts[-1]["cell"].iloc[-1] != cell[0]):
            yield pd.concat([*parts, batch.iloc[:cut]], ignore_index=True)
            parts = []
        elif cut:
            yield batch.iloc[:cut]
        parts.append(batch.iloc[cut:])


def _judged(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Links that connect what the candidates of each cell and its families connect."""
    for frame in _cells(batches):
        judge = np.frombuffer(b"".join(frame["judge"]), np.uint64).reshape(len(frame), -1)
        family = frame["family"].to_numpy()
        ids, cell, size = frame["content"].to_numpy(), frame["cell"].to_numpy(), frame["size"].to_numpy()
        bits = most_bits(similarity, size)
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(starts, len(cell)))
        small = np.repeat(sizes <= SMALL_CELL, sizes)

        def alike(i, j):
            ok = (family[i] != family[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
            a, b = i if np.isscalar(i) else i[ok], j[ok]
            ok[ok] = np.bitwise_count(judge[a] ^ judge[b]).sum(axis=1) <= np.maximum(bits[a], bits[b])
            return ok

        pairs = [_small_cells(cell, small, alike)]
        pairs += [_large_cell(np.arange(a, a + n), alike, family) for a, n in zip(starts.tolist(), sizes.tolist()) if n > SMALL_CELL]
        both = np.concatenate(pairs)
        yield pd.DataFrame({"a": ids[both[:, 0]], "b": ids[both[:, 1]]})


def _small_cells(cell: np.ndarray, small: np.ndarray, alike) -> np.ndarray:
    found = [np.empty((0, 2), np.int64)]
    for step in range(1, SMALL_CELL):
        i = np.flatnonzero((cell[step:] == cell[:-step]) & small[step:])
        if not len(i):
            break
        i = i[alike(i, i + step)]
        found.append(np.stack([i, i + step], axis=1))
    both = np.concatenate(found)
    return np.stack(_spanning(both[:, 0], both[:, 1], len(cell)), axis=1)


def _large_cell(rows: np.ndarray, alike, family: np.ndarray | None = None) -> np.ndarray:
    """Links that connect what all links connect: rows join the first pivot they are like, then groups are tied.

    Rows of one ``family`` are connected already.
    """
    found, groups, left = [np.empty((0, 2), np.int64)], [], rows
    while len(left):
        pivot, others = int(left[0]), left[1:]
        same = family[others] == family[pivot] if family is not None else np.zeros(len(others), bool)
        like = ~same
        like[like] = alike(pivot, others[like])
        groups.append(np.append(pivot, others[same | like]))
        found.append(np.stack([others[like], np.full(like.sum(), pivot)], axis=1))
        left = others[~(same | like)]
    groups.sort(key=len, reverse=True)
    sets = np.empty(len(rows), np.int64)  # of rows that are connected by now
    for k, group in enumerate(groups):
        sets[group - rows[0]] = k
    if family is not None:
        _, first, code = np.unique(family[rows], return_index=True, return_inverse=True)
        node, root = _spanning(sets, sets[first[code]], len(groups))
        joined = np.arange(len(groups))
        joined[node] = root
        sets = joined[sets]
    before = groups[0]
    for group in groups[1:]:
        for row in group.tolist():
            rest = before[sets[before - rows[0]] != sets[row - rows[0]]]
            like = rest[alike(row, rest)]
            others, first = np.unique(sets[like - rows[0]], return_index=True)
            new = others != sets[row - rows[0]]
            if new.any():  # one link to each set is enough
                found.append(np.stack([np.full(new.sum(), row), like[first[new]]], axis=1))
                sets[np.isin(sets, others)] = sets[row - rows[0]]
        before = np.concatenate([before, group])
    return np.concatenate(found)


def _compared(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Spanning links of the pairs of each cell whose shingles have at least this Jaccard similarity."""
    for frame in _cells(batches):
        cells, ids = frame["cell"].to_numpy(), frame["content"].to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            sets = [np.frombuffer(x, "<u8") for x in frame["shingles"].iloc[a:b]]
            size = np.array([len(x) for x in sets])
            codes, names = pd.factorize(np.concatenate(sets))
            start = np.append(0, np.cumsum(size))
            marks = np.zeros(len(names), np.int64)

            def alike(i: int, others: np.ndarray) -> np.ndarray:
                own = codes[start[i] : start[i + 1]]
                marks[own] = 1
                if len(others) * 4 > len(size):
                    shared = np.add.reduceat(marks[codes], start[:-1])[others]
                else:
                    shared = np.array([marks[codes[start[j] : start[j + 1]]].sum() for j in others.tolist()], np.int64)
                marks[own] = 0
                return shared / (size[i] + size[others] - shared) >= similarity

            both = _large_cell(np.arange(b - a), alike) + a
            yield pd.DataFrame({"a": ids[both[:, 0]], "b": ids[both[:, 1]]})


def families(marked: DataFrame) -> DataFrame:
    """(content, family): the component of each content's fingerprint (content, fp, size) at three differing bits or fewer."""
    fps = materialise(marked.where("size > 0").select("fp").distinct(), "distinct-fingerprints")
    roots = components(linked(fps))
    own = marked.groupBy("content").agg(F.any_value("fp").alias("fp"))
    return own.join(roots, own["fp"] == roots["node"], "left").select("content", F.coalesce("root", "fp").alias("family"))


def family_links(unique: DataFrame) -> DataFrame:
    """Stars (a, b) over the contents of each family; a content without words is like no other."""
    own = unique.where("size > 0").select("content", "family")
    first = own.groupBy("family").agg(F.min("content").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(first, "family").where("content != first").select(F.col("content").alias("a"), F.col("first").alias("b"))


def long_lists(postings: DataFrame, contents: int) -> DataFrame:
    """(key, g): the keys, at most ``COMMON``, whose lists a bounded sample of contents shows to exceed ``CELL``, and into how many chunks."""
    every = max(1, contents // SAMPLE)
    sample = postings.where(F.pmod(F.xxhash64("content"), F.lit(every)) == 0)
    lists = sample.groupBy("key").agg((F.count(F.lit(1)) * every).alias("n")).where(F.col("n") > CELL)
    return lists.orderBy(F.desc("n"), "key").limit(COMMON).select("key", F.ceil(F.col("n") * 1.25 / CELL).cast("int").alias("g"))


def _into_cells(members: DataFrame, key: str, cell: str) -> DataFrame:
    """(content, cell): lists of ``key`` dealt into the pairs of their ``g`` chunks; any two of a list meet."""
    mine = F.pmod(F.xxhash64("content"), F.col("g")).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    # 48 bits shuffle in fewer bytes than 64; lists that clash are compared as one
    name = F.shiftrightunsigned(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")), 16)
    return dealt.select(name.alias(cell), "content")


def candidates(unique: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between contents (content, family, keys, size, judge) of different families.

    The components of these and the families hold every pair at this similarity.
    """
    postings = unique.select("content", F.explode("keys").alias("key"))
    known = materialise(long_lists(postings, unique.count()), "long-lists")
    placed = postings.join(F.broadcast(known), "key", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    bins = _into_cells(placed, "key", "bin").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("bin")))
    members = bins.where("n > 1").withColumn("g", F.when(F.col("n") > 2 * CELL, F.ceil(F.col("n") / CELL)).otherwise(1).cast("int"))
    full = _into_cells(members, "bin", "cell").join(unique.select("content", "family", "size", "judge"), "content")
    # in one order everywhere, so that the lists of one set of copies give the same stars
    dealt = full.repartition("cell").sortWithinPartitions("cell", "content")
    return dealt.mapInPandas(lambda b: _judged(b, similarity), "a long, b long").distinct()


def bit_map(rows: DataFrame, id_col: str, tie_col: str) -> DataFrame:
    """(slot, bits): a map of ``MAP_BITS`` bits with those of the rows' ids and text hashes set."""
    slot, bit = _place(id_col, tie_col)
    return materialise(rows.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")), "bit-map")


def _place(id_col: str, tie_col: str) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(id_col, tie_col), F.lit(MAP_BITS))
    return F.shiftright(at, 6).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{id_col}`, `{tie_col}`), 64) as int))")


def on_map(rows: DataFrame, bits: DataFrame, id_col: str, tie_col: str, on: bool = True) -> DataFrame:
    """The rows whose bit is set (or not): all that were put on the map and, by chance, some others."""
    slot, bit = _place(id_col, tie_col)
    marks = F.broadcast(bits.select(F.col("slot").alias("map_slot"), F.col("bits").alias("map_bits")))
    there = F.coalesce(F.col("map_bits").bitwiseAND(bit), F.lit(0)) != 0
    return rows.join(marks, slot == F.col("map_slot"), "left").where(there if on else ~there).select(*rows.columns)


def exact_links(docs: DataFrame, unique: DataFrame, roots: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at this similarity; ``roots`` (node, root) are the components of candidates."""
    own = roots.select(F.col("node").alias("content"), "root").unionByName(roots.select(F.col("root").alias("content"), "root")).distinct()
    members = own.join(unique.select("content", "best", "size"), "content")
    totals = members.groupBy("root").agg(F.ceil(F.sum("size") / CELL_SHINGLES).cast("int").alias("g"))
    members = materialise(members.join(totals, "root").select("content", "root", "g", F.col("best.id").alias("m_id"), F.col("best.tie").alias("m_tie")), "candidates")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    texts = on_map(texts, bit_map(members, "m_id", "m_tie"), "id", "tie")
    met = texts.join(members, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("tie") == F.col("m_tie")))
    # of exactly repeated rows one is enough
    met = materialise(met.select("content", "root", "g", packed("text").alias("shingles")).dropDuplicates(["content"]), "candidate-shingles")
    mine = F.pmod(F.xxhash64("content"), F.col("g")).cast("int")
    cells = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("content", "shingles", F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "content")
    return dealt.mapInPandas(lambda b: _compared(b, similarity), "a long, b long").distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class of near copies: that of the smallest id, then the smallest text hash.

    Texts of equal words are copies whatever their case and white space. Of
    exactly repeated rows one stays; null ids come after all others.
    """
    text = F.col(f"`{text_col}`").cast("string")
    signed = prefix_signatures(similarity, common_shingles(docs.select(text.alias("text"))))
    marked = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), signed(text).alias("w"))
    path = new_path(docs.sparkSession, "signatures")
    marked = stored(marked.select("id", "tie", "w.*"), path)
    ids = _counted(marked)
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")).alias("best")
    unique = marked.groupBy("content").agg(best, F.any_value(F.struct("keys", "size", "judge")).alias("w"))
    unique = materialise(unique.join(families(marked), "content").select("content", "family", "best", "w.*"), "distinct-contents")
    remove(docs.sparkSession, path)  # its keys are as large as the texts, and nothing reads them again
    met = components(family_links(unique).unionByName(candidates(unique, similarity)))
    roots = components(exact_links(docs, unique, met, similarity, id_col, text_col))
    return _keep_best(docs, ids, unique.select(F.col("content").alias("fp"), "best"), roots, id_col, text_col)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id, then the smallest text hash.

    The choice is made on (id, text hash, fingerprint) rows; of exactly repeated
    rows one stays. Rows of null ids take part as any other, after all ids.
    """
    text = F.col(f"`{text_col}`").cast("string")
    marked = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), fingerprint_udf(shingle)(text).alias("fp"))
    marked = materialise(marked, "fingerprints")
    firsts = materialise(marked.groupBy("fp").agg(F.min("id").alias("first"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")).alias("best")), "distinct-fingerprints")
    roots = components(linked(firsts.select("fp"), max_bits))
    return _keep_best(docs, _counted(marked), firsts.select("fp", "best"), roots, id_col, text_col)


def _counted(marked: DataFrame) -> DataFrame:
    """(id, tie, n): how often each id comes with each text hash."""
    return materialise(marked.groupBy("id", "tie").agg(F.count(F.lit(1)).alias("n")), "ids")


def _keep_best(docs: DataFrame, ids: DataFrame, firsts: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are the best of their root; ``firsts`` has (fp, best), ``ids`` the (id, tie, n) of all rows.

    Rows that go and repeated rows are put on a bit map; rows off it stay as they
    are, without a shuffle, and those on it are looked up.
    """
    key, text = pick_name(docs.columns, "simhash_key"), F.col(f"`{text_col}`").cast("string")
    owner = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "best")
    best = owner.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.tie")
    best = materialise(best, "kept-documents")
    stays = best.select(F.col("id").alias("b_id"), F.col("tie").alias("b_tie"))
    doubtful = ids.join(stays, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("tie") == F.col("b_tie")), "left").where("n > 1 or b_tie is null")
    bits = bit_map(doubtful, "id", "tie")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias(f"{key}_id"), F.xxhash64(text).alias(f"{key}_tie"))
    kept = on_map(rows, bits, f"{key}_id", f"{key}_tie").join(best, F.col(f"{key}_id").eqNullSafe(best["id"]) & (F.col(f"{key}_tie") == best["tie"]), "left_semi")
    kept = kept.dropDuplicates([f"{key}_id", f"{key}_tie"])  # repeats are dropped before they are shuffled
    kept = on_map(rows, bits, f"{key}_id", f"{key}_tie", on=False).unionByName(kept)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
