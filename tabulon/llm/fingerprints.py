"""SimHash fingerprints of documents, in DataFrame operations only.

A text's terms are its distinct words, of ASCII-lower-cased letters and digits.
A term's hash votes on each of 64 signed bits with the term's weight, its
number of characters: the short words that all texts of a language share weigh
little. A bit of the fingerprint is 1 if its votes are positive. Repeated words
count once, so repeated lines don't drown the rest.

Fingerprints within a Hamming radius are found in permuted block tables: 64
bits are cut into blocks, and for each choice of ``radius`` blocks that may
differ one table has the fingerprints under the bits of all other blocks. Two
fingerprints within the radius agree in at least one choice. They meet in the
first table in which they agree and in no later one, so no pair is found twice.
Stored fingerprints stand in the tables once each, with the number of rows that
have them, in cells of at most ``CELL``: a search meets whole cells.

To edit a text, its last third is replaced by the first code points of the
next document. Ranks come from one range sort of short rows; texts are shuffled
twice: to their rank, and there cut into head and lead (what the document
before takes), which meet by rank.

Rules: null texts are empty; a text without letters or digits has fingerprint
zero. Documents stand by descending id (null last), then by SHA-256 of the text, and the
last is followed by the first; a single document is followed by itself. Equal
rows are interchangeable. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import materialise, ranked

BITS = 64
#: Blocks of the tables: radius 3 gives 4 tables of 16 bits, or 20 of 32 bits with 6 blocks.
BLOCKS = 6
RADIUS = 3
#: Stored fingerprints that one row of a table holds.
CELL = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.split(F.translate(text, _UPPER, _LOWER), r"[^\p{L}\p{N}]+"))


def term_hash(term: Column) -> Column:
    """The first eight bytes of a term's MD5."""
    digest = F.md5(term)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def fingerprint(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, fp) of ``texts`` (keys, text); keys tell rows apart."""
    each = texts.select(*keys, F.explode_outer(terms(F.col("text"))).alias("term"))
    weight = F.coalesce(F.length("term"), F.lit(0)).cast("long")
    each = each.select(*keys, term_hash("term").alias("h"), weight.alias("w"))
    votes = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(1) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"v{b}") for b in range(BITS)]
    bits = [F.when(F.col(f"v{b}") > 0, F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0))).otherwise(F.lit(0)).cast("long") for b in range(BITS)]
    fp = bits[0]
    for bit in bits[1:]:
        fp = fp.bitwiseOR(bit)
    return each.groupBy(*keys).agg(*votes).select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def tables(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks, as signed longs, of the bits that a table's rows share: all but ``radius`` of the blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    ones = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(ones[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within(searched: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, n) of each distinct ``searched`` (fp) with how many rows of ``stored`` (fp, n) lie within ``radius`` bits, itself included."""
    masks = tables(blocks, radius)
    posted = F.explode(F.array(*[F.struct(F.lit(t).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)]))
    held = stored.groupBy("fp").agg(F.sum("n").alias("n")).select("fp", "n", posted.alias("at"))
    sizes = held.groupBy("at").agg(F.count(F.lit(1)).alias("size"))
    # a hot entry is dealt over cells by hash before it is gathered
    cells = held.join(sizes.where(F.col("size") > CELL), "at", "left")
    cells = cells.withColumn("cell", F.coalesce(F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") * 2 / CELL)), F.lit(0)))
    cells = cells.groupBy("at", "cell").agg(F.collect_list(F.struct("fp", "n")).alias("others"))
    asked = searched.select("fp").distinct().select("fp", posted.alias("at"))
    # its size is estimated before the explode, so it would be broadcast however large it is
    met = asked.hint("merge").join(cells, "at")

    def first_here(x: Column) -> Column:
        differ = x["fp"].bitwiseXOR(F.col("fp"))
        earlier = [(F.col("at.no") > t) & (differ.bitwiseAND(F.lit(m)) == 0) for t, m in enumerate(masks)]
        none = ~earlier[0]
        for e in earlier[1:]:
            none = none & ~e
        return (F.bit_count(differ) <= radius) & none

    near = F.aggregate(F.filter("others", first_here), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return met.groupBy("fp").agg(F.sum(near).alias("n"))


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, place, id, text) of each row; file and place tell rows apart and are the same whenever they are read."""
    own = [F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")]
    try:
        where = docs.metadataColumn("_metadata")
        return docs.select(F.xxhash64(where["file_path"]).alias("file"), where["row_index"].alias("place"), *own)
    except AnalysisException:  # not a scan of Parquet files: rows get their places when they are written
        return materialise(docs.select(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"), *own), "fingerprint-rows")


def neighbours(rows: DataFrame) -> DataFrame:
    """(file, place, id, n_chars, rank, taken, taken_by) of ``rows``: code points replaced at a row's end, and those that the row before takes from this one."""
    light = rows.select("file", "place", "id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("text", 256)).alias("tie"))
    light = materialise(light, "fingerprint-ids")
    placed = materialise(ranked(light, [F.col("id").desc_nulls_last(), F.col("tie"), F.col("file"), F.col("place")]), "fingerprint-ranks")
    n = placed.count()
    taken = F.floor(F.col("n_chars") / 3)
    before = placed.select(F.pmod(F.col("rank") + 1, F.lit(max(n, 1))).alias("rank"), taken.alias("taken_by"))
    return placed.join(before, "rank").select("file", "place", "id", "n_chars", "rank", taken.alias("taken"), "taken_by")


def edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(rank, text) of each row of ``rows`` after its edit; ``order`` is that of ``neighbours``."""
    n = F.lit(max(order.count(), 1))
    met = rows.select("file", "place", "text").join(order.select("file", "place", "n_chars", "rank", "taken", "taken_by"), ["file", "place"])
    head = F.struct("rank", F.lit(0).alias("kind"), F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("taken")).cast("int")).alias("piece"))
    lead = F.struct(F.pmod(F.col("rank") - 1, n).alias("rank"), F.lit(1).alias("kind"), F.substring(F.col("text"), F.lit(1), F.col("taken_by").cast("int")).alias("piece"))
    pieces = met.select(F.explode(F.array(head, lead)).alias("p")).select("p.*")
    both = pieces.withColumn("next", F.lead("piece").over(W.partitionBy("rank").orderBy("kind"))).where("kind = 0")
    return both.select("rank", F.concat("piece", "next").alias("text"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 20) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within) of each row.

    ``n_within`` is, for ids that ``every`` divides, the number of rows whose
    fingerprints lie within ``RADIUS`` bits of the row's own, itself included.
    """
    rows = addressed(docs, id_col, text_col)
    order = neighbours(rows)
    order = materialise(order, "fingerprint-order")
    own = materialise(fingerprint(rows.select("file", "place", "text"), "file", "place"), "fingerprints")
    changed = edited(rows, order)
    digests = F.sha2("text", 256)
    changed_fp = materialise(fingerprint(changed.select("rank", digests.alias("sha"), "text"), "rank", "sha"), "fingerprints-edited")
    known = materialise(order.join(own, ["file", "place"]).select("id", "n_chars", "rank", "fp"), "fingerprints-ranked")
    after = known.select(F.pmod(F.col("rank") - 1, F.lit(max(known.count(), 1))).alias("rank"), F.col("fp").alias("next_fp"))
    met = known.join(changed_fp.withColumnRenamed("fp", "edited_fp"), "rank").join(after, "rank")
    stored = known.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    asked = known.where(F.col("id").cast("decimal(38,0)") % every == 0)
    found = asked.select("rank", "fp").join(within(asked, stored), "fp").select("rank", F.col("n").alias("n_within"))
    met = met.join(found, "rank", "left")
    return met.select(
        "id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_within",
    )
