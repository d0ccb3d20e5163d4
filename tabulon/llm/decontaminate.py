"""Benchmark decontamination by template windows, in DataFrame operations only.

A text becomes a list of tokens; numbers, names and units keep their value
behind a type mark, and a token's *template* is the mark alone (or the word).
Windows of ``window`` templates of all benchmark items are hash-joined with the
windows of all documents, so a question whose numbers, names or units were
exchanged still meets its original. The join has two steps: each window of the
benchmark has an anchor, its pair of neighbouring templates with the most
letters; where a document holds that pair, its window around it is hashed and
compared. Hits on one alignment of a text with an item are put together, and
the slots on it are checked: every original value must stand for one new value
and the other way round. An alignment that is consistent and covers ``least``
tokens, or the item, is a leak. So is one with a run of ``least`` equal tokens.

A window with fewer than half of its tokens outside slots would match by
shape alone; there the values themselves are hashed. Items shorter than a
window are looked for at their own length.

Names are capitalised words inside a sentence, units are unit words behind a
number, numbers start with a digit. What stands before an item decides on the
mark of its first word, so an item is looked for with either form of it; that
word itself must be equal. Null and empty texts never match. Hits are kept
by a digest of the text, so copies share them. Null or repeated ids are rows
like any other. With an empty benchmark nothing leaks. Further columns pass
through ``clean`` untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import materialise, pick_name

WINDOW = 8
LEAST = 13
#: Benchmarks of up to so many windows are broadcast; larger ones meet by a shuffled hash.
BROADCAST_WINDOWS = 500_000

#: Unit words.
UNITS = "kg|g|mg|lbs?|oz|km|cm|mm|m|mi|miles?|met(?:er|re)s?|feet|ft|inch(?:es)?|hours?|hrs?|minutes?|mins?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|percent|lit(?:er|re)s?|ml|l"

_NAME = r"[\x20\x09-\x0D](?=\p{Lu})(?<=[\p{L}\p{N},;:][\x20\x09-\x0D]{1,2})"
_POINT = r"[.,](?<=[0-9][.,])(?=[0-9])"
_UNIT = rf"([0-9%])\x20?({UNITS})(?![\p{{L}}\p{{N}}])"
_OTHER = r"[^\p{L}\p{N}@~_]+"


def tokens(text: Column) -> Column:
    """Marked tokens: ``@name``, ``~unit``, numbers with their first digit, other words in lower case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    free = F.when(text.contains("@") | text.contains("~") | text.contains("_"), F.regexp_replace(text, r"[@~_]", " ")).otherwise(text)
    marked = F.regexp_replace(free, _NAME, "$0@")
    marked = F.regexp_replace(F.regexp_replace(marked, _POINT, "_"), _UNIT, "$1 ~$2")
    return F.array_remove(F.split(F.lower(marked), _OTHER), "")


def kind(token: Column) -> Column:
    """Mark of a slot token, null for a word."""
    first = F.ascii(token)
    return F.when(first == ord("@"), "@").when(first == ord("~"), "~").when(first.between(ord("0"), ord("9")), "#")


def shape(token: Column) -> Column:
    """The template of a token: its mark, or the word."""
    return F.coalesce(kind(token), token)


def _windows(items: DataFrame) -> DataFrame:
    """(item, item_row, length, b_pos, by_shape, hash, offset, anchor) of all windows of ``length`` of an item's tokens."""
    keep = ["item", "item_row", "length", "b_pos", "by_shape"]
    starts = items.select("item", "item_row", "length", "toks", F.explode(F.sequence(F.lit(0), F.size("toks") - F.col("length"))).alias("b_pos"))
    own = starts.withColumn("own", F.explode(F.array(F.slice("toks", F.col("b_pos") + 1, F.col("length")))))
    own = own.withColumn("by_shape", F.size(F.filter("own", lambda t: kind(t).isNotNull())) * 2 <= F.col("length"))
    used = own.select(*keep, F.explode(F.array(F.when(F.col("by_shape"), F.transform("own", shape)).otherwise(F.col("own")))).alias("used"))
    pairs = used.select(*keep, "used", F.posexplode("used").alias("offset", "first")).withColumn("second", F.get("used", F.col("offset") + 1))
    pairs = pairs.where((F.col("length") == 1) | F.col("second").isNotNull()).withColumn("second", F.coalesce("second", F.lit("")))
    letters = F.length(F.regexp_replace(F.concat("first", "second"), r"[^\p{L}\p{N}]", ""))
    best = F.max_by(F.struct("offset", F.xxhash64("first", "second").alias("anchor"), window_hash(F.col("used")).alias("hash")), F.struct(letters, -F.col("offset"))).alias("best")
    return pairs.groupBy(*keep).agg(best).select(*keep, "best.*")


def window_hash(used: Column) -> Column:
    return F.xxhash64(used, F.size(used))


def _leads(items: DataFrame) -> DataFrame:
    """item, toks and lead: the mark (or none) that the first word has behind other text."""
    first = F.get("toks", F.lit(0))
    capital = F.col("text").cast("string").rlike(r"^[^\p{L}\p{N}]*\p{Lu}") & kind(first).isNull()
    leads = F.array_compact(F.array(F.lit(""), F.when(capital, "@"), F.when(first.rlike(rf"^(?:{UNITS})$"), "~")))
    out = items.select("item", "text", tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0).withColumn("lead", F.explode(leads))
    marked = F.concat(F.array(F.concat("lead", first)), F.slice("toks", F.lit(2), F.size("toks")))
    return out.select("item", "lead", F.when(F.col("lead") == "", F.col("toks")).otherwise(marked).alias("toks"))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The items (item, item_row: a digest of the item, toks, lead, length of its windows), and their windows."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    items = _leads(items).withColumn("item_row", F.xxhash64("item", "toks")).withColumn("length", F.least(F.size("toks"), F.lit(window)))
    items = materialise(items.select("item", "item_row", "toks", "lead", "length").dropDuplicates(["item_row"]), "benchmark-items")
    return items, materialise(_windows(items), "benchmark-windows")


def _pairs(texts: DataFrame, values: bool, single: bool) -> DataFrame:
    """(text_key, toks, pos, anchor): every pair of neighbouring tokens of text, as templates; asked for, also as they are where these differ, and each token alone."""
    toks = texts.select("text_key", F.explode(F.array(tokens(F.col("text")))).alias("toks"))
    placed = toks.select("text_key", "toks", F.posexplode("toks").alias("pos", "first")).withColumn("second", F.get("toks", F.col("pos") + 1))
    first, second = F.col("first"), F.col("second")
    there, slots = second.isNotNull(), kind(first).isNotNull() | kind(second).isNotNull()
    keys = [F.when(there, F.xxhash64(shape(first), shape(second)))]
    if values:
        keys.append(F.when(there & slots, F.xxhash64(first, second)))
    if single:
        keys += [F.xxhash64(shape(first), F.lit("")), F.when(kind(first).isNotNull(), F.xxhash64(first, F.lit("")))]
    anchor = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    return placed.select("text_key", "toks", "pos", anchor.alias("anchor")).where("anchor is not null")


def _hits(docs: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """(text_key, item, item_row, shift, b_pos, d_toks): windows that a text and an item share."""
    n, by_value, single = grams.agg(F.count(F.lit(1)), F.count_if(~F.col("by_shape")), F.count_if(F.col("length") == 1)).first()
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("text_key", F.unhex(F.md5("text")))
    spread = _pairs(texts, by_value > 0, single > 0)
    start = F.col("pos") - F.col("offset")
    if n <= BROADCAST_WINDOWS:
        met = spread.join(F.broadcast(grams), "anchor")
    else:
        # a benchmark too large to broadcast: only hashes are shuffled, the few texts that are met are read again
        met = materialise(spread.drop("toks").join(grams, "anchor").select("text_key", "item", "item_row", "length", "b_pos", "by_shape", "hash", "offset", "pos").distinct(), "template-anchors")
        again = texts.join(met.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"])
        met = met.join(again.select("text_key", tokens(F.col("text")).alias("toks")), "text_key")
    met = met.where((start >= 0) & (start + F.col("length") <= F.size("toks")))
    # behind an explode, which keeps the interpreted functions out of the join and its loop over all pairs
    met = met.withColumn("own", F.explode(F.array(F.slice("toks", start + 1, F.col("length")))))
    met = met.withColumn("own_hash", F.explode(F.array(window_hash(F.when(F.col("by_shape"), F.transform("own", shape)).otherwise(F.col("own"))))))
    return met.where("own_hash = hash").select("text_key", "item", "item_row", (start - F.col("b_pos")).alias("shift"), "b_pos", F.col("own").alias("d_toks"))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(text_key, item, covered): distinct leaked texts by the digest of the text."""
    items, grams = benchmark_windows(benchmark, item_col, item_text_col, window)
    hits = materialise(_hits(docs, grams, text_col).distinct(), "template-windows")
    pairs = hits.join(items.select("item_row", "toks", "lead"), "item_row")
    aligned = F.transform("d_toks", lambda d, j: F.struct((F.col("b_pos") + j).alias("at"), F.get("toks", F.col("b_pos") + j).alias("b"), d.alias("d")))
    pairs = pairs.select("text_key", "item", "item_row", "lead", "shift", F.size("toks").alias("n"), F.explode(aligned).alias("p")).distinct()
    # the mark of a first word makes no slot of it
    pairs = pairs.where((F.col("lead") == "") | (F.col("p.at") > 0) | (F.col("p.b") == F.col("p.d")))
    slot = kind(F.col("p.b")).isNotNull()
    whole = pairs.groupBy("text_key", "item", "item_row", "shift", "n").agg(
        F.count_distinct("p.at").alias("covered"),
        F.count_distinct(F.when(slot, F.col("p.b"))).alias("n_b"),
        F.count_distinct(F.when(slot, F.col("p.d"))).alias("n_d"),
        F.count_distinct(F.when(slot, F.struct("p.b", "p.d"))).alias("n_pairs"),
        _longest_run(F.array_sort(F.collect_set(F.when(F.col("p.b") == F.col("p.d"), F.col("p.at"))))).alias("equal"),
    )
    # one value of the item for one of the text, and the other way round
    consistent = (F.col("n_b") == F.col("n_pairs")) & (F.col("n_d") == F.col("n_pairs"))
    sound = consistent & (F.col("covered") >= F.least("n", F.lit(least))) | (F.col("equal") >= least)
    return whole.where(sound).groupBy("text_key", "item").agg(F.max("covered").alias("covered"))


def _longest_run(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in a sorted array."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(seen: Column, at: Column) -> Column:
        run = F.when(at == seen["last"] + 1, seen["run"] + 1).otherwise(F.lit(1))
        return F.struct(at.alias("last"), run.alias("run"), F.greatest(seen["most"], run).alias("most"))

    return F.aggregate(places, start, step, lambda seen: seen["most"])


def leaked_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc id, item_id, covered): the documents into which an item leaks, and the items."""
    found = leaks(docs, benchmark, text_col, **options)
    keyed = docs.select(F.col(id_col), F.unhex(F.md5(F.col(text_col).cast("string"))).alias("text_key"))
    return keyed.join(found, "text_key").select(id_col, F.col("item").alias("item_id"), "covered")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents into which an item leaks."""
    held = materialise(leaks(docs, benchmark, text_col, **options).select("text_key").distinct(), "leaked-texts")
    key = pick_name(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))
    return keyed.join(held.withColumnRenamed("text_key", key), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
