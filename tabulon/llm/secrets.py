"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every historical version of a file is content-addressed by the SHA-256 of its
text. The ledger has one row for each scanned blob: the rule versions that have
seen it and the spans that they found. A run scans a blob once, however many
paths hold it, and only with the rule versions that its ledger row lacks; the
findings of old and new rows are then joined back to all paths. Raising a
rule's version makes all blobs unseen for that rule alone.

Spans are code points, end exclusive: the lengths of the pieces between the
matches, and of the matches, are summed in order within one blob and rule.

Null texts are empty texts. A null or repeated path is a path like any other.
Texts without findings have zero counts and empty span strings. An empty table
gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import materialise


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base rules first, in their listed order; the others are added by this scan.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

LEDGER = "blob binary, rules array<string>, spans array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _lengths(items: Column) -> Column:
    return F.transform(items, lambda x: F.length(x))


def _matches(text: Column, rule: Rule, number: int, due: Column) -> Column:
    """Struct of a rule's piece, match and value lengths in a text; null where not due or without a match."""
    found = F.struct(
        F.lit(rule.kind).alias("kind"),
        F.lit(number).alias("kind_no"),
        F.lit(rule.least).alias("least"),
        _lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        _lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias("size"),
        _lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias("value"),
    )
    return F.when(due & text.rlike(rule.pattern), found)


def blobs_of(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob, text) of every version."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return versions.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text; repeats allowed) after scanning the unseen blob and rule-version pairs."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    once = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        due = once.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.select(F.col("blob").alias("l_blob"), F.col("rules").alias("seen"))
        due = once.join(seen, F.col("blob") == F.col("l_blob"), "left").drop("l_blob")
        due = due.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        due = due.where(F.size(F.array_except(keys, "seen")) > 0)
    per_rule = [_matches(F.col("text"), r, i, ~F.array_contains("seen", r.key)) for i, r in enumerate(rules)]
    hits = due.select("blob", "seen", F.filter(F.array(*per_rule), lambda x: x.isNotNull()).alias("hits"))
    hits = materialise(hits, "secret-hits")
    each = hits.select("blob", F.explode("hits").alias("h")).select("blob", "h.kind", "h.kind_no", "h.least", F.posexplode(F.arrays_zip("h.gap", "h.size", "h.value")).alias("at", "m"))
    order = W.partitionBy("blob", "kind_no").orderBy("at")
    end = (F.sum("m.gap").over(order) + F.sum("m.size").over(order)).cast("int")
    each = each.withColumn("end", end).where("m.value >= least")
    spans = each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("m.size")).cast("int").alias("start"), "kind_no", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    rows = hits.select("blob", F.array_union("seen", keys).alias("rules")).join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", none))
    if ledger is None:
        return rows
    current = F.array(*[F.lit(r.kind) for r in rules])
    old = ledger.select("blob", F.col("rules").alias("old_rules"), F.col("spans").alias("old_spans"))
    both = old.join(rows, "blob", "full_outer")
    newly = F.transform(F.array_except("rules", F.coalesce("old_rules", F.array().cast("array<string>"))), lambda k: F.split_part(k, F.lit("@"), F.lit(1)))
    kept = F.filter("old_spans", lambda s: F.array_contains(current, s["kind"]) & ~F.coalesce(F.array_contains(newly, s["kind"]), F.lit(False)))
    merged = F.array_sort(F.concat(F.coalesce(kept, none), F.coalesce("spans", none)))
    return both.select("blob", F.coalesce("rules", "old_rules").alias("rules"), merged.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row a path (path, blob): counts of the base kinds, digest of the base spans, all spans."""
    found = ledger.where(F.size("spans") > 0).select(F.col("blob").alias("f_blob"), "spans")
    met = paths.join(found, F.col("blob") == F.col("f_blob"), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>"))
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE))
    counts = [_count(spans, r.kind).alias(f"n_{r.kind}") for r in BASE]
    return met.select("path", "blob", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of all paths, the ledger to keep for the next run)."""
    versions = blobs_of(versions, path_col, text_col)
    after = materialise(scan_blobs(versions.select("blob", "text"), ledger, rules), "secret-ledger")
    return findings(versions.select("path", "blob"), after), after
