"""Repair of conversation structure over a suffix-shared automaton.

A conversation's rows become a signature: one symbol a row, its role class in
small letters, in capitals if its text is cut off, and ``d`` for a row that has
to go (blank, or said before). Signatures that end alike share the nodes of
their common end, so the automaton is minimised from the end: Spark range-sorts
the distinct reversed signatures, and a task walks along them keeping the nodes
of the end that the next one shares. Each node holds, once for all
conversations and for each state of the grammar ``(s?(ua)+)?``, the cost to go
and the first edit of the best audit from there. Edits that can tie begin with
different letters, and what follows an edit is settled by the node and state it
leads to, so (cost, letter) decides and no audits are compared.

Roles and texts meet only at the end, where each conversation's rows stream by
in order with its audit ahead of them; digests are running hashes, so a task
holds one row. What a conversation needs in one piece is what the result has in
one cell: a character a row of signature and audit. Signatures are put together
from pieces of ``PIECE`` rows. A SHA-256 of a whole conversation is a chain by
definition, so one conversation's texts pass through one task.

Rules: null roles and texts are one space. Rows stand by turn (null first),
then role, then SHA-256 of the text; equal rows are interchangeable. A null id
is a conversation of its own. An empty role or one with another initial can't
be kept. Conversations without rows have zero counts, no audit and the digest
of nothing. An empty table gives an empty result. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import materialise, ranked

#: Rows of a conversation whose symbols are gathered at once.
PIECE = 1024
#: Costs of the edits, and what a cut-off row that stays adds.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1

#: States of the grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where keeping a role leads, by state.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Where a user or assistant put in, or given as new role, leads.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLES = ("user", "user", "assistant", "user")
_FAR = 1 << 60


def _settled(moves: list[tuple[int, str]]) -> tuple[tuple[int, str], ...]:
    """Best moves of a node, with rows put in before it where that is better."""
    for _ in range(len(moves)):
        moves = [min(move, (INSERT + moves[_NEXT[s]][0], "I")) for s, move in enumerate(moves)]
    return tuple(moves)


END = _settled([(0, ""), (_FAR, ""), (_FAR, ""), (0, "")])


def node(symbol: str, after: tuple[tuple[int, str], ...]) -> tuple[tuple[int, str], ...]:
    """(cost to go, first edit) by state, before a row ``symbol`` that the node ``after`` follows."""
    moves = []
    for s in range(4):
        options = [(DELETE + after[s][0], "D")]
        if symbol != "d":
            more = CUT_OFF if symbol.isupper() else 0
            options.append((more + REROLE + after[_NEXT[s]][0], "R"))
            kept = _KEPT[s].get(symbol.lower())
            if kept is not None:
                options.append((more + after[kept][0], "K"))
        moves.append(min(options))
    return _settled(moves)


def best_audit(signature: str, nodes: list[tuple[tuple[int, str], ...]]) -> str:
    """The audit that ``nodes``, from the end of ``signature`` to its begin, spell out."""
    audit, state, at = [], START, len(signature)
    while letter := nodes[at][state][1]:
        audit.append(letter)
        if letter == "K":
            state = _KEPT[state][signature[-at].lower()]
        elif letter != "D":
            state = _NEXT[state]
        at -= letter != "I"
    return "".join(audit)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of sorted reversed signatures; nodes of the end shared with the one before are kept."""
    nodes, before = [END], ""
    for batch in batches:
        found = []
        for back in batch.column("back").to_pylist():
            same = next((i for i, (a, b) in enumerate(zip(before, back)) if a != b), min(len(before), len(back)))
            del nodes[same + 1 :]
            for symbol in back[same:]:
                nodes.append(node(symbol, nodes[-1]))
            found.append((back[::-1], nodes[-1][START][0], best_audit(back[::-1], nodes)))
            before = back
        signature, cost, audit = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(signature, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct ``signatures``."""
    back = materialise(signatures.select(F.reverse("signature").alias("back")).distinct(), "signatures")
    ordered = back.repartitionByRange("back").sortWithinPartitions("back")
    return ordered.mapInArrow(_walk, "signature string, cost long, audit string")


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, digest) of repaired conversations: an audit, then its rows, and so on."""
    digest, audit, at, state, begun = None, "", 0, START, False
    conv, schema = None, None

    def put(role: str, text: str) -> None:
        nonlocal begun
        if begun:
            digest.update(b"\n")
        digest.update(role.encode())
        digest.update(b":")
        digest.update(text.encode())
        begun = True

    def put_in() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            put(_ROLES[state], "")
            state, at = _NEXT[state], at + 1

    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("repaired", pa.string())])
        done = []
        columns = [batch.column(c) for c in ("conv_id", "audit", "role", "text")]
        for i in range(batch.num_rows):
            conv_id, whole, role, text = (c[i].as_py() for c in columns)
            if whole is not None:
                if digest:
                    put_in()
                    done.append((conv, digest.hexdigest()))
                conv, digest, audit, at, state, begun = conv_id, sha256(), whole, 0, START, False
                continue
            put_in()
            edit, at = audit[at], at + 1
            if edit == "R":
                role, state = _ROLES[state], _NEXT[state]
            elif edit == "K":
                state = _KEPT[state][role[0]]
            if edit != "D":
                put(role, text)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema.field(0).type), pa.array([d[1] for d in done], pa.string())], schema=schema)
    if digest:
        put_in()
        yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], schema=schema)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(``conv_id:turn``) % 20 deals; nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), hit.alias("hit")).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _joined(column: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", column))), lambda x: x[column]), "")


def _first(column: Column) -> Column:
    return F.substring(column, 1, 1)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, roles, blank, duplicate, truncated, gaps) of conversations of ``rows`` (conv_id, turn, role, text)."""
    text = F.col("text")
    said = text.rlike(r"[^\x20\x09-\x0D]")
    ended = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), said.alias("said"), ended.alias("ended"))
    light = materialise(light.withColumn("uid", F.monotonically_increasing_id()), "turns")
    placed = materialise(ranked(light, [F.col("conv_id").asc_nulls_first(), *_order(), F.col("uid")]), "turns-ranked")
    same = ["conv_id", "role", "digest"]
    first = placed.groupBy(*same).agg(F.min("rank").alias("first_rank"))
    met = placed.alias("p").join(first.alias("f"), F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.role") == F.col("f.role")) & (F.col("p.digest") == F.col("f.digest")))
    initial = F.when(_first(F.col("p.role")).isin("s", "u", "a"), _first(F.col("p.role"))).otherwise("x")
    blank, again = ~F.col("said"), F.col("said") & (F.col("rank") > F.col("first_rank"))
    cut = F.col("said") & ~again & ~F.col("ended")
    symbol = F.when(blank | again, "d").when(cut, F.upper(initial)).otherwise(initial)
    each = met.select("p.conv_id", "rank", initial.alias("roles"), symbol.alias("signature"), blank.alias("blank"), again.alias("duplicate"), cut.alias("truncated"))
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    pieces = each.withColumn("place", F.col("rank")).groupBy("conv_id", F.floor(F.col("rank") / PIECE).alias("piece")).agg(_joined("signature").alias("signature"), _joined("roles").alias("roles"), *counts)
    whole = pieces.withColumnRenamed("piece", "place").groupBy("conv_id").agg(_joined("signature").alias("signature"), _joined("roles").alias("roles"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    return whole.alias("w").join(turns.alias("t"), F.col("w.conv_id").eqNullSafe(F.col("t.conv_id"))).select("w.*", "gaps")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each of ``conversations`` (conv_id), whose ``rows`` are (conv_id, turn, role, text)."""
    signed = materialise(signatures(rows), "conversations")
    best = audits(signed.select("signature"))
    met = signed.join(best, "signature").withColumnRenamed("conv_id", "of")
    legal = F.regexp_count("roles", F.lit("(?=su|ua|au)"))
    known = ["gaps", "blank", "duplicate", "truncated"]
    ids = conversations.select("conv_id").distinct()
    met = ids.join(met, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    illegal = F.greatest(F.length("roles") - 1 - legal, F.lit(0))
    found = met.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in known], F.coalesce(illegal, F.lit(0)).cast("long").alias("illegal"), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    found = materialise(found, "audits")
    ahead = found.select("conv_id", F.lit(0).alias("kind"), "audit")
    texts = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("kind", F.lit(1))
    stream = ahead.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    kind = rows.schema["conv_id"].dataType.simpleString()
    digests = stream.select("conv_id", "audit", "role", "text").mapInArrow(_repaired, f"conv_id {kind}, repaired string")
    met = found.alias("a").join(digests.alias("d"), F.col("a.conv_id").eqNullSafe(F.col("d.conv_id")))
    return met.select("a.*", F.col("repaired").alias("repaired_sha256"))
