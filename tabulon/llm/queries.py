"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, dialogue, fingerprints, langid, merkle, mixing, neighbours, quality, records, secrets, simhash, toxicity, webtext
from tabulon.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents; see tabulon.llm.simhash for null, empty and tie rules."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix of all sources."""
    out = mixing.assign(mixing.measure(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM sized GROUP BY source),
rising AS (
  SELECT *, sum(source_size) OVER () AS all_size,
         coalesce(sum(2 * source_size) OVER o, 0) AS cap_before,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
  FROM sources
  WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, 2 * source_size * w_left * 2 <= w * (3 * all_size - 2 * cap_before) AS is_full FROM rising),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w * (3 * all_size - 2 * sum(CASE WHEN is_full THEN 2 * source_size ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(2 * sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM marked),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (budget // source_size) * size
                      + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' token ids, read back from the record files."""
    return records.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, scanned once per distinct text from an empty ledger."""
    found, _ = secrets.scan(table(spark, sf_dir, "documents"))
    return found.drop("blob").withColumnRenamed("path", "doc_id")


def _secret_sql() -> str:
    keyword = "|".join(
        (
            "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]",
            "[Pp][Aa][Ss][Ss][Ww][Dd]",
            "[Ss][Ee][Cc][Rr][Ee][Tt]",
            "[Tt][Oo][Kk][Ee][Nn]",
            "[Aa][Pp][Ii]_?[Kk][Ee][Yy]",
        )
    )
    kinds = [
        ("assign", f"({keyword})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]{16,}", 0, 16),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40),
    ]
    parts = [
        f"""SELECT row_no, {i} AS kind_no, '{kind}' AS kind, {least} AS least,
             unnest(list_transform(string_split_regex(text, '{p}'), lambda x: length(x))[:-2]) AS gap,
             unnest(list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x))) AS size,
             unnest(list_transform(regexp_extract_all(text, '{p}', {g}), lambda x: length(x))) AS val,
             unnest(range(len(regexp_extract_all(text, '{p}')))) AS nth
           FROM docs WHERE regexp_matches(text, '{p}')"""
        for i, (kind, p, g, least) in enumerate((k, p.replace("'", "''"), g, least) for k, p, g, least in kinds)
    ]
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
    matched AS ({" UNION ALL ".join(parts)}),
    placed AS (SELECT *, sum(gap) OVER o + sum(size) OVER o AS fin FROM matched
               WINDOW o AS (PARTITION BY row_no, kind_no ORDER BY nth)),
    spans AS (SELECT row_no, kind_no, kind, CAST(fin - size AS BIGINT) AS start,
                     kind || ':' || CAST(fin - size AS BIGINT) || ':' || CAST(fin AS BIGINT) AS s
              FROM placed WHERE val >= least),
    per AS (SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(s, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
                   string_agg(s, ',' ORDER BY start, kind_no) AS spans
            FROM spans GROUP BY row_no)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN per USING (row_no)"""


ORACLE["op5_secret_scan"] = _secret_sql()


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into which benchmark items leak, verbatim or re-parameterised, with the items."""
    return decontaminate.leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.FOLD).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    out = docs.select("doc_id", held_out("doc_id", langid.FOLDS, langid.FOLD).alias("held_out"), found.alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page from its host's consensus paths."""
    return webtext.main_text(table(spark, sf_dir, "pages"))


@query
def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by inner product, of every row whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


ORACLE["op7_nearest_vectors"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op2_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents labelled as good, and whether it is kept."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof digest and folded root of every document in the manifest by source."""
    return merkle.manifest(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


#: crc32 of an ASCII string ``s``: a table ``crc`` with one list of its 256 remainders, and the expression over that list.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS remainders FROM range(256) r(i))"


def _crc_sql(s: str) -> str:
    codes = f"list_transform(regexp_extract_all({s}, '[\\x00-\\x7F]'), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle_sql() -> str:
    field = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
    fields = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    changed = f"""CASE WHEN {_crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"""

    def levels(base: str, out: str) -> str:
        return f"""{out} AS (
          SELECT tree, 0 AS level, pos, n, digest FROM {base}
          UNION ALL
          SELECT tree, any_value(level) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos))
          FROM {out} WHERE n > 1 GROUP BY tree, pos // 3)"""

    def above(leaves: str, levels: str, out: str) -> str:
        return f"""{out} AS (
          SELECT l.id, r.level, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < l.pos // pow3), '') AS lefts,
                 coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > l.pos // pow3), '') AS rights
          FROM {leaves} l, (SELECT level, CAST(3 ** level AS BIGINT) AS pow3 FROM range(40) x(level)) r, {levels} s
          WHERE s.tree = l.tree AND s.level = r.level AND s.n > 1 AND s.pos // 3 = l.pos // (3 * pow3)
          GROUP BY l.id, r.level)"""

    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    docs AS (SELECT row_number() OVER () AS id, coalesce('s' || source, '') AS tree, doc_id, sha256({fields} || {field.format("text")}) AS digest,
                    sha256({fields} || {field.format("(" + changed + ")")}) AS other FROM documents, crc),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
    {levels("leaves", "nodes")},
    subroots AS (SELECT row_number() OVER (ORDER BY tree) AS id, '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    {levels("subroots", "heads")},
    {above("leaves", "nodes", "low")},
    {above("subroots", "heads", "high")},
    steps AS (SELECT id, level, lefts, rights FROM low
              UNION ALL
              SELECT l.id, 1000 + h.level, lefts, rights FROM leaves l JOIN subroots s ON s.name = l.tree JOIN high h ON h.id = s.id),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS step FROM steps),
    folded AS (SELECT id, 0 AS step, other AS digest FROM leaves
               UNION ALL
               SELECT f.id, s.step, sha256(lefts || digest || rights) FROM folded f JOIN numbered s ON s.id = f.id AND s.step = f.step + 1),
    ends AS (SELECT id, arg_max(digest, step) AS folded_root FROM folded GROUP BY id),
    proofs AS (SELECT id, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM numbered GROUP BY id),
    root AS (SELECT digest AS root FROM heads WHERE n = 1)
    SELECT doc_id, l.digest AS leaf, s.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN subroots s ON s.name = l.tree JOIN ends ON ends.id = l.id LEFT JOIN proofs ON proofs.id = l.id, root"""


ORACLE["op11_merkle_manifest"] = _merkle_sql()


@query
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damaged(rows), rows)


def _dialogue_sql() -> str:
    ws = r"\x20\x09-\x0D"

    def least(*options: tuple[str, str]) -> str:
        """The least of (cost, letter) pairs."""
        return "list_min([" + ", ".join(f"{{'c': {c}, 'm': '{m}'}}" for c, m in options) + "])"

    far = 1 << 40
    step = {0: ("u", 2, {"s": 1, "u": 2}), 1: ("u", 2, {"u": 2}), 2: ("a", 3, {"a": 3}), 3: ("u", 2, {"u": 2})}
    own = []
    for s, (_, to, kept) in step.items():
        keep = "CASE " + " ".join(f"WHEN lower(sym) = '{k}' THEN cut + m{t}.c" for k, t in kept.items()) + f" ELSE {far} END"
        own.append(least((f"3 + m{s}.c", "D"), (f"CASE WHEN sym = 'd' THEN {far} ELSE cut + 2 + m{to}.c END", "R"), (keep, "K")) + f" AS o{s}")
    final = ", ".join(f"list_min([o{s}, {{'c': 2 + least(o{to}.c, 2 + o{step[to][1]}.c), 'm': 'I'}}]) AS m{s}" for s, (_, to, _) in step.items())
    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit FROM conversations, crc),
    ids AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
    rows_ AS (SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                     CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM hit JOIN ids ON hit.conv_id IS NOT DISTINCT FROM ids.conv_id, range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS spot, count(*) OVER (PARTITION BY conv) AS n FROM rows_),
    faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{ws}]') THEN 'blank'
                              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY spot) > 1 THEN 'duplicate'
                              WHEN NOT regexp_matches(text, '[.!?][{ws}]*$') THEN 'truncated' ELSE '' END AS fault,
                      CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS ini,
                      lag(role[1]) OVER (PARTITION BY conv ORDER BY spot) || role[1] AS pair
               FROM placed),
    syms AS (SELECT conv, spot, n, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE ini END AS sym, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut FROM faults),
    togo AS (
      SELECT conv, max(spot) + 1 AS spot, {{'c': 0, 'm': ''}} AS m0, {{'c': 4, 'm': 'I'}} AS m1, {{'c': 2, 'm': 'I'}} AS m2, {{'c': 0, 'm': ''}} AS m3 FROM syms GROUP BY conv
      UNION ALL
      SELECT conv, spot, {final} FROM (SELECT t.conv, s.spot, {", ".join(own)} FROM togo t JOIN syms s ON s.conv = t.conv AND s.spot = t.spot - 1)),
    moves AS (SELECT conv, spot, unnest([m0, m1, m2, m3]) AS best, unnest([0, 1, 2, 3]) AS state FROM togo),
    steps AS (SELECT m.conv, m.spot, state, best.c AS cost, best.m AS letter,
                     CASE best.m WHEN 'D' THEN state WHEN 'K' THEN CASE sym WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END AS then_state
              FROM moves m LEFT JOIN syms s ON s.conv = m.conv AND s.spot = m.spot),
    walk AS (
      SELECT conv, 1 AS nth, spot, state, letter, then_state FROM steps WHERE spot = 1 AND state = 0
      UNION ALL
      SELECT w.conv, nth + 1, s.spot, s.state, s.letter, s.then_state FROM walk w JOIN steps s
        ON s.conv = w.conv AND s.spot = w.spot + CASE w.letter WHEN 'I' THEN 0 ELSE 1 END AND s.state = w.then_state WHERE w.letter <> ''),
    told AS (SELECT w.conv, string_agg(letter, '' ORDER BY nth) AS audit,
                    string_agg(CASE WHEN letter = 'K' THEN role WHEN w.state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) FILTER (letter IN ('K', 'R', 'I')) AS repaired
             FROM walk w LEFT JOIN placed p ON p.conv = w.conv AND p.spot = w.spot GROUP BY w.conv),
    counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                      count(*) FILTER (spot > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv)
    SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(coalesce(s.cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM ids LEFT JOIN counts ON counts.conv = ids.conv LEFT JOIN told ON told.conv = ids.conv LEFT JOIN steps s ON s.conv = ids.conv AND s.spot = 1 AND s.state = 0"""


ORACLE["op12_dialogue_repair"] = _dialogue_sql()


@query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, how alike they are, and how many others are near."""
    return fingerprints.compare(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE["op13_fingerprints"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
                     row_number() OVER (ORDER BY doc_id DESC NULLS LAST, sha256(coalesce(text, ''))) - 1 AS rank, count(*) OVER () AS n FROM documents),
edits AS (SELECT d.rank, d.text[1:d.n_chars - d.n_chars // 3] || e.text[1:d.n_chars // 3] AS text
          FROM docs d JOIN docs e ON e.rank = (d.rank + 1) % d.n),
texts AS (SELECT 0 AS kind, rank, text FROM docs UNION ALL SELECT 1, rank, text FROM edits),
terms AS (SELECT kind, rank, CAST('0x' || md5(term)[1:16] AS UBIGINT) AS h, length(term) AS w
          FROM (SELECT kind, rank, unnest(list_distinct(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'))) AS term FROM texts)),
votes AS (SELECT kind, rank, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN w ELSE -w END) AS v FROM terms, range(64) bits(b) GROUP BY ALL),
fps AS (SELECT t.kind, t.rank, coalesce(bit_or(CASE WHEN v > 0 THEN CAST(1 AS UBIGINT) << b ELSE 0 END), 0) AS fp
        FROM texts t LEFT JOIN votes v ON v.kind = t.kind AND v.rank = t.rank GROUP BY t.kind, t.rank),
stored AS (SELECT fp, count(*) AS n FROM fps WHERE kind = 0 GROUP BY fp),
found AS (SELECT q.rank, sum(s.n) AS n_within FROM fps q JOIN docs d ON d.rank = q.rank AND d.doc_id % 20 = 0 JOIN stored s ON bit_count(xor(q.fp, s.fp)) <= 3
          WHERE q.kind = 0 GROUP BY q.rank)
SELECT d.doc_id, d.n_chars, sha256(e.text) AS edited_sha256, lpad(lower(hex(a.fp)), 16, '0') AS fingerprint, lpad(lower(hex(c.fp)), 16, '0') AS edited_fingerprint,
       1 - bit_count(xor(a.fp, c.fp)) / 64.0 AS near_edited, 1 - bit_count(xor(a.fp, x.fp)) / 64.0 AS near_next, CAST(n_within AS BIGINT) AS n_within
FROM docs d JOIN edits e ON e.rank = d.rank JOIN fps a ON a.rank = d.rank AND a.kind = 0 JOIN fps c ON c.rank = d.rank AND c.kind = 1
JOIN fps x ON x.rank = (d.rank + 1) % d.n AND x.kind = 0 LEFT JOIN found f ON f.rank = d.rank
"""
