"""Token ids as length-delimited binary records with a separate offset index.

A shard file is a run of records. Each is framed as

    u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

(little endian; mask(c) = rotate right by 15, plus 0xA282EAD8). The payload is a
flag byte (bit 0: the id is null; bit 1: ids take four bytes instead of two;
bit 2: the ids are deflated), the document id as i64, and the token ids. Beside
each shard lies its index, ``.idx``: for every record a u64 offset and a u32
token count, so that a shuffled reader seeks straight to any record.

Rows are range-partitioned and sorted by (id, text hash): shards in name order
hold ascending ids. Each task streams its shards to a temporary name and then
renames them; a repeated attempt writes the same bytes, so a lost executor
costs its tasks only. Shards roll over at ``shard_bytes``.

Null texts are empty texts; an empty text gives the end id alone. Null ids come
first. Repeated rows are written as often as they occur. An empty table writes
no shard and gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabulon.llm.common import materialise, new_path

INDEX = np.dtype([("offset", "<u8"), ("n_tokens", "<u4")])
#: Most tasks that read shards back.
READERS = 10_000
#: Words of either generation of the cache; characters that are split at once.
_WORDS_KEPT, _CHUNK = 150_000, 1 << 20
#: Letters from U+0300 on, where combining marks begin, and the opening of special tokens.
_KEEP_CASE = r"[\x{300}-\x{10ffff}]|<[|]"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Stands between words that are encoded together.
_MARK = "\x01"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frames(stream, offset: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record from ``offset`` on; raises on a wrong checksum or a torn record."""
    stream.seek(offset)
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError(f"damaged record length at {offset}")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError(f"damaged record at {offset}")
        yield offset, body[:size]
        offset += 16 + size


def pack(doc_id: int | None, ids: bytes, wide: bool, deflate: bool) -> bytes:
    """Payload of a record; ``ids`` are little-endian u32 if wide, else u16."""
    body = zlib.compress(ids, 1) if deflate else ids
    return struct.pack("<Bq", (doc_id is None) | wide << 1 | deflate << 2, doc_id or 0) + body


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    body = zlib.decompress(payload[9:]) if flags & 4 else payload[9:]
    return None if flags & 1 else doc_id, np.frombuffer(body, "<u4" if flags & 2 else "<u2")


class WordEncoder:
    """Ids of texts by a tokenizer whose normaliser drops white space.

    Such a tokenizer never joins across ASCII white space, so each distinct
    word is encoded once and its ids are reused. Where the normaliser also
    lowers case, words that differ in the case of A-Z only share an entry; texts
    with marks that may combine with a letter, or with an opening of a special
    token, are left as they are. Where the tokenizer always parts letters from
    the punctuation behind them, both are looked up by themselves. New words
    are encoded many at once with a mark between them. The cache has two
    generations of bounded size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.steady = self.tokenizer.normalizer.normalize_str(letters) == letters
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.tails = self._tails()
        mark = [t.encode(_MARK, add_special_tokens=False).ids for t in (self.tokenizer, self.plain)]
        self.mark = mark[0][0] if len(mark[0]) == 1 and mark[0] == mark[1] else None
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _tails(self) -> bytes:
        """Punctuation that is parted from letters before it, alone or behind another such character."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        some = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
        parted = [c for c in some if [at for _, at in cut(f"ab{c}")] == [(0, 2), (2, 3)]]
        whole = all([at for _, at in cut(f"ab{c}{d}")] == [(0, 2), (2, 4)] for c in parted for d in parted)
        return "".join(parted).encode() if whole else b""

    def _letters(self, word: bytes) -> bool:
        """Whether this is Latin letters only, once normalised too."""
        text = word.decode()
        return text.isalpha() and max(text) < "\u0250" and self.tokenizer.normalizer.normalize_str(text).isalpha()

    def _run(self, tokenizer, words: list[bytes]) -> Iterator[bytes]:
        """Ids of each word, 200 at a time where the mark can part them."""
        size = 1 if self.mark is None else 200
        for at in range(0, len(words), 100 * size):
            groups = [words[i : i + size] for i in range(at, min(at + 100 * size, len(words)), size)]
            joined = [f" {_MARK} ".encode().join(g).decode() for g in groups]
            for group, made in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(made.ids, self.kind)
                cuts = np.flatnonzero(ids == self.mark) if size > 1 else np.array([], np.int64)
                if len(cuts) != len(group) - 1:
                    raise ValueError("the tokenizer does not keep words apart")
                data, width = ids.tobytes(), ids.itemsize
                starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(data)]
                yield from (data[a:b] for a, b in zip(starts, ends))

    def _learn(self, words: list[bytes]) -> None:
        if len(self.young) > _WORDS_KEPT:
            self.old, self.young = self.young, {b"": b""}
        known, old, tails, parted, rest = self.young, self.old, self.tails, [], {}
        for w in words:
            if w in old:
                known[w] = old[w]
                continue
            core = w.rstrip(tails)
            if len(core) < len(w) and (core.isalpha() or self._letters(core)):
                tail = w[len(core) :]
                parted.append((w, core, tail))
                rest[core] = rest[tail] = None
            else:
                rest[w] = None
        rest = [w for w in rest if w not in known]
        known.update((w, old[w]) for w in rest if w in old)
        rest = [w for w in rest if w not in known]
        plain = [w for w in rest if self.steady and w.isalpha() and w.islower()]
        marked = [w for w in rest if _MARK.encode() in w]
        for w in marked:
            known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        known.update(zip(plain, self._run(self.plain, plain)))
        other = [w for w in rest if w not in known]
        known.update(zip(other, self._run(self.tokenizer, other)))
        for w, core, tail in parted:
            known[w] = known[core] + known[tail]

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, laid end to end, and where each text's begin and end."""
        if self.lowers:
            kept = pc.match_substring_regex(texts, _KEEP_CASE)
            texts = pc.if_else(kept, texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        names = _bytes(coded.dictionary)
        new = [w for w in names if w not in self.young]
        if new:
            self._learn(new)
        parts = [*map(self.young.get, names)]
        if None in parts:  # the generations have just changed
            self._learn([w for w, p in zip(names, parts) if p is None])
            parts = [self.young[w] for w in names]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(self.kind).itemsize
        held, codes = np.frombuffer(b"".join(parts), self.kind), coded.indices.to_numpy()
        count = size[codes]
        end = np.append(0, np.cumsum(count))
        ids = held[np.arange(end[-1]) + np.repeat((np.cumsum(size) - size)[codes] - end[:-1], count)]
        return ids, end[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian; null is empty."""
        return [*self.stream(pa.array(texts, "large_string"))]

    def stream(self, texts: pa.Array) -> Iterator[bytes]:
        """The same for a column of texts, chunk by chunk."""
        texts = pc.fill_null(texts.cast("large_string"), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            some = max(1, int(np.searchsorted(np.cumsum(size[at : at + 20_000]), _CHUNK, "right")))
            if size[at] > _CHUNK:
                pieces = (self._chunk(pa.array([p], "large_string"))[0].tobytes() for p in _pieces(texts[at].as_py()))
                yield b"".join(pieces)
            else:
                ids, cuts = self._chunk(texts[at : at + some])
                yield from (ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            at += some


def _bytes(words: pa.Array) -> list[bytes]:
    """Of a string array without nulls; faster than through Python strings."""
    _, ends, data = words.cast("large_binary").buffers()
    at = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    held = data.to_pybytes() if data else b""
    return [held[a:b] for a, b in zip(at, at[1:])]


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end before white space."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + _CHUNK)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class _Shard:
    def __init__(self, fs, folder: str, name: str):
        self.fs, self.folder, self.name, self.size, self.entries = fs, folder, name, 0, []
        self.tmp = f"{folder}/_tmp-{name}-{TaskContext.get().taskAttemptId()}"
        self.stream = fs.open_output_stream(self.tmp)

    def add(self, payload: bytes, n_tokens: int) -> None:
        self.entries.append((self.size, n_tokens))
        data = frame(payload)
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> dict:
        self.stream.close()
        index = np.array(self.entries, dtype=INDEX)
        with self.fs.open_output_stream(f"{self.tmp}.idx") as f:
            f.write(index.tobytes())
        self.fs.move(f"{self.tmp}.idx", f"{self.folder}/{self.name}.idx")
        self.fs.move(self.tmp, f"{self.folder}/{self.name}.rec")
        return {"shard": self.name, "n_docs": len(index), "n_tokens": int(index["n_tokens"].sum()), "n_bytes": self.size}


def _write(batches: Iterator[pa.RecordBatch], uri: str, tokenizer: str, end_id: int, shard_bytes: int, deflate: bool) -> Iterator[pa.RecordBatch]:
    fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    enc, shard, roll, done = encoder(tokenizer), None, 0, []
    end = np.array([end_id], dtype=enc.kind).tobytes()
    part = TaskContext.get().partitionId()
    for batch in batches:
        ids, absent = batch.column("id").to_pylist(), batch.column("absent").to_pylist()
        for i, body in enumerate(enc.stream(batch.column("text"))):
            if shard is None:
                shard = _Shard(fs, folder, f"{part:08d}-{roll:04d}")
            body += end
            shard.add(pack(None if absent[i] else ids[i], body, enc.wide, deflate), len(body) // len(end))
            if shard.size >= shard_bytes:
                done.append(shard.close())
                shard, roll = None, roll + 1
    if shard is not None:
        done.append(shard.close())
    if done:
        yield pa.RecordBatch.from_pylist(done)


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20, deflate: bool = False) -> DataFrame:
    """Write the token ids of ``docs`` under ``uri``; returns the manifest (shard, n_docs, n_tokens, n_bytes, start).

    ``start`` is the number of ids before the shard. The manifest has one row a shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("absent"), text.alias("text"))
    order = [F.col("absent").desc(), F.col("id"), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    made = sorted_rows.mapInArrow(lambda b: _write(b, uri, tokenizer, end_id, shard_bytes, deflate), "shard string, n_docs long, n_tokens long, n_bytes long")
    made = materialise(made, "record-shards")
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return made.withColumn("start", F.coalesce(before, F.lit(0)))


def _read(batches: Iterator[pd.DataFrame], uri: str) -> Iterator[pd.DataFrame]:
    fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
    for batch in batches:
        for shard, start in zip(batch["shard"], batch["start"].tolist()):
            rows = []
            with fs.open_input_stream(f"{folder}/{shard}.idx") as f:
                offsets = np.frombuffer(f.read(), INDEX)["offset"]
            with fs.open_input_file(f"{folder}/{shard}.rec") as f:
                for at, (offset, payload) in enumerate(read_frames(f)):
                    if offset != offsets[at]:
                        raise ValueError(f"{shard}: record {at} lies at {offset}, its index says {offsets[at]}")
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
            if len(rows) != len(offsets):
                raise ValueError(f"{shard}: {len(rows)} records, {len(offsets)} in its index")
            out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})


def read_digests(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files; all checksums and the index are checked."""
    shards = manifest.select("shard", "start")
    # an explicit number, which adaptive execution leaves as it is: a shard a task
    shards = shards.repartition(max(1, min(manifest.count(), READERS)))
    return shards.mapInPandas(lambda b: _read(b, uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(uri: str, shard: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the index: what a shuffled reader does."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{folder}/{shard}.idx") as f:
        f.seek(record * INDEX.itemsize)
        offset = int(np.frombuffer(f.read(INDEX.itemsize), INDEX)["offset"][0])
    with fs.open_input_file(f"{folder}/{shard}.rec") as f:
        return unpack(next(read_frames(f, offset))[1])


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write, then read back: the digests of all documents."""
    spark = docs.sparkSession
    uri = uri or new_path(spark, "records")
    return read_digests(spark, write(docs, uri, tokenizer, end_id, id_col, text_col, **options), uri)
