"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are encoded once and staged compressed; ids are counted over all of them and ranked by frequency, so that
the commonest 256 take one byte. Files are written in ascending order of the document id. A file is a Parquet
container of binary blocks, since Spark's committer then makes writes safe against lost executors on any store; a
block holds whole documents: their ids and lengths, the control bytes (four 2-bit lengths in each), the data bytes
and a crc. Readers get the lengths of four values at a time from a table of the 256 control bytes.

Edge cases: a null or empty text is the end id alone; null ids come first; rows of one id are ordered by their
tokens' hash and length; ids of any type that orders are kept as they are; long texts become blocks of their own, and
memory is bounded by bytes of text and numbers of tokens, or by one document; an empty table gives no blocks; further
columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, ship, stage

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
#: Bytes of text that are encoded at once.
PIECE = 6 << 20
#: Pieces that a worker remembers; then it starts anew.
REMEMBERED = 900_000

#: Ids that are counted at once.
COUNTED = 1 << 22
#: What a tokenizer must say of itself for its texts to be cut into chunks here; others are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: What may end a chunk of letters and is a piece of its own.
_ENDS_TEXT = ",.!?;:)|#*$%&"
_ENDS = frozenset(bytes([b]) for b in _ENDS_TEXT.encode())

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values: 1 to 4 little-endian bytes each, lengths in control."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    wide = 4 if len(v) and v.max() > 0xFFFF else 2  # the bytes that can be in use
    data = v.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)[np.arange(wide) < size[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    quad = codes.reshape(-1, 4)
    return (quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values again: lengths by table lookup, then a gather of up to four bytes each."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    start = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        out |= np.where(size > k, raw[start + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


class WordEncoder:
    """Encodes texts as the tokenizer does, one white-space chunk at a time, remembering their pieces.

    Only a tokenizer whose file states NORMALIZER and SPLITTER drops white space and never merges across it; with any
    other, texts are encoded whole. Chunks of printable ASCII and Latin letters are lower-cased, split and mapped to
    byte letters here, and only their distinct pieces are encoded, many in one call; any other chunk, and any with a
    special token, goes to the whole tokenizer as it is written. A text with a combining mark is not lower-cased before
    its chunks are told apart: a small letter may compose with the mark where its capital does not.
    """

    simple = regex.compile(r"[\x21-\x7EÀ-ɏ]+")
    pieces = regex.compile(SPLITTER["pretokenizers"][0]["pattern"]["Regex"])

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        said = json.loads(self.whole.to_str())
        self.chunked = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == SPLITTER and said["model"]["type"] == "BPE"
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.marked = os.path.commonprefix(self.special).decode() or " "
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[bytes, bytes] = {}

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Remembers the pieces of chunks, as a piece is encoded alike wherever it stands, and gives the ids of chunks that are more than one remembered piece."""
        known, made, need, hard, mark = self.known, [], {}, [], self.marked.encode()
        for c in chunks:
            if c.isalpha():  # ASCII letters
                parts = (c.lower(),)
            elif c[-1:] in _ENDS and c[:-1].isalpha():
                parts = (c[:-1].lower(), c[-1:])
            else:
                text = c.decode()
                low, end = text.lower(), text[-1:]
                if low.isalpha() and max(text) <= "ɏ":
                    parts = (low.encode(),)
                elif end in _ENDS_TEXT and low[:-1].isalpha() and max(text) <= "ɏ":
                    parts = (low[:-1].encode(), c[-1:])
                elif self.simple.fullmatch(text) and not (mark in c and any(s in c for s in self.special)):
                    parts = [p.encode() for p in self.pieces.findall(low)]
                else:
                    hard.append(c)
                    continue
            if len(parts) > 1 or parts[0] != c:
                made.append((c, parts))
            for p in parts:
                if p not in known:
                    need[p] = None
        distinct, wide = list(need), np.dtype(self.kind).itemsize
        for at in range(0, len(distinct), 20_000):
            some = distinct[at : at + 20_000]
            e = self.bare.encode(" ".join([p.decode() if p.isalpha() else p.decode("latin-1").translate(self.letters) for p in some]), add_special_tokens=False)
            data = np.array(e.ids, self.kind).tobytes()
            ends = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1)) * wide).tolist()
            for i, p in enumerate(some):
                known[p] = data[ends[i] : ends[i + 1]]
        if hard:
            for c, e in zip(hard, self.whole.encode_batch([c.decode() for c in hard], add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, self.kind).tobytes()
        return {c: b"".join([known[p] for p in parts]) for c, parts in made}

    @staticmethod
    def has_marks(texts: pa.Array) -> pa.Array:
        """Which texts have a combining mark; only those beyond ASCII are searched."""
        out = np.invert(pc.string_is_ascii(texts).to_numpy(zero_copy_only=False))
        out[out] = pc.match_substring_regex(texts.filter(pa.array(out)), r"\pM").to_numpy(zero_copy_only=False)
        return pa.array(out)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each text has).

        Arrow cuts the texts into chunks and numbers the distinct ones; only these are looked up.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))  # a fresh array: ascii_lower misreads slices
        if not self.chunked:
            ids = [e.ids for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.array(x, self.kind) for x in ids] or [np.zeros(0, self.kind)]), np.array([len(x) for x in ids], np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[b""] = b""
        told = pc.or_(pc.match_substring(texts, self.marked), self.has_marks(texts))  # texts whose case counts
        words = pc.ascii_split_whitespace(pc.if_else(told, texts, pc.ascii_lower(texts)))
        coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        parts = list(map(known.get, distinct))
        new = [i for i, p in enumerate(parts) if p is None]
        made = self.learn([distinct[i] for i in new])
        for i in new:
            w = distinct[i]
            parts[i] = made[w] if w in made else known[w]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(self.kind).itemsize
        flat, codes = np.frombuffer(b"".join(parts), self.kind), coded.indices.to_numpy()
        n = size[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], n)
        at += np.arange(len(at))
        edges = words.offsets.to_numpy()
        return flat[at], np.diff(ends[edges - edges[0]])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes of self.kind."""
        ids, n = self.encode_column(pa.array([t.decode() for t in texts], pa.large_string()))
        ends = np.cumsum(n)
        return [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose rows' sizes add up to at most `most`, or of one row."""
    size = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(int(np.searchsorted(size, before + most, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most PIECE bytes of text, or one row."""
    return slices(batch, pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), PIECE)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, tie, ids): ids is zstandard-compressed and includes the end id; tie orders rows of one key."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, 1):
                flat, n = enc.encode_column(part[1])
                ends = np.cumsum(n + 1)
                flat = np.insert(flat, np.cumsum(n), end_id)
                ids = [flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), (n + 1).tolist())]
                yield pa.record_batch([part[0], pa.array(n + 1), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([squeeze.compress(x) for x in ids], pa.binary())], names=[key, "n", "tie", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return stage(docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, tie long, ids binary"), "token-ids")


def raw_ids(blob: bytes, n: int, expand: zstandard.ZstdDecompressor | None = None) -> np.ndarray:
    data = (expand or zstandard.ZstdDecompressor()).decompress(blob, max_output_size=4 * n)
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32)


def rank_table(encoded: DataFrame, size: int) -> np.ndarray:
    """Ids by falling frequency in all documents, then by id. Its size is the vocabulary's, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, expand = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, batch[1].to_numpy(), COUNTED):
                ids = [raw_ids(blob, n, expand) for blob, n in zip(part[0].to_pylist(), part[1].to_pylist())]
                total += np.bincount(np.concatenate(ids), minlength=size)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    counts = encoded.select("ids", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    freq = np.zeros(size, np.int64)
    freq[counts["id"].to_numpy()] = counts["n"].to_numpy()
    return np.lexsort((np.arange(size), -freq))


BLOCK = "part int, block int, keys array<{kind}>, lengths binary, n_ids long, control binary, data binary, crc long"


def write_token_files(encoded: DataFrame, ranked: np.ndarray, path: str, key: str = "doc_id", parts: int | None = None) -> None:
    """Writes blocks in ascending order of key; parts are ranges of it."""
    spark = encoded.sparkSession
    rank = np.zeros(len(ranked), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # one number for each id of the vocabulary
    parts = parts or max(1, encoded.rdd.getNumPartitions())
    kind = encoded.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0
        expand = zstandard.ZstdDecompressor()

        def close(arrow_kind: pa.DataType) -> pa.RecordBatch:
            flat = shared.value[np.concatenate(ids)]
            control, data = pack(flat)
            row = {"part": part, "block": block, "keys": keys, "lengths": np.array([len(x) for x in ids], "<i8").tobytes(), "n_ids": len(flat), "control": control, "data": data, "crc": zlib.crc32(data, zlib.crc32(control))}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.list_(arrow_kind)), ("lengths", pa.binary()), ("n_ids", pa.int64()), ("control", pa.binary()), ("data", pa.binary()), ("crc", pa.int64())]))

        for batch in batches:
            for k, n, blob in zip(*(batch[i].to_pylist() for i in range(3))):
                keys.append(k)
                ids.append(raw_ids(blob, n, expand))
                size += n
                if size >= BLOCK_IDS:
                    yield close(batch.schema.field(0).type)
                    keys, ids, size, block = [], [], 0, block + 1
        if keys:
            yield close(batch.schema.field(0).type)

    order = [F.col(key).asc_nulls_first(), F.col("tie"), F.col("n")]
    sorted_rows = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(key, "n", "ids")
    sorted_rows.mapInArrow(write, BLOCK.format(kind=kind)).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ranked)], "rank int, id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document, from the files alone. ids: little-endian 32-bit, or null."""
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    ranks = spark.read.parquet(f"{path}/ranks").toArrow()
    table = np.zeros(ranks.num_rows, np.uint32)
    table[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    shared = spark.sparkContext.broadcast(table)  # one number for each id of the vocabulary

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["data"], zlib.crc32(row["control"])) != row["crc"]:
                    raise ValueError(f"block {row['part']}/{row['block']} is damaged")
                ids = shared.value[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                size = np.frombuffer(row["lengths"], "<i8")
                start = np.cumsum(size) - size
                keys = row["keys"]
                own = [ids[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]
                m = len(keys)
                yield pa.record_batch([pa.array(keys, batch.schema.field("keys").type.value_type), pa.array(np.full(m, row["part"], np.int32)), pa.array(np.full(m, row["block"], np.int32)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own if with_ids else [None] * m, pa.binary())], names=["key", "part", "block", "at", "n_tokens", "ids_crc32", "ids"])

    rows = blocks.mapInArrow(decode, f"key {kind}, part int, block int, at long, n_tokens long, ids_crc32 long, ids binary")
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_start"))  # one row a part
    starts = sizes.join(F.broadcast(parts), "part").withColumn("_start", F.col("_part_start") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).select("part", "block", "_start")
    return rows.join(starts, ["part", "block"]).select("key", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encodes, writes files below path (the shared folder by default) and reads them back: one row a document."""
    import uuid

    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/stemma/token-files-{uuid.uuid4().hex}"
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    encoded = encode_documents(docs, tokenizer, end_id, key, text)
    write_token_files(encoded, rank_table(encoded, size), path, key)
    return read_token_files(spark, path, with_ids=False).drop("ids").withColumnRenamed("key", key)
