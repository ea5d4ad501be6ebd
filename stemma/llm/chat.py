"""Chat formatting by token-level assembly.

Rows of a conversation come in the order of turn. A turn is: the turn mark, the role, the text mark, the text, the
end mark. Segments are encoded separately, so no token spans two of them, and marks are reserved ids above the
vocabulary that no text can produce. The loss mask is the running sum of +1 where an assistant's text begins and -1
where it ends. So that the written form is as safe as the ids, control strings inside texts and roles get an escape
mark and a full stop after their first character, and escape marks are doubled; undoing that is exact.

A conversation is written as chunks of bounded size, and both passes stream over rows sorted by conversation and
turn, so that a conversation of any length never has to fit in memory.

Words of the tokenizer's own splitter are encoded once and remembered, if its file says that it splits as SPLITTER
does, and whole segments are encoded otherwise.

Edge cases: null texts and roles are empty; null turns come first, equal turns are ordered by role and text, and
repeated rows are turns of their own; rows of a null conversation form one conversation; texts of any length are
encoded as a whole is, since words are; an empty table gives an empty table; columns of any name may stand beside.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches, stage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "␛"
#: Strings that mark structure here or in other well-known templates.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_ESCAPING = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + f"|{ESCAPE}")
#: Ids after which a chunk is written, and words that a worker remembers.
CHUNK, REMEMBERED = 1 << 16, 1 << 17
#: How a byte-level tokenizer says that it splits texts, and the words that it then makes.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def escape(text: str) -> str:
    return _ESCAPING.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0]}{ESCAPE}.", text)


def unescape(text: str) -> str:
    """A doubled escape mark is one, and an escape mark with a full stop nothing."""
    return re.sub(f"{ESCAPE}(.)", lambda m: ESCAPE if m[1] == ESCAPE else "", text, flags=re.S)


class Assembler:
    """Ids of a byte-level tokenizer and, above its vocabulary, of the three marks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bare = Tokenizer(self.tokenizer.model)  # the same vocabulary in memory
        self.bare.encode_special_tokens = True
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        self.marks = {TURN: size, TEXT: size + 1, END: size + 2}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.letters = {b: c for c, b in back.items()}
        words = [b""] * (size + 3)
        for token, i in self.tokenizer.get_vocab().items():
            words[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for mark, i in self.marks.items():
            words[i] = mark.encode()
        self.words = words
        said = json.loads(self.tokenizer.to_str())
        self.by_word = said["normalizer"] is None and said["pre_tokenizer"] == SPLITTER and said["model"]["type"] == "BPE"
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _WORD.findall(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [w for w in dict.fromkeys(parts) if w not in known]
        if new:  # all in one call, as byte letters, which hold no white space
            e = self.bare.encode(" ".join([w.encode().decode("latin-1").translate(self.letters) for w in new]), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4").tobytes(), (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(new) + 1))).tolist()
            for i, w in enumerate(new):
                known[w] = ids[ends[i] : ends[i + 1]]
        return b"".join([known[w] for w in parts])


_assemblers: dict[str, Assembler] = {}


def assembler(path: str) -> Assembler:
    if path not in _assemblers:
        _assemblers[path] = Assembler(path)
    return _assemblers[path]


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(keys[0]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])


def format_chats(rows: DataFrame, tokenizer: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, chunk, ids, mask): ids as little-endian 32-bit, mask a byte for each, staged."""
    ship(rows.sparkSession)
    small_batches(rows.sparkSession)
    kind = rows.schema[conversation].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = assembler(tokenizer)
        turn_id, text_id, end_id = (a.marks[m].to_bytes(4, "little") for m in (TURN, TEXT, END))
        now, chunk, parts, edges, size, first = None, 0, [], [], 0, True

        def close() -> pa.RecordBatch:
            step = np.zeros(size + 1, np.int32)
            for s, e in edges:
                step[s] += 1
                step[e] -= 1
            mask = np.cumsum(step)[:size].astype(np.uint8)
            return pa.record_batch([pa.array([now], arrow_kind), pa.array([chunk], pa.int64()), pa.array([b"".join(parts)], pa.binary()), pa.array([mask.tobytes()], pa.binary())], names=["conv_id", "chunk", "ids", "mask"])

        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for conv, who, said in zip(*(batch[i].to_pylist() for i in range(3))):
                if first or conv != now:
                    if size:
                        yield close()
                    now, chunk, parts, edges, size, first = conv, 0, [], [], 0, False
                head, body = a.packed(escape(who or "")), a.packed(escape(said or ""))
                start = size + len(head) // 4 + 2
                size = start + len(body) // 4 + 1
                if who == learn and body:
                    edges.append((start, size - 1))
                parts += (turn_id, head, text_id, body, end_id)
                if size >= CHUNK:
                    yield close()
                    chunk, parts, edges, size = chunk + 1, [], [], 0
        if size:
            yield close()

    sorted_rows = in_order(rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")), "conv_id", "turn", "role", "text")
    return stage(sorted_rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, chunk long, ids binary, mask binary"), "chats")


def read_chats(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Reads the ids back: one row a conversation, with digests of its turns and of what the mask selects."""
    ship(formatted.sparkSession)
    small_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = assembler(tokenizer)
        marks = {v: k for k, v in a.marks.items()}
        low = min(marks)
        now, first = None, True
        turns = loss_chars = chars = 0
        told, loss, arrow_kind = hashlib.sha256(), hashlib.sha256(), None

        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], arrow_kind), *(pa.array([x]) for x in (turns, told.hexdigest(), loss_chars, loss.hexdigest(), chars))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for conv, ids, mask in zip(*(batch[i].to_pylist() for i in range(3))):
                if first or conv != now:
                    if not first:
                        yield close()
                    now, first, turns, loss_chars, chars = conv, False, 0, 0, 0
                    told, loss = hashlib.sha256(), hashlib.sha256()
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                at = np.flatnonzero(ids >= low)
                for s, e in zip(at.tolist(), [*at[1:].tolist(), len(ids)]):
                    written = b"".join([a.words[i] for i in ids[s + 1 : e].tolist()]).decode()
                    chars += len(marks[int(ids[s])]) + len(written)
                    plain = unescape(written)
                    if ids[s] == a.marks[TURN]:
                        turns += 1
                        told.update(plain.encode() + b"\n")
                    elif ids[s] == a.marks[TEXT]:
                        told.update(plain.encode() + b"\n")
                        if mask[s + 1 : e].any():
                            under = unescape(b"".join([a.words[i] for i in ids[s + 1 : e][mask[s + 1 : e] > 0].tolist()]).decode())
                            loss_chars += len(under)
                            loss.update(under.encode())
        if not first:
            yield close()

    chunks = in_order(formatted, "conv_id", "chunk").select("conv_id", "ids", "mask")
    return chunks.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
