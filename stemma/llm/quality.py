"""Quality rules with line labels from a linear-chain conditional random field.

Each line of a text is described by a few yes/no features; a two-state chain (content, boilerplate) trained by
maximum likelihood is decoded by Viterbi, and the share of word characters in content lines decides retention. Plain
counting rules over the words come first.

Training uses at most `sample` labelled documents, chosen by a hash of the id, and of these the ones of at most `longest`
characters and `lines` lines (the bound of what the driver holds), each text whole. A line of a document of
quality 0 counts as boilerplate, and so does one that is empty of words or repeats an earlier line; other lines of
documents of quality 1 count as content.

Edge cases: a null or empty text has no words and fails the base rules; without usable labels the built-in weights
hold; of several labels of an id the worst counts, of several texts the one with the least hash; repeated documents
are judged alike; long texts are read whole; an empty table gives an empty table; columns of any name may stand beside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, small_batches, text_bytes

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MORE = bytes(range(128, 192))  # continuation bytes
_CUES = (b"licen", b"rights reserved", b"copyright", b"cookie", b"subscribe", b"click here")
_ENDS = b".!?:;\"')"
FEATURES = ("few words", "no sentence end", "many symbols", "many capitals", "many digits", "repeats a line", "has bars", "cue word", "long words", "shouts", "first", "last")
#: Rounds and step of training.
ROUNDS, STEP, PENALTY = 120, 0.25, 0.02


@dataclass
class Chain:
    """weights[f]: log odds of content that feature f adds; bias; change: log weight of a change of label."""

    weights: np.ndarray
    bias: float
    change: float

    def odds(self) -> np.ndarray:
        """Log odds by feature code."""
        codes = np.arange(1 << len(FEATURES))
        return (codes[:, None] >> np.arange(len(FEATURES)) & 1) @ self.weights + self.bias


#: What holds without labels: signs as the features' names suggest.
DEFAULT = Chain(np.array([-0.3, -0.3, -3.0, -2.0, -1.5, -2.5, -1.0, -3.0, -0.5, -2.0, 0.0, 0.0]), 2.0, -1.0)


def line_code(line: bytes, seen: bool, first: bool, last: bool) -> tuple[int, int]:
    """(feature code, word characters) of a line."""
    words = line.split()
    chars = len(line.translate(None, _SPACES + _MORE))
    n = len(words)
    if not n:
        return 0b11 | (seen << 5) | (first << 10) | (last << 11), 0
    low = line.lower()
    solid = sum(map(len, words))
    code = (
        (n < 4)
        | (words[-1][-1] not in _ENDS) << 1
        | (20 * (len(line) - len(line.translate(None, SYMBOLS))) > solid) << 2
        | (10 * (len(line) - len(line.translate(None, _UPPER))) > 3 * solid) << 3
        | (5 * (len(line) - len(line.translate(None, _DIGITS))) > solid) << 4
        | seen << 5
        | (b"|" in line) << 6
        | any(c in low for c in _CUES) << 7
        | (solid > 9 * n) << 8
        | (20 * line.count(b"!") > solid) << 9
        | first << 10
        | last << 11
    )
    return code, chars


def describe(text: bytes) -> tuple[list[int], list[int], int]:
    """Feature code and word characters of each line, and the number of lines with a word that repeat an earlier one."""
    lines = text.split(b"\n")
    codes, chars, seen, repeated = [], [], set(), 0
    for i, line in enumerate(lines):
        again = line in seen
        seen.add(line)
        code, n = line_code(line, again, not i, i == len(lines) - 1)
        repeated += again and n > 0
        codes.append(code)
        chars.append(n)
    return codes, chars, repeated


def viterbi(odds: list[float], change: float) -> list[bool]:
    """The likeliest labels (True: content) of a chain whose content states score odds and whose changes score change."""
    back, a, b = [], 0.0, 0.0
    for i, x in enumerate(odds):
        if i:
            from_b, from_a = b + change > a, a + change > b
            a, b = max(a, b + change), max(b, a + change)
            back.append((from_b, from_a))
        a += x
    out = [a >= b]
    for from_b, from_a in reversed(back):
        out.append((not from_b) if out[-1] else from_a)
    return out[::-1]


def train(docs: list[tuple[list[int], list[bool]]]) -> Chain:
    """Maximum likelihood by gradient ascent with forward-backward over documents side by side."""
    if not docs or len({y for _, ys in docs for y in ys}) < 2:
        return DEFAULT
    size = np.array([len(c) for c, _ in docs])
    rows, longest, k = len(docs), int(size.max()), len(FEATURES)
    x = np.zeros((rows, longest, k + 1))
    y = np.zeros((rows, longest))
    for i, (codes, labels) in enumerate(docs):
        x[i, : len(codes), :k] = np.array(codes)[:, None] >> np.arange(k) & 1
        x[i, : len(codes), k] = 1
        y[i, : len(codes)] = labels
    real = np.arange(longest) < size[:, None]
    weight = real / size[:, None]  # each document counts once
    both = real[:, 1:] & real[:, :-1]
    pair_weight = both / size[:, None]
    w, change = np.zeros(k + 1), 0.0
    for _ in range(ROUNDS):
        s = np.clip(x @ w, -30, 30)
        up = np.exp(s)
        t = np.exp(change)
        forward, backward = np.zeros((rows, longest, 2)), np.ones((rows, longest, 2))
        a, b = up[:, 0], np.ones(rows)
        for j in range(longest):
            if j:
                a, b = (a + t * b) * up[:, j], b + t * a
            total = a + b
            a, b = a / total, b / total
            forward[:, j, 0], forward[:, j, 1] = a, b
        for j in range(longest - 2, -1, -1):
            a, b = backward[:, j + 1, 0] * up[:, j + 1], backward[:, j + 1, 1]
            a, b = a + t * b, b + t * a
            total = a + b
            backward[:, j] = np.where(both[:, j, None], np.column_stack([a / total, b / total]), 1.0)
        p = forward * backward
        p = p[..., 0] / p.sum(-1)
        right = np.stack([backward[:, 1:, 0] * up[:, 1:], backward[:, 1:, 1]], -1)
        left = forward[:, :-1]
        same = left[..., 0] * right[..., 0] + left[..., 1] * right[..., 1]
        diff = t * (left[..., 0] * right[..., 1] + left[..., 1] * right[..., 0])
        changes = diff / (same + diff)
        g = np.einsum("ij,ijk->k", (y - p) * weight, x) / rows - PENALTY * w / k
        gc = (((y[:, 1:] != y[:, :-1]) - changes) * pair_weight).sum() / rows - PENALTY * change / k
        w, change = w + STEP * k * g, float(np.clip(change + STEP * k * gc, -2.5, 0))
    return Chain(w[:k], float(w[k]), change)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = 1500, longest: int = 20_000, lines: int = 400) -> Chain:
    """Trains on at most `sample` labelled documents of at most `longest` characters and `lines` lines."""
    told = labels.filter(F.col(key).isNotNull() & F.col(quality).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(quality).alias("q"))
    chosen = told.orderBy(F.xxhash64("k"), "k").limit(sample)
    able = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").filter((F.length("t") <= longest) & (F.regexp_count("t", F.lit("\n")) < lines))
    rows = able.groupBy("k", "q").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x")).collect()  # at most `sample`
    out = []
    for r in sorted(rows, key=lambda r: (r.x.h, r.k)):
        codes, chars, _ = describe(text_bytes(r.x.t))
        out.append((codes, [bool(r.q) and n > 0 and not c >> 5 & 1 for c, n in zip(codes, chars)]))
    return train(out)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    at: dict[bytes, int] = {}
    ids = np.array([at.setdefault(w, len(at)) for w in words], np.int64)
    if len(at) == len(words):
        return 0
    if len(at) < 1 << 12 and width == 5:
        code = ids[:n] << 48 | ids[1 : n + 1] << 36 | ids[2 : n + 2] << 24 | ids[3 : n + 3] << 12 | ids[4 : n + 4]
    else:
        code = ids[:n]
        for k in range(1, width):
            code = np.unique(code, return_inverse=True)[1] * len(at) + ids[k : n + k]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge) > 0).sum())


VERDICT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("n_content_lines", T.LongType())])


def judge(text: bytes, odds: list[float], change: float, least: float) -> tuple:
    words = text.split()
    codes, chars, dup = describe(text)
    labels = viterbi([odds[c] for c in codes], change)
    total = sum(chars)
    content = sum(c for c, good in zip(chars, labels) if good)
    share = content / total if total else 0.0
    again = repeated_words(words)
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    return len(words), total, len(text) - len(text.translate(None, SYMBOLS)), dup, again, failed, not failed and share >= least, round(share, 6), sum(g and c > 0 for g, c in zip(labels, chars))


def judge_lines(docs: DataFrame, chain: Chain, text: str = "text", least: float = 0.5) -> tuple[DataFrame, str]:
    """docs with one struct column more, VERDICT, whose name is returned."""
    ship(docs.sparkSession)
    name = fresh(docs, "verdict")
    position = docs.columns.index(text)
    odds, change = chain.odds().tolist(), chain.change

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [judge(text_bytes(x), odds, change, least) for x in part[position].to_pylist()]
                columns = [pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.bool_() if f.dataType == T.BooleanType() else pa.float64()) for c, f in zip(zip(*rows), VERDICT.fields)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(columns, VERDICT.names)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, VERDICT)])), name


def report(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    rows, v = judge_lines(docs.select(key, text), chain, text, least)
    return rows.select(key, f"{v}.*")


def keep_good(docs: DataFrame, chain: Chain, text: str = "text", least: float = 0.5) -> DataFrame:
    small_batches(docs.sparkSession)
    rows, v = judge_lines(docs, chain, text, least)
    return rows.filter(F.col(v)["kept"]).select(*docs.columns)
