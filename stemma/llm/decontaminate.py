"""Benchmark decontamination with suffix arrays over the training words.

A shard is a run of documents that one task has in memory. Its words become ids of the benchmark's vocabulary, 0
being any other word, at which a suffix ends. Its suffix array is sorted by prefix doubling to the depth of the longest
test item; suffixes too short for any window are left out first. Every test suffix that begins a window is
binary-searched in it, word by word, and its range gives all places of the window; from there the words that go on are
searched in the array of the test suffixes, which gives the longest verbatim matches and their locations. Windows that
several items share are searched once.

The benchmark is taken in blocks of bounded size, one after the other; with more than one, documents are staged in
between, so that a driver or executor holds one block at a time.

Edge cases: null and empty texts have no words and no windows; an item of fewer than 13 words is one window; items of
one id count once; repeated documents are judged each; a text longer than a shard is a shard of its own; of several
longest matches the first place counts; a table may have columns of any name beside; an empty table on either side
gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, stage, text_bytes

WINDOW = 13
#: Bytes of benchmark text in a block, and of training text in a shard.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20

#: Digits, letters and everything beyond ASCII make words; A-Z become a-z.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def ranks(rank: np.ndarray, step: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new ranks) of positions by their rank and other's rank `step` further on."""
    after = np.zeros(len(rank), np.int64)
    after[: len(rank) - step] = other[step:]
    key = rank * (int(other.max(initial=0)) + 1) + after
    order = np.argsort(key, kind="stable")
    out = np.empty(len(rank), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
    return order, out


def suffix_array(flat: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` words or more, by prefix doubling."""
    order, rank, h = np.argsort(flat, kind="stable"), flat, 1
    while h < depth and len(flat) > 1:
        order, rank = ranks(rank, h, rank) if h < len(flat) else (order, rank)
        h *= 2
        if rank.max() == len(flat) - 1:
            break
    return order


def narrowed(text: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, depth, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges [low, high) of a suffix array whose suffixes have `want` as word number `depth`, by binary search."""
    out = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                break
            mid = (a[live] + b[live]) >> 1
            seen = text[array[mid] + (depth if np.isscalar(depth) else depth[live])]
            up = seen <= want[live] if right else seen < want[live]
            a[live[up]] = mid[up] + 1
            b[live[~up]] = mid[~up]
        out.append(a)
    return out[0], out[1]


class Suffixes:
    """The test suffixes of one block: its items' words, their suffix array, and the distinct windows with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        split = [(at[name], [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]) for name, text in items]
        long, short = [(i, w) for i, w in split if len(w) >= window], [(i, w) for i, w in split if 0 < len(w) < window]
        flat, owner, offset = [], [], []
        for i, w in long + short:
            flat += [*w, 0]
            owner += [i] * (len(w) + 1)
            offset += range(len(w) + 1)
        self.text = np.array(flat + [0] * window, np.int64)
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        n = sum(len(w) + 1 for _, w in long)  # words of items that are long enough, with their ends
        self.depth = max([len(w) for _, w in long] + [len(w) for _, w in short], default=0)
        self.least = min([len(w) for _, w in short] + [window] * bool(long), default=0)
        self.array = suffix_array(self.text[:n], max(self.depth, window)) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(self.text[:n] == 0)
        room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)
        # Windows of long items are runs of equal beginnings in the suffix array.
        fit = np.flatnonzero(room[self.array] >= window) if n else np.zeros(0, np.int64)
        first = self.array[fit]
        grid = self.text[first[:, None] + np.arange(window)]
        new = np.r_[True, (grid[1:] != grid[:-1]).any(1)] if len(fit) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        self.start, self.size = first[new], np.full(int(new.sum()), window)
        self.low = fit[new]
        self.high = fit[np.r_[np.flatnonzero(new)[1:], len(fit)] - 1] + 1 if len(fit) else np.zeros(0, np.int64)
        holders: list[set[int]] = [set() for _ in range(len(self.start))]
        for k, i in zip(number.tolist(), self.owner[first].tolist()):
            holders[k].add(i)
        brief: dict[tuple[int, ...], int] = {}
        begin, p = [], n
        for i, w in short:
            k = brief.setdefault(tuple(w), len(holders))
            if k == len(holders):
                holders.append(set())
                begin.append((p, len(w)))
            holders[k].add(i)
            p += len(w) + 1
        if begin:
            self.start = np.concatenate([self.start, [b for b, _ in begin]]).astype(np.int64)
            self.size = np.concatenate([self.size, [k for _, k in begin]]).astype(np.int64)
        known: dict[frozenset[int], int] = {}
        self.set_of = np.array([known.setdefault(frozenset(h), len(known)) for h in holders], np.int64)
        self.sets = list(known)


def places(text: np.ndarray, array: np.ndarray, test: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every place of a window, by binary search of the test suffixes that begin one."""
    ordered = text[array]
    which = np.arange(len(test.start))
    word = test.text[test.start]
    low, high = np.searchsorted(ordered, word, "left"), np.searchsorted(ordered, word, "right")
    found = []
    for d in range(1, test.window + 1):
        live = high > low
        which, low, high = which[live], low[live], high[live]
        done = test.size[which] == d
        found.append((which[done], low[done], high[done]))
        which, low, high = which[~done], low[~done], high[~done]
        if not len(which):
            break
        low, high = narrowed(text, array, low, high, d, test.text[test.start[which] + d])
    which, low, high = (np.concatenate(x) for x in zip(*found))
    n = high - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(which, n), array[at]


def longest(text: np.ndarray, window: np.ndarray, place: np.ndarray, test: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(words, test position) of the longest match of the suffix at each place of a window of full size."""
    low, high = test.low[window], test.high[window]
    size, live, d = np.full(len(place), test.window), np.arange(len(place)), test.window
    at = test.array[low]
    while len(live):
        word = text[place[live] + d]
        live, word = live[word > 0], word[word > 0]
        a, b = narrowed(test.text, test.array, low[live], high[live], d, word)
        more = b > a
        live = live[more]
        low[live], high[live] = a[more], b[more]
        at[live] = test.array[low[live]]
        d += 1
        size[live] = d
    return size, at


def search(shard: list[bytes], test: Suffixes) -> list[tuple[int, list[tuple[int, int]], set[int], list[tuple[int, int, int, int]]]]:
    """For each text: number of words, hit spans (word positions, merged), items, matches (item, item word, text word, words).

    Matches are the longest at their place, each with one of the items that hold it.
    """
    get, ids, counts = test.vocabulary.get, [], []
    for text in shard:
        w = words(text)
        counts.append(len(w))
        ids.extend(map(get, w, repeat(0)))
        ids.append(0)
    out = [(n, [], set(), []) for n in counts]
    if not test.least:
        return out
    flat = np.array(ids, np.int64)
    zero = np.flatnonzero(flat == 0)
    run = np.diff(zero, prepend=-1) - 1  # known words before each other one
    kept = np.repeat(run >= test.least, run + 1)  # whole runs, each with its end
    origin = np.flatnonzero(kept)
    if not len(origin):
        return out
    text = np.concatenate([flat[origin], np.zeros(max(test.depth, test.window) + 1, np.int64)])
    array = suffix_array(text[: len(origin)], max(test.depth, test.window))
    window, place = places(text, array, test)
    if not len(place):
        return out
    size = test.size[window]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size, -1)
    hit = np.cumsum(edge)[: len(origin)] > 0
    starts = np.cumsum([0] + [n + 1 for n in counts])
    turn = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    for s, e in zip(origin[turn[::2]].tolist(), origin[turn[1::2] - 1].tolist()):
        d = int(np.searchsorted(starts, s, "right")) - 1
        out[d][1].append((s - int(starts[d]), e + 1 - int(starts[d])))
    doc = np.searchsorted(starts, origin[place], "right") - 1
    for d, k in np.unique(np.column_stack([doc, test.set_of[window]]), axis=0).tolist():
        out[d][2].update(test.sets[k])
    full = size == test.window
    full &= window < len(test.low)
    at = test.start[window]
    size[full], at[full] = longest(text, window[full], place[full], test)
    order = np.lexsort((-size, place))
    place, size, at, doc = place[order], size[order], at[order], doc[order]
    one = np.r_[True, place[1:] != place[:-1]]  # the longest at a place
    place, size, at, doc = place[one], size[one], at[one], doc[one]
    head = np.r_[True, (place[1:] != place[:-1] + 1) | (size[1:] >= size[:-1])]  # others are the rests of the match before
    for d, p, n, q in zip(doc[head].tolist(), origin[place[head]].tolist(), size[head].tolist(), at[head].tolist()):
        out[d][3].append((int(test.owner[q]), int(test.offset[q]), p - int(starts[d]), n))
    return out


def shards(texts: list[bytes], size: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def test_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Suffixes]:
    """The benchmark in blocks of about BLOCK_BYTES, one after the other; one without items if there are none."""
    rows = benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("k"), F.lit(n))
    for i in range(n):
        yield Suffixes(sorted((r.k, r.t.encode()) for r in rows.filter(block == i).toLocalIterator()))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, str]:
    """docs with one struct column more, whose name is returned: n_words, n_hit, spans, items, matches, contaminated."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    name = fresh(docs, "contamination")
    match = T.StructType([T.StructField("item_id", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("item_word", "word", "words")])
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")])
    found = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(match)), T.StructField("contaminated", T.BooleanType())]
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(name, found)])
    position, width = docs.columns.index(text), len(docs.columns)
    arrow_type = to_arrow_type(found)
    empty = {"spans": [], "items": [], "matches": []}

    def with_block(df: DataFrame, test: Suffixes) -> DataFrame:
        shared = spark.sparkContext.broadcast(test)  # of about BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for batch in batches:
                texts = [text_bytes(x) for x in batch[position].to_pylist()]
                before = batch[width].to_pylist() if batch.num_columns > width else [empty] * len(texts)
                for a, b in shards(texts):
                    rows = []
                    for old, (n, spans, items, matches) in zip(before[a:b], search(texts[a:b], test), strict=True):
                        spans = merged([(s["start"], s["end"]) for s in old["spans"]] + spans)
                        hit = sum(e - s for s, e in spans)
                        more = [{"item_id": test.names[i], "item_word": q, "word": p, "words": k} for i, q, p, k in matches]
                        rows.append({"n_words": n, "n_hit": hit, "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted({*old["items"], *(test.names[i] for i in items)}), "matches": [*old["matches"], *more], "contaminated": hit > 0 and 20 * hit >= n})
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(rows, arrow_type)], names=[*part.schema.names[:width], name])

        return df.mapInArrow(run, schema)

    out = None
    for test in test_blocks(benchmark, item, item_text):
        out = with_block(docs, test) if out is None else with_block(stage(out, "contamination"), test)
    return out, name


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: word counts, hits, items and the longest verbatim match."""
    rows, c = contamination(docs.select(key, text), benchmark, text)
    longest = F.array_max(F.transform(F.col(c)["matches"], lambda m: F.struct(m["words"].alias("n"), (-m["word"]).alias("p"))))
    return rows.select(
        key, F.col(c)["n_words"].alias("n_words"), F.col(c)["n_hit"].alias("n_hit"), F.size(F.col(c)["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col(c)["items"], ",").cast("binary"), 256).alias("items_sha256"), F.col(c)["contaminated"].alias("contaminated"),
        F.coalesce(longest["n"], F.lit(0)).cast("long").alias("longest_match"), F.coalesce(-longest["p"], F.lit(-1)).cast("long").alias("longest_at"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    rows, c = contamination(docs, benchmark, text)
    return rows.filter(~F.col(c)["contaminated"]).select(*docs.columns)
