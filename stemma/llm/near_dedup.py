"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets confirm.

1. Each text becomes its set of 5-word shingles (64-bit hashes). Equal sets share a fingerprint and are one node.
2. A node's MinHash samples fill bands, and folded by parity into a bitmap they make its odd sketch, whose XOR
   population count with another estimates their similarity.
3. Nodes that share a band meet in its bucket, a large bucket being dealt into blocks of bounded size. Within a block,
   sketches give a forest that joins each node to its most similar ones.
4. The forest's links are confirmed on the full sets, and components computed. One node of each component of a large
   bucket then meets those of its other components in the same way, so that blocks grow together.
5. Buckets that still hold several components are taken again, now with the full sets: every pair of different
   components whose sketches do not rule it out is confirmed on the spot, so that the forest has hidden no link and
   only links leave the task. Blocks of one component alone do not meet each other: a bucket of many variants of one
   text is copied once for each block of what is not among them.

200 samples in 40 bands of 5 miss a pair at similarity 0.75 with probability 2e-5, and the sketch's cut, 0.60, lies
3.8 standard errors below it. Nothing is capped. Keys with a large share of rows are joined by broadcast of their few
rows in the other table.

Edge cases: null and empty texts have no shingles and are linked with nothing; fewer words than five are one shingle;
rows of equal texts share a component, rows of one id with different texts need not and are told apart; a null id
never names a component unless all its ids are null; long texts are read whole, and blocks that carry sets are bounded
by their size; an empty table gives an empty table; further columns, of any name, are not read. keep_one leaves one
row of each component, the least id and of several with that id the least hash of the text, also where a row is
repeated; rows without shingles all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.relational import join_hot
from .common import discard, fresh, segments, ship, small_batches, stage, text_bytes

WIDTH = 5
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
BITS = 512
#: Pairs whose estimated similarity is below the threshold less this are ruled out.
SLACK = 0.15
#: Rows of a block in the first and in the second pass, shingles of a block of the second, rounds of meetings of components.
BLOCK, SECOND_BLOCK, BLOCK_SHINGLES, ROUNDS = 2048, 512, 1 << 22, 4
#: The Bloom filter of ids whose sets are needed has 2 ** this many bits, at most 16 MB. Beyond some 10 ** 7 ids it passes
#: more and more of the others, whose sets are then shuffled for nothing.
BLOOM = (18, 27)

#: So many links, 16 MB, have their components found on the driver at once; more take jobs of their own in rounds.
AT_ONCE = 1 << 20
#: Words whose hashes a worker remembers.
KNOWN = 1 << 15

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None]
_PLACE = _rng.integers(1, 1 << 63, (WIDTH, 1), np.uint64) | np.uint64(1)
_known: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of the text in lower case (A-Z); fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > KNOWN:
        _known.clear()
    try:
        codes = [_known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _known:
                _known[w] = xxhash.xxh3_64_intdigest(w)
        codes = [_known[w] for w in words]
    h = np.array(codes, np.uint64)
    n = len(h) - WIDTH + 1
    if n < 1:
        return _mix((h * _PLACE[: len(h), 0]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[:n] * _PLACE[0]
    for k in range(1, WIDTH):
        total += h[k : n + k] * _PLACE[k]
    out = np.sort(_mix(total))
    return out[np.r_[True, out[1:] != out[:-1]]]


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(out, (h[at : at + 2048] * _MULTIPLY + _ADD).min(1), out=out)
    return out


def sketches(m: np.ndarray) -> np.ndarray:
    """Odd sketches of rows of samples: bit parities of hashed (position, sample)."""
    h = _mix((m.astype(np.uint64) << np.uint64(16)) + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bit = (h >> np.uint64(40)).astype(np.int64) % BITS + np.arange(len(m))[:, None] * BITS
    return np.packbits(np.bincount(bit.ravel(), minlength=len(m) * BITS).reshape(len(m), BITS).astype(np.uint8) & 1, axis=1)


def band_keys(m: np.ndarray) -> np.ndarray:
    h = np.zeros((len(m), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0xFF51AFD7ED558CCD) + m.reshape(len(m), BANDS, ROWS)[:, :, k])
    return h.view(np.int64)


def odd_bits(similarity: float) -> float:
    """The XOR population count that two odd sketches of this similarity have on average."""
    return BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - similarity)))


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, n, fp, bands, sketch) of every row, staged; h is the text's hash; fp and what follows are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(text_bytes(x)) for x in part[1].to_pylist()]
                m = np.array([samples(s) if len(s) else np.zeros(SAMPLES, np.uint32) for s in sets])
                empty = np.array([not len(s) for s in sets])
                bands = pa.ListArray.from_arrays(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32), pa.array(band_keys(m).ravel()), mask=pa.array(empty))
                sketch = pa.array([None if e else b.tobytes() for b, e in zip(sketches(m), empty)], pa.binary())
                yield pa.record_batch([part[0], part[2], pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()), bands, sketch], names=["id", "h", "n", "fp", "bands", "sketch"])

    return stage(docs.select(F.col(key).alias("id"), F.col(text), F.xxhash64(text)).mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, h long, n long, fp long, bands array<long>, sketch binary"), "sigs")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def dealt(rows: DataFrame) -> DataFrame:
    """Bucket rows (key, fp, ..., count) with the block they meet in."""
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    return rows.withColumn("_group", F.xxhash64("key", F.pmod(F.xxhash64("fp"), blocks))).withColumn("_side", F.lit(0))


def dealt_again(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, n, component) of buckets with several components, once for each pair of blocks that they meet in.

    A component with more than a block of a bucket has blocks of its own, which do not meet each other; the others share blocks.
    """
    kinds = stage(rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w")), "kinds")
    blocks = F.greatest(F.ceil(F.col("c") / F.lit(SECOND_BLOCK)), F.ceil(F.col("w") / F.lit(BLOCK_SHINGLES))).cast("int")
    large = kinds.groupBy("key").agg(F.sum("c").alias("count"), F.sum("w").alias("w")).filter((F.col("count") > SECOND_BLOCK) | (F.col("w") > BLOCK_SHINGLES)).select("key", "count")
    large = stage(large, "large")
    whole = large.isEmpty()
    small = (rows if whole else rows.join(large, "key", "left_anti")).withColumn("_group", F.xxhash64("key")).withColumn("_side", F.lit(0))
    if whole:
        return small
    kinds = kinds.join(large.select("key"), "key").withColumn("blocks", blocks)
    w = Window.partitionBy("key").orderBy("component")
    own = kinds.filter("blocks > 1").withColumn("start", (F.sum("blocks").over(w) - F.col("blocks")).cast("int"))  # one row for each block's worth of rows
    taken = kinds.filter("blocks > 1").groupBy("key").agg(F.sum("blocks").cast("int").alias("taken"))
    pool = kinds.filter("blocks = 1").groupBy("key").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).select("key", blocks.alias("pooled"))
    plan = taken.join(pool, "key", "full").select("key", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("pooled", F.lit(0)).alias("pooled"))
    of = stage(rows.join(large.select("key"), "key", "left_semi").withColumn("kind", F.xxhash64("key", "component")), "large-rows")
    of = join_hot(of, own.select(F.xxhash64("key", "component").alias("kind"), "start", "blocks"), "kind", "left")
    of = join_hot(stage(of, "large-rows"), plan, "key")
    first, many = F.coalesce("start", "taken"), F.coalesce("blocks", "pooled")
    of = of.withColumn("_own", first + F.pmod(F.xxhash64("fp"), many).cast("int")).withColumn("_met", F.sequence(F.lit(0), F.col("taken") + F.col("pooled") - 1))
    others = F.when(F.col("start").isNull(), F.col("_met")).otherwise(F.filter("_met", lambda x: (x < F.col("start")) | (x >= F.col("start") + F.col("blocks"))))
    of = of.withColumn("_met", F.explode(others))
    of = of.withColumn("_group", F.xxhash64("key", F.least("_own", "_met"), F.greatest("_own", "_met"))).withColumn("_side", F.when(F.col("_own") > F.col("_met"), 1).when(F.col("_own") < F.col("_met"), -1).otherwise(0))
    return small.unionByName(of.select(*small.columns))


def in_blocks(rows: DataFrame, again: bool, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (_group, _side, fp, n, sketch); again: links, with component, bands, key and s too."""
    rows = rows.select("_group", "_side", "fp", "n", "sketch", *(["component", "bands", "key", "s"] if again else []))
    least = percent / 100
    limit = odd_bits(least - SLACK)

    def pairs(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, side: np.ndarray, component: np.ndarray | None, bands: np.ndarray | None, band_key: np.ndarray | None, sets: list | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m = len(fp)
        if component is None:
            joined, best, parent = np.zeros(m, bool), np.full(m, np.inf), np.zeros(m, np.int64)
            a, b = [], []
            at = 0
            while True:
                joined[at] = True
                z = np.bitwise_count(bits ^ bits[at]).sum(1, dtype=np.int64).astype(float)
                z[(z > limit) | (np.minimum(n, n[at]) < least * np.maximum(n, n[at]) - 1e-9)] = np.inf
                closer = ~joined & (z < best)
                best[closer], parent[closer] = z[closer], at
                left = np.flatnonzero(~joined)
                if not len(left):
                    break
                at = left[np.argmin(best[left])]
                if best[at] < np.inf:
                    a.append(at)
                    b.append(parent[at])
            yield fp[np.array(a, np.int64)], fp[np.array(b, np.int64)]
            return
        which = (bands[0] == band_key[0]).argmax()
        lead: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := lead.get(c, c)) != c:
                lead[c] = lead.get(up, up)
                c = up
            return c

        a, b = [], []
        for i in range(m - 1):
            j = np.arange(i + 1, m)
            j = j[(component[j] != component[i]) & ((side[j] != side[i]) | (side[i] == 0))]
            j = j[(np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= limit) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]) - 1e-9)]
            if which:  # pairs that an earlier band has are met there
                j = j[~(bands[j, :which] == bands[i, :which]).any(1)]
            for k in j.tolist():
                x, y = find(int(component[i])), find(int(component[k]))
                if x != y and alike(sets[i], sets[k], percent):
                    lead[max(x, y)] = min(x, y)
                    a.append(i)
                    b.append(k)
        yield fp[np.array(a, np.int64)], fp[np.array(b, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def meet(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
            fp, n, side = table["fp"].to_numpy(), table["n"].to_numpy(), table["_side"].to_numpy()
            bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            component = table["component"].to_numpy() if again else None
            key = table["key"].to_numpy() if again else None
            a, b = [], []
            cut = segments(groups)
            size = np.diff(cut)
            if not again:  # pairs, most of all buckets, side by side
                two = cut[:-1][size == 2]
                z = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64)
                good = two[(z <= limit) & (np.minimum(n[two], n[two + 1]) >= least * np.maximum(n[two], n[two + 1]) - 1e-9)]
                a.append(fp[good])
                b.append(fp[good + 1])
            for s, e in zip(cut[:-1][size > 2 - again].tolist(), cut[1:][size > 2 - again].tolist()):
                bands = np.array(table["bands"].slice(s, e - s).to_pylist(), np.int64) if again else None
                sets = [v.values.to_numpy(zero_copy_only=False) for v in table["s"].slice(s, e - s)] if again else None
                for x, y in pairs(fp[s:e], n[s:e], bits[s:e], side[s:e], component[s:e] if again else None, bands, key[s:e] if again else None, sets):
                    a.append(x)
                    b.append(y)
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            both = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            groups = table["_group"].to_numpy()
            if groups[0] == groups[-1] and len(groups) < 8 * BLOCK:
                continue
            done = int(np.flatnonzero(groups != groups[-1])[-1]) + 1 if (groups != groups[-1]).any() else 0
            if done:
                yield from meet(table.slice(0, done), groups[:done])
            held = table.slice(done).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from meet(table, table["_group"].to_numpy())

    return rows.repartition("_group").sortWithinPartitions("_group").mapInArrow(run, "a long, b long")


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct nodes of links (a, b), and of each the place of the least node that it is linked with over any number of links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # a root takes the least of its neighbours
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, root


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being its component's least node; up to AT_ONCE links meet on the driver."""
    if links.count() <= AT_ONCE:
        table = links.toArrow()
        nodes, root = least_nodes(table["a"].to_numpy(), table["b"].to_numpy())
        return links.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes[root]}), "node long, root long")
    return graph.components(links, lambda df: stage(df, "cc"), discard).withColumnRenamed("component", "root")


def bloom(ids: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of 2 ** size bits over the column h (64-bit hashes), built by bitwise sums."""
    bits = ids.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - size), F.shiftrightunsigned(F.shiftleft("h", size), 64 - size))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(1 << size - 6, np.int64)
    out[words["w"].to_numpy()] = words["x"].to_numpy()
    return out.view(np.uint64)


def bloom_size(n: int) -> int:
    return max(BLOOM[0], min(BLOOM[1], (16 * n).bit_length()))


def in_bloom(words: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    """Which of these hashes (64-bit, signed) the filter may hold."""
    v, hit = h.view(np.uint64), np.ones(len(h), bool)
    for bit in (v >> np.uint64(64 - size), (v << np.uint64(size)) >> np.uint64(64 - size)):
        hit &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) > 0
    return hit


def full_sets(docs: DataFrame, key: str, text: str, needed: DataFrame) -> DataFrame:
    """(fp, s) for the nodes in needed (fp, id), a staged table: one document of each, found by a Bloom filter of its id's hash."""
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    size = bloom_size(needed.count())
    mask = docs.sparkSession.sparkContext.broadcast(bloom(needed.select(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("h")), size))  # at most 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bloom(mask.value, size, batch[0].to_numpy())
            texts = batch[1].filter(pa.array(hit))
            for at in range(0, len(texts), 1024):
                sets = [s for x in texts.slice(at, 1024).to_pylist() if len(s := shingles(text_bytes(x)))]
                if sets:
                    flat = pa.ListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.record_batch([pa.array([fingerprint(s) for s in sets], pa.int64()), flat], names=["fp", "s"])

    found = docs.select(h.alias("h"), F.col(text)).mapInArrow(run, "fp long, s array<long>")
    return stage(found.join(needed.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False), percent) for x, y in zip(batch[2], batch[3])]
            m = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch[0].filter(m), batch[1].filter(m)], names=["a", "b"])

    return one.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components_met(buckets: DataFrame, roots: DataFrame, light: DataFrame) -> DataFrame:
    """One row (key, fp, n, sketch, count) for each component of each large bucket that has several."""
    of = buckets.filter(F.col("count") > BLOCK).select("key", "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    one = stage(of.groupBy("key", F.coalesce("root", "fp").alias("component")).agg(F.min("fp").alias("fp")).select("key", "fp"), "met")
    counts = one.groupBy("key").count().filter("count > 1")
    return join_hot(one, counts, "key", counts=counts).join(light, "fp")


def grouped(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(id, h, n, fp, root, component_id, kept) of every row; root is null without shingles."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    small_batches(spark)
    sigs = signatures(docs, key, text)
    nodes = stage(sigs.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    rows = nodes.select("fp", F.explode("bands").alias("key"))
    counts = stage(rows.groupBy("key").count().filter("count > 1"), "counts")
    buckets = stage(join_hot(rows, counts, "key", counts=counts), "buckets")
    involved = stage(buckets.select("fp").distinct().join(nodes.select("fp", "id"), "fp"), "involved")
    sets = full_sets(docs, key, text, involved)
    light = nodes.select("fp", "n", "sketch")
    first = stage(in_blocks(dealt(buckets.join(light, "fp")), False, percent).distinct(), "pairs")
    links = [stage(confirm(first, sets, percent), "links")]
    roots = stage(components(links[0]), "roots")
    discard(counts, involved, first)
    for _ in range(ROUNDS if not buckets.filter(F.col("count") > BLOCK).isEmpty() else 0):
        met = stage(in_blocks(dealt(components_met(buckets, roots, light)), False, percent).distinct(), "pairs")
        more = stage(confirm(met, sets, percent), "links")
        discard(met)
        if more.isEmpty():
            break
        links.append(more)
        old, roots = roots, stage(components(reduce(DataFrame.union, links)), "roots")
        discard(old)
    named = buckets.select("key", "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("count")).filter("low <> high")
    mixed = stage(mixed.select("key", "count"), "mixed")
    if not mixed.isEmpty():
        several = stage(join_hot(named, mixed, "key", counts=mixed).select("key", "fp", "component").join(nodes.select("fp", "n"), "fp"), "several")
        again = dealt_again(several).drop("n")
        more = stage(in_blocks(again.join(nodes.select("fp", "n", "sketch", "bands"), "fp").join(sets, "fp"), True, percent).distinct(), "links")
        if not more.isEmpty():
            links.append(more)
            roots = stage(components(reduce(DataFrame.union, links)), "roots")
        discard(several)
    discard(buckets, sets, mixed)
    linked = stage(nodes.select("fp", "id").join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "linked")
    names = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    named = nodes.select("fp", "id").join(join_hot(linked.select("fp", "root"), names, "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = join_hot(sigs.select("id", "h", "n", "fp"), stage(named, "named"), "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "h", "n", "fp", "root", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    return grouped(docs, key, text, percent).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """docs with one row of each component, told by id (null too) and text, and all rows without shingles."""
    i, h, again = fresh(docs, "_id"), fresh(docs, "_hash"), fresh(docs, "_again")
    rows = stage(grouped(docs, key, text, percent).select("id", "h", "root", "kept"), "marks")
    able = rows.filter("kept and root is not null").groupBy("root", "id", "h").count()
    first = able.groupBy("root").agg(F.min("h").alias("first"))
    able = able.join(first, "root")
    gone = rows.filter("not kept").select("id", "h").distinct().union(able.filter("h <> first").select("id", "h"))
    repeated = able.filter("h = first and count > 1").select("id", "h")
    told = stage(gone.withColumn("again", F.lit(False)).union(repeated.withColumn("again", F.lit(True))).toDF(i, h, again), "told")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # A Bloom filter of at most 16 MB tells most rows that stay, so that no other texts are shuffled.
    size = bloom_size(told.count())
    mask = docs.sparkSession.sparkContext.broadcast(bloom(told.select(row_hash(F.col(i), F.col(h)).alias("h")), size))

    def may_go(x: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(mask.value, size, x.to_numpy()))

    seen = fresh(docs, "_seen")
    docs = docs.withColumn(seen, F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)))
    docs = docs.withColumn(seen, F.struct(F.col(seen).alias("h"), F.pandas_udf(may_go, "boolean")(row_hash(F.col(f"`{key}`"), F.col(seen))).alias("m")))
    near = docs.filter(F.col(seen)["m"]).join(told, F.col(f"`{key}`").eqNullSafe(F.col(i)) & (F.col(seen)["h"] == F.col(h)), "left")
    stay = docs.filter(~F.col(seen)["m"]).select(*columns).union(near.filter(F.col(again).isNull()).select(*columns))
    once = near.filter(F.col(again)).dropDuplicates([i, h]).select(*columns)
    return stay if told.filter(again).isEmpty() else stay.union(once)


def row_hash(key: Column, h: Column) -> Column:
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), h)
