"""Pair graphs, similarity joins, and iterative graph jobs on DataFrames of edges."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ensure_checkpoints, staged
from . import relational, stats

#: Items of a group that meet in one task, and rows of a block of vectors.
MET, BLOCK = 1024, 4096
#: Items of a document that takes its list to each of them.
LISTED = 32


def pairs_sharing(edges: DataFrame, item: str, group: str, least: int) -> DataFrame:
    """(a, b, weight): pairs of items in at least `least` common groups, of all items of every group.

    A group of more than MET items is dealt into blocks, pairs of blocks meeting in different tasks.
    """
    held = edges.select(group, item)
    blocks = F.ceil(F.col("_n") / F.lit(MET)).cast("int")
    size = held.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > MET)
    large = held.join(size, group).withColumn("_own", F.pmod(F.xxhash64(item), blocks).cast("int"))

    def plain(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumnRenamed(item, name)

    few = held.join(size.select(group), group, "left_anti")
    small = plain(few, "a").join(plain(few, "b"), group).filter("a < b").select("a", "b")
    left = large.withColumn("_hi", F.explode(F.sequence("_own", blocks - 1))).select(group, F.col("_own").alias("_lo"), "_hi", F.col(item).alias("a"))
    right = large.withColumn("_lo", F.explode(F.sequence(F.lit(0), "_own"))).select(group, "_lo", F.col("_own").alias("_hi"), F.col(item).alias("b"))
    met = left.join(right, [group, "_lo", "_hi"]).filter((F.col("_lo") < F.col("_hi")) | (F.col("a") < F.col("b")))
    every = small.union(met.select(F.least("a", "b"), F.greatest("a", "b")))
    return every.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def first_items(edges: DataFrame, item: str, group: str, most: int) -> DataFrame:
    """The first `most` items of each group, in order; a reference list that is longer counts no further."""
    w = Window.partitionBy(group).orderBy(item)
    return edges.select(group, item).distinct().withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most).drop("_i")


def adaptive_threshold(pairs: DataFrame, floor: int = 2) -> DataFrame:
    """One row: the larger of floor and the whole part of the median weight."""
    return pairs.agg(F.greatest(F.lit(floor), F.floor(F.percentile("weight", 0.5))).cast("long").alias("threshold"))


def top_of_either(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs among the n heaviest of either end."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b", "weight").union(pairs.select(F.col("b"), F.col("a"), "a", "b", "weight"))
    w = Window.partitionBy("u").orderBy(F.desc("weight"), "v")
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select("a", "b", "weight").distinct()


def idf_jaccard(edges: DataFrame, doc: str, item: str, most: int, least: float) -> DataFrame:
    """(a, b, similarity): shared idf over idf of the union; items in more than `most` documents do not count. Edges are distinct.

    Each document takes its list to each of its items, where pairs are compared in full, once, at the first item that they
    share; pairs are not shuffled. Pairs with a document of more than LISTED items are summed over their shared items.
    """
    known = edges.groupBy(doc).count().filter(F.col(doc).isNotNull()).agg(F.count("*"), F.max("count")).first()
    by_item = edges.filter(F.col(item).isNotNull()).repartition(item)  # one shuffle for the counts and for what they join
    df = by_item.groupBy(item).agg(F.count("*").cast("int").alias("_df")).filter(F.col("_df") <= most)

    def idf(df):
        return F.log(F.lit(float(known[0])) / df) + 1

    w = by_item.join(df, item).select(F.col(doc).alias("d"), F.col(item).alias("i"), F.col("_df").cast("byte" if most < 128 else "int").alias("f"))
    held = w.repartition("d").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "f"))).alias("l"), F.sum(idf(F.col("f"))).alias("norm"))
    each = held.filter(F.size("l") <= LISTED).select(F.explode("l.i").alias("i"), "d", "norm", F.col("l.i").alias("is"), F.col("l.f").alias("fs"))
    a, b = each.toDF("i", "a", "na", "ia", "fa"), each.toDF("i", "b", "nb", "ib", "fb")  # alike, so that they are shuffled once
    both = F.array_intersect("ia", "ib")  # in order

    def summed(items, counts):
        return F.aggregate(both, F.lit(0.0), lambda s, x: s + idf(F.element_at(counts, F.array_position(items, x).cast("int"))))

    met = a.join(b, "i").filter((F.col("a") < F.col("b")) & (F.get(both, F.lit(0)) == F.col("i")))
    alone = idf(F.element_at("fa", F.array_position("ia", F.col("i")).cast("int")))
    every = met.select("a", "b", F.when(F.size(both) == 1, alone).when(F.size("fa") <= F.size("fb"), summed("ia", "fa")).otherwise(summed("ib", "fb")).alias("s"), "na", "nb")
    if (known[1] or 0) > LISTED:
        size = held.select("d", (F.size("l") > LISTED).alias("long"), "norm")
        x, y = w.join(size.filter("long"), "d").select(F.col("d").alias("x"), "i", "f"), w.join(size, "d").select(F.col("d").alias("y"), "i", "long")
        pairs = x.join(y, "i").filter((F.col("x") < F.col("y")) | (~F.col("long") & (F.col("x") != F.col("y")))).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(idf(F.col("f"))).alias("s"))
        norm = size.select("d", "norm")
        every = every.union(pairs.join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b").select("a", "b", "s", "na", "nb"))
    return every.withColumn("similarity", F.col("s") / (F.col("na") + F.col("nb") - F.col("s") + 1e-9)).filter(F.col("similarity") >= least).select("a", "b", "similarity")


def blockwise(vectors: DataFrame, key: str, vector: str, group: str, blocks: int | None, run, schema: str, unit: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """run(ids, groups, vectors (of length one if unit), left, right, same) for every pair of blocks of vectors; with edges (src, dst), also those between the two blocks.

    Blocks hold about BLOCK vectors, so that a task holds two and a product of them; each vector goes to as many tasks as there are blocks. Null vectors go.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(group).alias("g"))
    blocks = blocks or max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("lo", F.least("own", "met")).withColumn("hi", F.greatest("own", "met"))

    def meet(pdf, *more):
        pdf = pdf.sort_values("id", kind="stable")
        m = np.vstack(pdf["v"].to_numpy()).astype(float)
        if unit:
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        own, lo, hi = pdf["own"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        return run(pdf["id"].to_numpy(), pdf["g"].to_numpy(), m, left, right, lo == hi, *more)

    out = schema.format(vectors.schema[key].dataType.simpleString())

    def meet_plain(pdf: pd.DataFrame) -> pd.DataFrame:
        return meet(pdf)

    if edges is None:
        return dealt.groupBy("lo", "hi").applyInPandas(meet_plain, out)
    kind = vectors.schema[key].dataType
    ends = edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    of = [F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int") for x in ("src", "dst")]
    ends = ends.select(F.least(*of).alias("lo"), F.greatest(*of).alias("hi"), "src", "dst")
    names = [f.split()[0] for f in out.split(", ")]

    def meet_edges(pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        return meet(pdf, more) if len(pdf) else pd.DataFrame({x: [] for x in names})

    return dealt.groupBy("lo", "hi").cogroup(ends.groupBy("lo", "hi")).applyInPandas(meet_edges, out)


def bridges(vectors: DataFrame, key: str, vector: str, group: str, least: float, blocks: int | None = None) -> DataFrame:
    """(a, b, cosine): pairs of different groups with at least this cosine."""

    def run(ids, groups, m, left, right, same):
        c = m[left] @ m[right].T
        i, j = np.nonzero((c >= least) & (groups[left][:, None] != groups[right][None, :]))
        x, y = ids[left[i]], ids[right[j]]
        keep = x < y if same else np.ones(len(x), bool)
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "cosine": c[i, j][keep]})

    return blockwise(vectors, key, vector, group, blocks, run, "a {0}, b {0}, cosine double")


def nearest(vectors: DataFrame, key: str, vector: str, group: str, k: int, blocks: int | None = None) -> DataFrame:
    """(id, other, cosine, rank): the k nearest of each row, exactly, by cosine to nine digits and then by id; blocks give their best k, ranks follow."""

    def run(ids, groups, m, left, right, same):
        out = []
        for x, y in ((left, right),) if same else ((left, right), (right, left)):
            c = m[x] @ m[y].T
            c[ids[x][:, None] == ids[y][None, :]] = -2
            best = np.argsort(-np.round(c, 9), axis=1, kind="stable")[:, :k]  # rows come by id
            out.append(pd.DataFrame({"id": np.repeat(ids[x], best.shape[1]), "other": ids[y][best.ravel()], "cosine": np.take_along_axis(c, best, 1).ravel()}))
        out = pd.concat(out)
        return out[out["cosine"] > -2]

    found = blockwise(vectors, key, vector, group, blocks, run, "id {0}, other {0}, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality) of the undirected graph (a, b)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    d = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return d.crossJoin(F.broadcast(d.agg(F.count("*").alias("_n")))).select("node", "degree", (F.col("degree") / (F.col("_n") - 1)).alias("centrality"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, checkpoint_every: int = 5) -> DataFrame:
    """(node, rank) of the directed graph (src, dst, weight); the mass of nodes without out-edges is spread evenly."""
    ensure_checkpoints(edges.sparkSession)
    out = edges.groupBy("src").agg(F.sum("weight").alias("_w"))
    share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_w")).alias("share")).checkpoint()
    nodes = share.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(out.select(F.col("src").alias("node"), F.lit(1).alias("_out")), "node", "left").checkpoint()
    n = nodes.count()
    ranks = nodes.select("node", "_out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        lost = ranks.filter("_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_lost"))
        got = share.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("_got"))
        new = ranks.withColumnRenamed("rank", "_old").join(got, "node", "left").crossJoin(F.broadcast(lost))
        new = new.select("node", "_out", "_old", ((1 - damping) / n + damping * (F.coalesce("_got", F.lit(0.0)) + F.col("_lost") / n)).alias("rank"))
        if i % checkpoint_every == checkpoint_every - 1 or i == rounds - 1:
            new = new.checkpoint()
            if (new.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] or 0.0) < tolerance * n:
                return new.select("node", "rank")
        ranks = new.drop("_old")
    return ranks.select("node", "rank")


def settled(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n), paths that reach each node of (src, dst) from nodes that nothing reaches, level by level; and the nodes that are never settled, on a cycle or behind one."""
    waiting = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("left"), F.lit(0.0).alias("n"))
    ready = e.select(F.col("src").alias("node")).distinct().join(waiting, "node", "left_anti").select("node", F.lit(1.0).alias("n")).checkpoint()
    done, rounds = ready, 0
    while not ready.isEmpty():
        sent = e.join(ready.select(F.col("node").alias("src"), F.col("n").alias("_n")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_c"), F.sum("_n").alias("_s"))
        waiting = waiting.join(sent, "node", "left").select("node", (F.col("left") - F.coalesce("_c", F.lit(0))).alias("left"), (F.col("n") + F.coalesce("_s", F.lit(0.0))).alias("n")).checkpoint()
        ready = waiting.filter("left = 0").select("node", "n").checkpoint()
        waiting = waiting.filter("left > 0")
        done, rounds = done.union(ready), rounds + 1
        done = done.checkpoint() if rounds % 10 == 0 else done
    return done, waiting.select("node")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of cycles of (src, dst); component is the least node of its strongly connected part.

    Every node gets the least node that reaches it; within one such colour, what reaches that node is its component. What is left is coloured again.
    """
    ensure_checkpoints(edges.sparkSession)
    left, found = edges.select("src", "dst").filter("src <> dst").distinct().checkpoint(), None
    while not left.isEmpty():
        colour = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")).checkpoint()
        while True:
            got = left.join(colour.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("_c"))
            new = colour.join(got, "node", "left").select("node", F.col("c").alias("_old"), F.least("c", "_c").alias("c")).checkpoint()
            colour = new.select("node", "c")
            if new.filter("c <> _old").isEmpty():
                break
        same = left.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").filter("c = d").select("src", "dst", "c").checkpoint()
        reach = colour.filter("node = c").checkpoint()
        front = reach
        while not front.isEmpty():
            front = same.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "c").distinct().join(reach.select("node"), "node", "left_anti").checkpoint()
            reach = reach.union(front)
        reach = reach.checkpoint()
        found = reach if found is None else found.union(reach)
        gone = reach.select("node")
        left = left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst").checkpoint()
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    several = found.groupBy("c").count().filter("count > 1").select("c")
    return found.join(several, "c").select("node", F.col("c").alias("component"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def condensed(edges: DataFrame, stuck: DataFrame, behind: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, from, to) of the edges between strongly connected parts, with their parts, and (node, component) of the parts that are cycles.

    Only what is on a cycle or between cycles is looked at: what can be settled from neither end (stuck, behind).
    """
    core = stuck.join(behind, "node", "left_semi").checkpoint()
    inside = edges.join(core.toDF("src"), "src", "left_semi").join(core.toDF("dst"), "dst", "left_semi").select("src", "dst")
    parts = strong_components(inside).checkpoint()
    out = edges.join(parts.toDF("src", "_from"), "src", "left").join(parts.toDF("dst", "_to"), "dst", "left")
    return staged(out.select("src", "dst", F.coalesce("_from", "src").alias("from"), F.coalesce("_to", "dst").alias("to")).filter(F.col("from") != F.col("to"))), parts


def path_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, spc) of a graph (src, dst): paths from sources to src times paths from dst to sinks.

    Cycles are taken as one node each; edges inside them have no count, and edges that join the same two share theirs equally.
    """
    edges = staged(edges.select("src", "dst").filter("src <> dst").distinct())
    f, stuck = settled(edges)
    g, behind = settled(reversed_edges(edges))
    if stuck.isEmpty():
        return edges.join(f.toDF("src", "f"), "src").join(g.toDF("dst", "g"), "dst").select("src", "dst", (F.col("f") * F.col("g")).alias("spc"))
    between, _ = condensed(edges, stuck, behind)
    parallel = staged(between.groupBy("from", "to").agg(F.count("*").alias("n")))
    dag = parallel.select(F.col("from").alias("src"), F.col("to").alias("dst"))
    f, g = settled(dag)[0], settled(reversed_edges(dag))[0]
    spc = parallel.join(f.toDF("from", "f"), "from").join(g.toDF("to", "g"), "to").select("from", "to", (F.col("f") * F.col("g") / F.col("n")).alias("spc"))
    return between.join(spc, ["from", "to"]).select("src", "dst", "spc")


def cycle_audit(edges: DataFrame, years: DataFrame) -> DataFrame:
    """(component, size, intra_edges, year_min, year_max) of the cycles of (src, dst); years (node, year)."""
    edges = staged(edges.select("src", "dst").filter("src <> dst").distinct())
    stuck, behind = settled(edges)[1], settled(reversed_edges(edges))[1]
    parts = condensed(edges, stuck, behind)[1]
    size = parts.join(years, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    inside = edges.join(parts.toDF("src", "component"), "src").join(parts.toDF("dst", "_to"), "dst").filter("component = _to").groupBy("component").agg(F.count("*").alias("intra_edges"))
    return size.join(inside, "component")


def main_path(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(src, dst, spc, weight, is_main): weight ln(spc + 1); main edges reach the weight at index int(n * share) - 1."""
    e = path_counts(edges).withColumn("weight", F.log1p("spc")).checkpoint()
    n = e.count()
    cut = stats.value_at(e, "spc", n - 1 - max(0, int(n * share) - 1)) if n else None
    return e.withColumn("is_main", F.col("spc") >= F.lit(cut))


def components(edges: DataFrame, keep=staged, drop=lambda *tables: None) -> DataFrame:
    """(node, component) of every node of an edge (a, b), component being the least node of its connected part.

    Large and small stars in turn, until nothing changes; the centre of a star, which may have any share of the edges,
    is joined by broadcast. keep computes a table once, drop gives up tables that nothing reads any more.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = None
    while (now := mark(e)) != was:
        was = now
        if not now[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = relational.join_hot(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # u's larger neighbours
        large = keep(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, keep(small.filter("u <> v").distinct())
        drop(old, large)
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(roots.select(F.col("component").alias("node"), "component").distinct())


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman's modularity of labels (node, label) on edges (a, b, weight)."""
    m = edges.agg(F.sum("weight").alias("m"))
    e = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
    inside = e.filter("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("inside"))
    degree = e.select(F.explode(F.array("la", "lb")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("degree"))
    q = degree.join(inside, "label", "left").crossJoin(F.broadcast(m))
    return q.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def disruption(edges: DataFrame) -> DataFrame:
    """(node, n_i, n_j, n_k, cd): citers of the node alone, of it and its references, of its references alone."""
    e = edges.select("citing", "cited").distinct()
    refs = e.select(F.col("citing").alias("node"), F.col("cited").alias("ref"))
    direct = e.select(F.col("cited").alias("node"), F.col("citing").alias("citer"))
    of_refs = refs.join(e.select(F.col("cited").alias("ref"), F.col("citing").alias("citer")), "ref").filter("citer <> node").select("node", "citer").distinct()
    both = direct.withColumn("d", F.lit(1)).join(of_refs.withColumn("r", F.lit(1)), ["node", "citer"], "full")
    c = both.groupBy("node").agg(F.count(F.when(F.col("r").isNull(), 1)).alias("n_i"), F.count(F.when(F.col("r").isNotNull() & F.col("d").isNotNull(), 1)).alias("n_j"), F.count(F.when(F.col("d").isNull(), 1)).alias("n_k"))
    return c.withColumn("cd", (F.col("n_i") - F.col("n_j")) / (F.col("n_i") + F.col("n_j") + F.col("n_k")))


def lineages(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(child, parent, support, total, strength, confidence, status) of clusters by edges from older to newer nodes.

    edges (src, dst) point forward in time; labels (node, label).
    """
    e = edges.join(labels.toDF("src", "parent"), "src").join(labels.toDF("dst", "child"), "dst").filter("parent <> child")
    n = e.groupBy("child", "parent").agg(F.count("*").alias("support"))
    w = Window.partitionBy("child")
    top = n.withColumn("total", F.sum("support").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("support"), "parent"))).filter("_r = 1").drop("_r")
    top = top.withColumn("strength", F.col("support") / F.col("total")).withColumn("confidence", F.least(F.lit(1.0), F.col("strength") * F.when(F.col("support") >= 8, 1.0).otherwise(0.75)))
    return top.withColumn("status", F.when((F.col("support") >= 8) & (F.col("confidence") >= 0.30), "evidence_backed_split").when(F.col("support") >= 3, "weak_split_candidate").otherwise("layout_cluster_only"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other) of directed edges (src, dst), both ways, each once, without loops."""
    e = edges.filter("src <> dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()


def expand(edges: DataFrame, seeds: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """Nodes one step from the seeds (node), without them; the `most` best of scores (node, score) are the feature asked for."""
    found = neighbours(edges).join(seeds, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seeds, "node", "left_anti")
    return found.join(scores, "node", "left").orderBy(F.desc_nulls_last("score"), "node").limit(most)


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops): least steps from any seed (node) along either direction, up to depth."""
    ensure_checkpoints(edges.sparkSession)
    both = neighbours(edges).checkpoint()
    seen = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    front = seen.select("node")
    for step in range(1, depth + 1):
        front = both.join(front, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        seen = seen.union(front.withColumn("hops", F.lit(step)))
    return seen


def ways(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, ways): the number of walks of up to depth edges (src, dst) from each seed (node); counted, never listed."""
    e = edges.select("src", "dst")
    front = seeds.select(F.col("node").alias("seed"), F.col("node").alias("src"), F.lit(1).cast("long").alias("ways"))
    total = None
    for _ in range(depth):
        front = front.join(e, "src").groupBy("seed", F.col("dst").alias("src")).agg(F.sum("ways").alias("ways"))
        total = front if total is None else total.union(front)
    return total.groupBy("seed", F.col("src").alias("node")).agg(F.sum("ways").alias("ways"))


def local_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(node, rank) on the seeds (node) and their neighbours; weight that leaves them goes to a sink, which is then dropped."""
    core = neighbours(edges).join(seeds, "node", "left_semi").select(F.col("other").alias("node")).union(seeds.select("node")).distinct()
    out = edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi")
    inside = core.select(F.col("node").alias("dst"), F.lit(True).alias("_in"))
    sunk = out.join(inside, "dst", "left").select("src", F.when(F.col("_in"), F.col("dst")).otherwise(F.lit(-1)).alias("dst"), "weight")
    ranks = pagerank(sunk.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), damping, rounds=rounds).filter("node <> -1")
    return ranks.crossJoin(F.broadcast(ranks.agg(F.sum("rank").alias("_t")))).select("node", (F.col("rank") / F.col("_t")).alias("rank"))
