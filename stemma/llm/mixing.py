"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Token capacity flows from
patterns to source quotas: the first use of a pattern's words costs nothing and each repetition costs more than the
one before, so that the flow repeats words only where a quota needs it. The flow of a pattern then selects documents
in the order of a seeded hash.

Edge cases: a null source is a source of its own, last in order; a null text has size 0; rows of one id share their
order and are taken together; an empty table gives an empty table; long texts are counted whole; columns of any name
may stand beside. Source names may hold any character, since patterns are written once, by Spark, and only carried
after that. A pattern's flow is met up to what whole documents allow: a prefix of the seeded order, and the one
further document whose size closes the gap best, the first of equals in the seeded order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stage, word_count

CYCLE = (3, 1, 2)


def source_order(names: list) -> list:
    """By code point, null last."""
    return sorted((n for n in names if n is not None), key=lambda s: [ord(c) for c in s]) + [n for n in names if n is None]


def quotas(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Targets by weight of share * all sizes, none above most * its size; what is cut off is shared anew by weight."""
    left, free, out = share * sum(sizes.values()), list(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        target = {s: left * weights[s] / total for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return out | target
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(supply: list[int], demand: list[int], links: list[list[int]], repeats: int) -> dict[tuple[int, int], int]:
    """Words from pattern p to source s, by successive shortest paths with potentials.

    Each pattern may be used `repeats` times; its k-th use costs k - 1 a word, a convex cost.
    """
    n, m = len(supply), len(demand)
    start, end = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, words in enumerate(supply):
        for k in range(repeats):
            arc(start, p, words, k)
        for s in links[p]:
            arc(p, n + s, repeats * words, 0)
    for s, words in enumerate(demand):
        arc(n + s, end, words, 0)
    height = [0] * len(graph)
    while True:
        far, via = {start: 0}, {}
        heap = [(0, start)]
        done = set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for i, (b, cap, cost, _) in enumerate(graph[a]):
                e = d + cost + height[a] - height[b]
                if cap > 0 and e < far.get(b, 1 << 60):
                    far[b], via[b] = e, (a, i)
                    heapq.heappush(heap, (e, b))
        if end not in via:
            break
        for v in range(len(graph)):
            height[v] += min(far.get(v, far[end]), far[end])
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = via[b][0]
        step = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= step
            graph[graph[a][i][0]][graph[a][i][3]][1] += step
    return {(p, b - n): repeats * supply[p] - cap for p in range(n) for b, cap, cost, _ in graph[p] if n <= b < n + m and cap < repeats * supply[p]}


def order_key(key: Column, seed: str) -> Column:
    """60 bits of the md5 of seed and id: the seeded order of documents."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def pattern_of(sources: Column) -> Column:
    """The membership pattern: the distinct sources, in order, as one string; nulls count as a source."""
    return F.to_json(F.struct(F.sort_array(F.array_distinct(sources), asc=False).alias("s")), {"ignoreNullFields": "false"})


def mix(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", share: float = 1.5, repeats: int = 2, seed: str = "mix", weights: dict | None = None, max_patterns: int = 4000) -> tuple[DataFrame, DataFrame, dict]:
    """(rows, plan, targets).

    rows: key, _pattern, _size, _order of every row, staged. plan: by pattern, copies of every document, and the
    seeded order up to which documents get one more, and the order of the one that closes the gap. targets: by source,
    its size, target, and the pattern of documents that no other source holds. Patterns are aggregates whose number
    max_patterns bounds; beyond it the operator refuses.
    """
    spark = docs.sparkSession
    rows = stage(docs.select(F.col(key), sources.alias("_sources"), word_count(F.col(text)).alias("_size"), order_key(F.col(key), seed).alias("_order")).withColumn("_pattern", pattern_of(F.col("_sources"))), "mix-rows")
    found = rows.groupBy("_pattern").agg(F.sum("_size").alias("words"), F.first("_sources").alias("sources")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found.sort(key=lambda r: r["_pattern"])
    members = [source_order(list(dict.fromkeys(r["sources"]))) for r in found]
    names = source_order(list(dict.fromkeys(s for m in members for s in m)))
    weigh = weights or {s: CYCLE[i % len(CYCLE)] for i, s in enumerate(names)}
    sizes = {s: sum(r["words"] for r, m in zip(found, members) if s in m) for s in names}
    targets = quotas(sizes, weigh, share, float(repeats))
    at = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([r["words"] for r in found], [round(targets[s]) for s in names], [[at[s] for s in m] for m in members], repeats)
    wanted = [sum(v for (p, _), v in flow.items() if p == i) for i in range(len(found))]
    quota = spark.createDataFrame([(r["_pattern"], w // r["words"] if r["words"] else 0, w % r["words"] if r["words"] else 0) for r, w in zip(found, wanted)], "_pattern string, _whole long, _rest long")
    alone = {m[0]: r["_pattern"] for r, m in zip(found, members) if len(m) == 1}
    info = {s: {"size": sizes[s], "target": targets[s], "pattern": alone.get(s)} for s in names}
    return rows, select(rows, quota), info


def select(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """By pattern: _whole, _cut (orders up to it get one more copy) and _extra (the order that gets one besides).

    The cut is found by sums over 4096 ranges of the order, then within the one range that the rest falls into.
    """
    cell = F.shiftright("_order", 48)
    sums = rows.groupBy("_pattern", cell.alias("_cell")).agg(F.sum("_size").alias("_words"))
    w = Window.partitionBy("_pattern").orderBy("_cell")
    edge = sums.withColumn("_before", F.sum("_words").over(w) - F.col("_words")).join(F.broadcast(quota), "_pattern").filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest"))).select("_pattern", "_cell", "_before", "_whole", "_rest")
    edge = stage(edge, "mix-edge")
    inner = rows.join(F.broadcast(edge), (rows["_pattern"] == edge["_pattern"]) & (F.shiftright(rows["_order"], 48) == edge["_cell"])).select(edge["*"], rows["_order"], rows["_size"]).withColumn("_upto", F.col("_before") + F.sum("_size").over(Window.partitionBy("_pattern").orderBy("_order")))
    cut = inner.filter(F.col("_upto") <= F.col("_rest")).groupBy("_pattern").agg(F.max("_order").alias("_cut"), F.max("_upto").alias("_reached"))
    cut = edge.join(cut, "_pattern", "left").select("_pattern", "_whole", "_rest", F.coalesce("_cut", F.shiftleft("_cell", 48) - 1).alias("_cut"), (F.col("_rest") - F.coalesce("_reached", "_before")).alias("_gap"))
    cut = stage(cut, "mix-cut")
    near = rows.join(F.broadcast(cut), "_pattern").filter((F.col("_order") > F.col("_cut")) & (F.abs(F.col("_size") - F.col("_gap")) < F.col("_gap")))
    extra = near.groupBy("_pattern").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_gap")).alias("d"), F.col("_order").alias("o")))["o"].alias("_extra"))
    return stage(quota.join(cut.select("_pattern", "_cut"), "_pattern", "left").join(extra, "_pattern", "left"), "mix-plan")


def copies(order: Column, plan: str = "") -> Column:
    """How often a document of this order is taken, from the plan's columns or a struct column that holds them."""
    of = (lambda c: F.col(plan)[c]) if plan else F.col
    more = (order <= of("_cut")) | (order == of("_extra"))
    return F.coalesce(of("_whole"), F.lit(0)) + F.coalesce(more, F.lit(False)).cast("long")


def source_report(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, size, source_size, target, taken) of every row, each document being held by one source."""
    rows, plan, targets = mix(docs, F.array(source), key, text, **options)
    info = docs.sparkSession.createDataFrame([(v["pattern"], v["size"], float(v["target"])) for v in targets.values()], "_pattern string, source_size long, target double")
    met = rows.join(F.broadcast(plan), "_pattern", "left").join(F.broadcast(info), "_pattern", "left")
    return met.select(key, F.col("_size").alias("size"), "source_size", "target", (copies(F.col("_order")) * F.col("_size")).alias("taken"))


def apply_mix(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; no text is shuffled."""
    _, plan, _ = mix(docs, sources, key, text, **options)
    pattern, held = fresh(docs, "_pattern"), fresh(docs, "_plan")
    named = docs.withColumn(pattern, pattern_of(sources))
    plan = plan.select(F.col("_pattern").alias(pattern), F.struct("_whole", "_cut", "_extra").alias(held))
    met = named.join(F.broadcast(plan), pattern)
    times = copies(order_key(F.col(key), options.get("seed", "mix")), held)
    return met.withColumn(held, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
