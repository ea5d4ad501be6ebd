"""Products over papers, edges, clusters, atoms and candidates: queues, lifecycles, matching chains, coverage, searches, views of the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import ensure_checkpoints, staged
from . import relational

# Queues and samples


def queued(layers: dict[str, tuple[DataFrame, int, int]], key: str, most: int) -> DataFrame:
    """(key, priority, reasons): ids of several selections (key, rank) with priorities and limits, each id once with its best priority, the first `most`."""
    every = None
    for reason, (df, priority, limit) in layers.items():
        part = df.orderBy("rank", key).limit(limit).select(key, F.lit(priority).alias("priority"), F.lit(reason).alias("reason"))
        every = part if every is None else every.unionByName(part)
    once = every.groupBy(key).agg(F.min("priority").alias("priority"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return once.orderBy("priority", key).limit(most)


def representatives(df: DataFrame, cluster: str, score: str, key: str) -> DataFrame:
    """The best of each cluster, with the cluster's size; largest clusters first."""
    size = df.groupBy(cluster).agg(F.count("*").alias("n"), F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))).alias("b"))
    return size.select(cluster, "n", (-F.col("b.k")).alias(key), F.col("b.s").alias(score)).orderBy(F.desc("n"), F.desc(score), key)


def audit_sample(df: DataFrame, key: str, suspicious: Column, weight: str, most: int, seed: str) -> DataFrame:
    """Half suspicious rows by weight, the rest by a seeded hash, each once."""
    bad = df.filter(suspicious).orderBy(F.desc(weight), key).limit(max(1, most // 2)).select(key, F.lit(True).alias("suspicious"))
    rest = df.join(bad.select(key), key, "left_anti").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(most).select(key, F.lit(False).alias("suspicious"))
    return bad.union(rest).orderBy(F.desc("suspicious"), key).limit(most)


def in_priority(df: DataFrame, priority: str, order: tuple[str, ...], then: list[str]) -> DataFrame:
    """df with its rank by named priorities (others last), then by columns."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(priority)), F.lit(0)), F.lit(99))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(place, *then)))  # a queue of repairs, small by nature


def action_groups(df: DataFrame, group: str, key: str, order: list[Column], n: int) -> DataFrame:
    """(group, papers, contracts, examples): the first n examples of each action."""
    top = relational.top_per_key(df, [group], order, n).groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", key))), lambda x: x[key].cast("string")), ",").alias("examples"))
    return df.groupBy(group).agg(F.count_distinct(key).alias("papers"), F.count("*").alias("contracts")).join(top, group)


def spread_selection(candidates: DataFrame, key: str, score: str, vector: str, k: int, floor: float, balance: float = 0.7) -> DataFrame:
    """(key, pick): maximal marginal relevance among those whose cosine distance to all picks is at least floor; when none is left, the best of the rest."""
    ensure_checkpoints(candidates.sparkSession)

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)

    left = candidates.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(score).alias("s"), F.col(vector).alias("v"), F.lit(-1.0).alias("near")).checkpoint()
    picks: list = []
    for _ in range(k):
        close = F.greatest("near", F.lit(0.0)) if picks else F.lit(0.0)
        value = F.when(1 - F.col("near") >= floor, balance * F.col("s") - (1 - balance) * close)
        best = left.orderBy(F.desc_nulls_last(F.round(value, 12)), F.desc("s"), "id").limit(1).collect()
        if not best:
            break
        picks.append(best[0]["id"])
        chosen = F.array(*[F.lit(float(x)) for x in best[0]["v"]])
        cosine = dot(F.col("v"), chosen) / F.greatest(F.sqrt(dot(F.col("v"), F.col("v")) * dot(chosen, chosen)), F.lit(1e-12))
        left = left.filter(F.col("id") != F.lit(picks[-1])).withColumn("near", F.greatest("near", cosine)).checkpoint()
    kind = candidates.schema[key].dataType.simpleString()
    return candidates.sparkSession.createDataFrame([(p, i + 1) for i, p in enumerate(picks)], f"`{key}` {kind}, pick int")


def peers_share(df: DataFrame, key: str, age: str, rate: str, window: float = 6.0, least: int = 5) -> DataFrame:
    """(key, share): the share of papers of about the same age (window on either side) whose rate is at most its own; one half with fewer than `least` peers.

    Peers meet by slices of age of the window's width, which a paper's peers lie in or beside. In a slice papers are
    counted by age and rate first, so that what meets are different pairs of the two.
    """
    slot = F.floor(F.col(age) / window)
    kinds = df.select(slot.alias("slot"), F.col(age).alias("a"), F.col(rate).alias("r"))
    cells = staged(kinds.groupBy("slot", "a", "r").agg(F.count("*").alias("n")))
    near = cells.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))).select("slot", F.col("a").alias("b"), F.col("r").alias("q"), "n")
    met = cells.drop("n").join(near, "slot").filter(F.abs(F.col("a") - F.col("b")) <= window)
    share = met.groupBy("a", "r").agg(F.sum("n").alias("peers"), F.sum(F.when(F.col("q") <= F.col("r"), F.col("n")).otherwise(0)).alias("low"))
    out = df.select(key, F.col(age).alias("a"), F.col(rate).alias("r")).join(share, ["a", "r"])
    return out.select(key, F.when(F.col("peers") < least, 0.5).otherwise(F.col("low") / F.col("peers")).alias("share"))


# Evidence


def provenance_counts(sections: DataFrame, paper: str, name: str, strategies: str, grade: str, contract: str, current: str) -> DataFrame:
    """By paper, decision sections by strength, those of the current parser contract, and those of them that are of decision grade."""
    key = F.regexp_replace(F.lower(F.trim(F.col(name))), r"[\s-]+", "_")
    rows = sections.filter(key.isin(*rules.DECISION_SECTIONS)).select(paper, key.alias("_k"), rules.provenance_strength(F.col(strategies), F.col(grade)).alias("_s"), (F.col(contract) == current).alias("_c"))
    return rows.groupBy(paper).agg(
        *[F.count_if(F.col("_s") == s).alias(s) for s in ("strong", "moderate", "weak")], F.count("*").alias("total"), F.count_if("_c").alias("current_contract"), F.count_if(F.col("_c") & F.col("_s").isin("strong", "moderate")).alias("decision_grade"), F.array_join(F.sort_array(F.collect_set("_k")), ",").alias("section_names"),
    )


def strongest(sections: DataFrame, paper: str, strength: Column) -> DataFrame:
    """(strength, n): papers by their strongest section."""
    rank = F.when(strength == "strong", 3).when(strength == "moderate", 2).otherwise(1)
    best = sections.groupBy(paper).agg(F.max(rank).alias("_r"))
    return best.groupBy(F.element_at(F.array(F.lit("weak"), F.lit("moderate"), F.lit("strong")), F.col("_r")).alias("strength")).agg(F.count("*").alias("n"))


def quality_grades(atoms: DataFrame, key: str, quality: str) -> DataFrame:
    q = F.lower(F.trim(F.coalesce(F.nullif(F.col(quality), F.lit("")), F.lit("unknown"))))
    n = atoms.groupBy(key).agg(*[F.count_if(q.isin(*names)).alias(k) for k, names in (("s", rules.SECTION_QUALITIES), ("w", rules.WEAK_QUALITIES), ("m", rules.MODEL_QUALITIES))], F.count("*").alias("n"))
    return n.select(key, rules.grade_of(F.col("s"), F.col("w"), F.col("m"), F.col("n")).alias("grade"))


def labelled(df: DataFrame, *columns: str) -> DataFrame:
    """(kind, label, n): counts of labels; nulls and empty ones are unlabelled."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit("unlabeled")).alias("label")) for x in columns])).alias("x")
    return df.select(each).groupBy("x.kind", "x.label").agg(F.count("*").alias("n"))


def sampled_kinds(df: DataFrame, kind: Column, key: str, n: int) -> DataFrame:
    """(kind, n, samples): rows by kind, with the first n keys of each."""
    rows = df.withColumn("kind", kind)
    few = relational.top_per_key(rows, ["kind"], [F.col(key)], n).groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("samples"))
    return rows.groupBy("kind").agg(F.count("*").alias("n")).join(few, "kind")


def scope_of(papers: int, linked: int, nodes: int, edges: int, cap: int) -> dict:
    """Whether a subgraph is the whole graph or bounded, and whether that bound is enough."""
    if papers <= cap and nodes >= papers * 0.95:
        scope, label, advised = "complete_graph", "complete", papers
    else:
        scope, advised = "bounded_evidence_subgraph", min(papers, max(cap, 3000, int(papers * 0.08)))
        if nodes < 3000 or edges < nodes * 0.5:
            label, advised = "evidence_subgraph_sparse_increase_or_use_step10_full_graph", min(papers, max(advised, 8000))
        else:
            label = "bounded_evidence_subgraph_below_recommended_cap" if cap < advised else "bounded_evidence_subgraph_adequate_for_extraction"
    return {"conclusion_scope": scope, "adequacy_label": label, "recommended_max_size": advised, "node_coverage": nodes / max(1, papers), "edge_coverage": edges / max(1, linked), "edge_density": edges / max(1, nodes)}


def lifecycles(candidates: DataFrame, directions: DataFrame, cards: DataFrame) -> DataFrame:
    """candidates (src, dst, score, calibrated) with directions (src, dst, direction, tier, scope) and cards (direction, complete, high, grade, card_scope): state, missing gates, grade and scope."""
    rows = candidates.join(directions, ["src", "dst"], "left").join(cards, "direction", "left")
    fused, carded = F.col("direction").isNotNull(), F.col("complete").isNotNull()
    state = F.when(~fused, "future_candidate_unfused").when(~carded, "fused_direction_missing_claim_card").when(F.col("high"), "fused_to_radar_claim_card").when(F.col("complete"), "exploratory_claim_card").otherwise("candidate_pool_incomplete_claim_card")
    gates = F.when(~fused, F.array(F.lit("Step13 Claim Card"), F.lit("Step6 fusion direction"))).when(~carded, F.array(F.lit("Step13 Claim Card"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "src", "dst", "direction", state.alias("lifecycle_state"), F.array_join(gates, ",").alias("missing_gates"), F.coalesce("grade", F.when(fused & ~carded, F.coalesce("tier", F.lit("metadata_only")))).alias("_g"), F.coalesce("card_scope", "scope", F.lit("candidate_pool_only")).alias("claim_scope"), "score", "calibrated",
    ).withColumn("evidence_grade", F.coalesce("_g", F.lit("model_only"))).drop("_g")


def matching_chains(edges: DataFrame, chains: DataFrame, most: int = 12, shared: int = 2) -> DataFrame:
    """(edge, chain, score, rank): chains (chain, paper, tokens, complete, weight) that an edge (edge, src, dst, tokens) can use: of one of its papers, or with as many shared words.

    Words meet by an inverted index, papers by equality; never all edges with all chains.
    """
    word = lambda df, k: df.select(k, F.explode(F.array_distinct("tokens")).alias("t"))
    overlap = word(edges, "edge").join(word(chains, "chain"), "t").groupBy("edge", "chain").agg(F.count("*").alias("overlap"))
    ends = edges.select("edge", F.explode(F.array_distinct(F.array("src", "dst"))).alias("paper"))
    own = ends.join(chains.select("chain", "paper"), "paper").select("edge", "chain", F.lit(True).alias("of_paper")).distinct()
    met = overlap.join(own, ["edge", "chain"], "full").filter(F.coalesce("of_paper", F.lit(False)) | (F.col("overlap") >= shared))
    mine = F.coalesce(F.col("of_paper"), F.lit(False)).cast("int")
    score = 3 * mine + 2 * F.col("complete").cast("int") + F.col("weight") + F.least(F.coalesce("overlap", F.lit(0)), F.lit(6)) / 10.0
    rows = met.join(chains.select("chain", "complete", "weight"), "chain").select("edge", "chain", mine.alias("_m"), F.round(score, 9).alias("score"))
    return relational.top_per_key(rows, ["edge"], [F.desc("_m"), F.desc("score"), F.col("chain")], most).drop("_m")


def roles(selections: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, weight, roles): papers by the roles that several tables give them, weights added."""
    every = reduce(DataFrame.unionByName, [df.select(key, F.lit(r).alias("role"), F.lit(w).alias("w")).distinct() for r, (df, w) in selections.items()])
    return every.groupBy(key).agg(F.sum("w").alias("weight"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def with_counts(df: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """df with the number of rows that each table has for its key."""
    for name, t in tables.items():
        df = df.join(t.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return df.na.fill(0, list(tables))


def inverted(df: DataFrame, key: str, members: str) -> DataFrame:
    """(member, keys): which rows list each member."""
    return df.select(key, F.explode(members).alias("member")).groupBy("member").agg(F.sort_array(F.collect_set(key)).alias("keys"))


# Views of the graph


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def incident(edges: DataFrame, target, most: int) -> DataFrame:
    """(other, weight, is_main): the other ends of a node's edges (src, dst, weight, is_main), the heaviest edge to each, best first."""
    own = edges.filter((F.col("src") == target) | (F.col("dst") == target))
    other = F.when(F.col("src") == target, F.col("dst")).otherwise(F.col("src"))
    best = own.groupBy(other.alias("other")).agg(F.max("weight").alias("weight"), F.max(F.col("is_main").cast("int")).cast("boolean").alias("is_main"))
    return best.orderBy(F.desc("is_main"), F.desc("weight"), "other").limit(most)


def hydrated(hits: DataFrame, key: str, nodes: DataFrame, clusters: DataFrame, cluster: str) -> DataFrame:
    """Ranked hits (key, rank) with their nodes and clusters, in rank order; hits without a node stay out."""
    return hits.join(nodes, key).join(clusters, cluster, "left").orderBy("rank")


def near_nodes(edges: DataFrame, node, degree: int, most: int) -> DataFrame:
    """(other, hops): neighbours up to two steps of a node (src, dst both ways), one step only from a node of more than `degree`."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).filter("a <> b").distinct()
    one = both.filter(F.col("a") == node).select(F.col("b").alias("other"))
    calm = one.agg((F.count("*") <= degree).alias("_ok"))
    two = both.join(one.select(F.col("other").alias("a")), "a", "left_semi").crossJoin(F.broadcast(calm)).filter("_ok").select(F.col("b").alias("other")).filter(F.col("other") != node)
    found = one.withColumn("hops", F.lit(1)).union(two.withColumn("hops", F.lit(2))).groupBy("other").agg(F.min("hops").alias("hops"))
    return found.orderBy("hops", "other").limit(most)


def crossing_paths(edges: DataFrame, labels: DataFrame, a, b, most: int) -> DataFrame:
    """(src, mid, dst): paths of two edges (src, dst) from a node of label a to one of label b."""
    start, end = labels.filter(F.col("label") == a), labels.filter(F.col("label") == b)
    first = edges.join(start.select(F.col("node").alias("src")), "src", "left_semi").select("src", F.col("dst").alias("mid"))
    last = edges.join(end.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("mid"), "dst")
    return first.join(last, "mid").filter("src <> dst").orderBy("src", "mid", "dst").limit(most).select("src", "mid", "dst")


#: Queries by name, as templates with parameters; others are refused.
TEMPLATES = {
    "neighbours": "SELECT DISTINCT dst AS node FROM edges WHERE src = :node UNION SELECT src FROM edges WHERE dst = :node",
    "degree": "SELECT count(*) AS n FROM edges WHERE src = :node OR dst = :node",
}


def run_template(edges: DataFrame, name: str, **args) -> DataFrame:
    if name not in TEMPLATES:
        raise ValueError(f"no template {name}")
    return edges.sparkSession.sql(TEMPLATES[name].replace("FROM edges", "FROM {edges}"), args=args, edges=edges)


def evolution(edges: DataFrame, years: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges from older to newer with years, counts of what is skipped) of references (citing, cited)."""
    j = edges.join(years.toDF("citing", "dst_year"), "citing", "left").join(years.toDF("cited", "src_year"), "cited", "left")
    why = F.when(F.col("citing") == F.col("cited"), "missing_node").when(F.col("dst_year").isNull() | F.col("src_year").isNull(), "unknown_year").when(F.col("dst_year") == F.col("src_year"), "same_year").when(F.col("dst_year") < F.col("src_year"), "time_inverted").otherwise("evolution")
    j = staged(j.withColumn("why", why))
    return j.filter("why = 'evolution'").select(F.col("cited").alias("src"), F.col("citing").alias("dst"), "src_year", "dst_year"), j.groupBy("why").agg(F.count("*").alias("n"))


def negatives(nodes: DataFrame, positives: DataFrame, n: int, seed: str) -> DataFrame:
    """(src, dst): n seeded pairs of older and newer nodes (node, year, i: 0-based) that no positive (src, dst) links.

    Each draw picks both ends by hash, so that all is joins by number; twice the draws are made that chance needs, and the first n distinct ones count.
    """
    total = nodes.count()
    draws = nodes.sparkSession.range(4 * n + 64)
    pick = lambda end: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{end}|"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(max(total, 1)))
    ends = draws.select("id", pick("a").alias("ia"), pick("b").alias("ib"))
    j = ends.join(nodes.select(F.col("i").alias("ia"), F.col("node").alias("a"), F.col("year").alias("ya")), "ia").join(nodes.select(F.col("i").alias("ib"), F.col("node").alias("b"), F.col("year").alias("yb")), "ib").filter("ya <> yb")
    older = F.col("ya") < F.col("yb")
    pairs = j.select("id", F.when(older, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(older, F.col("b")).otherwise(F.col("a")).alias("dst"))
    once = pairs.groupBy("src", "dst").agg(F.min("id").alias("id")).join(positives.select("src", "dst"), ["src", "dst"], "left_anti")
    return once.orderBy("id").limit(n).select("src", "dst")


def keyword_bridges(papers: DataFrame, key: str, text: str, topic: str, words: dict[str, list[str]], weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((key, category) of papers that use a bridging word, edges to every paper of another topic); the first category that has a word counts.

    The edges are papers with such words times papers of other topics, which is what is asked for; topics meet topics first, so papers are joined by topic.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    category = F.coalesce(*[F.when(low.rlike(rules.literal(tuple(w.lower() for w in ws))), F.lit(k)) for k, ws in words.items()])
    all_ = papers.select(F.col(key).alias("id"), F.coalesce(F.col(topic), F.lit("unknown")).alias("topic"))
    told = papers.select(F.col(key).alias("id"), F.coalesce(F.col(topic), F.lit("unknown")).alias("topic"), category.alias("category")).filter("category is not null")
    topics = all_.select("topic").distinct()
    apart = told.select("topic").distinct().crossJoin(F.broadcast(topics.withColumnRenamed("topic", "other_topic"))).filter("topic <> other_topic")  # topics, not papers
    e = told.join(apart, "topic").join(all_.toDF("other", "other_topic"), "other_topic")
    pair = e.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), "category", (F.col("id") > F.col("other")).alias("_o"))
    once = pair.groupBy("src", "dst").agg(F.min_by("category", "_o").alias("category")).withColumn("weight", F.lit(weight))
    return told.select(F.col("id").alias(key), "category"), once


def betweenness(edges: DataFrame, sources: DataFrame, depth: int = 64) -> DataFrame:
    """(node, score): dependencies on shortest paths of an undirected graph (src, dst) from sampled sources (node), scaled to all nodes.

    Breadth first from all sources side by side, one join a level, then dependencies back level by level.
    """
    both = staged(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).filter("a <> b").distinct())
    n, k = both.select("a").distinct().count(), max(1, sources.count())
    seen = staged(sources.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    front, level = seen, 0
    while level < depth:
        nxt = both.join(front.select(F.col("node").alias("a"), "s", "paths"), "a").groupBy("s", F.col("b").alias("node")).agg(F.sum("paths").alias("paths")).join(seen.select("s", "node"), ["s", "node"], "left_anti")
        front = staged(nxt.select("s", "node", F.lit(level + 1).alias("d"), "paths"))
        if front.isEmpty():
            break
        seen, level = staged(seen.union(front)), level + 1
    total = seen.filter(F.col("d") == level).select("s", "node", F.lit(0.0).alias("dep"))
    score = total
    for d in range(level - 1, 0, -1):
        up = seen.filter(F.col("d") == d).select("s", "node", "paths")
        down = seen.filter(F.col("d") == d + 1).select("s", F.col("node").alias("b"), F.col("paths").alias("q")).join(total.select("s", F.col("node").alias("b"), "dep"), ["s", "b"])
        given = up.join(both.select(F.col("a").alias("node"), "b"), "node").join(down, ["s", "b"]).groupBy("s", "node").agg(F.sum(F.col("paths") / F.col("q") * (1 + F.col("dep"))).alias("dep"))
        total = staged(up.select("s", "node").join(given, ["s", "node"], "left").select("s", "node", F.coalesce("dep", F.lit(0.0)).alias("dep")))
        score = score.union(total)
    pairs = max(1, (n - 1) * (n - 2))
    return score.groupBy("node").agg((F.sum("dep") * (n / k) / pairs).alias("score")).filter("score > 0")


def communities(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """(node, cluster, size): clusters of a weighted undirected graph (a, b, weight) by label propagation, the heaviest label of a node's neighbours, its own weighing a little more and the least of equals winning; clusters are numbered by size.

    Nodes of two halves move in turn, by hash, so that neighbours do not swap labels for ever.
    """
    both = staged(edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")))
    labels = staged(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for i in range(rounds):
        got = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        own = got.join(labels.withColumnRenamed("label", "_own"), "node").withColumn("w", F.col("w") * F.when(F.col("label") == F.col("_own"), 1.001).otherwise(1.0))
        best = own.groupBy("node").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "label"))["label"].alias("_best"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        new = staged(labels.join(best, "node").select("node", F.col("label").alias("_old"), F.when(moves, F.col("_best")).otherwise(F.col("label")).alias("label")))
        labels = new.select("node", "label")
        if i % 2 and new.filter("label <> _old").isEmpty():
            break
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    number = size.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1)  # one row a cluster
    return labels.join(number, "label").select("node", "cluster", "size")


def lens(nodes: DataFrame, key: str, text: str, cluster: str, edges: DataFrame, terms: dict[int, list[str]], most: int) -> dict[str, DataFrame]:
    """A topic's seeds (key, score), its clusters (cluster, seeds, share) and the edges (src, dst) within what the seeds reach in one step."""
    score = rules.topic_relevance(F.col(text), terms.get(4, []), terms.get(2, []), terms.get(1, []))
    seeds = staged(nodes.select(key, cluster, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(most))
    spread = seeds.groupBy(cluster).agg(F.count("*").alias("seeds"), F.sum("score").alias("score")).withColumn("share", F.col("seeds") / F.sum("seeds").over(Window.partitionBy()))  # at most `most` rows
    ids = seeds.select(F.col(key).alias("node"))
    out = edges.join(ids.toDF("src"), "src", "left_semi").unionByName(edges.join(ids.toDF("dst"), "dst", "left_semi")).distinct()
    return {"seeds": seeds, "clusters": spread, "edges": out}
