"""Further queries: signals of papers, entity resolution, gates, evaluation by peers, walks. They join the catalog's registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import graph, relational, resolution, search, stats
from ..sources.tables import FOLLOW_SQL, follow_ups, table
from .catalog import _BM25, _COCITED, _OVER, ASKED, cocited, query

YEAR = 2000
_AGE = f"greatest(1, {YEAR} - year(o_orderdate) + 1)"
_P95 = "(SELECT greatest(1.0, v) FROM (SELECT {v}::DOUBLE AS v, row_number() OVER (ORDER BY {v}) - 1 AS i, count(*) OVER () AS n FROM b) WHERE i = floor(0.95 * (n - 1)))"


def forward(spark, d):
    """Citations from older to newer orders."""
    return follow_ups(spark, d).select(F.col("cited").alias("src"), F.col("citing").alias("dst"))


# Signals


@query(
    f"WITH {FOLLOW_SQL}, cit AS (SELECT cited AS k, count(*) AS n FROM follow GROUP BY cited), lnk AS (SELECT citing AS k, count(*) AS n FROM follow GROUP BY citing), ref AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey), "
    "nb AS (SELECT citing AS k, cited AS o FROM follow UNION SELECT cited, citing FROM follow), fld AS (SELECT k, count(DISTINCT o_orderpriority) AS n FROM nb JOIN orders ON o_orderkey = o GROUP BY k), "
    f"b AS (SELECT o_orderkey, year(o_orderdate) AS y, coalesce(cit.n, 0) / {_AGE}::DOUBLE AS rate, coalesce(ref.n, 0) AS refs, coalesce(lnk.n, 0) AS linked, coalesce(fld.n, 0) AS fields FROM orders LEFT JOIN cit ON cit.k = o_orderkey LEFT JOIN lnk ON lnk.k = o_orderkey LEFT JOIN ref ON ref.k = o_orderkey LEFT JOIN fld ON fld.k = o_orderkey), "
    f"s AS (SELECT *, least(1.0, rate / {_P95.format(v='rate')}) AS burst, least(1.0, refs / {_P95.format(v='refs')}) AS breadth FROM b) "
    f"SELECT o_orderkey, round(greatest(0.0, 1 - greatest(0, {YEAR} - y) / 35.0)::DOUBLE, 6) AS recency, round(burst, 6) AS burst, round(breadth, 6) AS breadth, round(least(1.0, linked / greatest(refs, 1)::DOUBLE), 6) AS cocite_breadth, round(least(1.0, fields / 26.0)::DOUBLE, 6) AS bridging, round(burst * (1 - least(breadth, 0.9)), 6) AS disruption FROM s"
)
def graph_signals(spark, d):
    """Signals of each order from its citations, both ways; rates are against the 95th percentile of all."""
    o, e = table(spark, d, "orders"), follow_ups(spark, d)

    def tally(df, key):
        return df.groupBy(F.col(key).alias("o_orderkey")).agg(F.count("*").alias("n"))

    near = graph.neighbours(forward(spark, d)).join(o.select(F.col("o_orderkey").alias("other"), "o_orderpriority"), "other")
    fields = near.groupBy(F.col("node").alias("o_orderkey")).agg(F.count_distinct("o_orderpriority").alias("fields"))
    b = o.select("o_orderkey", F.year("o_orderdate").alias("y"))
    for df, name in ((tally(e, "cited"), "cites"), (tally(e, "citing"), "linked"), (tally(table(spark, d, "lineitem"), "l_orderkey"), "refs")):
        b = b.join(df.withColumnRenamed("n", name), "o_orderkey", "left")
    b = b.join(fields, "o_orderkey", "left").na.fill(0).withColumn("rate", F.col("cites") / F.greatest(F.lit(1), YEAR - F.col("y") + 1))
    top = {v: stats.order_statistic(b, v, 0.95, 1.0) or 1.0 for v in ("rate", "refs")}
    burst, breadth = c.clip(F.col("rate") / top["rate"]), c.clip(F.col("refs") / top["refs"])
    out = {
        "recency": c.clip(1 - F.greatest(F.lit(0), YEAR - F.col("y")) / 35.0), "burst": burst, "breadth": breadth, "cocite_breadth": c.clip(F.col("linked") / F.greatest("refs", F.lit(1))),
        "bridging": c.clip(F.col("fields") / 26.0), "disruption": c.clip(burst * (1 - F.least(breadth, F.lit(0.9)))),
    }
    return b.select("o_orderkey", *[F.round(v, 6).alias(k) for k, v in out.items()])


_X = "o_totalprice / 500000.0"


@query(
    f"WITH x AS (SELECT o_orderkey, least(1.0, {_X})::DOUBLE AS s, CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 10) / 10.0 END::DOUBLE AS t FROM orders) SELECT o_orderkey, round(least(1.0, greatest(0.0, 0.5 + (s - 0.5) * least(1.0, greatest(0.2, 0.45 * s + 0.55 * 0.5)))), 6) AS adjusted, "
    "round(CASE WHEN t IS NULL THEN s ELSE (0.6 * s + 0.4 * t) END, 10) AS novelty, round((exp(0.5 * ln(s + 0.05) + 0.5 * ln(0.4 + 0.05)) - 0.05) * (0.85 + 0.15 * s), 6) AS geometric FROM x"
)
def adjusted_scores(spark, d):
    s = F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0)
    t = F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 10) / 10.0)
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(c.reliable(s, s, F.lit(0.5)), 6).alias("adjusted"), F.round(c.weighted_mean({"a": s, "b": t}, {"a": 0.6, "b": 0.4}), 10).alias("novelty"),
        F.round(c.geometric_score({"a": s, "b": F.lit(0.4)}, {"a": 0.5, "b": 0.5}, s), 6).alias("geometric"),
    )


@query(
    f"WITH m AS (SELECT o_custkey, avg(date_diff('day', o_orderdate::DATE, DATE '{YEAR}-01-01') / 30.4)::DOUBLE AS age FROM orders GROUP BY o_custkey) SELECT o_custkey, round(age, 6) AS age, "
    "round(CASE WHEN age <= 12 THEN 0.3 WHEN age >= 18 THEN 1.0 ELSE 0.3 + (age - 12) / 6 * 0.7 END + 1e-9, 6) AS cite_weight, round(CASE WHEN age <= 12 THEN 1.0 WHEN age >= 36 THEN 0.7 ELSE 1.0 - (age - 12) / 24 * 0.3 END + 1e-9, 6) AS cocite_weight FROM m"
)
def adaptive_edge_weights(spark, d):
    """Weights of edge kinds by the mean age in months of a customer's orders; 1e-9 is added before rounding, so that exact halves go up."""
    age = F.avg(F.datediff(F.lit(f"{YEAR}-01-01").cast("date"), "o_orderdate") / 30.4)
    m = table(spark, d, "orders").groupBy("o_custkey").agg(age.alias("age"))
    return m.select("o_custkey", F.round("age", 6).alias("age"), F.round(c.ramp(F.col("age"), 12, 0.3, 18, 1.0) + 1e-9, 6).alias("cite_weight"), F.round(c.ramp(F.col("age"), 12, 1.0, 36, 0.7) + 1e-9, 6).alias("cocite_weight"))


_CD = f"{FOLLOW_SQL}, e AS (SELECT DISTINCT * FROM follow), o AS (SELECT x.citing AS node, y.citing AS citer FROM e x JOIN e y ON y.cited = x.cited AND y.citing <> x.citing), u AS (SELECT node, citer, max(dd) AS dd, max(rr) AS rr FROM (SELECT cited AS node, citing AS citer, 1 AS dd, 0 AS rr FROM e UNION ALL SELECT node, citer, 0, 1 FROM o) GROUP BY ALL), g AS (SELECT node, (count(*) FILTER (WHERE rr = 0) - count(*) FILTER (WHERE rr = 1 AND dd = 1)) / count(*)::DOUBLE AS cd FROM u GROUP BY node), p AS (SELECT node, cd, o_orderpriority AS field, year(o_orderdate) AS y FROM g JOIN orders ON o_orderkey = node)"


@query(
    f"WITH {_CD} SELECT node, round(CASE WHEN n > 1 THEN cd - (s - cd) / (n - 1) ELSE cd END, 5) AS corrected, round(CASE WHEN n > 1 THEN (r - 1) / (n - 1)::DOUBLE ELSE (cd + 1) / 2 END, 6) AS share FROM "
    "(SELECT *, count(*) OVER g AS n, sum(cd) OVER g AS s, count(*) OVER (PARTITION BY field, y ORDER BY cd) AS r FROM p WINDOW g AS (PARTITION BY field, y))"
)
def cd_against_peers(spark, d):
    """Disruption less the mean of the peers of field and year, and the share of peers not above."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("field"), F.year("o_orderdate").alias("y"))
    p = graph.disruption(follow_ups(spark, d)).filter("cd is not null").select("node", "cd").join(o, "node")
    both = stats.share_at_most(stats.less_peers(p, ["field", "y"], "cd", "corrected"), ["field", "y"], "cd", (F.col("cd") + 1) / 2, "share")
    return both.select("node", F.round("corrected", 5).alias("corrected"), F.round("share", 6).alias("share"))


_DEGREE = f"WITH {FOLLOW_SQL}, nb AS (SELECT citing AS node, cited AS o FROM follow UNION SELECT cited, citing FROM follow), g AS (SELECT node, count(*)::DOUBLE AS degree FROM nb GROUP BY node), z AS (SELECT node, (degree - (SELECT avg(degree) FROM g)) / ((SELECT stddev_pop(degree) FROM g) + 1e-9) AS z FROM g)"


@query(f"{_DEGREE} SELECT node, round(z, 5) AS z, round(least(1.0, greatest(0.0, (z + 3) / 6)), 5) AS share FROM z WHERE z >= 0")
def bridging_scores(spark, d):
    g = graph.neighbours(forward(spark, d)).groupBy("node").agg(F.count("*").cast("double").alias("degree"))
    z = stats.standard_score(g, "degree", "z").filter("z >= 0")
    return z.select("node", F.round("z", 5).alias("z"), F.round(c.clip((F.col("z") + 3) / 6), 5).alias("share"))


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, quantile_cont(o_totalprice, 0.9) OVER (PARTITION BY o_orderpriority) AS cut FROM orders) WHERE o_totalprice >= cut")
def high_mutations(spark, d):
    """Orders that reach the interpolated 90th percentile of their priority."""
    o = table(spark, d, "orders")
    cut = o.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.9).alias("cut"))
    return o.join(F.broadcast(cut), "o_orderpriority").filter("o_totalprice >= cut").select("o_orderkey", "o_orderpriority")


@query(f"SELECT o_orderkey, round(score, 6) AS score FROM (SELECT o_orderkey, 0.5 * least(1.0, {_X}) + 0.3 * (o_custkey % 10) / 10.0 + 0.2 * (o_orderkey % 7) / 7.0 AS score FROM orders) ORDER BY round(score, 9) DESC, o_orderkey LIMIT 30")
def landmarks(spark, d):
    score = 0.5 * F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0) + 0.3 * (F.col("o_custkey") % 10) / 10.0 + 0.2 * (F.col("o_orderkey") % 7) / 7.0
    best = table(spark, d, "orders").select("o_orderkey", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "o_orderkey").limit(30)
    return best.select("o_orderkey", F.round("score", 6).alias("score"))


@query("SELECT l_suppkey, max(l_discount) AS worst, round(avg(l_discount), 8) AS mean, round(quantile_cont(l_discount, 0.5), 8) AS median FROM lineitem GROUP BY l_suppkey")
def severity_methods(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_discount").alias("worst"), F.round(F.avg("l_discount"), 8).alias("mean"), F.round(F.percentile("l_discount", 0.5), 8).alias("median"))


# Scopes and gates


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey % 9 = 0 OR year(o_orderdate) BETWEEN 1994 AND 1996) AND o_totalprice >= 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def residual_filters(spark, d):
    """A year that is not known passes the range; every ninth customer's is not."""
    year = F.when(F.col("o_custkey") % 9 != 0, F.year("o_orderdate"))
    o = table(spark, d, "orders").filter(year.isNull() | year.between(1994, 1996)).filter((F.col("o_totalprice") >= 50000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, 'keyword' AS source FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_type), 'small')")
def keyword_scope(spark, d):
    hit = F.lower("p_name").contains("widget") | F.lower("p_type").contains("small")
    return table(spark, d, "part").filter(hit).select("p_partkey", F.lit("keyword").alias("source"))


_K = "lpad(p_partkey::VARCHAR, 5, '0')"


@query(
    f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'work' WHEN 3 THEN 'arxiv' ELSE 'unknown' END AS provider, CASE p_partkey % 5 WHEN 0 THEN '10.1234/abc.' || {_K} WHEN 1 THEN '2101.' || {_K} WHEN 2 THEN 'W' || {_K} WHEN 3 THEN '9912.' || {_K} END AS norm, CASE p_partkey % 5 WHEN 1 THEN 2021 WHEN 3 THEN 1999 END::INTEGER AS year FROM part"
)
def identifier_classes(spark, d):
    """Raw identifiers in the forms they come in, their provider, normal form and year."""
    k = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    forms = [("https://doi.org/10.1234/ABC.", "?x=1"), ("arXiv:2101.", "v2"), ("https://works.example.org/w", ""), ("10.48550/arXiv.9912.", ""), ("no id ", "")]
    raw = F.element_at(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in forms]), (F.col("p_partkey") % 5 + 1).cast("int"))
    ids = table(spark, d, "part").select("p_partkey", c.external_id(raw).alias("i"))
    return ids.select("p_partkey", "i.provider", "i.norm", F.when(F.col("i.provider") == "arxiv", c.arxiv_year(F.col("i.norm"))).alias("year"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n_cited, count(p_partkey)::BIGINT AS n_known, CASE WHEN count(*) = count(p_partkey) THEN 'accepted' ELSE 'rejected' END AS verdict FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = l_partkey GROUP BY l_orderkey")
def claim_gate(spark, d):
    """Claims (orders) whose evidence (parts) is all in the pool."""
    claims = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("cited"))
    return resolution.gatekeep(claims, "l_orderkey", "cited", table(spark, d, "part").filter("p_partkey % 10 <> 0"), "p_partkey")


@query("SELECT o_custkey, o_orderpriority AS top, round(n / t, 6) AS ratio, n / t < 0.5 AS crosses FROM (SELECT *, sum(n) OVER (PARTITION BY o_custkey)::DOUBLE AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def dominant_topic(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = n.groupBy("o_custkey").agg(F.min(F.struct(-F.col("n"), "o_orderpriority")).alias("b"), F.sum("n").alias("t"))
    ratio = -F.col("b.col1") / F.col("t")
    return best.select("o_custkey", F.col("b.o_orderpriority").alias("top"), F.round(ratio, 6).alias("ratio"), (ratio < 0.5).alias("crosses"))


_CHECKS = {"questions": "o_orderkey % 2 = 0", "section": "o_custkey % 3 <> 0", "provenance": "o_orderkey % 5 <> 0", "auc": "o_totalprice >= 65000", "score": "o_totalprice >= 70000"}


@query("SELECT o_orderkey, CASE " + " ".join(f"WHEN NOT ({v}) THEN '{k}'" for k, v in _CHECKS.items()) + " ELSE 'high_confidence' END AS state, " + " + ".join(f"CASE WHEN {v} THEN 0 ELSE 1 END" for v in _CHECKS.values()) + " AS n_gaps FROM orders")
def claim_card_gates(spark, d):
    """The first gate that a card fails, and how many."""
    checks = {k: F.expr(v) for k, v in _CHECKS.items()}
    return table(spark, d, "orders").select("o_orderkey", c.first_gap(checks, "high_confidence").alias("state"), F.size(c.gaps(checks)).alias("n_gaps"))


@query("WITH n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM embeddings) AS vectors) SELECT CASE WHEN docs = 0 THEN 'no_documents' WHEN labels * 10 < docs THEN 'few_labels' WHEN vectors = 0 THEN 'no_vectors' ELSE 'ready' END AS state FROM n")
def release_state(spark, d):
    one = [table(spark, d, t).agg(F.count("*").alias(t)) for t in ("documents", "labels", "embeddings")]
    checks = {"no_documents": F.col("documents") > 0, "few_labels": F.col("labels") * 10 >= F.col("documents"), "no_vectors": F.col("embeddings") > 0}
    return one[0].crossJoin(one[1]).crossJoin(one[2]).select(c.first_gap(checks, "ready").alias("state"))  # one row each


# Resolution and queues


_NAMES = "t AS (SELECT l_orderkey, list_sort(list_distinct(list(p_name || p_brand))) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey), u AS (SELECT s, min(l_orderkey) AS id FROM t WHERE len(s) >= 3 GROUP BY s)"


@query(f"WITH {_NAMES}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS k, len(a.s) + len(b.s) AS n FROM u a JOIN u b ON a.id < b.id AND list_has_any(a.s, b.s)) SELECT a, b, round(k / (n - k)::DOUBLE, 6) AS similarity FROM p WHERE k >= 0.4 * (n - k) - 1e-9")
def fuzzy_matches(spark, d):
    """Orders whose sets of part names are similar."""
    part = table(spark, d, "part").select("p_partkey", F.concat("p_name", "p_brand").alias("t"))
    words = resolution.numbered(part.groupBy("t").agg(F.count("*").alias("n")))
    held = table(spark, d, "lineitem").join(part.join(words, "t"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "number")
    named = held.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set("number").alias("s"))  # rows travel without buffers of sets
    return resolution.similar_number_sets(named, "l_orderkey", F.col("s"), 0.4, 3).withColumn("similarity", F.round("similarity", 6))


_PENALTY = "CASE WHEN o = 'R' THEN 2200 WHEN o = 'N' THEN 450 ELSE 0 END"


@query(f"WITH g AS (SELECT l_partkey, count(*) AS n, max(l_quantity) AS m, sum(l_quantity) AS s, arg_max(l_returnflag, l_orderkey * 100 + l_linenumber) AS o FROM lineitem GROUP BY l_partkey) SELECT l_partkey, n::BIGINT AS n, round(greatest(0.0, m + 18 * sqrt(n - 1) + least(80.0, 0.05 * s) - {_PENALTY}), 4) AS priority FROM g")
def backfill_priority(spark, d):
    return resolution.repair_priority(table(spark, d, "lineitem"), "l_partkey", "l_quantity", "l_returnflag", F.col("l_orderkey") * 100 + F.col("l_linenumber"), {"R": 2200, "N": 450})


@query("SELECT c_nationkey, floor(i / 2)::INTEGER AS game, arg_min(c_custkey, i) AS a, max(c_custkey) FILTER (WHERE i % 2 = 1) AS b FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS i FROM customer) GROUP BY ALL")
def swiss_round(spark, d):
    return resolution.swiss_pairs(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT user_id, event_id, event_type FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS r FROM events e JOIN (SELECT user_id, arg_max(event_type, event_id) AS now FROM events GROUP BY user_id) n ON n.user_id = e.user_id AND n.now <> e.event_type) WHERE r = 1")
def previous_snapshot(spark, d):
    """Each user's latest event of another type than the last one."""
    e = table(spark, d, "events")
    now = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("now"))
    return relational.latest_per_key(e.join(now, "user_id").filter("event_type <> now"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT source, sum(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '-')), 1, 8))::BIGINT)::BIGINT AS signature FROM documents GROUP BY source")
def input_signature(spark, d):
    """A digest of each source's rows that does not depend on their order, to tell stale results; nulls count too."""
    digest = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit("-"))).cast("binary")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.sum(digest).alias("signature"))


# Graphs


@query(f"WITH {FOLLOW_SQL} SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT citing FROM follow) AND o_orderkey NOT IN (SELECT cited FROM follow) AND year(o_orderdate) >= 1997 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def terminals(spark, d):
    """Ends of citation paths since 1997, the 50 largest."""
    e = follow_ups(spark, d)
    ends = e.select(F.col("citing").alias("o_orderkey")).distinct().join(e.select(F.col("cited").alias("o_orderkey")), "o_orderkey", "left_anti")
    return table(spark, d, "orders").join(ends, "o_orderkey", "left_semi").filter(F.year("o_orderdate") >= 1997).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


_SEEDS = "seed AS (SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 250000)"


@query(f"WITH {FOLLOW_SQL}, {_SEEDS}, nb AS (SELECT citing AS node, cited AS o FROM follow UNION SELECT cited, citing FROM follow) SELECT DISTINCT o AS node, o_totalprice AS score FROM nb JOIN orders ON o_orderkey = o WHERE node IN (SELECT node FROM seed) AND o NOT IN (SELECT node FROM seed) ORDER BY o_totalprice DESC, o LIMIT 200")
def neighbour_expansion(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("score"))
    return graph.expand(forward(spark, d), o.filter("score > 250000").select("node"), o, 200)


@query(f"WITH RECURSIVE {FOLLOW_SQL}, {_SEEDS}, nb AS (SELECT citing AS node, cited AS o FROM follow UNION SELECT cited, citing FROM follow), walk AS (SELECT node, 0 AS hops FROM seed UNION SELECT o, hops + 1 FROM walk JOIN nb ON nb.node = walk.node WHERE hops < 3) SELECT node, min(hops)::INTEGER AS hops FROM walk GROUP BY node")
def bounded_hops(spark, d):
    seeds = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("node"))
    return graph.hops(forward(spark, d), seeds, 3)


@query(f"WITH RECURSIVE {FOLLOW_SQL}, {_SEEDS}, walk AS (SELECT node AS seed, node, 0 AS k FROM seed UNION ALL SELECT seed, cited, k + 1 FROM walk JOIN follow ON citing = node WHERE k < 3) SELECT seed, node, count(*)::BIGINT AS ways FROM walk WHERE k > 0 GROUP BY ALL HAVING count(*) > 1")
def common_ancestors(spark, d):
    """What a seed reaches by more than one chain of up to three citations."""
    seeds = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("node"))
    back = follow_ups(spark, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst"))
    return graph.ways(back, seeds, 3).filter("ways > 1")


@query(f"WITH {FOLLOW_SQL} SELECT CASE WHEN x.o_orderkey % 13 = 0 THEN 'unknown_time' WHEN strftime(x.o_orderdate, '%Y-%m') < strftime(y.o_orderdate, '%Y-%m') THEN 'forward' ELSE 'same_time' END AS status, count(*)::BIGINT AS n FROM follow JOIN orders x ON x.o_orderkey = cited JOIN orders y ON y.o_orderkey = citing GROUP BY 1")
def temporal_status(spark, d):
    """Citations by how the months stand to each other; every thirteenth month is not known."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    e = follow_ups(spark, d).join(o.toDF("cited", "older"), "cited").join(o.toDF("citing", "newer"), "citing")
    return e.groupBy(c.order_of(F.when(F.col("cited") % 13 != 0, F.col("older")), F.col("newer")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {FOLLOW_SQL}, nb AS (SELECT citing AS node, cited AS o FROM follow UNION SELECT cited, citing FROM follow) SELECT node, round(least(1.0, count(*) FILTER (WHERE y.o_orderpriority <> x.o_orderpriority) / 20.0)::DOUBLE, 6) AS share FROM nb JOIN orders x ON x.o_orderkey = node JOIN orders y ON y.o_orderkey = o GROUP BY node")
def cross_topic_neighbours(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    e = graph.neighbours(forward(spark, d)).join(o.toDF("node", "own"), "node").join(o.toDF("other", "theirs"), "other")
    return e.groupBy("node").agg(F.round(F.least(F.lit(1.0), F.count_if(F.col("own") != F.col("theirs")) / 20.0), 6).alias("share"))


@query(f"WITH {_COCITED} SELECT min(weight)::BIGINT AS least, max(weight)::BIGINT AS most, round(avg(weight), 6) AS mean, quantile_cont(weight, 0.5)::DOUBLE AS median FROM pair")
def edge_weights(spark, d):
    return cocited(spark, d).agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.round(F.avg("weight"), 6).alias("mean"), F.percentile("weight", 0.5).alias("median"))


@query("SELECT label, lod::INTEGER AS lod, n::BIGINT AS n, x, y FROM (SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY label), range(4) t(lod)")
def cluster_tiles(spark, d):
    """Centres and sizes of clusters, at four levels of detail."""
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.element_at("embedding", i).cast("double")), 6).alias(k) for i, k in ((1, "x"), (2, "y"))])
    return n.select("label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lod"), "n", "x", "y")


@query("WITH b AS (SELECT o_orderpriority AS branch, (SELECT min(year(o_orderdate)) FROM orders) AS y0, year(o_orderdate) AS y FROM orders), n AS (SELECT (y0 + 5 * ((y - y0) // 5))::INTEGER AS since, branch, count(*)::BIGINT AS n FROM b GROUP BY ALL) SELECT since, branch, n, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY since ORDER BY n DESC, branch) AS r FROM n) WHERE r <= 3")
def story_steps(spark, d):
    """The largest branches of each span of five years."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("branch"), F.year("o_orderdate").alias("y"))
    first = o.agg(F.min("y").alias("y0"))
    since = (F.col("y0") + 5 * F.floor((F.col("y") - F.col("y0")) / 5)).cast("int")
    n = o.crossJoin(F.broadcast(first)).groupBy(since.alias("since"), "branch").agg(F.count("*").alias("n"))
    return relational.top_per_key(n, ["since"], [F.desc("n"), F.col("branch")], 3).select("since", "branch", "n", "rank")


@query()
def strengths(spark, d):
    """Bradley-Terry strengths of part brands that meet in an order; the dearer line wins."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    after = F.lead(F.struct("p_brand", "l_extendedprice")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    met = li.withColumn("o", after).filter("o is not null and o.l_extendedprice <> l_extendedprice")
    ahead = F.col("l_extendedprice") > F.col("o.l_extendedprice")
    games = met.select(F.when(ahead, F.col("p_brand")).otherwise(F.col("o.p_brand")).alias("winner"), F.when(ahead, F.col("o.p_brand")).otherwise(F.col("p_brand")).alias("loser"))
    return stats.bradley_terry(games).withColumn("strength", F.round("strength", 6))


@query()
def local_rank(spark, d):
    e = follow_ups(spark, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst"), F.lit(1.0).alias("weight"))
    seeds = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("node"))
    return graph.local_pagerank(e, seeds, rounds=15).withColumn("rank", F.round("rank", 9))


# Retrieval


@query(
    f"WITH {_BM25}, {_OVER}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS e FROM bm QUALIFY e <= 60), b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS f FROM ov QUALIFY f <= 60), "
    "m AS (SELECT doc_id, CASE WHEN f IS NULL THEN 'exact' WHEN e IS NULL THEN 'fuzzy' ELSE 'exact+fuzzy' END AS mode, row_number() OVER (ORDER BY e NULLS LAST, f NULLS LAST, doc_id) AS rank FROM a FULL JOIN b USING (doc_id)) SELECT doc_id, mode, rank::INTEGER AS rank FROM m WHERE rank <= 80"
)
def hybrid_hits(spark, d):
    """Documents by exact words first, then those only the overlap list has."""
    docs = table(spark, d, "documents")
    exact, fuzzy = (search.ranked_list(f(docs, "doc_id", "text", ASKED), "doc_id", 60) for f in (search.bm25, search.overlap))
    return resolution.merged_hits(exact, fuzzy, "doc_id", 80)
