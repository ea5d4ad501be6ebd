"""Queries over the products. Parts stand in for papers with brands as clusters, orders for papers with years, lines for atoms and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import graph, products
from ..sources.tables import FOLLOW_SQL, baskets, follow_ups, table
from .catalog import query
from .rules import c

# Queues and samples


@query(
    "WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60), b AS (SELECT p_partkey FROM part WHERE p_size > 40 ORDER BY p_size DESC, p_partkey LIMIT 80), u AS (SELECT p_partkey, 1 AS priority, 'top' AS reason FROM a UNION ALL SELECT p_partkey, 2, 'large' FROM b) "
    "SELECT p_partkey, min(priority)::INTEGER AS priority, string_agg(reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY p_partkey ORDER BY priority, p_partkey LIMIT 100"
)
def candidate_queue(spark, d):
    p = table(spark, d, "part")
    top, large = p.select("p_partkey", (-c("p_retailprice")).alias("rank")), p.filter("p_size > 40").select("p_partkey", (-c("p_size")).alias("rank"))
    return products.queued({"top": (top, 1, 60), "large": (large, 2, 80)}, "p_partkey", 100)


@query("SELECT p_brand, count(*)::BIGINT AS n, arg_min(p_partkey, {'s': -p_size, 'k': p_partkey}) AS p_partkey, max(p_size) AS p_size FROM part GROUP BY p_brand")
def cluster_representatives(spark, d):
    return products.representatives(table(spark, d, "part"), "p_brand", "p_size", "p_partkey")


@query("WITH s AS (SELECT p_partkey FROM part WHERE p_size % 7 = 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 20), r AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM s) ORDER BY md5('x|' || p_partkey), p_partkey LIMIT 40) SELECT p_partkey, suspicious FROM (SELECT p_partkey, true AS suspicious FROM s UNION ALL SELECT p_partkey, false FROM r) ORDER BY suspicious DESC, p_partkey LIMIT 40")
def audit_samples(spark, d):
    return products.audit_sample(table(spark, d, "part"), "p_partkey", c("p_size") % 7 == 0, "p_retailprice", 40, "x")


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 99 END, c_custkey)::INTEGER AS rank FROM customer")
def repair_order(spark, d):
    return products.in_priority(table(spark, d, "customer"), "c_mktsegment", ("MACHINERY", "BUILDING"), ["c_custkey"]).select("c_custkey", "rank")


@query("SELECT l_returnflag, count(DISTINCT l_orderkey)::BIGINT AS papers, count(*)::BIGINT AS contracts, (SELECT string_agg(k, ',' ORDER BY r) FROM (SELECT l_orderkey::VARCHAR AS k, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem b WHERE b.l_returnflag = a.l_returnflag) WHERE r <= 3) AS examples FROM lineitem a GROUP BY l_returnflag")
def repair_groups(spark, d):
    return products.action_groups(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey", [F.desc("l_extendedprice"), c("l_orderkey"), c("l_linenumber")], 3)


@query()
def spread_selection(spark, d):
    e = table(spark, d, "embeddings").withColumn("score", (c("vec_id") % 97) / 97.0)
    return products.spread_selection(e, "vec_id", "score", "embedding", 10, 0.3)


_PEERS = "SELECT o_orderkey, greatest(1, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') / 30.4)::DOUBLE AS age, o_orderkey % 50 AS cites FROM orders WHERE o_orderkey % 20 = 0"


def aged(spark, d):
    age = F.greatest(F.lit(1.0), F.datediff(F.lit("2000-01-01").cast("date"), c("o_orderdate").cast("date")) / 30.4)
    return table(spark, d, "orders").filter(c("o_orderkey") % 20 == 0).select("o_orderkey", age.alias("age"), ((c("o_orderkey") % 50) / F.greatest(F.lit(0.5), age / 12)).alias("rate"))


@query(f"WITH p AS (SELECT o_orderkey, age, cites / greatest(0.5, age / 12) AS rate FROM ({_PEERS})) SELECT a.o_orderkey, round(CASE WHEN count(*) < 5 THEN 0.5 ELSE count(*) FILTER (b.rate <= a.rate) / count(*)::DOUBLE END, 6) AS share FROM p a JOIN p b ON abs(a.age - b.age) <= 6 GROUP BY a.o_orderkey")
def venue_percentiles(spark, d):
    """Papers here are every twentieth order, which the stand-in of a corpus has; the share of peers of half a year."""
    return products.peers_share(aged(spark, d), "o_orderkey", "age", "rate").withColumn("share", F.round("share", 6))


@query("SELECT o_orderkey FROM orders, (SELECT quantile_cont(o_totalprice, 0.95) AS cut FROM orders) WHERE cut > 0 AND o_totalprice >= cut")
def purple_mutations(spark, d):
    """Orders that reach the interpolated 95th percentile, if that is above 0."""
    o = table(spark, d, "orders")
    cut = o.agg(F.percentile("o_totalprice", 0.95).alias("cut"))
    return o.crossJoin(F.broadcast(cut)).filter("cut > 0 and o_totalprice >= cut").select("o_orderkey")


@query("WITH x AS (SELECT o_orderkey, (o_custkey % 10) / 10.0 AS cd FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '2000-01-01') / 30.4375 >= 36) SELECT o_orderkey FROM x WHERE cd > 0.3")
def red_mutations(spark, d):
    from ..functions import columns

    mature = columns.lifecycle(c("o_orderdate"), F.lit("2000-01-01").cast("date")) == "mature"
    return table(spark, d, "orders").filter(mature & ((c("o_custkey") % 10) / 10.0 > 0.3)).select("o_orderkey")


# Evidence

_SECTION = "s AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'Future Work' WHEN 1 THEN 'results' WHEN 2 THEN ' Methods' ELSE 'intro' END AS name, CASE l_partkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS strength, l_suppkey % 2 = 0 AS current FROM lineitem)"


def sections(spark, d):
    names = F.array(*map(F.lit, ("Future Work", "results", " Methods", "intro")))
    kinds = F.array(*[F.array(F.lit(x)) for x in ("explicit_heading", "inline_heading", "parser_hint")])
    return table(spark, d, "lineitem").select("l_orderkey", F.get(names, (c("l_linenumber") % 4).cast("int")).alias("name"), F.get(kinds, (c("l_partkey") % 3).cast("int")).alias("strategies"), F.lit("").alias("grade"), F.when(c("l_suppkey") % 2 == 0, "v3").otherwise("v1").alias("contract"))


@query(f"WITH {_SECTION} SELECT l_orderkey, count(*) FILTER (strength = 'strong')::BIGINT AS strong, count(*) FILTER (strength = 'moderate')::BIGINT AS moderate, count(*) FILTER (strength = 'weak')::BIGINT AS weak, count(*)::BIGINT AS total, count(*) FILTER (current)::BIGINT AS current_contract, count(*) FILTER (current AND strength <> 'weak')::BIGINT AS decision_grade, string_agg(DISTINCT CASE name WHEN 'Future Work' THEN 'future_work' WHEN ' Methods' THEN 'methods' ELSE name END, ',' ORDER BY CASE name WHEN 'Future Work' THEN 'future_work' WHEN ' Methods' THEN 'methods' ELSE name END) AS section_names FROM s WHERE name <> 'intro' GROUP BY l_orderkey")
def section_provenance(spark, d):
    return products.provenance_counts(sections(spark, d), "l_orderkey", "name", "strategies", "grade", "contract", "v3")


@query(f"WITH {_SECTION}, b AS (SELECT l_orderkey, max(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS r FROM s GROUP BY l_orderkey) SELECT ['weak', 'moderate', 'strong'][r] AS strength, count(*)::BIGINT AS n FROM b GROUP BY r")
def strongest_sections(spark, d):
    s = sections(spark, d)
    return products.strongest(s, "l_orderkey", rules.provenance_strength(c("strategies"), c("grade")))


@query("WITH q AS (SELECT l_orderkey, l_partkey % 5 AS k FROM lineitem), n AS (SELECT l_orderkey, count(*) FILTER (k IN (0, 1)) AS s, count(*) FILTER (k = 2) AS w, count(*) FILTER (k = 3) AS m, count(*) AS n FROM q GROUP BY 1) SELECT l_orderkey, CASE WHEN s >= 3 AND s / n::DOUBLE >= 0.7 THEN 'strong_section' WHEN s >= 1 AND s / n::DOUBLE >= 0.35 THEN 'moderate_section' WHEN w > 0 AND s = 0 THEN 'weak_abstract' WHEN m > 0 AND s = 0 AND w = 0 THEN 'model_only' ELSE 'metadata_only' END AS grade FROM n")
def grades_by_paper(spark, d):
    names = F.array(F.lit("Section_Level "), F.lit("primary_section"), F.lit("abstract"), F.lit("model_only"), F.lit(None).cast("string"))
    return products.quality_grades(table(spark, d, "lineitem").select("l_orderkey", F.get(names, (c("l_partkey") % 5).cast("int")).alias("q")), "l_orderkey", "q")


@query("SELECT 'status' AS kind, CASE WHEN o_orderstatus = 'F' THEN 'unlabeled' ELSE o_orderstatus END AS label, count(*)::BIGINT AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'unlabeled'), count(*) FROM orders GROUP BY 2")
def calibration_labels(spark, d):
    o = table(spark, d, "orders").select(F.when(c("o_orderstatus") == "F", "").otherwise(c("o_orderstatus")).alias("status"), F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).alias("priority"))
    return products.labelled(o, "status", "priority")


@query("SELECT l_returnflag AS label, round(avg(CASE WHEN l_linenumber = 1 THEN l_discount END), 6) AS positive, round(avg(CASE WHEN l_linenumber > 1 THEN l_discount END), 6) AS negative FROM lineitem GROUP BY 1")
def calibration_by_class(spark, d):
    first = c("l_linenumber") == 1
    return table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("label")).agg(F.round(F.avg(F.when(first, c("l_discount"))), 6).alias("positive"), F.round(F.avg(F.when(~first, c("l_discount"))), 6).alias("negative"))


@query("WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 11 = 0 THEN 'missing' WHEN l_partkey % 2 = 0 THEN 'doi' ELSE 'other' END AS kind FROM lineitem) SELECT kind, count(*)::BIGINT AS n, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM r b WHERE b.kind = a.kind ORDER BY id LIMIT 4)) AS samples FROM r a GROUP BY kind")
def reference_taxonomy(spark, d):
    kind = F.when(c("l_partkey") % 11 == 0, "missing").when(c("l_partkey") % 2 == 0, "doi").otherwise("other")
    return products.sampled_kinds(table(spark, d, "lineitem").withColumn("id", c("l_orderkey") * 10 + c("l_linenumber")), kind, "id", 4)


@query(f"WITH {FOLLOW_SQL}, x AS (SELECT (SELECT count(*) FROM orders) AS p, (SELECT count(*) FROM follow) AS l, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS n, (SELECT count(*) FROM follow WHERE citing % 3 = 0 AND cited % 3 = 0) AS e) SELECT 'bounded_evidence_subgraph' AS conclusion_scope, CASE WHEN n < 3000 OR e < n * 0.5 THEN 'evidence_subgraph_sparse_increase_or_use_step10_full_graph' WHEN 100 < least(p, greatest(100, 3000, floor(p * 0.08))) THEN 'bounded_evidence_subgraph_below_recommended_cap' ELSE 'bounded_evidence_subgraph_adequate_for_extraction' END AS adequacy_label, round(n / p::DOUBLE, 6) AS node_coverage, round(e / l::DOUBLE, 6) AS edge_coverage FROM x")
def subgraph_scope(spark, d):
    o, e = table(spark, d, "orders"), follow_ups(spark, d)
    inside = (c("citing") % 3 == 0) & (c("cited") % 3 == 0)
    linked, edges = e.agg(F.count("*"), F.count_if(inside)).first()
    got = products.scope_of(o.count(), linked, o.filter("o_orderkey % 3 = 0").count(), edges, 100)
    return spark.createDataFrame([(got["conclusion_scope"], got["adequacy_label"], round(got["node_coverage"], 6), round(got["edge_coverage"], 6))], "conclusion_scope string, adequacy_label string, node_coverage double, edge_coverage double")


@query("SELECT o_custkey, count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS legacy, round(avg(CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 1.0 END * (o_orderkey % 10) / 10.0), 6) AS weight FROM orders GROUP BY o_custkey")
def knowledge_summary(spark, d):
    """Entries (orders) of each base (customer): how many, how many legacy, and their mean weight after decay."""
    legacy = c("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(legacy).alias("legacy"), F.round(F.avg(F.when(legacy, 0.5).otherwise(1.0) * (c("o_orderkey") % 10) / 10.0), 6).alias("weight"))


_LIFE = f"{FOLLOW_SQL}, k AS (SELECT cited AS src, citing AS dst, (cited % 100) / 100.0 AS score FROM follow), dir AS (SELECT src, dst, src * 1000000 + dst AS direction, CASE WHEN src % 2 = 0 THEN 'exploratory' END AS tier, 'exploratory_hypothesis' AS scope FROM k WHERE src % 3 = 0), card AS (SELECT direction, dst % 5 <> 0 AS complete, dst % 7 = 0 AS high, 'strong_section' AS grade, CASE WHEN dst % 2 = 0 THEN 'candidate_direction' END AS card_scope FROM dir WHERE dst % 4 <> 0)"


@query(f"WITH {_LIFE} SELECT src, dst, CASE WHEN direction IS NULL THEN 'future_candidate_unfused' WHEN complete IS NULL THEN 'fused_direction_missing_claim_card' WHEN high THEN 'fused_to_radar_claim_card' WHEN complete THEN 'exploratory_claim_card' ELSE 'candidate_pool_incomplete_claim_card' END AS lifecycle_state, CASE WHEN direction IS NULL THEN 'Step13 Claim Card,Step6 fusion direction' WHEN complete IS NULL THEN 'Step13 Claim Card' ELSE '' END AS missing_gates, coalesce(grade, CASE WHEN direction IS NOT NULL THEN coalesce(tier, 'metadata_only') END, 'model_only') AS evidence_grade, coalesce(card_scope, scope, 'candidate_pool_only') AS claim_scope FROM k LEFT JOIN dir USING (src, dst) LEFT JOIN card USING (direction)")
def candidate_lifecycles(spark, d):
    k = follow_ups(spark, d).select(c("cited").alias("src"), c("citing").alias("dst"), ((c("cited") % 100) / 100.0).alias("score"), F.lit(None).cast("double").alias("calibrated"))
    dirs = k.filter("src % 3 = 0").select("src", "dst", (c("src") * 1000000 + c("dst")).alias("direction"), F.when(c("src") % 2 == 0, "exploratory").alias("tier"), F.lit("exploratory_hypothesis").alias("scope"))
    cards = dirs.filter("dst % 4 <> 0").select("direction", (c("dst") % 5 != 0).alias("complete"), (c("dst") % 7 == 0).alias("high"), F.lit("strong_section").alias("grade"), F.when(c("dst") % 2 == 0, "candidate_direction").alias("card_scope"))
    return products.lifecycles(k, dirs, cards).select("src", "dst", "lifecycle_state", "missing_gates", "evidence_grade", "claim_scope")


_CHAINS = "e AS (SELECT p_partkey AS edge, p_partkey AS src, p_partkey + 1 AS dst, list_distinct(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 40 = 0), ch AS (SELECT p_partkey AS chain, p_partkey % 300 AS paper, list_distinct(string_split(p_name, ' ')) AS w, p_size % 2 = 0 AS complete, (p_size % 5) / 10.0 AS weight FROM part)"


@query(f"WITH {_CHAINS}, m AS (SELECT edge, chain, (paper IN (src, dst))::INT AS mine, len(list_intersect(e.w, ch.w)) AS n, complete, weight FROM e, ch), s AS (SELECT edge, chain, mine, round(3 * mine + 2 * complete::INT + weight + least(n, 6) / 10.0, 9) AS score FROM m WHERE mine = 1 OR n >= 2) SELECT edge, chain, score::DOUBLE AS score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY mine DESC, score DESC, chain) AS r FROM s) WHERE r <= 12")
def matching_chains(spark, d):
    p = table(spark, d, "part").withColumn("tokens", F.split("p_name", " "))
    e = p.filter("p_partkey % 40 = 0").select(c("p_partkey").alias("edge"), c("p_partkey").alias("src"), (c("p_partkey") + 1).alias("dst"), "tokens")
    chains = p.select(c("p_partkey").alias("chain"), (c("p_partkey") % 300).alias("paper"), "tokens", (c("p_size") % 2 == 0).alias("complete"), ((c("p_size") % 5) / 10.0).alias("weight"))
    return products.matching_chains(e, chains)


@query("SELECT k, sum(w)::DOUBLE AS weight, string_agg(r, ',' ORDER BY r) AS roles FROM (SELECT DISTINCT l_partkey AS k, 3.0 AS w, 'cited' AS r FROM lineitem UNION ALL SELECT DISTINCT p_partkey, 2.0, 'large' FROM part WHERE p_size > 25 UNION ALL SELECT DISTINCT p_partkey, 1.0, 'cheap' FROM part WHERE p_retailprice < 1000) GROUP BY k")
def decision_papers(spark, d):
    p = table(spark, d, "part")
    return products.roles({"cited": (table(spark, d, "lineitem").select(c("l_partkey").alias("k")), 3.0), "large": (p.filter("p_size > 25").select(c("p_partkey").alias("k")), 2.0), "cheap": (p.filter("p_retailprice < 1000").select(c("p_partkey").alias("k")), 1.0)}, "k")


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::BIGINT AS atoms, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')::BIGINT AS sections FROM orders")
def local_evidence(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return products.with_counts(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"atoms": li, "sections": li.filter("l_returnflag = 'R'")})


@query("SELECT member, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT DISTINCT l_suppkey AS member, l_orderkey AS k FROM lineitem) GROUP BY member")
def theme_principles(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("m"))
    return products.inverted(lists, "l_orderkey", "m").select("member", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"))


@query(f"WITH {FOLLOW_SQL}, a AS (SELECT o_orderkey AS atom, o_custkey % 7 AS kw, year(o_orderdate) AS y FROM orders), res AS (SELECT cited AS atom, citing AS resolver, CASE WHEN x.kw = z.kw THEN 0.65 ELSE 0.55 END AS conf FROM follow JOIN a x ON x.atom = cited JOIN a z ON z.atom = citing WHERE z.y > x.y AND (citing + cited) % 3 = 0) SELECT atom, count(resolver)::BIGINT AS n, coalesce(max(conf), 0.0)::DOUBLE AS best, coalesce(max(conf), 0.0) > 0.6 AS resolved FROM a LEFT JOIN res USING (atom) GROUP BY atom")
def resolved_limitations(spark, d):
    """Atoms (orders) and later citers that resolve them; above 0.6 counts."""
    a = table(spark, d, "orders").select(c("o_orderkey").alias("atom"), (c("o_custkey") % 7).alias("kw"), F.year("o_orderdate").alias("y"))
    e = follow_ups(spark, d).filter((c("citing") + c("cited")) % 3 == 0)
    met = e.join(a.toDF("cited", "kw", "y"), "cited").join(a.toDF("citing", "kw2", "y2"), "citing").filter("y2 > y")
    best = met.groupBy(c("cited").alias("atom")).agg(F.count("*").alias("n"), F.max(F.when(c("kw") == c("kw2"), 0.65).otherwise(0.55)).alias("best"))
    return a.join(best, "atom", "left").select("atom", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) > 0.6).alias("resolved"))


@query(f"WITH {FOLLOW_SQL} SELECT citing, cited, x.o_orderstatus AS citing_text, y.o_orderstatus AS cited_text FROM follow JOIN orders x ON x.o_orderkey = citing JOIN orders y ON y.o_orderkey = cited")
def edges_with_context(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return follow_ups(spark, d).join(o.toDF("citing", "citing_text"), "citing").join(o.toDF("cited", "cited_text"), "cited")


# Views of the graph


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_size DESC, p_partkey LIMIT 10 OFFSET 5")
def visual_nodes(spark, d):
    p = table(spark, d, "part")
    return products.page(p.filter(c("p_brand") == p.agg(F.min("p_brand")).first()[0]).select("p_partkey", "p_size"), [F.desc("p_size"), c("p_partkey")], 10, 5)


@query(f"WITH {FOLLOW_SQL} SELECT citing, cited FROM follow WHERE citing % 5 < 3 ORDER BY cited % 9 = 0 DESC, citing DESC, cited LIMIT 50 OFFSET 20")
def visual_edge_page(spark, d):
    e = follow_ups(spark, d).filter(c("citing") % 5 < 3)
    return products.page(e, [F.desc(c("cited") % 9 == 0), F.desc("citing"), c("cited")], 50, 20)


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), l AS (SELECT p_brand, lag(p_brand) OVER (ORDER BY p_brand) AS parent FROM n) SELECT p_brand, n::BIGINT AS n, parent FROM n LEFT JOIN (SELECT * FROM l WHERE parent IS NOT NULL AND p_brand <> parent) USING (p_brand) ORDER BY n DESC, p_brand LIMIT 30")
def visual_clusters(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    line = n.select("p_brand", F.lag("p_brand").over(Window.orderBy("p_brand")).alias("parent")).filter("parent is not null")  # one row a cluster
    return products.page(n.join(line, "p_brand", "left"), [F.desc("n"), c("p_brand")], 30, 0)


_AT = "SELECT min(cited) FROM follow"


@query(f"WITH {FOLLOW_SQL}, e AS (SELECT cited AS src, citing AS dst, (cited + citing) % 10 + 0.5 AS w, citing % 4 = 0 AS m FROM follow) SELECT CASE WHEN src = ({_AT}) THEN dst ELSE src END AS other, max(w)::DOUBLE AS weight, bool_or(m) AS is_main FROM e WHERE src = ({_AT}) OR dst = ({_AT}) GROUP BY 1")
def citation_search(spark, d):
    e = follow_ups(spark, d).select(c("cited").alias("src"), c("citing").alias("dst"), ((c("cited") + c("citing")) % 10 + 0.5).cast("double").alias("weight"), (c("citing") % 4 == 0).alias("is_main"))
    return products.incident(e, F.lit(e.agg(F.min("src")).first()[0]), 500)


@query("WITH h AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), k AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, rank::INTEGER AS rank, p_name, n::BIGINT AS n FROM h JOIN part USING (p_partkey) JOIN k USING (p_brand) WHERE rank <= 25")
def hydrated_hits(spark, d):
    p = table(spark, d, "part")
    from ..operators import search

    hits = search.ranked_list(p.select("p_partkey", c("p_retailprice").cast("double").alias("score")), "p_partkey", 25).select("p_partkey", "rank")
    return products.hydrated(hits, "p_partkey", p.select("p_partkey", "p_name", "p_brand"), p.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand").select("p_partkey", "rank", "p_name", "n")


_BOTH = f"{FOLLOW_SQL}, nb AS (SELECT citing AS a, cited AS b FROM follow UNION SELECT cited, citing FROM follow)"


@query(f"WITH {_BOTH}, one AS (SELECT b AS other FROM nb WHERE a = ({_AT})), two AS (SELECT DISTINCT b AS other FROM nb WHERE a IN (SELECT other FROM one) AND b <> ({_AT}) AND (SELECT count(*) FROM one) <= 100) SELECT other, min(h)::INTEGER AS hops FROM (SELECT other, 1 AS h FROM one UNION ALL SELECT other, 2 FROM two) GROUP BY other")
def safe_neighbours(spark, d):
    e = follow_ups(spark, d).select(c("cited").alias("src"), c("citing").alias("dst"))
    return products.near_nodes(e, F.lit(e.agg(F.min("src")).first()[0]), 100, 1000)


@query(f"WITH {FOLLOW_SQL}, l AS (SELECT o_orderkey AS node, o_orderpriority AS label FROM orders) SELECT a.cited AS src, a.citing AS mid, b.citing AS dst FROM follow a JOIN follow b ON b.cited = a.citing JOIN l x ON x.node = a.cited AND x.label = '1-URGENT' JOIN l y ON y.node = b.citing AND y.label = '5-LOW' ORDER BY 1, 2, 3 LIMIT 200")
def cross_topic_paths(spark, d):
    e = follow_ups(spark, d).select(c("cited").alias("src"), c("citing").alias("dst"))
    return products.crossing_paths(e, table(spark, d, "orders").select(c("o_orderkey").alias("node"), c("o_orderpriority").alias("label")), "1-URGENT", "5-LOW", 200)


@query(f"WITH {_BOTH} SELECT DISTINCT b AS node FROM nb WHERE a = ({_AT})")
def templated_neighbours(spark, d):
    e = follow_ups(spark, d).select(c("cited").alias("src"), c("citing").alias("dst"))
    return products.run_template(e, "neighbours", node=e.agg(F.min("src")).first()[0])


@query(f"WITH {FOLLOW_SQL}, y AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate) END AS y FROM orders) SELECT CASE WHEN a.y IS NULL OR b.y IS NULL THEN 'unknown_year' WHEN a.y = b.y THEN 'same_year' WHEN a.y < b.y THEN 'time_inverted' ELSE 'evolution' END AS why, count(*)::BIGINT AS n FROM follow JOIN y a ON a.k = citing JOIN y b ON b.k = cited GROUP BY 1")
def evolution_counts(spark, d):
    y = table(spark, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 13 != 0, F.year("o_orderdate")).alias("y"))
    return products.evolution(follow_ups(spark, d), y)[1]


_DRAW = "(('0x' || substr(md5('n|{0}|' || id), 1, 15))::BIGINT % (SELECT count(*) FROM v))"


@query(f"WITH {FOLLOW_SQL}, v AS (SELECT o_orderkey AS node, year(o_orderdate) AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), p AS (SELECT id, CASE WHEN a.y < b.y THEN a.node ELSE b.node END AS src, CASE WHEN a.y < b.y THEN b.node ELSE a.node END AS dst FROM range(4 * 200 + 64) r(id) JOIN v a ON a.i = {_DRAW.format('a')} JOIN v b ON b.i = {_DRAW.format('b')} WHERE a.y <> b.y), o AS (SELECT src, dst, min(id) AS id FROM p WHERE (src, dst) NOT IN (SELECT (cited, citing) FROM follow) GROUP BY ALL) SELECT src, dst FROM o ORDER BY id LIMIT 200")
def negative_edges(spark, d):
    from pyspark.sql import Window

    v = table(spark, d, "orders").select(c("o_orderkey").alias("node"), F.year("o_orderdate").alias("year"))
    v = v.withColumn("i", F.row_number().over(Window.orderBy("node")) - 1)  # numbers of the stand-in's nodes
    return products.negatives(v, follow_ups(spark, d).select(c("cited").alias("src"), c("citing").alias("dst")), 200, "n")


_WORDS = {"metal": ["copper", "steel", "brass"], "colour": ["red", "blue", "green"]}
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '{'|'.join(ws)}') THEN '{k}'" for k, ws in _WORDS.items()) + " END"


@query(f"SELECT category, count(*)::BIGINT AS n FROM (SELECT {_CATEGORY} AS category FROM part) WHERE category IS NOT NULL GROUP BY 1")
def bridge_categories(spark, d):
    return products.keyword_bridges(table(spark, d, "part"), "p_partkey", "p_name", "p_brand", _WORDS)[0].groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH b AS (SELECT p_partkey, p_brand, {_CATEGORY} AS category FROM part WHERE p_partkey <= 300), e AS (SELECT least(a.p_partkey, o.p_partkey) AS src, greatest(a.p_partkey, o.p_partkey) AS dst, a.category, a.p_partkey > o.p_partkey AS x FROM b a JOIN b o ON o.p_brand <> a.p_brand WHERE a.category IS NOT NULL) SELECT src, dst, arg_min(category, x) AS category, 0.5::DOUBLE AS weight FROM e GROUP BY src, dst")
def bridge_keyword_edges(spark, d):
    """The edges of the first 300 parts; every pair across topics is asked for, so a corpus of topics stands in."""
    return products.keyword_bridges(table(spark, d, "part").filter("p_partkey <= 300"), "p_partkey", "p_name", "p_brand", _WORDS)[1]


@query(f"WITH {FOLLOW_SQL} SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT citing FROM follow) AND o_orderkey NOT IN (SELECT cited FROM follow)")
def unknown_ids(spark, d):
    e = follow_ups(spark, d)
    return table(spark, d, "orders").select("o_orderkey").subtract(e.select("citing").union(e.select("cited")))


@query("SELECT l_partkey FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) GROUP BY l_partkey ORDER BY l_partkey LIMIT 5")
def references_of(spark, d):
    b = baskets(spark, d)
    return b.filter(c("citing") == b.agg(F.min("citing")).first()[0]).select(c("cited").alias("l_partkey")).orderBy("l_partkey").limit(5)


def part_graph(spark, d):
    return graph.pairs_sharing(baskets(spark, d), "cited", "citing", 2)


@query()
def part_communities(spark, d):
    return products.communities(part_graph(spark, d), 6)


@query()
def sampled_betweenness(spark, d):
    e = part_graph(spark, d).select(c("a").alias("src"), c("b").alias("dst"))
    s = e.select(c("src").alias("node")).distinct().orderBy(F.md5(c("node").cast("string").cast("binary"))).limit(8)
    return products.betweenness(e, s).withColumn("score", F.round("score", 9))


_LENS = "l AS (SELECT p_partkey, p_brand, 4 * contains(lower(p_name), 'red')::INT + 2 * contains(lower(p_name), 'gear')::INT + contains(lower(p_name), 'small')::INT AS score FROM part), s AS (SELECT * FROM l WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 60)"


@query(f"WITH {_LENS} SELECT p_brand, count(*)::BIGINT AS seeds, sum(score)::BIGINT AS score, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM s GROUP BY p_brand")
def topic_lens_clusters(spark, d):
    e = baskets(spark, d).select(c("citing").alias("src"), c("cited").alias("dst"))
    out = products.lens(table(spark, d, "part"), "p_partkey", "p_name", "p_brand", e, {4: ["red"], 2: ["gear"], 1: ["small"]}, 60)["clusters"]
    return out.withColumn("share", F.round("share", 6))


@query(f"WITH {_LENS}, e AS (SELECT DISTINCT l_orderkey + 1000000000 AS src, l_partkey AS dst FROM lineitem) SELECT src, dst FROM e WHERE dst IN (SELECT p_partkey FROM s)")
def topic_lens_edges(spark, d):
    e = baskets(spark, d).select((c("citing") + 1000000000).alias("src"), c("cited").alias("dst"))
    return products.lens(table(spark, d, "part"), "p_partkey", "p_name", "p_brand", e, {4: ["red"], 2: ["gear"], 1: ["small"]}, 60)["edges"]
