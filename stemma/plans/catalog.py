"""The queries over the literature-graph operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as c
from ..operators import graph, relational, search, stats
from ..sources.tables import BASKETS_SQL, FOLLOW_SQL, baskets, follow_ups, staged, table, with_schema
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Ages count to this day.
AS_OF = "2000-01-01"
#: What the retrieval queries look for.
ASKED = "the of heat reand onthe"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("date")


# Scans


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus = 'O' AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def keyset_page(spark, d):
    return relational.keyset_page(table(spark, d, "orders"), "o_orderkey", (F.col("o_totalprice") >= 1000) & (F.col("o_orderstatus") == "O"), 100, 50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 7 OR c_name = (SELECT c_name FROM customer WHERE c_custkey = 7)")
def point_lookup(spark, d):
    cust = table(spark, d, "customer")
    name = cust.filter("c_custkey = 7").select(F.col("c_name").alias("n"))
    return cust.join(F.broadcast(name), (F.col("c_custkey") == 7) | (F.col("c_name") == F.col("n")), "left_semi").select("c_custkey", "c_name", "c_nationkey")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n FROM {t}" for t in ("region", "nation", "customer", "orders", "lineitem", "documents", "events")))
def table_stats(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("region", "nation", "customer", "orders", "lineitem", "documents", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name, NULL::VARCHAR AS r_comment FROM region")
def schema_compat(spark, d):
    return with_schema(table(spark, d, "region"), T.StructType.fromDDL("r_regionkey long, r_name string, r_comment string"))


@query("SELECT year(m)::INTEGER AS y, month(m)::INTEGER AS m FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders))::TIMESTAMP, (SELECT max(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 1 MONTH)) AS m)")
def month_windows(spark, d):
    span = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.year("m").alias("y"), F.month("m").alias("m"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ')) AS digest FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0")
def inverted_abstract(spark, d):
    """Texts turned into inverted indexes and rebuilt by position."""
    docs = table(spark, d, "documents")
    places = docs.select("doc_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    back = places.select("doc_id", "w", F.explode("ps").alias("p")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "w"))).alias("s"))
    return back.select("doc_id", F.md5(F.array_join(F.col("s")["w"], " ").cast("binary")).alias("digest"))


@query(f"WITH {BASKETS_SQL}, h1 AS (SELECT DISTINCT b.citing AS o FROM basket b WHERE b.cited = 5), p1 AS (SELECT DISTINCT cited FROM basket WHERE citing IN (SELECT o FROM h1)), h2 AS (SELECT DISTINCT citing FROM basket WHERE cited IN (SELECT cited FROM p1)), p2 AS (SELECT DISTINCT cited FROM basket WHERE citing IN (SELECT citing FROM h2)) SELECT cited AS node, CASE WHEN cited = 5 THEN 0 WHEN cited IN (SELECT cited FROM p1) THEN 1 ELSE 2 END AS depth FROM p2")
def expand_from_seed(spark, d):
    """Parts that share orders with part 5, by hops."""
    e = baskets(spark, d)
    seen = spark.createDataFrame([(5, 0)], "node long, depth int")
    front = seen
    for depth in (1, 2):
        orders = e.join(front.select(F.col("node").alias("cited")), "cited", "left_semi").select("citing").distinct()
        front = e.join(orders, "citing", "left_semi").select(F.col("cited").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.union(front)
    return seen


# Upserts and logs

_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"


@query(f"SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) t FULL JOIN ({_NEW}) s ON s.o_orderkey = t.o_orderkey")
def upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return relational.merge(o.filter("o_orderkey % 5 <> 0"), new, "o_orderkey")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def insert_ignore(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return relational.insert_ignore(e.filter("l_partkey % 2 = 0").distinct(), e, ["l_orderkey", "l_partkey"])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark, d):
    return relational.latest_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, count(*)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY event_type")
def latest_outcomes(spark, d):
    return latest_state(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_id > e.event_id)")
def outbox_pending(spark, d):
    """Events after the last that is marked as processed, which here is every event a later one of its user follows."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    processed = e.join(last, "user_id").filter("event_id < last").select("event_id")
    return e.join(processed, "event_id", "left_anti").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND floor(epoch(b.ts))::BIGINT BETWEEN floor(epoch(a.ts))::BIGINT - 3600 AND floor(epoch(a.ts))::BIGINT)::BIGINT AS n FROM events a")
def quota_window(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", relational.within(e, "user_id", "ts", 3600, ["event_id"]).alias("n"))


@query("SELECT event_type, max(ts) AS high_water, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def high_water_marks(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("high_water"), F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, value > 50 AS s, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE s AND NOT b")
def state_transitions(spark, d):
    """False to true transitions, as of retractions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("s", F.col("value") > 50).withColumn("b", F.lag("s").over(w))
    return e.filter("s and not b").select("user_id", "event_id")


@query("SELECT m, n, n - lag(n) OVER (ORDER BY m) AS delta FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*)::BIGINT AS n FROM orders GROUP BY 1)")
def snapshot_delta(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.count("*").alias("n"))
    return m.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("m")))  # one row a month


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def json_metrics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


_DAYS = "SELECT event_type, ts::DATE AS day, count(*) FILTER (WHERE value > 50) AS opened, count(*) FILTER (WHERE value <= 50) AS resolved FROM events GROUP BY ALL"


@query(f"WITH s AS (SELECT *, sum(opened - resolved) OVER (PARTITION BY event_type ORDER BY day) AS s FROM ({_DAYS})) SELECT event_type, day::VARCHAR AS day, opened::BIGINT AS opened, resolved::BIGINT AS resolved, (s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY day)))::BIGINT AS backlog FROM s")
def backlog(spark, d):
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") > 50).alias("opened"), F.count_if(F.col("value") <= 50).alias("resolved"))
    return relational.backlog(days, "event_type", "day", "opened", "resolved").withColumn("day", F.col("day").cast("string"))


# Filters and joins


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def corpus_scope(spark, d):
    cust = table(spark, d, "customer")
    return relational.in_scope(table(spark, d, "orders"), "o_custkey", cust.filter("c_mktsegment = 'BUILDING'").select("c_custkey"), cust.filter("c_nationkey = 3").select("c_custkey")).select("o_orderkey", "o_custkey")


@query("WITH ids AS (SELECT 'part' AS provider, (p_partkey % 1500)::VARCHAR AS norm, p_partkey AS id FROM part WHERE p_partkey % 7 <> 0), known AS (SELECT provider, norm, count(DISTINCT id) AS n, min(id) AS target FROM ids GROUP BY ALL), refs AS (SELECT l_orderkey, l_linenumber, 'part' AS provider, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey::VARCHAR END AS norm FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN norm IS NULL THEN 'unclassifiable' WHEN n IS NULL THEN 'no_local_match' WHEN n = 1 THEN 'exact_linkable' ELSE 'ambiguous_local_match' END AS status, CASE WHEN n = 1 THEN target END AS target FROM refs LEFT JOIN known USING (provider, norm)")
def reference_relink(spark, d):
    ids = table(spark, d, "part").filter("p_partkey % 7 <> 0").select(F.lit("part").alias("provider"), (F.col("p_partkey") % 1500).cast("string").alias("norm"), F.col("p_partkey").alias("id"))
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("part").alias("provider"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey").cast("string")).alias("norm"))
    return relational.link_references(refs, ids).select("l_orderkey", "l_linenumber", "status", "target")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.06)")
def unresolved_limitations(spark, d):
    found = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return relational.unresolved(table(spark, d, "orders"), found, "o_orderkey", "l_discount", 0.06).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, coalesce(max(l_discount), 0.0) AS best FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING coalesce(max(l_discount), 0.0) < 0.05")
def ranked_unresolved(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.coalesce(F.max("l_discount"), F.lit(0.0)).alias("best")).filter("best < 0.05")


@query(f"WITH {FOLLOW_SQL} SELECT cited, citing, o_totalprice FROM follow JOIN orders ON o_orderkey = citing")
def later_citations(spark, d):
    """The first three later citers of each order."""
    return follow_ups(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("citing"), "o_totalprice"), "citing").select("cited", "citing", "o_totalprice")


@query(f"WITH {FOLLOW_SQL}, node AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000) SELECT citing, cited, CASE WHEN (citing + cited) % 4 = 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight FROM follow WHERE citing IN (SELECT id FROM node) AND cited IN (SELECT id FROM node)")
def subgraph_edges(spark, d):
    e = follow_ups(spark, d)
    nodes = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"))
    weights = e.filter((F.col("citing") + F.col("cited")) % 4 == 0).select(F.col("cited").alias("citing"), F.col("citing").alias("cited"), F.lit(2.5).alias("weight"))
    return relational.induced_edges(e, nodes, weights)


@query("(SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) UNION (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def seed_nodes(spark, d):
    o = table(spark, d, "orders")
    best = [F.desc("o_totalprice"), "o_orderkey"]
    return o.orderBy(*best).limit(100).select("o_orderkey").union(o.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).orderBy(*best).limit(50).select("o_orderkey")).distinct()


# Aggregates


@query("SELECT source, count(*)::BIGINT AS n, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS english, round(avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END), 6) AS long_share, CASE WHEN avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 'pass' WHEN avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'warn' ELSE 'fail' END AS gate FROM documents GROUP BY source")
def coverage_audit(spark, d):
    share = F.avg(F.when(F.col("n_chars") >= 500, 1.0).otherwise(0.0))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("english"), F.round(share, 6).alias("long_share"), F.when(share >= 0.9, "pass").when(share >= 0.5, "warn").otherwise("fail").alias("gate"))


@query("SELECT md5(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("SELECT o_orderpriority, o_totalprice AS p95 FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE i = floor(0.95 * (n - 1))")
def truncated_p95(spark, d):
    return stats.truncated_percentile(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.95, 1.0).withColumnRenamed("p", "p95")


@query("SELECT o_orderpriority, o_totalprice AS p FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE i = round_even(0.9 * (n - 1), 0)")
def nearest_p90(spark, d):
    return stats.nearest_percentile(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.9)


@query("SELECT l_partkey, round(avg(l_extendedprice), 8) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE i >= floor(n * 0.1) AND i < n - floor(n * 0.1) GROUP BY l_partkey")
def trimmed_mean(spark, d):
    return stats.trimmed_mean(table(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice", 0.1).withColumn("mean", F.round("mean", 8))


@query("SELECT l_suppkey, round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE exp(-stddev_pop(l_quantity) / (abs(quantile_cont(l_quantity, 0.5)) + 1e-6)) END, 6) AS consistency FROM lineitem GROUP BY l_suppkey")
def consistency(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(stats.consistency("l_quantity"), 6).alias("consistency"))


@query("WITH n AS (SELECT l_partkey, c_nationkey, count(*) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL), p AS (SELECT l_partkey, k / sum(k) OVER (PARTITION BY l_partkey) AS p FROM n) SELECT l_partkey, round(least(1.0, -sum(p * ln(p)) / ln(25.0)), 6) AS breadth FROM p GROUP BY l_partkey")
def cocite_breadth(spark, d):
    e = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.entropy_share(e.select("l_partkey", "c_nationkey"), "l_partkey", "c_nationkey", 25).withColumn("breadth", F.round("breadth", 6))


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents), df AS (SELECT word, count(*) AS df FROM w GROUP BY word) SELECT word, df::BIGINT AS df, round(ln((SELECT count(*) FROM documents)::DOUBLE / df) + 1, 6) AS idf FROM df WHERE df <= 100")
def entity_idf(spark, d):
    docs = table(spark, d, "documents")
    df = docs.select(F.explode(F.array_distinct(c.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")).filter("df <= 100")
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("word", "df", F.round(F.log(F.col("n") / F.col("df")) + 1, 6).alias("idf"))


_SCORED = "SELECT doc_id, quality AS y, least(0.999, n_chars / 5000.0) AS p FROM labels JOIN documents USING (doc_id)"


def scored_labels(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.lit(0.999), F.col("n_chars") / 5000.0).alias("p"))


@query(f"SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM ({_SCORED})")
def brier_score(spark, d):
    return scored_labels(spark, d).agg(F.round(stats.brier("y", "p"), 6).alias("brier"))


@query(f"SELECT round(avg(k / i) FILTER (WHERE y = 1), 6) AS average_precision FROM (SELECT y, sum(y) OVER w AS k, count(*) OVER w AS i FROM ({_SCORED}) WINDOW w AS (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING))")
def average_precision(spark, d):
    return stats.average_precision(scored_labels(spark, d), "y", "p", "doc_id").withColumn("average_precision", F.round("average_precision", 6))


@query(f"WITH s AS ({_SCORED}), top AS (SELECT y FROM s ORDER BY p DESC, doc_id LIMIT 50), h AS (SELECT sum(y) AS h, count(*) AS k, (SELECT sum(y) FROM s) AS a FROM top) SELECT round(h / least(k, a), 6) AS hit_rate, round(CASE WHEN h = 0 THEN 0.0 ELSE 2 * (h / k) * (h / a) / ((h / k) + (h / a)) END, 6) AS f1 FROM h")
def hit_rate_at_50(spark, d):
    s = scored_labels(spark, d)
    top = s.orderBy(F.desc("p"), "doc_id").limit(50).agg(F.sum("y").alias("h"), F.count("*").alias("k")).crossJoin(s.agg(F.sum("y").alias("a")))
    pr, rc = F.col("h") / F.col("k"), F.col("h") / F.col("a")
    return top.select(F.round(F.col("h") / F.least("k", "a"), 6).alias("hit_rate"), F.round(F.when(F.col("h") == 0, 0.0).otherwise(2 * pr * rc / (pr + rc)), 6).alias("f1"))


@query(f"WITH s AS (SELECT lang, y, p FROM ({_SCORED}) JOIN documents USING (doc_id)), r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r FROM s), g AS (SELECT lang, sum(r) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM r GROUP BY lang) SELECT lang, round((rs - p * (p + 1) / 2) / (p * q), 6) AS auc FROM g WHERE p > 0 AND q > 0")
def rolling_auc(spark, d):
    s = scored_labels(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return stats.auc_by(s, "lang", "y", "p").withColumn("auc", F.round("auc", 6))


@query(f"SELECT doc_id, round(greatest(0.01, least(0.995, 0.4 + (1 / (1 + exp(-greatest(-30.0, least(30.0, 3.0 * p - 1.0)))) - 0.4) * 0.5)), 6) AS calibrated FROM ({_SCORED})")
def calibration(spark, d):
    return scored_labels(spark, d).select("doc_id", F.round(c.calibrated(F.col("p"), 3.0, -1.0, 0.4, 400), 6).alias("calibrated"))


# Scores

_STAGE = f"CASE WHEN months < 6 THEN 'fresh' WHEN months < 36 THEN 'growing' ELSE 'mature' END"


def _harmonic_sql(stage: str) -> str:
    w = c.KEYSTONE_WEIGHTS[stage]
    up = [k for k in w if w[k] > 0]
    total = "+".join(f"CASE WHEN {k} IS NOT NULL THEN {w[k]} ELSE 0.0 END" for k in up)
    parts = "+".join(f"CASE WHEN {k} IS NOT NULL THEN {w[k]} / (least(greatest({k}, 0.0), 1.0) + 0.5) ELSE 0.0 END" for k in up)
    return f"least(greatest(({total})::DOUBLE / ({parts})::DOUBLE - 0.5 - 0.1 * review, 0.0), 1.0)"


@query(
    f"WITH p AS (SELECT l_orderkey, count(*) AS refs, count(DISTINCT l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey), s AS (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') / 30.4375 AS months, "
    f"greatest(0.0, 1 - date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') / 3650.0)::DOUBLE AS recency, CASE WHEN o_orderkey % 2 = 0 THEN 0.65 ELSE 0.5 END::DOUBLE AS venue, (o_totalprice / 500000.0)::DOUBLE AS burst, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END::DOUBLE AS review, (refs / 7.0)::DOUBLE AS breadth, (supp / refs)::DOUBLE AS linked, CASE WHEN o_orderkey % 5 <> 0 THEN supp / 26.0 END::DOUBLE AS bridging, 0.4::DOUBLE AS disruption FROM orders LEFT JOIN p ON l_orderkey = o_orderkey) "
    f"SELECT o_orderkey, {_STAGE} AS stage, round(CASE {_STAGE} WHEN 'fresh' THEN {_harmonic_sql('fresh')} WHEN 'growing' THEN {_harmonic_sql('growing')} ELSE {_harmonic_sql('mature')} END, 5) AS score FROM s"
)
def keystone_score(spark, d):
    o = table(spark, d, "orders")
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("refs"), F.count_distinct("l_suppkey").alias("supp"))
    j = o.join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("stage", c.lifecycle(F.col("o_orderdate"), as_of()))
    signals = {
        "recency": F.greatest(F.lit(0.0), 1 - F.datediff(as_of(), "o_orderdate") / 3650.0), "venue": F.when(F.col("o_orderkey") % 2 == 0, 0.65).otherwise(0.5), "burst": F.col("o_totalprice") / 500000.0,
        "review": F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0), "breadth": F.col("refs") / 7.0, "linked": F.col("supp") / F.col("refs"), "bridging": F.when(F.col("o_orderkey") % 5 != 0, F.col("supp") / 26.0), "disruption": F.lit(0.4),
    }
    return j.select("o_orderkey", "stage", F.round(c.keystone(signals, F.col("stage")), 5).alias("score"))


@query(f"WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS paths, o_totalprice / 500000.0 AS conf, o_custkey % 2 = 0 AS section, o_custkey % 3 = 0 AS decision, o_orderkey % 2 = 0 AS main, o_custkey % 7 <> 0 AS cal FROM orders), t AS (SELECT o_orderkey, CASE WHEN NOT cal THEN CASE WHEN paths >= 2 THEN 'exploratory_uncalibrated_candidate' ELSE 'insufficient' END WHEN paths >= 3 AND conf >= 0.70 AND section AND decision AND main THEN 'triangulated_strong' WHEN paths >= 3 AND conf >= 0.60 THEN 'triangulated_limited' WHEN paths >= 2 AND NOT section THEN 'exploratory_weak_limitation' WHEN paths >= 2 THEN 'exploratory' ELSE 'insufficient' END AS tier FROM x) SELECT o_orderkey, tier, CASE WHEN tier = 'exploratory_uncalibrated_candidate' THEN 'candidate_pool_only' WHEN tier = 'triangulated_strong' THEN 'candidate_direction' WHEN tier = 'triangulated_limited' THEN 'candidate_direction_with_uncertainty' WHEN tier LIKE 'exploratory%' THEN 'exploratory_hypothesis' ELSE 'not_for_user_claim' END AS scope FROM t")
def evidence_tiers(spark, d):
    o = table(spark, d, "orders")
    section = F.col("o_custkey") % 2 == 0
    tier = c.evidence_tier(F.col("o_orderkey") % 5, F.col("o_totalprice") / 500000.0, section, F.col("o_custkey") % 3 == 0, F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 7 != 0, ~section)
    return o.withColumn("tier", tier).select("o_orderkey", "tier", c.claim_scope(F.col("tier")).alias("scope"))


@query(f"SELECT o_orderkey, round(least(1.0, greatest(0.3, pow(2.0, -(date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') / 365.25) / 5.0))), 6) AS decay, least(5, floor(least(1.0, o_totalprice / 500000.0) * 5) + 1)::INTEGER AS grade FROM orders")
def decay_and_grade(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(c.time_decay(F.col("o_orderdate"), as_of()), 6).alias("decay"), c.to_grade(F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0)).alias("grade"))


@query(
    "WITH b AS (SELECT o_orderkey AS id, o_custkey % 2 = 0 AS has, ln(1 + o_totalprice) / (SELECT max(ln(1 + o_totalprice)) FROM orders) AS cite, least(1.0, o_totalprice / 500000.0) AS key FROM orders), m AS (SELECT id, 'starter' AS mode, 0.55 * cite + 0.45 * key AS score FROM b UNION ALL SELECT id, 'bottleneck', 0.6 * CASE WHEN has THEN 1.0 ELSE 0.0 END + 0.25 * key + 0.15 * cite FROM b), r AS (SELECT mode, id, round(score, 6) AS score, row_number() OVER (PARTITION BY mode ORDER BY round(score, 6) DESC, id) AS rank FROM m) SELECT mode, id, score, rank::INTEGER AS rank FROM r WHERE rank <= 20"
)
def recommendations(spark, d):
    o = table(spark, d, "orders")
    top = o.agg(F.max(F.log1p("o_totalprice")).alias("top"))
    b = o.crossJoin(F.broadcast(top)).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2 == 0).alias("has"), (F.log1p("o_totalprice") / F.col("top")).alias("cite"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("key"))
    modes = {"starter": 0.55 * F.col("cite") + 0.45 * F.col("key"), "bottleneck": 0.6 * F.when(F.col("has"), 1.0).otherwise(0.0) + 0.25 * F.col("key") + 0.15 * F.col("cite")}
    each = b.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.round(s, 6).alias("score")) for m, s in modes.items()])).alias("m")).select("id", "m.*")
    return relational.top_per_key(each, ["mode"], [F.desc("score"), F.col("id")], 20).select("mode", "id", "score", "rank")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 25")
def stratified_sample(spark, d):
    o = table(spark, d, "orders").withColumn("h", F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")).cast("binary")))
    return relational.top_per_key(o, ["o_orderpriority"], [F.col("h"), F.col("o_orderkey")], 25).select("o_orderkey", "o_orderpriority")


# Graphs

_COUPLED = f"{BASKETS_SQL}, pair AS (SELECT a.citing AS a, b.citing AS b, count(*) AS weight FROM basket a JOIN basket b ON a.cited = b.cited AND a.citing < b.citing GROUP BY ALL HAVING count(*) >= 2)"


@query(f"WITH {_COUPLED}, cut AS (SELECT greatest(2, floor(quantile_cont(weight, 0.5))) AS t FROM pair) SELECT a, b, weight::BIGINT AS weight FROM pair WHERE weight >= (SELECT t FROM cut)")
def bibliographic_coupling(spark, d):
    """Orders that share parts, with the adaptive threshold."""
    pairs = staged(graph.pairs_sharing(baskets(spark, d), "citing", "cited", 2))
    return pairs.crossJoin(F.broadcast(graph.adaptive_threshold(pairs))).filter("weight >= threshold").select("a", "b", "weight")


#: How many references of a citing paper count, in order.
REFERENCES = 80
_COCITED = f"{BASKETS_SQL}, head AS (SELECT * FROM basket QUALIFY row_number() OVER (PARTITION BY citing ORDER BY cited) <= {REFERENCES}), pair AS (SELECT a.cited AS a, b.cited AS b, count(*) AS weight FROM head a JOIN head b ON a.citing = b.citing AND a.cited < b.cited GROUP BY ALL HAVING count(*) >= 2)"


def cocited(spark, d):
    return graph.pairs_sharing(graph.first_items(baskets(spark, d), "cited", "citing", REFERENCES), "cited", "citing", 2)


@query(f"WITH {_COCITED}, two AS (SELECT a AS u, b AS v, a, b, weight FROM pair UNION ALL SELECT b, a, a, b, weight FROM pair) SELECT DISTINCT a, b, weight::BIGINT AS weight FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) AS r FROM two) WHERE r <= 12")
def cocitation(spark, d):
    return graph.top_of_either(cocited(spark, d), 12)


@query(f"WITH {BASKETS_SQL}, df AS (SELECT cited, count(*) AS df FROM basket GROUP BY cited HAVING count(*) <= 100), w AS (SELECT citing, cited, ln((SELECT count(DISTINCT citing) FROM basket)::DOUBLE / df) + 1 AS idf FROM basket JOIN df USING (cited)), norm AS (SELECT citing, sum(idf) AS n FROM w GROUP BY citing), s AS (SELECT a.citing AS a, b.citing AS b, sum(a.idf) AS s FROM w a JOIN w b ON a.cited = b.cited AND a.citing < b.citing GROUP BY ALL) SELECT a, b, round(s / (x.n + y.n - s + 1e-9), 5) AS similarity FROM s JOIN norm x ON x.citing = a JOIN norm y ON y.citing = b WHERE s / (x.n + y.n - s + 1e-9) >= 0.1")
def idf_coupling(spark, d):
    return graph.idf_jaccard(baskets(spark, d), "citing", "cited", 100, 0.1).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH {_COCITED} SELECT a, b, round(least(1.0, 0.5 * (0.3 * 0 + 0.4 * least(1.0, ln(1 + weight) / ln(51.0)) + 0.3 * 0) * CASE WHEN x.p_brand <> y.p_brand THEN 2.0 ELSE 1.0 END), 6) AS fused FROM pair JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b")
def fused_edges(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    e = cocited(spark, d).join(p.toDF("a", "ba"), "a").join(p.toDF("b", "bb"), "b")
    zero = F.lit(0.0)
    return e.select("a", "b", F.round(c.fused_weight(zero, F.col("weight"), zero, zero, F.col("ba") != F.col("bb"), F.lit(1.0)), 6).alias("fused"))


@query(f"WITH {_COCITED}, e AS (SELECT unnest([a, b]) AS node FROM pair), d AS (SELECT node, count(*) AS degree FROM e GROUP BY node) SELECT node, degree::BIGINT AS degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d")
def degree_centrality(spark, d):
    return graph.degree_centrality(cocited(spark, d)).withColumn("centrality", F.round("centrality", 6))


_NORMED = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings), c AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id)"


@query(f"WITH {_NORMED} SELECT a, b, round(c, 5) AS cosine FROM c WHERE a < b AND la <> lb AND c >= 0.3")
def semantic_bridges(spark, d):
    return graph.bridges(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3).withColumn("cosine", F.round("cosine", 5))


@query(f"WITH {_NORMED} SELECT a AS id, b AS other, round(c, 5) AS cosine, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM c) WHERE r <= 8")
def nearest_neighbours(spark, d):
    return graph.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 8).withColumn("cosine", F.round("cosine", 5))


@query(f"WITH {FOLLOW_SQL}, e AS (SELECT DISTINCT * FROM follow), o AS (SELECT x.citing AS node, y.citing AS citer FROM e x JOIN e y ON y.cited = x.cited AND y.citing <> x.citing), u AS (SELECT node, citer, max(dd) AS dd, max(rr) AS rr FROM (SELECT cited AS node, citing AS citer, 1 AS dd, 0 AS rr FROM e UNION ALL SELECT node, citer, 0, 1 FROM o) GROUP BY ALL), n AS (SELECT node, count(*) FILTER (WHERE rr = 0) AS i, count(*) FILTER (WHERE rr = 1 AND dd = 1) AS j, count(*) FILTER (WHERE dd = 0) AS k FROM u GROUP BY node) SELECT node, i::BIGINT AS n_i, j::BIGINT AS n_j, k::BIGINT AS n_k, round((i - j) / (i + j + k), 6) AS cd FROM n")
def cd_index(spark, d):
    return graph.disruption(follow_ups(spark, d)).withColumn("cd", F.round("cd", 6))


@query(f"WITH RECURSIVE {FOLLOW_SQL} SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")
def connected_components(spark, d):
    return graph.components(follow_ups(spark, d).select(F.col("citing").alias("a"), F.col("cited").alias("b")))


@query()
def citation_pagerank(spark, d):
    e = follow_ups(spark, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst"), F.lit(1.0).alias("weight"))
    return graph.pagerank(e, rounds=20).withColumn("rank", F.round("rank", 9))


@query(
    "WITH RECURSIVE n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), "
    "paths AS (SELECT 1 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c UNION ALL SELECT i + 1, a + b + c, a, b FROM paths WHERE i < (SELECT max(n) FROM n)), "
    "e AS (SELECT u.o_orderkey AS src, v.o_orderkey AS dst, f.a * g.a AS spc FROM n u JOIN n v ON v.o_custkey = u.o_custkey AND v.i - u.i BETWEEN 1 AND 3 JOIN paths f ON f.i = u.i JOIN paths g ON g.i = v.n - v.i + 1), "
    "cut AS (SELECT spc FROM (SELECT spc, row_number() OVER (ORDER BY spc DESC) - 1 AS k, count(*) OVER () AS n FROM e) WHERE k = greatest(0, floor(n * 0.01)::BIGINT - 1)) SELECT src, dst, spc, round(ln(1 + spc), 6) AS weight, spc >= (SELECT spc FROM cut) AS is_main FROM e"
)
def main_path(spark, d):
    return graph.main_path(follow_ups(spark, d).select(F.col("cited").alias("src"), F.col("citing").alias("dst"))).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_COCITED}, l AS (SELECT p_partkey AS node, p_brand AS label FROM part), m AS (SELECT sum(weight) AS m FROM pair), e AS (SELECT weight, x.label AS la, y.label AS lb FROM pair JOIN l x ON x.node = a JOIN l y ON y.node = b), ins AS (SELECT la AS label, sum(weight) AS i FROM e WHERE la = lb GROUP BY la), deg AS (SELECT label, sum(w) AS dg FROM (SELECT la AS label, weight AS w FROM e UNION ALL SELECT lb, weight FROM e) GROUP BY label) SELECT round(sum(coalesce(i, 0) / m - pow(dg / (2 * m), 2)), 6) AS modularity FROM deg LEFT JOIN ins USING (label), m")
def modularity(spark, d):
    pairs = cocited(spark, d)
    return graph.modularity(pairs, table(spark, d, "part").select("p_partkey", "p_brand")).withColumn("modularity", F.round("modularity", 6))


@query(f"WITH {FOLLOW_SQL}, l AS (SELECT o_orderkey AS node, o_orderpriority AS label FROM orders), n AS (SELECT y.label AS child, x.label AS parent, count(*) AS support FROM follow JOIN l x ON x.node = cited JOIN l y ON y.node = citing WHERE x.label <> y.label GROUP BY ALL), t AS (SELECT *, sum(support) OVER (PARTITION BY child) AS total, row_number() OVER (PARTITION BY child ORDER BY support DESC, parent) AS r FROM n) SELECT child, parent, support::BIGINT AS support, total::BIGINT AS total, round(support / total, 6) AS strength, round(least(1.0, support / total * CASE WHEN support >= 8 THEN 1.0 ELSE 0.75 END), 6) AS confidence, CASE WHEN support >= 8 AND support / total >= 0.30 THEN 'evidence_backed_split' WHEN support >= 3 THEN 'weak_split_candidate' ELSE 'layout_cluster_only' END AS status FROM t WHERE r = 1")
def branch_lineages(spark, d):
    e = follow_ups(spark, d).select(F.col("cited").alias("src"), F.col("citing").alias("dst"))
    return graph.lineages(e, table(spark, d, "orders").select("o_orderkey", "o_orderpriority")).withColumn("strength", F.round("strength", 6)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {FOLLOW_SQL}, e AS (SELECT *, row_number() OVER (ORDER BY y.o_orderdate, x.o_orderdate, cited, citing) AS r, count(*) OVER () AS n FROM follow JOIN orders x ON x.o_orderkey = cited JOIN orders y ON y.o_orderkey = citing) SELECT CASE WHEN r > n - floor(n * 0.1) THEN 'test' WHEN r > n - 2 * floor(n * 0.1) THEN 'val' ELSE 'train' END AS part, count(*)::BIGINT AS n, sum(citing)::BIGINT AS s FROM e GROUP BY 1")
def temporal_split(spark, d):
    """Edges by date; the last tenth tests, the tenth before validates. Two cut points come from counts by date."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    e = follow_ups(spark, d).join(o.toDF("cited", "src"), "cited").join(o.toDF("citing", "dst"), "citing")
    days = e.groupBy("dst").agg(F.count("*").alias("k"))
    w = Window.orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)  # one row a date
    days = days.select("dst", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy()).alias("n"))
    r = e.join(days, "dst").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("dst").orderBy("src", "cited", "citing")))
    tenth = F.floor(F.col("n") * 0.1)
    part = F.when(F.col("r") > F.col("n") - tenth, "test").when(F.col("r") > F.col("n") - 2 * tenth, "val").otherwise("train")
    return r.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("citing").alias("s"))


# Text

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_TERMS = "[" + ", ".join(f"'{t}'" for t in search.query_terms(ASKED)) + "]"
_BM25 = f"r AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), h AS (SELECT id, len(w) AS len, unnest(list_filter(w, lambda x: list_contains({_TERMS}, x))) AS term FROM r), tf AS (SELECT id, len, term, count(*) AS tf FROM h GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM r), bm AS (SELECT id AS doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (term), st GROUP BY id)"
_OVER = f"ov AS (SELECT doc_id, len(list_intersect({_TERMS}, {_WORDS})) / {float(len(search.query_terms(ASKED)))} AS score FROM documents WHERE len(list_intersect({_TERMS}, {_WORDS})) > 0)"


@query(f"WITH {_BM25} SELECT doc_id, round(score, 5) AS score FROM bm")
def bm25(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", ASKED).withColumn("score", F.round("score", 5))


@query(f"WITH {_OVER} SELECT doc_id, round(score, 6) AS score FROM ov")
def lexical_overlap(spark, d):
    return search.overlap(table(spark, d, "documents"), "doc_id", "text", ASKED).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' of the ')")
def phrase_search(spark, d):
    return search.phrase(table(spark, d, "documents"), "doc_id", "text", "of the")


@query(f"WITH {_BM25}, {_OVER}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100), b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ov QUALIFY rank <= 100) SELECT doc_id, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id")
def reciprocal_rank_fusion(spark, d):
    docs = table(spark, d, "documents")
    lists = [search.ranked_list(f(docs, "doc_id", "text", ASKED), "doc_id", 100) for f in (search.bm25, search.overlap)]
    return search.fuse_ranks(lists, "doc_id").withColumn("score", F.round("score", 8))


@query("SELECT source, word, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(" + _WORDS + ") AS word FROM documents) WHERE length(word) >= 3 GROUP BY ALL)) WHERE r <= 8")
def cluster_terms(spark, d):
    n = table(spark, d, "documents").select("source", F.explode(c.words(F.col("text"))).alias("word")).filter(F.length("word") >= 3).groupBy("source", "word").agg(F.count("*").alias("n"))
    return relational.top_per_key(n, ["source"], [F.desc("n"), F.col("word")], 8).select("source", "word", "n")


@query("SELECT doc_id, i::INTEGER AS chunk, len(w[i * 40 + 1 : i * 40 + 50])::INTEGER AS size, md5(array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ')) AS digest FROM (SELECT doc_id, " + _WORDS + " AS w FROM documents), unnest(range(0, greatest(1, CEIL((len(w) - 10) / 40.0)::BIGINT))) AS u(i) WHERE len(w) > 0")
def overlapping_chunks(spark, d):
    """Windows of 50 words, 10 of them shared with the next, until the end is reached."""
    w = table(spark, d, "documents").select("doc_id", c.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(1), F.ceil((F.size("w") - 10) / 40.0)).cast("int") - 1
    chunks = w.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk"), F.slice("w", i * 40 + 1, 50).alias("s")))).alias("x"))
    return chunks.select("doc_id", F.col("x.chunk").alias("chunk"), F.size("x.s").alias("size"), F.md5(F.array_join("x.s", " ").cast("binary")).alias("digest"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, len(regexp_extract_all(html, '(?i)<h[1-6][ >]'))::INTEGER AS headings FROM pages")
def page_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.regexp_count("html", F.lit("(?i)<h[1-6][ >]")).alias("headings"))


@query()
def diverse_selection(spark, d):
    e = table(spark, d, "embeddings").withColumn("score", (F.col("vec_id") % 97) / 97.0)
    return search.diverse(spark, e, "vec_id", "score", "embedding", 10)


# Streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, d):
    out = streams.hourly(spark, f"{d}/events.parquet")
    return out.withColumn("total", F.round("total", 4))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS ids FROM events")
def stream_ingest(spark, d):
    return streams.ingest(spark, f"{d}/events.parquet", "event_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
