"""Queries over logs and sinks; events are edits of edges, users are experts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, history
from ..sources.tables import BASKETS_SQL, FOLLOW_SQL, baskets, follow_ups, table
from .catalog import query
from .rules import c

_LOG = "log AS (SELECT event_id, user_id, event_id % 400 AS edge, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' ELSE 'update' END AS action, value FROM events)"


def edits(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", (c("event_id") % 400).alias("edge"), "ts", F.when(c("event_type") == "error", "delete").when(c("event_type") == "signup", "add").otherwise("update").alias("action"), "value")


@query(f"WITH {_LOG} SELECT edge, action, value FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY ts DESC, event_id DESC) AS r FROM log) WHERE r = 1 AND action <> 'delete'")
def edge_states(spark, d):
    return history.current_state(edits(spark, d), "edge", ["ts", "event_id"], "action").select("edge", "action", "value")


@query(f"WITH {_LOG} SELECT event_id, edge, lag(value) OVER (PARTITION BY edge ORDER BY ts, event_id) AS before, value AS after FROM log")
def edge_audit(spark, d):
    return history.audited(edits(spark, d), "edge", ["ts", "event_id"], "value").select("event_id", "edge", c("_before").alias("before"), c("value").alias("after"))


@query(f"WITH {_LOG}, l AS (SELECT edge, action, value FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY ts DESC, event_id DESC) AS r FROM log) WHERE r = 1) SELECT coalesce(g.edge, l.edge) AS edge, coalesce(l.value, g.value) AS value FROM (SELECT p_partkey AS edge, p_retailprice::DOUBLE AS value FROM part) g FULL JOIN l ON l.edge = g.edge WHERE coalesce(action, '') <> 'delete'")
def edges_after_edits(spark, d):
    edges = table(spark, d, "part").select(c("p_partkey").alias("edge"), c("p_retailprice").cast("double").alias("value"))
    return history.overridden(edges, edits(spark, d), "edge", ["ts", "event_id"], "action", "value")


@query(f"WITH {_LOG} SELECT event_id, edge, action FROM log WHERE user_id = (SELECT min(user_id) FROM log) ORDER BY ts DESC, event_id DESC LIMIT 20")
def expert_edits(spark, d):
    log = edits(spark, d)
    return history.edits_of(log, log.agg(F.min("user_id")).first()[0], "user_id", ["ts", "event_id"], 20).select("event_id", "edge", "action")


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0 OR ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def outbox_pruned(spark, d):
    e = table(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("t")).first().t
    return history.pruned(e, e.filter(c("event_id") % 3 == 0), "event_id", "ts", F.lit(last).cast("timestamp_ntz")).select("event_id", "event_type")


@query("SELECT count(*)::BIGINT AS n FROM events WHERE event_id % 3 <> 0")
def outbox_count(spark, d):
    e = table(spark, d, "events")
    return history.pending(e, e.filter(c("event_id") % 3 == 0), "event_id").agg(F.count("*").alias("n"))


_METRICS = "SELECT user_id, event_type, ts::DATE AS snapshot_date, year(ts)::INTEGER AS snapshot_year, value::DECIMAL(18,6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts DESC, value DESC) AS r FROM events) WHERE r = 1"


def metrics(spark, d):
    return history.metric_rows(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "event_type", "value", "day", "ts")


@query(_METRICS)
def metric_history(spark, d):
    return metrics(spark, d)


@query(f"SELECT snapshot_date, value FROM ({_METRICS}) WHERE user_id = 7 AND event_type = 'view'")
def node_metrics(spark, d):
    return history.metrics_of(metrics(spark, d), "user_id", "event_type", 7, "view").select("snapshot_date", "value")


_GONE = "gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 17 = 0 UNION SELECT -5)"


def retracted(spark, d):
    return table(spark, d, "orders").filter(c("o_orderkey") % 17 == 0).select(c("o_orderkey").alias("id")).union(spark.range(1).select(F.lit(-5).cast("long")))


def invalid(spark, d):
    papers = table(spark, d, "orders").select(c("o_orderkey").alias("id"), (c("o_orderkey") % 5 == 0).alias("is_retracted"))
    edges = follow_ups(spark, d).withColumn("is_deleted", c("citing") % 11 == 0)
    return history.invalidated(papers, edges, retracted(spark, d), "id", ("citing", "cited"))


@query(f"WITH {_GONE} SELECT coalesce(o_orderkey, id) AS id, id IS NOT NULL OR coalesce(o_orderkey % 5 = 0, false) AS is_retracted FROM orders FULL JOIN gone ON id = o_orderkey")
def retracted_papers(spark, d):
    return invalid(spark, d)[0]


@query(f"WITH {FOLLOW_SQL} SELECT citing, cited, citing % 11 = 0 OR citing % 17 = 0 OR cited % 17 = 0 AS is_deleted FROM follow")
def invalidated_edges(spark, d):
    return invalid(spark, d)[1]


@query(f"WITH {_GONE} SELECT id, 'retraction' AS alert_type, false AS acknowledged FROM gone")
def retraction_alerts(spark, d):
    return invalid(spark, d)[2]


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 12 <> 0 AND (o_orderkey % 7 = 0 OR o_orderdate::DATE >= DATE '1998-01-01' - 365)")
def retraction_check(spark, d):
    """Retracted now: every fourth; before: every twelfth; every seventh has no day."""
    o, k = table(spark, d, "orders"), c("o_orderkey")
    now = o.select("o_orderkey", (k % 4 == 0).alias("is_retracted"), F.when(k % 7 != 0, c("o_orderdate").cast("date")).alias("day"))
    return history.newly_retracted(o.filter(k % 3 == 0).select("o_orderkey", (k % 4 == 0).alias("is_retracted")), now, "o_orderkey", "day", F.lit("1998-01-01").cast("date"))


@query("SELECT user_id, quarter, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, quarter ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, year(ts) || '-Q' || quarter(ts) AS quarter FROM events)) WHERE r = 1")
def corpus_snapshots(spark, d):
    e = table(spark, d, "events").withColumn("quarter", F.concat(F.year("ts").cast("string"), F.lit("-Q"), F.quarter("ts").cast("string")))
    return history.snapshots(e, "user_id", "quarter", ["ts", "event_id"]).select("user_id", "quarter", "event_id")


@query(
    f"WITH {FOLLOW_SQL}, {BASKETS_SQL}, pair AS (SELECT a.cited AS a, b.cited AS b, count(*) AS weight FROM basket a JOIN basket b ON a.citing = b.citing AND a.cited < b.cited GROUP BY ALL HAVING count(*) >= 2), "
    "c AS (SELECT 'citation:' || cited || ':' || citing AS edge_id, cited AS src, citing AS dst, 'citation' AS layer, CASE WHEN cited % 9 = 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight, 1.0::DOUBLE AS confidence, cited % 9 = 0 AS is_main_path, CASE WHEN cited % 9 = 0 THEN 0 ELSE 3 END AS lod_min FROM follow), "
    "o AS (SELECT 'cocitation:' || a || ':' || b, a, b, 'cocitation', ln(1 + weight), least(1.0, weight / 10.0)::DOUBLE, false, 1 FROM pair) SELECT edge_id, src, dst, layer, round(weight, 9) AS weight, confidence, is_main_path, lod_min::INTEGER AS lod_min FROM (SELECT * FROM c UNION ALL SELECT * FROM o)"
)
def visual_edges(spark, d):
    """Citations, some of them also on the main path, and co-citations."""
    e = follow_ups(spark, d).select(c("cited").alias("src"), c("citing").alias("dst"))
    main = (c("src") % 9 == 0)
    cites = e.withColumns({"weight": F.when(main, 2.5).otherwise(1.0), "confidence": F.lit(1.0), "is_main": main})
    pairs = graph.pairs_sharing(baskets(spark, d), "cited", "citing", 2)
    co = pairs.select(c("a").alias("src"), c("b").alias("dst"), F.log1p("weight").alias("weight"), F.least(F.lit(1.0), c("weight") / 10.0).alias("confidence"), F.lit(False).alias("is_main"))
    out = history.layered_edges({"citation": cites.union(cites.filter(main).withColumns({"weight": F.lit(1.0), "is_main": F.lit(False)})), "cocitation": co})
    return out.withColumn("weight", F.round("weight", 9))


@query("SELECT o_orderkey, '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_custkey\":' || o_custkey || ',\"parts\":[' || coalesce(l, '') || ']}' AS detail FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_partkey) AS l FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def paper_details(spark, d):
    parts = table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("item"))
    return history.documents_of(table(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_custkey"], {"parts": parts})


@query("SELECT token, p_partkey, count(*)::BIGINT AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+')) AS token FROM part) GROUP BY ALL")
def search_index(spark, d):
    return history.postings(table(spark, d, "part"), "p_partkey", "p_name")


@query(f"WITH {FOLLOW_SQL} SELECT cited, count(*)::BIGINT AS n FROM follow GROUP BY cited")
def written_and_read(spark, d):
    return history.overwritten(follow_ups(spark, d).groupBy("cited").agg(F.count("*").alias("n")), "edges")


@query("SELECT count(*)::BIGINT AS n FROM region WHERE false")
def emptied_tables(spark, d):
    return history.emptied(table(spark, d, "region"), "region").agg(F.count("*").alias("n"))


@query("SELECT (row_number() OVER (ORDER BY s, label))::INTEGER AS place, line FROM (SELECT 0 AS s, '' AS label, '## Papers' AS line UNION ALL SELECT 0, o_orderstatus, '- ' || o_orderstatus || ': ' || count(*) FROM orders GROUP BY o_orderstatus UNION ALL SELECT 1, '', '## Edges' UNION ALL SELECT 1, l_returnflag, '- ' || l_returnflag || ': ' || count(*) FROM lineitem GROUP BY l_returnflag)")
def markdown_report(spark, d):
    count = lambda t, k: table(spark, d, t).groupBy(c(k).alias("label")).agg(F.count("*").alias("value"))
    return history.report([("Papers", count("orders", "o_orderstatus")), ("Edges", count("lineitem", "l_returnflag"))])
