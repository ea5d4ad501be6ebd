"""Queries on sentences, chains, vectors and calibration. They join the catalog's registry.

The tables' prose is invented, so the queries look for words that it has; tests apply the fixed patterns to English.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import atoms, stats, vectors
from ..sources.tables import table
from .catalog import ASKED, query

WORDS = {"new_constraint": "(?i)heat", "local_fix": "(?i)with by", "constraint": "(?i)onthe", "attempted_path": "(?i)for the|die", "failure_mechanism": "(?i)er is"}
OPEN, SUBJECT, SEVERE = "(?i)(the|die|el|le) ", "(?i)(heat|onthe|und|que|los) ", "(?i) (is|ist|es) "
RULES = {"tutorial": [r"\bred\b", r"\bring\b"], "roadmap": [r"\bsmall\b"], "survey": [r"\bblue\b", r"\bgear\b"]}
PRINCIPLES = {"heat": "(?i)the", "flow": "(?i)and", "field": "(?i)und|que"}
_PIECES = r"piece AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')), lambda s: s <> '') AS l FROM documents), sent AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(0, len(l)))::INTEGER AS place FROM piece)"
_STAGE = "CASE " + " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{n}'" for n, p in WORDS.items()) + " ELSE 'constraint' END"
#: Kinds of events stand in for the stages of a section.
_KINDS = {"error": "constraint", "view": "failure_mechanism", "click": "attempted_path", "purchase": "local_fix", "signup": "new_constraint"}


@query(f"WITH {_PIECES} SELECT doc_id, {_STAGE} AS stage, count(*)::BIGINT AS n, min(place)::INTEGER AS first FROM sent GROUP BY ALL")
def typed_sentences(spark, d):
    parts = atoms.sentences(table(spark, d, "documents"), "doc_id", "text")
    return parts.groupBy("doc_id", atoms.stage_of(F.col("sentence"), patterns=WORDS).alias("stage")).agg(F.count("*").alias("n"), F.min("place").alias("first"))


@query(
    f"WITH {_PIECES}, named AS (SELECT doc_id, place, sentence[1:500] AS s, coalesce(nullif(lower(regexp_extract(sentence, '{SUBJECT}', 1)), ''), 'technical limitation') AS keyword, CASE WHEN regexp_matches(sentence, '{SEVERE}') THEN 'high' ELSE 'medium' END AS severity FROM sent WHERE length(sentence) > 40 AND regexp_matches(sentence, '{OPEN}')), "
    "once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, keyword, lower(s[1:80]) ORDER BY place) AS k FROM named), five AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM once WHERE k = 1) "
    "SELECT doc_id, place, md5(s) AS description, keyword, severity FROM five WHERE n <= 5"
)
def limitation_atoms(spark, d):
    return atoms.limitation_atoms(table(spark, d, "documents"), "doc_id", "text", OPEN, SUBJECT, SEVERE).withColumn("description", F.md5(F.col("description").cast("binary")))


@query(f"WITH {_PIECES}, near AS (SELECT doc_id, place, sentence, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS context FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY place)) SELECT doc_id, place, md5(context) AS context FROM near WHERE regexp_matches(sentence, '(?i)heat|und ')")
def sentence_context(spark, d):
    parts = atoms.sentences(table(spark, d, "documents"), "doc_id", "text")
    return atoms.in_context(parts, "doc_id", "(?i)heat|und ").withColumn("context", F.md5(F.col("context").cast("binary")))


def _next(stage: str, after: str) -> str:
    return f"(SELECT min(e.p) FROM ev e WHERE e.user_id = s.user_id AND e.stage = '{stage}' AND e.p > {after})"


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"


@query(
    f"WITH ev AS (SELECT user_id, event_id AS p, {_CASE} AS stage FROM events), st AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS chain FROM ev WHERE stage IN ('constraint', 'failure_mechanism')), s AS (SELECT * FROM st WHERE chain <= 3), "
    f"a AS (SELECT s.*, CASE WHEN stage = 'failure_mechanism' THEN p ELSE {_next('failure_mechanism', 's.p')} END AS f FROM s), b AS (SELECT s.*, {_next('attempted_path', 'coalesce(s.f, s.p)')} AS t FROM a s), x AS (SELECT s.*, {_next('local_fix', 'coalesce(s.t, s.f, s.p)')} AS l FROM b s), "
    f"y AS (SELECT s.*, {_next('new_constraint', 'coalesce(s.l, s.t, s.f, s.p)')} AS n FROM x s), z AS (SELECT *, CASE WHEN stage = 'constraint' THEN p END AS o FROM y) "
    "SELECT user_id, chain::INTEGER AS chain, o AS \"constraint\", f AS failure_mechanism, t AS attempted_path, l AS local_fix, n AS new_constraint, CASE (o IS NOT NULL)::INT + (f IS NOT NULL)::INT + (t IS NOT NULL)::INT + (l IS NOT NULL)::INT + (n IS NOT NULL)::INT WHEN 5 THEN 'complete' WHEN 4 THEN 'partial' WHEN 3 THEN 'partial' ELSE 'fragment' END AS completeness "
    "FROM z WHERE (o IS NOT NULL)::INT + (f IS NOT NULL)::INT + (t IS NOT NULL)::INT + (l IS NOT NULL)::INT + (n IS NOT NULL)::INT > 1"
)
def stage_chains(spark, d):
    staged = table(spark, d, "events").select("user_id", "event_id", F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _KINDS.items()]).alias("stage"))
    out = atoms.chains(staged, "user_id", "event_id", "stage")
    return out.withColumn("completeness", atoms.completeness([F.col(n) for n in atoms.CHAIN]))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '\\bred\\b|\\bring\\b') THEN 'tutorial' WHEN regexp_matches(lower(p_name), '\\bsmall\\b') THEN 'roadmap' WHEN regexp_matches(lower(p_name), '\\bblue\\b|\\bgear\\b') THEN 'survey' ELSE 'non_review' END AS subtype, CASE WHEN regexp_matches(lower(p_name), '\\bred\\b|\\bring\\b|\\bsmall\\b|\\bblue\\b|\\bgear\\b') THEN 0.7 ELSE 1.0 END::DOUBLE AS penalty FROM part")
def review_subtypes(spark, d):
    kind = atoms.first_rule(F.col("p_name"), RULES, "non_review")
    return table(spark, d, "part").select("p_partkey", kind.alias("subtype"), F.when(kind == "non_review", 1.0).otherwise(0.7).alias("penalty"))


@query(
    "WITH h AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS {n}" for n, p in PRINCIPLES.items()) + " FROM documents) "
    "SELECT doc_id, CASE WHEN greatest(heat, flow, field) = 0 THEN 'other' WHEN heat >= flow AND heat >= field THEN 'heat' WHEN flow >= field THEN 'flow' ELSE 'field' END AS principle FROM h"
)
def principle_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", atoms.most_hits(F.col("text"), PRINCIPLES, "other").alias("principle"))


_SEEN = "SELECT o_custkey, max(o_orderdate)::DATE AS last_seen, count(*) FILTER (o_orderdate::DATE >= DATE '1999-10-01' AND o_orderdate::DATE <= DATE '2000-01-01')::BIGINT AS recent FROM orders WHERE o_orderdate::DATE <= DATE '2000-01-01' GROUP BY o_custkey"


@query(f"SELECT o_custkey, CASE WHEN recent > 0 THEN DATE '2000-01-01' ELSE last_seen END AS last_seen, recent = 0 AND date_diff('day', last_seen, DATE '2000-01-01') / 30.4 >= 18 AS legacy, CASE WHEN recent = 0 AND date_diff('day', last_seen, DATE '2000-01-01') / 30.4 >= 18 THEN 0.5 ELSE 1.0 END::DOUBLE AS decay FROM ({_SEEN})")
def knowledge_refresh(spark, d):
    day, end = F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date")
    seen = table(spark, d, "orders").filter(day <= end).groupBy("o_custkey").agg(F.max(day).alias("last"), F.count_if(day >= F.lit("1999-10-01").cast("date")).alias("recent"))
    return seen.select("o_custkey", c.refreshed(F.col("last"), F.col("recent"), F.lit(False), F.lit(1.0), end).alias("e")).select("o_custkey", "e.*")


@query(
    "WITH r AS (SELECT l_orderkey AS k, count(*) AS refs, count(*) FILTER (l_partkey % 7 = 0) AS linked FROM lineitem GROUP BY 1) "
    "SELECT o_orderkey, round(least(1.0, CASE WHEN o_orderkey % 4 = 0 THEN 0.2 ELSE 0 END + CASE WHEN o_orderpriority = '5-LOW' THEN 0.2 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 0.2 END + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 0.15 END + CASE WHEN coalesce(refs, 0) = 0 THEN 0.15 WHEN linked / refs::DOUBLE < 0.2 THEN 0.10 ELSE 0 END), 6)::DOUBLE AS uncertainty FROM orders LEFT JOIN r ON k = o_orderkey"
)
def uncertainty_scores(spark, d):
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("refs"), F.count_if(F.col("l_partkey") % 7 == 0).alias("linked"))
    rows = table(spark, d, "orders").join(refs, "o_orderkey", "left")
    abstract = F.when(F.col("o_orderkey") % 4 != 0, "x")
    field = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    score = c.uncertainty(abstract, field, F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus") == "F", F.coalesce("refs", F.lit(0)), F.coalesce("linked", F.lit(0)))
    return rows.select("o_orderkey", F.round(score, 6).alias("uncertainty"))


@query(
    "WITH b AS (SELECT min(ln(1 + o_totalprice)) AS a, max(ln(1 + o_totalprice)) AS z, min(o_custkey) AS x0, max(o_custkey) AS x1 FROM orders) "
    "SELECT o_orderkey, round(CASE WHEN z > a THEN 2 + (ln(1 + o_totalprice) - a) / (z - a) * 18 ELSE 11 END, 6) AS size, round(CASE WHEN x1 > x0 THEN -1 + (o_custkey - x0) / (x1 - x0)::DOUBLE * 2 ELSE 0 END, 6) AS x, round(least(1.0, greatest(0.0, (year(o_orderdate) - 1991) / 35.0)), 6)::DOUBLE AS z FROM orders, b"
)
def node_places(spark, d):
    """Sizes from 2 to 20 by logarithm, one axis to [-1, 1], depth by year from 1991 to 2026."""
    rows = table(spark, d, "orders")
    size = F.log1p("o_totalprice")
    ends = rows.agg(F.min(size), F.max(size), F.min("o_custkey"), F.max("o_custkey")).first()
    lo, hi, left, right = (F.lit(v) for v in ends)
    return rows.select(
        "o_orderkey", F.round(c.spread(size, lo, hi, 2.0, 20.0), 6).alias("size"), F.round(c.spread(F.col("o_custkey"), left, right, -1.0, 1.0), 6).alias("x"),
        F.round(c.clip((F.year("o_orderdate") - 1991) / F.lit(35.0)), 6).alias("z"),
    )


_UNIT = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)"


@query(f"WITH {_UNIT}, w AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM u), f AS (SELECT a.vec_id AS id, sqrt(greatest(2 - 2 * max(list_dot_product(a.e, b.e), 10)[10], 0)) AS distance FROM w a JOIN w b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT id, round(distance, 5) AS distance, distance > (SELECT avg(distance) + 2 * stddev_pop(distance) FROM f) AS outlier FROM f")
def vector_outliers(spark, d):
    return vectors.distance_outliers(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@query()
def whitened_vectors(spark, d):
    return vectors.whitened(table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def plane_layout(spark, d):
    return vectors.plane(table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def hashed_search(spark, d):
    """Whole texts that share words with what is asked; hits are recall only, not conclusions."""
    return vectors.fuzzy(table(spark, d, "documents"), "doc_id", "text", ASKED, 0.15).withColumn("claim_scope", F.lit("retrieval_context_only"))


@query()
def fitted_calibrator(spark, d):
    """Is a document of quality 1, by its length? One row: the fitted line and 21 points of its curve."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"))
    fit = stats.fit_calibrator(rows, "quality", "score")
    grid = spark.range(21).select((F.col("id") / 20.0).alias("score"))
    if fit["coef"] is None:
        return grid.withColumn("p", F.least("score", F.lit(0.65)))
    return grid.withColumn("p", c.calibrated(F.col("score"), fit["coef"], fit["intercept"], fit["base"], fit["support"]))
