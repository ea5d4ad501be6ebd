"""Queries over the record operators. Orders and customers are written as JSON records of each kind first, so the SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..sources.tables import baskets, table
from .catalog import query
from .rules import c

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_MANY = "(o_orderkey % 4)::INTEGER"


def landed(spark, d):
    """Orders as JSON works: every fifth has no title, every third no topic, each has as many references as its key over 4 leaves."""
    o = table(spark, d, "orders").withColumn("k", c("o_orderkey").cast("string"))
    url = lambda x: F.concat(F.lit("https://works.example.org/"), x)
    level = lambda p, n: F.struct(url(F.concat(F.lit(p), (c("o_custkey") % n).cast("string"))).alias("id"), F.lit("name").alias("display_name"))
    topic = F.struct(url(F.concat(F.lit("T"), (c("o_custkey") % 50).cast("string"))).alias("id"), F.lit("topic").alias("display_name"), level("S", 9).alias("subfield"), level("F", 5).alias("field"), level("D", 3).alias("domain"))
    refs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < c("o_orderkey") % 4), lambda i: url(F.concat(F.lit("W"), (c("o_orderkey") + i).cast("string"))))
    work = F.struct(
        url(F.concat(F.lit("W"), "k")).alias("id"), F.concat(F.lit("https://doi.org/10.1234/O."), "k").alias("doi"), F.when(c("o_orderkey") % 5 != 0, F.concat(F.lit(" Order "), "k")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        (c("o_orderkey") % 97).alias("cited_by_count"), F.lit("en").alias("language"), (c("o_orderstatus") == "F").alias("is_retracted"), F.create_map(F.lit("first"), F.array(F.lit(0), F.lit(2)), c("o_orderpriority"), F.array(F.lit(1))).alias("abstract_inverted_index"),
        F.when(c("o_orderkey") % 3 != 0, topic).alias("primary_topic"), F.when(c("o_orderkey") % 3 != 0, F.array(topic)).alias("topics"), refs.alias("referenced_works"),
        F.array(F.struct(F.struct(F.lit("a").alias("id"), F.concat(F.lit("Author "), c("o_custkey").cast("string")).alias("display_name")).alias("author"), F.array(F.struct(url(F.lit("I7")).alias("id"), F.lit("Place").alias("display_name"), F.lit("XX").alias("country_code"))).alias("institutions"))).alias("authorships"),
        F.array(F.struct(F.concat(F.lit("https://arxiv.org/abs/2101."), F.lpad("k", 5, "0")).alias("landing_page_url"), F.struct(F.lit("x").alias("id"), F.when(c("o_orderkey") % 2 == 0, "arXiv e-prints").otherwise("Elsewhere").alias("display_name")).alias("source"))).alias("locations"),
    )
    return o.select("o_orderkey", c("k").alias("paper_id"), F.to_json(work).alias("json"))


@query(
    f"SELECT 'W' || o_orderkey AS openalex_id, CASE WHEN o_orderkey % 2 = 0 THEN '2101.' || lpad(o_orderkey::VARCHAR, 5, '0') END AS arxiv_id, 'Order ' || o_orderkey AS title, 'first ' || o_orderpriority || ' first' AS abstract, o_orderdate::DATE AS publication_date, (o_orderkey % 97)::BIGINT AS cited_by_count, "
    f"CASE WHEN o_orderkey % 3 <> 0 THEN 'T' || o_custkey % 50 END AS primary_topic_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'F' || o_custkey % 5 END AS primary_field_id, o_orderstatus = 'F' AS is_retracted, 1 AS n_authors, {_MANY} AS n_refs FROM orders WHERE o_orderkey % 5 <> 0"
)
def normalised_works(spark, d):
    out = records.works(landed(spark, d), "json")
    return out.select("openalex_id", "arxiv_id", "title", "abstract", "publication_date", "cited_by_count", "primary_topic_id", "primary_field_id", "is_retracted", "n_authors", F.size("references_external").alias("n_refs"))


@query(
    f"SELECT o_orderkey::VARCHAR AS paper_id, 'W' || o_orderkey AS openalex_id, (o_orderkey % 97)::BIGINT AS cited_by_count, CASE WHEN o_orderkey % 3 <> 0 THEN 'T' || o_custkey % 50 END AS topic, CASE WHEN o_orderkey % 3 <> 0 THEN 'D' || o_custkey % 3 END AS domain, {_MANY} AS n_refs, CASE WHEN {_MANY} > 0 THEN 'W' || o_orderkey END AS first_ref, (CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) AS n_topics, 'I7' AS place FROM orders"
)
def enriched_works(spark, d):
    out = records.enriched_work(landed(spark, d), "paper_id", "json")
    return out.select("updates.paper_id", "updates.openalex_id", "updates.cited_by_count", c("updates.primary_topic_id").alias("topic"), c("updates.primary_domain_id").alias("domain"), F.size("references").alias("n_refs"), F.get("references", F.lit(0))["norm"].alias("first_ref"), F.size("topics").alias("n_topics"), F.get("affiliations", F.lit(0))["institution_id"].alias("place"))


@query("SELECT '2101.' || lpad(c_custkey::VARCHAR, 5, '0') AS arxiv_id, c_name AS title, CASE WHEN c_custkey % 4 <> 0 THEN 'two words' END AS abstract, CASE WHEN c_custkey % 7 = 0 THEN DATE '1900-01-01' ELSE DATE '2020-01-01' + (c_custkey % 100)::INTEGER END AS publication_date, CASE WHEN c_custkey % 3 <> 0 THEN 'cs.' || c_nationkey END AS topic, (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END) AS n_authors FROM customer WHERE c_custkey % 6 <> 0")
def normalised_preprints(spark, d):
    k = c("c_custkey")
    rec = F.struct(
        F.concat(F.lit("2101."), F.lpad(k.cast("string"), 5, "0")).alias("arxiv_id"), F.when(k % 6 != 0, F.concat(F.lit("  "), "c_name")).otherwise(" ").alias("title"), F.when(k % 4 != 0, " two \n words ").alias("abstract"),
        F.when(k % 7 == 0, "not a day").otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (k % 100).cast("int")).cast("string")).alias("created"), F.when(k % 3 != 0, F.array(F.concat(F.lit("cs."), c("c_nationkey").cast("string")), F.lit("x"))).otherwise(F.array()).alias("categories"),
        F.when(k % 2 == 0, F.array(F.lit("A B"), F.lit(" "), F.lit("C"))).otherwise(F.array(F.lit("A B"))).alias("authors"),
    )
    out = records.preprints(table(spark, d, "customer").select(F.to_json(rec).alias("json")), "json")
    return out.select("arxiv_id", "title", "abstract", "publication_date", c("primary_topic_id").alias("topic"), "n_authors")


@query(
    "SELECT '10.5/' || c_custkey AS doi, c_name AS title, 'bold text' AS abstract, CASE c_custkey % 4 WHEN 0 THEN DATE '2019-05-06' WHEN 1 THEN DATE '2019-05-01' WHEN 2 THEN DATE '2019-01-01' ELSE DATE '1900-01-01' END AS publication_date, c_custkey::BIGINT AS cited_by_count, CASE c_custkey % 3 WHEN 0 THEN 'cc-by-nc' WHEN 1 THEN 'cc-by' END AS license, CASE WHEN c_custkey % 3 < 2 THEN 'gold' ELSE 'closed' END AS oa_status, 1 AS n_refs, 'Ada Example' AS author FROM customer"
)
def normalised_items(spark, d):
    k = c("c_custkey")
    parts = F.when(k % 4 == 0, F.array(F.lit(2019), F.lit(5), F.lit(6))).when(k % 4 == 1, F.array(F.lit(2019), F.lit(5))).when(k % 4 == 2, F.array(F.lit(2019), F.lit(13), F.lit(45)))
    url = F.when(k % 3 == 0, "https://creativecommons.org/licenses/by-nc/4.0/").when(k % 3 == 1, "http://CreativeCommons.org/licenses/by/4.0/").otherwise("https://publisher.example.org/terms")
    rec = F.struct(
        F.concat(F.lit(" 10.5/"), k.cast("string")).alias("DOI"), F.array(c("c_name"), F.lit("second")).alias("title"), F.lit("<jats:p>bold</jats:p>  <i>text</i>").alias("abstract"), F.struct(F.array(parts).alias("date-parts")).alias("issued"), k.alias("is-referenced-by-count"),
        F.array(F.struct(F.lit("Ada").alias("given"), F.lit("Example").alias("family"))).alias("author"), F.array(F.struct(F.lit("10.1/x").alias("DOI")), F.struct(F.lit(None).cast("string").alias("DOI"))).alias("reference"), F.array(F.struct(url.alias("URL"))).alias("license"),
    )
    out = records.items(table(spark, d, "customer").select(F.to_json(rec).alias("json")), "json")
    return out.select("doi", "title", "abstract", "publication_date", "cited_by_count", "license", "oa_status", F.size("references_external").alias("n_refs"), F.get("authors", F.lit(0)).alias("author"))


@query(
    "SELECT c_custkey::VARCHAR AS paper_id, CASE WHEN c_custkey % 2 = 0 THEN 'W' || c_custkey END AS openalex_id, 'abc' || c_custkey AS s2_paper_id, CASE WHEN c_custkey % 3 <> 0 THEN 'S2F:' || lower(c_mktsegment) END AS topic, 2 AS n_refs, 'doi' AS first_kind, 'arxiv' AS second_kind FROM customer"
)
def scholar_records(spark, d):
    k = c("c_custkey")
    none = F.lit(None).cast("string")
    ref = lambda doi, arxiv, pid: F.struct(F.struct(doi.alias("DOI"), arxiv.alias("ArXiv")).alias("externalIds"), pid.alias("paperId"))
    rec = F.struct(
        F.concat(F.lit("S2:abc"), k.cast("string")).alias("paperId"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("W"), k.cast("string"))).alias("OpenAlex")).alias("externalIds"), k.alias("citationCount"),
        F.when(k % 3 != 0, F.array(F.struct(c("c_mktsegment").alias("category")))).alias("s2FieldsOfStudy"), F.array(ref(F.lit("10.1234/x"), none, none), ref(none, F.lit("2101.00001"), none), ref(none, none, none)).alias("references"),
    )
    out = records.enriched_scholar(table(spark, d, "customer").select(k.cast("string").alias("paper_id"), F.to_json(rec).alias("json")), "paper_id", "json")
    return out.select("updates.paper_id", "updates.openalex_id", "updates.s2_paper_id", c("updates.primary_topic_id").alias("topic"), F.size("references").alias("n_refs"), F.get("references", F.lit(0))["provider"].alias("first_kind"), F.get("references", F.lit(1))["provider"].alias("second_kind"))


_ANSWER = "a AS (SELECT l_orderkey, l_partkey % 9 AS n, CASE l_linenumber % 4 WHEN 0 THEN 's2' WHEN 1 THEN 'crossref' WHEN 2 THEN 'openalex' ELSE 'other' END AS provider FROM lineitem)"
_RANK = "CASE provider WHEN 'openalex' THEN 1 WHEN 'crossref' THEN 2 WHEN 's2' THEN 3 ELSE 9 END"


def answers(spark, d):
    names = F.array(*map(F.lit, ("s2", "crossref", "openalex", "other")))
    return table(spark, d, "lineitem").select("l_orderkey", (c("l_partkey") % 9).alias("n"), F.get(names, (c("l_linenumber") % 4).cast("int")).alias("provider")).distinct()


@query(f"WITH {_ANSWER} SELECT l_orderkey, provider, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, {_RANK}, provider) AS r FROM (SELECT DISTINCT * FROM a)) WHERE r = 1")
def best_answers(spark, d):
    return records.best_answer(answers(spark, d), "l_orderkey", "n", "provider").select("l_orderkey", "provider", "n")


@query("SELECT DISTINCT l_orderkey, min(CASE l_linenumber % 4 WHEN 0 THEN 's2' ELSE 't openalex' END) OVER (PARTITION BY l_orderkey) = 's2' AS from_first FROM lineitem WHERE l_linenumber % 4 IN (0, 2)")
def first_answers(spark, d):
    one = answers(spark, d).select("l_orderkey", "provider").distinct()
    return records.first_answer(one, "l_orderkey", "provider", ("s2", "openalex")).select("l_orderkey", (c("provider") == "s2").alias("from_first"))


_P = "p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'W' || o_orderkey ELSE 'x' END AS openalex_id, CASE WHEN o_orderkey % 7 <> 0 THEN '31' END AS primary_field_id, CASE WHEN o_custkey % 5 = 0 THEN 'S2F:physics' ELSE 'T1' END AS primary_topic_id, CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || o_orderkey ELSE '' END AS doi, CASE WHEN o_orderkey % 5 <> 0 THEN '2101.1' END AS arxiv_id, o_orderdate AS publication_date FROM orders)"


def papers(spark, d):
    k = c("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 1, F.concat(F.lit("W"), k.cast("string"))).when(k % 3 == 2, "x").alias("openalex_id"), F.when(k % 7 != 0, "31").alias("primary_field_id"), F.when(c("o_custkey") % 5 == 0, "S2F:physics").otherwise("T1").alias("primary_topic_id"),
        F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).otherwise("").alias("doi"), F.when(k % 5 != 0, "2101.1").alias("arxiv_id"), c("o_orderdate").alias("publication_date"),
    )


@query(f"WITH {_P} SELECT id, doi FROM p WHERE (openalex_id IS NULL OR openalex_id NOT LIKE 'W%' OR primary_field_id IS NULL OR primary_topic_id LIKE 'S2F:%') AND (coalesce(doi, '') <> '' OR coalesce(arxiv_id, '') <> '') ORDER BY coalesce(doi, '') = '', coalesce(openalex_id LIKE 'W%', false), publication_date, id LIMIT 300")
def backfill_targets(spark, d):
    return records.backfill_targets(papers(spark, d), 300).select("id", "doi")


@query("SELECT p_partkey, ratio::DOUBLE AS ratio FROM part JOIN (VALUES (0, 1.0), (1, 0.0), (3, 0.96), (4, 0.909091)) t(k, ratio) ON k = p_partkey % 6")
def verified_matches(spark, d):
    """Six cases: same identifier, preprint named, neither, near titles, near titles of neighbouring years, near titles of far years."""
    rows = [("10.1/a", None, "Same", 2000, "https://doi.org/10.1/A", "same", 2000, ""), (None, "2101.00001v2", "", 2000, None, "x", None, "{'arxiv': '2101.00001'}"), ("10.1/a", None, "One", 2000, "10.1/b", "Other", 2000, ""),
            (None, None, "abcdefghijklm", 2000, None, "abcdefghijkl", 1990, ""), (None, None, "abcdefghijklmnopqrstu", 2000, None, "abcdefghijklmnopqrstvwx", 2001, ""), (None, None, "abcdefghijklmnopqrstu", 2000, None, "abcdefghijklmnopqrstvwx", 2002, "")]
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_k int, doi string, arxiv_id string, title string, year int, work_doi string, work_title string, work_year int, work_ids string")
    pairs = table(spark, d, "part").select("p_partkey", (c("p_partkey") % 6).cast("int").alias("_k")).join(F.broadcast(cases), "_k")
    return records.verified(pairs).select("p_partkey", F.round("ratio", 6).alias("ratio"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 ORDER BY c_custkey LIMIT 40")
def filtered_works(spark, d):
    cust = table(spark, d, "customer")
    w = cust.select(c("c_custkey"), F.lpad(c("c_custkey").cast("string"), 9, "0").alias("openalex_id"), c("c_nationkey").cast("string").alias("primary_topic_id"), F.lit("2020-01-01").cast("date").alias("publication_date"), F.lit("en").alias("language"), (c("c_acctbal") <= 0).alias("is_retracted"), F.lit("x").alias("abstract"))
    return records.landed_works(w, "3", "2019-01-01", "2020-01-01", most=40).select("c_custkey")


_DUP = (
    "kn AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'd' || p_partkey % 40 END AS doi, CASE WHEN p_partkey % 3 = 0 THEN 'w' || p_partkey END AS openalex_id, 'red blue green gold part number' || p_partkey AS title FROM part WHERE p_partkey % 2 = 0), "
    "inc AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'd' || p_partkey % 40 END AS doi, CASE WHEN p_partkey % 3 <> 1 THEN 'w' || (p_partkey + 1) END AS openalex_id, 'Red, Blue green gold part number' || (p_partkey + 1) || '!' AS title FROM part WHERE p_partkey % 2 = 1)"
)


@query(
    f"WITH {_DUP}, a AS (SELECT i.id, min(k.id) AS match FROM inc i JOIN kn k ON k.doi = i.doi GROUP BY i.id), b AS (SELECT i.id, min(k.id) AS match FROM inc i JOIN kn k ON k.openalex_id = i.openalex_id WHERE i.id NOT IN (SELECT id FROM a) GROUP BY i.id) "
    "SELECT id, match, 'doi' AS step FROM a UNION ALL SELECT id, match, 'openalex_id' FROM b UNION ALL SELECT i.id, i.id + 1, 'title' FROM inc i WHERE i.id NOT IN (SELECT id FROM a) AND i.id NOT IN (SELECT id FROM b) AND i.id + 1 IN (SELECT id FROM kn)"
)
def duplicate_cascade(spark, d):
    p, k = table(spark, d, "part"), c("p_partkey")
    s = k.cast("string")
    known = p.filter(k % 2 == 0).select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("d"), (k % 40).cast("string"))).alias("doi"), F.when(k % 3 == 0, F.concat(F.lit("w"), s)).alias("openalex_id"), F.lit("").alias("arxiv_id"), F.concat(F.lit("red blue green gold part number"), s).alias("title"))
    nxt = (k + 1).cast("string")
    new = p.filter(k % 2 == 1).select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("d"), (k % 40).cast("string"))).alias("doi"), F.when(k % 3 != 1, F.concat(F.lit("w"), nxt)).alias("openalex_id"), F.lit(None).cast("string").alias("arxiv_id"), F.concat(F.lit("Red, Blue green gold part number"), nxt, F.lit("!")).alias("title"))
    return records.duplicates(new, known)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'own' WHEN p_partkey % 3 = 0 THEN 'new' ELSE '' END AS doi, greatest(p_partkey % 50, CASE WHEN p_partkey % 3 = 0 THEN 30 ELSE 0 END)::BIGINT AS cites FROM part")
def merged_duplicates(spark, d):
    k = c("p_partkey")
    existing = table(spark, d, "part").select(k.alias("id"), F.when(k % 4 == 0, "own").otherwise("").alias("doi"), (k % 50).alias("cites"))
    new = table(spark, d, "part").filter(k % 3 == 0).select((-k).alias("id"), F.lit("new").alias("doi"), F.lit(30).cast("long").alias("cites"))
    out = records.merged(existing, new, new.select("id", (-c("id")).alias("match")), ["doi"], "cites")
    return out.select("id", F.coalesce("doi", F.lit("")).alias("doi"), c("cites").cast("long").alias("cites"))


@query(
    "SELECT o_orderkey::VARCHAR AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN 'W' || o_orderkey ELSE 'old' END AS openalex_id, CASE WHEN o_orderkey % 2 = 0 THEN greatest(10, o_orderkey % 97) ELSE 10 END::BIGINT AS cited_by_count FROM orders"
)
def enrichment_written_back(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("paper_id"), F.lit("old").alias("openalex_id"), F.lit(10).cast("long").alias("cited_by_count"))
    got = records.enriched_work(landed(spark, d).filter(c("o_orderkey") % 2 == 0), "paper_id", "json")
    none = baskets(spark, d).select(c("citing").cast("string").alias("citing"), c("cited").cast("string").alias("cited")).limit(0)
    return records.write_back(o, none, got)[0]


@query("SELECT o_orderkey::VARCHAR AS citing, 'W' || (o_orderkey + i) AS cited FROM orders, range(3) t(i) WHERE o_orderkey % 2 = 0 AND i < o_orderkey % 4")
def references_written_back(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("paper_id"))
    got = records.enriched_work(landed(spark, d).filter(c("o_orderkey") % 2 == 0), "paper_id", "json")
    old = got.select(c("updates.paper_id").alias("citing"), F.explode("references").alias("r")).filter(F.endswith("r.external", F.lit("0"))).select("citing", c("r.external").alias("cited"))
    return records.write_back(o, old, got)[1]
