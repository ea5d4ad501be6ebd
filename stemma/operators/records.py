"""Records of remote catalogues as they land in files: JSON to flat papers, references, topics and affiliations; the best of several providers; writing them back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules
from . import relational

_ID = "id string, display_name string"
#: What is read of a work, a preprint record, a registered item and a scholar's record.
WORK = (
    "id string, doi string, title string, display_name string, publication_date string, publication_year int, cited_by_count long, language string, is_retracted boolean, is_paratext boolean, "
    f"abstract_inverted_index map<string, array<int>>, primary_topic struct<{_ID}, subfield: struct<id: string, display_name: string>, field: struct<id: string, display_name: string>, domain: struct<id: string, display_name: string>>, "
    f"topics array<struct<{_ID}, subfield: struct<id: string, display_name: string>, field: struct<id: string, display_name: string>, domain: struct<id: string, display_name: string>>>, "
    "authorships array<struct<author: struct<id: string, display_name: string>, institutions: array<struct<id: string, display_name: string, country_code: string>>>>, open_access struct<is_oa: boolean, oa_status: string, oa_url: string>, referenced_works array<string>, "
    "primary_location struct<source: struct<id: string, display_name: string>>, locations array<struct<landing_page_url: string, source: struct<id: string, display_name: string>>>, ids struct<arxiv: string, openalex: string>"
).replace("id string, display_name string", "id: string, display_name: string")
PREPRINT = "arxiv_id string, title string, abstract string, doi string, created string, datestamp string, license string, categories array<string>, authors array<string>"
ITEM = "DOI string, title array<string>, abstract string, issued struct<`date-parts`: array<array<int>>>, published struct<`date-parts`: array<array<int>>>, author array<struct<given: string, family: string, ORCID: string>>, reference array<struct<DOI: string>>, `is-referenced-by-count` long, license array<struct<URL: string>>"
SCHOLAR = "paperId string, externalIds struct<OpenAlex: string, DOI: string, ArXiv: string>, citationCount long, s2FieldsOfStudy array<struct<category: string>>, `references` array<struct<externalIds: struct<DOI: string, ArXiv: string>, paperId: string>>"


def tail(raw: Column) -> Column:
    """The last part of a path; null for nothing."""
    return F.nullif(F.element_at(F.split(raw, "/"), -1), F.lit(""))


def squeezed(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def from_inverted(index: Column) -> Column:
    """The text of a map from words to places."""
    each = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(each), lambda x: x["w"]), " "), F.lit(""))


def day_of(raw: Column) -> Column:
    """The first ten characters as a day, 1900 where they are none."""
    return F.coalesce(F.left(raw, F.lit(10)).try_cast("date"), F.lit("1900-01-01").cast("date"))


def works(raw: DataFrame, json: str) -> DataFrame:
    """Papers of JSON works; works without a title go."""
    w = raw.select(F.from_json(json, WORK).alias("w")).select("w.*")
    title = F.trim(F.coalesce("title", "display_name", F.lit("")))
    preprint = F.filter("locations", lambda x: F.lower(x["source"]["display_name"]).contains("arxiv") & x["landing_page_url"].rlike(r"arxiv\.org/abs/[^\s/]+"))
    link = F.coalesce(F.get(preprint, F.lit(0))["landing_page_url"], F.col("ids.arxiv"))
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return w.withColumn("title", title).filter("title <> ''").select(
        tail(F.col("id")).alias("openalex_id"), "doi", F.nullif(F.regexp_extract(link, r"arxiv\.org/abs/([^\s/]+)", 1), F.lit("")).alias("arxiv_id"), "title", from_inverted(F.col("abstract_inverted_index")).alias("abstract"),
        day_of(F.col("publication_date")).alias("publication_date"), "cited_by_count", tail(F.col("primary_topic.id")).alias("primary_topic_id"), tail(F.col("primary_topic.subfield.id")).alias("primary_subfield_id"),
        tail(F.col("primary_topic.field.id")).alias("primary_field_id"), tail(F.col("primary_topic.domain.id")).alias("primary_domain_id"), tail(F.col("primary_location.source.id")).alias("venue_id"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
        F.coalesce("is_paratext", F.lit(False)).alias("is_paratext"), "language", F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"), F.col("open_access.oa_status").alias("oa_status"), names.alias("authors"), F.coalesce(F.size(names), F.lit(0)).alias("n_authors"),
        F.coalesce(F.transform("referenced_works", lambda r: tail(r)), F.array().cast("array<string>")).alias("references_external"), F.lit("openalex").alias("source_provider"),
    )


def preprints(raw: DataFrame, json: str) -> DataFrame:
    """Papers of JSON preprint records; records without a title go."""
    w = raw.select(F.from_json(json, PREPRINT).alias("w")).select("w.*")
    names = F.filter(F.transform("authors", lambda n: F.trim(n)), lambda n: n != "")
    return w.withColumn("title", F.trim(F.coalesce("title", F.lit("")))).filter("title <> ''").select(
        F.nullif("arxiv_id", F.lit("")).alias("arxiv_id"), F.nullif("doi", F.lit("")).alias("doi"), "title", squeezed(F.col("abstract")).alias("abstract"), day_of(F.coalesce(F.nullif("created", F.lit("")), "datestamp")).alias("publication_date"),
        F.coalesce(F.size(names), F.lit(0)).alias("n_authors"), F.get("categories", F.lit(0)).alias("primary_topic_id"), F.lit("en").alias("language"), F.lit(True).alias("is_oa"), F.lit("green").alias("oa_status"), F.col("license"), names.alias("authors"), F.lit("arxiv").alias("source_provider"),
    )


def items(raw: DataFrame, json: str) -> DataFrame:
    """Papers of JSON items of a registry of identifiers; items without a title go."""
    w = raw.select(F.from_json(json, ITEM).alias("w")).select("w.*")
    parts = F.get(F.coalesce("issued.date-parts", "published.date-parts"), F.lit(0))
    year, month, day = (F.coalesce(F.get(parts, F.lit(i)), F.lit(d)) for i, d in ((0, 1900), (1, 1), (2, 1)))
    date = F.coalesce(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date"), F.make_date(year, F.lit(1), F.lit(1)))
    names = F.filter(F.transform("author", lambda a: F.trim(F.concat_ws(" ", F.nullif(a["given"], F.lit("")), a["family"]))), lambda n: n != "")
    url = F.lower(F.get(F.filter("license", lambda x: F.lower(x["URL"]).contains("creativecommons")), F.lit(0))["URL"])
    terms = F.when(url.contains("by-nc"), "cc-by-nc").when(url.contains("by/"), "cc-by").when(url.isNotNull(), "cc")
    refs = F.filter(F.transform("reference", lambda r: r["DOI"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return w.withColumn("title", F.trim(F.get("title", F.lit(0)))).filter("title <> ''").select(
        F.nullif(F.trim("DOI"), F.lit("")).alias("doi"), "title", squeezed(F.regexp_replace("abstract", "<[^>]+>", " ")).alias("abstract"), date.alias("publication_date"), F.coalesce(F.size(names), F.lit(0)).alias("n_authors"), names.alias("authors"),
        F.col("is-referenced-by-count").alias("cited_by_count"), terms.alias("license"), F.coalesce(terms.isNotNull(), F.lit(False)).alias("is_oa"), F.when(terms.isNotNull(), "gold").otherwise("closed").alias("oa_status"), F.coalesce(refs, F.array().cast("array<string>")).alias("references_external"), F.lit("crossref").alias("source_provider"),
    )


_UPDATES = ("paper_id", "openalex_id", "s2_paper_id", "cited_by_count", "primary_topic_id", "primary_subfield_id", "primary_field_id", "primary_domain_id")


def enriched_work(raw: DataFrame, key: str, json: str) -> DataFrame:
    """(updates, references, topics, affiliations) of a work that answers a paper (key)."""
    w = raw.select(F.col(key).alias("paper_id"), F.from_json(json, WORK).alias("w"))
    t, work = F.col("w.primary_topic"), c.external_id(F.col("w.id"))
    upd = F.struct(
        "paper_id", F.when(work["provider"] == "work", work["norm"]).alias("openalex_id"), F.lit(None).cast("string").alias("s2_paper_id"), F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by_count"), tail(t["id"]).alias("primary_topic_id"),
        tail(t["subfield"]["id"]).alias("primary_subfield_id"), tail(t["field"]["id"]).alias("primary_field_id"), tail(t["domain"]["id"]).alias("primary_domain_id"),
    )
    refs = F.filter(F.transform("w.referenced_works", lambda r: tail(r)), lambda x: x.isNotNull())
    refs = F.transform(refs, lambda x: F.struct(x.alias("external"), F.lit("openalex").alias("provider"), x.alias("norm")))
    topics = F.filter(F.transform("w.topics", lambda x: F.struct(tail(x["id"]).alias("topic_id"), x["display_name"].alias("topic_name"), tail(x["field"]["id"]).alias("field_id"), x["field"]["display_name"].alias("field_name"))), lambda x: x["topic_id"].isNotNull())
    places = F.flatten(F.transform("w.authorships", lambda a: F.coalesce(F.transform(a["institutions"], lambda i: F.struct(tail(i["id"]).alias("institution_id"), i["display_name"].alias("institution_name"), i["country_code"].alias("country_code"))), F.array().cast("array<struct<institution_id:string,institution_name:string,country_code:string>>"))))
    return w.select(upd.alias("updates"), _some(refs, "external:string,provider:string,norm:string").alias("references"), _some(topics, "topic_id:string,topic_name:string,field_id:string,field_name:string").alias("topics"), _some(places, "institution_id:string,institution_name:string,country_code:string").alias("affiliations"))


def _some(x: Column, fields: str) -> Column:
    return F.coalesce(x, F.array().cast(f"array<struct<{fields}>>"))


def enriched_scholar(raw: DataFrame, key: str, json: str) -> DataFrame:
    """(updates, references, topics) of a scholar's record that answers a paper (key)."""
    w = raw.select(F.col(key).alias("paper_id"), F.from_json(json, SCHOLAR).alias("w"))
    name = F.get("w.s2FieldsOfStudy", F.lit(0))["category"]
    topic = F.when(name.isNotNull(), F.concat(F.lit("S2F:"), F.left(F.regexp_replace(F.lower(name), "[^a-zA-Z0-9]+", "_"), F.lit(40))))
    work = c.external_id(F.col("w.externalIds.OpenAlex"))
    none = F.lit(None).cast("string")
    upd = F.struct("paper_id", F.when(work["provider"] == "work", work["norm"]).alias("openalex_id"), rules.scholar_id(F.col("w.paperId")).alias("s2_paper_id"), F.coalesce("w.citationCount", F.lit(0)).alias("cited_by_count"), topic.alias("primary_topic_id"), none.alias("primary_subfield_id"), none.alias("primary_field_id"), none.alias("primary_domain_id"))
    refs = F.transform("w.references", lambda r: F.coalesce(r["externalIds"]["DOI"], F.concat(F.lit("arXiv:"), r["externalIds"]["ArXiv"]), F.concat(F.lit("S2:"), r["paperId"])))
    refs = F.transform(F.filter(refs, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("external"), c.external_id(x)["provider"].alias("provider"), c.external_id(x)["norm"].alias("norm")))
    return w.select(upd.alias("updates"), _some(refs, "external:string,provider:string,norm:string").alias("references"), F.when(topic.isNotNull(), F.array(F.struct(topic.alias("topic_id"), name.alias("topic_name")))).otherwise(F.array().cast("array<struct<topic_id:string,topic_name:string>>")).alias("topics"))


def best_answer(answers: DataFrame, key: str, n_refs: str, provider: str, order: tuple[str, ...] = ("openalex", "crossref", "s2")) -> DataFrame:
    """Of each paper's answers the one with most references, then by provider."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(provider)), F.lit(0))
    rank = F.when(place == 0, 9).otherwise(place)
    return relational.latest_per_key(answers, [key], [F.desc_nulls_last(n_refs), rank, F.col(provider)])


def first_answer(answers: DataFrame, key: str, provider: str, order: tuple[str, ...]) -> DataFrame:
    """Of each paper's answers that of the first provider in the order that has one; other providers are not asked."""
    asked = answers.filter(F.col(provider).isin(*order))
    return relational.latest_per_key(asked, [key], [F.array_position(F.array(*map(F.lit, order)), F.col(provider))])


def write_back(papers: DataFrame, references: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, references) after enrichment: answers' values fill papers (larger citation counts win), new references are appended."""
    a = answers.select("updates.*")
    got = papers.join(a.select("paper_id", *[F.col(u).alias(f"_{u}") for u in _UPDATES[1:]]), "paper_id", "left")
    kept = {u: F.coalesce(F.col(f"_{u}"), F.col(u)) for u in _UPDATES[1:] if u in papers.columns}
    if "cited_by_count" in kept:
        kept["cited_by_count"] = F.greatest("cited_by_count", "_cited_by_count")
    new = answers.select(F.col("updates.paper_id").alias("citing"), F.explode("references").alias("r")).select("citing", F.col("r.external").alias("cited"))
    return got.withColumns(kept).select(papers.columns), relational.insert_ignore(references, new, ["citing", "cited"])


def backfill_targets(papers: DataFrame, most: int | None = None) -> DataFrame:
    """Papers that a look-up by identifier can complete: identifiers first, then those without a work, by date and id."""
    given = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    no_work = F.col("openalex_id").isNull() | ~F.col("openalex_id").startswith("W")
    found = papers.filter((no_work | F.col("primary_field_id").isNull() | F.coalesce(F.col("primary_topic_id").startswith("S2F:"), F.lit(False))) & (given("doi") | given("arxiv_id")))
    found = found.orderBy(F.when(given("doi"), 0).otherwise(1), F.when(no_work, 0).otherwise(1), "publication_date", "id")
    return found.limit(most) if most else found


def title_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the matching blocks over the lengths, as difflib counts them; no built-in function has this measure."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, u, v).ratio() if u and v else 0.0 for u, v in zip(x, y)])

    return F.pandas_udf(run, "double")(a, b)


def verified(pairs: DataFrame) -> DataFrame:
    """pairs (doi, arxiv_id, title, year and the same with work_ and ids of a found work) that are the same paper, with the ratio."""
    same = c.doi(F.col("doi")) == c.doi(F.col("work_doi"))
    mention = F.contains(F.lower(F.coalesce("work_ids", F.lit(""))), F.lower(c.arxiv(F.col("arxiv_id"))))
    ratio = F.col("ratio")
    rows = pairs.withColumn("ratio", matching_ratio(title_key(F.col("title")), title_key(F.col("work_title"))))
    near = F.abs(F.col("year") - F.col("work_year")) <= 1
    return rows.filter(F.coalesce(same, F.lit(False)) | F.coalesce(mention, F.lit(False)) | (ratio >= 0.94) | F.coalesce(near & (ratio >= 0.90), F.lit(False)))


def works_filter(topic: str, since: str, until: str, language: str = "en") -> str:
    """The filter that a catalogue of works takes."""
    return f"primary_topic.id:{topic},from_publication_date:{since},to_publication_date:{until},language:{language},is_retracted:false,has_abstract:true"


def landed_works(df: DataFrame, topic: str, since: str, until: str, language: str = "en", most: int | None = None) -> DataFrame:
    """What that filter keeps of landed works, so that a scan needs no network."""
    out = df.filter((F.col("primary_topic_id") == topic) & rules.within_dates(F.col("publication_date"), F.lit(since).cast("date"), F.lit(until).cast("date")) & (F.col("language") == language) & ~F.col("is_retracted") & F.col("abstract").isNotNull())
    return out.orderBy("publication_date", "openalex_id").limit(most) if most else out


def duplicates(incoming: DataFrame, known: DataFrame, least: float = 0.92) -> DataFrame:
    """(id, match, step) of incoming papers that known ones hold: by doi, then work, then preprint id, then similar title; the least known id counts."""
    left, found = incoming, None
    for step in ("doi", "openalex_id", "arxiv_id"):
        ids = known.filter(F.coalesce(F.col(step), F.lit("")) != "").groupBy(step).agg(F.min("id").alias("match"))
        hit = left.filter(F.coalesce(F.col(step), F.lit("")) != "").join(ids, step).select("id", "match", F.lit(step).alias("step"))
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select("id"), "id", "left_anti")

    def tokens(df: DataFrame) -> DataFrame:
        words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: F.length(w) > 1))
        return df.select("id", F.length("title").alias("long"), words.alias("s"))

    # Sets that similar share one of their rarest words of the known titles, so only those meet.
    a, b = tokens(left).filter(F.size("s") >= 3), tokens(known)
    df = b.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    rare = a.select("id", "long", "s", F.explode("s").alias("t")).join(df, "t", "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "t"))
    head = rare.withColumn("i", place).filter(F.col("i") <= F.size("s") - F.ceil(F.size("s") * least - 1e-9) + 1)
    met = head.join(b.select(F.col("id").alias("match"), F.col("long").alias("long_b"), F.col("s").alias("sb"), F.explode("s").alias("t")), "t").filter(F.col("long_b").between(F.floor(F.col("long") * 0.6), F.floor(F.col("long") * 1.4)))
    scored = met.select("id", "match", c.jaccard(F.col("s"), F.col("sb")).alias("score")).distinct().filter(F.col("score") >= least)
    best = scored.groupBy("id").agg(F.min(F.struct(-F.col("score"), F.col("match").alias("match")))["match"].alias("match"), F.lit("title").alias("step"))
    return found.unionByName(best)


def merged(existing: DataFrame, incoming: DataFrame, pairs: DataFrame, fill: list[str], most: str) -> DataFrame:
    """existing with the gaps of `fill` filled from its duplicates (pairs: id, match) and the larger count `most`."""
    got = incoming.join(pairs.select("id", "match"), "id").groupBy("match").agg(*[F.min_by(F.nullif(F.col(x), F.lit("")), F.when(F.coalesce(F.col(x), F.lit("")) != "", F.col("id"))).alias(f"_{x}") for x in fill], F.max(most).alias("_most"))
    out = existing.join(got.withColumnRenamed("match", "id"), "id", "left")
    return out.select(*[F.coalesce(F.nullif(F.col(x), F.lit("")), F.col(f"_{x}")).alias(x) if x in fill else F.greatest(F.coalesce(x, F.lit(0)), F.coalesce("_most", F.lit(0))).alias(x) if x == most else F.col(x) for x in existing.columns])
