"""Text retrieval over an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import words
from ..sources.tables import ensure_checkpoints


def query_terms(text: str, most: int = 16) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"[^\W]+", text.lower())))[:most]


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold a query word. Only the query's postings are ever shuffled."""
    terms = query_terms(query)
    rows = docs.select(F.col(key).alias("id"), words(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hits = rows.select("id", "len", F.explode(F.filter("w", lambda x: x.isin(terms))).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    s = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return s.groupBy("id").agg(F.sum(part).alias("score")).withColumnRenamed("id", key)


def overlap(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score): the share of the query's words that a document holds."""
    terms = query_terms(query)
    mine = F.array(*map(F.lit, terms))
    return docs.select(key, (F.size(F.array_intersect(mine, words(F.col(text)))) / F.lit(float(len(terms)))).alias("score")).filter("score > 0")


def phrase(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Documents that hold the query's words in a row."""
    needle = " " + " ".join(query_terms(query)) + " "
    return docs.filter(F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" ")).contains(needle)).select(key)


def ranked_list(scored: DataFrame, key: str, n: int) -> DataFrame:
    """(key, rank) of the n best."""
    best = scored.orderBy(F.desc(F.round("score", 9)), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), key)))  # n rows


def fuse_ranks(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank)."""
    every = lists[0].select(key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def diverse(spark: SparkSession, candidates: DataFrame, key: str, score: str, vector: str, k: int, balance: float = 0.7) -> DataFrame:
    """(key, pick): maximal marginal relevance, one pass over the candidates a pick; nothing but picks is collected."""
    ensure_checkpoints(spark)
    left = candidates.select(F.col(key).alias("id"), F.col(score).alias("s"), F.col(vector).alias("v"), F.lit(0.0).alias("near")).checkpoint()
    picks: list[int] = []
    for i in range(k):
        value = balance * F.col("s") - (1 - balance) * F.col("near")
        best = left.orderBy(F.desc(F.round(value, 12)), "id").limit(1).collect()
        if not best:
            break
        picks.append(best[0]["id"])
        chosen = F.array(*[F.lit(float(x)) for x in best[0]["v"]])

        def dot(a, b):
            return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)

        cosine = dot(F.col("v"), chosen) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(chosen, chosen))
        left = left.filter(F.col("id") != picks[-1]).withColumn("near", F.greatest("near", cosine) if i else cosine).checkpoint()
    return spark.createDataFrame([(p, i + 1) for i, p in enumerate(picks)], f"`{key}` long, pick int")
