"""Scans, joins, windows and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys with more than this part of all rows, and more than so many, are joined by a broadcast.
HOT, MANY = 2048, 1024


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has each key once, where one key may hold any share of rows.

    The keys that hold more than one in HOT of all rows, fewer than HOT of them, are looked up in a broadcast; the
    others are shuffled, so that no task gets more than that share (or MANY rows) for one key. counts: (key, count), if known.
    """
    counts = (rows.groupBy(key).count() if counts is None else counts).filter(F.col(key).isNotNull())
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    least = max((total or 0) // HOT, MANY)
    if (most or 0) <= least:
        return rows.join(table, key, how)
    often = [r[0] for r in counts.filter(F.col("count") > least).select(key).collect()]
    is_hot = F.coalesce(F.col(key).isin(often), F.lit(False))
    return rows.filter(is_hot).join(F.broadcast(table.filter(F.col(key).isin(often))), key, how).unionByName(rows.filter(~is_hot).join(table, key, how))


def keyset_page(df: DataFrame, key: str, predicate: Column, cursor, size: int) -> DataFrame:
    """The rows after cursor, one more than size so that the caller knows whether there are further ones."""
    return df.filter(predicate).filter(F.col(key) > F.lit(cursor)).orderBy(key).limit(size + 1)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def in_scope(df: DataFrame, key: str, *scopes: DataFrame) -> DataFrame:
    """Rows whose key any scope has."""
    ids = scopes[0]
    for s in scopes[1:]:
        ids = ids.union(s)
    return df.join(ids.toDF(key).distinct(), key, "left_semi")


def merge(target: DataFrame, source: DataFrame, key: str, refresh: bool = True) -> DataFrame:
    """Insert or update by key; with refresh, values that are there replace, else they only fill gaps."""
    t, s = target.alias("t"), source.alias("s")
    pick = (lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}"))) if refresh else (lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")))
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full").select(*[pick(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def link_references(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Status of each reference (provider, norm) against the ids (provider, norm, id) of the library."""
    known = ids.groupBy("provider", "norm").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target"))
    status = F.when(F.col("norm").isNull(), "unclassifiable").when(F.col("n").isNull(), "no_local_match").when(F.col("n") == 1, "exact_linkable").otherwise("ambiguous_local_match")
    return refs.join(known, ["provider", "norm"], "left").withColumn("status", status).withColumn("target", F.when(F.col("n") == 1, F.col("target")))


def unresolved(atoms: DataFrame, resolutions: DataFrame, key: str, confidence: str, above: float) -> DataFrame:
    """Atoms without a resolution of more than this confidence."""
    return atoms.join(resolutions.filter(F.col(confidence) > above).select(key), key, "left_anti")


def induced_edges(edges: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges (citing, cited) with both ends in nodes (id), with the weight of the reversed edge in weights or 1."""
    ids = nodes.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("id", "cited"), "cited", "left_semi").dropDuplicates(["citing", "cited"])
    back = weights.select(F.col("cited").alias("citing"), F.col("citing").alias("cited"), "weight")
    return inside.join(back, ["citing", "cited"], "left").select("citing", "cited", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def within(df: DataFrame, key: str, time: str, seconds: int, order: list[str]) -> Column:
    """How many rows of the key fall in the window that ends at the row's time."""
    w = Window.partitionBy(key).orderBy(F.col(time).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return F.count("*").over(w)


def backlog(df: DataFrame, key: str, time: str, opened: str, resolved: str) -> DataFrame:
    """max(0, before + opened - resolved) along time, as a running sum less its running minimum."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("_s", F.sum(F.col(opened) - F.col(resolved)).over(w))
    return s.withColumn("backlog", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")
