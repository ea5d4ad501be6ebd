"""Logs and sinks: edits and their current state, outboxes, metric histories, retractions, snapshots, layered edges, documents with their index, tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.tables import shared_folder
from . import relational


def current_state(log: DataFrame, key: str, time: list[str], action: str, deleted: str = "delete") -> DataFrame:
    """The last entry of each key, without those that a last entry deletes."""
    return relational.latest_per_key(log, [key], [F.desc(t) for t in time]).filter(F.col(action) != deleted)


def audited(log: DataFrame, key: str, time: list[str], value: str) -> DataFrame:
    """log with _before, the value that the key's entry before had."""
    return log.withColumn("_before", F.lag(value).over(Window.partitionBy(key).orderBy(*time)))


def overridden(edges: DataFrame, log: DataFrame, key: str, time: list[str], action: str, value: str) -> DataFrame:
    """edges (key, value) after all edits: added, changed and without the deleted ones."""
    last = relational.latest_per_key(log, [key], [F.desc(t) for t in time]).select(key, F.col(action).alias("_a"), F.col(value).alias("_v"))
    return edges.select(key, value).join(last, key, "full").filter(F.coalesce(F.col("_a"), F.lit("")) != "delete").select(key, F.coalesce("_v", value).alias(value))


def edits_of(log: DataFrame, who: str | None, expert: str, time: list[str], most: int) -> DataFrame:
    """An expert's edits (anybody's for None), latest first."""
    return (log if who is None else log.filter(F.col(expert) == who)).orderBy(*[F.desc(t) for t in time]).limit(most)


def pending(events: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return events.join(processed.select(key), key, "left_anti")


def pruned(events: DataFrame, processed: DataFrame, key: str, time: str, before: Column) -> DataFrame:
    """events without those that are processed and older."""
    old = processed.select(F.col(key).alias("_k")).distinct().withColumn("_done", F.lit(True))
    return events.join(old, F.col(key) == F.col("_k"), "left").filter(F.col("_done").isNull() | (F.col(time) >= before)).drop("_k", "_done")


def metric_rows(df: DataFrame, node: str, metric: str, value: str, day: str, time: str) -> DataFrame:
    """(node, metric, snapshot_date, snapshot_year, value): the last value of each node, metric and day, with six decimals."""
    last = relational.latest_per_key(df, [node, metric, day], [F.desc(time), F.desc(value)])
    return last.select(node, metric, F.col(day).alias("snapshot_date"), F.year(day).alias("snapshot_year"), F.col(value).cast("decimal(18,6)").alias("value"))


def metrics_of(rows: DataFrame, node: str, metric: str, who, name: str | None = None) -> DataFrame:
    """A node's history, of one metric or all, in the order of days."""
    own = rows.filter(F.col(node) == who)
    return (own if name is None else own.filter(F.col(metric) == name)).orderBy("snapshot_date", metric)


def invalidated(papers: DataFrame, edges: DataFrame, retracted: DataFrame, key: str, ends: tuple[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, edges, alerts) after retractions (key): papers are marked, also those that were not there; edges at them are deleted softly; each has an alert."""
    r = retracted.select(key).distinct()
    marked = papers.join(r.withColumn("_r", F.lit(True)), key, "full").withColumn("is_retracted", F.coalesce("_r", "is_retracted", F.lit(False))).drop("_r")
    hit = edges
    for i, end in enumerate(ends):
        hit = hit.join(r.select(F.col(key).alias(end), F.lit(True).alias(f"_r{i}")), end, "left")
    hit = hit.withColumn("is_deleted", F.coalesce("_r0", "_r1", F.col("is_deleted"), F.lit(False))).drop("_r0", "_r1")
    return marked, hit.select(edges.columns), r.select(key, F.lit("retraction").alias("alert_type"), F.lit(False).alias("acknowledged"))


def newly_retracted(before: DataFrame, now: DataFrame, key: str, day: str, as_of: Column, days: int = 365) -> DataFrame:
    """Papers of the last `days` (or of no day) that are retracted now and were not before."""
    recent = now.filter(F.col(day).isNull() | (F.col(day) >= F.date_sub(as_of, days)))
    was = before.select(key, F.col("is_retracted").alias("_was"))
    return recent.filter("is_retracted").join(was, key, "left").filter(~F.coalesce(F.col("_was"), F.lit(False))).select(key)


def snapshots(rows: DataFrame, corpus: str, quarter: str, time: list[str]) -> DataFrame:
    """The last snapshot of each corpus and quarter."""
    return relational.latest_per_key(rows, [corpus, quarter], [F.desc(t) for t in time])


def layered_edges(layers: dict[str, DataFrame]) -> DataFrame:
    """(edge_id, src, dst, layer, weight, confidence, is_main_path, lod_min) of layers (src, dst, weight, confidence, is_main), in their order; of one id the first stays, but for one on the main path."""
    every = None
    for i, (name, df) in enumerate(layers.items()):
        ident = F.concat_ws(":", F.lit(name), F.col("src").cast("string"), F.col("dst").cast("string"))
        lod = F.when(F.col("is_main"), 0).otherwise({"citation": 3, "cocitation": 1, "semantic": 2}.get(name, 0))
        rows = df.select(ident.alias("edge_id"), "src", "dst", F.lit(name).alias("layer"), F.col("weight").cast("double").alias("weight"), F.col("confidence").cast("double").alias("confidence"), F.col("is_main").alias("is_main_path"), lod.alias("lod_min"), F.lit(i).alias("_o"))
        every = rows if every is None else every.unionByName(rows)
    return relational.latest_per_key(every, ["edge_id"], [F.desc("is_main_path"), F.col("_o"), F.desc("weight")]).drop("_o")


def documents_of(papers: DataFrame, key: str, fields: list[str], lists: dict[str, DataFrame]) -> DataFrame:
    """(key, detail): a paper's fields and lists (key, item) as one JSON document, lists in order."""
    out = papers.select(key, *fields)
    for name, df in lists.items():
        out = out.join(df.groupBy(key).agg(F.sort_array(F.collect_list("item")).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct(*fields, *[F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n) for n in lists])).alias("detail"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf): an inverted index."""
    return docs.select(key, F.explode(c.words(F.col(text))).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def overwritten(df: DataFrame, name: str) -> DataFrame:
    """df written over a table of the shared folder, read back from it."""
    path = f"{shared_folder(df.sparkSession)}/stemma-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame, name: str) -> DataFrame:
    """The table with no rows, its schema kept."""
    return overwritten(df.limit(0), name)


def report(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(place, line) of a Markdown report: a heading and a bullet for each row (label, value) of small tables, in the order of labels."""
    out = None
    for i, (title, df) in enumerate(sections):
        head = df.sparkSession.range(1).select(F.lit(i).alias("section"), F.lit("").alias("label"), F.lit(f"## {title}").alias("line"))
        rows = df.select(F.lit(i).alias("section"), F.col("label").cast("string").alias("label"), F.concat(F.lit("- "), F.col("label").cast("string"), F.lit(": "), F.col("value").cast("string")).alias("line"))
        part = head.union(rows)
        out = part if out is None else out.union(part)
    return out.select(F.row_number().over(Window.orderBy("section", "label")).alias("place"), "line")  # a report's lines
