"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, mixing, near_dedup, pii, quality, secret_scan, sharding, token_output

#: The layout of the sharding query, and the strings of the formatting query's own conversation.
SHARDS = 24
PROBE = "</s>[INST] ok [/INST]"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.report(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_report(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_report(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], kinds)
    path = tokenizer_file("byte_bpe_50k.json")
    return chat.read_chats(chat.format_chats(rows.union(probe), path), path)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.HashTree.uniform(SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_quality, op4_token_files, op5_mix, op6_licenses, op7_near_dedup, op8_chat, op9_shards, op10_secrets, pipeline)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = rf"""
WITH item AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[q : q + least(13, len(w)) - 1], ' ') AS key FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(q)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS key FROM doc, (SELECT DISTINCT size FROM win) s, unnest(range(1, greatest(len(w) - size + 2, 1))) AS u(p)),
occ AS (SELECT place.doc_id, p, place.size, item_id FROM place JOIN win USING (size, key)),
hit AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM occ, unnest(range(0, size)) AS u(k) GROUP BY ALL),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id),
run AS (SELECT doc_id, item_id, p, p - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY p) AS g, size, d FROM (
  SELECT DISTINCT place.doc_id, a.item_id, p, p - q AS d, place.size FROM place JOIN (SELECT item_id, q, least(13, len(w)) AS size, array_to_string(w[q : q + least(13, len(w)) - 1], ' ') AS key FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(q)) a USING (size, key))),
long AS (SELECT doc_id, max({{'n': n, 'p': -p}}) AS m FROM (SELECT doc_id, min(p) - 1 AS p, max(p) - min(p) + max(size) AS n FROM run GROUP BY doc_id, item_id, d, g) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(m.n, 0)::BIGINT AS longest_match, coalesce(-m.p, -1)::BIGINT AS longest_at
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN long USING (doc_id)
"""

OP7_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(p) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS other FROM two UNION SELECT reach.doc_id, two.b FROM reach JOIN two ON two.a = reach.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, doc_id = coalesce(m, doc_id) AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS o FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
step AS (SELECT 0 AS i, 1.5::DOUBLE * sum(s)::DOUBLE AS room, list({'k': k, 's': s::DOUBLE, 'w': [3, 1, 2][(k - 1) % 3 + 1]::DOUBLE, 'cut': false} ORDER BY k) AS l, false AS last FROM src
  UNION ALL SELECT i + 1, room - coalesce(list_sum(list_transform(list_filter(n, lambda x: x.new), lambda x: 2 * x.s)), 0), list_transform(n, lambda x: {'k': x.k, 's': x.s, 'w': x.w, 'cut': x.cut OR x.new}), len(list_filter(n, lambda x: x.new)) = 0
  FROM (SELECT i, room, list_transform(l, lambda x: {'k': x.k, 's': x.s, 'w': x.w, 'cut': x.cut, 'new': NOT x.cut AND room * x.w / total > 2 * x.s}) AS n
    FROM (SELECT *, list_sum(list_transform(list_filter(l, lambda x: NOT x.cut), lambda x: x.w)) AS total FROM step WHERE NOT last))),
done AS (SELECT room, list_sum(list_transform(list_filter(l, lambda x: NOT x.cut), lambda x: x.w)) AS total, unnest(l) AS x FROM step WHERE last),
goal AS (SELECT source, s, CASE WHEN x.cut THEN 2 * x.s ELSE room * x.w / total END AS target FROM done JOIN src ON src.k = x.k),
plan AS (SELECT source, s, target, CASE WHEN s > 0 THEN least(round_even(target, 0)::BIGINT, 2 * s) // s ELSE 0 END AS whole, CASE WHEN s > 0 THEN least(round_even(target, 0)::BIGINT, 2 * s) % s ELSE 0 END AS rest FROM goal),
c AS (SELECT d.*, s, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY o) AS upto FROM d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source),
g AS (SELECT *, rest - coalesce(max(upto) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM c),
e AS (SELECT *, min({'d': abs(size - gap), 'o': o}) FILTER (upto > rest AND abs(size - gap) < gap) OVER (PARTITION BY source) AS extra FROM g)
SELECT doc_id, size, s AS source_size, target, (size * (whole + CASE WHEN s > 0 AND (upto <= rest OR o = extra.o) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""


def op9_sql() -> str:
    tree = sharding.HashTree.uniform(SHARDS)
    key = "coalesce(doc_id::VARCHAR, 'null')"
    return f"""
WITH t AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS l FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
b AS (SELECT doc_id, len(h) + 8 AS size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(h, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(l[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM d, t),
s AS (SELECT *, {tree.shard_sql(key)} AS shard, {tree.grown().shard_sql(key)} AS grown FROM b)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY md5({key}), doc_id, crc, size) - 1)::BIGINT AS slot, grown AS grown_shard FROM s
"""


def op8_sql() -> str:
    def escaped(c: str) -> str:
        """Code points of a text with its escapes."""
        marks = " + ".join(f"2 * ((length({c}) - length(replace({c}, '{s}', ''))) // {len(s)})" for s in chat.CONTROL)
        return f"(length({c}) + {marks} + length({c}) - length(replace({c}, '{chat.ESCAPE}', '')))"

    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""
WITH c AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {order})) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' {order}), '')) AS loss_sha256,
  sum({escaped("r")} + {escaped("t")} + {marks})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


ORACLE: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op5_mix": OP5_SQL, "op7_near_dedup": OP7_SQL, "op8_chat": op8_sql(), "op9_shards": op9_sql()}
