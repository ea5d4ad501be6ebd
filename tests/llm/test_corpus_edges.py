"""Cases that earlier versions lost or got wrong, the queries against their SQL, and the pipeline as a whole."""

import json
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import chat, common, decontaminate, mixing, near_dedup, pii, quality, queries, secret_scan, sharding, token_output
from stemma.operators import relational

TABLES = "documents benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in (r[i] for i in order)) for r in rows)


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')" if os.path.isdir(f"{folder}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = df.collect()
    assert plain(got, df.columns) == plain(want.fetchall(), names)
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_says_what_its_sql_says(spark, sf, name):
    against_sql(spark, sf, name)


@pytest.mark.parametrize("name", ["op5_mix", "op9_shards", "op7_near_dedup"])
def test_query_says_what_its_sql_says_on_odd_rows(spark, tmp_path, name):
    rng = random.Random(3)
    sources = ['a"b', "tab\there", "line\nend", "\x1f\x01", "é漢", "\\", None, "", "big"]
    rows = [(i, "w " * rng.randint(0, 30) if i % 11 else None, rng.choice(sources)) for i in range(400)] + [(900 + i, f"x{i} " * 20, "big") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(against_sql(spark, str(tmp_path), name)) == len(rows)


def test_mix_of_one_empty_source_and_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x y", None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(against_sql(spark, str(tmp_path), "op5_mix")) == 3


def test_mix_keeps_columns_of_any_name(spark):
    names = ["_cut", "_whole", "_extra", "_plan", "_pattern", "a.b", "_order"]
    df = spark.createDataFrame([(i, "w " * 5, "s", *range(len(names))) for i in range(20)], ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` long" for n in names)]))
    out = mixing.apply_mix(df, F.array("source"))
    assert out.columns == df.columns and out.count() == 30 and out.filter("_cut <> 0").count() == 0


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, [["a"], ["a", "b"], ["b"]][i % 3]) for i in range(300)], "doc_id long, text string, held array<string>")
    rows, plan, info = mixing.mix(df, F.col("held"), weights={"a": 1, "b": 3}, share=0.5)
    got = rows.join(plan, "_pattern").select(mixing.copies(F.col("_order")).alias("n"), "_size").collect()
    assert {s: v["size"] for s, v in info.items()} == {"a": 2000, "b": 2000}
    assert sum(r.n * r._size for r in got) == pytest.approx(sum(v["target"] for v in info.values()), abs=10) and max(r.n for r in got) == 1


def test_encoder_on_composed_and_decomposed_letters():
    enc = token_output.encoder(queries.tokenizer_file("word_bpe_49k.json"))
    assert enc.chunked
    rng = random.Random(4)
    letters = ["T", "t", "a", "E", "é", "̈", "́", "̧", "İ", "ı", "ß", "ﬁ", "K", "Å", " ", " ", "　", "\t", "\x1c", "\x85", "'", "S", "1", "½", "漢", "가", "ᄀ", "ᅡ", "<|endoftext|>", "ǅ", "Σ", "ς", ".", "_", "‍", "🙂"]
    texts = ["T̈", "ẗ T̈"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    flat, n = enc.encode_column(pa.array(texts))
    want = [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_a_tokenizer_with_other_rules_is_used_whole(tmp_path):
    file = json.load(open(queries.tokenizer_file("word_bpe_49k.json")))
    file["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(file))
    enc = token_output.WordEncoder(str(tmp_path / "other.json"))
    flat, n = enc.encode_column(pa.array(["Some Words", None, "more"]))
    assert not enc.chunked and n[1] == 0 and flat.tolist() == [i for t in ("Some Words", "", "more") for i in enc.whole.encode(t, add_special_tokens=False).ids]


def test_token_files_with_ids_that_are_strings(spark):
    df = spark.createDataFrame([("b", "two words", 1), ("a", "one", 1), (None, None, 1), ("a", "one", 1)], "name string, body string, keys int")
    path = queries.tokenizer_file("word_bpe_49k.json")
    got = sorted(token_output.token_report(df, path, key="name", text="body").collect(), key=lambda r: r.start)
    assert [(r.name, r.start, r.n_tokens) for r in got] == [(None, 0, 1), ("a", 1, 2), ("a", 3, 2), ("b", 5, 3)]
    assert got[0].ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())


def test_chat_words_are_those_of_the_tokenizer():
    a = chat.assembler(queries.tokenizer_file("byte_bpe_50k.json"))
    assert a.by_word
    rng = random.Random(5)
    letters = ["a", "B", "1", "²", " ", "  ", "\n", "\t", "'s", "'S", "é", "é", "漢", "!", "…", "\xa0", " ", "​", "🙂", "<|endoftext|>", "\x1c", "\x85", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["x" * 70_000 + " y", " " * 70_000 + "z"]
    assert [a.ids(t) for t in texts] == [e.ids for e in a.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_decontamination_in_several_blocks(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(n))
    items = [(f"i{k}", say(rng.randint(3, 40))) for k in range(12)]
    rows = [(k, say(20) + " " + rng.choice(items)[1] + " " + say(rng.randint(0, 20))) for k in range(30)] + [(99, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(decontaminate.report(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(decontaminate.report(df, bench).collect()) == whole


def test_suffix_arrays_and_longest_matches():
    rng = random.Random(7)
    for _ in range(20):
        flat = np.array([rng.randint(0, 3) for _ in range(200)] + [0], np.int64)
        order = decontaminate.suffix_array(flat, 16)
        key = [tuple(flat[p : p + 16].tolist()) for p in order]
        cut = [k[: k.index(0)] if 0 in k else k for k in key]
        assert cut == sorted(cut)
    items = [("a", b"p q r s t u v w x y z a1 b1 c1 d1 e1 f1"), ("b", b"short item")]
    test = decontaminate.Suffixes(items)
    n, spans, found, matches = decontaminate.search([b"zz p q r s t u v w x y z a1 b1 c1 d1 no short item end"], test)[0]
    assert (n, spans, found, matches) == (20, [(1, 16), (17, 19)], {0, 1}, [(0, 0, 1, 15), (1, 0, 17, 2)])


def test_many_items_with_one_passage_take_no_pairs():
    passage = " ".join(f"w{i}" for i in range(60))
    test = decontaminate.Suffixes([(str(i), f"{passage} tail{i}".encode()) for i in range(2000)])
    began = time.time()
    got = decontaminate.search([f"x {passage} z".encode()] * 2000, test)
    assert all(len(g[2]) == 2000 and len(g[3]) == 1 for g in got) and time.time() - began < 20


def test_bands_and_sketches_miss_few_pairs_near_the_threshold():
    rng = np.random.default_rng(8)
    pairs, lost = 3000, 0
    for _ in range(pairs):
        common, alone = rng.integers(0, 1 << 63, 300, np.uint64), rng.integers(0, 1 << 63, (2, 50), np.uint64)  # similarity 0.75
        m = np.array([near_dedup.samples(np.concatenate([common, x])) for x in alone])
        bands, bits = near_dedup.band_keys(m), near_dedup.sketches(m)
        lost += not (bands[0] == bands[1]).any() or np.bitwise_count(bits[0] ^ bits[1]).sum() > near_dedup.odd_bits(0.75 - near_dedup.SLACK)
    assert lost <= 3  # expected: 3000 * 1e-4


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    rng = random.Random(12)
    rows, n = [], 0
    for family in range(3):
        words = [f"w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(120):
            rows.append((n, " ".join(rng.choice("qwertyuiop") * 3 if rng.random() < rng.choice([0.01, 0.03, 0.05]) else w for w in words)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(near_dedup.near_duplicates(df).collect())
    for name, value in (("BLOCK", 6), ("SECOND_BLOCK", 3), ("BLOCK_SHINGLES", 400)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(relational, "HOT", 8)  # many keys count as hot
    monkeypatch.setattr(relational, "MANY", 4)
    assert sorted(near_dedup.near_duplicates(df).collect()) == want


def test_one_row_of_a_group_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, a), (1, a.upper()), (1, a + " more"), (2, a), (3, b), (3, b), (None, b), (4, None), (4, None), (5, "")]
    kept = near_dedup.keep_one(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, _again int")).collect()
    assert sorted((r.doc_id, len(r.text or "")) for r in kept if r.text) == sorted([(1, max(len(r.text or "") for r in kept if r.doc_id == 1)), (3, len(b))])
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 4, 5]


def test_training_sample_is_bounded_and_repeatable(spark):
    rng = random.Random(9)
    docs = [(i, "Some good words stand here.\n" * 3 if i % 2 else "### | !!!\n" * 5) for i in range(60)] + [(1, "another text\nof this id"), (61, "\n" * 500), (None, "x")]
    labels = [(i, i % 2) for i in range(62)] + [(3, None), (None, 1)]
    rng.shuffle(docs)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    one, two = quality.fit(d, lab), quality.fit(d.orderBy(F.rand()), lab.orderBy(F.rand()))
    assert (one.weights == two.weights).all() and (one.bias, one.change) == (two.bias, two.change)
    few = quality.fit(d, lab, sample=10)
    assert (few.weights != one.weights).any()
    assert quality.fit(d.limit(0), lab) is quality.DEFAULT and quality.fit(d, lab.limit(0)) is quality.DEFAULT


def test_secrets_in_time_that_grows_with_the_text():
    began = time.time()
    for text in ("eyJ" * 400_000, "eyJ." * 300_000, "/MIIEvQIBADANBg" * 80_000, "b3BlbnNzaC1rZXktdjEA/" * 57_000, "\nb3BlbnNzaC1rZXktdjEA" * 5_000):
        secret_scan.scan(text)
    assert time.time() - began < 20


def test_contexts_discover_planted_identifiers(spark):
    """Precision and recall of what contexts find, where contexts are told and others are not."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    before = ["please write to", "contact me at", "his address is", "reach her under"]
    rows, planted, decoys = [], 0, 0
    for i in range(900):
        noise = " ".join(word() for _ in range(30))
        if i % 3 == 0:
            rows.append((i, f"{noise} {rng.choice(before)} {word()}{i}@mail.example.org for more {noise}"))
        elif i % 3 == 1:  # no base pattern finds these
            rows.append((i, f"{noise} {rng.choice(before)} {word()}{i}@intranet for more {noise}"))
            planted += 1
        else:
            rows.append((i, f"{noise} part number {word()}{i}x7 was {noise}"))
            decoys += 1
    got = {r.doc_id: r.n_contextual for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right, wrong = sum(got[i] for i in got if i % 3 == 1), sum(got[i] for i in got if i % 3 != 1)
    assert right >= 0.95 * planted and wrong <= 0.05 * right


def test_sharding_without_broadcast(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id % 1500 AS doc_id", "'x' AS text", "id AS slot")
    tree = sharding.HashTree.uniform(24)
    few = sorted(sharding.assign_shards(df, tree).collect())
    assert sorted(sharding.assign_shards(df, tree, cell=1).collect()) == few


def pipeline_tables(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    words = [f"bench{i}" for i in range(40)]
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return " ".join(words)


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    say = lambda: ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(12)) for _ in range(4)).capitalize() + "."
    schema = "doc_id long, text string, lang string, source string, n_chars long, _cut int, verdict string, shard int"
    clean = [(i, say(), "en", f"s{i % 3}") for i in range(60)]
    hit = " ".join(f"bench{i}" for i in range(40))
    odd = [(0, clean[0][1], "en", "s0"), (70, clean[1][1] + " More.", "en", "s1"), (None, say(), None, None), (None, None, None, None), (71, "", "en", "s0"), (72, "too few", "en", "s0"), (73, hit + " and. " + say(), "en", "s1"), (5, say(), "en", 's"2\x1f')]
    pipeline_tables(spark, tmp_path, [(*r, 1, 2, "mine", 3) for r in clean + odd], schema)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id for r in out.collect()}
    assert got <= {r[0] for r in clean} | {None, 5} and not got & {70, 71, 72, 73}
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = common.stage(step(spark, docs, str(tmp_path)), name)
        assert after.columns == docs.columns
        kept.append({(r.doc_id, r.text) for r in after.collect()})
        docs = after
    texts = [{t for _, t in k} for k in kept]
    assert texts[0] == {r[1] for r in clean + odd if r[1] not in (None, "", "too few")}
    assert texts[1] == texts[0] - {clean[1][1] + " More."} and texts[2] == {t for t in texts[1] if not t.startswith("bench0")} and texts[3] <= texts[2]
    assert out.count() == docs.count()


def test_pipeline_on_nothing(spark, tmp_path):
    pipeline_tables(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_chat_workers_hold_one_vocabulary_and_few_words(spark):
    a = chat.assembler(queries.tokenizer_file("byte_bpe_50k.json"))
    words = [f"{a}{b}{c}{d}{e}" for a in "bcdfghjklmnpqrs" for b in "aeiou" for c in "bcdfgklmnp" for d in "aeiouyäöüé" for e in "abcdefghijklmnopqrst"]
    for at in range(0, len(words), 5000):
        part = " ".join(words[at : at + 5000])
        assert a.ids(part) == a.tokenizer.encode(part, add_special_tokens=False).ids
    assert 0 < len(a.known) <= chat.REMEMBERED + 5000 < len(words)
    assert all(isinstance(v, bytes) for v in a.known.values())  # a list of numbers takes several times as much
    rows = spark.createDataFrame([(i, 0, "assistant", "a b c d e f g h i j " * 60) for i in range(4000)], "conv_id long, turn int, role string, text string")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    made = chat.format_chats(rows, queries.tokenizer_file("byte_bpe_50k.json"))
    assert max(r.n for r in made.coalesce(1).select("conv_id", "ids", "mask").mapInArrow(sizes, "n long").collect()) < 6 << 20  # of 12 MB


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1, 400)]
    star = [(5000, 4000 + i) for i in range(300)] + [(4000 + i, 6000 - i) for i in range(300)]
    links = [(b - 3000, a - 3000) if rng.random() < 0.5 else (a - 3000, b - 3000) for a, b in chain + star + star[:9] + [(7000 + rng.randint(0, 500), 7000 + rng.randint(0, 500)) for _ in range(300)]]
    links = [(a, b) for a, b in links if a != b]
    rng.shuffle(links)
    lead = {n: n for link in links for n in link}
    while any(lead[a] != lead[b] for a, b in links):
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
    df = common.stage(spark.createDataFrame(links, "a long, b long"), "links")
    spark.sparkContext.setJobGroup("few", "")
    assert {(r.node, r.root) for r in near_dedup.components(df).collect()} == set(lead.items())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs <= 5  # rounds over all partitions take several jobs each
    assert near_dedup.components(df.limit(0)).count() == 0
    monkeypatch.setattr(near_dedup, "AT_ONCE", 10)
    assert {(r.node, r.root) for r in near_dedup.components(df).collect()} == set(lead.items())


def test_pipeline_workers_get_small_batches_and_remember_little(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" word" * 1200)).alias("text")).coalesce(1)
    quality.keep_good(docs, quality.DEFAULT)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    assert 0 < max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 6 << 20  # of 18 MB
    for i in range(60):
        near_dedup.shingles(" ".join(f"{i}-{k}" for k in range(2000)).encode())
    assert len(near_dedup._known) <= near_dedup.KNOWN + 2000
