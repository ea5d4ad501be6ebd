"""Every query with SQL against DuckDB, and the graph and score operators against hand values."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stemma.functions import columns as c
from stemma.operators import directions, graph, relational, resolution, search, stats
from stemma.plans import catalog, evidence, history, products, records, rules, sections, signals  # noqa: F401  (the others add to the registry)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_says_what_its_sql_says(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", ["cocitation", "degree_centrality", "edge_weights", "fused_edges", "modularity"])
def test_groups_of_over_80_items(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT o AS l_orderkey, p AS l_partkey FROM range(1, 3) a(o), range(1, 82 + o * 5) b(p) UNION ALL SELECT 3, p FROM range(1, 5) b(p)")
    con.execute("CREATE TABLE part AS SELECT p AS p_partkey, 'Brand#' || p % 3 AS p_brand FROM range(1, 100) b(p)")
    for t in ("lineitem", "part"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows and plain(df.collect(), df.columns) == plain(rows, names)
    if name == "edge_weights":
        assert dict(zip(names, rows[0]))["most"] == 3


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_path_counts(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert {r.spc for r in graph.path_counts(chain).collect()} == {1.0}
    lattice = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5)], "src long, dst long")
    assert {(r.src, r.dst): r.spc for r in graph.path_counts(lattice).collect()} == {(0, 1): 2, (0, 2): 2, (1, 3): 2, (2, 3): 2, (3, 4): 2, (3, 5): 2}
    assert graph.main_path(chain.limit(0)).count() == 0


def test_path_counts_with_cycles(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    got = {(r.src, r.dst): r.spc for r in graph.path_counts(pairs([(1, 2), (2, 3), (3, 2), (3, 4)])).collect()}
    assert got == {(1, 2): 1.0, (3, 4): 1.0}
    # 2 and 3 are one node, which two edges enter from 1 and one leaves for each of 4 and 5; 5 and 6 are another.
    got = {(r.src, r.dst): r.spc for r in graph.path_counts(pairs([(1, 2), (1, 3), (2, 3), (3, 2), (3, 4), (2, 5), (5, 6), (6, 5), (6, 7), (4, 7), (9, 9)])).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 1.0, (3, 4): 1.0, (2, 5): 1.0, (6, 7): 1.0, (4, 7): 1.0}
    assert graph.path_counts(pairs([(1, 2), (2, 1)])).count() == 0
    years = spark.createDataFrame([(2, 1999), (3, 2001), (5, None)], "node long, year int")
    audit = sorted(tuple(r) for r in graph.cycle_audit(pairs([(1, 2), (2, 3), (3, 2), (3, 5), (5, 6), (6, 5), (6, 7)]), years).collect())
    assert audit == [(2, 2, 1999, 2001, 2), (5, 2, None, None, 2)]


def test_strong_components_against_brute_force(spark):
    import random

    rng = random.Random(2)
    for n in (6, 12):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)}
        reach = {i: {i} for i in range(n)}
        for _ in range(n):
            for u, v in edges:
                reach[u] |= reach[v]
        want = {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n) if any(j != i and j in reach[i] and i in reach[j] for j in range(n))}
        got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
        assert got == want


def test_pairs_in_blocks_and_long_reference_lists(spark, monkeypatch):
    rows = [(g, i) for g in range(3) for i in range(1, 40 - g)] + [(9, 1), (9, 2)]
    df = spark.createDataFrame(rows, "g long, i long")
    whole = sorted(tuple(r) for r in graph.pairs_sharing(df, "i", "g", 1).collect())
    monkeypatch.setattr(graph, "MET", 7)
    assert sorted(tuple(r) for r in graph.pairs_sharing(df, "i", "g", 1).collect()) == whole
    assert sorted(r.i for r in graph.first_items(df, "i", "g", 5).filter("g = 2").collect()) == [1, 2, 3, 4, 5]


def test_statistics_of_large_groups(spark, monkeypatch):
    rows = [(k, float((i * 37) % 101) if k else 5.0) for k in (0, 1, None) for i in range(400)] + [(1, None), (7, 1.0), (7, 3.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    calls = (lambda: stats.truncated_percentile(df, ["k"], "v", 0.95), lambda: stats.nearest_percentile(df, ["k"], "v", 0.5), lambda: stats.trimmed_mean(df, ["k"], "v", 0.1))
    plainly = [sorted((r[0] or -1, round(r[1], 9)) for r in f().collect()) for f in calls]
    monkeypatch.setattr(stats, "GROUP", 50)
    assert [sorted((r[0] or -1, round(r[1], 9)) for r in f().collect()) for f in calls] == plainly


def test_vectors_with_nulls_and_ties(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(12)] + [(50, None, 1), (51, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    got = sorted((r.id, r.rank, r.other) for r in graph.nearest(df, "id", "v", "g", 2, blocks=3).collect() if r.id < 12)
    assert got == [(i, k, [x for x in range(12) if x != i][k - 1]) for i in range(12) for k in (1, 2)]
    assert graph.bridges(df, "id", "v", "g", 0.0).count() == 12


def test_pagerank(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (1, 5)]
    rank = {n: 0.2 for n in range(1, 6)}
    out = {n: [d for s, d in edges if s == n] for n in rank}
    for _ in range(60):
        lost = sum(rank[n] for n in rank if not out[n])
        rank = {n: 0.15 / 5 + 0.85 * (sum(rank[s] / len(out[s]) for s, d in edges if d == n) + lost / 5) for n in rank}
    df = spark.createDataFrame([(s, d, 1.0) for s, d in edges], "src long, dst long, weight double")
    assert {r.node: r.rank for r in graph.pagerank(df, tolerance=1e-9, rounds=60).collect()} == pytest.approx(rank, abs=1e-6)


def test_disruption_hand_case(spark):
    # Citers: one of the work alone, one of it and a reference, one of references alone.
    e = spark.createDataFrame([("F", "R1"), ("F", "R2"), ("C1", "F"), ("C2", "F"), ("C2", "R1"), ("C3", "R1"), ("C3", "R2")], "citing string, cited string")
    assert graph.disruption(e).filter("node = 'F'").first().cd == 0.0


def test_hand_values(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", x) for x in (0.1, 0.8, 0.85, 0.9, 10.0)], "k string, v double")
    assert {r.k: round(r["mean"], 6) for r in stats.trimmed_mean(df, ["k"], "v", 0.2).collect()} == {"a": 3.0, "b": 0.85}
    y = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8)], "y int, p double")
    assert y.agg(stats.brier("y", "p").alias("b")).first().b == pytest.approx(0.02)
    assert [one(spark, c.to_grade(F.lit(x))) for x in (0.0, 0.19, 0.21, 0.5, 1.0)] == [1, 1, 2, 3, 5]
    log = spark.createDataFrame([("p", t, o, r) for t, (o, r) in enumerate(zip((2, 0, 1), (0, 3, 0)))], "k string, t int, o int, r int")
    assert [r.backlog for r in relational.backlog(log, "k", "t", "o", "r").orderBy("t").collect()] == [2, 0, 1]
    ten = spark.createDataFrame([("x", float(v)) for v in range(1, 11)], "k string, v double")
    assert stats.truncated_percentile(ten, ["k"], "v", 0.95).first().p == 9.0
    assert one(spark, c.harmonic_score({"a": F.lit(None).cast("double")}, {"a": 0.5})) == 0.5
    assert one(spark, c.harmonic_score({"a": F.lit(0.6), "b": F.lit(None).cast("double")}, {"a": 0.5, "b": 0.5})) == pytest.approx(0.6)


def test_fused_ranks(spark):
    a, b = (spark.createDataFrame([(x, i + 1) for i, x in enumerate(v)], "id string, rank int") for v in (["a", "b"], ["b", "c"]))
    got = {r.id: r.score for r in search.fuse_ranks([a, b], "id").collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


def test_identifiers(spark):
    raw = ["https://doi.org/10.1234/AbC.", "doi:10.48550/arXiv.2101.00001", "arXiv:2101.00001v2", "https://example.org/W123", "free text", None]
    rows = spark.createDataFrame([(r,) for r in raw], "r string").select(c.external_id(F.col("r")).alias("x")).collect()
    assert [(r.x.provider, r.x.norm) for r in rows] == [("doi", "10.1234/abc"), ("arxiv", "2101.00001"), ("arxiv", "2101.00001"), ("work", "W123"), ("unknown", None), ("unknown", None)]
    assert one(spark, c.arxiv_year(F.lit("9905.00001"))) == 1999 and one(spark, c.arxiv_year(F.lit("2101.00001"))) == 2021


def test_diverse_selection(spark):
    v = [(1, 1.0, [1.0, 0.0]), (2, 0.9, [1.0, 0.01]), (3, 0.5, [0.0, 1.0])]
    got = search.diverse(spark, spark.createDataFrame(v, "id long, s double, v array<float>"), "id", "s", "v", 2, 0.5).collect()
    assert [r.id for r in got] == [1, 3] and math.isfinite(got[0].pick)


def test_bradley_terry(spark):
    games = [("a", "b")] * 3 + [("b", "a")] + [("b", "c")] * 2 + [("a", "c")] + [("c", "c")]
    strength = dict.fromkeys("abc", 1.0)
    for _ in range(8):
        new = {}
        for i in strength:
            mine = [g for g in games if i in g and g[0] != g[1]]
            load = sum(1 / (strength[w] + strength[x]) for w, x in mine)
            new[i] = (sum(w == i for w, _ in mine) + 0.1) / (load + 0.2 / (strength[i] + 1))
        strength = new
    df = spark.createDataFrame(games, "winner string, loser string")
    for small in (200_000, 0):  # on the driver, and in joins
        got = {r["item"]: r.strength for r in stats.bradley_terry(df, rounds=8, small=small).collect()}
        assert got == pytest.approx(strength, rel=1e-3)
    assert stats.bradley_terry(df.limit(0)).count() == 0


def test_order_statistic(spark):
    values = [(i * 37) % 101 / 7 for i in range(1, 90)] + [3.0] * 11
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert stats.order_statistic(df, "x", q) == sorted(values)[int(q * (len(values) - 1))]
    assert stats.order_statistic(df.limit(0), "x", 0.5) is None
    assert stats.order_statistic(df, "x", 0.0, 50.0) == 50.0


def test_local_pagerank_leaves_the_sink_out(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 4, 5.0)], "src long, dst long, weight double")
    got = {r.node: r.rank for r in graph.local_pagerank(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert set(got) == {1, 2} and sum(got.values()) == pytest.approx(1.0)


def test_similar_sets_and_merged_hits(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "b", "a"]), (3, ["a", "b", "c", "d"]), (4, ["x"]), (5, [])], "k long, s array<string>")
    got = resolution.similar_token_sets(df, "k", F.col("s"), 0.75).collect()
    assert [(r.a, r.b, r.similarity) for r in got] == [(1, 3, 0.75)]
    lists = [spark.createDataFrame(rows, "id long, rank int") for rows in ([(1, 1), (2, 2)], [(3, 1), (2, 2)])]
    merged = sorted((r.rank, r.id, r.mode) for r in resolution.merged_hits(*lists, "id", 10).collect())
    assert merged == [(1, 1, "exact"), (2, 2, "exact+fuzzy"), (3, 3, "fuzzy")]


@pytest.mark.parametrize("least, fewest, most, words", [(0.4, 3, 6, 25), (0.4, 1, 6, 12), (0.75, 1, 120, 130), (1 / 3, 1, 4, 9)])
def test_similar_sets_by_brute_force(spark, least, fewest, most, words):
    """Few and many tokens, wide sets, and sets that one common token makes similar."""
    r = random.Random(7)
    rows = [(i, [str(r.randrange(words)) for _ in range(r.randint(0, most))]) for i in range(150)]
    rows += [(1000 + i, [x for x in t if r.random() < 0.9] + ["z"]) for i, t in rows]
    sets = {}
    for i, t in rows:
        if len(set(t)) >= fewest:
            sets[frozenset(t)] = min(i, sets.get(frozenset(t), i))
    want = {(min(x, y), max(x, y), round(len(s & t) / len(s | t), 9)) for (s, x), (t, y) in itertools.combinations(sets.items(), 2) if s & t and len(s & t) / len(s | t) >= least}
    got = [(x.a, x.b, round(x.similarity, 9)) for x in resolution.similar_token_sets(spark.createDataFrame(rows, "k long, t array<string>"), "k", F.col("t"), least, fewest).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_few_dissimilar_sets_meet(spark):
    """Sets of 4 out of 60 tokens, at 0.4: one shared token does not do, so only pairs that share two may meet."""
    r = random.Random(7)
    sets = spark.createDataFrame([(r.sample([str(t) for t in range(60)], 4), i) for i in range(1000)], "s array<string>, id long")
    assert resolution.meetings(sets, 0.4, 3).count() < 25_000  # of 120,000 that share one


@pytest.mark.parametrize("many, wide", [(1 << 18, {3: 16, 2: 32}), (20, {3: 16, 2: 32}), (20, {3: 4, 2: 6}), (1 << 18, {3: 0, 2: 4})])
@pytest.mark.parametrize("least, fewest", [(0.4, 3), (0.25, 1), (0.0, 1)])
def test_similar_sets_by_every_kind_of_key(spark, monkeypatch, least, fewest, many, wide):
    """Tokens dealt out by the second, and sets that meet by fewer tokens than their partners could; as tokens and as numbers."""
    monkeypatch.setattr(resolution, "MANY", many)
    monkeypatch.setattr(resolution, "WIDE", wide)
    r = random.Random(5)
    rows = [(i, [r.choice([r.randrange(14), r.randrange(6), r.randrange(200)]) for _ in range(r.randint(0, 10))]) for i in range(160)]
    sets = {}
    for i, t in rows:
        if len(set(t)) >= fewest:
            sets[frozenset(t)] = min(i, sets.get(frozenset(t), i))
    want = sorted((min(x, y), max(x, y), round(len(s & t) / len(s | t), 9)) for (s, x), (t, y) in itertools.combinations(sets.items(), 2) if s & t and len(s & t) / len(s | t) >= least)
    df = spark.createDataFrame(rows, "k long, t array<int>")
    for got in (resolution.similar_token_sets(df, "k", F.col("t").cast("array<string>"), least, fewest), resolution.similar_number_sets(df, "k", F.col("t"), least, fewest)):
        assert sorted((x.a, x.b, round(x.similarity, 9)) for x in got.collect()) == want


def test_pairs_of_sets_are_not_shuffled(spark, sf):
    """Similar sets are compared where they meet, by three tokens if they must share three; orders and names travel as numbers."""
    r = random.Random(7)
    sets = spark.createDataFrame([(r.sample([str(t) for t in range(60)], 4), i) for i in range(1000)], "s array<string>, id long")
    met = resolution.meetings(sets, 0.4, 3)
    assert met.count() < 2_000  # more than 9,000 share two; three are needed
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    plan = signals.fuzzy_matches(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan and "Join" not in plan


@pytest.mark.parametrize("most_items, words", [(6, 60), (60, 150)])
def test_idf_jaccard_by_brute_force(spark, most_items, words):
    """Short lists, and lists beyond graph.LISTED; pairs with one and with several common items."""
    r = random.Random(7)
    edges = sorted({(d, r.randrange(words)) for d in range(150) for _ in range(r.randint(1, most_items if d % 3 else 5))})
    df = {i: sum(x == i for _, x in edges) for _, i in edges}
    weight = {i: math.log(150 / n) + 1 for i, n in df.items() if n <= 40}
    held = {d: {i for x, i in edges if x == d and i in weight} for d in range(150)}
    want = {}
    for x, y in itertools.combinations(held, 2):
        s = sum(weight[i] for i in held[x] & held[y])
        u = sum(weight[i] for i in held[x]) + sum(weight[i] for i in held[y]) - s
        if s and s / u >= 0.1:
            want[x, y] = round(s / u, 7)
    df = graph.idf_jaccard(spark.createDataFrame(edges, "d long, i long"), "d", "i", 40, 0.1)
    got = {(x.a, x.b): round(x.similarity, 7) for x in df.collect()}
    assert got == want
    if most_items == 6:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [a") == 0  # pairs are not shuffled to be summed


@pytest.mark.parametrize("rule", [True, False])
@pytest.mark.parametrize("size, most", [(40, 7), (300, 50)])
def test_predicted_links_by_brute_force(spark, monkeypatch, size, most, rule):
    """Several blocks, ties, a vector without a year, links as rows and as a rule."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    r = random.Random(7)
    vectors = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], i % 4 if i % 11 else None) for i in range(size)]
    rows = [(x[0], y[0]) for x in vectors for y in vectors if (x[0] + y[0]) % 7 == 0]
    logistic = lambda x, y: 1 / (1 + math.exp(-sum(p * q for p, q in zip(x, y))))
    want = [(-round(logistic(x, y), 9), i, j) for i, x, g in vectors for j, y, h in vectors if g is not None and h is not None and g < h and (i + j) % 7 and logistic(x, y) >= 0.55]
    known = None if rule else spark.createDataFrame(rows, "src long, dst long")
    got = directions.predicted_links(spark.createDataFrame(vectors, "k long, v array<double>, y int"), known, "k", "v", "y", 0.55, most, (lambda x, y: (x + y) % 7 == 0) if rule else None)
    assert [(-round(x.score, 9), x.src, x.dst) for x in got.collect()] == sorted(want)[:most]
