"""Operators over products, logs and records that SQL does not check, against hand cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from stemma.functions import rules
from stemma.operators import history, products, records


def test_betweenness_against_brute_force(spark):
    rng = random.Random(3)
    edges = {tuple(sorted((rng.randrange(12), rng.randrange(12)))) for _ in range(20)}
    edges = sorted((a, b) for a, b in edges if a != b)
    nodes = sorted({x for e in edges for x in e})
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:  # one source at a time, paths counted backwards
        dist, paths, order, queue = {s: 0}, dict.fromkeys(nodes, 0.0), [], [s]
        paths[s] = 1.0
        while queue:
            u = queue.pop(0)
            order.append(u)
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        dep = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    n = len(nodes)
    want = {k: v / ((n - 1) * (n - 2)) for k, v in score.items() if v > 1e-12}
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.score for r in products.betweenness(df, spark.createDataFrame([(x,) for x in nodes], "node long")).collect()}
    assert got == pytest.approx(want)


def test_communities_of_cliques(spark):
    edges = [(a, b, 1.0) for base, k in ((0, 6), (100, 5), (200, 4)) for a in range(base, base + k) for b in range(a + 1, base + k)] + [(0, 100, 0.1), (101, 200, 0.1)]
    got = {r.node: (r.cluster, r["size"]) for r in products.communities(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert {got[x] for x in range(6)} == {(0, 6)} and {got[x] for x in range(100, 105)} == {(1, 5)} and {got[x] for x in range(200, 204)} == {(2, 4)}


def test_spread_selection_keeps_its_floor(spark):
    v = [(1, 1.0, [1.0, 0.0]), (2, 0.9, [1.0, 0.01]), (3, 0.5, [0.0, 1.0]), (4, 0.4, None), (5, 0.1, [-1.0, 0.0])]
    df = spark.createDataFrame(v, "id long, s double, v array<double>")
    assert [r.id for r in products.spread_selection(df, "id", "s", "v", 3, 0.3).collect()] == [1, 3, 5]
    assert [r.id for r in products.spread_selection(df, "id", "s", "v", 9, 0.3).collect()] == [1, 3, 5, 2]  # none is left apart from the picks
    assert products.spread_selection(df.limit(0), "id", "s", "v", 3, 0.3).count() == 0


def test_templates_are_listed(spark):
    e = spark.createDataFrame([(1, 2), (3, 1)], "src long, dst long")
    assert sorted(r.node for r in products.run_template(e, "neighbours", node=1).collect()) == [2, 3]
    assert products.run_template(e, "degree", node=1).first().n == 2
    with pytest.raises(ValueError):
        products.run_template(e, "drop", node=1)


def test_scope_labels():
    assert products.scope_of(1000, 10, 990, 5, 5000)["adequacy_label"] == "complete"
    assert products.scope_of(100_000, 10, 5000, 40_000, 5000)["adequacy_label"] == "bounded_evidence_subgraph_below_recommended_cap"
    assert products.scope_of(60_000, 10, 5000, 40_000, 5000)["adequacy_label"] == "bounded_evidence_subgraph_adequate_for_extraction"
    assert products.scope_of(60_000, 10, 2000, 40_000, 5000)["recommended_max_size"] == 8000


def test_records_with_gaps(spark):
    raw = spark.createDataFrame([("{}",), ("not json",), ('{"title": "T", "id": null}',), (None,)], "json string")
    got = records.works(raw, "json").collect()
    assert [(r.title, r.openalex_id, r.n_authors, r.references_external, str(r.publication_date)) for r in got] == [("T", None, 0, [], "1900-01-01")]
    assert records.preprints(raw, "json").count() == 1 and records.items(raw, "json").count() == 0
    assert records.works_filter("T1", "2020-01-01", "2020-02-01") == "primary_topic.id:T1,from_publication_date:2020-01-01,to_publication_date:2020-02-01,language:en,is_retracted:false,has_abstract:true"


def test_overrides_and_reports(spark):
    edges = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    log = spark.createDataFrame([("a", 1, "update", 5.0), ("b", 1, "update", 7.0), ("b", 2, "delete", None), ("c", 1, "add", 9.0)], "k string, t int, action string, v double")
    assert sorted(tuple(r) for r in history.overridden(edges, log, "k", ["t"], "action", "v").collect()) == [("a", 5.0), ("c", 9.0)]
    small = spark.createDataFrame([("x", 2), ("w", 1)], "label string, value int")
    assert [r.line for r in history.report([("Title", small)]).orderBy("place").collect()] == ["## Title", "- w: 1", "- x: 2"]


def test_rules_on_nulls(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("x"))
    got = row.select(
        rules.heading_section(F.col("s")).alias("a"), rules.abstract_of(F.col("s")).alias("b"), rules.converted(F.col("x"), F.col("s"), F.col("s")).alias("c"), F.size(rules.depth_paths(F.col("s"))).alias("d"),
        rules.citation_function(F.col("s"), F.col("s"), F.col("s"), F.col("s"))["label"].alias("e"), rules.response_score(F.col("s")).alias("f"),
    ).first()
    assert tuple(got) == (None, None, None, 0, "background", 1)


def folded(text, least=80, most=700):
    """Chunks of a text, read sentence by sentence."""
    import re

    from stemma.operators import atoms

    clean = " ".join(text.split())
    told = lambda s: len(s) >= 35 and any(re.search(atoms.STAGE_PATTERNS[k], s) for k in atoms.CHAIN)
    done, held = [], ""
    for p in [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", clean) if x.strip()]:
        if len(p) > most:
            done += ([held] if held else []) + [x for i in range(0, len(p), most) if len(x := p[i : i + most].strip()) >= least]
            held = ""
        elif told(p):
            if held and not (len(held) >= least or told(held)):
                p, held = f"{held} {p}", ""
            done += ([held] if held else []) + [p]
            held = ""
        else:
            both = f"{held} {p}" if held else p
            if held and len(both) > most:
                done += [held] if len(held) >= least else []
                both = p
            held = both
            if len(held) >= least and (held[-1] in ".!?" or len(held) >= most * 0.75):
                done, held = [*done, held], ""
    if held and done and len(held) < least:
        done[-1] = f"{done[-1]} {held}"[:most]
    elif len(held) >= least:
        done.append(held)
    return done


def test_chunks_against_brute_force(spark):
    from stemma.operators import sections

    rng = random.Random(4)
    words = ["However", "noise", "we propose", "the loss", "fine", "a", "design", "1", "shown", "limits", "Thermal", "x" * 60]
    rows = [(i, " ".join(rng.choice(words).capitalize() if rng.random() < 0.2 else rng.choice(words) + rng.choice(["", "", ".", "!", ". "]) for _ in range(rng.randint(0, 160)))) for i in range(120)] + [(900, "word " * 400), (901, ""), (902, None), (903, "Short one.")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: r.s for r in df.select("k", sections.chunks(F.col("t")).alias("s")).collect()}
    for k, t in rows:
        assert [s.chunk for s in got[k]] == folded(t or ""), (k, t)
        clean = " ".join((t or "").split())
        assert all(clean[s.start : s.end] == s.chunk for s in got[k] if s.start is not None)
    named = df.withColumn("name", F.lit("Future Work"))
    atoms = sections.section_atoms(named, "k", "name", "t").collect()
    assert len({a.atom_id for a in atoms}) == len(atoms) and all(a.section_key == "future_work" and a.atom_index < 12 and a.evidence_grade == "section_atom_weak" for a in atoms)


def test_search_refuses_what_it_does_not_know(spark):
    from stemma.operators import sections

    with pytest.raises(ValueError):
        sections.dispatch("guess")
    assert sections.identifier_filter("free text") == {} and sections.identifier_filter("arXiv:2101.00001v2") and sections.identifier_filter("doi:10.1234/x")
    df = spark.createDataFrame([(1, "a b", "2101.00001"), (2, "b c", "2101.00002")], "k long, t string, arxiv_id string")
    assert [r.k for r in sections.exact_search(df, "k", "t", "arXiv:2101.00002v3").collect()] == [2]
    assert [r.k for r in sections.exact_search(df, "k", "t", "b c", phrase=True).collect()] == [2]
