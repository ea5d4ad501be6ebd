"""Queries over the row rules. Each applies a rule to cases that the parts take in turn; its SQL states what the rules say of each case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import table
from .catalog import ORACLE, QUERIES, query


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def cases(name: str, given: str, outs: str, apply: Callable[[], dict[str, Column]], rows: list[tuple[tuple, tuple]]) -> None:
    """Registers a query: part number k has the inputs of case k % n; rows: (inputs, outputs); outs names the outputs."""

    def run(spark, d):
        inputs = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(rows)], f"_k int, {given}")  # the cases
        parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).cast("int").alias("_k"))
        return parts.join(F.broadcast(inputs), "_k").select("p_partkey", *[c.alias(k) for k, c in apply().items()])

    run.__name__ = name
    run.__doc__ = f"{name} of {len(rows)} cases."
    QUERIES[name] = run
    columns = outs.split()
    values = ", ".join(f"({i}, {', '.join(map(literal, out))})" for i, (_, out) in enumerate(rows))
    ORACLE[name] = f"SELECT p_partkey, {', '.join(columns)} FROM part JOIN (VALUES {values}) t(k, {', '.join(columns)}) ON k = p_partkey % {len(rows)}"


def c(name: str) -> Column:
    return F.col(name)


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x + 1e-12, digits)


cases(
    "physical_depth", "t string", "paths n", lambda: {"paths": F.array_join(rules.depth_paths(c("t")), ","), "n": F.size(rules.depth_paths(c("t")))},
    [
        (("A 1550 nm laser of 10 mW at 300 K",), ("path_1", 1)), (("Reaches 95.3% on ImageNet",), ("path_2a", 1)), (("95.3% " + "x" * 60 + " imagenet",), ("", 0)), (("An ablation study",), ("path_2b", 1)), (("ablation ablating",), ("", 0)),
        (("O(n) time complexity and a convergence rate",), ("path_2c", 1)), (("Trained on 3 million images",), ("path_2d", 1)), (("Compared with 2 and 3",), ("path_3", 1)), (("We prove a lemma",), ("path_4", 1)), ((None,), ("", 0)), (("",), ("", 0)),
    ],
)
cases(
    "depth_counts", "t string", "path_1 path_2a path_2b path_2c path_2d path_3 path_4", lambda: rules.depth_counts(c("t")),
    [
        (("1 nm, 2 um and 3 fs",), (3, 0, 0, 0, 0, 0, 0)), (("88.1 BLEU on WMT, 3.5 F1 on GLUE, 1.1 AUC here",), (0, 3, 0, 0, 0, 0, 0)), (("ablation table, ablation results",), (0, 0, 6, 0, 0, 0, 0)),
        (("polynomial time, 5 GFLOPs",), (0, 0, 0, 2, 0, 0, 0)), (("1.5 billion tokens and 3M parameters",), (0, 0, 0, 0, 2, 0, 0)), (("gain versus 7",), (0, 0, 0, 0, 0, 3, 0)), (("theorem, proof, proved",), (0, 0, 0, 0, 0, 0, 2)),
    ],
)
cases(
    "cross_domain_gate", "age double, z double, topics array<string>", "passes", lambda: {"passes": rules.cross_domain(c("age"), c("z"), c("topics"))},
    [((12.0, 0.0, []), (True,)), ((12.0, -0.1, ["a", "b", "c"]), (False,)), ((3.0, -1.0, ["a", "b", "c"]), (True,)), ((3.0, 5.0, ["a", "a", "b"]), (False,)), ((3.0, 5.0, None), (False,)), ((6.0, 1.0, None), (True,))],
)
cases(
    "readiness_level", "e boolean, k boolean, x boolean, n int, g boolean, m boolean, s boolean, f boolean, v double", "level", lambda: {"level": rules.readiness(*[c(n) for n in "ekxngmsfv"])},
    [
        ((False, True, True, 3, True, True, True, True, 1.0), (0,)), ((True, None, True, 3, False, True, True, True, 1.0), (1,)), ((True, None, False, 0, True, True, False, False, 0.0), (2,)), ((True, True, False, 0, True, True, True, False, 0.9), (3,)),
        ((True, None, True, 2, True, True, True, True, 0.6), (4,)), ((True, None, True, 2, True, True, False, True, 0.5), (2,)), ((True, True, True, 5, True, True, True, True, 0.9), (4,)),
    ],
)
cases("simulation_gate", "tool string, dim string", "allowed dimension", lambda: {"allowed": rules.simulation_gate(c("tool"), c("dim"))["allowed"], "dimension": rules.simulation_gate(c("tool"), c("dim"))["dimension"]},
      [(("SPINS-B", "2D"), (True, "2D")), (("SPINS-B", "3D"), (True, "2D")), (("Meep", "3D"), (True, "3D")), (("FDTD-3D", "2D"), (False, "2D")), (("anything", "3D"), (True, "3D")), (("Meep", "1D"), (False, "1D"))])


def _falsifiable():
    got = rules.falsifiability(c("kind"), c("claim"), {"alpha": c("a"), "statistical_power": c("p"), "sample_size": c("n"), "convergence_criterion": c("v"), "validity_domain": c("d")})
    return {"as_kind": got["kind"], "score": rounded(got["score"]), "missing": F.array_join(got["missing"], ",")}


cases(
    "falsifiability", "kind string, claim string, a double, p double, n int, v string, d string", "as_kind score missing", _falsifiable,
    [
        (("experiment", "", 0.05, 0.8, 30, None, None), ("experiment", 1.0, "")), (("experiment", "", 0.05, None, None, None, None), ("experiment", 0.333333, "statistical_power,sample_size")), (("simulation", "", None, None, None, "-60dB", None), ("simulation", 1.0, "")),
        (("Simulation", "", None, None, None, None, None), ("simulation", 0.5, "convergence_criterion")), (("theory", "", None, None, None, None, None), ("theory", 0.4, "validity_domain")), ((None, "We ran FDTD with Meep", None, None, None, "x", None), ("simulation", 1.0, "")),
        ((None, "an analytical derivation", None, None, None, None, "x"), ("theory", 1.0, "")), (("other", "nothing", 1.0, 1.0, 1, None, None), ("experiment", 1.0, "")), ((None, None, None, None, None, None, None), ("experiment", 0.0, "alpha,statistical_power,sample_size")),
    ],
)
cases("refractive_indices", "m string, nm double", "n inside", lambda: {"n": rules.refractive_index(c("m")), "inside": F.round(rules.wavelength_in(c("m"), c("nm")), 6)},
      [(("Si", 1550.0), (3.476, 445.914845)), (("Silicon Nitride", 1000.0), (2.0, 500.0)), (("LiNbO3", 2.21), (2.21, 1.0)), (("fused-silica", 1444.0), (1.444, 1000.0)), (("unheard of", 7.0), (1.0, 7.0)), (("air", -1.0), (1.0003, None))])
cases("research_works", "t string", "research", lambda: {"research": rules.is_research(c("t"))}, [(("article",), (True,)), (("editorial",), (False,)), (("letter",), (False,)), ((None,), (True,)), (("comment",), (False,)), (("Letter",), (True,))])
cases("date_ranges", "d date, a date, b date", "within", lambda: {"within": rules.within_dates(c("d"), c("a"), c("b"))},
      [((__import__("datetime").date(*x), *[y and __import__("datetime").date(*y) for y in (a, b)]), (ok,)) for x, a, b, ok in (((2020, 1, 1), (2020, 1, 1), (2020, 1, 1), True), ((2020, 1, 2), None, (2020, 1, 1), False), ((2020, 1, 2), (2020, 1, 1), None, True), ((2019, 1, 2), (2020, 1, 1), None, False))])
cases("quality_grades", "s int, w int, m int, n int", "grade", lambda: {"grade": rules.grade_of(*[c(x) for x in "swmn"])},
      [((0, 0, 0, 0), ("insufficient",)), ((3, 1, 0, 4), ("strong_section",)), ((3, 3, 0, 6), ("moderate_section",)), ((1, 3, 0, 4), ("metadata_only",)), ((0, 1, 5, 6), ("weak_abstract",)), ((0, 0, 2, 3), ("model_only",)), ((0, 0, 0, 3), ("metadata_only",))])
cases("coverage_grades", "l double, s double, o double", "grade", lambda: {"grade": rules.coverage_grade(c("l"), c("s"), c("o"))},
      [((0.30, 0.12, 0.70), ("usable_evidence_bone",)), ((0.30, 0.12, 0.69), ("thin_evidence_bone",)), ((0.15, 0.03, 0.0), ("thin_evidence_bone",)), ((0.14, 0.5, 1.0), ("very_thin_evidence_bone",))])
cases("scope_policies", "g string, k boolean, b boolean, l double", "scope", lambda: {"scope": rules.scope_policy(c("g"), c("k"), c("b"), c("l"))},
      [(("strong_section", True, True, 0.3), ("validated_candidate",)), (("strong_section", True, False, 0.3), ("exploratory_with_claim_card",)), (("moderate_section", True, True, 0.9), ("exploratory_with_claim_card",)), (("weak_abstract", True, True, 0.9), ("candidate_pool_only",)), (("strong_section", False, True, 0.9), ("insufficient_evidence",))])
cases("provenance_strengths", "s array<string>, g string", "strength", lambda: {"strength": rules.provenance_strength(c("s"), c("g"))},
      [((["inline_heading", "explicit_heading"], ""), ("strong",)), ((["inline_heading"], ""), ("moderate",)), ((["parser_hint"], "section_explicit_heading"), ("weak",)), (([""], "section_embedded_heading"), ("strong",)), (([], "section_inline_heading"), ("moderate",)), (([], "x"), ("weak",))])
cases("higher_tiers", "a string, b string", "tier", lambda: {"tier": rules.higher_tier(c("a"), c("b"))},
      [(("exploratory", "triangulated_limited"), ("triangulated_limited",)), (("exploratory_weak_limitation", "exploratory_uncalibrated_candidate"), ("exploratory_weak_limitation",)), (("none such", "insufficient"), ("none such",)), (("triangulated_strong", "exploratory"), ("triangulated_strong",))])
cases("limitation_weights", "g string, k boolean, cg string, ch string", "weight", lambda: {"weight": rules.atom_weight(c("g"), c("k"), c("cg"), c("ch"))},
      [(("section_atom_decision_grade", True, "", ""), (0.9,)), (("section_atom_decision_grade", False, "typed_section_lineage", ""), (0.6,)), (("section_atom_weak", False, "", ""), (0.52,)), (("section_atom_traced", True, "typed_section_lineage", ""), (0.94,)), (("section_atom_weak", True, "partial_typed_section_lineage", "local_fix_partial"), (0.82,)), (("x", True, "partial_typed_section_lineage", "y"), (0.52,))])
cases("chain_weights", "g string, k boolean, ch string", "weight", lambda: {"weight": rules.chain_weight(c("g"), c("k"), c("ch"))},
      [(("typed_section_lineage", True, ""), (0.92,)), (("typed_section_lineage_traced", False, ""), (0.85,)), (("x", True, ""), (0.70,)), (("partial_typed_section_lineage", False, "attempted_path_partial"), (0.68,)), (("partial_typed_section_lineage", False, "q"), (0.50,)), (("x", False, ""), (0.45,))])
_D, _T, _W = "section_atom_decision_grade", "section_atom_traced", "section_atom_weak"
cases("chain_grades", "g array<string>, k boolean, o boolean", "grade", lambda: {"grade": rules.chain_grade(c("g"), c("k"), c("o"))},
      [(([_D, _D], True, True), ("typed_section_lineage",)), (([_D, _T], True, True), ("typed_section_lineage_traced",)), (([_D, _T], True, False), ("typed_section_lineage_inferred_order",)), (([_D, _W], True, True), ("weak_typed_section_lineage",)), (([_T], False, True), ("partial_typed_section_lineage",)), (([_W], False, False), ("weak_partial_typed_section_lineage",))])
cases("severity_scores", "s string, e double", "score", lambda: {"score": rounded(rules.severity_score(c("s"), c("e")))}, [(("HIGH", 0.5), (0.5,)), (("medium", 2.0), (0.65,)), ((None, None), (0.2275,)), (("odd", 0.01), (0.0275,)), (("low", 1.0), (0.35,))])
cases("root_constraints", "p string, t string", "root", lambda: {"root": rules.root_constraint(c("p"), c("t"))},
      [(("FP_OPT_GEOM", "an expensive way"), ("cost",)), (("FP_OPT_GEOM", "fine"), ("engineering",)), (("FP_PHYSICAL_CONSTRAINT", None), ("physical",)), (("FP_INFO_CAPACITY", "costly"), ("data",)), (("unknown", ""), ("engineering",))])
cases("smallest_experiments", "r string, k string", "experiment cost_level cycle_weeks", lambda: {x: rules.smallest_experiment(c("r"), c("k"))[x] for x in ("experiment", "cost_level", "cycle_weeks")},
      [(("physical", "loss"), ("Build A/B prototype isolating `loss` and measure physical constraint margins.", "medium", 6)), (("data", ""), ("Run held-out-distribution validation focused on `target bottleneck` with explicit failure slicing.", "low", 3)), (("cost", None), ("Run cost-per-result benchmark for `target bottleneck` under fixed throughput target.", "low", 2)), (("odd", "x"), ("Implement minimal system refactor targeting `x` and benchmark integration overhead.", "medium", 4))])


def _function():
    got = rules.citation_function(c("t"), c("a"), c("u"), c("b"))
    return {"label": got["label"], "confidence": rounded(got["confidence"])}


cases(
    "citation_functions", "t string, a string, u string, b string", "label confidence", _function,
    [
        (("A review of rings", None, "x", None), ("background", 0.62)), (("Filters using rings", "", "x", ""), ("usage", 0.6)), (("We extend rings", "", "", ""), ("extension", 0.6)), (("A benchmark", "", "", ""), ("similarity", 0.58)), (("A bottleneck", "", "", ""), ("motivation", 0.58)),
        (("ring filter laser", None, "ring filter laser", None), ("extension", 0.6)), (("ring filter laser comb grating", "", "ring alpha beta gamma delta", ""), ("similarity", 0.49)), (("ring", None, "comb", None), ("background", 0.45)), ((None, None, None, None), ("background", 0.45)),
    ],
)
cases("function_weights", "f double, k boolean", "weight", lambda: {"weight": rounded(rules.function_weight(c("f"), c("k")))}, [((0.9, True), (0.75,)), ((0.6, True), (0.6,)), ((0.9, False), (0.25,)), ((0.5, False), (0.2,)), ((None, False), (0.0,))])
cases("resolutions", "k string, d string, t string, a string", "confidence", lambda: {"confidence": rules.resolves(c("k"), c("d"), c("t"), c("a"))},
      [(("loss", "", "We overcome LOSS", ""), (0.65,)), (("noise", "thermal noise limits coupling", "Robust coupling", "with thermal control"), (0.55,)), (("loss", "", "loss stays", ""), (None,)), (("technical limitation", "one term", "Efficient term", "technical limitation"), (None,)), ((None, None, None, None), (None,))])
cases("team_scores", "k string, n int", "score", lambda: {"score": rules.team_score(c("k"), c("n"))}, [(("experiment", 6), (1.0,)), (("theory", 2), (1.0,)), (("theory", 4), (0.7,)), ((" Simulation ", 3), (0.6,)), (("experiment", 11), (0.9,)), (("essay", 3), (0.5,)), (("theory", 0), (0.5,)), (("theory", None), (0.5,))])
_SIGNALS = ("recency", "venue", "team", "burst", "review", "breadth", "bridging", "cocite", "outlier", "disruption", "language", "mechanism", "support")


def _py_smoothed(x: tuple) -> float:
    import math

    v = dict(zip(_SIGNALS, x))
    meta = 0.30 * v["recency"] + 0.20 * v["venue"] + 0.15 * v["team"] + 0.20 * v["burst"] + 0.15 * (1 - v["review"])
    ties = 0.5 * v["breadth"] + 0.5 * v["bridging"] if v["cocite"] is None else 0.40 * v["breadth"] + 0.35 * v["cocite"] + 0.25 * v["bridging"]
    other = v["outlier"] if v["disruption"] is None else 0.5 * v["disruption"] + 0.5 * v["outlier"]
    logs = sum(w * math.log((g + 0.5) / 5.5) for w, g in ((0.2, meta), (0.45, ties), (0.2, other), (0.15, 0.5 * v["language"] + 0.5 * v["mechanism"])))
    return round(max(0.0, min(1.0, (math.exp(logs) * 5.5 - 0.5) * (0.85 + 0.15 * v["support"]))), 6)


_INPUTS = [(0.9, 0.5, 0.5, 0.2, 0.0, 0.4, 0.3, 0.7, 0.5, 0.1, 0.6, 0.2, 1.0), (0.1, 0.65, 1.0, 0.9, 1.0, 0.2, 0.8, None, 0.5, None, 0.0, 0.0, 0.0), (0.0,) * 13, (1.0, 1.0, 1.0, 1.0, 0.0) + (1.0,) * 8]
cases("smoothed_scores", ", ".join(f"{s} double" for s in _SIGNALS), "score", lambda: {"score": rounded(rules.smoothed_score({s: c(s) for s in _SIGNALS[:-1]}, c("support")))}, [(x, (_py_smoothed(x),)) for x in _INPUTS])
cases("scholar_ids", "r string", "norm", lambda: {"norm": rules.scholar_id(c("r"))}, [(("S2: abc",), ("abc",)), (("semantic_scholar:Xy",), ("Xy",)), ((" plain ",), ("plain",)), (("s2:",), (None,)), ((None,), (None,))])
cases("topic_fields", "t string", "field", lambda: {"field": rules.field_of_topic(c("t"))},
      [(("physics.optics",), ("31",)), (("cond-mat.mtrl-sci",), ("25",)), (("cond-mat.other",), ("31",)), (("S2F:Medicine",), ("27",)), (("cs.LG",), ("17",)), (("T10245",), (None,)), ((None,), (None,)), ((" q-bio.NC ",), ("13",))])
cases("publication_days", "r string", "day", lambda: {"day": rules.publication_day(c("r")).cast("string")},
      [(("2024-03-15",), ("2024-03-15",)), (("2024/3/5",), ("2024-03-05",)), (("15-01-2024",), ("2024-01-15",)), (("2024-03",), ("2024-03-01",)), ((" 2024 ",), ("2024-01-01",)), (("March 2024",), (None,)), (("2024-13-01",), (None,)), ((None,), ("1970-01-01",))])
cases("quantities", "v double, u string, w string", "value", lambda: {"value": F.round(rules.converted(c("v"), c("u"), c("w")), 9)},
      [((1000.0, "m", "km"), (1.0,)), ((2.0, "dB cm-1", "dB/m"), (200.0,)), ((3.0, "dB·cm⁻¹", "dB/cm"), (3.0,)), ((1.0, "dB*cm**-1", "dB/mm"), (0.1,)), ((1.5, "µm", "nm"), (1500.0,)), ((1.0, "nm", "ps"), (None,)), ((1.0, "parsec", "m"), (None,)), ((2.0, "GHz", "MHz"), (2000.0,))])
cases("contents_lines", "l string", "contents", lambda: {"contents": rules.is_contents_line(c("l"))}, [(("1 Introduction . . . . . 7",), (True,)), (("2.1 Related Work 13",), (True,)), (("Discussion",), (False,)), (("",), (False,)), (("A.1 Further Results 21",), (True,)), (("we saw 13",), (False,))])
cases(
    "section_headings", "l string", "section", lambda: {"section": rules.heading_section(c("l"))},
    [
        (("5. Limitations",), ("limitations",)), (("IV Discussion and Outlook:",), ("discussion",)), (("Conclusions",), ("conclusion",)), (("outlook",), (None,)), (("Outlook",), ("future_work",)), (("3 Methods",), ("method",)), (("Results and Discussion",), ("discussion",)),
        (("Section 4 Failure Cases",), ("error_analysis",)), (("Ablation study",), ("ablation",)), (("The results are good",), (None,)), (("Experimental setup  -",), ("experiments",)), (("3 Results and More 17",), (None,)), (("",), (None,)), ((None,), (None,)),
    ],
)
cases("ranked_sentences", "t string", "ranked", lambda: {"ranked": F.array_join(rules.bottleneck_first(rules.abstract_sentences(c("t"))), " | ")},
      [(("All is well here. However, loss remains. It is short.",), ("However, loss remains. | All is well here. | It is short.",)), (("One two three four. no capital starts it.",), ("One two three four. no capital starts it.",)), (("Short. Nothing else is here!",), ("Nothing else is here!",)), (("",), ("",))])
_LONG = "This is a long first sentence that says what was done and how it was measured. " * 4
cases("abstracts_of_texts", "t string", "abstract", lambda: {"abstract": rules.abstract_of(c("t"))},
      [((f"Title\nAbstract\n{_LONG}\n1 Introduction\nmore",), (_LONG.strip(),)), ((f"Title\n\n{_LONG}\n\nnext",), (_LONG.strip(),)), (("Title\nABSTRACT:\nToo short.\nKeywords a",), (None,)), (("short",), (None,)), ((None,), (None,))])
cases("response_scores", "r string", "score", lambda: {"score": rules.response_score(c("r"))}, [(('{"score": 4}',), (4,)), (('text {"why": 1, "score": 2} end',), (2,)), (("I say 3 of 5",), (3,)), (('{"score": 9}',), (1,)), (("none",), (1,)), (("10",), (1,))])
cases("topic_relevance", "t string", "score", lambda: {"score": rules.topic_relevance(c("t"), ["metasurface"], ["lens", "phase"], ["light"])}, [(("A metasurface lens",), (6,)), (("Light and phase of light",), (3,)), (("none",), (0,)), ((None,), (0,))])


@query("SELECT p_partkey, substr(sha256('parser|' || p_size || '|' || p_brand), 1, 16) AS hash FROM part")
def parser_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.parser_hash(F.lit("parser"), c("p_size").cast("string"), c("p_brand")).alias("hash"))


_ALPHABET = "'0123456789ABCDEFGHJKMNPQRSTVWXYZ'"


@query(
    "SELECT event_id, " + " || ".join(f"substr({_ALPHABET}, (((epoch_us(ts) // 1000) >> {5 * (9 - i)}) & 31)::INT + 1, 1)" for i in range(10)) + " || " + " || ".join(f"substr({_ALPHABET}, (('0x' || substr(md5(event_id::VARCHAR), {2 * i + 1}, 2))::BIGINT & 31)::INT + 1, 1)" for i in range(16)) + " AS ulid FROM events"
)
def ulids(spark, d):
    return table(spark, d, "events").select("event_id", rules.ulid(c("ts").cast("timestamp"), c("event_id").cast("string")).alias("ulid"))


@query("SELECT o_custkey, (o_custkey * 137.5) % 360 AS hue, '#' || printf('%02x%02x%02x', r, g, b) AS colour FROM (SELECT o_custkey, " + ", ".join(
    f"floor(255 * (CASE WHEN t{k} < 1.0::DOUBLE / 6 THEN p + (q - p) * 6 * t{k} WHEN t{k} < 0.5 THEN q WHEN t{k} < 2.0::DOUBLE / 3 THEN p + (q - p) * (2.0::DOUBLE / 3 - t{k}) * 6 ELSE p END))::INT AS {k}" for k in "rgb"
) + " FROM (SELECT *, " + ", ".join(f"CASE WHEN h + {o} < 0 THEN h + {o} + 1 WHEN h + {o} > 1 THEN h + {o} - 1 ELSE h + {o} END AS t{k}" for k, o in (("r", "1.0::DOUBLE / 3"), ("g", "0.0::DOUBLE"), ("b", "-1.0::DOUBLE / 3"))) + f" FROM (SELECT DISTINCT o_custkey, ((o_custkey * 137.5::DOUBLE) % 360) / 360.0::DOUBLE AS h, {0.55 + 0.70 - 0.55 * 0.70!r}::DOUBLE AS q, {2 * 0.55 - (0.55 + 0.70 - 0.55 * 0.70)!r}::DOUBLE AS p FROM orders)))")
def field_colours(spark, d):
    return table(spark, d, "orders").select("o_custkey").distinct().select("o_custkey", F.pmod(c("o_custkey") * 137.5, F.lit(360.0)).alias("hue"), rules.hue_colour(c("o_custkey")).alias("colour"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '2000-01-01' - 1094 AND DATE '2000-01-01' - 364")
def sampling_window(spark, d):
    since, until = rules.sampling_window("established", F.lit("2000-01-01").cast("date"))
    return table(spark, d, "orders").filter(rules.within_dates(c("o_orderdate").cast("date"), since, until)).select("o_orderkey")
