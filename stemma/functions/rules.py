"""Rules over single rows: gates, grades, readiness, identifiers, dates, quantities, colours, headings, abstracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clip

# Units of measure and what counts as a mention of one after a number.
_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
UNITS = ("nm", "µm", "um", "mm", "cm", "db", "dbi", "thz", "ghz", "mhz", "khz", "hz", "w", "mw", "µw", "uw", "kw", "fs", "ps", "ns", "µs", "us", "ev", "mev", "kev", "gev", "k", "mk", "pa", "kpa", "mpa", "t", "mt", "µt", "cm-1", "cm⁻¹", "sr", "rad", "db/cm", "db/km", "%")
# Names of data sets near which a measured performance counts.
DATASETS = (
    "coco", "imagenet", "cifar", "glue", "squad", "mmlu", "humaneval", "ms-marco", "wmt", "mnist", "vqa", "vqav2", "nocaps", "vizwiz", "okvqa", "textvqa", "gqa", "refcoco", "conceptual captions", "laion", "yfcc", "flickr30k",
    "msvd", "msrvtt", "superglue", "mnli", "sst", "cityscapes", "ade20k", "pascal voc", "lvis", "kinetics", "hmdb", "ucf101", "something-something", "clevr", "scanqa", "sqa", "scienceqa", "winogrande", "hellaswag", "arc",
    "truthfulqa", "gsm8k", "math", "mbpp", "mujoco", "atari", "dm control", "dmc", "metaworld", "openai gym", "d4rl", "robosuite", "maniskill",
)
# Patterns of performance, ablation, complexity, scale, comparison and theory.
PERFORMANCE = r"[0-9]+(?:\.[0-9]+)?\s*%|[0-9]+\.[0-9]+\s*(?:f1|bleu|rouge|auc|map|accuracy|ap\b)"
ABLATION_STUDY, ABLATION = r"(?i)ablation\s+(?:table|study|experiment|analysis|result)", r"(?i)ablat\w*"
COMPLEXITY = r"(?i)O\([^)]+\)|time\s+complexity|space\s+complexity|polynomial\s+time|convergence\s+rate|(?:FLOPS|GFLOPs|FLOPs)\b"
SCALE = r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:million|billion|[kmgt])\s*(?:samples|parameters|examples|images|tokens|trajectories)"
COMPARISONS = (
    "compare", "compared", "comparison", "baseline", "baselines", "outperform", "outperforms", "outperformed", "versus", " vs ", " vs.", "against", "surpass", "surpasses", "surpassed", "improve", "improves", "improvement", "gain", "gains",
    "better than", "superior to", "state-of-the-art", "sota",
)
THEORY = (
    r"\btheorem\b", r"\blemma\b", r"\bproof\b|\bprove\b|\bproven\b|\bproved\b", r"\bproposition\b", r"\bcorollary\b", r"\bwe\s+prove\b", r"\bit\s+can\s+be\s+shown\s+that\b", r"\bunder\s+the\s+assumption\b", r"\bbound\s+is\s+tight\b",
    r"\bguarantees?\s+that\b", r"\bsufficient\s+condition\b", r"\bnecessary\s+condition\b",
)
# Effective refractive indices at 1550 nm, and other names of media.
INDEX = {"si": 3.476, "sin": 2.0, "ln": 2.21, "glass": 1.444, "gaas": 3.37, "air": 1.0003, "vacuum": 1.0}
MEDIA = {"silicon": "si", "si3n4": "sin", "silicon_nitride": "sin", "siliconnitride": "sin", "linbo3": "ln", "lithiumniobate": "ln", "sio2": "glass", "silica": "glass", "fused_silica": "glass", "fusedsilica": "glass", "galliumarsenide": "gaas", "unknown": "vacuum"}
# Dimensions that simulation tools support; other tools support both.
TOOLS = {"SPINS-B": ("2D",), "FDFD-2D": ("2D",), "FDTD-3D": ("3D",)}
# What a validation of each kind must state, and its score without.
REQUIRED = {"experiment": (("alpha", "statistical_power", "sample_size"), None), "simulation": (("convergence_criterion",), 0.5), "theory": (("validity_domain",), 0.4)}
HINTS = {
    "simulation": ("fdtd", "meep", "lumerical", "tidy3d", "simulation", "simulated", "numerically", "fem"), "experiment": ("measured", "fabricated", "experiment", "sample", "device"),
    "theory": ("analytical", "theoretically", "derivation", "perturbation"),
}
# Scores of teams by kind of work: up to 3 authors, 4 to 10, 11 and more.
TEAMS = {"experiment": (0.5, 1.0, 0.9), "simulation": (0.6, 1.0, 0.8), "theory": (1.0, 0.7, 0.7)}
# Fields of topics, by whole name and by prefix in the order in which they count.
FIELDS = {
    "physics.optics": "31", "quant-ph": "31", "cond-mat.mtrl-sci": "25", "s2f:physics": "31", "s2f:materials_science": "25", "s2f:computer_science": "17", "s2f:medicine": "27", "s2f:engineering": "22", "s2f:mathematics": "26",
    "s2f:chemistry": "16", "s2f:biology": "13", "s2f:economics": "20",
}
FIELD_PREFIXES = {"physics.": "31", "cond-mat.": "31", "hep-": "31", "astro-ph": "31", "gr-qc": "31", "nucl-": "31", "nlin.": "31", "cs.": "17", "eess.": "22", "math.": "26", "stat.": "26", "q-fin.": "20", "q-bio.": "13"}
# Kinds of evidence, their grades and weights, and the order of tiers.
SECTION_QUALITIES, WEAK_QUALITIES, MODEL_QUALITIES = ("section_level", "structured_sections", "primary_section", "full_text_section"), ("weak_abstract", "abstract"), ("model_only", "calibrated_graph", "edge_candidate")
STRONG_STRATEGIES, MODERATE_STRATEGIES = ("explicit_heading", "heading_continuation", "embedded_heading"), ("inline_heading",)
DECISION_SECTIONS = ("limitation", "limitations", "discussion", "conclusion", "conclusions", "future_work", "future_directions", "results", "error_analysis", "ablation", "method", "methods", "experiments")
ATOM_WEIGHTS = {"section_atom_decision_grade": 0.90, "section_atom_traced": 0.78, "section_atom_weak": 0.52}
MODERATE_PARTIAL = ("constraint_failure_only", "attempted_path_partial", "local_fix_partial", "resolution_candidate_partial", "validated_resolution_partial")
TIERS = {"insufficient": 0, "exploratory_uncalibrated_candidate": 1, "exploratory_weak_limitation": 1, "exploratory": 2, "triangulated_limited": 3, "triangulated_strong": 4}
SEVERITIES = {"high": 1.0, "medium": 0.65, "low": 0.35}
# Terms of cost and of resolution, roots of principles, weeks and cost of their smallest experiments.
COST = r"(?i)\b(cost|expensive|budget|resource|compute|latency|throughput|memory|time-consuming|slow|infrastructure)\b"
RESOLUTION = r"(?i)\b(overcome|resolve|mitigate|address|improve|improved|enable|enabled|demonstrate|scalable|room-temperature|low-loss|robust|efficient|high-performance|integrated)\b"
ROOTS = {"FP_PHYSICAL_CONSTRAINT": "physical", "FP_SCALING_INTEGRATION": "engineering", "FP_OPT_GEOM": "engineering", "FP_INFO_CAPACITY": "data", "FP_GENERALIZATION_SHIFT": "data", "FP_OTHER": "cost"}
EXPERIMENTS = {
    "physical": ("Build A/B prototype isolating `{}` and measure physical constraint margins.", "medium", 6), "data": ("Run held-out-distribution validation focused on `{}` with explicit failure slicing.", "low", 3),
    "cost": ("Run cost-per-result benchmark for `{}` under fixed throughput target.", "low", 2), "engineering": ("Implement minimal system refactor targeting `{}` and benchmark integration overhead.", "medium", 4),
}
# Citation functions by words of the citing text, in the order in which they count, with confidence.
FUNCTIONS = (
    (r"\b(review|survey|tutorial|perspective|roadmap)\b", "background", 0.62), (r"\b(using|utilizing|based on|built on|employ|implemented|derived from)\b", "usage", 0.60),
    (r"\b(extend|extends|extension|improve|improved|enhance|enhanced)\b", "extension", 0.60), (r"\b(compare|compared|similar|contrast|benchmark)\b", "similarity", 0.58), (r"\b(motivat|inspir|challenge|limitation|bottleneck)\b", "motivation", 0.58),
)
STOP_WORDS = ("the", "and", "for", "with", "from", "using", "based", "paper", "study", "optical", "photonic", "photonics", "light", "system", "systems", "method", "methods", "towards", "toward", "novel", "new", "high", "low")
# Headings of sections, in the order in which they count.
_HEAD, _TAIL = r"(?i)^\s*(section\s+)?(\d+(\.\d+)*|[ivx]+|[a-z])?[\).:\s-]*(", r")\s*[:.\-–—]*\s*$"
HEADINGS = {
    "limitations": "limitation|limitations|open challenges?|challenges and limitations|limitations and future work", "discussion": "discussion|discussion and outlook|discussion and conclusions?|results and discussion",
    "conclusion": "conclusion|conclusions|concluding remarks?|summary|summary and conclusions?", "future_work": "future work|outlook|perspective|perspectives|summary and outlook|conclusions? and outlook",
    "results": "results?|evaluation|experimental results|results and discussion", "error_analysis": "error analysis|failure analysis|limitations and discussion|failure cases?", "ablation": "ablation( study| analysis)?",
    "method": "method|methods|methodology|approach|materials and methods|theoretical model|model and methods|device fabrication|fabrication and characterization", "experiments": "experiment|experiments|experimental setup|experimental methods|experiment setup|validation experiment",
}
DOT_LEADER, NUMBERED_ENTRY = r"\.\s*(?:\.\s*){2,}\d{1,4}(?:\s|$)", r"^\s*(?:section\s+)?(?:\d+(?:\.\d+)*|[A-Z](?:\.\d+)?)\s+[A-Z][A-Za-z0-9,&()/+'\-\s]{2,90}\s+\d{1,4}\s*$"
# Words by which a sentence speaks of a bottleneck.
BOTTLENECK = (
    "limitation", "limited", "limit", "challenge", "challenging", "however", "although", "but", "despite", "yet", "constraint", "constrain", "barrier", "bottleneck", "difficult", "problem", "issue", "unsolved", "unresolved", "remain",
    "hinder", "impede", "restrict", "prevent", "lack", "insufficient", "inadequate", "trade-off", "tradeoff", "gap",
)
NOT_RESEARCH = ("editorial", "letter", "erratum", "correction", "retraction", "comment")
#: Factors of units to the first of their dimension.
SCALES = {
    "length": {"m": 1.0, "km": 1e3, "cm": 1e-2, "mm": 1e-3, "um": 1e-6, "µm": 1e-6, "nm": 1e-9}, "time": {"s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9, "ps": 1e-12, "fs": 1e-15}, "frequency": {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9, "THz": 1e12},
    "power": {"W": 1.0, "kW": 1e3, "mW": 1e-3, "uW": 1e-6, "µW": 1e-6}, "energy": {"eV": 1.0, "meV": 1e-3, "keV": 1e3, "MeV": 1e6, "GeV": 1e9}, "loss": {"dB/m": 1.0, "dB/cm": 1e2, "dB/km": 1e-3, "dB/mm": 1e3}, "gain": {"dB": 1.0},
}
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def looked_up(key: Column, table: dict, default: Column | None = None) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def holds(text: Column, part: str) -> Column:
    return text.contains(part).cast("int")


def literal(parts: tuple[str, ...]) -> str:
    """A pattern of any of these strings."""
    return "|".join(rf"\Q{p}\E" for p in parts)


# Depth of a text


def windows(text: Column, pattern: str, around: int) -> Column:
    """Array of the text around each match, `around` characters on either side."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def near(m: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
        start = F.greatest(F.lit(0), before - around)
        return F.substr(text, start + 1, before + F.length(m) + around - start)

    return F.transform(found, near)


def depth_counts(text: Column) -> dict[str, Column]:
    """What each path to physical depth counts in a text."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    studies, compared = count_of(t, ABLATION_STUDY), total([holds(low, k) for k in COMPARISONS])
    return {
        "path_1": count_of(low, rf"(?i)({_NUMBER})\s*(?:{'|'.join(sorted(map(_quoted, UNITS), key=len, reverse=True))})\b"),
        "path_2a": F.size(F.filter(windows(low, PERFORMANCE, 50), lambda w: w.rlike(literal(DATASETS)))),
        "path_2b": F.when(studies > 0, studies * 3).otherwise(count_of(t, ABLATION)),
        "path_2c": count_of(t, COMPLEXITY),
        "path_2d": count_of(t, SCALE),
        "path_3": F.when(compared > 0, compared + count_of(low, r"[0-9]+(?:\.[0-9]+)?")).otherwise(0),
        "path_4": total([t.rlike(f"(?i){p}").cast("int") for p in THEORY]),
    }


def _quoted(s: str) -> str:
    return rf"\Q{s}\E"


#: How much each path must count.
DEPTH = {"path_1": 3, "path_2a": 1, "path_2b": 3, "path_2c": 3, "path_2d": 1, "path_3": 3, "path_4": 2}


def depth_paths(text: Column) -> Column:
    """The paths to physical depth that a text passes."""
    return F.array_compact(F.array(*[F.when(n >= DEPTH[k], F.lit(k)) for k, n in depth_counts(text).items()]))


# Gates


def cross_domain(age_months: Column, bridging: Column, topics: Column, least_z: float = 0.0, least_topics: int = 3) -> Column:
    return F.when(age_months >= 6, bridging >= least_z).otherwise(F.size(F.array_distinct(F.coalesce(topics, F.array().cast("array<string>")))) >= least_topics)


def readiness(evidence: Column, counter: Column, crosses: Column, subfields: Column, geometry: Column, materials: Column, simulation: Column, fabrication: Column, score: Column) -> Column:
    """Level 0 to 4."""
    bonus = F.when(F.coalesce(counter, F.lit(False)), 0.5).when(crosses & (subfields >= 2), 0.3).otherwise(0.0)
    high = F.least(F.lit(4), F.floor(2 + bonus + simulation.cast("int") + (fabrication & (score >= 0.6)).cast("int")))
    return F.when(~evidence, 0).when(~(geometry & materials), 1).otherwise(high).cast("int")


def simulation_gate(tool: Column, wanted: Column) -> Column:
    """(allowed, dimension): a tool of two dimensions only takes a three-dimensional task down to two."""
    dims = looked_up(tool, {k: ",".join(v) for k, v in TOOLS.items()}, F.lit("2D,3D"))
    fits = dims.contains(wanted)
    down = (wanted == "3D") & dims.contains("2D")
    return F.struct((fits | down).alias("allowed"), F.when(fits | ~down, wanted).otherwise("2D").alias("dimension"))


def falsifiability(kind: Column, claim: Column, stated: dict[str, Column]) -> Column:
    """(kind, score, missing): by its kind, or the kind that words of the claim suggest, what a validation lacks."""
    low = F.lower(F.coalesce(claim, F.lit("")))
    n = {k: total([holds(low, w) for w in ws]) for k, ws in HINTS.items()}
    guess = F.when((n["simulation"] >= n["experiment"]) & (n["simulation"] >= n["theory"]) & (n["simulation"] > 0), "simulation").when((n["experiment"] >= n["theory"]) & (n["experiment"] > 0), "experiment").when(n["theory"] > 0, "theory").otherwise("experiment")
    known = F.coalesce(F.when(F.lower(kind).isin(*REQUIRED), F.lower(kind)), guess)
    missing, score = F.array().cast("array<string>"), F.lit(0.0)
    for k, (names, without) in REQUIRED.items():
        gone = F.array_compact(F.array(*[F.when(stated[x].isNull(), F.lit(x)) for x in names]))
        missing = F.when(known == k, gone).otherwise(missing)
        score = F.when(known == k, F.when(F.size(gone) == 0, 1.0).otherwise(without) if without else 1 - F.size(gone) / F.lit(3.0)).otherwise(score)
    return F.struct(known.alias("kind"), score.alias("score"), missing.alias("missing"))


def refractive_index(medium: Column) -> Column:
    """Unknown media count as a vacuum."""
    name = F.regexp_replace(F.lower(medium), "[ -]", "_")
    return looked_up(looked_up(name, MEDIA, name), INDEX, F.lit(1.0))


def wavelength_in(medium: Column, nanometres: Column) -> Column:
    return F.when(nanometres > 0, nanometres / refractive_index(medium))


def is_research(kind: Column) -> Column:
    return ~F.coalesce(kind.isin(*NOT_RESEARCH), F.lit(False))


def within_dates(day: Column, since: Column, until: Column) -> Column:
    """Inclusive; null ends are open."""
    return F.coalesce(day >= since, F.lit(True)) & F.coalesce(day <= until, F.lit(True)) & day.isNotNull()


# Evidence


def grade_of(section: Column, weak: Column, model: Column, n: Column) -> Column:
    """Grade from counts of labels by kind."""
    share = section / F.greatest(n, F.lit(1))
    return F.when(n == 0, "insufficient").when((section >= 3) & (share >= 0.7), "strong_section").when((section >= 1) & (share >= 0.35), "moderate_section").when((weak > 0) & (section == 0), "weak_abstract").when((model > 0) & (section == 0) & (weak == 0), "model_only").otherwise("metadata_only")


def coverage_grade(linked: Column, sections: Column, works: Column) -> Column:
    return F.when((linked >= 0.30) & (sections >= 0.12) & (works >= 0.70), "usable_evidence_bone").when((linked >= 0.15) & (sections >= 0.03), "thin_evidence_bone").otherwise("very_thin_evidence_bone")


def scope_policy(grade: Column, card: Column, calibrated: Column, linked: Column) -> Column:
    return F.when((grade == "strong_section") & card & calibrated & (linked >= 0.30), "validated_candidate").when(grade.isin("strong_section", "moderate_section") & card, "exploratory_with_claim_card").when(grade.isin("weak_abstract", "metadata_only", "model_only"), "candidate_pool_only").otherwise("insufficient_evidence")


def provenance_strength(strategies: Column, grade: Column) -> Column:
    some = F.filter(strategies, lambda x: F.trim(x) != "")
    any_of = lambda names: F.arrays_overlap(some, F.array(*map(F.lit, names)))
    by_grade = F.when(grade.isin("section_explicit_heading", "section_embedded_heading"), "strong").when(grade == "section_inline_heading", "moderate").otherwise("weak")
    return F.when(F.size(some) > 0, F.when(any_of(STRONG_STRATEGIES), "strong").when(any_of(MODERATE_STRATEGIES), "moderate").otherwise("weak")).otherwise(by_grade)


def higher_tier(left: Column, right: Column) -> Column:
    rank = lambda c: looked_up(c, TIERS, F.lit(0))
    return F.when(rank(left) >= rank(right), left).otherwise(right)


def atom_weight(grade: Column, current: Column, chain_grade: Column, chain: Column) -> Column:
    """Weight of a limitation taken from a section atom; current: its parser contract is the current one."""
    base = looked_up(grade, ATOM_WEIGHTS, F.lit(0.52))
    lifted = F.when(chain_grade == "typed_section_lineage", 0.94).when(chain_grade == "typed_section_lineage_traced", 0.88).when((chain_grade == "partial_typed_section_lineage") & chain.isin(*MODERATE_PARTIAL), 0.82).otherwise(0.0)
    return F.when(~current, F.least(base, F.lit(0.60))).otherwise(F.greatest(base, lifted))


def chain_weight(grade: Column, complete: Column, chain: Column) -> Column:
    return (
        F.when(grade == "typed_section_lineage", 0.92).when(grade == "typed_section_lineage_traced", 0.85).when(complete, 0.70)
        .when(grade == "partial_typed_section_lineage", F.when(chain.isin(*MODERATE_PARTIAL), 0.68).otherwise(0.50)).otherwise(0.45)
    )


def chain_grade(grades: Column, complete: Column, in_order: Column) -> Column:
    """Grade of a chain from the array of its atoms' grades."""
    traced = F.forall(grades, lambda g: g.isin("section_atom_decision_grade", "section_atom_traced"))
    decision = F.forall(grades, lambda g: g == "section_atom_decision_grade") & (F.size(grades) > 0)
    return (
        F.when(complete & ~in_order & traced, "typed_section_lineage_inferred_order").when(complete & decision, "typed_section_lineage").when(complete & traced, "typed_section_lineage_traced")
        .when(complete, "weak_typed_section_lineage").when(traced, "partial_typed_section_lineage").otherwise("weak_partial_typed_section_lineage")
    )


def severity_score(severity: Column, evidence: Column) -> Column:
    return looked_up(F.lower(F.coalesce(severity, F.lit("medium"))), SEVERITIES, F.lit(0.55)) * clip(F.when(F.coalesce(evidence, F.lit(0.0)) == 0, 0.35).otherwise(evidence), 0.05, 1.0)


def root_constraint(principle: Column, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(COST), "cost").otherwise(looked_up(principle, ROOTS, F.lit("engineering")))


def smallest_experiment(root: Column, keyword: Column) -> Column:
    """(experiment, cost_level, cycle_weeks)."""
    kw = F.coalesce(F.nullif(keyword, F.lit("")), F.lit("target bottleneck"))
    known = F.when(root.isin(*EXPERIMENTS), root).otherwise("engineering")
    said = looked_up(known, {k: v[0] for k, v in EXPERIMENTS.items()})
    return F.struct(F.replace(said, F.lit("{}"), kw).alias("experiment"), looked_up(known, {k: v[1] for k, v in EXPERIMENTS.items()}).alias("cost_level"), looked_up(known, {k: v[2] for k, v in EXPERIMENTS.items()}).alias("cycle_weeks"))


def name_tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or more without stop words."""
    return F.array_except(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[a-zA-Z][a-zA-Z0-9\-]{2,}"), F.lit(0)), lambda w: F.lower(w)), F.array(*map(F.lit, STOP_WORDS)))


def citation_function(citing_title: Column, citing_abstract: Column, cited_title: Column, cited_abstract: Column) -> Column:
    """(label, confidence): by words of the citing text, else by shared words."""
    joined = lambda a, b: F.concat_ws(" ", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    text = F.lower(joined(citing_title, citing_abstract))
    mine, theirs = name_tokens(joined(citing_title, F.left(citing_abstract, F.lit(800)))), name_tokens(joined(cited_title, F.left(cited_abstract, F.lit(800))))
    share = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.lit(1), F.least(F.size(mine), F.size(theirs)))
    said = lambda label, c: F.struct(F.lit(label).alias("label"), c.cast("double").alias("confidence"))
    out = F.when(text.rlike(FUNCTIONS[0][0]), said(FUNCTIONS[0][1], F.lit(FUNCTIONS[0][2])))
    for pattern, label, c in FUNCTIONS[1:]:
        out = out.when(text.rlike(pattern), said(label, F.lit(c)))
    return out.when(share >= 0.35, said("extension", F.least(F.lit(0.60), 0.45 + 0.35 * share))).when(share >= 0.18, said("similarity", F.least(F.lit(0.55), 0.42 + 0.35 * share))).otherwise(said("background", F.lit(0.45)))


def function_weight(confidence: Column, context: Column) -> Column:
    c = clip(F.coalesce(confidence, F.lit(0.0)))
    return F.when(context, F.least(F.lit(0.75), c)).otherwise(F.least(F.lit(0.25), c * 0.40))


def resolves(keyword: Column, description: Column, title: Column, abstract: Column) -> Column:
    """Confidence that a later paper resolves a limitation, or null: its keyword or two of its terms, and a word of resolution."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    k = F.lower(F.coalesce(keyword, F.lit("")))
    hit = (k != "") & (k != "technical limitation") & F.contains(F.lower(text), k)
    terms = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"[a-zA-Z][a-zA-Z0-9\-]{3,}"), F.lit(0)), lambda w: F.lower(w))
    shared = F.size(F.array_intersect(terms(F.coalesce(description, F.lit(""))), terms(F.left(text, F.lit(2500)))))
    return F.when((hit | (shared >= 2)) & text.rlike(RESOLUTION), F.when(hit, 0.65).otherwise(0.55))


def team_score(kind: Column, authors: Column) -> Column:
    k = F.lower(F.trim(kind))
    i = F.when(authors <= 3, 1).when(authors <= 10, 2).otherwise(3)
    by = F.try_element_at(F.create_map(*[x for n, v in TEAMS.items() for x in (F.lit(n), F.array(*map(F.lit, v)))]), k)
    return F.when(F.coalesce(authors, F.lit(0)) == 0, 0.5).otherwise(F.coalesce(F.element_at(by, i), F.lit(0.5)))


def smoothed_score(signals: dict[str, Column], support: Column) -> Column:
    """Geometric mean of four groups of signals, each smoothed to (x + 0.5) / 5.5; null breadth and disruption leave their groups."""
    s = {k: clip(v) for k, v in signals.items()}
    meta = clip(0.30 * s["recency"] + 0.20 * s["venue"] + 0.15 * s["team"] + 0.20 * s["burst"] + 0.15 * (1.0 - s["review"]))
    ties = F.when(s["cocite"].isNull(), 0.5 * s["breadth"] + 0.5 * s["bridging"]).otherwise(0.40 * s["breadth"] + 0.35 * s["cocite"] + 0.25 * s["bridging"])
    other = F.when(s["disruption"].isNull(), s["outlier"]).otherwise(0.5 * s["disruption"] + 0.5 * s["outlier"])
    model = 0.5 * s["language"] + 0.5 * s["mechanism"]
    logs = total([w * F.log((clip(x) + 0.5) / 5.5) for w, x in ((0.20, meta), (0.45, ties), (0.20, other), (0.15, model))])
    return clip((F.exp(logs) * 5.5 - 0.5) * (0.85 + 0.15 * clip(support)))


# Identifiers, dates, quantities


def scholar_id(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(raw), r"(?i)^s2:\s*", "")
    return F.nullif(F.trim(F.regexp_replace(s, r"(?i)^semantic_scholar:\s*", "")), F.lit(""))


def field_of_topic(topic: Column) -> Column:
    t = F.lower(F.trim(topic))
    return F.coalesce(looked_up(t, FIELDS), *[F.when(t.startswith(p), F.lit(v)) for p, v in FIELD_PREFIXES.items()])


def publication_day(raw: Column) -> Column:
    """A day from usual forms; null where none fits, 1970 where nothing is given."""
    s = F.trim(raw)
    made = (
        F.when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01"))).when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))).when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.replace(s, F.lit("/"), F.lit("-")))
        .when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.regexp_replace(s, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1")).when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s)
    )
    return F.when(raw.isNull(), F.lit("1970-01-01").cast("date")).otherwise(made.try_cast("date"))


def plain_unit(unit: Column) -> Column:
    """dB cm-1, dB·cm⁻¹ and the like as dB/cm."""
    s = F.translate(F.trim(unit), "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻−–—", "0123456789+----")
    s = F.regexp_replace(F.regexp_replace(s, r"\*\*", ""), r"[·•⋅×✕*]", " ")
    return F.regexp_replace(s, r"^dB\s*/?\s*(cm|mm|km|m)(?:-1)?$", "dB/$1")


def converted(value: Column, unit: Column, target: Column) -> Column:
    """The value in the target unit; null if either is unknown or their dimensions differ."""
    factor = {u: f for table in SCALES.values() for u, f in table.items()}
    kind = {u: k for k, table in SCALES.items() for u in table}
    a, b = plain_unit(unit), plain_unit(target)
    return F.when(looked_up(a, kind) == looked_up(b, kind), value * looked_up(a, factor) / looked_up(b, factor))


def parser_hash(name: Column, version: Column, schema: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", name, version, schema).cast("binary"), 256), F.lit(16))


def ulid(moment: Column, seed: Column) -> Column:
    """26 characters that sort by time (milliseconds), the last 16 from the md5 of seed."""
    ms, low = F.unix_millis(moment), F.md5(seed.cast("binary"))
    at = lambda n: F.substring(F.lit(_BASE32), n.cast("int") + 1, 1)
    head = [F.substr(F.lit(_BASE32), (F.shiftright(ms, 5 * (9 - i)).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(10)]
    tail = [F.substr(F.lit(_BASE32), (F.conv(F.substring(low, 2 * i + 1, 2), 16, 10).cast("int").bitwiseAND(31) + 1), F.lit(1)) for i in range(16)]
    return F.concat(*head, *tail)


def hue_colour(number: Column) -> Column:
    """Hex colour of a field's number by the golden angle, saturation 0.70, lightness 0.55; grey without a number."""
    h = F.pmod(number * 137.5, F.lit(360.0)) / 360.0
    q = 0.55 + 0.70 - 0.55 * 0.70
    p = 2 * 0.55 - q

    def channel(t: Column) -> Column:
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        v = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)
        return F.lower(F.lpad(F.hex(F.floor(255 * v).cast("long")), 2, "0"))

    return F.when(number.isNull(), "#888888").otherwise(F.concat(F.lit("#"), channel(h + 1 / 3), channel(h), channel(h - 1 / 3)))


def sampling_window(kind: str, today: Column) -> tuple[Column, Column]:
    """(from, to): the days between which a pilot samples, in months of 30.4 days."""
    low, high = {"fresh": (6, 18), "established": (12, 36), "mature": (36, 60)}[kind]
    return F.date_sub(today, int(high * 30.4)), F.date_sub(today, int(low * 30.4))


# Text


def is_contents_line(line: Column) -> Column:
    clean = F.left(F.regexp_replace(F.trim(line), r"\s+", " "), F.lit(180))
    return clean.rlike(DOT_LEADER) | clean.rlike(NUMBERED_ENTRY)


def heading_section(line: Column) -> Column:
    """The section that a heading opens, or null."""
    clean = F.left(F.regexp_replace(F.trim(line), r"\s+", " "), F.lit(120))
    bare = F.lower(F.regexp_replace(clean, r"^[ .:;–—-]+|[ .:;–—-]+$", ""))
    broken = bare.isin("outlook", "perspective", "perspectives") & ~clean.rlike(r"^\p{Lu}")
    return F.when((clean != "") & ~is_contents_line(clean) & ~broken, F.coalesce(*[F.when(clean.rlike(_HEAD + p + _TAIL), F.lit(name)) for name, p in HEADINGS.items()]))


def abstract_sentences(text: Column) -> Column:
    """Sentences of ten characters or more, cut before capitals."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: F.length(s) >= 10)


def bottleneck_first(sentences: Column) -> Column:
    """Sentences that speak of bottlenecks, then the others, each in their order."""
    told = lambda s: F.lower(s).rlike(literal(BOTTLENECK))
    return F.concat(F.filter(sentences, told), F.filter(sentences, lambda s: ~told(s)))


def abstract_of(text: Column, most: int = 2500) -> Column:
    """From the heading Abstract to the next one, else the first long paragraph, cut at a sentence's end."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[ \t\x{A0}]+", " "), r"\n{3,}", "\n\n")
    start = r"(?i)(?:^|\n)\s*(?:abstract|a\s*b\s*s\s*t\s*r\s*a\s*c\s*t)\s*[:\-–—]?\s*\n"
    body = F.try_element_at(F.split(clean, start, 2), F.lit(2))
    stop = F.try_element_at(F.split(body, r"(?i)\n\s*(?:1[.\s]|introduction|keywords|key\s+words)\b", 2), F.lit(1))
    named = F.trim(F.when(F.length(stop) < F.length(body), stop).otherwise(F.left(body, F.lit(most))))

    def cut(s: Column) -> Column:
        short = F.left(s, F.lit(most))
        ended = F.regexp_extract(short, r"(?s)^(.*\.)", 1)
        return F.when(F.length(s) <= most, s).when(F.length(ended) > most // 2 + 1, ended).otherwise(short)

    long = F.get(F.filter(F.transform(F.split(clean, r"\n\n"), lambda p: F.trim(p)), lambda p: (F.length(p) > 200) & (F.regexp_count(p, F.lit(r"\S+")) >= 30)), F.lit(0))
    return F.when((F.size(F.split(clean, start, 2)) > 1) & (F.length(cut(named)) >= 50), cut(named)).otherwise(cut(long))


def response_score(said: Column) -> Column:
    """A score of 1 to 5 in what a model answered; 1 where there is none."""
    inside = F.regexp_extract(said, r'\{[^{}]*"score"\s*:\s*(\d+(?:\.\d+)?)[^{}]*\}', 1).try_cast("double")
    bare = F.regexp_extract(said, r"\b([1-5])\b", 1).try_cast("int")
    return F.coalesce(F.when(inside.between(1, 5) & (inside == F.floor(inside)), inside.cast("int")), bare, F.lit(1))


def topic_relevance(text: Column, strong: list[str], medium: list[str], weak: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return total([F.lit(0)] + [w * holds(low, t) for w, ts in ((4, strong), (2, medium), (1, weak)) for t in ts])
