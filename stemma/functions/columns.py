"""Column expressions for scores, ages, identifiers and evidence rules. All run inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a month by which ages become life-cycle stages.
MONTH_DAYS = 30.4375

#: Weights of the signals by life-cycle stage; a negative weight is a penalty.
KEYSTONE_WEIGHTS = {
    "fresh": {"recency": 0.15, "venue": 0.05, "burst": 0.15, "review": -0.10, "breadth": 0.10, "linked": 0.0, "bridging": 0.20, "disruption": 0.0},
    "growing": {"recency": 0.10, "venue": 0.05, "burst": 0.20, "review": -0.10, "breadth": 0.15, "linked": 0.05, "bridging": 0.25, "disruption": 0.0},
    "mature": {"recency": 0.05, "venue": 0.05, "burst": 0.05, "review": -0.10, "breadth": 0.10, "linked": 0.15, "bridging": 0.25, "disruption": 0.25},
}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null; greatest and least would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def log_share(x: Column, most: float) -> Column:
    """ln(1 + x) over ln(1 + most), at most 1."""
    return F.least(F.lit(1.0), F.log1p(x) / F.log1p(F.lit(most)))


def time_decay(older: Column, as_of: Column, half_life: float = 5.0, least: float = 0.3) -> Column:
    """Halves every half_life years of 365.25 days, never below least; unknown or future dates do not decay."""
    years = F.datediff(as_of, older) / F.lit(365.25)
    return F.when(older.isNull() | (years <= 0), 1.0).otherwise(F.greatest(F.lit(least), F.pow(F.lit(2.0), -years / half_life)))


def fused_weight(cite: Column, cocite: Column, couple: Column, semantic: Column, cross: Column, decay: Column, alpha: float = 0.5) -> Column:
    graph = 0.3 * log_share(cite, 20) + 0.4 * log_share(cocite, 50) + 0.3 * log_share(couple, 30)
    return F.least(F.lit(1.0), (alpha * graph + (1 - alpha) * clip(semantic)) * F.when(cross, 2.0).otherwise(1.0) * decay)


def lifecycle(published: Column, as_of: Column) -> Column:
    months = F.datediff(as_of, published) / F.lit(MONTH_DAYS)
    return F.when(published.isNull(), "growing").when(months < 6, "fresh").when(months < 36, "growing").otherwise("mature")


def harmonic_score(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted harmonic mean of shifted signals plus penalties; null signals and zero weights do not count."""
    up = [(F.when(s.isNotNull(), F.lit(weights[k])).otherwise(0.0), F.coalesce(weights[k] / (clip(s) + 0.5), F.lit(0.0))) for k, s in signals.items() if weights.get(k, 0) > 0]
    down = [F.coalesce(weights[k] * clip(s), F.lit(0.0)) for k, s in signals.items() if weights.get(k, 0) < 0]
    total, parts, penalty = sum((w for w, _ in up), F.lit(0.0)), sum((p for _, p in up), F.lit(0.0)), sum(down, F.lit(0.0))
    return F.when(parts > 0, clip(total / parts - 0.5 + penalty)).otherwise(clip(0.5 + penalty))


def keystone(signals: dict[str, Column], stage: Column) -> Column:
    out = harmonic_score(signals, KEYSTONE_WEIGHTS["growing"])
    for name in ("fresh", "mature"):
        out = F.when(stage == name, harmonic_score(signals, KEYSTONE_WEIGHTS[name])).otherwise(out)
    return out


def to_grade(x: Column) -> Column:
    """1 to 5 from [0, 1]."""
    return F.least(F.lit(5), (F.floor(x * 5) + 1)).cast("int")


def doi(raw: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(raw)), r"^(https?://)?(dx\.)?(doi\.org/|doi:)", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"\s+", "")
    return F.nullif(F.regexp_replace(s, r"[.,;)\]]+$", ""), F.lit(""))


def arxiv(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(raw), r"(?i)^(https?://)?(www\.)?(arxiv\.org/(abs|pdf)/|arxiv:)", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(s, r"(?i)\.pdf$", ""), r"v[0-9]+$", ""), F.lit(""))


def external_id(raw: Column) -> Column:
    """Struct of provider and normalised id; the first form that fits counts."""
    d, a = doi(raw), arxiv(raw)
    work = F.upper(F.element_at(F.split(F.trim(raw), "/"), -1))

    def made(p: str, v: Column) -> Column:
        return F.struct(F.lit(p).alias("provider"), v.alias("norm"))

    return (
        F.when(d.rlike(r"^10\.48550/arxiv\."), made("arxiv", F.regexp_replace(d, r"^10\.48550/arxiv\.", "")))
        .when(d.rlike(r"^10\.[0-9]{4,9}/"), made("doi", d))
        .when(work.rlike(r"^W[0-9]+$"), made("work", work))
        .when(a.rlike(r"^[0-9]{4}\.[0-9]{4,5}$"), made("arxiv", a))
        .otherwise(made("unknown", F.lit(None).cast("string")))
    )


def arxiv_year(ident: Column) -> Column:
    yy = F.regexp_extract(ident, r"^([0-9]{2})[0-9]{2}\.", 1)
    return F.when(yy != "", F.when(yy.try_cast("int") <= 90, yy.try_cast("int") + 2000).otherwise(yy.try_cast("int") + 1900))


def evidence_tier(paths: Column, confidence: Column, section: Column, decision: Column, main_path: Column, calibrated: Column, weak: Column) -> Column:
    return (
        F.when(~calibrated, F.when(paths >= 2, "exploratory_uncalibrated_candidate").otherwise("insufficient"))
        .when((paths >= 3) & (confidence >= 0.70) & section & decision & main_path, "triangulated_strong")
        .when((paths >= 3) & (confidence >= 0.60), "triangulated_limited")
        .when((paths >= 2) & weak, "exploratory_weak_limitation")
        .when(paths >= 2, "exploratory")
        .otherwise("insufficient")
    )


def claim_scope(tier: Column) -> Column:
    return (
        F.when(tier == "exploratory_uncalibrated_candidate", "candidate_pool_only")
        .when(tier == "triangulated_strong", "candidate_direction")
        .when(tier == "triangulated_limited", "candidate_direction_with_uncertainty")
        .when(tier.startswith("exploratory"), "exploratory_hypothesis")
        .otherwise("not_for_user_claim")
    )


def calibrated(score: Column, coef: float, intercept: float, base: float, support: int) -> Column:
    """Platt scaling, shrunk to the base rate where support is small."""
    p = 1 / (1 + F.exp(-clip(coef * score + intercept, -30.0, 30.0)))
    return clip(base + (p - base) * min(1.0, support / 800.0), 0.01, 0.995)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def reliable(score: Column, coverage: Column, critical: Column) -> Column:
    """The score drawn to one half where its signals are thin."""
    return clip(0.5 + (score - 0.5) * clip(0.45 * coverage + 0.55 * critical, 0.2, 1.0))


def weighted_mean(signals: dict[str, Column], weights: dict[str, float], default: float = 0.5) -> Column:
    """Over the signals that are there; default without any."""
    total = sum((F.when(s.isNotNull(), weights[k]).otherwise(0.0) for k, s in signals.items()), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(s * weights[k], F.lit(0.0)) for k, s in signals.items()), F.lit(0.0)) / total).otherwise(default)


def geometric_score(signals: dict[str, Column], weights: dict[str, float], support: Column, shift: float = 0.05) -> Column:
    logs = sum((weights[k] * F.log(clip(s) + shift) for k, s in signals.items()), F.lit(0.0))
    return (F.exp(logs) - shift) * (0.85 + 0.15 * support)


def ramp(x: Column, low: float, at_low: float, high: float, at_high: float) -> Column:
    """at_low up to low, at_high from high on, a straight line between."""
    return F.when(x <= low, at_low).when(x >= high, at_high).otherwise(at_low + (x - low) / (high - low) * (at_high - at_low))


def order_of(older: Column, newer: Column) -> Column:
    """How the dates of a citation stand to each other."""
    return F.when(older.isNull() | newer.isNull(), "unknown_time").when(older < newer, "forward").when(older > newer, "time_inverted").otherwise("same_time")


def first_gap(checks: dict[str, Column], done: str) -> Column:
    """The name of the first check that does not hold, in the order given."""
    out = F.lit(done)
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def gaps(checks: dict[str, Column]) -> Column:
    """The names of all checks that do not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def uncertainty(abstract: Column, field: Column, embedded: Column, enriched: Column, refs: Column, linked: Column) -> Column:
    """Penalties for what a paper lacks, at most 1."""
    def lacks(ok: Column, cost: float) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), 0.0).otherwise(cost)

    filled = [F.length(F.coalesce(x, F.lit(""))) > 0 for x in (abstract, field)]
    links = F.when(refs == 0, 0.15).when(linked / F.greatest(refs, F.lit(1)) < 0.2, 0.10).otherwise(0.0)
    return clip(lacks(filled[0], 0.2) + lacks(filled[1], 0.2) + lacks(embedded, 0.2) + lacks(enriched, 0.15) + links)


def refreshed(last_seen: Column, recent: Column, legacy: Column, decay: Column, as_of: Column, months: int = 18, expired: float = 0.5) -> Column:
    """(last_seen, legacy, decay): recent evidence renews an entry; `months` of 30.4 days without any make it legacy."""
    old = F.datediff(as_of, last_seen) / 30.4 >= months
    return F.struct(
        F.when(recent > 0, as_of).otherwise(last_seen).alias("last_seen"),
        F.when(recent > 0, False).when(old, True).otherwise(legacy).alias("legacy"),
        F.when(recent > 0, 1.0).when(old, expired).otherwise(decay).alias("decay"),
    )


def spread(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """x from [low, high] to [to_low, to_high]; the middle where the range is empty."""
    return F.when(high > low, to_low + (x - low) / (high - low) * (to_high - to_low)).otherwise((to_low + to_high) / 2)
