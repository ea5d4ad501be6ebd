import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import columns as c
from stemma.operators import atoms, stats, vectors


def test_fixed_patterns_on_english(spark):
    rows = [("However, noise remains.", None, "new_constraint"), ("We propose a method.", None, "attempted_path"), ("Thermal loss occurs.", None, "failure_mechanism"), ("Nothing here.", "Future Work", "new_constraint"), ("Nothing here.", "other", "constraint"), (None, None, "constraint"), ("It cost 3 units.", None, "cost_or_scaling_signal")]
    df = spark.createDataFrame(rows, "t string, s string, want string")
    assert all(r.want == r.got for r in df.select("want", atoms.stage_of(F.col("t"), F.col("s")).alias("got")).collect())


def test_sentences_limits_and_context(spark):
    text = "Short one. The severe loss of power in this device is a bottleneck! The severe loss of power in this device is a bottleneck! Yet all is well here and nothing else follows?"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " . ")], "k long, t string")
    parts = atoms.sentences(df, "k", "t")
    assert parts.filter("k = 1").count() == 4 and parts.filter("k in (2, 3)").count() == 0
    got = atoms.limitation_atoms(df, "k", "t").collect()
    assert [(r.k, r.place, r.keyword, r.severity) for r in got] == [(1, 1, "loss", "high")]
    near = {r.place: r.context for r in atoms.in_context(parts, "k", "bottleneck").collect()}
    assert near[1].startswith("Short one. The severe") and near[2].endswith("follows?")


def brute_chains(rows, most=3):
    out = []
    for key in sorted({k for k, _, _ in rows}):
        mine = sorted((p, s) for k, p, s in rows if k == key)
        starts = [(p, s) for p, s in mine if s in atoms.CHAIN[:2]][:most]
        for n, (p, s) in enumerate(starts, 1):
            chain, at = {s: p}, p
            for stage in atoms.CHAIN[atoms.CHAIN.index(s) + 1 :]:
                later = [q for q, t in mine if t == stage and q > at]
                if later:
                    chain[stage] = at = later[0]
            if len(chain) > 1:
                out.append((key, n, *[chain.get(x) for x in atoms.CHAIN]))
    return out


def test_chains_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), p, str(rng.choice([*atoms.CHAIN, "metric_result"]))) for k in range(12) for p in range(int(rng.integers(0, 14)))]
    df = spark.createDataFrame(rows, "k long, p long, s string")
    got = sorted([tuple(r) for r in atoms.chains(df, "k", "p", "s").collect()], key=lambda r: r[:2])
    assert got == brute_chains(rows)
    assert atoms.chains(df.limit(0), "k", "p", "s").count() == 0


def test_rules_and_hits(spark):
    df = spark.createDataFrame([("A Tutorial on heat",), (None,), ("overview",)], "t string")
    rules = {"tutorial": [r"\btutorial\b"], "survey": [r"\boverview\b"]}
    assert [r[0] for r in df.select(atoms.first_rule(F.col("t"), rules, "none")).collect()] == ["tutorial", "none", "survey"]
    hits = {"a": "x", "b": "y"}
    df = spark.createDataFrame([("xy",), ("yyx",), ("q",), (None,)], "t string")
    assert [r[0] for r in df.select(atoms.most_hits(F.col("t"), hits, "none")).collect()] == ["a", "b", "none", "none"]


def test_whitening_and_plane(spark):
    x = np.random.default_rng(1).normal(size=(60, 4)) @ np.array([[3, 1, 0, 0], [0, 2, 0, 0], [0, 0, 1, 0.5], [0, 0, 0, 0.3]])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>").repartition(5)
    n, mean, cov = vectors.moments(df, "v")
    assert n == 60 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    w = np.array([r.whitened for r in vectors.whitened(df, "id", "v").orderBy("id").collect()])
    assert np.allclose(np.cov(w.T), np.eye(4), atol=1e-8)
    xy = np.array([(r.x, r.y) for r in vectors.plane(df, "id", "v").orderBy("id").collect()])
    top = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(xy), np.abs((x - x.mean(0)) @ top[2][:2].T))
    few = np.array([r.whitened for r in vectors.whitened(df.filter("id < 3"), "id", "v").collect()])
    assert np.allclose(np.linalg.norm(few, axis=1), 1)
    assert vectors.plane(df.limit(0), "id", "v").count() == 0


def test_fuzzy_by_hand(spark):
    df = spark.createDataFrame([(1, "Heat flow"), (2, "other words"), (3, None)], "k long, t string")
    got = {r.k: r.score for r in vectors.fuzzy(df, "k", "t", "heat flow").collect()}
    assert got[1] == 1.0 and got[3] == 0.0 and got[2] <= 0.3


def test_calibrator_against_gradient(spark):
    rng = np.random.default_rng(5)
    s = rng.uniform(size=300)
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-4 * (s - 0.7)))).astype(int)
    fit = stats.fit_calibrator(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double"), "y", "s")
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    miss = w * (y - 1 / (1 + np.exp(-(fit["coef"] * s + fit["intercept"]))))
    assert miss.sum() == pytest.approx(0, abs=1e-6) and (miss * s).sum() == pytest.approx(fit["coef"] / 6, abs=1e-6)
    assert fit["support"] == 300 and fit["base"] == pytest.approx(y.mean())
    assert stats.fit_calibrator(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s")["coef"] is None


def test_refresh_and_uncertainty(spark):
    rows = [("1999-12-01", 0, True, 0.5), ("1997-01-01", 0, False, 1.0), ("1997-01-01", 2, True, 0.5)]
    df = spark.createDataFrame(rows, "seen string, n int, legacy boolean, decay double")
    got = df.select(c.refreshed(F.col("seen").cast("date"), F.col("n"), F.col("legacy"), F.col("decay"), F.lit("2000-01-01").cast("date")).alias("e")).collect()
    assert [(str(r.e.last_seen), r.e.legacy, r.e.decay) for r in got] == [("1999-12-01", True, 0.5), ("1997-01-01", True, 0.5), ("2000-01-01", False, 1.0)]
    no = F.lit(None).cast("boolean")
    worst = spark.range(1).select(c.uncertainty(F.lit(""), F.lit(None).cast("string"), no, no, F.lit(0), F.lit(0)).alias("u")).first().u
    assert math.isclose(worst, 0.9)
