"""Aggregates whose definitions differ from the built-in ones."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ensure_checkpoints

#: Values of a group that are sorted in one task.
GROUP = 100_000


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with _i, the 0-based rank of value in its group, and _n, the group's size; nulls go."""
    w = Window.partitionBy(*keys)
    return df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))


def large_groups(df: DataFrame, keys: list[str], value: str) -> DataFrame | None:
    """(keys, _n) of the groups with more than GROUP values, as many as one in GROUP rows; None without any."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > GROUP)
    return None if n.isEmpty() else n


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def values_at(df: DataFrame, keys: list[str], value: str, large: DataFrame, index: dict[str, Column]) -> DataFrame:
    """(keys, _n, one value for each index, with _below and _upto counts) of large groups: the value at each 0-based index of the sorted group.

    Approximate percentiles bracket each index, so that only values within the bracket are counted one by one; no group is sorted in one task.
    """
    rows = df.alias("r").join(F.broadcast(large).alias("l"), same_keys("r", "l", keys), "inner").select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"r.{value}").alias("_v"), "l._n").filter("_v is not null")
    out = large
    for name, at in index.items():
        q = at / F.greatest(F.col("_n") - 1, F.lit(1))
        marks = [i / 64 for i in range(65)]
        grid = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), F.percentile_approx("_v", marks, 10_000).alias("_g")).withColumn("_q", F.floor(q * 64).cast("int"))
        grid = grid.select(*keys, "_n", at.alias("_at"), F.get("_g", F.greatest(F.col("_q") - 1, F.lit(0))).alias("_lo"), F.get("_g", F.least(F.col("_q") + 2, F.lit(64))).alias("_hi"))
        met = rows.alias("r").join(F.broadcast(grid).alias("g"), same_keys("r", "g", keys)).select(*[F.col(f"r.{k}").alias(k) for k in keys], "_v", "_at", "_lo", "_hi")
        below = met.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.first("_at").alias("_at"))
        inside = met.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
        w = Window.partitionBy(*keys).orderBy("_v")  # different values within the bracket
        reached = inside.withColumn("_upto", F.sum("_c").over(w)).alias("i").join(F.broadcast(below).alias("b"), same_keys("i", "b", keys))
        hit = reached.filter(F.col("_upto") + F.col("_below") > F.col("_at")).groupBy(*[F.col(f"i.{k}").alias(k) for k in keys]).agg(F.min(F.struct("_v", (F.col("_upto") + F.col("_below")).alias("upto"), (F.col("_upto") + F.col("_below") - F.col("_c")).alias("below"))).alias(name))
        out = out.alias("o").join(hit.alias("h"), same_keys("o", "h", keys), "left").select("o.*", f"h.{name}")
    return out


def _by_size(df: DataFrame, keys: list[str], value: str, window, bracket) -> DataFrame:
    """Groups of up to GROUP values by a window, others by brackets."""
    large = large_groups(df, keys, value)
    if large is None:
        return window(df)
    small = df.alias("d").join(F.broadcast(large).alias("l"), same_keys("d", "l", keys), "left_anti").select("d.*")
    return window(small).unionByName(bracket(large))


def truncated_percentile(df: DataFrame, keys: list[str], value: str, q: float, least: float | None = None) -> DataFrame:
    """The value at index int(q * (n - 1)) of the sorted group, at least `least`."""
    out = _at_index(df, keys, value, lambda n: F.floor(F.lit(q) * (n - 1)))
    return out.withColumn("p", F.greatest("p", F.lit(least))) if least is not None else out


def nearest_percentile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at index round((n - 1) * q), halves to even."""
    return _at_index(df, keys, value, lambda n: F.bround(F.lit(q) * (n - 1)))


def _at_index(df: DataFrame, keys: list[str], value: str, index) -> DataFrame:
    def window(rows: DataFrame) -> DataFrame:
        return ranked(rows, keys, value).filter(F.col("_i") == index(F.col("_n"))).select(*keys, F.col(value).alias("p"))

    def bracket(large: DataFrame) -> DataFrame:
        return values_at(df, keys, value, large, {"x": index(F.col("_n"))}).select(*keys, F.col("x._v").alias("p"))

    return _by_size(df, keys, value, window, bracket)


def trimmed_mean(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The mean without floor(n * share) values at either end; share is at most 0.49."""
    k = F.floor(F.col("_n") * F.lit(min(share, 0.49)))

    def window(rows: DataFrame) -> DataFrame:
        return ranked(rows, keys, value).filter((F.col("_i") >= k) & (F.col("_i") < F.col("_n") - k)).groupBy(*keys).agg(F.avg(value).alias("mean"))

    def bracket(large: DataFrame) -> DataFrame:
        ends = values_at(df, keys, value, large, {"a": k, "b": F.col("_n") - k - 1})
        rows = df.alias("r").join(F.broadcast(ends).alias("e"), same_keys("r", "e", keys)).filter((F.col(f"r.{value}") > F.col("e.a._v")) & (F.col(f"r.{value}") < F.col("e.b._v")))
        mid = rows.groupBy(*[F.col(f"r.{x}").alias(x) for x in keys]).agg(F.sum(F.col(f"r.{value}")).alias("_s"))
        got = ends.alias("e").join(F.broadcast(mid).alias("m"), same_keys("e", "m", keys), "left").select("e.*", "m._s")
        edges = F.col("a._v") * (F.col("a.upto") - k) + F.col("b._v") * (F.col("_n") - k - F.col("b.below"))
        return got.select(*keys, F.when(F.col("a._v") == F.col("b._v"), F.col("a._v")).otherwise((F.coalesce("_s", F.lit(0.0)) + edges) / (F.col("_n") - 2 * k)).alias("mean"))

    return _by_size(df, keys, value, window, bracket)


def consistency(value: str) -> Column:
    """exp(-sigma / (|median| + 1e-6)); 1 for a single value."""
    return F.when(F.count(value) <= 1, 1.0).otherwise(F.exp(-F.stddev_pop(value) / (F.abs(F.percentile(value, 0.5)) + 1e-6)))


def entropy_share(df: DataFrame, key: str, category: str, kinds: int) -> DataFrame:
    """Shannon entropy of category within key over ln(kinds), at most 1."""
    counts = df.groupBy(key, category).count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(key))
    return counts.withColumn("_p", p).groupBy(key).agg(F.least(F.lit(1.0), -F.sum(F.col("_p") * F.log("_p")) / F.log(F.lit(float(kinds)))).alias("breadth"))


def brier(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def average_precision(df: DataFrame, y: str, score: str, tie: str, cells: int = 256) -> DataFrame:
    """Mean precision at the positives, by falling score. Ranks come from counts of ranges of the score, so no task sorts all."""
    cell = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), F.col(score))) * cells)
    rows = df.select(F.col(y).alias("y"), F.col(score).alias("s"), F.col(tie).alias("t"), cell.alias("c"))
    sums = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    above = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    sums = sums.select("c", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(above), F.lit(0)).alias("k0"))
    w = Window.partitionBy("c").orderBy(F.desc("s"), "t").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("i", F.count("*").over(w)).withColumn("k", F.sum("y").over(w)).join(F.broadcast(sums), "c")
    return at.filter("y = 1").agg(F.avg((F.col("k") + F.col("k0")) / (F.col("i") + F.col("n0"))).alias("average_precision"))


def auc_by(df: DataFrame, key: str, y: str, score: str) -> DataFrame:
    """Area under the ROC curve in each group, by rank sums with ties averaged."""
    w = Window.partitionBy(key).orderBy(score)
    low = F.rank().over(w)
    same = F.count("*").over(Window.partitionBy(key, score))
    r = df.withColumn("_r", low + (same - 1) / 2.0)
    g = r.groupBy(key).agg(F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("rs"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("q"))
    return g.filter("p > 0 and q > 0").select(key, ((F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def value_at(df: DataFrame, value: str, index: int) -> float:
    """The value at a 0-based index of the whole column sorted, nulls apart.

    An approximate quantile brackets it, so that only the values within the bracket meet in one task, counted by value.
    """
    v = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    n = v.count()
    q, slack = index / max(n - 1, 1), max(2e-5, 2 / n)
    low, high = v.agg(F.percentile_approx("v", [max(0.0, q - slack), min(1.0, q + slack)], 100_000).alias("b")).first().b
    below = v.filter(F.col("v") < low).count()
    inside = v.filter(F.col("v").between(low, high)).groupBy("v").count()
    reached = inside.withColumn("upto", F.sum("count").over(Window.orderBy("v"))).filter(F.col("upto") + below > index)
    return reached.agg(F.min("v").alias("v")).first().v


def order_statistic(df: DataFrame, value: str, q: float, least: float | None = None) -> float | None:
    """The value at index int(q * (n - 1)) of the whole column sorted, at least `least`; None without values."""
    n = df.filter(F.col(value).isNotNull()).count()
    if not n:
        return None
    found = value_at(df, value, math.floor(q * (n - 1)))
    return found if least is None else max(found, least)


def less_peers(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the value less the mean of the other rows of its group; alone, the value itself."""
    w = Window.partitionBy(*keys)
    others = F.count(value).over(w) - 1
    return df.withColumn(out, F.when(others > 0, F.col(value) - (F.sum(value).over(w) - F.col(value)) / others).otherwise(F.col(value)))


def share_at_most(df: DataFrame, keys: list[str], value: str, alone: Column, out: str) -> DataFrame:
    """df with the share of the other rows of its group whose value is at most its own."""
    upto = F.count(value).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)) - 1
    others = F.count(value).over(Window.partitionBy(*keys)) - 1
    return df.withColumn(out, F.when(others > 0, upto / others).otherwise(alone))


def standard_score(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the z-score of the value over all rows, population sigma."""
    m = df.agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sigma"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, (F.col(value) - F.col("_mu")) / (F.col("_sigma") + 1e-9)).drop("_mu", "_sigma")


def bradley_terry(games: DataFrame, prior: float = 0.1, rounds: int = 50, tolerance: float = 1e-6, small: int = 200_000) -> DataFrame:
    """(item, strength) from games (winner, loser): minorise-maximise with `prior` wins each way against a player of strength 1.

    Games are counted by pair once. Up to `small` pairs are fitted on the driver; with more, each round joins the pairs with the strengths twice and is
    checkpointed. Strengths stay positive, also of items that always or never win.
    """
    ensure_checkpoints(games.sparkSession)
    played = games.filter("winner <> loser")
    both = played.select(F.col("winner").alias("item"), F.col("loser").alias("other"), F.lit(1).alias("won")).union(played.select("loser", "winner", F.lit(0)))
    pairs = both.groupBy("item", "other").agg(F.count("*").alias("n"), F.sum("won").alias("won")).checkpoint()
    if pairs.count() <= small:
        return _fitted_here(pairs, prior, rounds, tolerance)
    wins = pairs.groupBy("item").agg(F.sum("won").alias("won"))
    strength = wins.select("item", F.lit(1.0).alias("strength"))
    for _ in range(rounds):
        met = pairs.join(strength, "item").join(strength.select(F.col("item").alias("other"), F.col("strength").alias("theirs")), "other")
        load = met.groupBy("item", "strength").agg(F.sum(F.col("n") / (F.col("strength") + F.col("theirs"))).alias("load"))
        new = load.join(wins, "item").select("item", ((F.col("won") + prior) / (F.col("load") + 2 * prior / (F.col("strength") + 1))).alias("new"), "strength").checkpoint()
        moved = new.agg(F.max(F.abs(F.log("new") - F.log("strength"))).alias("m")).first().m
        strength = new.select("item", F.col("new").alias("strength"))
        if moved is None or moved < tolerance:
            break
    return strength


def _fitted_here(pairs: DataFrame, prior: float, rounds: int, tolerance: float) -> DataFrame:
    """The same fit of a bounded number of pairs (item, other, n, won)."""
    import numpy as np

    rows = pairs.toPandas().sort_values(["item", "other"])
    names, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
    other = np.searchsorted(names, rows["other"].to_numpy())
    n, won = rows["n"].to_numpy(float), np.bincount(item, rows["won"].to_numpy(float), len(names))
    s = np.ones(len(names))
    for _ in range(rounds if len(names) else 0):
        new = (won + prior) / (np.bincount(item, n / (s[item] + s[other]), len(names)) + 2 * prior / (s + 1))
        moved = np.abs(np.log(new) - np.log(s)).max()
        s = new
        if moved < tolerance:
            break
    return pairs.sparkSession.createDataFrame([(x, float(v)) for x, v in zip(names.tolist(), s)], f"item {pairs.schema['item'].dataType.simpleString()}, strength double")


def fit_calibrator(df: DataFrame, y: str, score: str, strength: float = 6.0, rounds: int = 25, tolerance: float = 1e-9) -> dict:
    """Logistic regression of y (0 or 1) on one score, classes weighing alike, the slope penalised by 1 / (2 strength).

    Newton steps, each one aggregation of five sums. Without both classes: slope None. support and base are the rows and the share of ones.
    """
    ensure_checkpoints(df.sparkSession)
    rows = df.filter(F.col(y).isin(0, 1) & F.col(score).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("s")).checkpoint()
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return {"coef": None, "intercept": None, "support": n, "base": ones / n if n else 0.5}
    weight = F.when(F.col("y") == 1, F.lit(n / (2 * ones))).otherwise(F.lit(n / (2 * (n - ones))))
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("s") * a + b)))
        miss, curve = weight * (F.col("y") - p), weight * p * (1 - p)
        ga, gb, haa, hab, hbb = rows.agg(F.sum(miss * F.col("s")), F.sum(miss), F.sum(curve * F.col("s") ** 2), F.sum(curve * F.col("s")), F.sum(curve)).first()
        ga, haa = ga - a / strength, haa + 1 / strength
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tolerance:
            break
    return {"coef": a, "intercept": b, "support": n, "base": ones / n}
