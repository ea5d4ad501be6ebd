"""Entity resolution, evidence gates and merged result lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Tokens of a set that are taken in threes, or else in twos, at most.
WIDE = {3: 16, 2: 32}
#: Sets that one task gets for a token, unless that is less than one in 2,048 of all.
MANY = 1 << 18


def numbered(words: DataFrame) -> DataFrame:
    """(t, number) of words (t, n): the rarer by n the lower, and below zero where n is 1; int if that will do."""
    place = F.monotonically_increasing_id()
    out = staged(words.filter("t is not null").orderBy("n", "t").select("t", F.when(F.col("n") > 1, place).otherwise(-1 - place).alias("number")))
    low, high = out.agg(F.min("number"), F.max("number")).first()
    small = low is None or (low >= -(1 << 31) and high < 1 << 31)
    return out.withColumn("number", F.col("number").cast("int")) if small else out


def distinct_sets(df: DataFrame, key: str, tokens: Column, fewest: int) -> DataFrame:
    """(s, id), computed once: the sets of at least `fewest` tokens, sorted, with their least keys; null is no token."""
    each = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("s"))
    return staged(each.filter(F.size("s") >= fewest).groupBy("s").agg(F.min("id").alias("id")).filter("id is not null"))


def similar_token_sets(df: DataFrame, key: str, tokens: Column, least: float, fewest: int = 1) -> DataFrame:
    """(a, b, similarity): pairs of different token sets with this Jaccard similarity, a and b the least keys of their sets.

    Equal sets count as one; those that meet are compared in full.
    """
    sets = distinct_sets(df, key, tokens, fewest)
    each = sets.select("id", F.explode("s").alias("t"))
    words = numbered(each.groupBy("t").agg(F.count("*").alias("n")))
    return similar_sets(staged(each.join(words, "t").groupBy("id").agg(F.collect_list("number").alias("s"))), least, fewest, 0)


def similar_number_sets(df: DataFrame, key: str, numbers: Column, least: float, fewest: int = 1) -> DataFrame:
    """The same where tokens are numbers, the rarer the lower, as by numbered(): what is shuffled is smaller. Numbers below zero count as others do."""
    return similar_sets(distinct_sets(df, key, numbers, fewest), least, fewest)


def similar_sets(sets: DataFrame, least: float, fewest: int, first=None) -> DataFrame:
    met = meetings(sets, least, fewest, first)
    return met.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity")).filter(F.col("similarity") >= least)


def meetings(sets: DataFrame, least: float, fewest: int, first=None) -> DataFrame:
    """(a, b, na, nb, both): pairs of the sets (s, id), once each, among which all similar ones are; their sizes and common tokens.

    Sets of na and nb tokens are similar if they share m = ceil((na + nb) * least / (1 + least)); they meet by their
    q = min(3, m) first common tokens, or fewer where more than WIDE would be combined. A set of n tokens shares at least
    c = ceil(least * n) with a similar one, so these q are among the first n - max(c, q) + q of either. Sets travel once
    for each token that may be the first, and are combined and compared where they arrive, so no pair is shuffled; a token
    of more than MANY sets is dealt out by the second. Tokens below `first` have one set each.
    """
    sized = sets.select("id", F.array_sort("s").alias("s"), F.size("s").alias("n"))
    held = sized.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("k"))
    most, total = sized.agg(F.max("n"), F.sum("n")).first()
    often = [r.t for r in held.filter(F.col("k") > max(MANY, (total or 0) // 2048)).collect()]  # fewer than 2,048
    up_to = {q: max((n for n in range(1, (most or 0) + 1) if n - max(math.ceil(n * least - 1e-9), q) + q <= WIDE[q]), default=0) for q in WIDE}

    def wanted(n: Column, other: Column) -> Column:
        """Tokens by which sets of these sizes meet."""
        larger = F.greatest(n, other)
        cap = F.when(larger <= up_to[3], 3).when(larger <= up_to[2], 2).otherwise(1)
        return F.least(cap, F.greatest(F.lit(1), F.ceil((n + other) * (least / (1 + least)) - 1e-9)).cast("int"))

    def reach(q: int) -> Column:
        """Of how many first tokens a set takes q for its keys; 0 if none of its partners meets it by q."""
        n = F.size("s")
        own = F.ceil(n * least - 1e-9).cast("int")
        low, high = F.greatest(F.lit(fewest), own, F.lit(1)), F.least(F.lit(most or 0), F.floor(n / least + 1e-9).cast("int")) if least > 0 else F.lit(most or 0)
        some = {1: (wanted(n, low) == 1) | (wanted(n, high) == 1), 2: (n <= up_to[2]) & ((wanted(n, low) <= 2) | (high > up_to[3])), 3: wanted(n, F.least(high, F.greatest(n, F.lit(up_to[3])))) == 3}
        return F.when(some[q], n - F.greatest(F.lit(q), own) + q).otherwise(0)

    lone = F.lit(0) if first is None else F.size(F.filter("s", lambda x: x < first))
    none = F.lit(None).cast(sized.schema["s"].dataType.elementType)
    reaches = [reach(q).alias(f"r{q}") for q in (1, 2, 3)]

    def place(t: str) -> Column:
        return F.array_position("s", F.col(t)).cast("int")

    def part(after: Column, to: Column) -> Column:
        return F.slice("s", after + 1, F.greatest(F.lit(0), to - after))

    end = F.greatest(*[reach(q) - q + 1 for q in (1, 2, 3)])
    sent = sized.select("id", "s", F.explode(part(lone, end)).alias("t1"))
    hot, by = F.col("t1").isin(often), ["t1"]
    if often:
        seconds = F.concat(F.array(none), part(place("t1"), F.greatest("r2", "r3")))
        sent = sent.select("*", *reaches).select("id", "s", "t1", F.explode(F.when(hot, seconds).otherwise(F.array(none))).alias("g"))
        by = ["t1", "g"]
    came = sent.repartition(*by).select("*", *reaches, place("t1").alias("i"))
    seconds = F.concat(F.when(F.col("i") <= F.col("r1"), F.array(none)).otherwise(F.array().cast(sized.schema["s"].dataType)), part(F.col("i"), F.greatest("r2", "r3")))
    second = came.select("id", "s", *by, "r2", "r3", F.explode(F.when(hot, F.filter(seconds, lambda x: x.eqNullSafe(F.col("g")))).otherwise(seconds) if often else seconds).alias("t2"))
    second = second.withColumn("j", F.coalesce(place("t2"), F.lit(0)))
    thirds = F.concat(F.when(F.col("j") <= F.col("r2"), F.array(none)).otherwise(F.array().cast(sized.schema["s"].dataType)), part(F.col("j"), F.col("r3")))
    keyed = second.select("id", "s", *by, "t2", F.explode(F.when(F.col("j") == 0, F.array(none)).otherwise(thirds)).alias("t3"))
    keyed = keyed.withColumn("h", F.xxhash64("t2", "t3"))  # sorts by one number
    earlier = F.collect_list(F.struct("id", "s")).over(Window.partitionBy("h", *by, "t2", "t3").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    met = keyed.withColumn("met", earlier).filter(F.size("met") > 0).select("t1", "t2", "t3", "id", "s", F.explode("met").alias("x"))
    q = F.when(F.col("t2").isNull(), 1).when(F.col("t3").isNull(), 2).otherwise(3)
    na, nb = F.size("x.s"), F.size("s")
    fit = met.filter((F.col("x.id") < F.col("id")) & (F.least(na, nb) >= F.greatest(na, nb) * least - 1e-9) & (wanted(na, nb) == q))
    pairs = fit.select("t1", "t2", "t3", F.col("x.id").alias("a"), F.col("id").alias("b"), na.alias("na"), nb.alias("nb"), F.explode(F.array(F.array_intersect("x.s", "s"))).alias("both"))
    here = [F.col(t).isNull() | (F.get("both", F.lit(k)) == F.col(t)) for k, t in enumerate(("t1", "t2", "t3"))]  # each pair at one of its keys
    return pairs.filter(here[0] & here[1] & here[2]).select("a", "b", "na", "nb", F.size("both").alias("both"))


def gatekeep(claims: DataFrame, key: str, cited: str, pool: DataFrame, pool_key: str) -> DataFrame:
    """(key, n_cited, n_known, verdict): accepted if it cites something and the pool holds all of it."""
    each = claims.select(key, F.explode_outer(cited).alias("_c"))
    known = pool.select(F.col(pool_key).alias("_c"), F.lit(1).alias("_k")).distinct()
    n = each.join(known, "_c", "left").groupBy(key).agg(F.count("_c").alias("n_cited"), F.count("_k").alias("n_known"))
    return n.withColumn("verdict", F.when((F.col("n_cited") > 0) & (F.col("n_cited") == F.col("n_known")), "accepted").otherwise("rejected"))


def repair_priority(df: DataFrame, key: str, weight: str, outcome: str, when: Column, penalties: dict[str, int]) -> DataFrame:
    """(key, n, priority) of what is missing, by those who ask for it: the heaviest, how many, how heavy, less a penalty by the outcome of the last attempt."""
    lost = F.lit(0)
    for name, cost in penalties.items():
        lost = F.when(F.col("_last") == name, cost).otherwise(lost)
    grouped = df.groupBy(key).agg(F.count("*").alias("n"), F.max(weight).alias("_m"), F.sum(weight).alias("_s"), F.max_by(outcome, when).alias("_last"))
    raw = F.col("_m") + 18 * F.sqrt(F.col("n") - 1) + F.least(F.lit(80.0), 0.05 * F.col("_s")) - lost
    return grouped.select(key, "n", F.round(F.greatest(F.lit(0.0), raw), 4).alias("priority"))


def merged_hits(exact: DataFrame, fuzzy: DataFrame, key: str, n: int) -> DataFrame:
    """(key, mode, rank) of the first n: exact hits in their order, then those only the fuzzy list has; both lists have rank."""
    e, f = exact.select(key, F.col("rank").alias("_e")), fuzzy.select(key, F.col("rank").alias("_f"))
    both = e.join(f, key, "full").withColumn("mode", F.when(F.col("_f").isNull(), "exact").when(F.col("_e").isNull(), "fuzzy").otherwise("exact+fuzzy"))
    best = both.orderBy(F.col("_e").asc_nulls_last(), F.col("_f").asc_nulls_last(), key).limit(n)
    order = Window.orderBy(F.col("_e").asc_nulls_last(), F.col("_f").asc_nulls_last(), key)  # at most n rows
    return best.select(key, "mode", F.row_number().over(order).alias("rank"))


def swiss_pairs(df: DataFrame, group: str, player: str, score: str) -> DataFrame:
    """(group, game, a, b): neighbours by falling score meet; an odd last player has no opponent."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), player)) - 1
    seats = df.select(group, F.col(player).alias("_p"), place.alias("_i")).withColumn("game", F.floor(F.col("_i") / 2).cast("int"))
    return seats.groupBy(group, "game").agg(F.min_by("_p", "_i").alias("a"), F.max(F.when(F.col("_i") % 2 == 1, F.col("_p"))).alias("b"))


def swiss_rounds(players: int) -> int:
    return int(math.log2(players)) if players > 1 else 0
