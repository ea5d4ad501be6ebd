"""Personal data by patterns, and by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. They are the seeds of a bipartite
graph of identifiers and the lexical contexts around them. Rounds of scoring go over it until nothing changes, at most
ROUNDS of them: a context is trusted by the share and number of known identifiers of a kind among what it surrounds,
where what is not known yet, but looks like an identifier, counts half against it; an identifier is trusted by the
contexts that surround it. A context is the two words before, or one word on either side, as far as
they lie within 64 characters before and 48 after; longer words have no context. Identifier-like tokens, and digits in groups, that trusted contexts reach are reported with the kind of their contexts
(groups of 6 to 19 digits, as cards and phones only; a token inside a reported group is not told apart). All of it is
DataFrame operations; a text is read once and no text is shuffled.

Patterns are written so that each position is tried once: a run of characters is taken whole or not at all, since
every later start within it would fail alike.

Edge cases: a null text is empty; spans are in code points, ends exclusive; a found span that overlaps a base span is
dropped; rows of one id are scanned each; long texts are scanned whole; an empty table gives an empty table; columns
of any name may stand beside, and are not read. A context or value with a large share of all edges is joined by
broadcast of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import join_hot
from .common import discard, stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Runs of fewer digits would be dropped, and no run that is kept begins inside one.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # What contexts may turn out to be identifiers: tokens of 6 characters or more that hold a digit or an at sign, up to
    # their last letter or digit, as a full stop may follow; and digits in groups.
    "token": r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+-]*+(?:[0-9]|@[._%+@-]*+[A-Za-z0-9]))(?=[A-Za-z0-9][A-Za-z0-9._%+@-]{4}[._%+@-]*+[A-Za-z0-9])[A-Za-z0-9]++(?:[._%+@-]++[A-Za-z0-9]++)*+",
    "group": r"(?<![A-Za-z0-9._%+@-])\(?[0-9]++(?:(?:\)\x20?|[\x20./-])\(?[0-9]++(?![._%+@-]*+[A-Za-z]))++",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "token": "[0-9@]", "group": r"[0-9](?:\)|[\x20./-]\(?[0-9])"}
#: Rounds of scoring, known identifiers that a context needs, trust that makes a context or an identifier count.
ROUNDS, SUPPORT, CONTEXT_TRUST, TRUST = 8, 4, 0.6, 0.8
#: What an instance that is not known yet counts against its context.
UNKNOWN = 0.5


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    places = F.transform(F.split(number, ""), lambda d, i: F.when((n - i) % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    d = digits(match)
    n = F.length(d)
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", F.when(n.between(13, 19), luhn(d)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "group", n.between(6, 19) & match.rlike(r"[\x20()/]"))  # others are tokens
        .otherwise(True)
    )


def matches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, hits) of every row, staged. hits: kind, i, gap before, match and its surroundings, by kind in order."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    found = rows.select("*", *[F.when(F.col("t").contains("@") if need == "@" else F.col("t").rlike(need), F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, need in _NEEDS.items()])
    found = found.select("row", "id", *[f"m_{k}" for k in PATTERNS], *[F.when(F.size(f"m_{k}") > 0, F.split("t", PATTERNS[k], -1)).otherwise(none).alias(f"p_{k}") for k in PATTERNS])

    def hits(k: str) -> Column:
        pieces = F.col(f"p_{k}")
        return F.transform(
            F.col(f"m_{k}"),
            lambda m, i: F.struct(
                F.lit(k).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), m.alias("match"),
                F.right(F.get(pieces, i), F.lit(64)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(48)).alias("after"),
            ),
        )

    return stage(found.select("row", "id", F.concat(*[hits(k) for k in PATTERNS]).alias("hits")), "pii-hits")


def located(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, before, after) of what passes its checks."""
    w = Window.partitionBy("row", "kind").orderBy("i")
    each = found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(w)).withColumn("start", F.col("end") - F.length("match"))
    return each.filter(valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end", "match", "before", "after")


def contexts(spans: DataFrame) -> DataFrame:
    """Edges (value, pattern): two words before, and one word on either side."""
    before, after = F.regexp_replace(F.lower("before"), "[0-9]", "0"), F.regexp_replace(F.lower("after"), "[0-9]", "0")
    last, two = F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    right = F.regexp_extract(after, r"^\s*(\S+)", 1)
    patterns = F.array(F.when(two != "", F.concat(F.lit("L|"), two)), F.when((last != "") & (right != ""), F.concat(F.lit("C|"), last, F.lit("|"), right)))
    return spans.select(F.lower("match").alias("value"), F.explode(F.array_compact(patterns)).alias("pattern")).distinct()


def bootstrap(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(value, kind, trust) of what contexts discover beyond the seeds (value, kind). edges (value, pattern) is a staged table."""
    first = stage(seeds.select("value", "kind").distinct(), "pii-seeds")
    held = stage(edges.groupBy("pattern").count(), "pii-patterns")
    uses = stage(edges.groupBy("value").count(), "pii-values")
    kinds = F.map_from_entries(F.collect_list(F.struct("kind", "trust")))  # at most one entry for each of KINDS
    found, was = None, None
    for _ in range(rounds):
        known = first.withColumn("trust", F.lit(1.0))
        known = known if found is None else known.unionByName(found)
        near = join_hot(edges, known.groupBy("value").agg(kinds.alias("kinds")), "value", counts=uses).select("pattern", F.explode("kinds").alias("kind", "trust"))
        near = near.groupBy("pattern", "kind").agg(F.sum("trust").alias("mass"), F.count("*").alias("n"))
        known_n = F.sum("n").over(Window.partitionBy("pattern"))  # a row for each of KINDS
        near = near.withColumn("all", known_n).filter(F.col("n") >= support).join(held, "pattern")
        against = F.col("all") + UNKNOWN * F.greatest(F.col("count") - F.col("all"), F.lit(0))
        trusted = near.withColumn("trust", F.col("mass") / against * (1 - 1 / (1 + F.col("n")))).filter(F.col("trust") >= CONTEXT_TRUST)
        reached = join_hot(edges, trusted.groupBy("pattern").agg(kinds.alias("kinds")), "pattern", counts=held).select("value", F.explode("kinds").alias("kind", "c"))
        scored = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("trust")).filter(F.col("trust") >= TRUST)
        best = scored.groupBy("value").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"), F.max("trust").alias("trust"))
        old, found = found, stage(best.join(first.select("value").distinct(), "value", "left_anti"), "pii-found")
        if old is not None:
            discard(old)
        now = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("value", "kind").cast("decimal(38,0)"))).first())
        if now == was or not now[0]:
            break
        was = now
    return found


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts and digest of base spans, all spans, and the number that contexts found."""
    found = matches(docs, key, text)
    spans = stage(located(found), "pii-spans")
    base = spans.filter(F.col("kind").isin(*KINDS))
    tokens = spans.filter(~F.col("kind").isin(*KINDS))
    b = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    tokens = stage(tokens.join(b, (F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti"), "pii-tokens")
    edges = stage(contexts(base.unionByName(tokens)), "pii-edges")
    new = bootstrap(edges, base.select(F.lower("match").alias("value"), "kind"))
    more = tokens.withColumnRenamed("kind", "form").withColumn("value", F.lower("match")).join(new.select("value", "kind"), "value")
    more = more.filter((F.col("form") == "token") | F.col("kind").isin("card", "phone"))
    g = more.filter("form = 'group'").select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    more = more.join(g, (F.col("form") == "token") & (F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    every = base.select("row", order.alias("k"), "start", "end", F.lit(True).alias("base")).union(more.select("row", order.alias("k"), "start", "end", F.lit(False)))
    grouped = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "start", "end", "base"))).alias("s"))
    rows = found.select("row", "id").join(grouped, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<k:int,start:bigint,end:bigint,base:boolean>>")))
    base_of = F.filter("s", lambda x: x["base"])

    def held(kind: int) -> Column:
        """Number of base spans of a kind; a default argument of the lambda would be taken as the place in the array."""
        return F.size(F.filter("s", lambda x: x["base"] & (x["k"] == kind))).cast("long")

    def written(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    return rows.select(
        F.col("id").alias(key),
        *[held(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)],
        F.sha2(written(base_of).cast("binary"), 256).alias("base_sha256"),
        written(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_contextual"),
    )
