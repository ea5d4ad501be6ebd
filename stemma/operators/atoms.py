"""Sentences of texts as typed atoms: stages, limitations, context, chains of stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that mark a sentence's type, in the order in which types win.
STAGE_PATTERNS = {
    "new_constraint": r"(?i)\b(however|nevertheless|still|remain(?:s|ing)?|future work|further work|open question|not fully|yet to)\b",
    "local_fix": r"(?i)\b(overcome|resolve(?:d|s)?|mitigat(?:e|ed|es|ing|ion)|address(?:ed|es|ing)?|improv(?:e|ed|es|ement)|enable(?:d|s)?|achiev(?:e|ed|es)|demonstrat(?:e|ed|es))\b",
    "constraint": r"(?i)\b(limit(?:ation)?s?|challenge[sd]?|bottleneck|constraint|trade[- ]?off|requires?|difficult|lack|insufficient|not yet)\b",
    "attempted_path": r"(?i)\b(we (?:use|used|propose|proposed|employ|employed)|approach|method|design|architecture|fabricat(?:e|ed|ion)|optimi[sz](?:e|ed|ation))\b",
    "failure_mechanism": r"(?i)\b(fail(?:ed|ure|s)?|loss|noise|instabil(?:ity|e)|defect|degrad(?:e|es|ation)|crosstalk|thermal|fabrication error|mismatch)\b",
    "metric_result": r"(?i)(\b\d+(?:\.\d+)?\s?(?:%|dB|GHz|MHz|THz|nm|um|K|mW|W|ns|ps|fs)\b|\bQ[- ]?factor\b|\befficien(?:cy|t)\b)",
    "validation_setup": r"(?i)\b(experiment(?:al)?|measurement|measured|simulation|simulated|benchmark|validation|setup|prototype|testbed)\b",
    "cost_or_scaling_signal": r"(?i)\b(cost|expensive|low[- ]?cost|scal(?:e|ing|able|ability)|yield|manufactur(?:e|ing)|throughput|mass production)\b",
}
# What a sentence without such words is, by its section.
SECTION_BIAS = {
    "limitations": "constraint", "limitation": "constraint", "error_analysis": "failure_mechanism", "ablation": "failure_mechanism", "method": "attempted_path", "methods": "attempted_path",
    "experiments": "validation_setup", "results": "metric_result", "future_work": "new_constraint", "conclusion": "new_constraint",
}
# Words of limitations, their subjects, and marks of severity.
LIMITATION = r"(?i)\b(limit(?:ation)?s?|challenge[sd]?|bottleneck|drawback|constraint|remain(?:s|ing)?|future work|open question|not yet|however|although|requires?|difficult|scalab(?:le|ility)|expensive|loss|noise|unstable)\b"
SUBJECT = r"(?i)\b(scalability|efficiency|loss|noise|stability|fabrication|power|bandwidth|resolution|temperature|integration|dispersion|coupling|nonlinearity|sensitivity)\b"
SEVERE = r"(?i)\b(severe|critical|fundamental|major|limited|requires?)\b"
#: The order of stages in a chain.
CHAIN = ("constraint", "failure_mechanism", "attempted_path", "local_fix", "new_constraint")
GAP = r"(?<=[.!?])[ \t\n\f\r]+"


def section_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, sentence): place counts from 0; null and empty texts have none."""
    cut = F.filter(F.transform(F.split(text, GAP), lambda s: F.regexp_replace(s, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")), lambda s: s != "")
    return df.select(key, F.posexplode(cut).alias("place", "sentence"))


def stage_of(text: Column, section: Column | None = None, patterns: dict[str, str] | None = None) -> Column:
    """The first type whose words the text has, else what its section suggests, else a constraint."""
    rules = [F.when(text.rlike(p), F.lit(name)) for name, p in (patterns or STAGE_PATTERNS).items()]
    bias = [] if section is None else [F.when(section_key(section) == k, F.lit(v)) for k, v in SECTION_BIAS.items()]
    return F.coalesce(*rules, *bias, F.lit("constraint"))


def limitation_atoms(df: DataFrame, key: str, text: str, words: str = LIMITATION, subject: str = SUBJECT, severe: str = SEVERE, shortest: int = 41, most: int = 5) -> DataFrame:
    """(key, place, description, keyword, severity): the first `most` sentences of each text that name a limitation, each subject and opening once."""
    found = sentences(df, key, text).filter((F.length("sentence") >= shortest) & F.col("sentence").rlike(words))
    named = found.select(key, "place", F.substring("sentence", 1, 500).alias("description"), F.coalesce(F.nullif(F.lower(F.regexp_extract("sentence", subject, 1)), F.lit("")), F.lit("technical limitation")).alias("keyword"), F.when(F.col("sentence").rlike(severe), "high").otherwise("medium").alias("severity"))
    once = Window.partitionBy(key, "keyword", F.lower(F.substring("description", 1, 80))).orderBy("place")
    first = named.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).filter(F.col("_n") <= most).drop("_n")


def in_context(parts: DataFrame, key: str, words: str, around: int = 1) -> DataFrame:
    """(key, place, context): sentences with these words, joined with `around` sentences on each side."""
    w = Window.partitionBy(key).orderBy("place")
    near = [F.lag("sentence", k).over(w) for k in range(around, 0, -1)] + [F.col("sentence")] + [F.lead("sentence", k).over(w) for k in range(1, around + 1)]
    return parts.withColumn("context", F.concat_ws(" ", *near)).filter(F.col("sentence").rlike(words)).select(key, "place", "context")


def chains(atoms: DataFrame, key: str, place: str, stage: str, most: int = 3) -> DataFrame:
    """(key, chain, one place for each stage or null): from each of the first `most` constraints or failures of a group, the next atom of each later stage in turn.

    A stage that does not follow is passed over. Chains of one atom go. What follows is read in falling order, so that a frame grows by one row at a time; places of a group must differ.
    """
    df = atoms.filter(F.col(stage).isin(*CHAIN)).select(key, F.col(place).alias("_p"), F.col(stage).alias("_s"))
    order = Window.partitionBy(key).orderBy("_p")
    later = Window.partitionBy(key).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_r", F.array().cast("array<struct<s:string,p:bigint>>"))
    for name in reversed(CHAIN[1:]):  # _r: the rest of a chain that goes on behind this row with stages from name on
        own = F.concat(F.array(F.struct(F.lit(name).alias("s"), F.col("_p").cast("long").alias("p"))), F.col("_r"))
        df = df.withColumn("_o", F.when(F.col("_s") == name, own)).withColumn("_f", F.last("_o", ignorenulls=True).over(later))
        df = df.withColumn("_before", F.col("_r")).withColumn("_r", F.coalesce("_f", "_r"))
        if name == "failure_mechanism":
            df = df.withColumn("_r", F.when(F.col("_s") == name, F.col("_before")).otherwise(F.col("_r")))
    starts = df.filter(F.col("_s").isin(*CHAIN[:2])).withColumn("chain", F.row_number().over(order)).filter(F.col("chain") <= most)
    whole = F.concat(F.array(F.struct(F.col("_s").alias("s"), F.col("_p").cast("long").alias("p"))), F.col("_r"))
    placed = starts.withColumn("_c", whole).filter(F.size("_c") > 1)

    def at(name: str) -> Column:
        return F.get(F.filter("_c", lambda x: x["s"] == name), F.lit(0))["p"].alias(name)

    return placed.select(key, "chain", *[at(name) for name in CHAIN])


def completeness(present: list[Column]) -> Column:
    """How much of a chain is there, from its five stages."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in present])
    return F.when(n == len(present), "complete").when(n >= 3, "partial").otherwise("fragment")


def first_rule(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first label one of whose patterns the lower-cased text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(name)) for name, ps in rules.items()], F.lit(default))


def most_hits(text: Column, rules: dict[str, str], default: str) -> Column:
    """The label whose pattern the text has most often, the first of equals; the default without any."""
    body = F.coalesce(text, F.lit(""))
    best = F.array_max(F.array(*[F.struct(F.regexp_count(body, F.lit(p)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, p) in enumerate(rules.items())]))
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))
