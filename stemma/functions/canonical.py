"""Canonical JSON, token counts and shades of colours: what needs Python, a batch at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of fields.
PALETTE = {
    "Computer Science": "#1f77b4", "Engineering": "#5d8fc7", "Materials Science": "#9467bd", "Physics and Astronomy": "#17becf", "Chemistry": "#aec7e8", "Mathematics": "#c5b0d5", "Earth and Planetary Sciences": "#6b8e23", "Environmental Science": "#2ca02c",
    "Energy": "#bcbd22", "Chemical Engineering": "#8c564b", "Agricultural and Biological Sciences": "#f7b801", "Biochemistry, Genetics and Molecular Biology": "#90ee90", "Neuroscience": "#ffa07a", "Immunology and Microbiology": "#ff7f0e",
    "Pharmacology, Toxicology and Pharmaceutics": "#ffbb78", "Medicine": "#d62728", "Health Professions": "#ff9896", "Nursing": "#e377c2", "Dentistry": "#f7b6d2", "Veterinary": "#c49c94", "Social Sciences": "#ffa500", "Arts and Humanities": "#dda0dd",
    "Economics, Econometrics and Finance": "#dec2bf", "Business, Management and Accounting": "#cab2d6", "Psychology": "#fd8d3c", "Decision Sciences": "#bdbdbd",
}


def canonical_json(raw: Column) -> Column:
    """JSON with sorted keys, no spaces and floats of six digits; not a number and infinity become null, text that is no JSON stays null."""

    def run(values: pd.Series) -> pd.Series:
        import json
        import math

        def plain(x):
            if isinstance(x, float):
                return None if math.isnan(x) or math.isinf(x) else float(f"{x:.6g}")
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items()}
            return [plain(v) for v in x] if isinstance(x, list) else x

        def one(text):
            try:
                return None if text is None else json.dumps(plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return values.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(raw)


def canonical_hash(raw: Column) -> Column:
    return F.sha2(canonical_json(raw).cast("binary"), 256)


def token_count(text: Column, ranks: str, pattern: str) -> Column:
    """How many tokens a byte-pair vocabulary makes of a text; ranks is a file that executors can read, one token and its rank a line."""

    def run(values: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return values.fillna("").map(lambda t: len(enc.encode_ordinary(t))).astype("int64")

    return F.pandas_udf(run, "long")(text)


def verifier(tokens: Column, most: int = 480) -> Column:
    """Which of two verifiers takes a claim and its evidence, by their tokens together."""
    return F.when(tokens > most, "long_context").otherwise("short_context")


def shade(field: Column, place: Column, n: Column) -> Column:
    """Hex colour of a field, its brightness by the place (from 0) of a subfield among n; grey for other fields.

    Hue and saturation stay; the brightest channel becomes the brightness asked for, so channels scale alike.
    """
    base = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in PALETTE.items() for x in (F.lit(k), F.lit(v))]), field), F.lit("#7f7f7f"))
    rgb = [F.conv(F.substring(base, 2 + 2 * i, 2), 16, 10).cast("double") / 255.0 for i in range(3)]
    v = F.when(n > 1, 0.45 + 0.40 * place / (n - 1)).otherwise(0.65)
    top = F.greatest(*rgb)
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.floor(F.round(x / top * v * 255, 9)).cast("long")), 2, "0")) for x in rgb])
