"""Language guess by script and stop words, and code normalisation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleo.functions.columns import let, lookup, norm

# Stop words per language, in order of precedence, and code variants.
STOP_WORDS = {"en": "the of and to that with", "de": "der die und ein ich zu", "fr": "le la que un et ou", "es": "el los del y una por"}
CODE_VARIANTS = {"zh-cn": "zh", "zh-tw": "zh", "pt-br": "pt", "pt-pt": "pt"}


def normalise_code(code: Column) -> Column:
    return F.coalesce(lookup(code, CODE_VARIANTS), code)


def guess_language(text: Column, fallback: str = "en") -> Column:
    """Devanagari decides first, then the language with most of its stop words, the fallback without any."""
    # every step once per row: the stop words met (distinct), their numbers per language, the best of them
    listed = {l: F.array(*[F.lit(w) for w in ws.split()]) for l, ws in STOP_WORDS.items()}
    met = F.array_intersect(F.split(norm(text), " "), F.array(*[F.lit(w) for ws in STOP_WORDS.values() for w in ws.split()]))
    best = let(met, lambda m: F.array_max(F.array(*[F.struct(F.size(F.array_intersect(m, ws)).alias("n"), F.lit(-i).alias("i"), F.lit(l).alias("l")) for i, (l, ws) in enumerate(listed.items())])))
    named = let(best, lambda b: F.when(b["n"] == 0, fallback).otherwise(normalise_code(b["l"])))
    return F.when(text.rlike("[ऀ-ॿ]"), "hi").otherwise(named)
