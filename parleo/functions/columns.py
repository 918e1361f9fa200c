"""Small column helpers used by every operator."""
from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(c: Column, digits: int) -> Column:
    """Round half up through floor, so that other engines give the same double."""
    k = 10 ** digits
    return F.floor(c * F.lit(float(k)) + F.lit(0.5)) / F.lit(float(k))


def norm(c: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\p{P}\p{S}\s]+", " "))


def words(c: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    t = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    return F.array_remove(F.split(t, " "), "")  # only blank text gives an empty piece; t is computed once


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-word phrases of a token array."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def lookup(c: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Constant map as a CASE ladder; for a handful of keys only."""
    e = None
    for k, v in table.items():
        e = F.when(c == k, F.lit(v)) if e is None else e.when(c == k, F.lit(v))
    return e.otherwise(F.lit(default)) if default is not None else e


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also where body loops over it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_once(df: DataFrame, ids: Sequence[str], items: Column, name: str, pos: str | None = None) -> DataFrame:
    """Explode a costly array without evaluating it again.

    The plain generator makes the optimiser put ``size(items) > 0`` in front of
    it, which computes the array a second and third time; the outer one does not.
    """
    if pos is None:
        out = df.select(*ids, F.explode_outer(items).alias(name))
    else:
        out = df.select(*ids, F.posexplode_outer(items).alias(pos, name))
    return out.where(F.col(name).isNotNull())


def constant(rows: Sequence[dict], ddl: str) -> Column:
    """Fixed array of structs as one foldable literal instead of hundreds of small expressions."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{ddl}>>")


def any_contains(c: Column, phrases: Sequence[str]) -> Column:
    """True when the text contains one of a short fixed list of phrases."""
    e = F.lit(False)
    for p in phrases:
        e = e | F.contains(c, F.lit(p))
    return e


def pick(c: Column, values: Sequence[str]) -> Column:
    """values[c] for a non-negative integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))


def mmss(seconds: Column) -> Column:
    """m:ss display of seconds."""
    s = F.floor(seconds).cast("bigint")
    return F.concat((F.floor(s / 60)).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
