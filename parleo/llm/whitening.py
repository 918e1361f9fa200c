"""Embedding whitening: covariances from exact squares of dimensions and of sums of two dimensions.

Every entry becomes a whole number, ``floor(256 c)``.  The fit list holds each
distinct vector once.  Its means are taken first; then every task sums, for
each dimension ``i`` and each pair ``i, j``, the squares of the centred values
``u_i`` and ``u_i + u_j``.  Since ``(a + b)^2 - a^2 - b^2 = 2ab``, differences
of those variances are the cross-covariances (polarisation).  Sums travel as
31-bit limbs, so they are exact at any size; values are centred by the whole
part of the mean, and the driver puts the remainder right in whole numbers.
What reaches the driver is quadratic in the dimensions, never in the rows.

Defined results: rows whose vector is null or holds a null or non-finite entry
are left out; a null id stays null; empty vectors have no component, hence no
row; entries beyond 64 bits count as the largest long.  Vectors of different
lengths have no common covariance: each length is fitted by itself.  Components
without variance are left out (one distinct vector: no row).  Repeated vectors
count once in the fit and are all returned.  ``deviation`` is null where it
exceeds 64 bits; ``deviation_exact`` holds it to 38 digits.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import shared_table

SCALE = 256
COMPONENTS = 4
LIMB = 31
#: Rows squared at a time: keeps the pair sums of one dimension in the cache.
BLOCK = 2048


@dataclass(frozen=True)
class Fit:
    """Whitening of the vectors of one length; ``mean = whole + rest / n``."""
    n: int
    whole: list[int]
    rest: list[int]
    axes: np.ndarray          # components x dimensions, unit rows
    values: np.ndarray        # eigenvalues, falling
    explained: np.ndarray
    identity_error: float = 0.0


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vector is whole and finite."""
    v = rows[vec_col].cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(v.isNotNull() & ~bad).select(rows[id_col].cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length among the vectors of a batch."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        part = column if len(at) == len(lengths) else column.take(pa.array(at))
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))


def _centred(x: np.ndarray, whole: list[int]) -> np.ndarray:
    """Exact differences; Python integers where 64 bits could overflow in later squares and sums."""
    ends = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, whole), default=0)
    if 4 * ends * ends * (len(x) + x.shape[1]) < 2 ** 62:
        return x - np.array(whole, dtype=np.int64)
    return x.astype(object) - np.array(whole, dtype=object)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Signed base-2^31 digits of a whole number."""
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield k, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        k += 1


def _summed(fit_list: DataFrame, sums) -> dict[tuple[int, int, int], int]:
    """Exact totals over all tasks; ``sums(x)`` gives (i, j, whole number) for a matrix of vectors."""
    schema = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("limb", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                for start in range(0, len(x), BLOCK):
                    for i, j, value in sums(x[start:start + BLOCK]):
                        key = (x.shape[1], i, j)
                        total[key] = total.get(key, 0) + value
        cells = [(*key, k, limb) for key, value in total.items() for k, limb in _limbs(value)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells) if cells else [[]] * 5, schema)], schema=schema)

    parts = fit_list.mapInArrow(task, "dims int, i int, j int, k int, limb bigint")
    out: dict[tuple[int, int, int], int] = {}
    for r in parts.groupBy("dims", "i", "j", "k").agg(F.sum("limb").alias("limb")).toLocalIterator():
        key = (r["dims"], r["i"], r["j"])
        out[key] = out.get(key, 0) + (r["limb"] << (LIMB * r["k"]))
    return out


def _pair_squares(means: dict[int, list[int]]):
    """Sums of squares of ``u_i`` (as i, i) and of ``u_i + u_j`` (i < j)."""
    def sums(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
        u = np.ascontiguousarray(_centred(x, means[x.shape[1]]).T)
        for i in range(len(u)):
            one = u[i]
            yield i, i, int((one * one).sum())
            if i + 1 < len(u):
                two = u[i + 1:] + one
                squares = np.einsum("ij,ij->i", two, two) if two.dtype == np.int64 else (two * two).sum(axis=1)
                for j, value in enumerate(squares.tolist(), i + 1):
                    yield i, j, int(value)
    return sums


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance from the sums of squares, in whole numbers up to the last division.

    ``squares`` are about the whole part of the mean; ``n^2 q - n r^2`` is the
    sum of ``(n x - S)^2``.
    """
    d = len(rest)
    own = [n * n * squares.get((i, i), 0) - n * rest[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = own[i] / n ** 3
        for j in range(i + 1, d):
            both = n * n * squares.get((i, j), 0) - n * (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) // 2 / n ** 3
    return out


def _components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of the largest eigenvalues, those without variance left out."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values[-1], 0.0) * len(v) * np.finfo(float).eps]
    return vectors[:, order].T, values[order], values[order] / np.trace(v) if len(order) else values[order]


def _project(x: np.ndarray, fit: Fit) -> np.ndarray:
    u = _centred(x, fit.whole).astype(float) - np.array([r / fit.n for r in fit.rest])
    return (u @ fit.axes.T) / np.sqrt(fit.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A whitening for each vector length among ``whole_vectors`` rows."""
    fit_list = shared_table(vectors.where(F.size("x") > 0).select("x").distinct())
    counts = {r["d"]: r["n"] for r in fit_list.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    totals = _summed(fit_list, lambda x: ((i, 0, int(s)) for i, s in enumerate(x.sum(axis=0) if np.abs(x.astype(float)).max(initial=0) < 2 ** 40 else x.astype(object).sum(axis=0))))
    means = {d: [totals.get((d, i, 0), 0) // n for i in range(d)] for d, n in counts.items()}
    rests = {d: [totals.get((d, i, 0), 0) - n * means[d][i] for i in range(d)] for d, n in counts.items()}
    squares = _summed(fit_list, _pair_squares(means))
    fits = {}
    for d, n in counts.items():
        v = covariance(n, rests[d], {(i, j): q for (dims, i, j), q in squares.items() if dims == d})
        axes, values, explained = _components(v, components)
        fits[d] = Fit(n, means[d], rests[d], axes, values, explained)
    return {d: Fit(f.n, f.whole, f.rest, f.axes, f.values, f.explained, e) for d, e in _identity_errors(fit_list, fits).items() for f in [fits[d]]}


def _identity_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the list."""
    most = max((len(f.values) for f in fits.values()), default=0)
    if not most:
        return {d: 0.0 for d in fits}
    schema = pa.schema([("dims", pa.int32()), *((f"w{k}", pa.float64()) for k in range(most))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                w = _project(x, fits[x.shape[1]])
                columns = [pa.array(w[:, k]) if k < w.shape[1] else pa.nulls(len(x), pa.float64()) for k in range(most)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), *columns], schema=schema)

    pairs = [(a, b) for a in range(most) for b in range(a, most)]
    got = (fit_list.mapInArrow(task, ", ".join(["dims int", *(f"w{k} double" for k in range(most))]))
           .groupBy("dims").agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).collect())
    return {r["dims"]: max((abs(r[f"c{a}_{b}"] - (a == b)) for a, b in pairs if r[f"c{a}_{b}"] is not None), default=0.0) for r in got}


OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()),
                 ("identity_error", pa.float64()), ("eigenvalue", pa.float64()), ("deviation_exact", pa.decimal128(38, 0))])
OUT_DDL = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, eigenvalue double, deviation_exact decimal(38,0)"


def _deviations(x: np.ndarray, f: Fit) -> list[int]:
    """Sum over dimensions of ``(n x - S)^2`` for each row: ``n u - r`` squared out, exact."""
    u = _centred(x, f.whole)
    wide = u.dtype == object or max((abs(int(u.max(initial=0))), abs(int(u.min(initial=0))))) * f.n * len(f.whole) >= 2 ** 62
    own, cross = (u * u).sum(axis=1).tolist(), (u.astype(object) @ np.array(f.rest, dtype=object) if wide else u @ np.array(f.rest, dtype=np.int64)).tolist()
    fixed = sum(r * r for r in f.rest)
    return [f.n * f.n * int(a) - 2 * f.n * int(b) + fixed for a, b in zip(own, cross)]


def transform(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """One row per vector and component; nothing is shuffled."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, x in _matrices(batch.column(1)):
                f = fits.get(x.shape[1])
                if f is None or not len(f.values):
                    continue
                k, w, dev = len(f.values), _project(x, f), _deviations(x, f)
                each = lambda values: np.tile(values, len(at))
                rows = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(at, k))), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(rows), f.n, np.int64)),
                    pa.array([v if v < 2 ** 63 else None for v in dev], pa.int64()).take(rows), pa.array(w.reshape(-1)), pa.array(each(f.explained)),
                    pa.array(np.full(len(rows), f.identity_error)), pa.array(each(f.values)),
                    pa.array([Decimal(v) if v < 10 ** 38 else None for v in dev], pa.decimal128(38, 0)).take(rows)], schema=OUT)

    return vectors.mapInArrow(task, OUT_DDL)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all distinct vectors and project every vector; see the module's text for odd rows."""
    vectors = whole_vectors(rows, id_col, vec_col)
    return transform(vectors, fit(vectors, components))
