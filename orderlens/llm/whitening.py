"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

An entry c becomes the whole number ``floor(64 * c) + 1000000``; the fit list is each distinct
vector once. Its count n and sums S come first, then the scatter of the centred vectors: entries
are moved by the whole number nearest to their mean before they are multiplied, and the rest
(less than one half) is taken off in exact arithmetic, so the scatter of ``n * x - S`` is known
to the last digit whatever the offset. Tasks add up their own scatter (a few rows of one row of
the matrix each), Spark adds those.

The scatter (dimensions squared numbers) is factored on the driver by Cholesky with pivoting,
which stops where the rest is rounding, so dependent dimensions need no special case. One-sided
Jacobi then turns the columns of the triangular factor against each other until all are
orthogonal: squared column norms are the eigenvalues, normalised columns the components. The
covariance itself is never decomposed, which keeps small eigenvalues accurate.

Defined cases: a vector that is null, or has a null, infinite or not-a-number entry is left out,
also one with an entry whose size exceeds 2**26 (the centred products would leave the longs);
the dimension is the length that most remaining rows have (ties: the larger), other lengths and
empty vectors are left out; an id may be null or repeated, each row counts in the result, each
distinct vector once in the fit; only components with an eigenvalue above rounding exist, so a
single distinct vector, like an empty table, gives an empty result; a deviation beyond a long is
null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import emit, prepare, saved
from orderlens.llm.vectors import doubles, matrix, no_null

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 26)
MOST = (1 << 63) - 1
# Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
HALF = 1 << 31

SCATTER = pa.schema([("row", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x (array<long>) of the rows whose entries are all finite."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), doubles(vectors[vec_col]).alias("v"))
    finite = no_null(F.col("v"), lambda c: ~F.isnan(c) & (F.abs(c) <= LARGEST))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    return rows.where(finite & (F.size("v") > 0)).select("vec_id", x.alias("x"))


def main_width(rows: DataFrame) -> int:
    """The length most rows have; lengths are few, so only their counts move."""
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    first = widths.orderBy(F.desc("n"), F.desc("width")).first()
    return first.width if first else 0


def column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and S: added up in the tasks, then as decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += matrix(batch.column(0), width).sum(axis=0)
        schema = pa.schema([("n", pa.int64()), ("total", pa.list_(pa.int64()))])
        yield emit(schema, [n], [total])

    parts = fit.select("x").mapInArrow(partial, "n long, total array<long>")
    added = parts.select("n", F.posexplode("total").alias("dim", "part")).groupBy("dim")
    rows = added.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    sums = {r.dim: int(r.total) for r in rows}
    return (rows[0].n if rows else 0), [sums[d] for d in sorted(sums)]


def products(d: np.ndarray) -> list[np.ndarray]:
    """d' d exactly, as two long matrices (high, low) with value high * 2**31 + low."""
    largest = float(np.abs(d).max(initial=0)) ** 2
    if largest * len(d) < EXACT:
        whole = d.astype(float)
        parts = (whole.T @ whole).astype(np.int64)
        return [parts >> 31, parts & (HALF - 1)]
    high = np.zeros((d.shape[1],) * 2, np.int64)
    low = high.copy()
    for row in d:  # entries up to 2**33: exact in Python's integers
        wide = np.multiply.outer(row.astype(object), row.astype(object))
        high += (wide >> 31).astype(np.int64)
        low += (wide & (HALF - 1)).astype(np.int64)
    return [high, low]


def scatter(fit: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """Sum over the fit list of (n x - S)(n x - S)', divided by n: exact whole numbers."""
    width = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((2, width, width), np.int64)
        for batch in batches:
            more = products(matrix(batch.column(0), width) - middle)
            high += more[0]
            low += more[1]
        yield emit(SCATTER, np.arange(width), list(high), list(low))

    parts = fit.select("x").mapInArrow(partial, "row int, high array<long>, low array<long>")
    each = parts.select("row", F.posexplode(F.arrays_zip("high", "low")).alias("col", "part"))
    added = each.groupBy("row", "col").agg(
        *[F.sum(F.col(f"part.{half}").cast("decimal(38,0)")).alias(half) for half in ("high", "low")]
    )
    out = [[0] * width for _ in range(width)]
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    for r in added.collect():  # dimensions squared numbers
        out[r.row][r.col] = n * (int(r.high) * HALF + int(r.low)) - rest[r.row] * rest[r.col]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """A factor g with a = g g', lower triangular up to the order of its rows; columns end where
    the remaining diagonal is rounding."""
    a = a.copy()
    size = len(a)
    least = size * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    g = np.zeros((size, 0))
    for _ in range(size):
        k = int(a.diagonal().argmax())
        if a[k, k] <= least:
            break
        column = a[:, k] / np.sqrt(a[k, k])
        a -= np.outer(column, column)
        a[k, :] = a[:, k] = 0
        g = np.c_[g, column]
    return g


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring, reversed(ring)) if a < b < n or b < a < n]
        pairs = sorted({(min(p), max(p)) for p in pairs})
        if pairs:
            left, right = np.array(pairs).T
            out.append((left, right))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``g`` times a rotation that makes its columns orthogonal, longest first."""
    g = g.copy()
    tiny = 4 * np.finfo(float).eps
    rounds = rounds_of_pairs(g.shape[1])
    for _ in range(sweeps):
        turned = False
        for left, right in rounds:
            a, b = g[:, left], g[:, right]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            open_ = np.abs(ab) > tiny * np.sqrt(aa * bb)
            if not open_.any():
                continue
            turned = True
            ratio = (bb - aa) / np.where(open_, 2 * ab, 1)
            t = np.where(ratio < 0, -1, 1) / (np.abs(ratio) + np.sqrt(1 + ratio**2))
            c = np.where(open_, 1 / np.sqrt(1 + t * t), 1)
            s = np.where(open_, t * c, 0)
            g[:, left], g[:, right] = c * a - s * b, s * a + c * b
        if not turned:
            break
    return g[:, np.argsort(-(g * g).sum(axis=0), kind="stable")]


@dataclass(frozen=True)
class Fit:
    """What a whitening needs: n, S, components (one a column), eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def fitted(fit: DataFrame, width: int, components: int) -> Fit | None:
    n, sums = column_sums(fit, width)
    if n < 2:
        return None
    exact = scatter(fit, n, sums)
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in exact])
    turned = one_sided_jacobi(pivoted_cholesky(covariance))
    values = (turned * turned).sum(axis=0)
    trace = float(Fraction(sum(exact[d][d] for d in range(width)), n * n))
    return Fit(n, sums, turned[:, :components] / np.sqrt(values[:components]), values[:components], trace)


def centred(x: np.ndarray, of: Fit) -> np.ndarray:
    """x - S / n: the difference with the whole part of the mean is exact."""
    whole = np.array([s // of.n for s in of.sums], np.int64)
    rest = np.array([float(Fraction(s % of.n, of.n)) for s in of.sums])
    return (x - whole) - rest


def deviations(x: np.ndarray, of: Fit) -> list[int | None]:
    """Sum of (n x - S)**2 per row; null where it leaves the longs."""
    size = max(abs(of.n * int(edge) - s) for s, lo, hi in zip(of.sums, x.min(0), x.max(0), strict=True) for edge in (lo, hi))
    if size < HALF and size * size * x.shape[1] <= MOST and of.n * int(np.abs(x).max()) <= MOST:
        gaps = x * of.n - np.array(of.sums, np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    exact = [sum((of.n * v - s) ** 2 for v, s in zip(row, of.sums, strict=True)) for row in x.tolist()]
    return [v if v <= MOST else None for v in exact]


def identity_error(fit: DataFrame, of: Fit) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, by a pass of its own."""
    width, k = of.components.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centred(matrix(batch.column(0), width), of) @ of.components / np.sqrt(of.values)
            total += w.sum(axis=0)
            square += w.T @ w
        yield emit(pa.schema([("sums", pa.list_(pa.float64()))]), [np.r_[total, square.ravel()]])

    parts = fit.select("x").mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("at", "part"))
    added = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect()}
    sums = np.array([added[i] for i in range(k + k * k)]) / of.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = prepare(vectors.sparkSession)
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    rows = whole_numbers(vectors, id_col, vec_col)
    width = main_width(rows)
    rows = rows.where(F.size("x") == width)
    # Repeats go within the tasks first, so a hot vector moves once per task.
    fit = saved(rows.select("x").distinct()) if width else None
    of = fitted(fit, width, components) if width else None
    if of is None or not len(of.values):
        return spark.createDataFrame([], f"{names}, identity_error double")
    k = len(of.values)
    error = identity_error(fit, of)
    fields = [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
    schema = pa.schema([*fields, ("whitened", pa.float64()), ("explained", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1), width)
            place = pa.array(np.repeat(np.arange(m), k))
            yield emit(
                schema,
                batch.column(0).take(place),
                np.tile(np.arange(1, k + 1), m),
                np.full(m * k, of.n),
                pa.array(deviations(x, of), pa.int64()).take(place),
                (centred(x, of) @ of.components / np.sqrt(of.values)).ravel(),
                np.tile(of.values / of.trace, m),
            )

    return rows.mapInArrow(each, names).withColumn("identity_error", F.lit(error))
