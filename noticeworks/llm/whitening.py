"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, so the scatter ``M = n * sum(x x') - S S'`` (n**2 times the covariance) is summed up without rounding. Then

1. the characteristic polynomial of M is found modulo many primes, each by a Hessenberg reduction, and put together by Chinese remaindering;
2. its roots, all real, are isolated in integers: the number of roots beyond a point is the number of sign changes of the polynomial shifted
   there, and an isolated root is halved down to ``FRACTION`` bits behind the point;
3. a component is the null space of M minus a root, by inverse iteration in integers of that precision.

Vectors are read three times by narrow passes (sums, check of the whitened covariance, output); sums are one slim row per cell and task.
The driver holds the matrix and the polynomial, whose size follows the dimension alone; primes and components are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Bits behind the point of a root, and of the quotients of the inverse iteration.
FRACTION, QUOTIENT = 128, 192
#: Larger entries, also after scaling, count as this.
LARGEST = 1 << 62
_LIMB = 40
#: Rows that a pass holds at once.
ROWS = 4096


def whole_numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their floor(SCALE * entry) as integers without the SHIFT)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fits = (np.diff(ends) == dim) & (bad[ends[1:]] == bad[ends[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values[ends[rows][:, None] + np.arange(dim)])
    return rows, np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            rows, x = whole_numbers(part.column("vector"), dim)
            if len(rows):
                yield part, rows, x


def _exact(x: np.ndarray, largest: int) -> np.ndarray:
    """``x`` as floats where products of two with ``largest`` as bound sum up without rounding, else as Python integers."""
    return x.astype(np.float64) if largest * largest * max(1, len(x)) < 1 << 53 else x.astype(object)


def _summed(dim: int) -> Callable:
    """Pass over vectors: (cell, limb, value) of the sums of entries and of products, and of the number of rows."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for _, _, x in _parts(batches, dim):
            n += len(x)
            y = _exact(x, int(np.abs(x).max()))
            sums = sums + (y.sum(axis=0).astype(np.int64).astype(object) if y.dtype == np.float64 else y.sum(axis=0))
            product = y.T @ y
            products = products + (product.astype(np.int64).astype(object) if y.dtype == np.float64 else product)
        cells, limbs, values = [], [], []
        for cell, v in enumerate([n, *sums.tolist(), *products[upper].tolist()]):
            sign, v, k = (1, int(v), 0) if v >= 0 else (-1, -int(v), 0)
            while v:
                cells.append(cell)
                limbs.append(k)
                values.append(sign * (v & ((1 << _LIMB) - 1)))
                v >>= _LIMB
                k += 1
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["cell", "limb", "value"])

    return run


def scatter(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, n * sum of products - products of sums) over ``vectors`` (vector), exactly, as Python integers."""
    rows = vectors.select("vector").mapInArrow(_summed(dim), "cell long, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect()
    cells = [0] * (1 + dim + dim * (dim + 1) // 2)
    for r in rows:
        cells[r["cell"]] += r["value"] << (_LIMB * r["limb"])
    n, sums = cells[0], np.array(cells[1 : 1 + dim], dtype=object)
    products = np.zeros((dim, dim), object)
    products[np.triu_indices(dim)] = cells[1 + dim :]
    products = products + np.triu(products, 1).T
    return n, sums, n * products - np.outer(sums, sums)


def primes(bits: int) -> list[int]:
    """Primes below 2**31, from above, whose product has more than ``bits`` bits."""
    small = [p for p in range(2, 46341) if all(p % q for q in range(2, math.isqrt(p) + 1))] if bits else []
    out, total, p = [], 0.0, (1 << 31) + 1
    while total <= bits + 1:
        p -= 2
        if all(p % q for q in small):
            out.append(p)
            total += math.log2(p)
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, from that of the highest power, of det(x - matrix) modulo a prime below 2**31, by reduction to Hessenberg form."""
    a = (matrix % p).astype(np.int64)
    d = len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        if i := int(below[0]):
            a[[k, k + i]] = a[[k + i, k]]
            a[:, [k, k + i]] = a[:, [k + i, k]]
        u = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - u[:, None] * a[k] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * u % p).sum(axis=1)) % p
    known = np.zeros((d + 1, d + 1), np.int64)  # row k: the polynomial of the first k rows and columns, from the constant up
    known[0, 0] = 1
    for k in range(1, d + 1):
        factor, along = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            factor[i] = int(a[i, k - 1]) * along % p
            along = along * int(a[i, i - 1]) % p if i else 0
        known[k, 1:] = known[k - 1, :-1]
        known[k] = (known[k] - (factor[:, None] * known[:k] % p).sum(axis=0)) % p
    return known[d, ::-1].tolist()


def _across(spark: SparkSession, items: list[tuple], schema: str, fn: Callable, out: str) -> list:
    """``fn`` of each item, dealt to tasks. Items and results are bounded by the dimension."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], f"i int, {schema}")
    rows = rows.repartition(max(1, min(len(items), spark.sparkContext.defaultParallelism)), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [fn(*(v for k, v in r.items() if k != "i")) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results)], names=["i", "result"])

    return [r["result"] for r in sorted(rows.mapInArrow(run, f"i int, result {out}").collect(), key=lambda r: r["i"])]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), from that of the highest power, of a symmetric integer matrix without negative roots."""
    d, trace = len(matrix), int(matrix.trace())
    # the k-th coefficient is at most (d over k) * (trace / d)**k
    most = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    moduli = primes(most.bit_length() + 1)
    shared = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])
    residues = _across(spark, [(p,) for p in moduli], "p long", lambda p: polynomial_modulo(np.array(shared.value, dtype=object), p), "array<long>")
    product = math.prod(moduli)
    weights = [product // p * pow(product // p, -1, p) for p in moduli]
    out = [sum(w * r[k] for w, r in zip(weights, residues, strict=True)) % product for k in range(d + 1)]
    return [c - product if c > product // 2 else c for c in out]


def roots_beyond(polynomial: list[int], at: int) -> int:
    """Number of roots over ``at`` of a polynomial that has real roots only: sign changes of the shifted one."""
    shifted = list(polynomial)
    for last in range(len(shifted) - 1, 0, -1):
        for k in range(1, last + 1):
            shifted[k] += shifted[k - 1] * at
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(polynomial: list[int], count: int, fraction: int = FRACTION) -> list[tuple[int, int]]:
    """(root * 2**fraction rounded up, multiplicity) of the largest positive roots, ``count`` or more in all, falling. All roots are real."""
    scaled = [c << (fraction * k) for k, c in enumerate(polynomial)]
    top = 1
    while roots_beyond(scaled, top):
        top <<= 1

    def sign(at: int) -> int:
        value = 0
        for c in scaled:
            value = value * at + c
        return (value > 0) - (value < 0)

    open_, found, taken = [(0, roots_beyond(scaled, 0), top, 0)], [], 0  # (below, roots over it, above, roots over it)
    while open_ and taken < count:
        low, n_low, high, n_high = open_.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1:
            side = (-1) ** n_low
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if sign(middle) == side else (low, middle)
        if high - low == 1:
            found.append((high, n_low - n_high))
            taken += n_low - n_high
            continue
        middle = (low + high) // 2
        n = roots_beyond(scaled, middle)
        open_ += [(low, n_low, middle, n), (middle, n, high, n_high)]
    return found


def null_space(matrix: np.ndarray, root: int, size: int, fraction: int = FRACTION) -> np.ndarray:
    """``size`` orthonormal rows that span the null space of ``matrix`` minus root / 2**fraction, by one step of inverse iteration.

    The root is known to so many digits that what is left of other components is far below double precision.
    """
    d = len(matrix)
    rng = np.random.default_rng(20240901)
    start = np.array([[int(v) for v in row] for row in rng.integers(-(1 << 40), 1 << 40, (d, size))], dtype=object)
    a = np.concatenate([matrix * (1 << fraction) - np.diag([root] * d).astype(object), start * (1 << fraction)], axis=1)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, best]] = a[[best, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            quotient = (a[k + 1 :, k] << QUOTIENT) // a[k, k]
            a[k + 1 :, k + 1 :] -= (quotient[:, None] * a[k, k + 1 :]) >> QUOTIENT
            a[k + 1 :, k] = 0
    x = np.zeros((d, size), object)
    for k in range(d - 1, -1, -1):
        x[k] = ((a[k, d:] << QUOTIENT) - (a[k, k + 1 : d, None] * x[k + 1 :]).sum(axis=0)) // a[k, k]
    out: list[np.ndarray] = []
    for column in x.T:
        largest = max(abs(v) for v in column)
        v = np.array([c / largest for c in column.tolist()], dtype=np.float64)
        for _ in range(2):
            for u in out:
                v = v - (u @ v) * u
            v = v / np.linalg.norm(v)
        out.append(v if v[np.argmax(np.abs(v))] > 0 else -v)
    return np.array(out)


@dataclass(frozen=True)
class Whitening:
    """What a fit list says: number of vectors, sums (without SHIFT), roots of n**2 times the covariance, their share of the trace, components as rows."""

    n: int
    sums: list[int]
    roots: list[float]
    explained: list[float]
    components: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums: exact, as 64-bit integers where they fit."""
        if (int(np.abs(x).max(initial=0)) + 1) * self.n + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened vectors: the covariance has roots / n**2, so n cancels."""
        return centred.astype(np.float64) @ (self.components / np.sqrt(np.array(self.roots))[:, None]).T


def _named(vectors: DataFrame, vector_col: str, *more: str) -> DataFrame:
    return vectors.select(*(F.col(c).alias(f"id{i}") for i, c in enumerate(more)), F.col(vector_col).cast("array<double>").alias("vector"))


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Learns from all rows that count (see ``whiten``). Without any, n is 0 and there are no components."""
    spark = vectors.sparkSession
    rows = _named(vectors, vector_col)
    whole = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    dim = rows.filter(F.col("vector").isNotNull() & whole).agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    if not dim:
        return Whitening(0, [], [], [], np.zeros((0, 0)))
    n, sums, matrix = scatter(rows, dim)
    trace = int(matrix.trace())
    found = largest_roots(characteristic_polynomial(spark, matrix), min(components, dim)) if trace else []
    shared = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])

    def space(root: str, size: int) -> list[list[float]]:
        return null_space(np.array(shared.value, dtype=object), int(root), size).tolist()

    spaces = _across(spark, [(str(r), m) for r, m in found], "root string, size int", space, "array<array<double>>") if found else []
    one = 1 << FRACTION
    listed = [(r / one, r / (trace * one), v) for (r, _), vs in zip(found, spaces, strict=True) for v in vs][:components]
    return Whitening(n, [int(s) for s in sums], [r for r, _, _ in listed], [e for _, e, _ in listed], np.array([v for _, _, v in listed]).reshape(len(listed), dim))


def _products(model: Whitening) -> Callable:
    """Pass over vectors: sums of the whitened values and of their products."""
    k = len(model.roots)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, _, x in _parts(batches, model.dim):
            y = model.project(model.centred(x))
            sums += y.sum(axis=0)
            products += y.T @ y
        values = np.concatenate([sums, products[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "value"])

    return run


def identity_error(vectors: DataFrame, model: Whitening, *, vector_col: str = "embedding") -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity; 0 without components."""
    k = len(model.roots)
    if not k:
        return 0.0
    sums = _named(vectors, vector_col).mapInArrow(_products(model), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.zeros(k + k * (k + 1) // 2)
    for r in sums.collect():
        cells[r["cell"]] = r["value"]
    mean, (i, j) = cells[:k] / model.n, np.triu_indices(k)
    return float(np.abs(cells[k:] / model.n - mean[i] * mean[j] - (i == j)).max())


def _whitened(model: Whitening, error: float, schema: T.StructType) -> Callable:
    k = len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _parts(batches, model.dim):
            centred = model.centred(x)
            values = model.project(centred)
            small = centred.dtype == np.int64 and int(np.abs(centred).max()) ** 2 * model.dim < 1 << 63
            squares = (centred if small else centred.astype(object)) ** 2
            deviation = pa.array([v if v < 1 << 63 else None for v in squares.sum(axis=1).tolist()], pa.int64())
            every = pa.array(np.repeat(np.arange(len(rows)), k))
            size = len(rows) * k
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows)).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(size, model.n)),
                    deviation.take(every), pa.array(values.ravel()), pa.array(np.tile(np.array(model.explained), len(rows))), pa.array(np.full(size, error)),
                ], names=schema.names,
            )

    return run


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, model: Whitening | None = None) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row that counts and each component, from 1 by falling eigenvalue.

    Entries become x = floor(64 * entry) + 1,000,000. Rows count unless the vector is null, holds a null or non-finite entry, or has fewer entries than the
    longest of them; repeated rows and null ids count like any other. Components are those with a positive eigenvalue, at most ``components``; equal eigenvalues give
    some orthonormal basis. So no rows, one row, or rows all alike give none. ``deviation`` is null beyond a long. Scaled entries beyond 2**62 count as
    this. Other columns are not read. With ``model``, rows are projected by what another list says.
    """
    model = model or fit(vectors, vector_col=vector_col, components=components)
    rows = _named(vectors, vector_col, id_col)
    error = identity_error(vectors, model, vector_col=vector_col)
    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, rows.schema["id0"].dataType), *(T.StructField(n, k) for n, k in kinds)])
    return rows.mapInArrow(_whitened(model, error, schema), schema) if model.roots else vectors.sparkSession.createDataFrame([], schema)


def brute_force(vectors: list[tuple], components: int = COMPONENTS) -> tuple[dict, np.ndarray, np.ndarray]:
    """The contract by NumPy's symmetric eigenvalues, for tests: ({id: (n, deviation, whitened)}, shares, components as rows)."""
    left = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(SCALE * c) + SHIFT for c in v] for _, v in left], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = exact.astype(np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    out = centred @ axes[:, order] / np.sqrt(values[order])
    return {i: (n, int((e * e).sum()), w) for (i, _), e, w in zip(left, exact, out, strict=True)}, values[order] / values.sum(), axes[:, order].T
