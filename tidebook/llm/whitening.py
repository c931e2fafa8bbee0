"""Embedding whitening from an exact covariance: integers are split into limbs small enough for float64 products.

Vectors become integers, x = floor(scale * c). The fit list is each distinct x once. With the sums S known, x is centred by
the integer next to S / n, its entries are split into limbs of 20 bits, and limb matrices are multiplied by BLAS in float64:
products of 4,096 rows stay below 2^53, so every sum is exact. Sums of one power of 2^20 are added up by Spark as
decimals, recombined to big integers on the driver (dimensions squared times seven numbers at most, whatever
the number of rows), corrected for what S / n lies off the integer, and rounded once. Then the matrix is decomposed.

Defined cases: rows whose vector is null or holds null, NaN or an infinity are left out. Vectors of different lengths
are whitened apart, each among its own; empty ones have no components. Integers beyond 2^62 are cut to it. Components whose
eigenvalue is not above 1e-13 of the trace (all of them where vectors are equal) have no direction and are left out.
A deviation beyond 63 bits is null. Repeated rows each get their result, an empty table gives no rows, and only the
columns in keep and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize

SCALE = 256
BITS = 20
#: Rows of one product: 2^12 products of two limbs of 20 bits stay below 2^53.
ROWS = 1 << 12
#: Rows after which sums of products are handed on, so that they stay below 2^63.
HELD = 1 << 20
LARGEST = 1 << 62


@dataclass
class Fit:
    """n vectors with sums S; components in columns by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(vector: Column, scale: int = SCALE) -> Column:
    x = F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale))
    return F.transform(x, lambda k: F.least(F.greatest(k, F.lit(-LARGEST)), F.lit(LARGEST)))


def usable(vector: Column) -> Column:
    wide = vector.cast("array<double>")
    return vector.isNotNull() & ~F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """float64 matrices whose sum, each times its power of 2^20, is d; all but the last are not negative."""
    out = []
    while len(d) and ((d < -(1 << BITS)) | (d >= 1 << BITS)).any():
        out.append((d & ((1 << BITS) - 1)).astype(np.float64))
        d = d >> BITS
    return [*out, d.astype(np.float64)]


def products(d: np.ndarray) -> list[np.ndarray]:
    """The exact d^T d as int64 matrices, one for each power of 2^20, of at most ROWS rows."""
    parts = limbs(d)
    out = [np.zeros((d.shape[1],) * 2, np.int64) for _ in range(2 * len(parts) - 1)]
    for p, a in enumerate(parts):
        for q, b in enumerate(parts[p:], p):
            m = (a.T @ b).astype(np.int64)
            out[p + q] += m if p == q else m + m.T
    return out


def matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch that have vectors of one length, with these as an int64 matrix of at most ROWS rows."""
    for batch in batches:
        lists = batch.column(column)
        at, flat = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
        size = np.diff(at)
        for width in np.unique(size):
            rows = np.flatnonzero(size == width)
            for k in range(0, len(rows), ROWS):
                own = rows[k : k + ROWS]
                yield own, flat[at[own][:, None] + np.arange(width)]


def sums_of(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length: the number of vectors and their sums. Halves of 32 bits are added apart, so nothing overflows."""

    def run(batches):
        for _, x in matrices(batches):
            lo, hi = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
            width = x.shape[1]
            # Place -1 holds the number of rows, for vectors of length 0 as well.
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, width)), pa.array(np.arange(-1, width)), pa.array(np.append(len(x), lo)), pa.array(np.append(0, hi))], names=["width", "i", "lo", "hi"])

    rows = vectors.mapInArrow(run, "width long, i long, lo long, hi long")
    found: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("width", "i").agg(F.sum(F.col("lo").cast("decimal(20,0)")).alias("lo"), F.sum(F.col("hi").cast("decimal(20,0)")).alias("hi")).collect():
        found.setdefault(r.width, {})[r.i] = int(r.lo) + (int(r.hi) << 32)
    return {w: (s[-1], [s[i] for i in range(w)]) for w, s in found.items()}


def centre(n: int, sums: list[int]) -> list[int]:
    """The integer next to each mean."""
    return [(2 * s + n) // (2 * n) for s in sums]


def grams(vectors: DataFrame, middle: dict[int, list[int]]) -> dict[int, dict[tuple[int, int], int]]:
    """For each length: the exact sums of products of the vectors less their middle, for i <= j."""

    def rows_of(width, held):
        i, j = np.triu_indices(width)
        for level, m in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width)), pa.array(np.full(len(i), level)), pa.array(i), pa.array(j), pa.array(m[i, j])], names=["width", "level", "i", "j", "v"])

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        count: dict[int, int] = {}
        for _, x in matrices(batches):
            width = x.shape[1]
            if not width:
                continue
            if count.get(width, 0) + len(x) > HELD:
                yield from rows_of(width, held.pop(width))
                count[width] = 0
            own, more = held.setdefault(width, []), products(x - np.array(middle[width], np.int64))
            count[width] = count.get(width, 0) + len(x)
            own += [np.zeros_like(more[0]) for _ in range(len(more) - len(own))]
            for m, p in zip(own, more, strict=False):
                m += p
        for width, own in held.items():
            yield from rows_of(width, own)

    rows = vectors.mapInArrow(run, "width long, level long, i long, j long, v long")
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in rows.groupBy("width", "level", "i", "j").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
        own = out.setdefault(r.width, {})
        own[r.i, r.j] = own.get((r.i, r.j), 0) + (int(r.v) << (BITS * r.level))
    return out


def decompose(n: int, sums: list[int], middle: list[int], gram: dict[tuple[int, int], int]) -> Fit:
    """The covariance is (n G - T T') / n^2, with G and T of the centred integers: integers, divided once."""
    off = [s - n * m for s, m in zip(sums, middle, strict=True)]
    v = np.zeros((len(sums),) * 2)
    for (i, j), g in gram.items():
        v[i, j] = v[j, i] = (n * g - off[i] * off[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    return Fit(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(v)))


def fit_list(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """x: each distinct integer vector once. Equal ones meet within tasks first, so a very common one is no hot key."""
    return embeddings.where(usable(F.col(vector))).select(integers(F.col(vector), scale).alias("x")).distinct()


def fit(distinct: DataFrame) -> dict[int, Fit]:
    """The decomposition for each length of the vectors x, each of which counts."""
    sums = sums_of(distinct)
    middle = {w: centre(n, s) for w, (n, s) in sums.items()}
    gram = grams(distinct, middle)
    return {w: decompose(n, s, middle[w], gram[w]) for w, (n, s) in sums.items() if w}


def project(x: np.ndarray, own: Fit, most: int) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Numbers of the components that have a direction, the whitened values on them, and the exact deviations."""
    live = np.flatnonzero(own.values[:most] > 1e-13 * own.trace)
    reach = own.n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in own.sums)
    if reach * reach * len(own.sums) < 1 << 63:
        d = own.n * x - np.array(own.sums, np.int64)
        deviation: list[int | None] = (d * d).sum(1).tolist()
        d = d.astype(np.float64)
    else:
        exact = [[own.n * v - s for v, s in zip(row, own.sums, strict=True)] for row in x.tolist()]
        total = [sum(v * v for v in row) for row in exact]
        deviation = [t if t < 1 << 63 else None for t in total]
        d = np.array([[float(v) for v in row] for row in exact]).reshape(len(x), -1)
    return live, (d / own.n) @ (own.vectors[:, live] / np.sqrt(own.values[live])), deviation


def whitened(vectors: DataFrame, fits: dict[int, Fit], most: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep with component, n, deviation, whitened and explained: one row for each vector x and component."""
    schema = vectors.select(*keep).schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double")):
        schema = schema.add(name, kind)
    shared = vectors.sparkSession.sparkContext.broadcast(fits)  # dimensions squared

    def run(batches):
        for batch in batches:
            for rows, x in matrices(iter([batch])):
                own = shared.value.get(x.shape[1])
                if own is None:
                    continue
                live, w, deviation = project(x, own, most)
                k, again = len(live), np.repeat(rows, len(live))
                out = [pa.array(np.tile(live + 1, len(rows)), pa.int32()), pa.array(np.full(len(again), own.n)), pa.array([v for v in deviation for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(own.values[live] / own.trace, len(rows)) if k else np.empty(0))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(again)) for c in range(len(keep))), *out], names=schema.names)

    return vectors.select(*keep, F.col("x")).mapInArrow(run, schema)


def identity_error(distinct: DataFrame, fits: dict[int, Fit], most: int = 4) -> float | None:
    """The largest entry of the whitened values' covariance less the identity, measured over the fit list of every length."""
    widths = {w: np.flatnonzero(f.values[:most] > 1e-13 * f.trace) for w, f in fits.items()}
    schema = "width long, i long, j long, s double"

    def run(batches):
        for _, x in matrices(batches):
            own = fits.get(x.shape[1])
            if own is None or not len(widths[x.shape[1]]):
                continue
            _, w, _ = project(x, own, most)
            k = w.shape[1]
            i, j = np.triu_indices(k)
            # Values are centred already; their sums (place -1) take out what rounding leaves.
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i) + k, x.shape[1])), pa.array(np.append(i, np.full(k, -1))), pa.array(np.append(j, np.arange(k))), pa.array(np.append((w.T @ w)[i, j], w.sum(0)))], names=["width", "i", "j", "s"])

    found = {(r.width, r.i, r.j): r.s for r in distinct.mapInArrow(run, schema).groupBy("width", "i", "j").agg(F.sum("s").alias("s")).collect()}
    errors = []
    for (width, i, j), s in found.items():
        if i >= 0:
            n = fits[width].n
            errors.append(abs(s / n - found[width, -1, i] / n * found[width, -1, j] / n - (i == j)))
    return max(errors, default=None)


def whiten(embeddings: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), most: int = 4, scale: int = SCALE) -> DataFrame:
    """The columns in keep with component, n, deviation, whitened, explained and identity_error for each usable row."""
    distinct = materialize(fit_list(embeddings, vector, scale), "vectors")
    fits = fit(distinct)
    rows = embeddings.where(usable(F.col(vector))).select(*keep, integers(F.col(vector), scale).alias("x"))
    return whitened(rows, fits, most, keep).withColumn("identity_error", F.lit(identity_error(distinct, fits, most)).cast("double"))
