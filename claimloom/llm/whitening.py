"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Vectors become integers (``scale`` units per one).  The scatter n * sum(x x') - S S' of the distinct ones is summed exactly; it is
n squared times the covariance.  Its characteristic polynomial comes from residues: every prime's task brings the matrix to
Hessenberg form modulo the prime, and Chinese remaindering gives the integer coefficients.  All roots are real, so the sign changes of the
shifted polynomial count the roots beyond a point exactly; bisection isolates the largest ones to ``PRECISION`` bits.  Inverse iteration at
such a root, in decimal arithmetic of that precision, gives the vector that spans its null space.

What the driver holds is bounded by the dimension: one matrix, one polynomial and a few vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_map
from claimloom.session import durable

SCALE = 256
COMPONENTS = 4
# Relative bits of a root, digits of the inverse iteration.
PRECISION = 110
DIGITS = 90
ROWS = 4096
_LIMB = 40
_LIMBS = 5


def finite(vector: Column) -> Column:
    """True for vectors that are neither null nor empty and hold no null or non-finite entry."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def _integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer rows, and which of the vectors they are: one that a long cannot hold is left out."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    scaled = np.floor(flat * scale)
    held = (np.abs(scaled) < 2.0**63).all(axis=1)
    return scaled[held].astype(np.int64), np.flatnonzero(held)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it, behind their width: equal rows have equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1))] = w
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        narrow = x[rows].astype(f"<i{w}")
        for i, row in zip(rows.tolist(), narrow):
            out[i] = bytes([w]) + row.tobytes()
    return out


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r, f"<i{r[0]}", offset=1).astype(np.int64) for r in rows])


def distinct_integers(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """x: every distinct integer vector once, packed; copies fold inside each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, _ = _integers(b.column(0), scale)
                yield pa.RecordBatch.from_arrays([pa.array(_packed(x) if len(x) else [], pa.binary())], ["x"])

    return df.select(vec_col).mapInArrow(run, "x binary").distinct()


def _products(x: np.ndarray) -> np.ndarray:
    """x'x in Python integers; floating point where every partial sum is an exact one."""
    top = max(abs(int(x.min())), abs(int(x.max())))
    if top * top * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = x.astype(object)
    return big.T @ big


def scatter(distinct: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n * sum(x x') - S S' of the distinct vectors, exact: every task sums its own in whole numbers of any size, and Spark adds
    these up in limbs."""

    def run(batches):
        n, total, square = 0, 0, 0
        for b in batches:
            for at in range(0, len(b["x"]), ROWS):
                x = _unpacked(b["x"][at : at + ROWS])
                n, total, square = n + len(x), total + x.astype(object).sum(axis=0), square + _products(x)
        if n:
            d = len(total)
            cells = [(-1, -1, n), *[(i, -1, total[i]) for i in range(d)], *[(i, j, square[i, j]) for i in range(d) for j in range(i + 1)]]
            out = {"i": [c[0] for c in cells], "j": [c[1] for c in cells]}
            for k in range(_LIMBS):
                out[f"l{k}"] = [(int(v) >> _LIMB * k) & ((1 << _LIMB) - 1) if k < _LIMBS - 1 else int(v) >> _LIMB * k for *_, v in cells]
            yield out

    limbs = [f"l{k}" for k in range(_LIMBS)]
    cells = arrow_map(distinct, run, f"i int, j int, {', '.join(f'{x} long' for x in limbs)}").groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs])
    value = {(r.i, r.j): sum(r[x] << _LIMB * k for k, x in enumerate(limbs)) for r in cells.collect()}
    n = value.get((-1, -1), 0)
    d = sum(1 for i, j in value if j == -1 and i >= 0)
    sums = [value[i, -1] for i in range(d)]
    return n, sums, [[n * value[max(i, j), min(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def primes_below(limit: int) -> Iterator[int]:
    """Primes from ``limit`` down: candidates that no prime up to their root divides."""
    small = np.ones(isqrt(limit) + 1, bool)
    small[:2] = False
    for p in range(2, isqrt(len(small)) + 1):
        if small[p]:
            small[p * p :: p] = False
    divisors = np.flatnonzero(small)
    for c in range(limit - 1, 1, -1):
        if (c % divisors[divisors * divisors <= c]).all():
            yield c


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients, constant first, of det(t - matrix) modulo a prime below 2^31, by a similar matrix in Hessenberg form."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for m in range(1, d - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        i = m + int(pivots[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    # leading minors: each from those before it, along its last column
    minors = [np.ones(1, np.int64)]
    for k in range(d):
        now = np.zeros(k + 2, np.int64)
        now[1:] = minors[k]
        now[:-1] -= int(h[k, k]) * minors[k] % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            now[: i + 1] -= int(h[i, k]) * chain % p * minors[i] % p
        minors.append(now % p)
    return minors[-1].tolist()


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first, of det(t - matrix) of a matrix without negative eigenvalues.

    The bound on the coefficients (elementary symmetric functions of roots with a given sum are largest where all are equal) says how
    many primes it takes; each is a row, and Spark deals them out.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = 2 * max(comb(d, k) * trace**k // d**k for k in range(d + 1)) + 2
    primes, product = [], 1
    for p in primes_below(1 << 31):
        if product > bound:
            break
        primes.append(p)
        product *= p

    def run(batches):
        for b in batches:
            yield {"p": b["p"], "c": [polynomial_mod(matrix, p) for p in b["p"]]}

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rows = arrow_map(spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks, "p"), run, "p long, c array<long>").collect()
    weights = {p: product // p * pow(product // p, -1, p) for p in primes}
    out = [sum(r.c[k] * weights[r.p] for r in rows) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in out]


def roots_beyond(poly: list[int], num: int, bits: int) -> int:
    """Roots greater than num / 2^bits, each as often as it occurs: sign changes after a shift, exact as all roots are real."""
    d = len(poly) - 1
    c = [v << bits * (d - i) for i, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], num: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(poly):
        value = value * num + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], k: int) -> list[tuple[int, int]]:
    """The k largest positive roots (fewer, if there are fewer) as (num, bits): num / 2^bits is within 2^-PRECISION of a root, relatively."""
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    top = max(1, -poly[-2]) if len(poly) > 1 else 1
    out = []
    for rank in range(1, min(k, len(poly) - 1) + 1):
        lo, hi, bits = 0, 1 << top.bit_length(), 0
        above_lo, above_hi = len(poly) - 1, 0
        sign_hi = None
        while (hi - lo) << PRECISION > hi or not lo:
            if hi - lo < 2:
                lo, hi, bits = lo << 32, hi << 32, bits + 32
            mid = (lo + hi) // 2
            if above_lo - above_hi == 1:
                # one root is left between the two: the sign tells the side
                sign_hi = _sign(poly, hi, bits) if sign_hi is None else sign_hi
                at = _sign(poly, mid, bits)
                # the upper end may itself be no root, as none equal to it lies beyond it
                if at == 0:
                    lo = hi = mid
                    break
                lo, hi = (lo, mid) if at == sign_hi or sign_hi == 0 and at == -_sign(poly, lo, bits) else (mid, hi)
            else:
                n = roots_beyond(poly, mid, bits)
                if n >= rank:
                    lo, above_lo = mid, n
                else:
                    hi, above_hi, sign_hi = mid, n, None
        out.append((lo + hi, bits + 1))
    return out


def null_vectors(matrix: list[list[int]], roots: list[tuple[int, int]]) -> list[list[float]]:
    """Unit vectors of the null spaces of matrix - root by inverse iteration, orthogonal to those before (also where roots coincide)."""
    d = len(matrix)
    found: list[np.ndarray] = []
    with localcontext() as context:
        context.prec = DIGITS
        whole = np.array([[Decimal(v) for v in row] for row in matrix], object)
        tiny = max(abs(v) for row in matrix for v in row) * Decimal(10) ** (5 - DIGITS)
        for k, (num, bits) in enumerate(roots):
            shift = Decimal(num) / Decimal(1 << bits)
            a = whole.copy()
            a[np.arange(d), np.arange(d)] -= shift
            order = np.arange(d)
            for m in range(d):
                i = m + max(range(d - m), key=lambda r: abs(a[m + r, m]))
                if i != m:
                    a[[i, m]], order[[i, m]] = a[[m, i]], order[[m, i]]
                if abs(a[m, m]) < tiny:
                    a[m, m] = tiny
                a[m + 1 :, m] = a[m + 1 :, m] / a[m, m]
                a[m + 1 :, m + 1 :] -= np.outer(a[m + 1 :, m], a[m, m + 1 :])
            v = np.array([Decimal(1) + Decimal((i + 1) * (k + 3) % 7) / 11 for i in range(d)], object)
            for _ in range(4):
                for other in found:
                    v = v - other * (v @ other)
                y = v[order]
                for m in range(d):
                    y[m] -= a[m, :m] @ y[:m] if m else 0
                for m in range(d - 1, -1, -1):
                    y[m] = (y[m] - (a[m, m + 1 :] @ y[m + 1 :] if m + 1 < d else 0)) / a[m, m]
                for other in found:
                    y = y - other * (y @ other)
                v = y / (y @ y).sqrt()
            found.append(v)
    out = []
    for v in found:
        lead = max(v, key=abs)
        out.append([float(x) if lead > 0 else -float(x) for x in v])
    return out


class Whitening:
    """What a fit leaves: n, S, the eigenvalues as shares of the trace, and the components."""

    def __init__(self, spark, n: int, sums: list[int], matrix: list[list[int]], components: int):
        trace = sum(matrix[i][i] for i in range(len(matrix)))
        roots = largest_roots(characteristic_polynomial(spark, matrix), components) if trace else []
        self.n, self.sums = n, sums
        self.vectors = np.array(null_vectors(matrix, roots) if roots else np.zeros((0, len(sums))))
        with localcontext() as context:
            context.prec = DIGITS
            values = [Decimal(num) / Decimal(1 << bits) for num, bits in roots]
            self.explained = [float(v / trace) for v in values]
            # the scatter is n squared times the covariance
            self.deviations = np.array([float(v.sqrt() / n) for v in values])
        self.identity_error = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they hold it."""
        top = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums))
        kind = np.int64 if top < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors.T / self.deviations

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        top = max(abs(int(centred.min())), abs(int(centred.max())))
        exact = centred if top * top * centred.shape[1] < 1 << 63 else centred.astype(object)
        return [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1).tolist()]


def fit(df: DataFrame, vec_col: str, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """The whitening of the distinct integer vectors, with its identity error; every vector of ``df`` must be finite and of one length."""
    distinct = durable(distinct_integers(df, vec_col, scale))
    model = Whitening(df.sparkSession, *scatter(distinct), components)
    k = len(model.deviations)

    def run(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for at in range(0, len(b["x"]), ROWS):
                w = model.whiten(model.centred(_unpacked(b["x"][at : at + ROWS])))
                total, square = total + w.sum(axis=0), square + w.T @ w
        yield {"i": [*np.repeat(np.arange(k), k), *np.arange(k)], "j": [*np.tile(np.arange(k), k), *[-1] * k], "v": [*square.ravel(), *total]}

    if k:
        cells = {(r.i, r.j): r.v / model.n for r in arrow_map(distinct, run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
        covariance = np.array([[cells[i, j] - cells[i, -1] * cells[j, -1] for j in range(k)] for i in range(k)])
        model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: up to ``components`` rows per vector.

    Vectors that are null, empty or hold a null or non-finite entry take no part, nor do those whose length is not the most frequent one (the
    larger of equally frequent ones) or whose integers a long cannot hold.  Zero vectors take part.  Repeated vectors are fitted once and
    whitened each time; repeated and null ids are ids.  Ties: equal eigenvalues get orthogonal components of their common
    space.  Only positive eigenvalues have components, so vectors that are all equal give no rows, as does an empty table.  A deviation
    beyond a long is null.  Long vectors cost time by the fourth power of their length, spread over the primes.  Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(finite(F.col("v")))
    kind = df.schema[id_col].dataType.simpleString()
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    fields = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not usual:
        return spark.createDataFrame([], fields).withColumnRenamed("id", id_col)
    rows = rows.filter(F.size("v") == usual[0].d)
    model = fit(rows, "v", components, scale)
    k = len(model.deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, held = _integers(b.column(1), scale) if len(b) else (np.zeros((0, 0)), [])
            if not len(x) or not k:
                continue
            centred = model.centred(x)
            w = model.whiten(centred)
            m = len(x)
            columns = {
                "id": b.column(0).take(pa.array(np.repeat(held, k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, model.n),
                "deviation": pa.array([v for v in model.deviation(centred) for _ in range(k)], pa.int64()), "whitened": w.ravel(),
                "explained": np.tile(model.explained, m), "identity_error": np.full(m * k, model.identity_error),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)
