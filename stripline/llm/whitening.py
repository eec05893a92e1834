"""Whitening of embeddings by exact linear algebra.

Entries become integers, so the scatter matrix is one of integers.  Its characteristic polynomial is exact: tasks reduce the matrix to Hessenberg form
modulo many primes at once and read the polynomial off it, and the Chinese remainder theorem joins the residues; how many primes that takes follows from a
bound on the coefficients.  All roots are real, hence by Descartes' rule the sign changes of the shifted polynomial count the roots beyond a point
exactly, with multiplicity: bisection isolates the largest roots, and ends at any precision.  Components are null vectors of the matrix less a root, by
inverse iteration with as many digits as tell the roots apart.

Only sums over rows are distributed; what the driver holds is bounded by the square of the dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, getcontext, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripline.session import cut

SCALE, COMPONENTS = 256.0, 4
LIMB = 32          # bits of a limb of a sum
PRIMES_AT_ONCE = 16
SEPARATE = 200     # bits to which roots are told apart
LONG = 1 << 63


def integers(vectors: pa.ListArray | pa.LargeListArray, scale: float = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector is there, without null or non-finite entries, and their entries as ``floor(scale * c)``, beyond a long its bounds."""
    offsets = np.asarray(vectors.offsets)
    values = vectors.values.cast(pa.float64())
    x = values.to_numpy(zero_copy_only=False)  # nulls become nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    null = np.asarray(vectors.is_null())
    rows = np.flatnonzero(~null & (bad[offsets[1:]] == bad[offsets[:-1]]))
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(scale * x)
        whole = np.where(y >= 2.0 ** 63, LONG - 1, np.where(y >= -(2.0 ** 63), y, 0).astype(np.int64))
    whole = np.where(y < -(2.0 ** 63), -LONG, whole)
    return rows, [whole[offsets[r]:offsets[r + 1]] for r in rows.tolist()]


def integer_rows(rows: DataFrame, vector: str, ident: str, scale: float = SCALE) -> DataFrame:
    """``vec_id, dim, x`` of the usable rows; ``x`` are the bytes of the integers, 8 each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            if not batch.num_rows:
                continue
            keep, x = integers(col, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([len(v) for v in x], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())],
                                             ["vec_id", "dim", "x"])
    return rows.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, dim long, x binary")


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of packed integers as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), np.int64).reshape(-1, dim)


def limbs(values: list[int]) -> list[tuple[int, int, int]]:
    """(index, limb, part) of integers of any size: 32 bits a limb, the last one signed."""
    out = []
    for k, v in enumerate(values):
        j = 0
        while v not in (0, -1) or j == 0:
            out.append((k, j, v & ((1 << LIMB) - 1)))
            v >>= LIMB
            j += 1
        if v:
            out.append((k, j, -1))
    return out


def summed(df: DataFrame, sums, size: int) -> list[int]:
    """Exact totals of what ``sums(batch)`` returns (``size`` integers of any size), added up as limbs by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(batch)
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*limbs(total))], ["k", "j", "v"])

    out = [0] * size
    for r in df.mapInArrow(run, "k long, j long, v long").groupBy("k", "j").agg(F.sum("v").alias("v")).collect():
        out[r.k] += r.v << (LIMB * r.j)
    return out


def outer(y: np.ndarray) -> list[int]:
    """Sum of the products of any two columns, exact; in doubles where all sums stay below 2^53, else in blocks of rows, else in integers of any size."""
    most = int(max(abs(int(y.max())), abs(int(y.min())))) if y.size else 0
    step = (1 << 53) // max(1, most * most)
    if step < 1:
        y = y.astype(object)
        return (y.T @ y).ravel().tolist()
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), step):
        f = y[i:i + step].astype(np.float64)
        total += (f.T @ f).astype(np.int64)
    return total.ravel().tolist()


def scatter(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and n^2 times the covariance of distinct integer vectors, all exact; centred at the rounded mean before multiplying."""
    first = summed(fit, lambda b: [b.num_rows, *matrix(b.column(0), dim).sum(axis=0, dtype=object).tolist()], dim + 1)
    n, s = first[0], first[1:]
    middle = [(2 * v + n) // (2 * n) for v in s]

    def centred(b: pa.RecordBatch) -> list[int]:
        x = matrix(b.column(0), dim)
        wide = x.size and max(abs(int(x.max())), abs(int(x.min())), *map(abs, middle)) >= 1 << 62
        y = x.astype(object) - np.array(middle, object) if wide else x - np.array(middle, np.int64)
        return outer(y)

    flat = summed(fit, centred, dim * dim)
    rest = [v - n * m for v, m in zip(s, middle)]
    return n, s, [[n * flat[i * dim + j] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2^31."""
    small = [p for p in range(3, 46341, 2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))]
    found, top, width = [], (1 << 31) - 1, 1 << 16
    while len(found) < count:
        low = top - width + 1
        sieve = np.ones(width, bool)
        for p in (2, *small):
            sieve[-low % p::p] = False
        found += (np.flatnonzero(sieve)[::-1] + low).tolist()
        top = low - 1
    return found[:count]


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Modular inverses by powers."""
    out, base, e = np.ones_like(x), x.copy(), p - 2
    for _ in range(31):
        out = np.where(e & 1, out * base % p, out)
        base, e = base * base % p, e >> 1
    return out


def residues(m: list[list[int]], some: list[int]) -> np.ndarray:
    """Coefficients of det(xI - m) modulo each prime, constant first: Hessenberg reduction of all residues side by side."""
    p = np.array(some, np.int64)
    d, q, one = len(m), p[:, None], p[:, None, None]
    a = np.array([[[v % x for v in row] for row in m] for x in some], np.int64).reshape(len(some), d, d)
    every = np.arange(len(some))
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(a[:, k + 1:, k] != 0, axis=1)  # any nonzero entry; where there is none the column is done
        move = every[pivot != k + 1]
        if len(move):
            j = pivot[move]
            rows = a[move, k + 1].copy()
            a[move, k + 1] = a[move, j]
            a[move, j] = rows
            cols = a[move, :, k + 1].copy()
            a[move, :, k + 1] = a[move, :, j]
            a[move, :, j] = cols
        u = a[:, k + 2:, k] * _inverse(a[:, k + 1, k], p)[:, None] % q
        a[:, k + 2:] = (a[:, k + 2:] - u[:, :, None] * a[:, None, k + 1] % one) % one
        step = np.zeros((len(some), d), np.int64)
        for i in range(d - k - 2):
            step = (step + a[:, :, k + 2 + i] * u[:, i, None]) % q
        a[:, :, k + 1] = (a[:, :, k + 1] + step) % q
    polys = [np.zeros((len(some), d + 1), np.int64)]
    polys[0][:, 0] = 1
    for k in range(d):
        new = np.zeros((len(some), d + 1), np.int64)
        new[:, 1:] = polys[k][:, :-1]
        new = (new - a[:, k, k, None] * polys[k]) % q
        along = np.ones(len(some), np.int64)
        for i in range(k - 1, -1, -1):
            along = along * a[:, i + 1, i] % p
            new = (new - (a[:, i, k] * along % p)[:, None] * polys[i]) % q
        polys.append(new)
    return polys[d]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - m), constant first, of a positive semidefinite integer matrix; residues are found by tasks.

    The k-th elementary symmetric function of nonnegative roots is at most C(d, k) (trace / d)^k.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = max(math.comb(d, k) * trace ** k // d ** k for k in range(d + 1)) + 1
    some = primes(-(-(2 * bound).bit_length() // 30))
    lots = [some[i:i + PRIMES_AT_ONCE] for i in range(0, len(some), PRIMES_AT_ONCE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                c = residues(m, lots[k])
                yield pa.RecordBatch.from_arrays([pa.array(lots[k]), pa.array(c.tolist())], ["p", "c"])

    got = {r.p: r.c for r in spark.range(0, len(lots), 1, min(len(lots), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, "p long, c array<long>").collect()}
    out, product = [0] * (d + 1), 1
    for p in some:
        inverse = pow(product, -1, p)
        out = [x + product * ((c - x) * inverse % p) for x, c in zip(out, got[p])]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """Roots beyond ``num / 2^bits``, with multiplicity, of a polynomial all of whose roots are real: the sign changes after a shift."""
    d = len(poly) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(poly)]  # roots times 2^bits
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def positive_at(poly: list[int], num: int, bits: int) -> int:
    """Sign of the polynomial at ``num / 2^bits``."""
    d, out = len(poly) - 1, 0
    for i in range(d, -1, -1):
        out = out * num + (poly[i] << (bits * (d - i)))
    return (out > 0) - (out < 0)


def largest_roots(poly: list[int], trace: int, most: int, separate: int = SEPARATE) -> list[tuple[int, int, int]]:
    """The largest positive roots as (number, bits, multiplicity): each lies within 2^-bits below ``number / 2^bits``, to ``separate`` significant bits."""
    poly = poly[next(i for i, v in enumerate(poly) if v):]  # zero is no root any more
    top = trace.bit_length()
    open_, out, have = [(0, 1 << top, 0, len(poly) - 1, 0)], [], 0  # low, high, bits, roots above low, roots above high
    while open_ and have < most:
        low, high, bits, below, above = open_.pop()
        n = below - above
        if not n:
            continue
        if n == 1 and low:
            sign = positive_at(poly, high, bits) or -positive_at(poly, low, bits)
            while (high - low) << separate > high:
                low, high, bits = 2 * low, 2 * high, bits + 1
                mid = (low + high) // 2
                low, high = (low, mid) if positive_at(poly, mid, bits) in (sign, 0) else (mid, high)
        if low and (high - low) << separate <= high:
            out.append((high, bits, n))
            have += n
            continue
        low, high, bits = (low, high, bits) if (low + high) % 2 == 0 else (2 * low, 2 * high, bits + 1)
        mid = (low + high) // 2
        at = roots_above(poly, mid, bits)
        open_ += [(low, mid, bits, below, at), (mid, high, bits, at, above)]
    return out


def null_vectors(m: list[list[int]], num: int, bits: int, count: int, digits: int) -> list[list[float]]:
    """``count`` orthonormal vectors that the matrix less ``num / 2^bits`` takes next to nothing: inverse iteration in decimals."""
    d = len(m)
    with localcontext() as ctx:
        ctx.prec = digits
        ctx.Emax, ctx.Emin = 10 ** 9, -(10 ** 9)
        root = Decimal(num) / Decimal(1 << bits)
        a = np.array([[Decimal(v) for v in row] for row in m], object).reshape(d, d)
        for i in range(d):
            a[i, i] -= root
        tiny = (max(abs(v) for v in a.ravel()) or Decimal(1)) * Decimal(10) ** (-digits)
        order = list(range(d))
        for k in range(d):
            j = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))  # noqa: B023
            if j != k:
                a[[k, j]] = a[[j, k]]
                order[k], order[j] = order[j], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            for i in range(k + 1, d):
                if a[i, k]:
                    a[i, k] /= a[k, k]
                    a[i, k + 1:] -= a[i, k] * a[k, k + 1:]

        def solve(b):
            y = np.array([b[i] for i in order], object)
            for i in range(d):
                y[i] -= sum(a[i, :i] * y[:i], Decimal(0))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum(a[i, i + 1:] * y[i + 1:], Decimal(0))) / a[i, i]
            return y

        found: list[np.ndarray] = []
        for k in range(count):
            v = np.array([Decimal(1 + (i * (2 * k + 3)) % (d + 7)) for i in range(d)], object)
            for _ in range(4):
                v = solve(v)
                for _ in range(2):
                    for w in found:
                        v = v - w * sum(v * w, Decimal(0))
                    v = v / sum(v * v, Decimal(0)).sqrt()
            found.append(v)
        return [[float(x) for x in v] for v in found]


def principal(spark: SparkSession, m: list[list[int]], most: int = COMPONENTS) -> list[tuple[Decimal, list[float]]]:
    """The largest positive eigenvalues of a positive semidefinite integer matrix, falling, with unit eigenvectors; at most ``most``."""
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return []
    out = []
    digits = 3 * SEPARATE // 10 + len(str(trace)) + 20
    getcontext()  # decimals are set up once
    for num, bits, n in largest_roots(characteristic(spark, m), trace, most):
        with localcontext() as ctx:
            ctx.prec = digits
            root = Decimal(num) / Decimal(1 << bits)
        out += [(root, v) for v in null_vectors(m, num, bits, min(n, most - len(out)), digits)]
    return out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """Projections of all vectors on the largest principal components, scaled to unit covariance.

    rows: an id and an array of numbers.  Rows whose vector is null or holds null or non-finite entries are dropped; entries become ``x = floor(scale * c)``
    (beyond a long: the nearest long).  Only vectors of the most frequent length count (the smaller of equally frequent ones), by distinct vectors.
    The fit list is each distinct x once.  A row for each remaining row and component: ``n`` (of the fit list), ``deviation`` (sum of (n x - S)^2, null
    beyond a long), ``whitened`` (on the component, over the root of its eigenvalue e), ``explained`` (e / trace) and ``identity_error``, the largest
    entry by which the covariance of the whitened fit list differs from the identity.  There are at most ``components``, and at most as many as the
    covariance has positive eigenvalues, so none for a single vector, equal ones, empty vectors or an empty table.  Repeated rows and rows without an
    id are rows of their own.  Vectors of equal eigenvalues are any orthonormal basis of their space.
    """
    spark = rows.sparkSession
    some = integer_rows(rows, vector, ident, scale)
    distinct = cut(some.select("dim", "x").distinct())
    most = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    nothing = spark.createDataFrame([], SCHEMA)
    if most is None or not most.dim:
        return nothing
    dim = most.dim
    fit = distinct.filter(F.col("dim") == dim).select("x")
    n, s, m = scatter(fit, dim)
    found = principal(spark, m, components)
    if not found:
        return nothing
    trace = sum(m[i][i] for i in range(dim))
    basis = np.array([v for _, v in found]).T  # dim x components
    with localcontext() as ctx:
        ctx.prec = 60
        scales = np.array([float((root / n / n).sqrt()) for root, _ in found])
        explained = [float(root / trace) for root, _ in found]
    safe = n * max(1, max(map(abs, s)))

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Whitened rows, and n x - S as longs where they fit."""
        bound = n * max(abs(int(x.max())), abs(int(x.min()))) + safe if x.size else 0
        y = n * x - np.array(s, np.int64) if bound < LONG else n * x.astype(object) - np.array(s, object)
        return (y / n).astype(np.float64) @ basis / scales, y

    k = len(found)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for batch in batches:
            if batch.num_rows:
                z, _ = projected(matrix(batch.column(0), dim))
                total += np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    got = np.zeros(k * k + k)
    for r in fit.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r.k] = r.v / n
    mean = got[k * k:]
    error = float(np.abs(got[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = projected(matrix(batch.column(1), dim))
            if y.dtype == object or dim * int(np.abs(y).max()) ** 2 >= LONG:
                far = [v if v < LONG else None for v in (sum(e * e for e in row) for row in y.tolist())]
            else:
                far = (y * y).sum(axis=1).tolist()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(z)), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()), pa.array(np.full(len(z) * k, n)), pa.array([v for v in far for _ in range(k)], pa.int64()),
                 pa.array(z.ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(len(z) * k, error))], [c.split()[0] for c in SCHEMA.split(", ")])

    return some.filter(F.col("dim") == dim).select("vec_id", "x").mapInArrow(finish, SCHEMA)
