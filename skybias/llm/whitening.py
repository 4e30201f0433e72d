"""Whitening of vectors by the exact characteristic polynomial of their integer scatter matrix.

1. Entries become integers. One pass sums the entries and their products over all rows, exactly (sums travel in limbs of 40 bits).
2. With n rows, products P and sums S, the matrix A = n P - S S' is integral, and the covariance is A / n^2.
3. The characteristic polynomial of A is computed modulo many primes, each by Hessenberg reduction; Spark deals the primes to tasks. Its
   coefficients follow by Chinese remaindering: they are at most (1 + trace / d)^d in size, as A has no negative eigenvalue.
4. All roots are real, so by Descartes' rule the number of roots above a point is the number of sign changes of the shifted polynomial, with
   multiplicities. Bisection on integers isolates the leading roots, and bisection on dyadic numbers brings them to ``BITS`` bits.
5. Inverse iteration in fixed-point arithmetic of ``BITS`` bits gives the null space of A - root, a unit eigenvector for each root.

Steps 4 and 5 work on one d x d matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm.registry import query
from skybias.llm.tables import table

SCALE, COMPONENTS = 1024, 8
LIMB, LIMBS, BITS = 40, 5, 256
LONG = 2 ** 63
PRODUCTS = ", ".join(["i int", "j int", *(f"l{k} long" for k in range(LIMBS))])


def _integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE c) of whole rows; a constant added to all entries would cancel in all that is computed from n x - S, so none is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(column), -1 if len(flat) else 0)


def _limbs(value: int) -> list[int]:
    """Low limbs are not negative, the highest has the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _exact(total: np.ndarray, x: np.ndarray) -> None:
    """Add x'x for x with a first column of ones, exactly: in doubles where no sum can leave 53 bits, else in Python's integers."""
    x = np.column_stack([np.ones(len(x)), x])
    most = float(np.abs(x).max(initial=1.0))
    rows = int(2 ** 52 / most ** 2) if most < 2 ** 26 else 0
    if rows:
        for a in range(0, len(x), rows):
            part = x[a:a + rows]
            total += (part.T @ part).astype(np.int64).astype(object)
    else:
        whole = np.array([[int(v) for v in row] for row in x], object)
        total += whole.T @ whole


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = _integers(batch.column("vector"))
        if len(x):
            total = np.zeros((x.shape[1] + 1, x.shape[1] + 1), object) if total is None else total
            _exact(total, x)
    if total is not None:
        cells = [(i, j, *_limbs(int(total[i, j]))) for i in range(len(total)) for j in range(i, len(total))]
        columns = list(zip(*cells, strict=True))
        yield pa.record_batch([pa.array(c, pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(columns)], ["i", "j", *(f"l{k}" for k in range(LIMBS))])


def moments(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and products of the integer vectors: a triangle of sums from each task, added up by Spark."""
    rows = vectors.mapInArrow(_products, PRODUCTS).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    d = max(r["i"] for r in rows)
    full = np.zeros((d + 1, d + 1), object)
    for r in rows:
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = sum(int(r[f"l{k}"]) << (LIMB * k) for k in range(LIMBS))
    return int(full[0, 0]), [int(s) for s in full[0, 1:]], full[1:, 1:]


def _prime(p: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3e9."""
    if any(p % q == 0 for q in (2, 3, 5, 7)):
        return False
    odd = p - 1
    while odd % 2 == 0:
        odd //= 2
    for base in (2, 3, 5, 7):
        x, e = pow(base, odd, p), odd
        while e != p - 1 and x not in (1, p - 1):
            x, e = x * x % p, e * 2
        if x != p - 1 and e % 2 == 0:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    found, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def characteristic_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - a) modulo p, lowest first: reduction to Hessenberg form by similarity, then the recurrence over its columns."""
    h, d = np.array(a % p, np.int64), len(a)
    for k in range(d - 2):
        pivot = np.flatnonzero(h[k + 1:, k])
        if not len(pivot):
            continue
        r = k + 1 + int(pivot[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        m = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - m[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * m % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        weight, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        poly[k] = (poly[k] - (weight[:, None] * poly[:k] % p).sum(0)) % p
    return poly[d]


def _modular(cells: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.array(cells, object)
        for batch in batches:
            out = [characteristic_modulo(a, p).tolist() for p in batch.column("p").to_pylist()]
            yield pa.record_batch([batch.column("p"), pa.array(out, pa.list_(pa.int64()))], ["p", "c"])

    return run


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Exact coefficients of det(t - a), lowest first, for an integer matrix without negative eigenvalues."""
    d, trace = len(a), int(sum(a[i, i] for i in range(len(a))))
    chosen = primes(d * (2 + trace // d).bit_length() + 2)
    dealt = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(min(len(chosen), 4 * spark.sparkContext.defaultParallelism))
    rows = dealt.mapInArrow(_modular([[int(v) for v in row] for row in a]), "p long, c array<long>").collect()
    product, out = 1, [0] * (d + 1)
    for p, c in sorted((r["p"], r["c"]) for r in rows):
        inverse = pow(product % p, -1, p)
        out = [x + product * ((v - x) * inverse % p) for x, v in zip(out, c, strict=True)]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def roots_above(poly: list[int], at: int) -> int:
    """Roots above ``at``, with multiplicities, of a polynomial all of whose roots are real: sign changes after a shift."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def leading_roots(poly: list[int], top: int, count: int) -> list[tuple[int, int, int]]:
    """(numerator, binary exponent, multiplicity) of the largest roots, at least ``count`` with multiplicities: root = numerator / 2^exponent.

    Roots that are still together in an interval of length 2^-64 count as one.
    """
    known: dict[tuple[int, int], int] = {}
    scaled: dict[int, list[int]] = {}

    def above(at: int, s: int) -> int:
        if (at, s) not in known:
            scaled.setdefault(s, [c << (s * (len(poly) - 1 - k)) for k, c in enumerate(poly)])
            known[at, s] = roots_above(scaled[s], at)
        return known[at, s]

    def refined(low: int, s: int) -> int:
        """The one root in (low, low + 1] / 2^s to BITS bits after the point, by the sign of the polynomial."""
        def value(x: int) -> int:
            v = 0
            for k, c in enumerate(reversed(poly)):
                v = v * x + (c << (BITS * k))
            return v

        low, high = low << (BITS - s), (low + 1) << (BITS - s)
        end = value(high)
        if end == 0:
            return high
        while high - low > 1:
            middle = (low + high) // 2
            v = value(middle)
            if v == 0:
                return middle
            low, high = (low, middle) if (v > 0) == (end > 0) else (middle, high)
        return high

    found: list[tuple[int, int, int]] = []
    high, s = top + 1, 0
    while sum(m for _, _, m in found) < count:
        done = sum(m for _, _, m in found)
        if done == len(poly) - 1:
            break
        # largest root not yet found: the smallest interval (low, low + 1] / 2^s above which there are ``done`` roots
        s, low, high = 0, -1, top + 1
        while True:
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if above(middle, s) > done else (low, middle)
            inside = above(low, s) - above(high, s)
            if inside == 1 or s >= 64:
                break
            low, high, s = low << 16, high << 16, s + 16
        found.append((refined(low, s) if inside == 1 else high << (BITS - s), BITS, inside))
    return found


def null_space(a: np.ndarray, root: int, multiplicity: int, seed: int = 0) -> np.ndarray:
    """Unit vectors (rows) that a - root / 2^BITS sends nearest to zero: inverse iteration with a factorisation in fixed point."""
    d = len(a)
    lu = np.array([[int(a[i, j]) << BITS for j in range(d)] for i in range(d)], object)
    for i in range(d):
        lu[i, i] -= root
    order = list(range(d))
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(lu[i, k]))
        if r != k:
            lu[[r, k]] = lu[[k, r]]
            order[r], order[k] = order[k], order[r]
        if lu[k, k] == 0:
            lu[k, k] = 1  # the smallest number of this arithmetic
        for i in range(k + 1, d):
            if lu[i, k]:
                m = (lu[i, k] << BITS) // lu[k, k]
                lu[i, k] = m
                lu[i, k + 1:] -= (m * lu[k, k + 1:]) >> BITS

    def solve(b: list[int]) -> list[int]:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum((int(lu[i, j]) * x[j]) >> BITS for j in range(i))
        for i in range(d - 1, -1, -1):
            x[i] = ((x[i] - sum((int(lu[i, j]) * x[j]) >> BITS for j in range(i + 1, d))) << BITS) // int(lu[i, i])
        most = max(map(abs, x)).bit_length()
        return [v >> (most - BITS) if most > BITS else v << (BITS - most) for v in x]

    draws, out = np.random.default_rng(seed), []
    for _ in range(multiplicity):
        x = [int(v * 2 ** 53) << (BITS - 53) for v in draws.uniform(0.5, 1.0, d)]
        for _ in range(4):
            x = solve(x)
            for u in out:  # stay apart from the vectors of the same root that are there already
                share = (sum(p * q for p, q in zip(u, x, strict=True)) << BITS) // sum(p * p for p in u)
                x = [q - ((share * p) >> BITS) for p, q in zip(u, x, strict=True)]
        out.append(x)
    unit = np.array([[v / 2 ** BITS for v in x] for x in out])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lead = np.take_along_axis(unit, np.abs(unit).argmax(1)[:, None], 1)
    return unit * np.sign(lead)


def components(spark: SparkSession, n: int, sums: list[int], products: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, unit eigenvectors (rows) and shares of the trace, of the ``count`` largest."""
    s = np.array(sums, object)
    a = n * products - np.outer(s, s)
    trace = int(sum(a[i, i] for i in range(len(a))))
    count = min(count, len(a))
    if trace == 0:  # all rows are alike: no direction is better than another
        return np.zeros(count), np.eye(len(a))[:count], np.zeros(count)
    values, vectors, shares = [], [], []
    for k, (root, _, together) in enumerate(leading_roots(characteristic_polynomial(spark, a), trace, count)):
        vectors += list(null_space(a, root, together, k))
        values += [root / (n * n << BITS)] * together
        shares += [root / (trace << BITS)] * together
    return np.array(values[:count]), np.array(vectors[:count]), np.array(shares[:count])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n x - S as doubles, rounded once, and the exact sum of its squares for each row."""
    most = n * float(np.abs(x).max(initial=0.0)) + max(map(abs, sums), default=0)
    exact = np.int64 if most * most * max(1, len(sums)) < 2 ** 62 else object
    whole = x.astype(np.int64) if exact is np.int64 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    apart = n * whole - np.array(sums, exact)
    return apart.astype(np.float64), (apart * apart).sum(1).tolist()


def _whitened(n: int, sums: list[int], weights: np.ndarray, moments_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(weights)
        total, products, rows = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            x = _integers(batch.column("vector"))
            if not len(x):
                continue
            apart, deviation = _centred(x, n, sums)
            w = (apart / n) @ weights.T
            if moments_only:
                total, products, rows = total + w.sum(0), products + w.T @ w, rows + len(w)
            else:
                fits = pa.array([v if v < LONG else None for v in deviation], pa.int64())
                yield pa.record_batch([batch.column("vec_id"), fits, pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])
        if moments_only and rows:
            i, j = np.triu_indices(k)
            sums_ = np.concatenate([total, products[i, j]])
            where = [*((c, -1) for c in range(k)), *zip(i.tolist(), j.tolist(), strict=True)]
            yield pa.record_batch([pa.array([p[0] for p in where], pa.int32()), pa.array([p[1] for p in where], pa.int32()), pa.array(sums_)], ["i", "j", "s"])

    return run


def _identity_error(rows: DataFrame, n: int, sums: list[int], weights: np.ndarray, real: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance less the identity; the rows are centred before they are multiplied."""
    k, cells = len(weights), np.zeros((len(weights), len(weights) + 1))
    found = rows.mapInArrow(_whitened(n, sums, weights, True), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    for r in found:
        cells[r["i"], r["j"]] = r["s"] / n
    mean, cov = cells[:, k], cells[:, :k]
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k))[np.ix_(real, real)].max(initial=0.0))


def whitened(vectors: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row of ``vectors`` and leading component.

    A row is dropped if its vector is null or empty or holds null or non-finite entries. Vectors of different lengths are fitted apart. Repeated
    rows count as often as they occur; a null vec_id is kept as null. Entries are rounded down to 1/1024 and shifted; ``deviation`` is the exact sum of
    (n x - S)^2, null where it leaves 64 bits. Components with eigenvalue 0 have a null ``whitened`` and take no part in ``identity_error``; an
    empty table gives no row. Equal eigenvalues are ordered arbitrarily, but alike in every run.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    for (d,) in sorted(rows.select(F.size("vector").alias("d")).distinct().collect()):
        own = rows.where(F.size("vector") == d)
        n, sums, products = moments(own)
        values, directions, shares = components(spark, n, sums, products, count)
        real = values > 0
        weights = directions / np.sqrt(np.where(real, values, 1.0))[:, None]
        error = _identity_error(own, n, sums, weights, real)
        cells = own.mapInArrow(_whitened(n, sums, weights, False), "vec_id long, deviation long, w array<double>")
        parts = [F.struct(F.lit(k + 1).alias("component"), (F.col("w")[k] if real[k] else F.lit(None).cast("double")).alias("whitened"),
                          F.lit(float(shares[k])).alias("explained")) for k in range(len(values))]
        long = cells.select("vec_id", "deviation", F.explode(F.array(*parts)).alias("c"))
        out = out.union(long.select("vec_id", "c.component", F.lit(n).cast("long"), "deviation", "c.whitened", "c.explained", F.lit(error)))
    return out


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
