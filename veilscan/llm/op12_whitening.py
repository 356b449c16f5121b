"""Whitening of embeddings along the leading eigenvectors of their covariance, found by slicing its spectrum.

Entries become whole numbers, so counts, sums and centred products are exact and don't depend on how rows are dealt out:
tasks add them up, and the driver gets one matrix of the vectors' width. Of the covariance less a shift, the signs of the
pivots of a symmetric factorisation (LDL' with 1 by 1 and 2 by 2 pivots) say how many eigenvalues lie above the shift.
Halving with these counts isolates each leading eigenvalue in an interval of its own; Rayleigh quotient iteration, which
converges cubically, ends the search inside it; and counts just above and just below certify the eigenvalue's number.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Entries become floor(SCALE * c) + SHIFT; larger entries than MOST are out of range.
SCALE, SHIFT, MOST = 1024, 100_000, float(1 << 40)
COMPONENTS = 8
_EPS = np.finfo(float).eps
_EXACT, _LONG = 1 << 53, 1 << 62


@dataclass(frozen=True)
class Model:
    """What whitening needs: number of vectors, exact sums of their entries, eigenvalues by falling size, their vectors as
    rows, the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def middle(self) -> list[int]:
        """The whole numbers nearest to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]


def whole(vectors: DataFrame, vector: str = "embedding", into: str = "x") -> DataFrame:
    """``vectors`` whose entries are all finite numbers, with ``into``: array<long> of floor(1024 * c) + 100000.

    Rows go whose vector is null, empty, holds null, NaN or infinite entries or any beyond 2**40, or is of another length
    than most vectors (the longer one if two lengths tie). Repeated rows stay."""
    good = F.forall(vectors[vector], lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= MOST))
    rows = vectors.filter(vectors[vector].isNotNull() & (F.size(vectors[vector]) > 0) & good)
    width = rows.groupBy(F.size(rows[vector]).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    made = rows.withColumn(into, F.transform(rows[vector], lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))
    return made.filter(F.size(into) == (width["size"] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, exact: in doubles or longs where all sums fit, else in Python's numbers."""
    most = int(np.abs(x).max(initial=0)) ** 2 * len(x)
    if most < _EXACT:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    return (x.T @ x).astype(object) if most < _LONG else x.astype(object).T @ x.astype(object)


def _added(rows: DataFrame, part, schema: str) -> DataFrame:
    """(i, j, value): sums over all rows of the (i, j) -> number tables that ``part`` makes of a batch's vectors; a task adds up its own first."""

    def add(batches):
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in part(_matrix(batch.column(0))).items():
                    total[k] = total.get(k, 0) + v
        if total:
            i, j = zip(*total)
            exact = schema.startswith("decimal")
            values = [Decimal(int(v)) for v in total.values()] if exact else [float(v) for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0) if exact else pa.float64())], ["i", "j", "value"])

    return rows.mapInArrow(add, f"i int, j int, value {schema}").groupBy("i", "j").agg(F.sum("value").alias("value"))


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above the shift: the positive pivots of LDL' of it less the shift,
    with Bunch and Kaufman's choice of pivots."""
    a = v - shift * np.eye(len(v))
    alpha, k, n, count = (1 + 17**0.5) / 8, 0, len(a), 0

    def swap(p, q):
        a[[p, q]] = a[[q, p]]
        a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        two = False
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(column.argmax())
            beside = np.abs(a[r, k:])
            beside[r - k] = 0
            if abs(a[k, k]) * beside.max() < alpha * most**2:
                two = abs(a[r, r]) < alpha * beside.max()
                swap(k + 1 if two else k, r)
        if two:
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            count += 1  # such a block has a pivot of each sign
            k += 2
        else:
            d = a[k, k]
            if d:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :] / d)
            count += d > 0
            k += 1
    return count


def _iterated(v: np.ndarray, shift: float, known: list[np.ndarray], seed: int, scale: float) -> tuple[float, np.ndarray]:
    """A Rayleigh quotient and its vector, from a shift: inverse iteration first, then with the quotient as the shift."""
    x = np.random.Generator(np.random.PCG64(seed)).standard_normal(len(v))
    best = (np.inf, shift, x)
    for step in range(12):
        for u in known:
            x = x - (u @ x) * u
        x = x / np.linalg.norm(x)
        rho = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - rho * x))
        if residual < best[0]:
            best = (residual, rho, x)
        elif step > 4:
            break
        at = shift if step < 2 else rho
        try:
            x = np.linalg.solve(v - at * np.eye(len(v)), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            x = np.linalg.solve(v - (at + _EPS * scale) * np.eye(len(v)), x)
        if not np.isfinite(x).all():
            break
    return best[1], best[2]


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, by falling size, and their unit vectors as rows; fewer where the rest is zero to
    double precision. Equal eigenvalues get vectors at right angles."""
    scale = float(np.abs(v).sum(axis=1).max(initial=0.0))
    n, tiny = len(v), 8 * len(v) * _EPS * scale
    counts = {-tiny: n, scale + tiny: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    if not n or not scale or count(tiny) == 0:
        return np.zeros(0), np.zeros((0, n))
    for k in range(1, min(most, count(tiny)) + 1):
        while True:
            lo = max(s for s, c in counts.items() if c >= k)
            hi = min(s for s, c in counts.items() if c < k and s > lo)
            close = hi - lo <= 2 * tiny
            if close or counts[lo] - counts[hi] == 1:
                rho, x = _iterated(v, (lo + hi) / 2, vectors, k, scale)
                if close or (lo <= rho <= hi and count(rho - tiny) >= k > count(rho + tiny)):
                    break
            count((lo + hi) / 2)
        values.append(rho)
        vectors.append(x)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order]


def fit(vectors: DataFrame, x: str = "x", components: int = COMPONENTS) -> Model | None:
    """The model of ``whole`` vectors; null if there are none. The driver gets sums of the vectors' width and its square."""
    rows = vectors.select(x)
    sums = {r["j"]: int(r["value"]) for r in _added(rows, lambda m: {(0, 0): len(m)} | {(0, j + 1): s for j, s in enumerate(_columns(m))}, "decimal(38,0)").collect()}
    if not sums:
        return None
    n = sums.pop(0)
    model = Model(n, [sums[j] for j in sorted(sums)], np.zeros(0), np.zeros((0, len(sums))), 0.0)
    middle = np.array(model.middle, np.int64)
    upper = [(i, j) for i in range(len(middle)) for j in range(i, len(middle))]
    products = _added(rows, lambda m: dict(zip(upper, _products(m - middle)[np.triu_indices(len(middle))])), "decimal(38,0)").collect()
    # centred on whole numbers in the tasks; what the means differ from these is taken off exactly
    off = [s - n * int(m) for s, m in zip(model.sums, middle)]
    v = np.zeros((len(middle), len(middle)))
    for r in products:
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["value"]) - off[i] * off[j]) / (n * n)
    values, found = leading(v, components)
    return Model(n, model.sums, values, found, float(np.trace(v)))


def _columns(x: np.ndarray) -> list[int]:
    return (x if int(np.abs(x).max(initial=0)) * len(x) < _LONG else x.astype(object)).sum(axis=0).tolist()


def _whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """(x - mean) on each component, over the root of its eigenvalue."""
    middle = np.array(model.middle, np.int64)
    off = np.array([(s - model.n * int(m)) / model.n for s, m in zip(model.sums, middle)])
    return ((x - middle) - off) @ (model.vectors.T / np.sqrt(model.values))


def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sums of (n * x - S) squared, exact; null where they don't fit a long."""
    middle = model.middle
    off = [s - model.n * m for s, m in zip(model.sums, middle)]
    d = x - np.array(middle, np.int64)
    most = model.n * int(np.abs(d).max(initial=0)) + max(map(abs, off))
    if most**2 * x.shape[1] < _LONG:
        return ((model.n * d - np.array(off, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((model.n * d.astype(object) - np.array(off, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def identity_error(vectors: DataFrame, model: Model, x: str = "x") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over all rows."""
    k = len(model.values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def part(m):
        y = _whitened(m, model)
        products = y.T @ y
        return {p: products[p] for p in pairs} | {(-1, j): s for j, s in enumerate(y.sum(axis=0))}

    got = {(r["i"], r["j"]): r["value"] / model.n for r in _added(vectors.select(x), part, "double").collect()}
    return max((abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i, j in pairs), default=0.0)


def whitened(vectors: DataFrame, model: Model, vec_id: str = "vec_id", x: str = "x") -> DataFrame:
    """(vec_id, component, deviation, whitened) of each ``whole`` row and component of the model, numbered from 1."""
    k = len(model.values)

    def apply(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                m = _matrix(part.column(1))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(m)), k)))
                deviation = pa.array(_deviations(m, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(m)), k)))
                numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m)))
                yield pa.RecordBatch.from_arrays([ids, numbers, deviation, pa.array(_whitened(m, model).ravel())], ["vec_id", "component", "deviation", "whitened"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    return vectors.select(vectors[vec_id].alias("vec_id"), x).mapInArrow(apply, f"vec_id {kind}, component int, deviation long, whitened double")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Without vectors, or where all are equal, there are no components and no rows; vectors that span fewer dimensions than
    eight have as many components as dimensions."""
    rows = whole(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "x")
    model = fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.values]), F.col("component"))
    error = F.lit(float(identity_error(rows, model)))
    out = whitened(rows, model).withColumns({"n": F.lit(model.n).cast("long"), "explained": share, "identity_error": error})
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
