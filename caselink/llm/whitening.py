"""Embedding whitening by incremental eigendecomposition.

Entries become whole numbers on a grid, and every distinct grid vector is fitted once. Each partition starts from nothing
and takes one vector after the other into the eigendecomposition of its scatter around its mean: a centred rank-one update
whose new eigenvalues are the roots of the secular equation, whose new eigenvectors follow from weights recomputed from
these roots (so that they stay orthogonal), and from which entries that the vector doesn't touch, and all but one of equal
eigenvalues, are deflated. The spectra of partitions are combined the same way: a rank-one update for each direction of
the other and one for the distance of the means, sixteen spectra a task, level by level. At last one distributed pass
forms the scatter of all vectors in this basis, and its Rayleigh-Ritz values and vectors are the result: this removes what
rounding the updates have gathered.

A task holds one d x d spectrum at a time; the driver gets d x d numbers.

Edge cases: rows whose vector is null or empty or holds null or non-finite entries, or entries beyond 2**50, are dropped;
so are vectors of another length than most rows have (of equally frequent ones the shorter is kept); zero vectors are
kept; a null vec_id is kept; repeated rows give repeated rows, and count once in the fit; components with an eigenvalue of
at most 1e-12 of the largest don't exist, so an empty table or one distinct vector gives an empty result; ``deviation`` is null
where it exceeds a long. Other columns of the input don't take part, whatever they are called.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.vectors import usable
from caselink.session import durable, ship

EPS = np.finfo(np.float64).eps
FAN = 16
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots t of 1 + sum(weights / (poles - t)) = 0 for ascending, distinct poles and positive weights: one between
    each pole and the next, the last within the sum of weights. Returned are the differences poles[j] - t[i] as a matrix,
    which hold more digits than the roots, and the roots.

    Each step solves the equation with the poles on either side of a root in place and the rest as a constant; it is kept
    within the bracket that the signs so far leave.
    """
    k = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    gap = upper - poles
    lower_half = (1 + (weights / (poles - (poles + gap / 2)[:, None])).sum(1)) >= 0
    lower_half[-1] = True  # there is no pole above
    base = np.where(lower_half, poles, upper)
    delta = poles - base[:, None]
    lo = np.where(lower_half, 0.0, -gap / 2)
    hi = np.where(lower_half, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    below = np.tri(k, dtype=bool)  # poles up to the root's own
    left, right = poles - base, upper - base
    tau = (lo + hi) / 2
    for _ in range(60):
        far = delta - tau[:, None]
        term = weights / far
        slope = term / far
        f = 1 + term.sum(1)
        open_ = np.abs(f) > EPS * k * (1 + np.abs(term).sum(1))
        if not open_.any():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
        psi = np.where(below, slope, 0).sum(1)
        phi = slope.sum(1) - psi
        d1, d2 = left - tau, right - tau
        c = f - d1 * psi - d2 * phi
        a = (d1 + d2) * f - d1 * d2 * (psi + phi)
        b = d1 * d2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = tau + step
        new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2)
        new = np.where(open_, new, tau)
        if (new == tau).all():
            break
        tau = new
    return delta - tau[:, None], base + tau


class Spectrum:
    """Count, exact sums, mean, and the eigendecomposition of the scatter around the mean of the vectors so far."""

    def __init__(self, d: int) -> None:
        self.n, self.sums = 0, [0] * d
        self.mean, self.values, self.vectors = np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, rows: np.ndarray) -> None:
        """Take in whole-number rows, one rank-one update each."""
        high, low = rows >> 31, rows & (2**31 - 1)
        self.sums = [s + (int(h) << 31) + int(w) for s, h, w in zip(self.sums, high.sum(0), low.sum(0), strict=True)]
        for x in rows.astype(np.float64):
            gone = x - self.mean
            self.update(gone, self.n / (self.n + 1))
            self.n += 1
            self.mean += gone / self.n

    def merge(self, other: Spectrum) -> None:
        total = self.n + other.n
        gone = other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.update(vector, value)
        self.update(gone, self.n * other.n / total)
        self.mean += gone * (other.n / total)
        self.n, self.sums = total, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def update(self, x: np.ndarray, weight: float) -> None:
        """The decomposition of the scatter plus weight * x x'. ``values`` stay ascending."""
        if weight <= 0:
            return
        z = np.sqrt(weight) * (x @ self.vectors)
        size = z @ z
        scale = max(self.values[-1], size)
        if size <= EPS * EPS * scale:
            return
        self._level(z, 8 * EPS * scale)
        live = np.flatnonzero(z * z > EPS * EPS * scale)
        if not len(live):
            return
        poles, z = self.values[live], z[live]
        away, roots = secular_roots(poles, z * z)
        k = len(live)
        # weights for which the roots are exact, so that the vectors come out orthogonal
        over = poles - poles[:, None]
        over = np.where(np.tri(k, k, -1, dtype=bool), over, np.c_[over[:, 1:], np.ones(k)])
        z = np.sign(z) * np.sqrt(np.abs(np.prod(-away.T / over, axis=1)))
        turn = z[:, None] / away.T
        turn /= np.sqrt((turn * turn).sum(0))
        self.vectors[:, live] = self.vectors[:, live] @ turn
        self.values[live] = roots
        if (np.diff(self.values) < 0).any():
            order = np.argsort(self.values, kind="stable")
            self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _level(self, z: np.ndarray, near: float) -> None:
        """Of eigenvalues that are as good as equal, turn all of the update into the last one's direction."""
        for i in np.flatnonzero(np.diff(self.values) <= near).tolist():
            r = np.hypot(z[i], z[i + 1])
            if r and z[i]:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                a, b = self.vectors[:, i].copy(), self.vectors[:, i + 1]
                self.vectors[:, i], self.vectors[:, i + 1] = c * a - s * b, s * a + c * b


def on_grid(column: pa.Array, scale: int, shift: int) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """(mask, rows) of floor(scale * entry) + shift."""
    ok, vectors = usable(column)
    rows = [None if v is None or np.abs(v).max() > 2.0**50 else np.floor(scale * v).astype(np.int64) + shift for v in vectors]
    return np.array([r is not None for r in rows], bool), rows


def _grid(scale: int, shift: int):
    """Grid vectors less the shift, in as few bytes an entry as hold the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = on_grid(batch.column(0), scale, 0)
            rows = [r for r in rows if r is not None]
            kinds = [next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= r.min() and r.max() <= np.iinfo(t).max) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([len(r) for r in rows], pa.int32()), pa.array([r.astype(t).tobytes() for r, t in zip(rows, kinds, strict=True)], pa.binary())], names=["dim", "x"])

    return run


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of ``_grid`` as whole numbers."""
    kinds = {2 * d: np.int16, 4 * d: np.int32, 8 * d: np.int64}
    raw = column.to_pylist()
    out = np.empty((len(raw), d), np.int64)
    size = np.array([len(r) for r in raw])
    for s, t in kinds.items():
        at = np.flatnonzero(size == s)
        if len(at):
            out[at] = np.frombuffer(b"".join(raw[i] for i in at), t).reshape(-1, d)
    return out


def _one(blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["part"])


def _spectra(d: int):
    def run(batches):
        own = Spectrum(d)
        for batch in batches:
            if batch.num_rows:
                own.add(_matrix(batch.column(0), d))
        if own.n:
            yield _one(pickle.dumps(own))

    return run


def _combined(batches):
    own = None
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            other = pickle.loads(blob)
            if own is None:
                own = other
            else:
                own.merge(other)
    if own is not None:
        yield _one(pickle.dumps(own))


class Whitening:
    """What the fit gives: ``n`` vectors with ``sums`` by dimension, and components by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], basis: np.ndarray, values: np.ndarray, trace: float, most: int) -> None:
        self.n, self.sums = n, np.array(sums, np.int64)
        self.floor, self.rest = self.sums // n, self.sums % n
        held = min(most, int((values > 1e-12 * max(values[0], 0)).sum())) if len(values) else 0
        self.basis, self.values, self.explained = basis[:, :held], values[:held], values[:held] / trace if held else values[:0]

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.floor) - self.rest / self.n

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ self.basis / np.sqrt(self.values)

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        rough = np.abs(self.centred(rows)).max(1) * self.n
        fits = rows.shape[1] * (rough + self.n) ** 2 < 2.0**63
        apart = np.where(fits[:, None], self.n * (rows - self.floor) - self.rest, 0)
        return [int(x) if f else None for x, f in zip((apart * apart).sum(1), fits, strict=True)]


def _sums_of(map_rows, d: int):
    """One row of a partition: the sum of what ``map_rows`` returns, an array, over its blocks."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = map_rows(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield _one(total.tobytes())

    return run


def _summed(fit: DataFrame, map_rows, d: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all partitions, of the bounded size ``shape``: partial sums are added up level by level."""
    parts = fit.mapInArrow(_sums_of(map_rows, d), "part binary")

    def add(batches):
        total = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total = np.frombuffer(blob) + (0 if total is None else total)
        if total is not None:
            yield _one(total.tobytes())

    got = _by_levels(parts, add, "whiten-sums").collect()
    return np.frombuffer(got[0].part).reshape(shape) if got else np.zeros(shape)


def _by_levels(parts: DataFrame, join, name: str) -> DataFrame:
    """Rows ``part`` brought together by ``join``, at most ``FAN`` a task, until one is left."""
    parts = durable(parts, name)
    left = parts.count()
    while left > 1:
        tasks = -(-left // FAN)
        dealt = parts.withColumn("turn", F.pmod(F.xxhash64("part"), F.lit(tasks))) if tasks > 1 else parts.withColumn("turn", F.lit(0))
        parts = durable(dealt.repartition(tasks, "turn").select("part").mapInArrow(join, "part binary"), name)
        now = parts.count()
        left = now if now < left else 1
    return parts


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 16) -> tuple[Whitening, float] | None:
    """The whitening of the distinct grid vectors, and the largest entry by which the whitened ones' covariance, summed
    over all of them, misses the identity. None without vectors."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vector_col).alias("v")).mapInArrow(_grid(scale, shift), "dim int, x binary")
    distinct = durable(rows.groupBy("dim", "x").agg(F.count("*").alias("times")), "whiten-distinct")
    lengths = distinct.groupBy("dim").agg(F.sum("times").alias("times")).orderBy(F.col("times").desc(), "dim").limit(1).collect()
    if not lengths:
        return None
    d = lengths[0].dim
    own = distinct.where(F.col("dim") == d).select("x")
    got = pickle.loads(_by_levels(own.mapInArrow(_spectra(d), "part binary"), _combined, "whiten-spectra").collect()[0].part)
    basis = np.linalg.qr(got.vectors)[0]
    start = Whitening(got.n, got.sums, basis, np.ones(d), 1.0, d)
    square = lambda y: y.T @ y
    projected = _summed(own, lambda x: square(start.centred(x) @ basis), d, (d, d)) / got.n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    order = np.argsort(values)[::-1]
    model = Whitening(got.n, [s + got.n * shift for s in got.sums], basis @ turn[:, order], values[order], float(np.trace(projected)), components)
    k = len(model.values)
    if not k:
        return model, 0.0
    sums = _summed(own, lambda x: np.c_[square(w := model.whitened(x + shift)), w.sum(0)[:, None]], d, (k, k + 1))
    mean = sums[:, k] / got.n
    return model, float(np.abs(sums[:, :k] / got.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """A row for each vector and component: its whitened coordinate, with what the fit says of all."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    got = fit(own, "v", scale, shift, components)
    if got is None or not len(got[0].values):
        return own.sparkSession.createDataFrame([], SCHEMA)
    model, error = got
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, rows = on_grid(batch.column(1), scale, shift)
            at = [i for i in np.flatnonzero(ok).tolist() if len(rows[i]) == d]
            for lo in range(0, len(at), 1024):
                part = at[lo : lo + 1024]
                x = np.array([rows[i] for i in part])
                m = len(part)
                again = np.repeat(np.arange(m), k)
                cols = [batch.column(0).take(pa.array(part)).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(again)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, SCHEMA)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
