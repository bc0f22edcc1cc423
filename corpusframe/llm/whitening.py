"""Embedding whitening by incremental eigendecomposition.

Every partition keeps a spectrum of its own (rows seen, their mean, eigenvalues and eigenvectors of the centred
scatter) and feeds it centred rank-one updates: the eigenvalues of ``D + z z'`` are the roots of the secular
equation, and entries that cannot move a root are deflated first. Spectra of partitions are combined the same
way, one rank-one update for each direction of the other spectrum and one for the distance of the means, in
groups of ``FAN`` per round of Spark. The result is the start basis of a Rayleigh-Ritz step: one more pass
projects all rows, centred by their exact mean, on that basis; the eigenvectors of the small projected
covariance turn the basis into components exact to double precision.

A chunk of rows is first turned into a triangle with the same scatter (QR), so the number of updates is that of
dimensions per chunk and not that of rows; everything else is as named. Entries enter as whole numbers
(``floor(1024 * c) + 100000``), so counts, sums and deviations are exact.

Rows whose vector is null or holds a null or non-finite entry are left out; so are vectors whose size is not
the most frequent one (ties: the larger size). No rows at all make no result. Repeated rows and ids count as
often as they stand there; a null id is kept. A component without variance whitens to 0. A deviation beyond a
64-bit integer is null. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.llm.common import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of one QR; partial results merged by one task.
CHUNK = 4096
FAN = 16
SCALE = 1024
SHIFT = 100_000
EPS = float(np.finfo(float).eps)


# ---- one rank-one update ------------------------------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) as (index of the nearest pole, distance from it): ``d`` strictly rises, ``z2`` is positive.

    Root i lies between d[i] and d[i + 1], the last one below d[-1] + sum(z2). All are sought at once, by Newton
    steps on the function freed of its two poles, kept inside a bracket by bisection.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    middle = d + gap / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(1)
    left = (at_middle >= 0) | (np.arange(k) == k - 1)
    pole = np.where(left, np.arange(k), np.arange(k) + 1)
    away = d[None, :] - d[pole][:, None]
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(at_middle >= 0, gap / 2, gap), 0.0)
    near, far = np.where(left, 0.0, -gap), np.where(left, gap, 0.0)
    x = (low + high) / 2
    for _ in range(80):
        r = 1.0 / (away - x[:, None])
        f = 1 + r @ z2
        done = np.abs(f) <= 4 * EPS * (1 + np.abs(r) @ z2)
        if done.all():
            break
        slope = (r * r) @ z2
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        a, b = x - near, far - x
        h, dh = f * a * b, slope * a * b + f * (b - a)
        step = x - h / np.where(dh == 0, 1.0, dh)
        x = np.where(done, x, np.where((step > low) & (step < high), step, (low + high) / 2))
    return pole, x


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``u diag(d) u' + v v'``; ``d`` rises."""
    z = u.T @ v
    norm = float(np.sqrt(z @ z))
    if norm == 0.0:
        return d, u
    u = u.copy()
    tol = 8 * EPS * max(float(np.abs(d[-1])), norm * norm)
    # deflation 1: of two eigenvalues that agree, a rotation takes one out of the update
    last = -1
    for i in np.flatnonzero(np.abs(z) * norm > tol).tolist():
        if last >= 0 and d[i] - d[last] <= tol:
            r = float(np.hypot(z[i], z[last]))
            c, s = z[i] / r, z[last] / r
            a, b = u[:, last].copy(), u[:, i].copy()
            u[:, i], u[:, last] = c * b + s * a, c * a - s * b
            z[i], z[last] = r, 0.0
        last = i
    # deflation 2: entries too small to move their eigenvalue
    live = np.flatnonzero(np.abs(z) * norm > tol)
    if not len(live):
        return d, u
    dl, zl = d[live], z[live]
    pole, off = secular_roots(dl, zl * zl)
    # distances of all roots from all poles, without cancellation; the update that has exactly these roots
    dist = (dl[pole] - dl[:, None]) + off
    ratio = dist / np.where(np.eye(len(live), dtype=bool), 1.0, dl[None, :] - dl[:, None])
    zh = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(zl)
    w = zh[:, None] / dist
    w /= np.sqrt((w * w).sum(0))
    d = d.copy()
    d[live] = dl[pole] + off
    u[:, live] = u[:, live] @ w
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


# ---- spectra ------------------------------------------------------------------------------------------------------------------

def empty_spectrum(dim: int) -> tuple:
    return 0, np.zeros(dim), np.zeros(dim), np.eye(dim)


def absorb(spectrum: tuple, n2: int, mean2: np.ndarray, directions: np.ndarray) -> tuple:
    """``spectrum`` with ``n2`` rows of mean ``mean2`` more, whose centred scatter is that of the rows ``directions``."""
    n, mean, d, u = spectrum
    if not n2:
        return spectrum
    for v in directions:
        d, u = rank_one(d, u, v)
    if n:
        d, u = rank_one(d, u, (mean2 - mean) * np.sqrt(n * n2 / (n + n2)))
    return n + n2, mean + (mean2 - mean) * (n2 / (n + n2)), d, u


def add_rows(spectrum: tuple, x: np.ndarray) -> tuple:
    mean = x.mean(0)
    centred = x - mean
    return absorb(spectrum, len(x), mean, np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred)


def merged(spectra: list[tuple]) -> tuple:
    out = spectra[0]
    for n, mean, d, u in spectra[1:]:
        out = absorb(out, n, mean, np.sqrt(np.maximum(d, 0))[:, None] * u.T)
    return out


def pack(spectrum: tuple) -> bytes:
    n, mean, d, u = spectrum
    return np.concatenate([[float(n)], mean, d, u.ravel()]).tobytes()


def unpack(raw: bytes, dim: int) -> tuple:
    a = np.frombuffer(raw)
    return int(a[0]), a[1:1 + dim], a[1 + dim:1 + 2 * dim], a[1 + 2 * dim:].reshape(dim, dim)


# ---- passes -------------------------------------------------------------------------------------------------------------------

def usable(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    return df.filter(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def whole(batch: pa.RecordBatch, at: int, dim: int) -> np.ndarray:
    """Vectors of a batch as whole numbers, without the shift."""
    flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -2.0 ** 45, 2.0 ** 45).astype(np.int64).reshape(-1, dim)


def chunked(batches, dim: int, rows: int):
    """Whole-number rows of all batches, ``rows`` at a time."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(whole(batch, 0, dim))
            n += batch.num_rows
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def gathered(vectors: DataFrame, start, merge, step=None) -> bytes | None:
    """``start`` makes one block of bytes of every partition; ``merge`` makes one of up to FAN; rounds of Spark leave one in all."""
    def first(batches):
        out = start(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out], pa.binary())], names=["part", "raw"])

    def again(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        return pa.table({"part": pa.array([rows["part"][0].as_py() // FAN], pa.int64()), "raw": pa.array([merge(rows["raw"].to_pylist())], pa.binary())})
    parts = durable(vectors.mapInArrow(first, "part long, raw binary"))
    most = parts.agg(F.max("part")).head()[0]
    if most is None:
        return None
    while most:
        parts = durable(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(again, "part long, raw binary"))
        most //= FAN
    return bytes(parts.head()["raw"])


def summed(dtype):
    def merge(raws: list[bytes]) -> bytes:
        return np.sum([np.frombuffer(r, dtype) for r in raws], axis=0, dtype=dtype).tobytes()
    return merge


class Whitening:
    """Rows, exact sums (of shifted numbers), eigenvalues and components (columns) by falling eigenvalue, total variance."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, total: float):
        self.n, self.sums, self.values, self.vectors, self.total = n, sums, values, vectors, total

    @property
    def dim(self) -> int:
        return len(self.sums)

    def matrix(self, components: int) -> np.ndarray:
        """Centred rows times this are whitened; a direction without variance becomes 0."""
        e = self.values[:components]
        alive = e > self.dim * EPS * max(float(self.values[0]), 0.0)
        return self.vectors[:, :components] * np.where(alive, 1 / np.sqrt(np.where(alive, e, 1.0)), 0.0)


def common_size(df: DataFrame, vector: str) -> int | None:
    top = usable(df, vector).groupBy(F.size(F.col(f"`{vector}`")).alias("size")).count().filter("size > 0").orderBy(F.desc("count"), F.desc("size")).head()
    return top["size"] if top else None


def sized(df: DataFrame, vector: str, dim: int) -> DataFrame:
    return usable(df, vector).filter(F.size(F.col(f"`{vector}`")) == dim)


def partition_spectrum(dim: int, rows: int):
    def start(batches):
        out = empty_spectrum(dim)
        for x in chunked(batches, dim, rows):
            out = add_rows(out, x.astype(np.float64))
        return pack(out) if out[0] else None
    return start


def fit(df: DataFrame, vector: str = "embedding", chunk: int = CHUNK) -> Whitening | None:
    """The whitening of all usable vectors of ``df``; None when there are none."""
    dim = common_size(df, vector)
    if dim is None:
        return None
    vectors = sized(df, vector, dim).select(vector)

    def sums(batches):
        n, total = 0, np.zeros(dim, np.int64)
        for x in chunked(batches, dim, chunk):
            n, total = n + len(x), total + x.sum(0)
        return np.concatenate([[n], total]).astype(np.int64).tobytes() if n else None
    counted = np.frombuffer(gathered(vectors, sums, summed(np.int64)), np.int64)
    n, total = int(counted[0]), counted[1:].copy()
    spectrum = unpack(gathered(vectors, partition_spectrum(dim, chunk), lambda raws: pack(merged([unpack(r, dim) for r in raws]))), dim)
    basis = np.linalg.qr(spectrum[3][:, ::-1])[0]

    def projected(batches):
        out, some = np.zeros((dim, dim)), False
        for x in chunked(batches, dim, chunk):
            y = ((x * n - total) / n) @ basis
            out, some = out + y.T @ y, True
        return out.tobytes() if some else None
    small = np.frombuffer(gathered(vectors, projected, summed(np.float64))).reshape(dim, dim) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    components = basis @ turn[:, ::-1]
    components = components * np.where(components[np.abs(components).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)
    return Whitening(n, total + n * SHIFT, values[::-1].copy(), components, float(np.trace(small)))


def identity_error(df: DataFrame, model: Whitening, components: int, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    dim, n, total, matrix = model.dim, model.n, model.sums - model.n * SHIFT, model.matrix(components)
    k = matrix.shape[1]

    def moments(batches):
        out, some = np.zeros((k + 1, k)), False
        for x in chunked(batches, dim, CHUNK):
            w = ((x * n - total) / n) @ matrix
            out, some = out + np.vstack([w.T @ w, w.sum(0)]), True
        return out.tobytes() if some else None
    raw = np.frombuffer(gathered(sized(df, vector, dim).select(vector), moments, summed(np.float64))).reshape(k + 1, k) / n
    return float(np.abs(raw[:k] - np.outer(raw[k], raw[k]) - np.eye(k)).max())


def deviations(away: np.ndarray) -> pa.Array:
    """Exact sum of squares of each row of whole numbers; null beyond 64 bits."""
    if len(away) and float(np.abs(away).max()) ** 2 * away.shape[1] < 2.0 ** 62:
        return pa.array((away * away).sum(1), pa.int64())
    exact = [sum(int(a) * int(a) for a in row) for row in away]
    return pa.array([e if e < 2 ** 63 else None for e in exact], pa.int64())


def whitened(df: DataFrame, model: Whitening, components: int = 8, key: str = "vec_id", vector: str = "embedding", error: float | None = None) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error: one row per usable row of ``df`` and component.

    ``error`` is the model's ``identity_error`` on the fit list where that is known already; else it is taken over ``df``.
    """
    dim, n, total, matrix = model.dim, model.n, model.sums - model.n * SHIFT, model.matrix(components)
    k = matrix.shape[1]
    explained = [float(e / model.total) if model.total > 0 else 0.0 for e in model.values[:k]]
    error = identity_error(df, model, components, vector) if error is None else error
    rows = sized(df, vector, dim).select(key, vector)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names[4:]]])

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            away = whole(batch, 1, dim) * n - total
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviations(away).take(each),
                pa.array(((away / n) @ matrix).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names=names)
    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Fit on all usable rows of ``df`` and whiten them."""
    model = fit(df, vector)
    if model is None:
        nothing = Whitening(1, np.full(1, SHIFT, np.int64), np.ones(1), np.eye(1), 1.0)
        return whitened(df.filter(F.lit(False)), nothing, components, key, vector, error=0.0)
    return whitened(df, model, components, key, vector)
