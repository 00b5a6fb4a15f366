"""Embedding whitening.

Vectors become whole numbers; components are the eigenvectors of their covariance. Every partition keeps the spectrum of its
own centred scatter up to date by rank-one updates: the secular equation gives the new eigenvalues, directions that an
update doesn't touch, or that share an eigenvalue, are deflated. Spectra are then combined, each eigenpair of one being a
rank-one update of the other, in a tree of tasks. In the basis so found a last pass over all vectors measures their
covariance, whose own eigenvectors (Rayleigh-Ritz) correct what rounding and order have left in the basis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.llm.common import stored

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned.
COMPONENTS = 32
#: Centred rows of a block are first turned by an orthogonal transform, which leaves at most as many rows as there are
#: dimensions and the same scatter; each of these is a rank-one update. 1: every vector is an update of its own.
BLOCK = 2048
#: Spectra that a task combines.
FAN = 16
_EPS = np.finfo(float).eps


def secular(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """d rising and distinct, w positive -> matrix of d[i] - mu[j], mu being the roots of 1 + sum(w / (d - mu)).

    One root lies behind each d. It is measured from the nearer pole, so that the small difference keeps its digits; steps
    interpolate the poles on either side and fall back on halving the bracket."""
    k, total = len(d), w.sum()
    gap = np.append(np.diff(d), total)
    own = np.arange(k)
    middle = d + gap / 2
    left = 1 + (w / (d - middle[:, None])).sum(1) >= 0
    left[-1] = True
    delta = d - d[np.where(left, own, np.minimum(own + 1, k - 1))][:, None]
    lo, hi = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    hi[-1] = total
    tau, low = (lo + hi) / 2, np.tri(k, dtype=bool)
    for _ in range(80):
        away = delta - tau[:, None]
        term = w / away
        slope = term / away
        psi, dpsi = np.where(low, term, 0).sum(1), np.where(low, slope, 0).sum(1)
        phi, dphi = np.where(low, 0, term).sum(1), np.where(low, 0, slope).sum(1)
        f = 1 + psi + phi
        lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
        done = (np.abs(f) <= 4 * k * _EPS * (1 + np.abs(psi) + np.abs(phi))) | (hi - lo <= 2 * _EPS * np.abs(tau))
        if done.all():
            break
        a = away[own, own]
        b = np.append(away[own[:-1], own[1:]], 1.0)
        s, r = a * a * dpsi, psi - a * dpsi
        big_s, big_r = b * b * dphi, phi - b * dphi
        c = 1 + r + big_r
        p, q = c * (a + b) + s + big_s, a * b * f
        root = np.sqrt(np.maximum(0, p * p - 4 * c * q))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] + s[-1] / c[-1]
        new = tau + step
        tau = np.where(done, tau, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return (delta - tau[:, None]).T


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of basis diag(values) basis' + v v'."""
    z = basis.T @ v
    norm = float(z @ z)
    if norm == 0 or not len(values):
        return values, basis
    tol = 8 * _EPS * max(values[-1], norm)
    active = np.flatnonzero(np.abs(z) * np.sqrt(norm) > tol)
    values, basis = values.copy(), basis.copy()
    if (np.diff(values[active]) <= tol).any():
        kept: list[int] = []
        for i in active:
            if kept and values[i] - values[kept[-1]] <= tol:  # the pair is turned so that the update meets one of them only
                j = kept.pop()
                r = float(np.hypot(z[i], z[j]))
                c, s = z[i] / r, z[j] / r
                z[i], z[j] = r, 0.0
                basis[:, [j, i]] = basis[:, [j, i]] @ np.array([[c, s], [-s, c]])
                values[j], values[i] = values[j] * c * c + values[i] * s * s, values[j] * s * s + values[i] * c * c
            kept.append(int(i))
        active = np.array(kept)
        active = active[np.argsort(values[active], kind="stable")]
    if len(active):
        d, w = values[active], z[active] ** 2
        away = secular(d, w)
        # the z that has exactly these roots, so that the eigenvectors are orthogonal to rounding
        spread = d[:, None] - d
        np.fill_diagonal(spread, 1.0)
        again = np.sqrt(np.abs(np.prod(away / spread, axis=1))) * np.sign(z[active])
        turn = again[:, None] / away
        turn /= np.sqrt((turn * turn).sum(0))
        values[active] = d - np.diagonal(away)
        basis[:, active] = basis[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return np.maximum(values[order], 0), basis[:, order]


def combined(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum of two scatters around the same mean."""
    values, basis = one
    for value, v in zip(other[0], other[1].T):
        if value > 0:
            values, basis = rank_one(values, basis, np.sqrt(value) * v)
    return values, basis


def finite_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), of the rows whose vector has neither nulls nor numbers that aren't finite."""
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ok).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The x of a batch of vectors of d entries as long integers; beyond 2**62 they stop there."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    return np.clip(np.floor(SCALE * flat), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Dimensions, n and the sums of x by dimension, of the most frequent length of vectors (the greater of two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                x = matrix(batch.column(0).filter(pa.array(sizes == d)), int(d))
                exact = x.sum(0) if not x.size or np.abs(x).max() < 2**62 // len(x) else x.astype(object).sum(0)
                n, s = found.get(int(d), (0, [0] * int(d)))
                found[int(d)] = (n + len(x), [a + int(b) for a, b in zip(s, exact)])
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1)), pa.array(range(-1, d)), pa.array([str(n), *map(str, s)])], names=["d", "i", "s"])

    parts = rows.select("v").mapInArrow(run, "d long, i long, s string")
    totals = stored(parts.groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    best = totals.filter("i = -1").orderBy(F.desc("s"), F.desc("d")).limit(1).collect()
    if not best:
        return 0, 0, []
    own = totals.filter(F.col("d") == best[0].d).orderBy("i").collect()
    return best[0].d, int(own[0].s), [int(r.s) for r in own[1:]]


def spread(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, as long integers where their squares' sum fits, as Python's otherwise."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, s), default=0)
    if most < 2**62:
        out = n * x - np.array(s, np.int64)
        if x.shape[1] * int(np.abs(out).max(initial=0)) ** 2 < 2**63:
            return out
    return n * x.astype(object) - np.array(s, object)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    return (spread(x, n, s) / n).astype(float)


def spectra(rows: DataFrame, d: int, n: int, s: list[int], block: int = BLOCK) -> DataFrame:
    """part, spectrum: for each partition the eigenvalues and eigenvectors of its scatter around the mean of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, any_rows = (np.zeros(d), np.eye(d)), False
        for batch in batches:
            c = centred(matrix(batch.column(0), d), n, s)
            for a in range(0, len(c), block):
                any_rows = True
                for v in c[a : a + block] if block <= 1 else np.linalg.qr(c[a : a + block], mode="r"):
                    found = rank_one(*found, v)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([found[0], found[1].ravel()])])], names=["spectrum"])

    out = rows.select("v").mapInArrow(run, "spectrum array<double>")
    return out.select(F.spark_partition_id().cast("long").alias("part"), "spectrum")


def combined_spectra(parts: DataFrame, d: int, fan: int = FAN) -> np.ndarray:
    """The eigenvectors of the sum of all scatters: each task combines `fan` spectra, level by level, until one is left."""

    def unpacked(x) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(x)
        return x[:d], x[d:].reshape(d, d)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = [unpacked(x) for _, x in sorted(zip(group["part"], group["spectrum"]), key=lambda p: p[0])]
        found = own[0]
        for more in own[1:]:
            found = combined(found, more)
        return pd.DataFrame({"part": [group["part"].iloc[0] // fan], "spectrum": [np.concatenate([found[0], found[1].ravel()])]})

    while parts.count() > 1:
        group = F.floor(F.col("part") / fan).cast("long")
        parts = stored(parts.groupBy(group.alias("g")).applyInPandas(run, "part long, spectrum array<double>"), "spectra")
    return np.linalg.qr(unpacked(parts.first().spectrum)[1])[0]


def second_moment(rows: DataFrame, d: int, n: int, s: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean products and means of the centred vectors' coordinates in the basis, summed by partition, then by place."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = centred(matrix(batch.column(0), d), n, s) @ basis
            total += np.vstack([y.T @ y, y.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size)), pa.array(total.ravel())], names=["i", "t"])

    rows = rows.select("v").mapInArrow(run, "i long, t double").groupBy("i").agg(F.sum("t").alias("t")).orderBy("i").collect()
    total = np.array([r.t for r in rows]).reshape(k + 1, k) / n
    return total[:k], total[k]


def fitted(rows: DataFrame, d: int, n: int, s: list[int], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and its unit eigenvectors with the largest coordinate positive."""
    basis = combined_spectra(stored(spectra(rows, d, n, s, block), "spectra"), d)
    products, means = second_moment(rows, d, n, s, basis)
    values, turn = np.linalg.eigh(products - np.outer(means, means))
    vectors = (basis @ turn)[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(d)])
    return np.maximum(values[::-1], 0), vectors


def whitened(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error; a row for each
    usable vector and component.

    Vectors that are null or hold nulls or numbers that aren't finite are left out, and so are those of another length than
    the most frequent one. There are as many components as dimensions at most; of those without variance (constant columns,
    fewer vectors than dimensions) whitened is null and explained 0, and identity_error tells about the others (null if
    there are none). deviation is null where it exceeds a long. Repeated and null vec_ids count and come back row by row;
    equal eigenvalues take any basis of theirs, the same for all rows; other columns are ignored; no rows give none."""
    rows = finite_rows(vectors)
    d, n, s = sums(rows)
    rows = rows.filter(F.size("v") == d)
    k = min(components, d)
    schema = StructType([rows.schema["vec_id"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if not k:
        return rows.limit(0).select("vec_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema[1:]])
    values, basis = fitted(rows, d, n, s, block)
    some = int((values[:k] > d * _EPS * values[0]).sum())
    scaled = basis[:, :some] / np.sqrt(values[:some])
    error = None
    if some:
        products, means = second_moment(rows, d, n, s, scaled)
        error = float(np.abs(products - np.outer(means, means) - np.eye(some)).max())
    explained = [float(v / values.sum()) if i < some else 0.0 for i, v in enumerate(values[:k])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                m, out = part.num_rows, np.full((part.num_rows, k), np.nan)
                wide = spread(matrix(part.column(1), d), n, s)
                out[:, :some] = (wide / n).astype(float) @ scaled
                far = (wide * wide).sum(1).tolist()
                far = pa.array([v if v < 2**63 else None for v in far], pa.int64())
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), far.take(again),
                    pa.array(out.ravel(), mask=np.isnan(out.ravel())), pa.array(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
