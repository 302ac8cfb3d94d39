"""Embedding whitening: covariance by streaming rank-one updates, eigenvectors by symmetric QR.

Whole numbers. Each entry c becomes ``x = floor(64 * c) + 1000000``; the fit list holds each distinct x once, so copies of
a vector weigh nothing extra. It is a table in the shared folder while both passes over it run.

Fit. A task streams its part of the list through Welford's update: the row ``k`` adds the rank-one matrix of its
difference from the mean so far, times ``(k - 1) / k``. Entries are counted from the task's own first row, so running
sums are exact and differences lose nothing to the size of x. States of tasks meet by the parallel formula
``M = Ma + Mb + outer(delta, delta) * na * nb / n``, in rounds of groups, so that no task and not the driver holds more
than a few of them. The covariance is ``M / n``; its eigenvectors come from Householder's tridiagonal form and implicit
QR steps with Wilkinson shifts.

Result. A second pass streams the whitened list through the same update; the largest entry by which its covariance
differs from the identity is ``identity_error``, measured and not derived. Then every row is projected, without a shuffle.

Defined cases: vectors that are null, empty or hold a null, NaN or infinite entry take no part, neither do those with
an entry whose x is beyond ``LARGEST``; vectors of one length are whitened among themselves, each length with its own
``n`` (one matrix per length is held, ``identity_error`` is the largest of all); directions without variance (below
``FLAT`` of the largest) are no components, so a list of one vector gives no rows; repeated rows each get their rows, a
null vec_id stays null; ``deviation`` is null where it does not fit a LONG; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard, written
from .common import table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Largest magnitude of ``floor(64 * c)``: sums over four billion rows stay exact.
LARGEST = float(1 << 31)
#: A direction with less than this share of the largest variance has none but rounding.
FLAT = 1e-12
#: Groups in which states of tasks meet, round by round.
ROUNDS = (256, 16, 1)
#: Entries of vectors that are taken into doubles at once.
ENTRIES_AT_ONCE = 1 << 20
STATE = "d int, part int, n long, origin binary, sums binary, products binary"


# ---- moments ------------------------------------------------------------------------------------------------


@dataclass
class Moments:
    """n rows: ``origin``, sums of the rows' differences from it, and products of differences from their mean."""

    n: int
    origin: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    @classmethod
    def starting_at(cls, row: np.ndarray) -> Moments:
        d = len(row)
        return cls(0, row.copy(), np.zeros_like(row), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's updates by ``rows`` one after the other; their rank-one matrices are added in one product."""
        own = rows - self.origin
        running = self.sums + np.cumsum(own, axis=0)
        before = np.concatenate((self.sums[None, :], running[:-1]))
        k = np.arange(self.n, self.n + len(rows), dtype=np.float64)[:, None]  # rows before each
        delta = own - before / np.maximum(k, 1)
        delta *= np.sqrt(k / (k + 1))
        self.products += delta.T @ delta
        self.sums, self.n = running[-1], self.n + len(rows)

    def merge(self, other: Moments) -> None:
        """The parallel formula."""
        shift = other.origin - self.origin
        delta = shift + other.sums / other.n - self.sums / self.n
        n = self.n + other.n
        self.products += other.products
        self.products += np.outer(delta, delta) * (self.n * other.n / n)
        self.sums, self.n = self.sums + other.sums + other.n * shift, n

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


def _packed(states: list[tuple[int, int, Moments]]) -> pa.RecordBatch:
    columns = [
        pa.array([d for d, _, _ in states], pa.int32()), pa.array([p for _, p, _ in states], pa.int32()),
        pa.array([m.n for _, _, m in states], pa.int64()),
        *(pa.array([getattr(m, f).tobytes() for _, _, m in states], pa.binary()) for f in ("origin", "sums", "products")),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["d", "part", "n", "origin", "sums", "products"])


def _unpacked(row: dict, kind) -> Moments:
    own, sums = (np.frombuffer(row[f], kind) for f in ("origin", "sums"))
    return Moments(row["n"], own, sums, np.frombuffer(row["products"], np.float64).reshape(len(own), -1).copy())


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of the vectors of a batch, so many at once."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at, step = np.flatnonzero(sizes == d), max(1, ENTRIES_AT_ONCE // int(d))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            yield int(d), some, flat[starts[some][:, None] + np.arange(d)]


def moments(vectors: DataFrame, projected=None) -> dict[int, Moments]:
    """Moments of column ``x`` for each length ``d``; of ``projected(d, rows)`` where that is given."""
    kind = np.int64 if projected is None else np.float64

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: dict[int, Moments] = {}
        for batch in batches:
            for d, _, rows in _blocks(batch.column(0)):
                rows = rows if projected is None else projected(d, rows)
                if rows.shape[1]:
                    if d not in own:
                        own[d] = Moments.starting_at(rows[0] if projected is None else np.zeros(rows.shape[1]))
                    own[d].add(rows)
        part = TaskContext.get().partitionId()
        for d, m in own.items():
            yield _packed([(d, part, m)])

    def met(states: pa.Table) -> pa.Table:
        first, *more = states.to_pylist()
        whole = _unpacked(first, kind)
        for row in more:
            whole.merge(_unpacked(row, kind))
        return pa.Table.from_batches([_packed([(first["d"], first["part"], whole)])])

    found = vectors.select("x").mapInArrow(stream, STATE)
    for groups in ROUNDS:
        found = found.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("d", "part").applyInArrow(met, STATE)
    return {r.d: _unpacked(r.asDict(), kind) for r in found.collect()}


# ---- symmetric QR -------------------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, q) with ``a = q @ T @ q.T``, by Householder reflections."""
    a = np.array(a, dtype=np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        p -= v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, v[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    d, e, q = tridiagonal(a)
    rows = q.T.copy()  # eigenvectors as rows: a rotation changes two of them
    eps, hi = np.finfo(np.float64).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        cuts = np.flatnonzero(e[:hi] == 0)
        lo = cuts[-1] + 1 if len(cuts) else 0
        gap = (d[hi - 1] - d[hi]) / 2  # Wilkinson: the eigenvalue of the last two rows that is nearer to the last
        shift = d[hi] - e[hi - 1] * (e[hi - 1] / (gap + np.copysign(np.hypot(gap, e[hi - 1]), gap)))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # chases the bulge down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a0, a1, b = d[k], d[k + 1], e[k]
            d[k] = c * c * a0 + 2 * c * s * b + s * s * a1
            d[k + 1] = s * s * a0 - 2 * c * s * b + c * c * a1
            e[k] = c * s * (a1 - a0) + (c * c - s * s) * b
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = c * rows[k] + s * rows[k + 1]
            rows[k + 1] = c * rows[k + 1] - s * rows[k]
            rows[k] = upper
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


# ---- the operator -------------------------------------------------------------------------------------------


@dataclass
class Whitener:
    """Of vectors of one length: exact sums over the fit list, and the directions that have variance."""

    n: int
    origin: np.ndarray
    sums: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, m: Moments, components: int) -> Whitener:
        v = m.covariance()
        values, vectors = symmetric_qr(v)
        keep = values[:components] > max(FLAT * values[0], 0)
        values, vectors = values[:components][keep], vectors[:, :components][:, keep]
        return cls(m.n, m.origin, m.sums, vectors / np.sqrt(values), values / max(np.trace(v), 1e-300))

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        return self.n * (rows - self.origin) - self.sums

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of squares of ``scaled``; whole-number arithmetic wraps, so it is right wherever the sum fits."""
        own = self.scaled(rows)
        about = (own.astype(np.float64) ** 2).sum(axis=1)
        exact = (own * own).sum(axis=1)
        return [int(x) if a < 9.2e18 else _long(own[i]) for i, (x, a) in enumerate(zip(exact, about, strict=True))]

    def project(self, rows: np.ndarray) -> np.ndarray:
        return (self.scaled(rows) / self.n) @ self.directions


def _long(row: np.ndarray) -> int | None:
    whole = sum(int(x) ** 2 for x in row)
    return whole if whole < 1 << 63 else None


def whole_numbers(v: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The x vector of a usable vector, else null."""
    v = v.cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST / scale))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~odd, F.transform(v, lambda c: F.floor(c * scale) + F.lit(shift).cast("long")))


def whiten(vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per usable vector and component."""
    picked = vectors.select(F.col(id_name).alias("vec_id"), whole_numbers(F.col(vector_name)).alias("x")).filter("x is not null")
    distinct, at = written(picked.select("x").distinct(), "whitening")
    by_length = {d: Whitener.of(m, components) for d, m in moments(distinct).items()}
    again = moments(distinct, projected=lambda d, rows: by_length[d].project(rows))
    error = max((float(np.abs(m.covariance() - np.eye(len(m.sums))).max()) for m in again.values()), default=0.0)
    discard(vectors.sparkSession, at)
    kept = picked.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, places, rows in _blocks(batch.column(1)):
                w = by_length[d]
                c = len(w.explained)
                of = np.repeat(np.arange(len(places)), c)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(places[of])), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(places))),
                        pa.array(np.full(len(of), w.n, dtype=np.int64)), pa.array(w.deviations(rows), pa.int64()).take(pa.array(of)),
                        pa.array(w.project(rows).ravel()), pa.array(np.tile(w.explained, len(places))), pa.array(np.full(len(of), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return picked.mapInArrow(run, f"vec_id {kept}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
