"""Embedding whitening by a block Jacobi-Davidson solver.

1. *Pack*: every usable vector becomes whole numbers x = floor(scale * c) +
   shift; the vectors are staged as blocks of some megabytes, read by every
   later pass.
2. *Products*: the covariance V is never formed.  ``V @ W`` for a few columns
   W is one pass: a task sums Xc' (Xc W) over its blocks, centred before
   multiplying, and the sums are grouped by entry on the executors; the
   driver gets dimensions x columns numbers, whatever the number of rows.
3. *Solve*: Rayleigh-Ritz on a growing subspace; the correction equation of
   each pair that isn't settled is solved roughly by MINRES (one product a
   step for all pairs at once), projected against the settled vectors and the
   leading Ritz vectors.  Leading pairs are locked when their residual is at
   the rounding of double precision; a last Rayleigh-Ritz on the locked
   vectors gives the eigenvalues.
4. *Whiten*: a pass projects every centred vector; another sums the
   whitened vectors' covariance.

Defined cases: a vector that is null, empty, or holds null, non-finite or
huge entries (2^42 or more, whose x isn't exact as a double) is dropped, as
are vectors of another length than the commonest (the longer one on a tie).
Null ids and repeated rows count like any other row.  Components without
variance (at most 1e-12 of the largest) are left out, so equal vectors, one
vector or an empty table give no rows.  A deviation beyond a long is null.
Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release_memory, staged

SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**42)
PACK_BYTES = 4 << 20
COMPONENTS = 8
GUARD = 4  # Ritz vectors kept beside the wanted ones
INNER = 12  # MINRES steps of a correction at most
EPS = float(np.finfo(np.float64).eps)
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


# ---------------------------------------------------------------- packs
def packed(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """(staged blocks: ids, x as bytes of int64; dimensions, 0 if no vector is usable)."""
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", usable))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PACK_BYTES // (8 * dim))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = np.floor(np.asarray(pc.list_flatten(part.column("v"))) * scale).astype(np.int64) + shift
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    rows = rows.filter(F.size("v") == dim)
    return staged(rows.mapInArrow(run, "ids array<long>, x binary"), "vectors"), dim


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for ids, x in zip(b.column("ids"), b.column("x")):
            yield ids.values, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim)
    release_memory()


def _summed(packs: DataFrame, kind: str, of: Callable, dim: int) -> list:
    """The sum over all tasks of the vector ``of(blocks)``, entry by entry,
    added up by the executors."""
    arrow = pa.list_(pa.float64() if kind == "double" else pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([of(_blocks(batches, dim))], arrow)], ["part"])

    parts = packs.mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("i", "p"))
    got = {r["i"]: r["s"] for r in parts.groupBy("i").agg(F.sum("p").alias("s")).collect()}
    return [got[i] for i in range(len(got))]


@dataclass
class Centre:
    """The number of vectors and the exact sums of their entries."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], object)
        self.part = np.array([r / self.n for r in self.rest], np.float64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part is taken off exactly."""
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - sums)^2, exact; null beyond a long."""
        d = x - self.whole
        top = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if top * top * x.shape[1] < 2**63:
            e = d * self.n - self.rest.astype(np.int64)
            return np.einsum("ij,ij->i", e, e).tolist()
        e = d.astype(object) * self.n - self.rest
        return [int(v) if v < 2**63 else None for v in (e * e).sum(axis=1)]


def centre(packs: DataFrame, dim: int) -> Centre | None:
    """None without vectors."""
    low = 26  # bits; parts of a block can't overflow a long

    def of(blocks: Iterator) -> list[Decimal]:
        n, sums = 0, np.zeros(dim, object)
        for _, x in blocks:
            n += len(x)
            sums += (x >> low).sum(axis=0).astype(object) * (1 << low) + (x & ((1 << low) - 1)).sum(axis=0).astype(object)
        return [Decimal(n), *(Decimal(int(s)) for s in sums)]

    got = [int(v) for v in _summed(packs, "decimal(38,0)", of, dim)] if dim else []
    return Centre(got[0], got[1:]) if got and got[0] else None


class Covariance:
    """The covariance (divisor n) as an operator: ``V @ columns`` by a pass
    over the packs."""

    def __init__(self, packs: DataFrame, at: Centre, dim: int):
        self.packs, self.at, self.dim, self.passes = packs, at, dim, 0

    def __call__(self, columns: np.ndarray) -> np.ndarray:
        at = self.at

        def of(blocks: Iterator) -> list[float]:
            total = np.zeros(columns.shape)
            for _, x in blocks:
                c = at.centred(x)
                total += c.T @ (c @ columns)
            return total.ravel().tolist()

        self.passes += 1
        return np.array(_summed(self.packs, "double", of, self.dim)).reshape(columns.shape) / at.n

    def trace(self) -> float:
        at = self.at
        return _summed(self.packs, "double", lambda blocks: [float(sum((at.centred(x) ** 2).sum() for _, x in blocks))], self.dim)[0] / at.n

    def seen_through(self, directions: np.ndarray) -> np.ndarray:
        """The covariance of the projections on the given columns."""
        at, k = self.at, directions.shape[1]

        def of(blocks: Iterator) -> list[float]:
            total = np.zeros((k, k))
            for _, x in blocks:
                y = at.centred(x) @ directions
                total += y.T @ y
            return total.ravel().tolist()

        return np.array(_summed(self.packs, "double", of, self.dim)).reshape(k, k) / at.n


# ---------------------------------------------------------------- solver
def _without(columns: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The columns less their parts in the basis, taken off twice."""
    for _ in range(2):
        columns = columns - basis @ (basis.T @ columns)
    return columns


def _orthonormal(columns: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the given ones outside the basis; those
    that add nothing are left out."""
    out = basis
    for c in columns.T:
        size = np.linalg.norm(c)
        if size > 0:
            c = _without((c / size)[:, None], out)
            left = np.linalg.norm(c)
            if left > 1e-10:
                out = np.hstack([out, _without(c / left, out)])
                out[:, -1] /= np.linalg.norm(out[:, -1])
    return out[:, basis.shape[1]:]


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Rough solutions of ``product(X) = right``, a symmetric system for each
    column, side by side: until every residual is ``share`` of its right side."""
    tiny = np.finfo(np.float64).tiny
    beta = np.linalg.norm(right, axis=0)
    start, eta = np.maximum(beta, tiny), beta.copy()
    v, old = right / start, np.zeros_like(right)
    w0, w1, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c0 = c1 = np.ones(right.shape[1])
    s0 = s1 = np.zeros(right.shape[1])
    for _ in range(steps):
        u = product(v)
        delta = (v * u).sum(axis=0)
        new = u - delta * v - beta * old
        after = np.linalg.norm(new, axis=0)
        a0 = c1 * delta - c0 * s1 * beta
        a1 = np.sqrt(a0 * a0 + after * after)
        a2, a3 = s1 * delta + c0 * c1 * beta, s0 * beta
        live = (a1 > tiny) & (np.abs(eta) > tiny)
        safe = np.where(a1 > tiny, a1, 1)
        c2, s2 = a0 / safe, after / safe
        w = (v - a3 * w0 - a2 * w1) / safe
        x = np.where(live, x + c2 * eta * w, x)
        eta = np.where(live, -s2 * eta, 0)
        if (np.abs(eta) <= share * start).all():
            break
        w0, w1, c0, c1, s0, s1 = w1, w, c1, c2, s1, s2
        old, v, beta = v, new / np.maximum(after, tiny), after
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, want: int, *, guard: int = GUARD, inner: int = INNER,
                    seed: int = 7, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, residual norms) of
    the ``want`` leading pairs of a symmetric positive semidefinite operator.

    Residuals end at the rounding of double precision: 16 eps sqrt(dim) times
    the largest eigenvalue, or where four rounds lower them no more."""
    want = min(want, dim)
    width, most = min(dim, want + guard), min(dim, 6 * (want + guard))
    locked = np.zeros((dim, 0))
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dim, width)), locked)
    image, best, idle, largest = product(basis), np.inf, 0, float(np.finfo(np.float64).tiny)
    for _ in range(rounds):
        small = basis.T @ image
        theta, coords = np.linalg.eigh((small + small.T) / 2)
        theta, coords = theta[::-1], coords[:, ::-1]
        ritz, ritz_image = basis @ coords, image @ coords
        open_ = want - locked.shape[1]
        residual = _without(ritz_image[:, :open_] - ritz[:, :open_] * theta[:open_], locked)
        norms = np.linalg.norm(residual, axis=0)
        largest = max(theta[0], largest)
        floor = 16 * EPS * np.sqrt(dim) * largest
        idle = 0 if norms.max(initial=0) < 0.5 * best else idle + 1
        best = min(best, norms.max(initial=0))
        settled = norms <= (floor if idle < 4 else max(floor, 2 * best))
        done = int(np.argmin(settled)) if not settled.all() else len(settled)
        if done:
            locked = np.hstack([locked, _without(ritz[:, :done], locked)])
            locked /= np.linalg.norm(locked, axis=0)
            best, idle = np.inf, 0
        if locked.shape[1] == want:
            break
        keep = slice(done, None if ritz.shape[1] <= most - (want - locked.shape[1]) else done + width)
        basis, image, theta = ritz[:, keep], ritz_image[:, keep], theta[done:]
        todo = np.flatnonzero(norms[done:] > floor)
        out = np.hstack([locked, basis[:, :width]])
        values = theta[todo]
        right = -_without(residual[:, done:][:, todo], out)
        new = minres(lambda t: _without(product(t) - t * values, out), right, inner, 0.05)
        new = _orthonormal(np.hstack([_without(new, out), right]), np.hstack([locked, basis]))[:, : max(0, dim - locked.shape[1] - basis.shape[1])]
        if not new.shape[1]:
            idle += 1
            continue
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    found = locked if locked.shape[1] == want else np.hstack([locked, ritz[:, done: done + want - locked.shape[1]]])
    found = np.linalg.qr(found)[0]
    small = found.T @ (moved := product(found))
    values, coords = np.linalg.eigh((small + small.T) / 2)
    values, coords = values[::-1], coords[:, ::-1]
    found = found @ coords
    return values, found, np.linalg.norm(moved @ coords - found * values, axis=0)


# ---------------------------------------------------------------- operator
@dataclass
class Whitening:
    at: Centre
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float
    passes: int


def fit(packs: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of all packed vectors; None if nothing varies."""
    at = centre(packs, dim)
    if at is None:
        return None
    v = Covariance(packs, at, dim)
    trace = v.trace()
    if not trace > 0:
        return None
    values, vectors, residuals = jacobi_davidson(v, dim, components)
    keep = values > 1e-12 * values[0]
    values, vectors, residuals = values[keep], vectors[:, keep], residuals[keep]
    seen = v.seen_through(vectors / np.sqrt(values))
    return Whitening(at, values, vectors, residuals, trace, float(np.abs(seen - np.eye(len(values))).max()), v.passes)


def transform(packs: DataFrame, dim: int, fitted: Whitening | None) -> DataFrame:
    """A row per vector and component."""
    if fitted is None:
        return packs.sparkSession.createDataFrame([], OUT)
    at, k = fitted.at, len(fitted.values)
    directions, explained, error = fitted.vectors / np.sqrt(fitted.values), fitted.values / fitted.trace, fitted.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim):
            y, row = at.centred(x) @ directions, np.repeat(np.arange(len(x)), k)
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, at.n, np.int64)),
                 pa.array(at.deviations(x), pa.int64()).take(pa.array(row)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(n, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packs.mapInArrow(run, OUT)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all usable vectors and whiten each of them."""
    packs, dim = packed(df, id_col, vec_col)
    return transform(packs, dim, fit(packs, dim, components))
