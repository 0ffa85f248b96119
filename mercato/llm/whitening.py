"""Operator 13: whitening of embeddings by incremental eigendecomposition.

The distinct vectors are dealt into blocks. A block keeps the spectrum (count,
mean, eigenvalues and eigenvectors) of the scatter of what it has seen; each
further vector is a centred rank-one update of it: the secular equation is solved
for all eigenvalues at once, after deflation of equal eigenvalues and of directions
the update has no part in. Spectra of blocks are combined, in rounds of 16, by the
same updates: one for each eigenpair of the other, one for the difference of the
means. The last one's eigenvectors are the basis of a Rayleigh-Ritz refinement over
all blocks, which gives the components to double precision.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import parts_for, written

#: Vectors in a block, and spectra or moments combined by one task.
BLOCK = 2048
FANOUT = 16
#: 64 times an entry is held within these ends, where sums of a block are exact.
MOST = 2.0**50
EPS, TINY = np.finfo(float).eps, np.finfo(float).tiny
SPECTRUM = "part long, n long, sums array<decimal(38,0)>, mean binary, values binary, vectors binary"
MOMENTS = "part long, n long, mean binary, second binary"


def entries(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and x, the long floor(64 * c) + 1000000 of each entry c, of the rows whose vectors are whole."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    rows = rows.where(F.col("c").isNotNull() & F.forall(
        "c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = F.transform("c", lambda c: (F.floor(F.greatest(F.least(c * 64.0, F.lit(MOST)), F.lit(-MOST))) + 1_000_000).cast("long"))
    return rows.select("vec_id", held.alias("x"))


def matrix(lists, dims: int) -> np.ndarray:
    """Rows of longs; a missing entry is that of c = 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(size), dims), 1_000_000, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def secular(poles: np.ndarray, z: np.ndarray):
    """The roots of 1 + sum(z_j^2 / (pole_j - root)) over rising, distinct poles and nonzero z: for each root its nearer
    pole and its distance from that. One root lies between each two poles, one above the last.

    Each step puts a rational function with poles at both ends through value and
    slope of either half of the sum and takes its root; where that leaves the
    bracket, the bracket is halved.
    """
    k = len(poles)
    square = z * z
    width = np.r_[np.diff(poles), square.sum() * (1 + 4 * EPS)]  # of each root's bracket, from the pole below
    f = 1 + (square / (poles[None, :] - poles[:, None] - width[:, None] / 2)).sum(axis=1)
    above = (f < 0) & (np.arange(k) < k - 1)  # f rises: the root is in the upper half where f < 0 in the middle
    near = np.arange(k) + above
    at = poles[None, :] - poles[near][:, None]  # of each pole from each root's origin
    p, q = np.where(above, -width, 0), np.where(above, 0, width)
    low, high = np.where(f < 0, (p + q) / 2, p), np.where(f < 0, q, (p + q) / 2)
    q[-1] = np.inf
    x = (low + high) / 2
    left = np.tri(k)
    for _ in range(60):
        gap = at - x[:, None]
        term = square / gap
        slope = term / gap
        total = term.sum(axis=1)
        below = np.einsum("ij,ij->i", term, left)
        value = 1 + total
        done = np.abs(value) <= 8 * EPS * (1 + total - 2 * below)  # as near as this sum of two signs can tell
        if done.all():
            break
        low, high = np.where(value < 0, x, low), np.where(value >= 0, x, high)
        s_below = np.einsum("ij,ij->i", slope, left)
        s_above = slope.sum(axis=1) - s_below
        b = s_below * (p - x) ** 2
        with np.errstate(all="ignore"):
            e = np.where(np.isinf(q), 0, s_above * (q - x) ** 2)
            c = 1 + (below - b / (p - x)) + (value - 1 - below - np.where(np.isinf(q), 0, e / (q - x)))
            # c + b / (p - y) + e / (q - y) = 0
            far = np.where(np.isinf(q), 0, q)
            two, one, none = c, c * (p + far) + b + e, c * p * far + b * far + e * p
            root = np.sqrt(np.maximum(one * one - 4 * two * none, 0))
            t = one + np.where(one >= 0, root, -root)
            first, second = 2 * none / t, t / (2 * two)
            single = p + b / c
            y = np.where((first > low) & (first < high), first, second)
            y = np.where(np.isinf(q), single, y)
        y = np.where((y > low) & (y < high), y, (low + high) / 2)
        x = np.where(done, x, y)
    return near, x


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray):
    """The rising eigenvalues and the eigenvectors of ``vectors diag(values) vectors' + v v'``."""
    z = v @ vectors
    size = np.abs(z).max(initial=0)
    if size == 0:
        return values, vectors
    scale = max(values[-1], size * size * len(z), TINY)
    # deflation: of equal eigenvalues one direction takes the whole update, by a reflection of their eigenvectors
    starts = np.flatnonzero(np.r_[True, np.diff(values) > 8 * EPS * scale])
    vectors = vectors.copy()
    for i, j in zip(starts, np.r_[starts[1:], len(z)], strict=True):
        if j - i > 1 and (norm := np.linalg.norm(z[i:j])) > 0:
            u = z[i:j].copy()
            u[-1] += np.copysign(norm, u[-1])
            part = vectors[:, i:j]
            vectors[:, i:j] = part - np.outer(part @ u, u * (2 / (u @ u)))
            z[i:j - 1], z[j - 1] = 0, -np.copysign(norm, u[-1])
    live = np.flatnonzero(np.abs(z) * np.linalg.norm(z) > EPS * scale)
    if not len(live):
        return values, vectors
    poles, z = values[live], z[live]
    near, x = secular(poles, z)
    found = poles[near] + x
    # the update that has exactly these roots, so that the eigenvectors are orthogonal (Loewner's formula)
    gap = poles[:, None] - poles[near][None, :] - x[None, :]
    apart = np.abs(poles[:, None] - poles[None, :])
    np.fill_diagonal(apart, 1)
    own = np.exp((np.log(np.maximum(np.abs(gap), TINY)).sum(axis=1) - np.log(apart).sum(axis=1)) / 2)
    gap = np.where(gap == 0, -TINY, gap)
    turn = (np.copysign(own, z)[:, None] / gap)
    turn /= np.linalg.norm(turn, axis=0)
    values = values.copy()
    values[live] = found
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and the spectrum of the scatter (not divided by the count) of some vectors."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, [0] * dims
        self.mean, self.values, self.vectors = np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, rows: np.ndarray) -> None:
        """Rows of longs, one centred rank-one update after the other."""
        self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(axis=0), strict=True)]
        for row in rows.astype(float):
            off = row - self.mean
            self.n += 1
            if self.n > 1:
                self.values, self.vectors = updated(self.values, self.vectors, off * np.sqrt((self.n - 1) / self.n))
            self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> None:
        """The other's eigenpairs as successive rank-one updates, then the difference of the means."""
        n = self.n + other.n
        off = other.mean - self.mean
        steps = [(other.vectors * np.sqrt(np.maximum(other.values, 0))).T, off[None] * np.sqrt(self.n * other.n / max(n, 1))]
        for v in np.concatenate(steps):
            self.values, self.vectors = updated(self.values, self.vectors, v)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.mean = self.mean + off * (other.n / max(n, 1))
        self.n = n

    def row(self, part: int) -> dict:
        return {"part": [part], "n": [self.n], "sums": [[Decimal(s) for s in self.sums]], "mean": [self.mean.tobytes()],
                "values": [self.values.tobytes()], "vectors": [np.ascontiguousarray(self.vectors).tobytes()]}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        out = cls(len(row["sums"]))
        out.n, out.sums = row["n"], [int(s) for s in row["sums"]]
        out.mean, out.values = (np.frombuffer(row[c]) for c in ("mean", "values"))
        out.vectors = np.frombuffer(row["vectors"]).reshape(len(out.sums), -1)
        return out


def in_rounds(rows: DataFrame, parts: int, join, schema: str) -> DataFrame:
    """The rows of parts 0 to ``parts`` - 1 joined to one, 16 at a time: ``join`` gets a list of rows in order of part."""
    def one(key, table):
        out = join(table.sort_by("part").to_pylist()) | {"part": [key[0].as_py()]}
        return pa.Table.from_pydict(out, schema=table.schema)

    while parts > 1:
        rows = rows.groupBy(F.expr(f"part div {FANOUT}").alias("up")).applyInArrow(one, schema)
        parts = -(-parts // FANOUT)
    return rows


def spectrum(fit: DataFrame, parts: int, dims: int) -> Spectrum:
    """The spectrum of all blocks of ``fit`` (part, x)."""
    def block(key, table):
        out = Spectrum(dims)
        rows = matrix(table.column("x"), dims)
        out.add(rows[np.lexsort(rows.T[::-1])])  # in one order, whatever order the shuffle gives
        return pa.Table.from_pydict(out.row(key[0].as_py()), schema=to_arrow)

    def join(rows):
        out = Spectrum.of(rows[0])
        for r in rows[1:]:
            out.join(Spectrum.of(r))
        return out.row(0)

    to_arrow = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
                          ("mean", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary())])
    row = in_rounds(fit.groupBy("part").applyInArrow(block, SPECTRUM), parts, join, SPECTRUM).first()
    return Spectrum.of(row.asDict())


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles: whole numbers are taken off first, so no digits are lost."""
    whole = np.array([s // n for s in sums], np.int64)
    return (rows - whole).astype(float) - np.array([(s % n) / n for s in sums])


def moments(fit: DataFrame, parts: int, dims: int, n: int, sums: list[int], basis: np.ndarray):
    """Mean and covariance over the blocks of ``fit`` of the centred vectors in ``basis``, centred before multiplying."""
    def block(key, table):
        y = centred(matrix(table.column("x"), dims), n, sums)
        y = y[np.lexsort(y.T[::-1])] @ basis
        mean = y.mean(axis=0)
        y -= mean
        return pa.Table.from_pydict({"part": [key[0].as_py()], "n": [len(y)], "mean": [mean.tobytes()],
                                     "second": [(y.T @ y).tobytes()]}, schema=to_arrow)

    def join(rows):
        size, mean, second = 0, 0.0, 0.0
        for r in rows:
            off = np.frombuffer(r["mean"]) - mean
            both = size + r["n"]
            second = second + np.frombuffer(r["second"]).reshape(len(off), -1) + np.outer(off, off) * (size * r["n"] / both)
            mean, size = mean + off * (r["n"] / both), both
        return {"part": [0], "n": [size], "mean": [mean.tobytes()], "second": [second.tobytes()]}

    to_arrow = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("second", pa.binary())])
    row = in_rounds(fit.groupBy("part").applyInArrow(block, MOMENTS), parts, join, MOMENTS).first()
    return np.frombuffer(row["second"]).reshape(basis.shape[1], -1) / row["n"]


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum((n * x - S)^2) of each row, exact; beyond long it stops at long's end."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    off = rows - whole
    most = int(np.abs(off).max(initial=0)) + 1
    if (most * n) ** 2 * max(1, rows.shape[1]) < 2**63:
        return ((off * n - rest) ** 2).sum(axis=1).tolist()
    top = 2**63 - 1
    return [min(top, sum((int(o) * n - int(r)) ** 2 for o, r in zip(row, rest, strict=True))) for row in off]


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector and component (by falling eigenvalue): vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Fitted on the distinct vectors x = floor(64 * c) + 1000000, each once, so
    copies weigh nothing; every row of the table is whitened. Rows with a null
    vector or null or non-finite entries are dropped; a shorter vector's missing
    entries are those of c = 0; 64 * c is held within 2^50 and deviation within
    long. There are as many components as dimensions, if fewer. A component
    without variance (its eigenvalue is rounding beside the trace: one vector,
    constant or dependent dimensions) has a null ``whitened`` and no part in
    identity_error, which is 0 where no component has variance; ``explained`` is
    0 where the trace is. Null ids and repeated rows pass through. A table without
    whole vectors gives no rows; extra columns are not looked at.

    A task holds one block of vectors or 16 spectra of dims^2 numbers; one
    spectrum comes to the driver and goes out with the tasks, as large as the
    dimensions make it, however many rows there are.
    """
    rows = entries(vectors, id_col, vec_col)
    out = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    n, dims = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not dims:
        return vectors.sparkSession.createDataFrame([], out)
    blocks = parts_for(n, BLOCK)
    fit = distinct.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("long"))

    first = spectrum(fit, blocks, dims)
    n, sums = first.n, first.sums
    basis = np.linalg.qr(first.vectors[:, ::-1])[0]  # orthonormal to the last digit, as Rayleigh-Ritz asks
    small = moments(fit, blocks, dims, n, sums, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, axes = values[::-1], basis @ turn[:, ::-1]
    trace = float(np.trace(small))
    k = min(components, dims)
    has = values[:k] > dims * 16 * EPS * trace
    axes = axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(axis=0), np.arange(k)])
    share = (values[:k] / trace if trace > 0 else np.zeros(k)).clip(0, 1)
    axes = axes / np.sqrt(np.where(has, values[:k], 1))
    error = float(np.abs(moments(fit, blocks, dims, n, sums, axes[:, has]) - np.eye(int(has.sum()))).max()) if has.any() else 0.0

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = matrix(part.column("x"), dims)
                y = centred(x, n, sums) @ axes
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(y.ravel(), mask=np.tile(~has, m)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, out)
