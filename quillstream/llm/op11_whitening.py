"""Embedding whitening by a bidiagonal qd solver.

Distinct vectors are centred exactly in integers, and every task reduces its rows by QR, block after block,
to one triangle R; triangles are stacked and reduced again until one is left, so R^T R is the scatter of all
rows though their products are never formed. Householder reflections make R bidiagonal. Its singular values
come from the differential qd algorithm with shifts (dqds), which finds small ones as accurately as large
ones, and a twisted factorisation at each value gives its vector. Only sums and triangles of the vectors'
width leave the tasks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .common import stage as staged

#: Entries are counted in steps of 1 / SCALE and moved up by OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components that are given, at most.
COMPONENTS = 16
#: Rows that are reduced or projected at once.
BLOCK_ROWS = 2048
#: Triangles that one task of a round stacks.
FAN_IN = 32
#: Entries of this many steps do not fit a long beside the offset; their rows count as non-finite.
LARGEST = 1 << 62

_EPS = np.finfo(float).eps


# ---- the bidiagonal solver ----------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor V of Householder's reduction: r = U B V^T."""
    a = np.array(r, float)
    n = a.shape[1]
    right = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        top = np.abs(x).max(initial=0.0)
        if top == 0 or np.count_nonzero(x[1:]) == 0:
            return np.zeros_like(x), 0.0
        v = x / top
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v, 2.0 / (v @ v)

    for k in range(n):
        v, beta = reflector(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, beta = reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform, of the values less the shift; None if the shift exceeds the smallest value."""
    d = q[0] - shift
    new_q, new_e = [], []
    for k, above in enumerate(e):
        if d < 0:
            return None
        total = d + above
        ratio = q[k + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(above * ratio)
        # Where d and e are both zero a zero value has come off and the rest stands alone.
        d = d * ratio - shift if total else q[k + 1] - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def _lower_bound(q: list[float], e: list[float]) -> float:
    """At most the smallest value: one over the trace of the inverse, from the d of a sweep without shift."""
    d, inverse = q[0], 0.0
    for k, above in enumerate(e):
        if d == 0:
            return 0.0
        inverse += 1 / d
        d *= q[k + 1] / (d + above)
    if d == 0:
        return 0.0
    return 1 / (inverse + 1 / d)


def singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling, by dqds.

    Every sweep takes a lower bound of the smallest value off, so the array stays positive and nothing
    cancels; the last value comes free when its coupling is negligible, and a negligible coupling further
    up cuts the array in two.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in upper / scale], 0.0)]
    while work:
        q, e, taken = work.pop()
        while len(q) > 2:
            cut = next(
                (
                    k
                    for k in range(len(e) - 1, -1, -1)
                    if e[k] <= _EPS**2 * (taken + min(q[k], q[k + 1])) or e[k] < 1e-290
                ),
                None,
            )
            if cut is not None:
                work.append((q[cut + 1 :], e[cut + 1 :], taken))
                q, e = q[: cut + 1], e[:cut]
                continue
            if q[0] < q[-1]:  # the same values the other way round; small ones come free at the end
                q, e = q[::-1], e[::-1]
            shift = _lower_bound(q, e)
            after = _sweep(q, e, shift)
            while after is None:  # the bound is off by a rounding error at most
                shift *= 1 - 1e-3 if shift > 1e-300 else 0.0
                after = _sweep(q, e, shift)
            (q, e), taken = after, taken + shift
        if len(q) == 1:
            found.append(taken + q[0])
        elif q:
            total = q[0] + q[1] + e[0]
            large = (total + np.hypot(q[0] - q[1] + e[0], 2 * np.sqrt(e[0] * q[1]))) / 2
            found += [taken + large, taken + (q[0] * (q[1] / large) if large else 0.0)]
    return np.sqrt(np.sort(found)[::-1]) * scale


def _twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Vector of B^T B near ``value`` (squared) from its twisted factorisation, and the value's correction."""
    n = len(diagonal)
    q, e, coupling = diagonal**2, upper**2, diagonal[: n - 1] * upper
    tiny = _EPS * _EPS * max(value, 1e-280)
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for k in range(n - 1):  # stationary transform, from the top
        pivot = s[k] + q[k] or tiny
        down[k] = coupling[k] / pivot
        s[k + 1] = e[k] * (s[k] / pivot) - value
    p[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):  # progressive transform, from the bottom
        pivot = e[k] + p[k + 1] or tiny
        up[k] = coupling[k] / pivot
        p[k] = p[k + 1] * (q[k] / pivot) - value
    gamma = s + p + value
    twist = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -up[k] * z[k]
    length = np.linalg.norm(z)
    return z / length, gamma[twist] / length**2


def _near_cluster(diagonal: np.ndarray, upper: np.ndarray, value: float, earlier: np.ndarray, seed: int) -> np.ndarray:
    """A vector of a value that several share: inverse iteration, kept orthogonal to the earlier ones."""
    n = len(diagonal)
    matrix = np.zeros((n, n))
    place = np.arange(n)
    matrix[place, place] = diagonal**2
    matrix[place[1:], place[1:]] += upper**2
    matrix[place[1:], place[:-1]] = matrix[place[:-1], place[1:]] = diagonal[: n - 1] * upper
    top = np.abs(matrix).max()
    matrix[place, place] -= value + 8 * _EPS * top
    z = np.random.default_rng(seed).standard_normal(n)
    for _ in range(4):
        for _ in range(2):
            z -= earlier @ (earlier.T @ z)
        z = np.linalg.solve(matrix, z / np.linalg.norm(z))
    for _ in range(2):
        z -= earlier @ (earlier.T @ z)
        z /= np.linalg.norm(z)
    return z


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit right singular vector per leading singular value, as columns."""
    out = np.zeros((len(diagonal), len(values)))
    for k, value in enumerate(values**2):
        correction = 0.0
        for _ in range(3):
            z, step = _twisted(diagonal, upper, value + correction)
            if not np.isfinite(z).all() or abs(step) <= 2 * _EPS * value:
                break
            if abs(correction + step) > 1e-6 * value:
                break
            correction += step
        near = [j for j in range(k) if values[j] ** 2 - value <= 1e-3 * value]
        if near or not np.isfinite(z).all():
            others = out[:, near]
            kept = z - others @ (others.T @ z) if np.isfinite(z).all() else np.zeros(len(z))
            if np.linalg.norm(kept) > 0.5:
                kept -= others @ (others.T @ kept)
                z = kept / np.linalg.norm(kept)
            else:
                z = _near_cluster(diagonal, upper, value, out[:, :k], k)
        out[:, k] = z
    return out


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading squared singular values of a triangle, their right vectors, and the sum of all squares.

    Values that are rounding noise beside the largest are left out.
    """
    diagonal, upper, right = bidiagonal(r)
    values = singular_values(diagonal, upper)
    total = float(np.sum(values**2))
    floor = 8 * len(values) * _EPS * values[0] if len(values) else 0.0
    leading = values[:count][values[:count] > floor]
    vectors = right @ right_vectors(diagonal, upper, leading)
    return leading**2, vectors, total


# ---- the distributed part -----------------------------------------------------------------------


class Whitening(NamedTuple):
    """A fitted whitening; vectors count in steps of 1 / SCALE, without the offset."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None


def steps(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the vectors in whole steps, without those that hold nulls or non-finite entries."""

    def fits(c):
        return F.coalesce(F.abs(c.cast("double")) < LARGEST / SCALE, F.lit(False))

    vector = F.col(f"`{vector_col}`")
    sound = embeddings.filter(vector.isNotNull() & F.forall(vector, fits))
    return sound.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(vector, lambda c: F.floor(SCALE * c.cast("double"))).alias("x"),
    )


def _width(vectors: DataFrame) -> int:
    """The commonest length of the vectors, of equally common ones the greatest."""
    sizes = vectors.groupBy(F.size("x").alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def _blocks(batches, width: int):
    """Arrays of at most BLOCK_ROWS vectors, with the batch they come from."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: whole numbers of 64 bits where they fit, else of Python."""
    bound = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    kind = np.int64 if bound < 1 << 62 else object
    return n * x.astype(kind) - np.array(sums, kind)


def _deviation(centred: np.ndarray) -> pa.Array:
    """Sum of squares per row; null where it does not fit a long."""
    top = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
    if top * top * max(1, centred.shape[1]) < 1 << 63:
        return pa.array((centred.astype(np.int64) ** 2).sum(axis=1), pa.int64())
    exact = [sum(int(v) ** 2 for v in row) for row in centred]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _folded(parts: DataFrame, merge) -> bytes | None:
    """One value from a column of binary parts: rounds of FAN_IN to one, each a table of its own."""

    def join(batches):
        state = None
        for batch in batches:
            for value in batch.column("part"):
                state = value.as_py() if state is None else merge(state, value.as_py())
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["part"])

    parts = staged(parts, "parts")
    left = parts.count()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = staged(parts.repartition(left).mapInArrow(join, "part binary"), "parts")
    row = parts.first()
    return row["part"] if row else None


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    def add(batches):
        count, total = 0, np.zeros(width, object)
        for _, x in _blocks(batches, width):
            count += len(x)
            small = len(x) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 1 << 62
            total = total + (x if small else x.astype(object)).sum(axis=0).astype(object)
        sums = [str(count), *map(str, total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, width), pa.int32()), pa.array(sums, pa.string())], names=["dim", "sum"]
        )

    added = fit.select("x").mapInArrow(add, "dim int, sum string")
    rows = added.groupBy("dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    by = {row["dim"]: int(row["sum"]) for row in rows}
    return by.get(-1, 0), [by.get(k, 0) for k in range(width)]


def _triangle(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray | None:
    """R of the QR decomposition of all centred rows, block by block and task by task."""

    def reduce(batches):
        r = None
        for _, x in _blocks(batches, width):
            rows = (_centred(x, n, sums) / n).astype(float)
            r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["part"])

    def merge(one: bytes, other: bytes) -> bytes:
        both = [np.frombuffer(part).reshape(-1, width) for part in (one, other)]
        return np.linalg.qr(np.vstack(both), mode="r").tobytes()

    found = _folded(fit.select("x").mapInArrow(reduce, "part binary"), merge)
    if found is None:
        return None
    r = np.frombuffer(found).reshape(-1, width)
    return np.vstack([r, np.zeros((width - len(r), width))])


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, centred before multiplying."""
    count, width = len(model.values), len(model.sums)
    project = model.vectors / np.sqrt(model.values)
    n, sums = model.n, model.sums

    def moments(batches):
        state = None
        for _, x in _blocks(batches, width):
            rows = (_centred(x, n, sums) / n).astype(float) @ project
            mean = rows.mean(axis=0)
            rest = rows - mean
            own = np.concatenate([[len(rows)], mean, (rest.T @ rest).ravel()]).tobytes()
            state = own if state is None else merge(state, own)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["part"])

    def merge(one: bytes, other: bytes) -> bytes:
        a, b = np.frombuffer(one), np.frombuffer(other)
        rows = a[0] + b[0]
        apart = b[1 : count + 1] - a[1 : count + 1]
        mean = a[1 : count + 1] + apart * (b[0] / rows)
        scatter = a[count + 1 :] + b[count + 1 :] + np.outer(apart, apart).ravel() * (a[0] * b[0] / rows)
        return np.concatenate([[rows], mean, scatter]).tobytes()

    found = _folded(fit.select("x").mapInArrow(moments, "part binary"), merge)
    if not count or found is None:
        return None
    state = np.frombuffer(found)
    return float(np.abs(state[count + 1 :].reshape(count, count) / state[0] - np.eye(count)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors of (vec_id, x), all of one length; the copies of a vector meet map-side."""
    width = _width(vectors)
    distinct = staged(vectors.filter(F.size("x") == width).select("x").distinct(), "distinct-vectors")
    n, sums = _sums(distinct, width) if width else (0, [])
    r = _triangle(distinct, width, n, sums) if n else None
    if r is None:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, None)
    scatter, directions, total = principal(r, components)
    model = Whitening(n, sums, directions, scatter / n, total / n, None)
    return model._replace(identity_error=_identity_error(distinct, model))


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector of the model's length and component: its deviation and whitened coordinate."""
    width, count = len(model.sums), len(model.values)
    n, sums, error = model.n, model.sums, model.identity_error
    project = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace if count else model.values

    def apply(batches):
        for part, x in _blocks(batches, width):
            centred = _centred(x, n, sums)
            rows = (centred / n).astype(float) @ project
            each = np.repeat(np.arange(len(part)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(len(each), n, np.int64)),
                    _deviation(centred).take(pa.array(each)),
                    pa.array(rows.ravel()),
                    pa.array(np.tile(explained, len(part))),
                    pa.array([error] * len(each), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.filter(F.size("x") == width).mapInArrow(
        apply,
        "vec_id long, component int, n long, deviation long, whitened double, explained double,"
        " identity_error double",
    )


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Per sound row and component: id, component (from 1, by falling share of the variance), n, deviation,
    whitened, explained and identity_error, as the contract of the query has them.

    Rows whose vector is null, holds a null or non-finite entry, or one whose steps do not fit a long, give
    nothing. Vectors of another length than the commonest (of equally common ones the longest) give nothing
    either. Copies of a vector count once for the fit and each give their rows; repeated and null ids are
    kept as they are. Directions with no variance beside the largest are no components, so one vector, or
    copies of one, give no rows. A deviation beyond a long is null. Of directions with equal variance any
    orthogonal choice is given, the same for all rows. Extra columns are not read.
    """
    vectors = staged(steps(spread(embeddings, id_col, vector_col), id_col, vector_col), "vectors")
    return whitened(vectors, fit(vectors, components)).withColumnRenamed("vec_id", id_col)


def query(embeddings: DataFrame) -> DataFrame:
    """The whitened coordinates of every embedding."""
    return whiten(embeddings)
