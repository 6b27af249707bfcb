"""Whitening against numpy's own decompositions, and the solver against hard spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import op11_whitening as whitening

DATA = "/root/testdata/sf0.001"


def plain(rows, components=16):
    """{vec_id: (x, whitened per component)} and the model's numbers, from numpy's eigh."""
    kept = [(d, v) for d, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = {d: [math.floor(64 * c) + 1_000_000 for c in v] for d, v in kept}
    fit = np.array(sorted(set(map(tuple, xs.values()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return xs, n, sums, values, vectors, np.trace(cov)


def test_solver_on_hard_spectra():
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    for name, matrix in {
        "plain": rng.standard_normal((200, 24)),
        "graded": rng.standard_normal((200, 24)) * np.logspace(0, -10, 24),
        "few rows": rng.standard_normal((5, 24)),
        "ties": np.vstack([np.eye(24)] * 2),
        "clusters": (basis * np.repeat([3, 2, 1], 8)) @ basis.T,
        "near ties": (basis * (1 + 1e-9 * np.arange(24))) @ basis.T,
        "one value": np.ones((40, 24)),
        "nothing": np.zeros((3, 24)),
    }.items():
        r = np.linalg.qr(matrix, mode="r")
        r = np.vstack([r, np.zeros((24 - len(r), 24))])
        exact = np.linalg.svd(matrix, compute_uv=False)
        diagonal, upper, right = whitening.bidiagonal(r)
        ours = whitening.singular_values(diagonal, upper)
        assert np.allclose(ours[: len(exact)], exact, atol=1e-13 * max(exact[0], 1)), name
        values, vectors, total = whitening.principal(r, 16)
        assert len(values) == min(16, (exact > 1e-13 * max(exact[0], 1e-300)).sum()), name
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12), name
        scatter = matrix.T @ matrix
        assert np.allclose(scatter @ vectors, vectors * values, atol=1e-12 * max(total, 1)), name


def test_small_values_keep_their_relative_accuracy():
    exact = np.logspace(0, -14, 12)
    upper = np.full(11, 1e-3) * exact[1:]
    ours = whitening.singular_values(exact, upper)
    from fractions import Fraction

    # The product of the values is that of the diagonal, whatever the superdiagonal is.
    want = math.prod(map(Fraction, exact))
    assert abs(float(Fraction(math.prod(map(Fraction, ours))) / want) - 1) < 1e-13


@pytest.fixture(scope="module")
def found(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    return table, whitening.query(table.repartition(7)).collect()


def test_rows_equal_numpy(found):
    table, rows = found
    source = [(r.vec_id, r.embedding) for r in table.collect()]
    xs, n, sums, values, vectors, trace = plain(source)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == 16 * len(xs)
    assert {k for _, k in by} == set(range(1, 17)) and {r.n for r in rows} == {n}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10
    for k in range(16):
        ours = np.array([by[d, k + 1].whitened for d in sorted(xs)])
        want = np.array([((n * np.array(xs[d], object) - sums) / n).astype(float) for d in sorted(xs)])
        want = want @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(ours - want).max(), np.abs(ours + want).max()) < 1e-7
        assert abs(by[min(xs), k + 1].explained / (values[k] / trace) - 1) < 1e-10
    for d, x in xs.items():
        assert by[d, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, [float(v) for v in rng.standard_normal(3)]) for k in range(20)]
    odd = [
        (100, None),
        (101, [1.0, None, 2.0]),
        (102, [1.0, float("nan"), 2.0]),
        (103, [float("inf"), 0.0, 1.0]),
        (104, []),
        (105, [1.0, 2.0]),
        (106, [1e300, 0.0, 0.0]),
        (None, good[0][1]),
        (3, good[3][1]),
        (3, good[4][1]),
    ]
    frame = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns(
        {name: F.lit("own") for name in ("x", "n", "part", "component", "whitened")}
    )
    rows = whitening.query(frame).collect()
    xs, n, sums, values, _, trace = plain(good)
    assert {r.vec_id for r in rows} == {k for k, _ in good} | {None}
    assert len(rows) == 3 * 23 and {r.n for r in rows} == {20}
    assert abs(sum(r.explained for r in rows if r.vec_id == 7) - 1) < 1e-12
    assert all(abs(r.identity_error) < 1e-12 for r in rows)
    assert whitening.query(frame.limit(0)).count() == 0
    assert whitening.query(frame.limit(0)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]


def test_copies_of_one_vector_have_no_component(spark):
    rows = [(k, [0.5, 0.25]) for k in range(9)]
    assert whitening.query(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2**40 * (k % 5) + k), float(k * k)]) for k in range(11)]
    got = whitening.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    xs, n, sums, *_ = plain(rows)
    for r in got:
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(xs[r.vec_id], sums))
        assert r.deviation == (exact if exact < 2**63 else None)
    assert got
