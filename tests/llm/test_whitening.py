"""Whitening against a dense eigendecomposition, exact integers, and odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from taxaflow.llm import queries, whitening


def table(spark, rows):
    """With columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, "w", 0) for i, v in rows], "vec_id bigint, embedding array<float>, n int, whitened string, d int")


def model(rows, k=4):
    """(fit list, sums, eigenvalues, components, trace) by plain means."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return x, n, sums, values[order][:k], vectors[:, order[:k]], values.sum()


@pytest.mark.parametrize("d", [3, 40])
def test_against_dense(spark, d):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((500, d)) @ np.diag(1 / np.arange(1, d + 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)] + [(900 + i, base[7].astype(np.float32).tolist()) for i in range(200)]
    odd = [(1, None), (2, []), (3, [float("nan")] * d), (4, [None] + [1.0] * (d - 1)), (5, [float("inf")] * d)]
    x, n, sums, values, vectors, trace = model(rows)
    out = whitening.whiten(table(spark, rows + odd)).collect()
    m = min(4, d)
    assert len(out) == len(rows) * m and {r.component for r in out} == set(range(1, m + 1))
    got = np.zeros((m, len(x)))
    place = {i: k for k, i in enumerate(x)}
    for r in out:
        assert r.n == n and int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-10 and r.identity_error < 1e-10
        got[r.component - 1, place[r.vec_id]] = r.whitened
    want = ((np.array(list(x.values())) - np.array(sums) / n) @ vectors / np.sqrt(values)).T
    for mine, theirs in zip(got, want):
        assert np.abs(mine * np.sign(mine @ theirs) - theirs).max() < 1e-9


def test_lengths_repeats_and_constants(spark):
    """Each length has its own fit; a length without variance gives no row; null ids and repeated rows stay."""
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(None, [9.0, 1.0]), (3, [3.0, 1.0])] + [(50 + i, [2.0, 2.0, 2.0]) for i in range(3)] + [(90, [1e30, 0.0, -1e30, 0.0]), (91, [0.0] * 4)]
    out = whitening.whiten(table(spark, rows)).collect()
    two = [r for r in out if r.vec_id is None or r.vec_id < 50]
    assert len(two) == 7 and {r.component for r in two} == {1} and sum(r.vec_id is None for r in two) == 1
    assert not [r for r in out if r.vec_id in (50, 51, 52)]
    assert [r.n for r in out if r.vec_id == 90] == [2]
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("rank", [0, 1, 3, 9, 50])
def test_lanczos(rank):
    """Low rank breaks blocks down; repeated eigenvalues; more passes than one."""
    rng = np.random.default_rng(rank)
    q = np.linalg.qr(rng.standard_normal((50, 50)))[0]
    values = np.zeros(50)
    values[:rank] = [4.0, 4.0, 3.0][:rank] + sorted(rng.random(max(0, rank - 3)) * 2, reverse=True)
    a = q @ np.diag(values) @ q.T
    got, vectors = whitening.lanczos(lambda b: a @ b, 50, 4, block=5)
    assert np.abs(got - values[:4]).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-11


def test_lanczos_stops_early():
    """A gap after the wanted eigenvalues: far fewer products than columns."""
    values = np.r_[[100.0, 80.0, 60.0, 40.0], np.linspace(1e-3, 0, 396)]
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((400, 400)))[0]
    seen = []
    got, _ = whitening.lanczos(lambda b: seen.append(b.shape[1]) or q @ (values[:, None] * (q.T @ b)), 400, 4)
    assert np.abs(got - values[:4]).max() < 1e-11 and sum(seen) <= 128


def test_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    table(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 8)).astype(np.float32))]).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op11_whitening(spark, str(tmp_path))
    assert [*out.dtypes] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert out.count() == 240
