"""Whitening against numpy's own decompositions."""

import numpy as np
import pytest

from cueloom.llm import queries, whitening

KIND = "vec_id long, embedding array<float>, label int, n string, x string"


def against_numpy(x, tolerance=1e-9):
    r = np.linalg.qr(x, mode="r")
    directions, squares, total = whitening.leading_directions(r, 4)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(squares, s[: len(squares)] ** 2, rtol=1e-12) and abs(total - (s ** 2).sum()) <= 1e-12 * total
    assert np.abs(directions.T @ directions - np.eye(len(squares))).max(initial=0) < 1e-12
    assert np.abs(x.T @ (x @ directions) - directions * squares).max(initial=0) <= 1e-12 * s[0] ** 2
    return len(squares)


def test_directions_of_one_matrix():
    rng = np.random.default_rng(1)
    orthogonal = np.linalg.qr(rng.standard_normal((200, 20)))[0]
    turned = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    assert against_numpy(rng.standard_normal((500, 64))) == 4
    assert against_numpy(rng.standard_normal((800, 48)) * np.logspace(0, -8, 48)) == 4
    assert against_numpy(rng.standard_normal((30, 64))) == 4  # fewer rows than columns
    assert against_numpy(rng.standard_normal((9, 1))) == 1
    assert against_numpy(np.vstack([np.eye(8) * 3] * 4)) == 4  # all values equal, parts apart
    assert against_numpy((orthogonal * 7) @ turned) == 4  # all values equal, in one part
    assert against_numpy((orthogonal * np.array([5, 5, 5, 5 - 1e-9, 5 - 1e-12] + [1.0] * 15)) @ turned) == 4
    assert against_numpy(np.ones((10, 5))) == 1  # one direction has variance
    assert against_numpy(np.zeros((10, 5))) == 0


def test_dqds_keeps_small_values():
    """Every value to high relative accuracy, where squaring the matrix would lose the small ones."""
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([1e-1, 1e-4, 1e-8])
    from fractions import Fraction

    found = whitening.dqds(a, b)
    square = 1.0
    for v in a:
        square *= v ** 2
    assert abs(np.prod(found) / square - 1) < 1e-13  # the determinant tells of the smallest value
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(200), rng.standard_normal(199)
    assert np.allclose(whitening.dqds(a, b), np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2, rtol=1e-11, atol=1e-12)
    # three by three in exact numbers: each root is met by the characteristic polynomial's change of sign
    a, b = np.array([2.0, 1.0, 1e-5]), np.array([1.0, 3e-3])
    t = [[Fraction(v) for v in row] for row in (np.diag(a) + np.diag(b, 1)).tolist()]
    g = [[sum(t[k][i] * t[k][j] for k in range(3)) for j in range(3)] for i in range(3)]

    def polynomial(x):
        m = [[g[i][j] - (x if i == j else 0) for j in range(3)] for i in range(3)]
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    for value in whitening.dqds(a, b):
        assert polynomial(Fraction(value) * (1 - Fraction(1, 10 ** 13))) * polynomial(Fraction(value) * (1 + Fraction(1, 10 ** 13))) < 0


def test_whiten(spark):
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((300, 12)) * np.linspace(2, 0.1, 12) + 1).astype(np.float32)
    odd = [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (None, [float(v) for v in x[0]]), (307, [float(v) for v in x[3]]),
           (307, [float(v) for v in x[3]]), (-1, [1.0, 2.0]), (-2, [3.0, -0.001]), (-3, [5.0])]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd
    df = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], KIND).repartition(5)
    got = whitening.whiten(df).collect()
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == sorted((i is None, i) for i, _ in kept)
    fit = np.unique(np.array([v for _, v in kept if len(v) == 12]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = None
    by_id = {(r.vec_id, len(r.whitened)): r for r in got}
    for i, v in kept:
        if len(v) != 12:
            continue
        r = by_id[i, 4]
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) and 0 <= r.identity_error < 1e-10
        w = (v - sums / n) @ vectors[:, :4] / np.sqrt(values[:4])
        signs = np.sign(w * r.whitened) if signs is None else signs
        assert np.allclose(w * signs, r.whitened, atol=1e-9) and np.allclose(r.explained, values[:4] / values.sum(), rtol=1e-10)
    assert {(r.vec_id, r.n, len(r.whitened)) for r in got if r.vec_id is not None and r.vec_id < 0} == {(-1, 2, 1), (-2, 2, 1), (-3, 1, 0)}
    assert whitening.whiten(df.limit(0)).count() == 0


def test_deviation_beyond_64_bits():
    m = whitening.Whitening(10, np.array([0, 10 ** 9]), np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[1, 1], [10 ** 8, 0], [10 ** 12, 0]])
    assert m.deviations(x) == [100 + (10 - 10 ** 9) ** 2, 10 ** 18 + 10 ** 18, None]


def test_query(spark):
    df = queries.QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.01")
    rows = df.collect()
    assert [f.simpleString() for f in df.schema.fields] == ["vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double", "explained:double", "identity_error:double"]
    assert len(rows) == 4 * spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count() and len({r.identity_error for r in rows}) == 1
    for c in range(1, 5):
        w = np.array([r.whitened for r in rows if r.component == c])
        assert rows[0].n != len(w) or (abs(w.mean()) < 1e-9 and abs(w.var() - 1) < 1e-6)
