import numpy as np
import pytest

from rollcall.llm import whitening as wh


def frame(spark, vectors, kind="float"):
    rows = [(i, v, "x", 1, 2.0) for i, v in vectors]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, vector string, component int, n double")


def check(out, vectors, components=32):
    """Compare with an eigen decomposition of the exact integers' covariance."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in vectors], object)
    n, total = len(x), sum(x)
    wide = n * x - total
    a = (wide / n).astype(float)
    e, w = np.linalg.eigh(a.T @ a / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(components, int((e > 1e-20 * e[0]).sum()))
    by = {(r.vec_id, r.component): r for r in out}
    assert len(out) == n * k
    white = a @ w[:, :k] / np.sqrt(e[:k])
    for j in range(k):
        mine = np.array([by[i, j + 1].whitened for i, _ in vectors])
        sign = np.sign(mine @ white[:, j])
        assert np.allclose(mine, sign * white[:, j], atol=1e-7 * np.sqrt(n))
        assert abs(by[vectors[0][0], j + 1].explained / (e[j] / e.sum()) - 1) < 1e-9
    for row, (i, _) in zip(wide, vectors):
        assert by[i, 1].deviation == sum(v * v for v in row) and by[i, 1].n == n
        assert by[i, 1].identity_error < 1e-6


def test_components_equal_an_eigen_decomposition(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(400, 12)) * np.logspace(0, 2, 12) @ np.linalg.qr(draw.normal(size=(12, 12)))[0]
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    check(wh.whitened(frame(spark, vectors)).collect(), vectors)
    check(wh.whitened(frame(spark, vectors, "double").repartition(7), components=5).collect(), vectors, 5)


def test_nearly_and_wholly_dependent_dimensions(spark):
    """A hundred million to one between directions, a repeated column and a constant one."""
    draw = np.random.default_rng(3)
    big, small = draw.normal(size=(300, 1)) * 1e6, draw.normal(size=(300, 2))
    base = np.concatenate([big, big + small[:, :1] * 4, small[:, 1:], big, np.full((300, 1), 3.0)], axis=1)
    base = np.floor(base * 64) / 64
    vectors = [(i, list(map(float, v))) for i, v in enumerate(base)]
    out = wh.whitened(frame(spark, vectors, "double")).collect()
    assert max(r.component for r in out) == 3 and all(r.identity_error < 1e-4 for r in out)


def test_edge_cases(spark):
    good = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [-2.0, 0.0]), (4, [3.0]), (5, [1.0, -1.0])]
    bad = [(6, None), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 0.0])]
    out = wh.whitened(frame(spark, good + bad)).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(["1"] * 4 + ["None"] * 2 + ["4"] * 2 + ["5"] * 2)
    assert {r.n for r in out} == {5} and out[0].identity_error < 1e-9
    assert wh.whitened(frame(spark, [])).collect() == []
    assert wh.whitened(frame(spark, [(1, [])])).collect() == []
    assert wh.whitened(frame(spark, [(1, [2.0]), (2, [2.0])])).collect() == []
    far = wh.whitened(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert len(far) >= 3 and all(r.deviation is None or r.deviation >= 0 for r in far)


def test_passes_repeat_until_orthonormal():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 6)) @ np.diag(np.logspace(0, -9, 6)) @ rng.normal(size=(6, 6))
    with pytest.raises(np.linalg.LinAlgError):
        np.linalg.cholesky(a.T @ a)
    f = wh._factor(a.T @ a, 200)
    assert np.linalg.norm(f.T @ f - a.T @ a) < 1e-9 * np.linalg.norm(a.T @ a)
