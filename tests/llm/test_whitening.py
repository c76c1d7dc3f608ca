import numpy as np
import pytest

from hearthwave.llm import whitening as w

ROWS = "vec_id long, embedding array<float>, label int"


def _sound(v, found):
    for value, x in found:
        assert abs(np.linalg.norm(x) - 1) < 1e-12 and np.abs(v @ x - value * x).max() <= 1e-13 * max(np.trace(v), 1e-300)
    basis = np.array([x for _, x in found])
    assert np.abs(basis @ basis.T - np.eye(len(found))).max() < 1e-10


@pytest.mark.parametrize("dims", [1, 2, 3, 17, 64])
def test_slices_equal_the_spectrum(dims):
    rng = np.random.default_rng(dims)
    a = rng.normal(size=(3 * dims, dims)) * np.linspace(1, 4, dims)
    v = a.T @ a / len(a)
    found = w.slices(v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose([e for e, _ in found], want, rtol=1e-12)
    _sound(v, found)


def test_equal_near_and_missing_eigenvalues():
    rng = np.random.default_rng(1)
    for values in ([3, 3, 3, 1], [2, 2 - 1e-14, 1, 0], [5, 0, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 1 - 3e-9, 0.5], [1e-8, 1e-9, 1e-200, 0], [7e30, 7e30, 1, 0]):
        q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
        v = q @ np.diag(np.array(values, float)) @ q.T
        v = (v + v.T) / 2
        found = w.slices(v, 4)
        assert np.allclose([e for e, _ in found], sorted(values, reverse=True)[:4], rtol=1e-12, atol=1e-14 * max(values))
        _sound(v, found)
    assert [e for e, _ in w.slices(np.zeros((3, 3)), 4)] == [0.0] * 3
    outer = np.outer(np.arange(5.0), np.arange(5.0))
    assert abs(w.slices(outer, 2)[0][0] - 30) < 1e-12


def test_counts_above_a_shift():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = rng.normal(size=(12, 12))
        v = a + a.T  # indefinite: pivots of two rows
        e = np.linalg.eigvalsh(v)
        for shift in (-3.0, 0.0, 0.5, 4.0):
            assert w.above(v, shift) == int((e > shift).sum())
    assert w.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def _plain(rows):
    """By numpy: (n, sums, whitened up to signs, explained, deviation)."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return kept, n, sums, e, u, v


def test_whole_operator_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 12)) * np.linspace(0.2, 2, 12)
    rows = [(i, [float(c) for c in x], 1) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[7][1], None) for i in range(200)]  # a hot vector counts once
    rows += [(2000, None, 1), (2001, [1.0] * 11 + [None], 1), (2002, [1.0] * 11 + [float("nan")], 1), (2003, [float("inf")] * 12, 1), (2004, [1.0, 2.0], 1), (2005, [], 1), (None, rows[3][1], 2), (5, rows[4][1], 2)]
    df = spark.createDataFrame(rows, ROWS).repartition(7).selectExpr("*", "1 AS component", "'x' AS n", "2 AS x", "3 AS i")
    got = w.whiten(df, "vec_id", "embedding").collect()
    kept, n, sums, e, u, v = _plain([r for r in rows if r[0] not in (2004, 2005)])
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got}.pop() < 1e-9 and len({r["identity_error"] for r in got}) == 1
    want = {}
    for i, x in kept:
        white = ((np.array(x) - sums / n) @ u[:, :4]) / np.sqrt(e[:4])
        want.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), np.abs(white)))
    for r in got:
        assert any(r["deviation"] == d and abs(abs(r["whitened"]) - a[r["component"] - 1]) < 1e-9 for d, a in want[r["vec_id"]])
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) < 1e-12
    by = {c: [(r["vec_id"], r["whitened"]) for r in got if r["component"] == c and r["vec_id"] is not None and r["vec_id"] < 400 and r["vec_id"] != 5] for c in range(1, 5)}
    for c, pairs in by.items():
        signs = {np.sign(x * (((np.array(dict(kept)[i]) - sums / n) @ u[:, c - 1]))) for i, x in pairs}
        assert len(signs) == 1  # one sign for all rows


def test_defined_cases(spark):
    assert w.whiten(spark.createDataFrame([], ROWS), "vec_id", "embedding").count() == 0
    assert w.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], ROWS), "vec_id", "embedding").count() == 0
    same = w.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], ROWS), "vec_id", "embedding").collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in same)
    line = w.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)], ROWS), "vec_id", "embedding").collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: (r["vec_id"], r["component"]))] == [False, True, True] * 5
    huge = w.whiten(spark.createDataFrame([(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (3, [0.0, 5.0], 1)], ROWS), "vec_id", "embedding").collect()
    assert len(huge) == 6 and all(r["n"] == 3 for r in huge) and any(r["deviation"] is None for r in huge) and {r["identity_error"] for r in huge if r["component"] == 1}.pop() < 1e-4
    text = w.whiten(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<double>"), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"], abs(r["whitened"])) for r in text) == [("a", 1.0), ("b", 1.0)]
