from fractions import Fraction
from math import floor, inf, nan

import numpy as np

from plotline.llm import whitening as W
from plotline.llm.shared import table


def exact(vectors):
    """Distinct whole-number vectors, their sums and covariance in rational arithmetic."""
    xs = sorted({tuple(floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors})
    n, width = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(width)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(width)] for i in range(width)]
    return xs, sums, cov


def test_error_free_steps():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-8, 9, 200), rng.normal(size=200)
    s, e = W.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(u) + Fraction(v) for x, y, u, v in zip(a, b, s, e))
    rows = np.stack([a, b], axis=1)
    p, e = W.outer((rows, np.zeros_like(rows)))
    assert all(Fraction(x) * Fraction(y) == Fraction(u) + Fraction(v) for x, y, u, v in zip(a, b, p[:, 1], e[:, 1]))


def test_sums_keep_what_rounding_cuts_off():
    high, low = W.total((np.array([[1e16], [1.0], [-1e16], [1e-8]]), np.zeros((4, 1))))
    assert high[0] + low[0] == 1.00000001


def test_covariance_against_rational_arithmetic(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(c) for c in v] for v in (rng.normal(size=(60, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])).astype(np.float32)]
    xs, sums, cov = exact(vectors)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors + vectors[:7])], "vec_id long, embedding array<float>").repartition(5)
    fit = W.whole_vectors(rows, "vec_id", "embedding").select("_x").distinct()
    model = W.fit_whitening(fit, 5)
    assert model.n == len(xs) and [int(f) * model.n + int(r) for f, r in zip(model.floor, model.rest)] == sums
    high, low = W.compensated(fit, 5, model.centred, 5, products=True)
    for (i, j), h, t in zip(zip(*np.triu_indices(5)), high, low):
        assert abs(Fraction(h) + Fraction(t) - cov[i][j] * model.n) <= abs(cov[i][j] * model.n) * Fraction(1, 2**95)
    plain = np.array([[float(c) for c in r] for r in cov])
    assert np.allclose(plain @ model.components, model.components * model.eigenvalues, atol=1e-12 * np.trace(plain))


def test_whole_table_against_plain_arithmetic(spark, tiny):
    rows = table(spark, tiny, "embeddings")
    given = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    xs, sums, cov = exact(given.values())
    n, plain = len(xs), np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(plain)
    found = {(r["vec_id"], r["component"]): r for r in W.whiten(rows).collect()}
    assert set(found) == {(i, c) for i in given for c in range(1, 17)}
    signs = {}
    for i, v in given.items():
        x = [floor(64 * float(c)) + 1_000_000 for c in v]
        away = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for c in range(1, 17):
            r = found[i, c]
            mine = float(away @ vectors[:, -c]) / values[-c] ** 0.5
            sign = signs.setdefault(c, np.sign(mine * r["whitened"]))
            assert abs(r["whitened"] - sign * mine) < 1e-9
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r["explained"] - values[-c] / np.trace(plain)) < 1e-12 and 0 <= r["identity_error"] < 1e-9


SCHEMA = "vec_id long, embedding array<double>, n int, _x string, component int"


def test_odd_rows(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [3.0, -1.0]]
    odd = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [-inf, 1.0], [1e300, 1.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, 1, "a", 2) for i, v in enumerate(good)] + [(None, good[0], 1, "a", 2)] + [(100 + i, v, 1, "b", 3) for i, v in enumerate(odd)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in found) == [(False, i, c) for i in range(4) for c in (1, 2)] + [(True, 0, 1), (True, 0, 2)]
    assert {r["n"] for r in found} == {3}
    same = {r["vec_id"]: r["whitened"] for r in found if r["component"] == 1}
    assert same[1] == same[3] and same[0] == same[None]


def test_tables_without_spread(spark):
    for rows in ([], [(1, [1.0, 2.0], 1, "a", 2)] * 3, [(1, None, 1, "a", 2)], [(1, [], 1, "a", 2)]):
        df = W.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not df.collect()


def test_components_follow_the_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 1, "a", 2) for i in range(6)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in found} == {1} and abs(found[0]["explained"] - 1) < 1e-12


def test_large_entries(spark):
    big = 2.0**44
    rows = [(1, [big, 0.0], 1, "a", 2), (2, [-big, 1.0], 1, "a", 2), (3, [0.0, 5.0], 1, "a", 2)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["deviation"] is None for r in found if r["vec_id"] != 3) and found[0]["identity_error"] < 1e-4
