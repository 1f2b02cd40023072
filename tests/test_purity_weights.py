"""Region weights against a dense solver that takes gradients by differences and scans each ray."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import mixture as X


def squared_skewness(w, p, e):
    d = p * w - e
    m2, m3 = np.mean(d**2), np.mean(d**3)
    return m3**2 / m2**3


def dense(p, rounds=10, steps=25, close=1e-4, flat=1e-5):
    w, estimate = np.ones(len(p)), p.mean()
    for _ in range(rounds):
        about, moved = estimate, False
        for _ in range(steps):
            f = lambda x: squared_skewness(x, p, about)  # noqa: B023, E731
            h = 1e-6
            g = np.array([(f(w + h * np.eye(len(p))[i]) - f(w - h * np.eye(len(p))[i])) / (2 * h) for i in range(len(p))])
            if np.linalg.norm(g) <= flat:
                break
            step = 1e-4 * np.std(p * w - about) / np.linalg.norm(g * p) * len(p) ** 0.5
            t = 0.0
            while f(w - (t + step) * g) < f(w - t * g):  # walk to the first minimum
                t += step
            lo, hi = max(0.0, t - step), t + step
            for _ in range(80):
                a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
                lo, hi = (lo, b) if f(w - a * g) < f(w - b * g) else (a, hi)
            w, moved = w - (lo + hi) / 2 * g, True
        estimate = np.mean(p * w)
        if not moved or abs(estimate - about) < close:
            break
    return w, min(max(estimate, 0.0), 1.0)


def table(spark, p):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "dmr_label int, purity double")


@pytest.mark.parametrize("p", [
    [0.1, 0.12, 0.15, 0.2, 0.9], list(np.random.default_rng(3).beta(2, 5, 30)),
])
def test_against_dense_solver(spark, p):
    w, purity = dense(np.array(p), rounds=3)
    weights, reached = X.skewness_weights(table(spark, p), rounds=3)
    assert not reached["converged"] and reached["purity"] == pytest.approx(purity, abs=1e-8) and reached["skewness_sq"] < 1e-12
    assert [r.weight for r in weights.orderBy("dmr_label").collect()] == pytest.approx(list(w), abs=1e-8)


def test_estimates_settle(spark):
    p = [0.5, 0.45, 0.6, 0.1, 0.05, 0.55, 0.5]
    got = X.skewness_purity(table(spark, p)).first()
    assert got.converged and got.purity == pytest.approx(dense(np.array(p))[1], abs=1e-8)


def test_ray_minimum_is_the_first_one():
    """The polynomials of a step against the objective itself."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        p, w = rng.uniform(0, 1, 12), rng.uniform(0.5, 1.5, 12)
        e, n = float(np.mean(p * w)) + 0.01, 12
        d = p * w - e
        m = {(j, k): float(np.mean(p**j * d**k)) for j, k in X.POWERS}
        r, c = m[0, 3] / m[0, 2], 6 * m[0, 3] / (n * m[0, 2] ** 3)
        g = c * p * (d**2 - r * d)
        t = X._ray_minimum(m, r, c)
        f = lambda t: squared_skewness(w - t * g, p, e)  # noqa: B023, E731
        assert t > 0 and f(t) <= min(f(0.999 * t), f(1.001 * t)) + 1e-15
        before = [f(x) for x in np.linspace(0, t, 200)]
        assert all(a >= b - 1e-12 for a, b in zip(before, before[1:]))


def test_edges(spark):
    flat = X.skewness_purity(table(spark, [0.3] * 5)).first()
    assert (flat.n_regions, flat.converged) == (5, True) and flat.purity == pytest.approx(0.3)
    assert X.skewness_purity(table(spark, [0.0] * 3)).first().purity == 0.0
    none = X.skewness_purity(table(spark, [0.3]).where("false")).first()
    assert none.n_regions == 0 and none.purity is None
    some = X.skewness_purity(table(spark, [0.1, 0.2, 0.7]).unionByName(spark.createDataFrame([(9, None)], "dmr_label int, purity double"))).first()
    assert some.n_regions == 3
    even = X.skewness_purity(table(spark, [0.2, 0.4, 0.6])).first()  # no skewness to begin with
    assert even.purity == pytest.approx(0.4) and even.converged
    rows = table(spark, [0.1, 0.2, 0.9])
    assert X.skewness_weights(rows, rounds=0)[1]["converged"] is False
    assert X.skewness_weights(rows)[0].agg(F.count("*")).first()[0] == 3
