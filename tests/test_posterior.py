"""Inverted posteriors against exact integration at small n; fits against simulated cells."""

import math
import random

import numpy as np
import pytest

from tallyspark.operators import posterior


def beta_cdf(x, n, c):
    """P(rate <= x) under the posterior of c of n successes: a binomial sum."""
    x = np.clip(x, 0, 1)
    return sum(math.comb(n + 1, j) * x**j * (1 - x) ** (n + 1 - j) for j in range(c + 1, n + 2))


def density(x, n, c):
    return (n + 1) * math.comb(n, c) * x**c * (1 - x) ** (n - c)


def difference_cdf(y, first, second):
    """P(rate 1 - rate 2 <= y), by quadrature between the points where it bends."""
    x, w = posterior.gauss_legendre(60)
    out, cuts = 0.0, sorted({0.0, 1.0, min(1.0, max(0.0, -y)), min(1.0, max(0.0, 1 - y))})
    for a, b in zip(cuts, cuts[1:]):
        at = a + (b - a) * x
        out += float(((b - a) * w * beta_cdf(at + y, *first) * density(at, *second)).sum())
    return out


def quantile(level, first, second):
    low, high = -1.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if difference_cdf(middle, first, second) < level else (low, middle)
    return low


def test_quadrature():
    for n in (1, 2, 7, 64, 500):
        x, w = posterior.gauss_legendre(n)
        assert abs(w.sum() - 1) < 1e-12 and abs((w * x ** (2 * n - 1)).sum() - 1 / (2 * n)) < 1e-12


@pytest.mark.parametrize(("first", "second"), [((5, 5), (5, 0)), ((3, 0), (4, 0)), ((1, 1), (2, 1)), ((8, 2), (6, 5)), ((60, 58), (50, 3)), ((0, 0), (0, 0))])
def test_one_problem_is_exact(first, second):
    got = posterior.mean_quantiles(np.array([1.0, -1.0]), *(np.array([first[i], second[i]], float) for i in (0, 1)), np.ones(2), 1, (0.025, 0.5, 0.975))
    assert abs(got[0] - ((first[1] + 1) / (first[0] + 2) - (second[1] + 1) / (second[0] + 2))) < 1e-12
    for level, q in zip((0.025, 0.5, 0.975), got[1:]):
        assert abs(q - quantile(level, first, second)) < 1e-6


def test_many_problems_and_contrasts_against_a_grid():
    """Densities on a fine grid, convolved."""
    cells = [(1, 6, 5), (-1, 6, 1), (-1, 4, 4), (1, 3, 0)]
    step = 1 / 4000
    x = (np.arange(4000) + 0.5) * step
    total, at = np.ones(1), 0.0
    for s, n, c in cells:
        own = density(x, n, c) * step
        total = np.convolve(total, own if s > 0 else own[::-1])
        at += x[0] if s > 0 else -x[-1]
    cdf = np.cumsum(total) / total.sum()
    grid = at + np.arange(len(total)) * step + step / 2
    got = posterior.mean_quantiles(*(np.array([z[i] for z in cells], float) for i in range(3)), np.ones(4), 1, (0.025, 0.975))
    for level, q in zip((0.025, 0.975), got[1:]):
        assert abs(q - np.interp(level, cdf, grid)) < 1e-4
    many = posterior.mean_quantiles(np.array([1.0, -1.0]), np.array([10.0, 20.0]), np.array([7.0, 3.0]), np.array([400.0, 400.0]), 400, (0.025, 0.975))
    var = sum((a := c + 1) * (b := n - c + 1) / ((a + b) ** 2 * (a + b + 1)) for n, c in ((10, 7), (20, 3))) / 400
    assert abs(many[1] - (many[0] - 1.959964 * var**0.5)) < 1e-4 and abs(many[2] - (many[0] + 1.959964 * var**0.5)) < 1e-4


def test_normal_interval_is_off_where_this_is_not():
    got = posterior.mean_quantiles(np.array([1.0, -1.0]), np.array([3.0, 3.0]), np.array([3.0, 0.0]), np.ones(2), 1, (0.975,))
    assert got[1] < 1 and abs(got[1] - quantile(0.975, (3, 3), (3, 0))) < 1e-6


def test_intervals_of_samples(spark):
    rows = [(m, s, c, p, (p + i) % 3 == 0 or m == "rl" and i % 2 == 0) for m, s in (("base", None), ("rl", 0), ("rl", 1)) for c in "TE" for p in range(5) for i in range(4)]
    df = spark.createDataFrame(rows + [("rl", 0, "T", 99, True)], "model string, seed int, condition string, problem_id long, correct boolean")
    got = {(r["seed"], r["metric"]): r for r in posterior.exact_intervals(df).collect()}
    assert set(got) == {(s, m) for s in (0, 1) for m in ("dt", "dp", "did")}
    assert all(r["n"] == 5 and r["lo"] < r["point"] < r["hi"] for r in got.values())
    assert abs(got[0, "did"]["point"]) < 1e-12 and posterior.exact_intervals(df.limit(0)).count() == 0


def simulated(a, b, problems, n, seed):
    r = random.Random(seed)
    return [(p, n, sum(r.random() < q for _ in range(n))) for p in range(problems) for q in [r.betavariate(a, b)]]


@pytest.mark.parametrize(("a", "b"), [(0.5, 2.0), (2.0, 8.0), (6.0, 6.0)])
def test_fit_recovers_simulated_rates(spark, a, b):
    cells = spark.createDataFrame([("x", *row) for row in simulated(a, b, 3000, 20, 1)], "g string, problem_id long, n long, c long")
    fit = posterior.fitted(cells, ["g"]).first()
    assert abs(fit["a"] / a - 1) < 0.12 and abs(fit["b"] / b - 1) < 0.12 and fit["n_problems"] == 3000
    true = 1 - math.prod((b + i) / (a + b + i) for i in range(64))
    assert abs(posterior.predicted(posterior.fitted(cells, ["g"]), ["g"], [64]).first()["pass_at_k"] - true) < 0.02


def test_fit_is_a_maximum_and_serves_alike_problems():
    n, c, w = (np.array(x, float) for x in ([10, 10, 10, 4], [0, 5, 10, 1], [5, 3, 2, 4]))

    def log_likelihood(a, b):
        g = math.lgamma
        return sum(k * (g(y + a) - g(a) + g(m - y + b) - g(b) - g(m + a + b) + g(a + b)) for m, y, k in zip(n, c, w))

    a, b = posterior.beta_binomial(n, c, w)
    best = log_likelihood(a, b)
    assert all(log_likelihood(a * x, b * y) <= best + 1e-12 for x in (0.99, 1, 1.01) for y in (0.99, 1, 1.01))
    a, b = posterior.beta_binomial(np.full(3, 10.0), np.full(3, 5.0), np.ones(3))
    assert a + b > 1e5 and abs(a / (a + b) - 0.5) < 1e-6
    for hits in (0.0, 10.0):
        a, b = posterior.beta_binomial(np.array([10.0]), np.array([hits]), np.array([4.0]))
        assert 0 < a < 1e6 and 0 < b < 1e6


def test_prediction_from_few_samples(spark):
    r = random.Random(8)
    rows = [("m", p, i, r.random() < q) for p in range(400) for q in [r.betavariate(0.6, 3)] for i in range(128)]
    df = spark.createDataFrame(rows, "model string, problem_id long, sample_idx int, correct boolean")
    got = posterior.extrapolation_check(df, ["model"], 16, 64).first()
    assert abs(got["error"]) < 0.04 and abs(got["predicted"] - got["observed"] - got["error"]) < 1e-12
