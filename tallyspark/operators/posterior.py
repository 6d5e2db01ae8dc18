"""Exact Bayesian intervals of mean gains, and beta-binomial fits, on count histograms.

Spark reduces samples to (n, c) per cell and cells to how many problems have which (n, c);
a task per result then works on that histogram, whose size follows the numbers of samples
a problem has and not the problems.

Intervals: each cell's success rate has the Beta posterior of a uniform prior.  The mean
gain over problems is a sum of independent rates, so its characteristic function is the
product of theirs, one factor per (n, c) to the power of its problems; its distribution
function is found by numeric inversion and the quantiles by bisection.  No normal
approximation is made, so few problems and rates near 0 or 1 are served as well.

Fits: successes of a problem are binomial with a rate that is Beta distributed over
problems; Newton steps on the logarithms of both parameters maximise the likelihood.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.metrics import count_correct, estimates

#: Gain -> its cells with their signs; b is base, r is RL, of conditions T, D and E.
PARTS = {
    "dt": [(1, "rT"), (-1, "bT")], "dd": [(1, "rD"), (-1, "bD")], "dp": [(1, "rE"), (-1, "bE")],
    "did_d": [(1, "rT"), (-1, "bT"), (-1, "rD"), (1, "bD")], "did": [(1, "rT"), (-1, "bT"), (-1, "rE"), (1, "bE")],
}
NODES, CHUNK = 4096, 256


def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [0, 1], by Newton steps from the usual first guess."""
    x = np.cos(np.pi * (np.arange(n) + 0.75) / (n + 0.5))
    for _ in range(100):
        p, before = np.ones(n), np.zeros(n)
        for k in range(1, n + 1):
            p, before = ((2 * k - 1) * x * p - (k - 1) * before) / k, p
        slope = n * (x * p - before) / (x * x - 1)
        step = p / slope
        x = x - step
        if np.abs(step).max() < 1e-15:
            break
    return (1 + x) / 2, 1 / ((1 - x * x) * slope * slope)


def mean_quantiles(sign: np.ndarray, n: np.ndarray, c: np.ndarray, problems: np.ndarray, of: int, levels: tuple[float, ...]) -> list[float]:
    """Mean and quantiles of sum(sign * rate) / ``of`` over cells; ``problems`` cells have
    the same sign, n and c."""
    a, b = c + 1.0, n - c + 1.0
    mean = float((problems * sign * a / (a + b)).sum() / of)
    sd = float(np.sqrt((problems * a * b / ((a + b) ** 2 * (a + b + 1))).sum()) / of)
    width = float(problems.sum() / of)  # beyond every value
    h = max(np.pi / width, 0.2 / sd)
    t = (np.arange(NODES) + 0.5) * h
    # Nodes that resolve both the densities, polynomials of degree n, and the waves.
    most = float(min(t[-1], max(40 / sd, 4000 * h))) / of
    x, w = gauss_legendre(int(max(n.max(), most) / 2) + 48)
    with np.errstate(divide="ignore"):
        log_density = np.outer(c, np.log(x)) + np.outer(n - c, np.log1p(-x))
    density = np.exp(log_density - log_density.max(axis=1, keepdims=True)) * w
    density /= density.sum(axis=1, keepdims=True)
    phi = np.zeros(NODES, complex)
    used = 0
    for at in range(0, NODES, CHUNK):
        s = t[at : at + CHUNK] / of
        if s[-1] > most * 1.0001:
            break
        wave = np.exp(1j * np.outer(x, s))
        total = np.zeros(len(s), complex)
        for i in range(0, len(n), 512):
            own = density[i : i + 512] @ wave
            own = np.where((sign[i : i + 512] < 0)[:, None], own.conj(), own)
            with np.errstate(divide="ignore"):
                total += problems[i : i + 512] @ np.log(own)
        phi[at : at + CHUNK] = np.exp(total)
        used = at + CHUNK
        if np.abs(phi[at : at + CHUNK]).max() < 1e-17:
            break
    t, weight = t[:used], phi[:used] / (np.arange(used) + 0.5)
    below = lambda y: 0.5 - (weight * np.exp(-1j * t * y)).imag.sum() / np.pi
    out = [mean]
    for level in levels:
        low, high = max(-width, mean - 30 * sd), min(width, mean + 30 * sd)
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if below(middle) < level else (low, middle)
        out.append((low + high) / 2)
    return out


def exact_intervals(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """(seed, metric, point, lo, hi, n): posterior mean and interval of the mean pass@1
    gains and of both contrasts (``PARTS``), over problems that have all of a gain's cells."""
    cell = lambda df, keys, name: count_correct(df, keys).select(*keys, F.concat(F.lit(name), "condition").alias("cell"), "n", "c")
    rl = cell(samples.where("model = 'rl'"), ["seed", "condition", "problem_id"], "r")
    base = cell(samples.where("model = 'base'"), ["condition", "problem_id"], "b")
    of = lambda names: [F.max(F.when(F.col("cell") == x, F.struct("n", "c"))).alias(x) for x in names]
    wide = rl.groupBy("seed", "problem_id").agg(*of(["rT", "rD", "rE"])).join(base.groupBy("problem_id").agg(*of(["bT", "bD", "bE"])), "problem_id")
    parts = []
    for metric, cells in PARTS.items():
        whole = F.lit(True)
        for _, x in cells:
            whole = whole & F.col(x).isNotNull()
        each = F.array(*(F.struct(F.lit(metric).alias("metric"), F.lit(s).alias("sign"), F.col(x)["n"].alias("n"), F.col(x)["c"].alias("c")) for s, x in cells))
        parts.append(F.when(whole, each).otherwise(F.array().cast("array<struct<metric:string,sign:int,n:bigint,c:bigint>>")))
    rows = wide.select("seed", F.explode(F.concat(*parts)).alias("x")).select("seed", "x.*")
    histogram = rows.groupBy("seed", "metric", "sign", "n", "c").agg(F.count("*").alias("problems"))
    tail = (1 - level) / 2

    def invert(table: pa.Table) -> pa.Table:
        metric = table.column("metric")[0].as_py()
        sign, n, c, problems = (table.column(x).to_numpy().astype(float) for x in ("sign", "n", "c", "problems"))
        of = round(problems.sum() / len(PARTS[metric]))
        point, lo, hi = mean_quantiles(sign, n, c, problems, of, (tail, 1 - tail))
        return pa.table({"seed": table.column("seed").slice(0, 1), "metric": [metric], "point": [point], "lo": [lo], "hi": [hi], "n": pa.array([of], pa.int64())})

    kind = samples.schema["seed"].dataType.simpleString()
    return histogram.groupBy("seed", "metric").applyInArrow(invert, f"seed {kind}, metric string, point double, lo double, hi double, n long")


def beta_binomial(n: np.ndarray, c: np.ndarray, problems: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Most likely (a, b) of Beta distributed rates; sizes a + b stay under 1e6, where rates
    are alike for all that counts can tell."""
    most = int(n.max())
    above = lambda x: np.array([problems[x > i].sum() for i in range(most)])
    hits, misses, tries = above(c), above(n - c), above(n)
    i = np.arange(most)

    def value(u):
        a, b = np.exp(u)
        return (hits * np.log(a + i) + misses * np.log(b + i) - tries * np.log(a + b + i)).sum()

    m = float(np.clip((problems * c).sum() / (problems * n).sum(), 1e-6, 1 - 1e-6))
    u, best = np.log([m, 1 - m]), -np.inf
    best = value(u)
    for _ in range(steps):
        a, b = np.exp(u)
        all_ = (tries / (a + b + i)).sum()
        slope = np.array([a * ((hits / (a + i)).sum() - all_), b * ((misses / (b + i)).sum() - all_)])
        curve = (tries / (a + b + i) ** 2).sum()
        aa = a * a * (curve - (hits / (a + i) ** 2).sum()) + slope[0]
        bb = b * b * (curve - (misses / (b + i) ** 2).sum()) + slope[1]
        ab = a * b * curve
        # Where the surface is no hill, the curvature is damped until the step leads up.
        damp = max(0.0, (aa + bb) / 2 + np.hypot((aa - bb) / 2, ab)) * 1.1 + 1e-12
        det = (aa - damp) * (bb - damp) - ab * ab
        step = -np.array([(bb - damp) * slope[0] - ab * slope[1], (aa - damp) * slope[1] - ab * slope[0]]) / det
        step *= min(1.0, 2.0 / max(1e-300, np.abs(step).max()))
        while np.abs(step).max() > 1e-13 and value(u + step) < best:
            step = step / 2
        u = u + step
        best = value(u)
        if np.abs(step).max() < 1e-11 or np.exp(u).sum() > 1e6:
            break
    if np.exp(u).sum() > 1e6:
        u = u - np.log(np.exp(u).sum() / 1e6)
    return float(np.exp(u[0])), float(np.exp(u[1]))


def fitted(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, n_problems): beta-binomial fit of cells (by, problem, n, c) with n > 0."""
    histogram = cells.where("n > 0").groupBy(*by, "n", "c").agg(F.count("*").alias("problems"))
    kinds = ", ".join(f"{x} {cells.schema[x].dataType.simpleString()}" for x in by)

    def fit(table: pa.Table) -> pa.Table:
        n, c, problems = (table.column(x).to_numpy().astype(float) for x in ("n", "c", "problems"))
        a, b = beta_binomial(n, c, problems)
        own = {x: table.column(x).slice(0, 1) for x in by}
        return pa.table(own | {"a": [a], "b": [b], "n_problems": pa.array([int(problems.sum())], pa.int64())})

    return histogram.groupBy(*by).applyInArrow(fit, f"{kinds}, a double, b double, n_problems long")


def predicted(fits: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """(by, k, pass_at_k, n_problems): one less the mean chance of k failures."""
    each = fits.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    fail = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda x, i: x * (F.col("b") + i) / (F.col("a") + F.col("b") + i))
    return each.select(*by, "k", (1 - fail).alias("pass_at_k"), "n_problems")


def extrapolation_check(samples: DataFrame, by: list[str], given: int, k: int) -> DataFrame:
    """(by, k, predicted, observed, error, n_problems): pass@k predicted from each problem's
    first ``given`` samples (sample_idx) against the unbiased one of all its samples."""
    few = predicted(fitted(count_correct(samples.where(F.col("sample_idx") < given), [*by, "problem_id"]), by), by, [k])
    seen = estimates(count_correct(samples, [*by, "problem_id"]), [k]).groupBy(*by, "k").agg(F.avg("p").alias("observed"))
    joined = few.withColumnRenamed("pass_at_k", "predicted").join(seen, [*by, "k"])
    return joined.select(*by, "k", "predicted", "observed", (F.col("predicted") - F.col("observed")).alias("error"), "n_problems")
