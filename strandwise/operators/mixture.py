"""Mixture proportions of scored reads.

With a = P(normal) / margin and b = P(type) / margin, a read contributes log((1 - t) a + t b).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from strandwise.session import stage

ROWS_PER_BLOCK = 256  # reads x grid points held at once inside a task
GROUP_ROWS = 2_000_000  # reads of one region handled by one task
GROUPS = 64  # in which the tasks' vectors are added first
LOW, HIGH = 1e-10, 1 - 1e-10


def _curve(a: np.ndarray, b: np.ndarray, theta: np.ndarray) -> np.ndarray:
    total = np.zeros(len(theta))
    for i in range(0, len(a), ROWS_PER_BLOCK):
        x, y = a[i : i + ROWS_PER_BLOCK, None], b[i : i + ROWS_PER_BLOCK, None]
        total += np.log((1 - theta) * x + theta * y).sum(axis=0)
    return total


def _ratios(scored: DataFrame, margins: tuple[float, float], *keys: str) -> DataFrame:
    return scored.select(
        *keys, (F.col("p_n") / float(margins[0])).alias("a"), (F.col("p_t") / float(margins[1])).alias("b")
    )


def mixture_curve(scored: DataFrame, margins: tuple[float, float], n: int = 10_000) -> DataFrame:
    """Log-likelihood at t = 0, 1/n, ..., (n-1)/n as rows (grid, loglik).

    Every task sums its reads into one vector of n numbers; the vectors are added in groups and the
    groups' sums once more, so no task sees more than a share of them.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        theta = np.arange(n) / n
        total, seen = np.zeros(n), False
        for pdf in batches:
            total += _curve(pdf["a"].to_numpy(), pdf["b"].to_numpy(), theta)
            seen = seen or len(pdf) > 0
        if seen:
            yield pd.DataFrame({"group": [TaskContext.get().partitionId() % GROUPS], "curve": [total]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": [0], "curve": [np.sum(pdf["curve"].to_list(), axis=0)]})

    schema = "group int, curve array<double>"
    parts = _ratios(scored, margins).mapInPandas(partial, schema)
    whole = parts.groupBy("group").applyInPandas(added, schema).groupBy("group").applyInPandas(added, schema)
    return whole.select(F.posexplode("curve").alias("grid", "loglik"))


def _summary(curve: np.ndarray) -> tuple[float, float, float]:
    """Best grid point (the first of equals), variance of successive differences, largest log-likelihood."""
    n = len(curve)
    fi = float(np.var(np.diff(curve))) if n > 1 else float("nan")
    return int(curve.argmax()) / n, fi, float(curve.max())


def mixture_grid(scored: DataFrame, margins: tuple[float, float], n: int = 10_000) -> DataFrame:
    """Share of the type that maximises the likelihood on the grid; one row."""
    curve = mixture_curve(scored, margins, n)
    step = Window.partitionBy(F.lit(0)).orderBy("grid")  # n rows
    rows = curve.withColumn("_d", F.col("loglik") - F.lag("loglik").over(step))
    best = F.min_by("grid", F.struct(-F.col("loglik"), F.col("grid")))
    return rows.agg((best / F.lit(float(n))).alias("purity"), F.var_pop("_d").alias("fi"), F.max("loglik").alias("loglik"))


def mixture_grid_by_region(
    scored: DataFrame, margins: tuple[float, float], n: int = 10_000, region: str = "dmr_label", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The grid search inside every region.

    A region with many reads is cut into parts of ``group_rows`` by read id. A part gives one vector; a
    region's vectors are added and searched in one step, so one row per region leaves it.
    """
    sizes = stage(
        scored.groupBy(region).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("_parts")), "region-sizes"
    )
    salted = (
        _ratios(scored, margins, region, "read_id").join(sizes, region)
        .withColumn("_part", F.pmod(F.xxhash64("read_id"), F.col("_parts").cast("long")))
        .drop("read_id", "_parts")
    )
    kind = scored.schema[region].dataType.simpleString()

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _curve(pdf["a"].to_numpy(), pdf["b"].to_numpy(), np.arange(n) / n)
        return pd.DataFrame({region: [pdf[region].iloc[0]], "curve": [total]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        purity, fi, loglik = _summary(np.sum(pdf["curve"].to_list(), axis=0))
        return pd.DataFrame({region: [pdf[region].iloc[0]], "purity": [purity], "fi": [fi], "loglik": [loglik]})

    parts = salted.groupBy(region, "_part").applyInPandas(partial, f"`{region}` {kind}, curve array<double>")
    return parts.groupBy(region).applyInPandas(finish, f"`{region}` {kind}, purity double, fi double, loglik double")


def mean_purity(by_region: DataFrame) -> DataFrame:
    """Mean of the region purities, clipped to [0, 1]; one row."""
    return by_region.agg(
        F.count("*").alias("n_regions"), F.greatest(F.least(F.avg("purity"), F.lit(1.0)), F.lit(0.0)).alias("purity")
    )


def region_moments(values: DataFrame, mean: float, value: str = "purity", by: tuple[str, ...] = ()) -> DataFrame:
    """Second and third moment about a given mean, and the squared skewness."""
    d = F.col(value) - float(mean)
    m2, m3 = F.avg(d * d), F.avg(d * d * d)
    return values.groupBy(*by).agg(
        F.count("*").alias("n"), m2.alias("m2"), m3.alias("m3"),
        F.when(m2 > 0, m3 * m3 / (m2 * m2 * m2)).alias("skewness_sq"),
    )


def _ray_minimum(m: dict[tuple[int, int], float], r: float, c: float) -> float:
    """How far to go along the steepest descent of the squared skewness: its first minimum on the ray, 0 if none.

    ``m[j, k]`` is the mean of purity^j times deviation^k. A step t moves every deviation d by t q with
    q = -c p^2 (d^2 - r d), so second and third moment are polynomials in t and no further pass is needed.
    """
    dq, qq = -c * (m[2, 3] - r * m[2, 2]), c**2 * (m[4, 4] - 2 * r * m[4, 3] + r**2 * m[4, 2])
    ddq, dqq = -c * (m[2, 4] - r * m[2, 3]), c**2 * (m[4, 5] - 2 * r * m[4, 4] + r**2 * m[4, 3])
    qqq = -(c**3) * (m[6, 6] - 3 * r * m[6, 5] + 3 * r**2 * m[6, 4] - r**3 * m[6, 3])
    scale = (m[0, 2] / qq) ** 0.5 if qq > 0 else 1.0  # t in units that keep the coefficients alike
    m2 = np.polynomial.Polynomial([m[0, 2], 2 * dq * scale, qq * scale**2])
    m3 = np.polynomial.Polynomial([m[0, 3], 3 * ddq * scale, 3 * dqq * scale**2, qqq * scale**3])
    turns = 2 * m3.deriv() * m2 - 3 * m3 * m2.deriv()
    ahead = [t.real for f in (m3, turns) for t in f.roots() if abs(t.imag) <= 1e-9 * max(1.0, abs(t)) and t.real > 1e-12]
    return min(ahead, default=0.0) * scale


POWERS = ((0, 1), (0, 2), (0, 3), (2, 2), (2, 3), (2, 4), (4, 2), (4, 3), (4, 4), (4, 5), (6, 3), (6, 4), (6, 5), (6, 6))


def skewness_weights(
    by_region: DataFrame, region: str = "dmr_label", rounds: int = 10, steps: int = 25, close: float = 1e-4, flat: float = 1e-5
) -> tuple[DataFrame, dict]:
    """One weight per region that takes the skewness out of the weighted purities, and what was reached.

    ``by_region`` holds ``region`` and ``purity``. In every round the estimate (mean weighted purity) is held while the
    weights go down the squared skewness about it; rounds end when the estimate moves by less than ``close``. The
    gradient is closed-form in the second and third moment, so a step is one aggregate over the table of weights and a line
    search over a polynomial on the driver. Weights stay in a table with a row per region.

    Returns the table ``region, purity, weight`` and a dict of ``purity`` (clipped to [0, 1]), ``skewness_sq``,
    ``n_regions``, ``converged``. Regions without a purity are left out; equal purities keep weight 1; no regions give
    purity None.
    """
    table = by_region.where(F.col("purity").isNotNull()).select(region, F.col("purity").cast("double").alias("purity"), F.lit(1.0).alias("weight"))
    table = stage(table, "region-weights")
    n, estimate = table.agg(F.count("*"), F.avg(F.col("purity") * F.col("weight"))).first()
    if not n:
        return table, {"purity": None, "skewness_sq": None, "n_regions": 0, "converged": True}
    skewness, converged = None, False
    for _ in range(rounds):
        about, moved = estimate, False
        for _ in range(steps):
            d = F.col("purity") * F.col("weight") - float(about)
            term = lambda j, k: F.avg(F.pow(F.col("purity"), F.lit(float(j))) * F.pow(d, F.lit(float(k))))  # noqa: B023, E731
            m = dict(zip(POWERS, table.agg(*[term(j, k).alias(f"m{j}{k}") for j, k in POWERS]).first()))
            estimate = about + m[0, 1]
            if m[0, 2] <= (1e-15 * about) ** 2:  # all alike: no skewness to speak of
                skewness = None
                break
            skewness = m[0, 3] ** 2 / m[0, 2] ** 3
            r, c = m[0, 3] / m[0, 2], 6 * m[0, 3] / (n * m[0, 2] ** 3)
            slope = abs(c) * (n * max(0.0, m[2, 4] - 2 * r * m[2, 3] + r**2 * m[2, 2])) ** 0.5
            t = _ray_minimum(m, r, c) if slope > flat else 0.0
            if not t:
                break
            moved = True
            table = stage(table.withColumn("weight", F.col("weight") - float(t * c) * F.col("purity") * (d * d - float(r) * d)), "region-weights")
        else:
            estimate = table.agg(F.avg(F.col("purity") * F.col("weight"))).first()[0]
        if not moved or abs(estimate - about) < close:
            converged = True
            break
    return table, {"purity": min(max(estimate, 0.0), 1.0), "skewness_sq": skewness, "n_regions": n, "converged": converged}


def skewness_purity(by_region: DataFrame, region: str = "dmr_label", **how) -> DataFrame:
    """``n_regions, purity, skewness_sq, converged``: the mean of the region purities under ``skewness_weights``; one row."""
    _, reached = skewness_weights(by_region, region, **how)
    row = (reached["n_regions"], reached["purity"], reached["skewness_sq"], reached["converged"])
    return by_region.sparkSession.createDataFrame([row], "n_regions long, purity double, skewness_sq double, converged boolean")


def _next_brackets(points: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New bounds and the interpolated solution of sum(theta) = 1 from slopes sampled per type.

    ``points`` (types x samples) increase and ``slopes`` decrease along each row. At the solution all
    slopes equal one multiplier; every sampled slope is tried as its value.
    """

    def below(lam: float) -> np.ndarray:
        k = (slopes >= lam).sum(axis=1)
        return points[np.arange(len(points)), np.maximum(k - 1, 0)]

    def above(lam: float) -> np.ndarray:
        k = (slopes > lam).sum(axis=1)
        return points[np.arange(len(points)), np.minimum(k, points.shape[1] - 1)]

    def between(lam: float) -> np.ndarray:
        return np.array([np.interp(-lam, -s, p) for s, p in zip(slopes, points)])

    tried = np.unique(slopes)
    small = [x for x in tried if below(x).sum() > 1]
    large = [x for x in tried if above(x).sum() < 1]
    low = below(min(large)) if large else points[:, 0]
    high = above(max(small)) if small else points[:, -1]
    a, b = tried[0], tried[-1]
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if between(mid).sum() > 1 else (a, mid)
    return low, high, np.clip(between((a + b) / 2), low, high)


def mixture_proportions(
    scored: DataFrame, margins: dict[str, float], tolerance: float = 1e-9, max_rounds: int = 30, reach: int = 10
) -> DataFrame:
    """Shares of more than two types that maximise the summed log-likelihood and add up to 1.

    The objective is a sum of one concave function per type, so the answer is where all slopes are
    equal. Each round samples every type's slope at a few shares with one grouped aggregate over the
    reads and narrows the bounds; the driver sees types x samples numbers. Samples lie close around the
    interpolated answer, which makes the bounds shrink quickly. ``converged`` is false where the bounds were
    still wider than ``tolerance`` after ``max_rounds``.
    """
    names = sorted(margins)
    spark = scored.sparkSession
    table = spark.createDataFrame([(t, float(margins[t])) for t in names], "dmr_ctype string, m double")
    a, b = (1.0 - F.col("p_ctype")) / (1.0 - F.col("m")), F.col("p_ctype") / F.col("m")
    reads = stage(scored.join(table, "dmr_ctype").select("dmr_ctype", a.alias("a"), (b - a).alias("d")), "ratios")
    low, high = np.full(len(names), LOW), np.full(len(names), HIGH)
    guess = np.array([margins[t] for t in names], dtype=float)
    guess = np.clip(guess / guess.sum(), LOW, HIGH)
    done = False
    for _ in range(max_rounds):
        width = (high - low)[:, None]
        steps = np.concatenate([-(4.0 ** -np.arange(1, reach + 1)), [0.0], 4.0 ** -np.arange(reach, 0, -1)])
        points = np.sort(
            np.concatenate([low[:, None], np.clip(guess[:, None] + width * steps, low[:, None], high[:, None]), high[:, None]], axis=1),
            axis=1,
        )
        grid = spark.createDataFrame([(t, p.tolist()) for t, p in zip(names, points)], "dmr_ctype string, at array<double>")
        sums = reads.join(F.broadcast(grid), "dmr_ctype").groupBy("dmr_ctype").agg(
            *[F.sum(F.col("d") / (F.col("a") + F.get("at", F.lit(j)) * F.col("d"))).alias(f"s{j}") for j in range(points.shape[1])]
        )
        found = {r["dmr_ctype"]: [r[f"s{j}"] for j in range(points.shape[1])] for r in sums.collect()}  # one row per type
        slopes = np.array([found.get(t, [0.0] * points.shape[1]) for t in names])
        slopes = np.minimum.accumulate(slopes, axis=1)  # rounding must not break the order
        low, high, answer = _next_brackets(points, slopes)
        done = np.max(high - low) < tolerance or np.max(np.abs(answer - guess)) < tolerance / 10
        guess = answer
        if done:
            break
    share = np.clip(guess, LOW, HIGH)
    share = share / share.sum()
    return spark.createDataFrame(
        [(t, float(x), bool(done)) for t, x in zip(names, share)], "cell_type string, pred double, converged boolean"
    )
