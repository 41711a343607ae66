"""Score mixtures: a skewed normal noise component and a lognormal signal in the positive tail.

Fitting needs a histogram only: scores are counted in ``BINS`` narrow bins in
Spark, and expectation maximisation runs on the bins' means and counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
_ERF = np.vectorize(math.erf, otypes=[float])


def skew_normal(x: np.ndarray, scale: float, skew: float) -> np.ndarray:
    """Density of the skew normal distribution of mean 0."""
    location = -scale * skew / math.sqrt(1 + skew * skew) * math.sqrt(2 / math.pi)
    z = (x - location) / scale
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (1 + _ERF(skew * z / math.sqrt(2))) / scale


def log_normal(x: np.ndarray, mu: float, sigma: float) -> np.ndarray:
    out = np.zeros(len(x))
    up = x > 0
    z = (np.log(x[up]) - mu) / sigma
    out[up] = np.exp(-z * z / 2) / (x[up] * sigma * math.sqrt(2 * math.pi))
    return out


def posterior(x: np.ndarray, p: float, scale: float, skew: float, mu: float, sigma: float) -> np.ndarray:
    """Probability of the signal; 0 for scores up to 0. ``p`` is the noise's share."""
    noise, signal = p * skew_normal(x, scale, skew), (1 - p) * log_normal(x, mu, sigma)
    return np.where(x > 0, signal / np.maximum(noise + signal, 1e-300), 0.0)


def simplex_minimum(f, start: np.ndarray, steps: int = 400, tolerance: float = 1e-9) -> np.ndarray:
    """Nelder and Mead's downhill simplex."""
    points = [start] + [start + d for d in np.diag(np.maximum(np.abs(start) * 0.1, 0.05))]
    values = [f(x) for x in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        tries = [(k, centre + k * (centre - points[-1])) for k in (1.0,)]
        up = f(tries[0][1])
        if up < values[0]:
            far = centre + 2 * (centre - points[-1])
            low = f(far)
            points[-1], values[-1] = (far, low) if low < up else (tries[0][1], up)
        elif up < values[-2]:
            points[-1], values[-1] = tries[0][1], up
        else:
            near = centre + 0.5 * (points[-1] - centre)
            low = f(near)
            if low < values[-1]:
                points[-1], values[-1] = near, low
            else:
                points = [points[0]] + [points[0] + 0.5 * (x - points[0]) for x in points[1:]]
                values = [values[0]] + [f(x) for x in points[1:]]
    return points[int(np.argmin(values))]


def fit(histogram: pd.DataFrame, rounds: int = 200, tolerance: float = 1e-4) -> tuple[float, ...]:
    """``p, scale, skew, mu, sigma`` of bins with ``x`` and ``n``."""
    x, n = histogram["x"].to_numpy(float), histogram["n"].to_numpy(float)
    up = x > 0
    scale, skew, p = math.sqrt((n * x * x).sum() / n.sum()) or 1.0, 0.0, 0.8
    top = np.log(x[up])[np.argsort(x[up])][-max(2, int(up.sum() * 0.2)) :]
    mu, sigma = float(top.mean()), max(0.1, float(top.std()))
    last = -math.inf
    for _ in range(rounds):
        noise, signal = p * skew_normal(x, scale, skew), (1 - p) * log_normal(x, mu, sigma)
        total = np.maximum(noise + signal, 1e-300)
        likelihood = float((n * np.log(total)).sum())
        if likelihood - last < tolerance and last > -math.inf:
            break
        last = likelihood
        r = n * signal / total
        p = 1 - r.sum() / n.sum()
        if r.sum() > 1e-9:
            mu = float((r[up] * np.log(x[up])).sum() / r.sum())
            sigma = max(1e-3, math.sqrt((r[up] * (np.log(x[up]) - mu) ** 2).sum() / r.sum()))
        w = n * noise / total
        best = simplex_minimum(lambda t: -(w * np.log(np.maximum(skew_normal(x, math.exp(t[0]), t[1]), 1e-300))).sum(), np.array([math.log(scale), skew]), 60)
        scale, skew = math.exp(best[0]), float(best[1])
    return p, scale, skew, mu, sigma


def score_bins(ecs: DataFrame, score: str) -> pd.DataFrame:
    """Mean and count of the scores of each of ``BINS`` bins."""
    low, high = ecs.agg(F.min(score), F.max(score)).first()
    width = ((high - low) or 1.0) / BINS
    return ecs.groupBy(F.floor((F.col(score) - low) / width).alias("bin")).agg(F.avg(score).alias("x"), F.count(score).alias("n")).orderBy("bin").toPandas().dropna()


def add_probability(ecs: DataFrame, score: str = "score", name: str = "probability") -> DataFrame:
    """``ecs`` with the posterior probability of each score's being signal."""
    parameters = fit(score_bins(ecs, score))

    def run(batches):
        for frame in batches:
            yield frame.assign(**{name: posterior(frame[score].to_numpy(float), *parameters)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ecs.schema.fields)
    return ecs.mapInPandas(run, f"{fields}, `{name}` double")


def fit_normal(histogram: pd.DataFrame, clamp_mean: bool = False, rounds: int = 2000) -> tuple[float, ...]:
    """``mean, deviation, q, mu, sigma`` of a normal noise of weight q and a lognormal signal, of greatest likelihood; an error if no signal is left."""
    x, n = histogram["x"].to_numpy(float), histogram["n"].to_numpy(float)
    mean = (n * x).sum() / n.sum()
    deviation = math.sqrt((n * (x - mean) ** 2).sum() / n.sum())
    upper = x[np.argsort(x)][np.searchsorted(np.cumsum(n[np.argsort(x)]), 0.75 * n.sum())]

    def cost(t: np.ndarray) -> float:
        m, d, q, mu, sigma = t
        if clamp_mean:
            m = 0.0
        if d <= 0 or sigma <= 0:
            return math.inf
        with np.errstate(all="ignore"):
            density = q * np.exp(-(((x - m) / d) ** 2) / 2) / (d * math.sqrt(2 * math.pi)) + (1 - q) * log_normal(x, mu, sigma)
            value = -(n * np.log(density)).sum()
        return math.inf if math.isnan(value) else float(value)

    best = simplex_minimum(cost, np.array([0.0, deviation, 0.95, upper - 0.4**2 / 2, 0.4]), rounds)
    if clamp_mean:
        best[0] = 0.0
    if not best[2] < 1:
        raise ValueError(f"no tail: the normal part has weight {best[2]}")
    return tuple(map(float, best))


def add_normal_probability(ecs: DataFrame, score: str = "score", name: str = "probability", clamp_mean: bool = False) -> DataFrame:
    """``ecs`` with the posterior probability of the lognormal tail beside normal noise, as columns of the score."""
    mean, deviation, q, mu, sigma = fit_normal(score_bins(ecs, score), clamp_mean)
    x = F.col(score).cast("double")
    density = lambda v, m, s: F.exp(-((v - m) / s) ** 2 / 2) / (s * math.sqrt(2 * math.pi))
    signal = F.when(x > 0, (1 - q) * density(F.log(x), mu, sigma) / x).otherwise(0.0)
    return ecs.withColumn(name, signal / (signal + q * density(x, mean, deviation)))
