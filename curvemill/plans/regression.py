"""Functional regression on all covariates at once, and curves adjusted for them.

Every covariate has a curve whose wavelet coefficients share a mixture prior;
coordinate updates, residual variance and prior alternate on the moments until the mixture's weights settle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mixture as mx
from ..functions import wavelets as wv
from ..operators.moments import Moments, moments
from .finemap import SIGMA2_FLOOR


@dataclass
class RegressionFit:
    curves: np.ndarray
    grid: np.ndarray
    mle: np.ndarray
    se: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    prior: mx.Prior
    sigma2: float
    x_mean: np.ndarray
    y_mean: np.ndarray
    history: list[list[np.ndarray]] = field(default_factory=list)

    def curves_table(self, spark: SparkSession) -> DataFrame:
        """(j, t, f): units of the response per unit of the covariate."""
        p, t = self.curves.shape
        return spark.createDataFrame(pa.table({"j": np.repeat(np.arange(p), t), "t": np.tile(np.arange(1, t + 1), p), "f": self.curves.ravel()}))

    def adjusted_rows(self, rows: DataFrame, key: str, x: str = "x", y: str = "y", to_grid: np.ndarray | None = None) -> DataFrame:
        """(key, t, y): curves less the covariates' effects; no join, the effects are literals of the plan."""
        out = F.col(y) if to_grid is None else F.array(*(sum(F.col(y)[int(k)] * float(v) for k, v in zip(np.flatnonzero(r), r[np.flatnonzero(r)], strict=True)) for r in to_grid))
        for j, c in enumerate(self.curves):
            off = F.col(x)[j] - float(self.x_mean[j])
            effect = F.array(*(F.lit(float(v)) * off for v in c))
            out = F.zip_with(out, effect, lambda a, f: a - f)
        return rows.select(key, F.posexplode(out).alias("t", "y")).withColumn("t", F.col("t") + 1)


def fit_moments(m: Moments, pos: np.ndarray | None = None, *, prior: str = "single", max_iterations: int = 100, tolerance: float = 1e-3, max_scale: int = 10, filter_moments: int = 10, family: str = "least_asymmetric") -> RegressionFit:
    p, t = m.p, m.cross.shape[0] - m.p
    pos = np.arange(1, t + 1, dtype=float) if pos is None else np.asarray(pos, float)
    grid, to_grid = wv.interpolation(pos, max_scale) if wv.needs_remap(pos, max_scale) else (pos, np.eye(t))
    w = wv.transform_matrix(len(grid), filter_moments, family)
    a = w @ to_grid
    var = np.diag(m.xtx) / (m.n - 1)
    x_sd = np.where(var > 1e-12, np.sqrt(np.maximum(var, 0)), 1.0)
    xtx, xty = m.xtx / np.outer(x_sd, x_sd), m.xty @ a.T / x_sd[:, None]
    d, yty = np.where(var > 1e-12, np.diag(xtx), 0.0), np.diag(a @ m.yty @ a.T)
    live = np.flatnonzero(d > 0)
    size = xty.shape[1]
    sigma2 = max(float(yty.sum()) / (m.n - 1) / size, SIGMA2_FLOOR)
    first = np.zeros(xty.shape)
    first[live] = xty[live] / d[live][:, None]
    sd = mx.sd_grid(first[live], np.broadcast_to(np.sqrt(sigma2 / d[live])[:, None], first[live].shape))
    g = mx.start_prior(sd, wv.scale_blocks(size), prior == "per_scale")
    mean, spread, mle, se = np.zeros(xty.shape), np.zeros(xty.shape), np.zeros(xty.shape), np.ones(xty.shape)
    history: list[list[np.ndarray]] = []
    for _ in range(max_iterations):
        for j in live:
            rest = xty[j] - xtx[j] @ mean + xtx[j, j] * mean[j]
            mle[j], se[j] = rest / d[j], math.sqrt(sigma2 / d[j])
            post, sd_j = mx.posterior(g, mle[j : j + 1], se[j : j + 1])
            mean[j], spread[j] = post[0], sd_j[0] ** 2
        error = float(yty.sum()) - 2 * float((mean * xty).sum()) + float((mean * (xtx @ mean)).sum()) + float((d[:, None] * spread).sum())
        sigma2 = max(error / (m.n * size), SIGMA2_FLOOR)
        new = mx.fit_prior(g, mle[live], se[live], np.ones(len(live)), penalised=False)
        moved = sum(float(np.abs(x.weight - y.weight).sum()) for x, y in zip(new.parts, g.parts, strict=True)) / math.log(max(3, sum(len(x.weight) for x in g.parts)))
        g = new
        history.append([x.weight for x in g.parts])
        if moved < tolerance:
            break
    return RegressionFit(mean @ w / x_sd[:, None], grid, mle, se, mean, spread, g, sigma2, m.mean[:p], m.mean[p:], history)


class FunctionalRegression:
    def __init__(self, **settings):
        self.settings = settings

    def fit(self, rows: DataFrame, *, x: str = "x", y: str = "y", pos: np.ndarray | None = None) -> RegressionFit:
        return fit_moments(moments(rows, x=x, y=y), pos, **self.settings)


def wavelet_regression(m: Moments, *, moments: int = 10, family: str = "least_asymmetric", null_weight: float = 10.0) -> np.ndarray:
    """Curves of covariates (P x T) by least squares on all of them with an intercept, coefficient by coefficient; each covariate's scales are shrunk on their own.

    The responses must have 2**k points. Rows less ``x @ curves`` are adjusted for the covariates (``moments.adjusted``).
    """
    t = m.cross.shape[0] - m.p
    w = wv.transform_matrix(t, moments, family)
    inverse = np.linalg.pinv(m.xtx)
    beta = inverse @ m.xty @ w.T
    rest = np.maximum(np.einsum("ij,jk,ik->i", w, m.yty, w) - np.einsum("pt,pt->t", beta, m.xty @ w.T), 0) / max(1, m.n - 1 - m.p)
    se = np.sqrt(np.maximum(np.outer(np.diag(inverse), rest), 1e-24))
    out = np.zeros_like(beta)
    for block in wv.scale_blocks(t):
        for i in range(m.p):
            out[i, block] = mx.shrink(beta[i, block], se[i, block], null_weight)[0]
    return out @ w
