"""Fine-mapping of curves: iterative single-effect regression on second moments.

One distributed pass gives X'X, X'Y and Y'Y (operators.moments). Interpolation,
scaling and the wavelet transform are linear, so they are applied to the moments; the
loop then runs on the driver on P x J numbers and launches no job. For many small regions
``fit_by_region`` runs the same code inside a grouped function.
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
from ..functions.special import LOG_2PI, log_mean_exp
from ..operators.moments import Medians, Moments, low_medians, moments, partial
from . import smoothing

SIGMA2_FLOOR = math.sqrt(2.220446049250313e-16)
#: What sums may put between a coefficient and the threshold that it equals.
ROUNDING = 1e-12


@dataclass
class Settings:
    effects: int = 10
    start_effects: int = 3
    prior: str = "single"
    max_iterations: int = 100
    tolerance: float = 1e-3
    coverage: float = 0.95
    min_purity: float = 0.5
    min_lbf: float = 0.1
    null_weight: float = 0.1
    tol_null_prior: float = 1e-3
    grid_ratio: float = math.sqrt(2)
    max_scale: int = 10
    max_em_rows: int | None = 100
    em_passes: int = 2
    small_sample: bool = False
    greedy: bool = True
    backfit: bool = True
    negligible: float = 1e-3
    #: Coefficients of at most this median absolute value (standardised) are masked; None saves the second pass over the rows.
    low_count: float | None = 0.0
    filter_moments: int = 10
    family: str = "least_asymmetric"
    smoother: str = "ti"

    def __post_init__(self) -> None:
        if self.effects < 1 or self.start_effects < 1 or self.prior not in ("single", "per_scale") or self.smoother not in ("ti", "smash", "hmm", "none"):
            raise ValueError("effects and start_effects must be positive; prior single or per_scale; smoother ti, smash, hmm or none")


@dataclass
class Effect:
    alpha: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    lbf: np.ndarray
    prior: mx.Prior
    members: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    @property
    def first(self) -> np.ndarray:
        return self.alpha[:, None] * self.mean

    @property
    def second(self) -> np.ndarray:
        return self.alpha[:, None] * (self.var + self.mean**2)

    @property
    def lead(self) -> int:
        return int(np.argmax(self.alpha))

    @property
    def max_lbf(self) -> float:
        finite = self.lbf[np.isfinite(self.lbf)]
        return float(finite.max()) if len(finite) else -math.inf


def credible_set(alpha: np.ndarray, coverage: float) -> np.ndarray:
    """The shortest run of the most probable that exceeds the coverage, or all; ties by index."""
    order = np.argsort(-alpha, kind="stable")
    beyond = np.flatnonzero(np.cumsum(alpha[order]) > coverage)
    return order[: int(beyond[0]) + 1 if len(beyond) else len(order)]


def relation(a: np.ndarray, b: np.ndarray) -> str:
    x, y = set(a.tolist()), set(b.tolist())
    return "identical" if x == y else "a_in_b" if x < y else "b_in_a" if y < x else "none"


@dataclass
class State:
    """Sufficient statistics in coefficient space and the effects so far."""

    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    n: int
    masked: np.ndarray
    settings: Settings
    prior: mx.Prior
    sigma2: float
    effects: list[Effect] = field(default_factory=list)
    elbo: list[float] = field(default_factory=list)
    history: list[list[np.ndarray]] = field(default_factory=list)
    growing: bool = True
    backfitting: bool = True
    iterations: int = 0
    converged: bool = False

    @property
    def d(self) -> np.ndarray:
        return np.diag(self.xtx)

    @property
    def correlation(self) -> np.ndarray:
        s = np.sqrt(self.d)
        return self.xtx / np.outer(s, s)

    def fitted(self) -> np.ndarray:
        return sum((e.first for e in self.effects), np.zeros(self.xty.shape))

    def residual(self, i: int) -> np.ndarray:
        """X'(Y - what all effects but i fit). A single effect is fitted to the data."""
        return self.xty - self.xtx @ (self.fitted() - self.effects[i].first)

    def new_effect(self) -> Effect:
        p, j = self.xty.shape
        return Effect(np.full(p, 1 / p), np.zeros((p, j)), np.ones((p, j)), np.full(p, np.nan), self.prior)

    def squared_error(self) -> float:
        """Expected ||Y - X B||**2."""
        f = self.fitted()
        out = self.yty - 2 * float((f * self.xty).sum()) + float((f * (self.xtx @ f)).sum())
        for e in self.effects:
            g = e.first
            out += float((self.d[:, None] * e.second).sum()) - float((g * (self.xtx @ g)).sum())
        return out

    def cells(self) -> int:
        return self.n * self.xty.shape[1]

    def divergence(self, i: int) -> float:
        """Kullback-Leibler divergence of effect i from its prior."""
        e = self.effects[i]
        cross = float((e.first * self.residual(i)).sum()) / self.sigma2
        return cross - float((self.d[:, None] * e.second).sum()) / (2 * self.sigma2) - log_mean_exp(e.lbf)

    def log_likelihood(self) -> float:
        return -self.cells() / 2 * (LOG_2PI + math.log(self.sigma2)) - self.squared_error() / (2 * self.sigma2)

    def _rest(self, i: int) -> float:
        """||Y - X (B without effect i)||**2."""
        g = self.fitted() - self.effects[i].first
        return self.yty - 2 * float((g * self.xty).sum()) + float((g * (self.xtx @ g)).sum())

    def marginal_log_likelihood(self, i: int) -> float:
        """Of the residuals that effect i sees, the effect integrated out."""
        return log_mean_exp(self.effects[i].lbf) - self.cells() / 2 * (LOG_2PI + math.log(self.sigma2)) - self._rest(i) / (2 * self.sigma2)

    def expected_log_likelihood(self, i: int) -> float:
        """Of the same residuals, under effect i's posterior."""
        e = self.effects[i]
        error = self._rest(i) - 2 * float((e.first * self.residual(i)).sum()) + float((self.d[:, None] * e.second).sum())
        return -self.cells() / 2 * (LOG_2PI + math.log(self.sigma2)) - error / (2 * self.sigma2)

    def false_sign_rate(self, i: int) -> np.ndarray:
        """Local false sign rate of each coefficient of effect i, averaged over covariates by their probability."""
        bhat = self.residual(i) / self.d[:, None]
        shat = np.broadcast_to(np.sqrt(self.sigma2 / self.d)[:, None], bhat.shape)
        return self.effects[i].alpha @ mx.local_false_sign_rate(self.effects[i].prior, bhat, shat)

    def objective(self) -> float:
        return self.log_likelihood() - sum(self.divergence(i) for i in range(len(self.effects)))

    def update_effect(self, i: int) -> None:
        s, e = self.settings, self.effects[i]
        bhat = self.residual(i) / self.d[:, None]
        shat = np.broadcast_to(np.sqrt(self.sigma2 / self.d)[:, None], bhat.shape).copy()
        bhat, shat[:, self.masked] = np.where(self.masked[None], 0.0, bhat), 1.0
        prior, lbf = mx.expectation_maximisation(e.prior, bhat, shat, passes=s.em_passes, max_rows=s.max_em_rows, null_weight=s.null_weight, tol_null=s.tol_null_prior, masked=self.masked, df=self.n - 1 if s.small_sample else None)
        alpha = mx.softmax(lbf)
        rows = alpha > min(s.negligible, 0.5 / len(alpha))
        mean, sd = mx.posterior(prior, bhat, shat, self.masked, rows)
        self.effects[i] = Effect(alpha, mean, sd**2, lbf, prior, credible_set(alpha, s.coverage))

    def purity(self, members: np.ndarray) -> float:
        return float(np.abs(self.correlation[np.ix_(members, members)]).min()) if len(members) > 1 else 1.0

    def is_dummy(self, e: Effect, min_lbf: float | None = None) -> bool:
        if not len(e.members) or e.prior.null > 1 - self.settings.tol_null_prior:
            return True
        weak = True if min_lbf is None else e.max_lbf < min_lbf
        return len(e.members) > 1 and self.purity(e.members) < self.settings.min_purity and weak

    def discard(self, drop: list[int]) -> None:
        """At least one effect stays: the first, if all are to go."""
        drop = [i for i in drop if i] if len(drop) == len(self.effects) else drop
        self.effects = [e for i, e in enumerate(self.effects) if i not in set(drop)]

    def expand(self, extra: int = 7) -> int:
        room = min(self.settings.effects, len(self.xty)) - len(self.effects)
        p, j = self.xty.shape
        for _ in range(max(0, min(extra, room))):
            e = self.new_effect()
            self.effects.append(Effect(np.zeros(p), np.zeros((p, j)), np.ones((p, j)), e.lbf, self.prior))
        return max(0, min(extra, room))

    def grow_or_prune(self) -> bool:
        """Drop dummy effects, or add more while all are real; whether the number changed."""
        drop = [i for i, e in enumerate(self.effects) if self.is_dummy(e, self.settings.min_lbf)]
        if drop and self.backfitting:
            self.growing = False
            before = len(self.effects)
            self.backfitting = len(drop) < before  # with dummies only there is nothing to fit back
            self.discard(drop)
            return len(self.effects) != before
        if not drop and not self.growing:
            self.backfitting = False
        if self.growing and not drop:
            if self.expand():
                return True
            self.growing = False
        return False

    def run(self) -> State:
        s = self.settings
        self.growing, self.backfitting = s.greedy, s.backfit
        limit = min(s.effects, len(self.xty))
        self.effects = [self.new_effect() for _ in range(min(s.start_effects if s.greedy else limit, limit))]
        for self.iterations in range(1, s.max_iterations + 1):
            for i in range(len(self.effects)):
                self.update_effect(i)
            self.history.append([e.alpha for e in self.effects])
            changed = limit > 1 and self.grow_or_prune()
            self.sigma2 = max(self.squared_error() / self.cells(), SIGMA2_FLOOR)
            self.elbo.append(self.objective() if not changed else -math.inf)
            if limit == 1:
                self.converged = True
                break
            if not changed and len(self.history) > 1 and len(self.history[-2]) == len(self.effects):
                if max(np.abs(a - b).max() for a, b in zip(self.history[-1], self.history[-2], strict=True)) < s.tolerance:
                    self.converged = True
                    break
        return self

    def finish(self, filter_sets: bool = True) -> State:
        """Drop impure effects, then of nested sets the larger (the smaller set wins, then the larger factor, then the first)."""
        if filter_sets:
            self.discard([i for i, e in enumerate(self.effects) if self.is_dummy(e)])
        drop: list[int] = []
        for i in range(len(self.effects)):
            for j in range(i + 1, len(self.effects)):
                if i in drop or j in drop or relation(self.effects[i].members, self.effects[j].members) == "none":
                    continue
                rank = lambda k: (len(self.effects[k].members), -self.effects[k].max_lbf, k)
                drop.append(max(i, j, key=rank))
        self.discard(drop)
        return self

    def pip(self) -> np.ndarray:
        return 1 - np.prod([1 - e.alpha for e in self.effects], axis=0)


@dataclass
class Fit:
    """Results over the original covariates: tables by ``table``, curves by ``curves``."""

    state: State
    kept: np.ndarray
    names: list[str]
    grid: np.ndarray
    curves: list[smoothing.Curve]
    x_mean: np.ndarray
    x_sd: np.ndarray
    y_mean: np.ndarray
    raw: Moments
    to_grid: np.ndarray

    def _spread(self, values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(len(self.names), fill)
        out[self.kept] = values
        return out

    def pip(self) -> np.ndarray:
        """Of every original covariate; constant ones have 0."""
        return self._spread(self.state.pip(), 0.0)

    def alpha(self) -> list[np.ndarray]:
        return [self._spread(e.alpha, 0.0) for e in self.state.effects]

    def lbf(self) -> list[np.ndarray]:
        return [self._spread(e.lbf, -math.inf) for e in self.state.effects]

    def sets(self) -> list[np.ndarray]:
        return [self.kept[e.members] for e in self.state.effects]

    def false_sign_rates(self) -> list[float]:
        """The least rate over coefficients, for each effect."""
        return [float(self.state.false_sign_rate(i).min()) for i in range(len(self.state.effects))]

    def summary(self) -> list[dict]:
        return [{"effect": i + 1, "size": len(e.members), "purity": self.state.purity(e.members), "max_lbf": e.max_lbf, "lead": self.names[self.kept[e.lead]]} for i, e in enumerate(self.state.effects)]

    def refit(self, smoother: str) -> Fit:
        """The same effects with curves by another smoother."""
        curves, grid = _curves(smoother, self.state, self.raw, self.kept, self.grid, self.to_grid, self.x_sd)
        return Fit(self.state, self.kept, self.names, grid, curves, self.x_mean, self.x_sd, self.y_mean, self.raw, self.to_grid)

    # tables

    def variables_table(self, spark: SparkSession) -> DataFrame:
        kept = np.zeros(len(self.names), bool)
        kept[self.kept] = True
        return spark.createDataFrame(pa.table({"j": np.arange(len(self.names)), "name": self.names, "kept": kept, "pip": self.pip()}))

    def effects_table(self, spark: SparkSession) -> DataFrame:
        n, p = len(self.state.effects), len(self.names)
        return spark.createDataFrame(pa.table({"effect": np.repeat(np.arange(1, n + 1), p), "j": np.tile(np.arange(p), n), "alpha": np.concatenate(self.alpha()), "lbf": np.concatenate(self.lbf())}))

    def sets_table(self, spark: SparkSession) -> DataFrame:
        sets = self.sets()
        return spark.createDataFrame(pa.table({"effect": np.repeat(np.arange(1, len(sets) + 1), [len(s) for s in sets]), "place": np.concatenate([np.arange(1, len(s) + 1) for s in sets]), "j": np.concatenate(sets)}))

    def curves_table(self, spark: SparkSession, level: float = 0.05) -> DataFrame:
        """(effect, t, pos, f, low, up, lfsr); bands are null where the smoother has a false sign rate instead."""
        rows = []
        for i, c in enumerate(self.curves):
            low, up = c.band(level) if c.variance is not None else (None, None)
            for t in range(len(self.grid)):
                rows.append((i + 1, t + 1, float(self.grid[t]), float(c.effect[t]), None if low is None else float(low[t]), None if up is None else float(up[t]), None if c.lfsr is None else float(c.lfsr[t])))
        return spark.createDataFrame(rows, "effect int, t int, pos double, f double, low double, up double, lfsr double")

    def fitted_rows(self, rows: DataFrame, key: str, x: str = "x") -> DataFrame:
        """(key, t, fit): each individual's fitted curve, mean plus leads times effects, as array expressions without a join."""
        leads = [int(self.kept[e.lead]) for e in self.state.effects]
        base = self.to_grid @ self.y_mean if len(self.grid) != len(self.y_mean) else self.y_mean
        terms = [F.array(*(F.lit(float(v)) for v in base))]

        def of_lead(j: int, effect: np.ndarray):
            off = F.col(x)[j] - float(self.x_mean[j])
            return F.transform(F.array(*(F.lit(float(v)) for v in effect)), lambda f: f * off)

        terms += [of_lead(j, c.effect) for j, c in zip(leads, self.curves, strict=True)]
        total = terms[0]
        for t in terms[1:]:
            total = F.zip_with(total, t, lambda a, b: a + b)
        return rows.select(key, F.posexplode(total).alias("t", "fit")).withColumn("t", F.col("t") + 1)


def _curves(smoother: str, state: State, raw: Moments, kept: np.ndarray, grid: np.ndarray, to_grid: np.ndarray, x_sd: np.ndarray) -> tuple[list[smoothing.Curve], np.ndarray]:
    """Curves in units of the response per unit of the covariate."""
    xtx = raw.xtx[np.ix_(kept, kept)]
    leads = [e.lead for e in state.effects]
    xty, yty = raw.xty[kept] @ to_grid.T, to_grid @ raw.yty @ to_grid.T
    if smoother == "none":
        size = xty.shape[1]
        w = wv.transform_matrix(size, state.settings.filter_moments, state.settings.family)
        scale = np.sqrt(np.maximum(np.diag(w @ yty @ w.T), 0) / (raw.n - 1))
        out = []
        for e in state.effects:
            unit = e.alpha / x_sd[kept]
            spread = np.square(w.T) @ (np.square(scale) * ((e.alpha / x_sd[kept] ** 2) @ e.var))
            out.append(smoothing.Curve(w.T @ (scale * (unit @ e.mean)), spread))
        return out, grid
    return smoothing.backfitted(smoother, xtx, xty, yty, raw.n, leads), grid


def coefficients(m: Moments, pos: np.ndarray | None = None, settings: Settings | None = None) -> np.ndarray:
    """The matrix that takes a centred response to its standardised wavelet coefficients; 0 for those that don't vary."""
    s, t = settings or Settings(), m.cross.shape[0] - m.p
    pos = np.arange(1, t + 1, dtype=float) if pos is None else np.asarray(pos, float)
    grid, to_grid = wv.interpolation(pos, s.max_scale) if wv.needs_remap(pos, s.max_scale) else (pos, np.eye(t))
    y_sd = np.sqrt(np.maximum(np.diag(to_grid @ m.yty @ to_grid.T), 0) / (m.n - 1))
    a = wv.transform_matrix(len(grid), s.filter_moments, s.family) @ (to_grid / np.where(y_sd > 0, y_sd, 1.0)[:, None])
    c_sd = np.sqrt(np.maximum(np.diag(a @ m.yty @ a.T), 0) / (m.n - 1))
    return np.where(c_sd > 1e-12, 1 / np.where(c_sd > 1e-12, c_sd, 1.0), 0.0)[:, None] * a


def fit_moments(m: Moments, pos: np.ndarray | None = None, names: list[str] | None = None, settings: Settings | None = None, masked: np.ndarray | None = None) -> Fit:
    """The whole fit from the moments of (x, y)."""
    s = settings or Settings()
    p, t = m.p, m.cross.shape[0] - m.p
    pos = np.arange(1, t + 1, dtype=float) if pos is None else np.asarray(pos, float)
    if len(pos) != t:
        raise ValueError("as many positions as points are needed")
    names = names or [f"x{j}" for j in range(p)]
    var = np.diag(m.xtx) / (m.n - 1)
    kept = np.flatnonzero(var > 1e-12 * np.maximum(1.0, m.mean[:p] ** 2))
    if not len(kept):
        raise ValueError("All columns of X are constant")
    x_sd = np.where(var > 0, np.sqrt(np.maximum(var, 0)), 1.0)
    grid, to_grid = wv.interpolation(pos, s.max_scale) if wv.needs_remap(pos, s.max_scale) else (pos, np.eye(t))

    w = wv.transform_matrix(len(grid), s.filter_moments, s.family)
    y_sd = np.sqrt(np.maximum(np.diag(to_grid @ m.yty @ to_grid.T), 0) / (m.n - 1))
    a = w @ (to_grid / np.where(y_sd > 0, y_sd, 1.0)[:, None])
    wyyw = a @ m.yty @ a.T
    c_sd = np.sqrt(np.maximum(np.diag(wyyw), 0) / (m.n - 1))
    off = c_sd <= 1e-12 if masked is None else masked | (c_sd <= 1e-12)
    if off.sum() > len(off) - 3:
        raise ValueError("hardly any coefficient varies")
    c_unit = np.where(c_sd > 0, c_sd, 1.0)
    xtx = m.xtx[np.ix_(kept, kept)] / np.outer(x_sd[kept], x_sd[kept])
    xty = m.xty[kept] @ a.T / x_sd[kept][:, None] / c_unit
    yty = float((np.diag(wyyw) / c_unit**2).sum())

    d = np.diag(xtx)
    bhat = np.where(off[None], 0.0, xty / d[:, None])
    sd = mx.sd_grid(np.append(np.ravel(bhat), np.abs(bhat).max()), np.append(np.broadcast_to(1 / np.sqrt(d)[:, None], bhat.shape).ravel(), 0.01), s.grid_ratio)
    prior = mx.start_prior(sd, wv.scale_blocks(len(grid)), s.prior == "per_scale")
    sigma2 = max(yty / (m.n - 1) / len(grid), SIGMA2_FLOOR)
    state = State(xtx, xty, yty, m.n, off, s, prior, sigma2).run().finish()
    curves, out_grid = _curves(s.smoother, state, m, kept, grid if s.smoother in ("ti", "none") else pos, to_grid if s.smoother in ("ti", "none") else np.eye(t), x_sd)
    return Fit(state, kept, names, out_grid, curves, m.mean[:p], x_sd, m.mean[p:], m, to_grid)


class FunctionalFineMapper:
    """Which covariates act on a curve, how sure that is, and what their effects look like.

    rows: a DataFrame with arrays x (covariates) and y (points), one row for each individual.
    """

    def __init__(self, **settings):
        self.settings = Settings(**settings)

    def fit(self, rows: DataFrame, *, x: str = "x", y: str = "y", pos: np.ndarray | None = None, names: list[str] | None = None) -> Fit:
        m, masked = moments(rows, x=x, y=y), None
        if self.settings.low_count is not None and m.n > 1:
            masked = low_medians(rows, coefficients(m, pos, self.settings), m.mean[m.p :], self.settings.low_count + ROUNDING, x=x, y=y)
        return fit_moments(m, pos, names, self.settings, masked)

    def fit_by_region(self, rows: DataFrame, region: str, *, x: str = "x", y: str = "y") -> DataFrame:
        """(region, effect, j, alpha, lbf, pip, in_set) for each of many small regions, each fitted in one task."""
        settings = self.settings

        def run(key, part):
            z = np.concatenate([np.stack(part.column(c).to_pylist()).astype(float) for c in (x, y)], axis=1)
            p = len(part.column(x)[0])
            out = {c: [] for c in ("region", "effect", "j", "alpha", "lbf", "pip", "in_set")}
            try:
                m, masked = Moments(*partial(z), p), None
                if settings.low_count is not None and m.n > 1:
                    masked = Medians.of(np.abs((z[:, p:] - m.mean[p:]) @ coefficients(m, settings=settings).T), settings.low_count + ROUNDING).at_most()
                fit = fit_moments(m, settings=settings, masked=masked)
            except ValueError:  # nothing varies in this region
                fit = None
            if fit is not None:
                pip = fit.pip()
                for i, (alpha, lbf, members) in enumerate(zip(fit.alpha(), fit.lbf(), fit.sets(), strict=True)):
                    for j in range(p):
                        for c, v in zip(out, (key[0].as_py(), i + 1, j, float(alpha[j]), float(lbf[j]), float(pip[j]), j in set(members.tolist())), strict=True):
                            out[c].append(v)
            kinds = (part.schema.field(region).type, pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

        kind = rows.schema[region].dataType.simpleString()
        whole = rows.select(region, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
        return whole.groupBy(region).applyInArrow(run, f"region {kind}, effect int, j int, alpha double, lbf double, pip double, in_set boolean")
