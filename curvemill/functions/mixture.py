"""Normal scale mixtures centred at 0: grids, likelihoods, weights, posteriors.

Everything here works on numpy arrays of driver state or of one group; the
DataFrame forms of the same formulas are in operators/mixture_frames.py.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .special import log_normal_pdf, log_t_pdf, logsumexp, normal_cdf

#: The null component's first weight, and the floor of standard errors.
START_NULL, SE_FLOOR = 0.8, 1e-32


@dataclass(frozen=True)
class Mixture:
    """``sd[0]`` is 0: the point mass."""

    sd: np.ndarray
    weight: np.ndarray

    def reweighted(self, weight: np.ndarray) -> Mixture:
        weight = np.asarray(weight, float)
        if weight.shape != self.sd.shape:
            raise ValueError("as many weights as components are needed")
        return Mixture(self.sd, weight)

    @property
    def null(self) -> float:
        return float(self.weight[0])


@dataclass(frozen=True)
class Prior:
    """One mixture for all coefficients, or one for each scale."""

    parts: tuple[Mixture, ...]
    blocks: tuple[np.ndarray, ...]

    @property
    def per_scale(self) -> bool:
        return len(self.parts) > 1

    @property
    def null(self) -> float:
        return float(np.mean([p.null for p in self.parts]))

    def reweighted(self, weights: list[np.ndarray]) -> Prior:
        if len(weights) != len(self.parts):
            raise ValueError("as many weight vectors as mixtures are needed")
        return Prior(tuple(p.reweighted(w) for p, w in zip(self.parts, weights, strict=True)), self.blocks)

    def each(self):
        return zip(self.parts, self.blocks, strict=True)


def sd_grid(estimate: np.ndarray, se: np.ndarray, ratio: float = math.sqrt(2), lowest: float | None = None, highest: float | None = None) -> np.ndarray:
    """0 and a geometric grid from a tenth of the least standard error to twice the largest excess root mean square."""
    estimate, se = np.ravel(estimate).astype(float), np.ravel(se).astype(float)
    low = se.min() / 10 if lowest is None else lowest
    excess = float(np.max(estimate**2 - se**2, initial=0.0))
    high = (2 * math.sqrt(excess) if excess > 0 else 8 * low) if highest is None else highest
    n = max(1, math.ceil(math.log(max(high / low, 1.0)) / math.log(ratio)))
    return np.concatenate([[0.0], high * ratio ** np.arange(-n, 1.0)])


def start_prior(sd: np.ndarray, blocks: list[np.ndarray], per_scale: bool) -> Prior:
    """0.8 on the null, the rest shared evenly."""
    weight = np.full(len(sd), (1 - START_NULL) / (len(sd) - 1))
    weight[0] = START_NULL
    every = np.sort(np.concatenate(blocks))
    return Prior(tuple(Mixture(sd, weight) for _ in blocks), tuple(blocks)) if per_scale else Prior((Mixture(sd, weight),), (every,))


def component_logs(part: Mixture, estimate: np.ndarray, se: np.ndarray, df: float | None = None) -> np.ndarray:
    """log density of every estimate under every component (last axis)."""
    sd = np.sqrt(part.sd**2 + np.maximum(se, SE_FLOOR)[..., None] ** 2)
    x = estimate[..., None]
    return log_normal_pdf(x, sd) if df is None else log_t_pdf(x, df, sd)


def log_bayes_factor(prior: Prior, estimate: np.ndarray, se: np.ndarray, masked: np.ndarray | None = None, df: float | None = None) -> np.ndarray:
    """For each covariate (row): log likelihood ratio of the mixture to no effect, summed over unmasked coefficients.

    Infinite values become max(1e4, 100 * the largest finite), likewise below.
    """
    total = np.zeros(len(estimate))
    for part, block in prior.each():
        use = block if masked is None else block[~masked[block]]
        if not len(use):
            continue
        logs = component_logs(part, estimate[:, use], se[:, use], df)
        with np.errstate(divide="ignore"):
            total += (logsumexp(logs + np.log(part.weight), axis=-1) - logs[..., 0]).sum(1)
    finite = total[np.isfinite(total)]
    total = np.where(np.isposinf(total), max(1e4, 100 * finite.max(initial=0)), total)
    return np.where(np.isneginf(total), -max(1e4, 100 * finite.max(initial=0)), total)


def softmax(log_bf: np.ndarray) -> np.ndarray:
    """Inclusion probabilities of one effect; covariates whose factor is not a number get none."""
    x = np.where(np.isnan(log_bf), -np.inf, log_bf)
    w = np.exp(x - x.max())
    return w / w.sum()


def weights_step(scale: np.ndarray, row_weight: np.ndarray, w: np.ndarray, null_penalty: float = 0.0) -> tuple[np.ndarray, float]:
    """(weights after one expectation-maximisation step, value before it); scale: rows x components of likelihoods, each row up to a factor."""
    mixed = np.maximum(scale @ w, 1e-300)
    new = w * (scale.T @ (row_weight / mixed))
    value = float(row_weight @ np.log(mixed)) + (null_penalty * math.log(max(w[0], 1e-300)) if null_penalty else 0.0)
    new[0] += null_penalty
    return new / (row_weight.sum() + null_penalty), value


def fit_weights(logs: np.ndarray, row_weight: np.ndarray, start: np.ndarray, null_penalty: float = 0.0, steps: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Weights that maximise sum(row_weight * log(sum_k w_k exp(logs))) + null_penalty * log(w_0).

    The problem is concave: expectation-maximisation steps, extrapolated by squared
    steps while that helps (Varadhan and Roland 2008).
    """
    scale = np.exp(logs - logs.max(axis=1, keepdims=True))
    w = np.maximum(np.asarray(start, float), 1e-12)
    w /= w.sum()
    if row_weight.sum() + null_penalty <= 0:
        return w

    def step(w: np.ndarray) -> tuple[np.ndarray, float]:
        return weights_step(scale, row_weight, w, null_penalty)

    before = -np.inf
    for _ in range(steps):
        one, value = step(w)
        if value - before <= tol * max(1.0, abs(value)):
            break
        before = value
        two, at_one = step(one)
        r, v = one - w, (two - one) - (one - w)
        size = float(np.sqrt(v @ v))
        w = two
        if size > 1e-14:
            a = -max(1.0, float(np.sqrt(r @ r)) / size)
            far = np.maximum(one - r - 2 * a * r + a * a * v, 0)
            if far.sum() > 0:
                ahead, at_far = step(far / far.sum())
                if at_far >= at_one:
                    w = ahead
    return w


def fit_prior(prior: Prior, estimate: np.ndarray, se: np.ndarray, row_weight: np.ndarray, null_weight: float = 0.1, tol_null: float = 1e-3, penalised: bool = True, masked: np.ndarray | None = None, null_start: float = 1.0) -> Prior:
    """M-step: new weights of each part, given the weight of each covariate (row). Nearly null parts become null."""
    out = []
    for part, block in prior.each():
        use = block if masked is None else block[~masked[block]]
        if not len(use):
            out.append(np.eye(len(part.sd))[0])
            continue
        logs = component_logs(part, estimate[:, use], se[:, use]).reshape(-1, len(part.sd))
        start = np.full(len(part.sd), 1e-6)
        start[0] = null_start
        w = fit_weights(logs, np.repeat(row_weight, len(use)), np.maximum(start, part.weight), null_weight * len(use) if penalised else 0.0)
        out.append(np.eye(len(w))[0] if w[0] > 1 - tol_null else w)
    return prior.reweighted(out)


def expectation_maximisation(prior: Prior, estimate: np.ndarray, se: np.ndarray, *, passes: int = 2, max_rows: int | None = 100, null_weight: float = 0.1, tol_null: float = 1e-3, masked: np.ndarray | None = None, df: float | None = None, tol: float = 1e-4) -> tuple[Prior, np.ndarray]:
    """(prior, log Bayes factors): alternate inclusion probabilities and weights on the ``max_rows`` strongest covariates (None: on all)."""
    se = np.where(np.isfinite(se) & (se > 0), se, SE_FLOOR)
    log_bf = log_bayes_factor(prior, estimate, se, masked, df)
    if len(log_bf) == 1:
        return prior, log_bf
    top = np.sort(np.argsort(-log_bf, kind="stable")[:max_rows])
    before = -np.inf
    for _ in range(passes):
        z = softmax(log_bf)
        prior = fit_prior(prior, estimate[top], se[top], z[top] / max(z[top].sum(), 1e-300), null_weight, tol_null, masked=masked)
        log_bf = log_bayes_factor(prior, estimate, se, masked, df)
        level = float(logsumexp(log_bf))
        if abs(level - before) < tol:
            break
        before = level
    return prior, log_bf


def posterior(prior: Prior, estimate: np.ndarray, se: np.ndarray, masked: np.ndarray | None = None, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sd) of every effect. Masked coefficients and rows left out of ``rows`` are 0."""
    mean, second = np.zeros(estimate.shape), np.zeros(estimate.shape)
    for part, block in prior.each():
        logs = component_logs(part, estimate[:, block], se[:, block])
        with np.errstate(divide="ignore"):
            logs = logs + np.log(part.weight)
        w = np.exp(logs - logsumexp(logs, axis=-1)[..., None])
        s2 = np.maximum(se[:, block], SE_FLOOR)[..., None] ** 2
        shrink = part.sd**2 / (part.sd**2 + s2)
        m = shrink * estimate[:, block][..., None]
        mean[:, block] = (w * m).sum(-1)
        second[:, block] = (w * (m**2 + shrink * s2)).sum(-1)
    sd = np.sqrt(np.maximum(second - mean**2, 0))
    keep = np.ones(len(estimate), bool) if rows is None else rows
    mask = np.zeros(estimate.shape[1], bool) if masked is None else masked
    drop = ~keep[:, None] | mask[None]
    return np.where(drop, 0, mean), np.where(drop, 0, sd)


def local_false_sign_rate(prior: Prior, estimate: np.ndarray, se: np.ndarray) -> np.ndarray:
    """Posterior probability of the less likely sign, the point mass counting against both."""
    out = np.ones(estimate.shape)
    for part, block in prior.each():
        valid = np.isfinite(estimate[:, block]) & np.isfinite(se[:, block]) & (se[:, block] > 0)
        x, s = np.where(valid, estimate[:, block], 0.0), np.where(valid, se[:, block], 1.0)
        logs = component_logs(part, x, s)
        with np.errstate(divide="ignore"):
            logs = logs + np.log(part.weight)
        w = np.exp(logs - logsumexp(logs, axis=-1)[..., None])
        w = np.where(valid[..., None], w, part.weight)
        s2 = s[..., None] ** 2
        shrink = part.sd**2 / (part.sd**2 + s2)
        z = np.where(part.sd > 0, shrink * x[..., None] / np.sqrt(np.where(part.sd > 0, shrink * s2, 1)), 0.0)
        below = np.where(part.sd > 0, np.where(valid[..., None], normal_cdf(-z), 0.5), 0.0)
        negative, null = (w * below).sum(-1), w[..., 0]
        out[:, block] = np.minimum(negative, np.maximum(1 - negative - null, 0)) + null
    return np.clip(out, 0, 1)


def shrink(estimate: np.ndarray, se: np.ndarray, null_weight: float = 10.0, ratio: float = math.sqrt(2)) -> tuple[np.ndarray, np.ndarray, Mixture]:
    """(posterior mean, posterior variance, mixture): adaptive shrinkage of one vector, with a prior count on the null."""
    estimate, se = np.asarray(estimate, float), np.asarray(se, float)
    usable = np.isfinite(estimate) & np.isfinite(se) & (se > 0)
    if not usable.any():
        return np.zeros_like(estimate), np.zeros_like(estimate), Mixture(np.zeros(1), np.ones(1))
    x, s = estimate[usable], se[usable]
    sd = sd_grid(x, s, ratio)
    part = Mixture(sd, np.full(len(sd), 1 / len(sd)))
    part = part.reweighted(fit_weights(component_logs(part, x, s), np.ones(len(x)), part.weight, max(0.0, null_weight - 1)))
    mean, spread = posterior(Prior((part,), (np.arange(len(x)),)), x[None], s[None])
    out_mean, out_var = np.zeros_like(estimate), np.zeros_like(estimate)
    out_mean[usable], out_var[usable] = mean[0], spread[0] ** 2
    return out_mean, out_var, part


def shrink_level(estimate: np.ndarray, se: np.ndarray, block: np.ndarray, masked: np.ndarray | None = None, null_weight: float = 10.0) -> Mixture:
    """The mixture of all covariates' coefficients (rows) in one scale's block, masked ones left out; without any it is the null."""
    use = block if masked is None else block[~masked[block]]
    return shrink(estimate[:, use].ravel(), se[:, use].ravel(), null_weight)[2]
