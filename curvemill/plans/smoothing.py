"""Effect curves from second moments: translation-invariant wavelets, HMM, adaptive smoothing, or none.

``xx`` and ``xy`` are a lead covariate's centred sums (numbers and one row of
length T), ``yy`` the T x T matrix of the responses; any linear transform of curves is
a product with these, so no row is read again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import hmm
from ..functions.mixture import shrink
from ..functions.special import normal_quantile
from ..functions.wavelets import average_basis_inverse, average_basis_variance, is_power_of_two, stationary_haar


@dataclass
class Curve:
    effect: np.ndarray
    variance: np.ndarray | None = None
    lfsr: np.ndarray | None = None
    log_evidence: float | None = None

    def band(self, level: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
        if self.variance is None:
            raise ValueError("this method has no variance; use lfsr")
        half = float(normal_quantile(np.array([1 - level / 2]))[0]) * np.sqrt(self.variance)
        return self.effect - half, self.effect + half


def slopes(xx: float, xy: np.ndarray, yy_diag: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginal slope and standard error (divisor n - 1) of each response on one covariate."""
    b = xy / xx
    return b, np.sqrt(np.maximum(yy_diag - b * xy, 0) / (n - 1) / xx)


def translation_invariant(xx: float, xy: np.ndarray, yy: np.ndarray, n: int, *, null_weight: float = 30.0, null_weight_smooth: float = 3.0, by_level: bool = True) -> Curve:
    """Undecimated Haar coefficients of the slopes, each level shrunk on its own (or all at once), averaged over all shifts on the way back."""
    size = len(xy)
    if not is_power_of_two(size):
        raise ValueError("the translation-invariant smoother needs 2**k points; interpolate first")
    details, smooth = stationary_haar(size)
    back, back_smooth = average_basis_inverse(size)
    found = [slopes(xx, d @ xy, np.einsum("ij,jk,ik->i", d, yy, d), n) for d in details]
    b, se = (np.array([f[i] for f in found]) for i in (0, 1))
    if by_level:
        shrunk = [shrink(x, np.maximum(s, 1e-12), null_weight)[:2] for x, s in zip(b, se, strict=True)]
        mean, d_var = (np.array([v[i] for v in shrunk]) for i in (0, 1))
    else:
        mean, d_var = (v.reshape(b.shape) for v in shrink(b.ravel(), np.maximum(se, 1e-12).ravel(), null_weight)[:2])
    effect = np.einsum("lij,lj->i", back, mean)
    b, se = slopes(xx, smooth @ xy, np.einsum("ij,jk,ik->i", smooth, yy, smooth), n)
    mean, var, _ = shrink(b, np.maximum(se, 1e-12), null_weight_smooth)
    return Curve(effect + back_smooth @ mean, average_basis_variance(d_var, var))


def adaptive(xx: float, xy: np.ndarray, yy: np.ndarray, n: int) -> Curve:
    """Slopes as one noisy curve with a standard error for each point: undecimated Haar with propagated variances and shrinkage by level, any length.

    Equivalent in purpose to smoothing by adaptive shrinkage.
    """
    b, se = slopes(xx, xy, np.diag(yy), n)
    mean, var = smooth_signal(b, np.maximum(se, 1e-12))
    return Curve(mean, var)


def smooth_signal(y: np.ndarray, se: np.ndarray, null_weight: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, variance) of a signal under independent normal noise; a length that isn't 2**k is mirrored and cut."""
    t = len(y)
    size = max(4, 1 << (t - 1).bit_length())
    if size != t:
        index = np.concatenate([np.arange(t), np.arange(t)[::-1]] * (size // (2 * t) + 2))[:size]
        mean, var = smooth_signal(y[index], se[index], null_weight)
        return mean[:t], var[:t]
    details, smooth = stationary_haar(size)
    back, back_smooth = average_basis_inverse(size)
    mean, d_var = np.zeros(size), []
    for level, d in enumerate(details):
        m, v, _ = shrink(d @ y, np.sqrt(np.square(d) @ np.square(se)), null_weight)
        mean += back[level] @ m
        d_var.append(v)
    m = smooth @ y
    return mean + back_smooth @ m, average_basis_variance(np.array(d_var), np.square(smooth) @ np.square(se))


def hmm_curve(b: np.ndarray, se: np.ndarray, options: hmm.Options | None = None) -> Curve:
    fit = hmm.fit(b, np.maximum(se, 1e-12), options=options or hmm.Options(maxiter=100))
    return Curve(fit.posterior["mean"], None, fit.posterior["lfsr"], fit.log_evidence_ratio)


def univariate(method: str, xx: float, xy: np.ndarray, yy: np.ndarray, n: int) -> Curve:
    """One covariate's curve by "ti", "ti_pooled" (one mixture for all levels), "smash" or "hmm"."""
    if method == "ti_pooled":
        return translation_invariant(xx, xy, yy, n, null_weight=3.0, by_level=False)
    if method == "ti":
        return translation_invariant(xx, xy, yy, n)
    if method == "smash":
        return adaptive(xx, xy, yy, n)
    if method == "hmm":
        return hmm_curve(*slopes(xx, xy, np.diag(yy), n))
    raise ValueError("method must be ti, smash or hmm")


def backfitted(method: str, xtx: np.ndarray, xty: np.ndarray, yty: np.ndarray, n: int, leads: list[int], rounds: int = 5) -> list[Curve]:
    """Curves of several lead covariates: each is fitted to what the others leave, in rounds. A lead that occurs twice gets one curve and zeros."""
    t = xty.shape[1]
    if method == "hmm":
        own = list(dict.fromkeys(leads))
        gram = xtx[np.ix_(own, own)]
        inverse = np.linalg.pinv(gram)
        b = inverse @ xty[own]
        rest = np.maximum(np.diag(yty) - np.einsum("jt,jt->t", b, xty[own]), 0) / max(1, n - 1 - len(own))
        curves = {j: hmm_curve(b[i], np.sqrt(rest * inverse[i, i])) for i, j in enumerate(own)}
        return [curves[j] if leads.index(j) == i else Curve(np.zeros(t), None, np.ones(t)) for i, j in enumerate(leads)]
    found = [Curve(np.zeros(t), np.zeros(t)) for _ in leads]
    for _ in range(1 if len(leads) == 1 else rounds):
        for i, j in enumerate(leads):
            if leads.index(j) != i:
                continue
            others = [k for k in range(len(leads)) if k != i]
            f = np.stack([found[k].effect for k in others]) if others else np.zeros((0, t))
            x_others = [leads[k] for k in others]
            xy = xty[j] - xtx[j, x_others] @ f
            cross = xty[x_others].T @ f
            yy = yty - cross - cross.T + f.T @ xtx[np.ix_(x_others, x_others)] @ f
            found[i] = univariate(method, float(xtx[j, j]), xy, yy, n)
    return found
