"""Normal and Student-t functions on numpy arrays (there is no scipy here)."""

from __future__ import annotations

import math

import numpy as np

LOG_2PI = math.log(2 * math.pi)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([0.5 * math.erfc(-v) for v in (x / math.sqrt(2)).ravel().tolist()]).reshape(x.shape)


def log_normal_pdf(x, sd) -> np.ndarray:
    return -0.5 * LOG_2PI - np.log(sd) - 0.5 * (x / sd) ** 2


def log_normal_cdf(x: np.ndarray) -> np.ndarray:
    """Stable in the lower tail: an asymptotic series takes over below -10."""
    x = np.asarray(x, float)
    far = x < -10
    near = np.where(far, 0.0, x)
    y = np.where(far, x, -11.0)
    z = 1 / (y * y)
    tail = -0.5 * LOG_2PI - 0.5 * y * y - np.log(-y) + np.log1p(z * (-1 + z * (3 + z * (-15 + z * 105))))
    return np.where(far, tail, np.log(np.maximum(normal_cdf(near), 1e-320)))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Newton steps on the log of the distribution from a logistic start; symmetric in p and 1 - p."""
    p = np.asarray(p, float)
    low = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore"):
        goal = np.log(low)
    safe = np.where(low > 0, goal, -700.0)
    x = np.where(safe > -3, 0.55 * (safe - np.log1p(-np.exp(np.minimum(safe, -1e-9)))), -np.sqrt(np.maximum(-2 * safe - np.log(np.maximum(1.0, -4 * math.pi * safe)), 0)))
    for _ in range(60):
        log_cdf = log_normal_cdf(x)
        step = (log_cdf - safe) / np.exp(-0.5 * LOG_2PI - 0.5 * x * x - log_cdf)
        x = x - np.clip(step, -1, 1)
        if np.abs(step).max(initial=0) < 1e-14:
            break
    x = np.where(low > 0, x, -np.inf)
    return np.where(p > 0.5, -x, x)


def log_t_pdf(x, df: float, sd) -> np.ndarray:
    """Of a Student-t variable with scale sd."""
    constant = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return constant - np.log(sd) - (df + 1) / 2 * np.log1p((x / sd) ** 2 / df)


def logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.reshape(()) if axis is None else np.squeeze(out, axis=axis)


def log_mean_exp(x: np.ndarray) -> float:
    return float(logsumexp(np.asarray(x, float)) - math.log(len(x)))


def log1p_exp(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def truncated_moments(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of Z given Z > -z, for a standard normal Z shifted by z: moments of max-free truncation at 0 of N(z, 1)."""
    ratio = np.exp(-0.5 * LOG_2PI - 0.5 * z * z - log_normal_cdf(z))
    mean = z + ratio
    variance = 1 - ratio * (ratio + z)
    far = z < -10
    y = np.where(far, -z, 10.0)
    mean = np.where(far, 1 / y - 2 / y**3 + 10 / y**5, mean)
    variance = np.where(far, 1 / y**2 - 6 / y**4, variance)
    return mean, np.maximum(variance, 0)


def two_sided_se(effect: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The standard error under which an effect has that two-sided normal p-value."""
    return np.abs(effect) / normal_quantile(1 - np.asarray(p, float) / 2)


def _log_beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.log(out)


def log_t_tail(t: float, df: float) -> float:
    """log P(T > |t|)."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + (b * math.log1p(-x) if x < 1 else 0.0)
    if x < (a + 1) / (a + b + 2):
        return math.log(0.5) + front - math.log(a) + _log_beta_cf(a, b, x)
    upper = math.exp(front - math.log(b) + _log_beta_cf(b, a, 1 - x)) if x < 1 else 0.0
    return math.log(0.5) + math.log1p(-min(upper, 1 - 1e-16))


def equivalent_normal_effect(effect: float, se: float, df: float) -> float:
    """The normal effect with the same tail probability as a t effect, for a stated se."""
    tail = log_t_tail(effect / se, df)
    low, high = 0.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(log_normal_cdf(np.array(-mid))) > tail else (low, mid)
    return math.copysign(se * (low + high) / 2, effect)
