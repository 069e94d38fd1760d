"""Hidden Markov smoothing of noisy effects along positions.

Model: y_t ~ N(beta_t, se_t**2); beta_t comes from the state's prior, a point
at the state's centre mixed with normals around it (optionally kept above 0); states form a Markov chain.
Sequences are independent given the parameters. Recursions run in time for all states at
once and, where sequences have one length, are the same code for each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .special import LOG_2PI, log_normal_cdf, logsumexp, normal_cdf, truncated_moments

VERSION = "1"


def version() -> str:
    return VERSION


def check_data(y: np.ndarray, se: np.ndarray, sequence: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, se = np.asarray(y, float), np.asarray(se, float)
    sequence = np.zeros(len(y), int) if sequence is None else np.asarray(sequence)
    if not len(y) == len(se) == len(sequence) or not len(y):
        raise ValueError("y, se and sequence must have one length, of 1 at least")
    if not (np.isfinite(y).all() and np.isfinite(se).all() and (se > 0).all()):
        raise ValueError("y and se must be finite and se above 0")
    return y, se, sequence


def segments(sequence: np.ndarray) -> list[slice]:
    """Stretches of equal neighbouring ids."""
    cuts = np.flatnonzero(sequence[1:] != sequence[:-1]) + 1
    edges = [0, *cuts.tolist(), len(sequence)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def sigma_grid(y, se, ratio: float = math.sqrt(2), lowest: float | None = None, highest: float | None = None) -> np.ndarray:
    from .mixture import sd_grid

    return sd_grid(y, se, ratio, lowest, highest)


def mean_grid(y: np.ndarray, half: int = 50, shape: float = 3.0, expansion: float = 3.0, largest: float | None = None, positive_only: bool = False) -> np.ndarray:
    """0, then centres whose distance grows by a power, mirrored unless positive_only. 0 comes first."""
    top = expansion * float(np.abs(y).max(initial=0)) if largest is None else largest
    up = top * (np.arange(1, half + 1) / half) ** shape
    return np.concatenate([[0.0], up] if positive_only else [[0.0], up, -up])


def screen_counts(y, se, mu: np.ndarray, sd: float = 0.0, block: int = 5000) -> np.ndarray:
    """Expected number of points of each centre, were points independent."""
    counts = np.zeros(len(mu))
    for at in range(0, len(y), block):
        var = se[at : at + block, None] ** 2 + sd**2
        logs = -0.5 * (y[at : at + block, None] - mu) ** 2 / var - 0.5 * np.log(var)
        counts += np.exp(logs - logsumexp(logs, axis=1)[:, None]).sum(0)
    return counts


def screen_means(y, se, mu: np.ndarray, min_count: float = 0.5, min_fraction: float = 1e-5, sd: float = 0.0, block: int = 5000) -> np.ndarray:
    """Centres whose expected number of points, were points independent, is large enough; the first always stays."""
    keep = screen_counts(y, se, mu, sd, block) >= max(min_count, len(y) * min_fraction)
    keep[0] = True
    return mu[keep]


def select_grid(y, se, mu: np.ndarray, min_count: float = 0.5, min_fraction: float = 1e-5, sd: float = 0.0) -> np.ndarray:
    """Centres of a grid that a fit starts from: those that points screen for, 0 first."""
    return screen_means(y, se, np.asarray(mu, float), min_count, min_fraction, sd)


def transition_mask(n: int, topology: str = "full") -> np.ndarray:
    """full: every move; hub: states move to themselves and to and from the first."""
    if topology == "full":
        return np.ones((n, n), bool)
    if topology != "hub":
        raise ValueError("topology must be full or hub")
    mask = np.eye(n, dtype=bool)
    mask[0, :] = mask[:, 0] = True
    return mask


def first_transition(mask: np.ndarray, stay: float | np.ndarray = 0.98) -> np.ndarray:
    """Each state stays with its probability (one for all, or one for each state); its other moves share the rest."""
    out, each = np.zeros(mask.shape), np.broadcast_to(np.asarray(stay, float), (len(mask),))
    if (each <= 0).any() or (each > 1).any():
        raise ValueError("stay probabilities must be above 0 and 1 at most")
    for i, row in enumerate(mask):
        stay = each[i]
        others = np.flatnonzero(row & (np.arange(len(row)) != i))
        out[i, others] = (1 - stay) / len(others) if len(others) else 0
        out[i, i] = stay if len(others) else 1.0
        if not row[i]:
            out[i, i] = 0
            out[i] /= out[i].sum()
    return out


def check_transition(a: np.ndarray, mask: np.ndarray, tol: float = 1e-10) -> None:
    if a.shape != mask.shape or (a < 0).any() or np.abs(a.sum(1) - 1).max() > tol or (a[~mask] > tol).any():
        raise ValueError("transition rows must be distributions over the mask's moves")


def stationary(a: np.ndarray, tol: float = 1e-13, steps: int = 100_000) -> np.ndarray:
    p = np.full(len(a), 1 / len(a))
    for _ in range(steps):
        new = p @ a
        if np.abs(new - p).max() < tol:
            return new / new.sum()
        p = new
    return p / p.sum()


def component_logs(y, se, mu, sd, support: str = "real") -> np.ndarray:
    """points x scales x states: log density of y. With support nonnegative the normal around a centre is kept above 0."""
    var = se[:, None, None] ** 2 + sd[None, :, None] ** 2
    d = y[:, None, None] - mu[None, None, :]
    out = -0.5 * (LOG_2PI + np.log(var) + d**2 / var)
    if support == "nonnegative":
        wide = sd > 0
        tau2 = sd[wide][None, :, None] ** 2
        s2 = se[:, None, None] ** 2
        post_var = s2 * tau2 / (s2 + tau2)
        post = post_var * (y[:, None, None] / s2 + mu[None, None, :] / tau2)
        out[:, wide] += log_normal_cdf(post / np.sqrt(post_var)) - log_normal_cdf(mu[None, None, :] / np.sqrt(tau2))
    return out


def mix_logs(cache: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """points x states: the cache (points x scales x states) mixed with weights rho (states x scales)."""
    with np.errstate(divide="ignore"):
        return logsumexp(cache + np.log(rho.T)[None], axis=1)


def refresh_cache(cache: np.ndarray, y, se, old_mu, new_mu, sd, support: str = "real", tol: float = 0.0) -> np.ndarray:
    """Only states whose centre moved are computed anew."""
    moved = np.abs(new_mu - old_mu) > tol
    if moved.any():
        cache = cache.copy()
        cache[:, :, moved] = component_logs(y, se, new_mu[moved], sd, support)
    return cache


@dataclass
class Smoothed:
    log_likelihood: float
    gamma: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    #: Probability that a point's state differs from the one before; nan where a sequence begins.
    boundary: np.ndarray


def forward_backward(logs: np.ndarray, a: np.ndarray, start: np.ndarray, sequence: np.ndarray, engine: str = "auto", mask: np.ndarray | None = None) -> Smoothed:
    """Exact smoothing. Scaled recursions where the chain is small or dense, in logs if those underflow or it is sparse."""
    density = (a > 0).mean() if mask is None else mask.mean()
    if engine == "auto":
        engine = "scaled" if len(a) <= 4 or density >= 0.25 else "log"
    if engine == "scaled":
        found = _scaled(logs, a, start, sequence)
        if found is not None:
            return found
    return _logged(logs, a, start, sequence)


def _scaled(logs, a, start, sequence) -> Smoothed | None:
    n, m = logs.shape
    gamma, counts, first, boundary, total = np.zeros((n, m)), np.zeros((m, m)), np.zeros(m), np.full(n, np.nan), 0.0
    for part in segments(sequence):
        own = logs[part]
        top = own.max(1)
        b = np.exp(own - top[:, None])
        t = len(b)
        alpha, beta, scale = np.empty((t, m)), np.ones((t, m)), np.empty(t)
        p = start
        for i in range(t):
            f = p * b[i]
            scale[i] = f.sum()
            if not scale[i] > 1e-280:
                return None
            alpha[i] = f / scale[i]
            p = alpha[i] @ a
        for i in range(t - 2, -1, -1):
            beta[i] = a @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
        g = alpha * beta
        g /= g.sum(1, keepdims=True)
        if t > 1:
            tail = b[1:] * beta[1:] / scale[1:, None]
            counts += a * (alpha[:-1].T @ tail)
            boundary[part.start + 1 : part.stop] = np.clip(1 - (alpha[:-1] * np.diag(a) * tail).sum(1), 0, 1)
        gamma[part], first, total = g, first + g[0], total + float(np.log(scale).sum() + top.sum())
    return Smoothed(total, gamma, counts, first, boundary)


def _logged(logs, a, start, sequence) -> Smoothed:
    n, m = logs.shape
    gamma, counts, first, boundary, total = np.zeros((n, m)), np.zeros((m, m)), np.zeros(m), np.full(n, np.nan), 0.0
    with np.errstate(divide="ignore"):
        log_a, log_start = np.log(a), np.log(start)
    for part in segments(sequence):
        b = logs[part]
        t = len(b)
        f, r = np.empty((t, m)), np.zeros((t, m))
        f[0] = log_start + b[0]
        for i in range(1, t):
            f[i] = logsumexp(f[i - 1][:, None] + log_a, axis=0) + b[i]
        for i in range(t - 2, -1, -1):
            r[i] = logsumexp(log_a + (b[i + 1] + r[i + 1])[None], axis=1)
        level = float(logsumexp(f[-1]))
        g = np.exp(f + r - level)
        g /= g.sum(1, keepdims=True)
        for i in range(1, t):
            pair = np.exp(f[i - 1][:, None] + log_a + (b[i] + r[i])[None] - level)
            counts += pair
            boundary[part.start + i] = min(1.0, max(0.0, 1 - np.trace(pair)))
        gamma[part], first, total = g, first + g[0], total + level
    return Smoothed(total, gamma, counts, first, boundary)


def log_likelihood(logs, a, start, sequence) -> float:
    total = 0.0
    for part in segments(sequence):
        p = start
        for row in logs[part]:
            top = row.max()
            f = p * np.exp(row - top)
            total += math.log(max(f.sum(), 1e-300)) + top
            p = (f / max(f.sum(), 1e-300)) @ a
    return total


def variational_states(logs, a, start, sequence, begin: np.ndarray | None = None, steps: int = 50, tol: float = 1e-6, floor: float = 1e-12) -> np.ndarray:
    """Independent state distributions for each point: points at odd, then at even places are updated, given their neighbours'."""
    log_a, log_start = np.log(np.maximum(a, floor)), np.log(np.maximum(start, floor))
    soft = lambda x: (lambda w: (lambda v: v / v.sum(1, keepdims=True))(np.maximum(w, floor)))(np.exp(x - logsumexp(x, axis=1)[:, None]))
    q = soft(logs) if begin is None else begin.copy()
    starts = np.zeros(len(logs), bool)
    for part in segments(sequence):
        starts[part.start] = True
    ends = np.append(starts[1:], True)
    place = np.arange(len(logs)) % 2
    for _ in range(steps):
        before = q.copy()
        for side in (1, 0):
            at = np.flatnonzero(place == side)
            score = logs[at].copy()
            head, tail = starts[at], ends[at]
            score[head] += log_start
            score[~head] += q[at[~head] - 1] @ log_a
            score[~tail] += q[at[~tail] + 1] @ log_a.T
            q[at] = soft(score)
        if np.abs(q - before).max() < tol:
            break
    return q


def variational_bound(logs, a, start, q, sequence) -> float:
    log_a, log_start = np.log(np.maximum(a, 1e-300)), np.log(np.maximum(start, 1e-300))
    total = float((q * logs).sum() - (q * np.log(np.maximum(q, 1e-300))).sum())
    for part in segments(sequence):
        own = q[part]
        total += float(own[0] @ log_start + np.einsum("ti,ij,tj->", own[:-1], log_a, own[1:]))
    return total


def best_path(logs, log_a, log_start, sequence) -> np.ndarray:
    """Path of the largest sum of logs, moves and starts; ties go to the first state."""
    path = np.zeros(len(logs), int)
    for part in segments(sequence):
        b = logs[part]
        back = np.zeros(b.shape, int)
        f = log_start + b[0]
        for i in range(1, len(b)):
            move = f[:, None] + log_a
            back[i] = move.argmax(0)
            f = move.max(0) + b[i]
        at = int(f.argmax())
        for i in range(len(b) - 1, -1, -1):
            path[part.start + i] = at
            at = back[i, at]
    return path


def viterbi(logs, a, start, sequence) -> np.ndarray:
    """Most probable path; ties go to the first state."""
    with np.errstate(divide="ignore"):
        return best_path(logs, np.log(a), np.log(start), sequence)


def penalised_path(logs, mask, sequence, penalty: float) -> np.ndarray:
    """Path of the largest emissions less a penalty for each change of state that the mask allows."""
    if not (penalty >= 0 and math.isfinite(penalty)):
        raise ValueError("a step's penalty must be finite and not negative")
    move = np.where(np.eye(len(mask), dtype=bool), 0.0, np.where(mask, -penalty, -np.inf))
    return best_path(logs, move, np.zeros(len(mask)), sequence)


def path_segments(path: np.ndarray, sequence: np.ndarray, mu: np.ndarray | None = None) -> list[dict]:
    """Runs of one state: sequence, start and end (from 1, over all rows), length, state, state_mean."""
    out = []
    for part in segments(sequence):
        for run in segments(path[part]):
            s = int(path[part][run.start])
            out.append({"sequence": sequence[part.start], "start": part.start + run.start + 1, "end": part.start + run.stop, "length": run.stop - run.start, "state": s + 1, "state_mean": None if mu is None else float(mu[s])})
    return out


def step_summary(path: np.ndarray, sequence: np.ndarray, mu: np.ndarray | None = None) -> dict:
    """segments, per_sequence (steps and changes of each stretch of one id), and how many steps, changes and states there are in all."""
    runs = path_segments(path, sequence, mu)
    per = [{"sequence": sequence[part.start], "steps": (n := len(segments(path[part]))), "changes": n - 1} for part in segments(sequence)]
    steps = sum(p["steps"] for p in per)
    return {"segments": runs, "per_sequence": per, "step_count": steps, "change_count": steps - len(per), "occupied_state_count": len(np.unique(path))}


def expanded_prior(x, rows: int, columns: int) -> np.ndarray:
    """Counts of a Dirichlet prior for each entry, from a scalar, one for each column, or a matrix; 1 says nothing."""
    x = np.asarray(x, float)
    if x.ndim and x.shape not in ((columns,), (rows, columns)):
        raise ValueError(f"a prior must be a scalar, {columns} numbers or {rows} by {columns}")
    if not np.isfinite(x).all() or (x < 1).any():
        raise ValueError("prior entries must be finite and 1 at least")
    return np.broadcast_to(x, (rows, columns)).copy()


def dirichlet_penalty(probability: np.ndarray, alpha: np.ndarray, active: np.ndarray | None = None) -> float:
    """Log density of probabilities under the prior counts, up to a constant, over the active entries."""
    use = (alpha > 1) & (np.ones(alpha.shape, bool) if active is None else active)
    if (probability[use] <= 0).any():
        return -math.inf
    return float(((alpha[use] - 1) * np.log(probability[use])).sum())


def voronoi_bounds(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-way points to the neighbouring centres."""
    order = np.argsort(anchor, kind="stable")
    mid = (anchor[order][1:] + anchor[order][:-1]) / 2
    low, high = np.empty(len(anchor)), np.empty(len(anchor))
    low[order], high[order] = np.append(-np.inf, mid), np.append(mid, np.inf)
    return low, high


def close_states(mu: np.ndarray, occupancy: np.ndarray, distance: float, fixed: tuple[int, ...] = (0,)) -> list[int]:
    """Of neighbouring centres no further apart than the distance, the less occupied one that isn't fixed; the lower of two alike."""
    out, order = [], np.argsort(mu, kind="stable").tolist()
    if not (math.isfinite(distance) and distance > 0):
        return out
    for i, j in zip(order, order[1:], strict=False):
        free = [k for k in (i, j) if k not in fixed]
        if mu[j] - mu[i] <= distance and free:
            loser = min(free, key=lambda k: occupancy[k])
            if loser not in out:
                out.append(loser)
    return out


def component_statistics(y, se, mu, sd, rho, cache, logs, gamma, support: str = "real") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected counts states x scales, sums of precision, of precision * y by state): what weights and means need."""
    with np.errstate(divide="ignore"):
        resp = np.exp(cache + np.log(rho.T)[None] - logs[:, None, :]) * gamma[:, None, :]
    precision = 1 / (se[:, None] ** 2 + sd[None, :] ** 2)
    return resp.sum(0).T, np.einsum("tlm,tl->m", resp, precision), np.einsum("tlm,tl->m", resp, precision * y[:, None])


def update_means(mu, anchor, sums, counts, learn: np.ndarray, min_count: float = 2.0, damping: float = 1.0, minimum: float | None = None, bounded: bool = True) -> np.ndarray:
    """Weighted means of the states that may learn, kept in their Voronoi cells and above the minimum."""
    precision, weighted = sums
    new = np.where(precision > 0, weighted / np.maximum(precision, 1e-300), mu)
    if bounded:
        low, high = voronoi_bounds(anchor)
        new = np.clip(new, low, high)
    if minimum is not None:
        new = np.maximum(new, minimum)
    use = learn & (counts.sum(1) >= min_count)
    return np.where(use, mu + damping * (new - mu), mu)


def update_truncated_means(y, se, mu, anchor, sd, rho, gamma, learn, counts, min_count: float = 2.0, minimum: float = 0.0, steps: int = 40) -> np.ndarray:
    """With effects kept above 0 the mean has no closed form: golden-section search of each state's expected log density in its cell."""
    low, high = voronoi_bounds(anchor)
    top = float(np.abs(y).max(initial=1)) * 3
    out, g = mu.copy(), (math.sqrt(5) - 1) / 2
    for j in np.flatnonzero(learn & (counts.sum(1) >= min_count)):
        def value(m: float, j: int = j) -> float:
            return float(gamma[:, j] @ mix_logs(component_logs(y, se, np.array([m]), sd, "nonnegative"), rho[j : j + 1])[:, 0])

        a, b = max(minimum, low[j]), min(top, high[j])
        if not a < b:
            continue
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = value(c), value(d)
        for _ in range(steps):
            if fc >= fd:
                b, d, fd = d, c, fc
                c = b - g * (b - a)
                fc = value(c)
            else:
                a, c, fc = c, d, fd
                d = a + g * (b - a)
                fd = value(d)
        best = (a + b) / 2
        if value(best) > value(mu[j]):
            out[j] = best
    return out


def posterior_summary(y, se, mu, sd, rho, logs, gamma, cache, support: str = "real") -> dict[str, np.ndarray]:
    """mean, sd, probability_ge_zero, probability_le_zero, probability_zero, lfsr of each point."""
    with np.errstate(divide="ignore"):
        w = np.exp(cache + np.log(rho.T)[None] - logs[:, None, :]) * gamma[:, None, :]
    s2, tau2 = se[:, None, None] ** 2, sd[None, :, None] ** 2
    var = s2 * tau2 / (s2 + tau2)
    centre = np.where(tau2 > 0, (y[:, None, None] * tau2 + mu[None, None, :] * s2) / (s2 + tau2), mu[None, None, :])
    spread = np.sqrt(np.where(var > 0, var, 1))
    z = centre / spread
    mean, second = centre, centre**2 + var
    above = np.where(var > 0, normal_cdf(z), (centre > 0).astype(float))
    below = np.where(var > 0, 1 - above, (centre < 0).astype(float))
    zero = np.where((var == 0) & (centre == 0), 1.0, 0.0)
    if support == "nonnegative":
        m, v = truncated_moments(z)
        wide = np.broadcast_to(var > 0, z.shape)
        mean = np.where(wide, m * spread, mean)
        second = np.where(wide, (v + m**2) * var, second)
        above, below = np.where(wide, 1.0, above), np.where(wide, 0.0, below)
    total = lambda x: (w * x).sum((1, 2))
    p_zero, p_above, p_below, m1 = total(zero), total(above), total(below), total(mean)
    ge, le = np.clip(p_above + p_zero, 0, 1), np.clip(p_below + p_zero, 0, 1)
    return {"mean": m1, "sd": np.sqrt(np.maximum(total(second) - m1**2, 0)), "probability_ge_zero": ge, "probability_le_zero": le, "probability_zero": p_zero, "lfsr": np.minimum(ge, le)}


@dataclass
class Options:
    """Defaults of ``fit``; see its docstring."""

    mu: np.ndarray | None = None
    prior_sd: np.ndarray | None = None
    half_grid: int = 50
    grid_shape: float = 3.0
    grid_expansion: float = 3.0
    grid_max_abs: float | None = None
    nonnegative_state_means: bool = False
    effect_support: str = "auto"
    positive_mean_floor: float | None = None
    min_state_count: float = 0.5
    min_state_fraction: float = 1e-5
    screening_prior_sd: float = 0.0
    topology: str = "full"
    stay_probability: float | np.ndarray = 0.98
    prefilter: bool = True
    init_transition: np.ndarray | None = None
    transition_mask: np.ndarray | None = None
    init_prob: np.ndarray | None = None
    init_rho: np.ndarray | None = None
    init_prior: float | np.ndarray = 1.0
    fixed_pointmass_states: tuple[int, ...] | None = None
    fixed_mean_states: tuple[int, ...] = (0,)
    mean_min_pointmass_weight: float = 0.0
    positive_state_means: bool | None = None
    variational_tolerance: float = 1e-6
    variational_probability_floor: float = 1e-12
    variational_final_exact: bool = True
    engine: str = "auto"
    inference: str = "exact"
    variational_maxiter: int = 1
    null_state: str = "pointmass"
    shared_mixture: bool = False
    estimate_init: bool = False
    transition_prior: float | np.ndarray = 1.0
    mixture_prior: float | np.ndarray = 1.0
    learn_state_means: bool = True
    mean_update_start: int = 3
    mean_min_effective_count: float = 2.0
    mean_min_self_transition: float = 0.93
    mean_damping: float = 1.0
    mean_bounds: str = "voronoi"
    prune_states: bool = True
    prune_start: int = 5
    prune_every: int = 5
    prune_min_state_count: float = 1.0
    prune_min_state_fraction: float = 1e-4
    prune_max_fraction: float = 0.25
    prune_max_loglik_loss: float = 0.05
    merge_distance: float | None = None
    null_model_selection: str = "none"
    null_selection_gamma: float = 1.0
    null_bic_margin: float = 0.0
    parameter_tolerance: float = 1e-6
    step_penalty: float | None = None
    step_penalty_scale: float = 1.5
    maxiter: int = 20
    tolerance: float = 1e-5


@dataclass
class Fit:
    posterior: dict[str, np.ndarray]
    state_probability: np.ndarray
    viterbi_state: np.ndarray
    penalised_state: np.ndarray
    segments: list[dict]
    boundary_probability: np.ndarray
    mu: np.ndarray
    prior_sd: np.ndarray
    rho: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    iterations: int
    converged: bool
    history: list[float] = field(default_factory=list)
    pruned: list[int] = field(default_factory=list)
    null_chosen: bool = False

    @property
    def log_evidence_ratio(self) -> float:
        return self.log_likelihood - self.null_log_likelihood

    def __repr__(self) -> str:
        return f"HMM fit: {len(self.mu)} states, {len(self.viterbi_state)} points, log likelihood {self.log_likelihood:.3f} ({self.iterations} iterations{'' if self.converged else ', not converged'})"


def parameter_count(a, mask, rho, fixed_rho: tuple[int, ...] = (0,), learned_means: int = 0, start: np.ndarray | None = None, tol: float = 1e-6) -> int:
    """Free parameters that a fit uses: moves, weights, means and, if they were learnt, starts above the tolerance."""
    moves = sum(max(0, int((row[m] > tol).sum()) - 1) for row, m in zip(a, mask, strict=True))
    weights = sum(max(0, int((r > tol).sum()) - 1) for i, r in enumerate(rho) if i not in fixed_rho)
    return moves + weights + learned_means + (0 if start is None else max(0, int((start > tol).sum()) - 1))


def fit(y, se, sequence=None, options: Options | None = None) -> Fit:
    """Baum-Welch with learnt centres, pruning checked by likelihood, and posterior summaries.

    States start on a grid of centres screened for points, the first at 0; each has its own mixture
    over prior_sd (fixed_pointmass_states, by default the null state, only the point mass). States are numbered from 0 in options;
    priors are Dirichlet counts (scalar, one a column, or a matrix) and count in the stopping rule. A state is dropped when few points use it, or when it is
    near another, but only if the likelihood hardly falls. With null_model_selection "bic" all states but the null go if
    that has the better criterion.
    """
    o = options or Options()
    y, se, sequence = check_data(y, se, sequence)
    n = len(y)
    positive = o.nonnegative_state_means if o.positive_state_means is None else o.positive_state_means
    support = o.effect_support if o.effect_support != "auto" else ("nonnegative" if positive else "real")
    if o.mu is not None:
        mu = np.asarray(o.mu, float)
    else:
        mu = mean_grid(y, o.half_grid, o.grid_shape, o.grid_expansion, o.grid_max_abs, positive)
        mu = select_grid(y, se, mu, o.min_state_count, o.min_state_fraction, o.screening_prior_sd) if o.prefilter else mu
    if not len(mu) or mu[0] != 0:
        raise ValueError("the first centre must be 0, the null state's")
    sd = np.asarray(o.prior_sd, float) if o.prior_sd is not None else sigma_grid(y, se)
    floor = o.positive_mean_floor if o.positive_mean_floor is not None else (float(np.median(se)) * 0.1 if positive else None)
    anchor, m = mu.copy(), len(mu)
    mask = transition_mask(m, o.topology) if o.transition_mask is None else np.asarray(o.transition_mask, bool)
    a = first_transition(mask, o.stay_probability) if o.init_transition is None else np.asarray(o.init_transition, float)
    check_transition(a, mask)
    start = np.full(m, 1 / m) if o.init_prob is None else np.asarray(o.init_prob, float)
    rho = np.full((m, len(sd)), 0.5 / max(1, len(sd) - 1))
    rho[:, 0] = 0.5 if len(sd) > 1 else 1.0
    rho = rho if o.init_rho is None else np.array(o.init_rho, float)
    if start.shape != (m,) or rho.shape != (m, len(sd)) or (start < 0).any() or (rho < 0).any() or abs(start.sum() - 1) > 1e-8 or np.abs(rho.sum(1) - 1).max() > 1e-8:
        raise ValueError("starts and weights must be distributions over states and components")
    points = ((0,) if o.null_state == "pointmass" else ()) if o.fixed_pointmass_states is None else o.fixed_pointmass_states
    point, fixed = np.isin(np.arange(m), points), np.isin(np.arange(m), [0, *o.fixed_mean_states])
    rho[point] = np.eye(len(sd))[0]
    alpha_a, alpha_rho = expanded_prior(o.transition_prior, m, m), expanded_prior(o.mixture_prior, m, len(sd))
    alpha_start = expanded_prior(o.init_prior, 1, m)[0]

    cache = component_logs(y, se, mu, sd, support)
    logs = mix_logs(cache, rho)
    null_level = float(log_likelihood(logs[:, :1], np.ones((1, 1)), np.ones(1), sequence))

    def infer(logs, a, start, mask, warm=None) -> tuple[Smoothed, float]:
        if o.inference == "exact" or not mask.all():
            s = forward_backward(logs, a, start, sequence, o.engine, mask)
            return s, s.log_likelihood
        q = variational_states(logs, a, start, sequence, warm, o.variational_maxiter, o.variational_tolerance, o.variational_probability_floor)
        counts, first = np.zeros(a.shape), np.zeros(len(a))
        for part in segments(sequence):
            counts += q[part][:-1].T @ q[part][1:]
            first += q[part.start]
        level = variational_bound(logs, a, start, q, sequence)
        return Smoothed(level, q, counts, first, np.full(n, np.nan)), level

    state, level = infer(logs, a, start, mask)
    history, pruned, converged, k = [level], [], False, 0
    before, stay = math.inf, np.broadcast_to(np.asarray(o.stay_probability, float), (m,))
    for k in range(1, o.maxiter + 1):
        counts, precision, weighted = component_statistics(y, se, mu, sd, rho, cache, logs, state.gamma, support)
        w = counts + (alpha_rho - 1)
        if o.shared_mixture:
            w[~point] = w[~point].sum(0)
        rho = np.where(w.sum(1, keepdims=True) > 0, np.maximum(w, 0) / np.maximum(w.sum(1, keepdims=True), 1e-300), rho)
        rho[point] = np.eye(len(sd))[0]
        moves = np.where(mask, state.counts + (alpha_a - 1), 0)
        a = np.where(moves.sum(1, keepdims=True) > 1e-12, np.maximum(moves, 0) / np.maximum(moves.sum(1, keepdims=True), 1e-300), a)
        if o.estimate_init:
            first = np.maximum(state.first + alpha_start - 1, 1e-12)
            start = first / first.sum()
        if o.learn_state_means and k >= o.mean_update_start:
            learn = ~fixed & (np.diag(a) >= o.mean_min_self_transition) & (rho[:, 0] >= o.mean_min_pointmass_weight)
            if support == "nonnegative":
                new_mu = update_truncated_means(y, se, mu, anchor, sd, rho, state.gamma, learn, counts, o.mean_min_effective_count, floor or 0.0)
            else:
                new_mu = update_means(mu, anchor, (precision, weighted), counts, learn, o.mean_min_effective_count, o.mean_damping, floor, o.mean_bounds == "voronoi")
            cache, mu = refresh_cache(cache, y, se, mu, new_mu, sd, support), new_mu
        logs = mix_logs(cache, rho)
        state, new_level = infer(logs, a, start, mask, state.gamma)
        checkpoint = o.prune_states and k >= o.prune_start and (k - o.prune_start) % o.prune_every == 0
        dropped = False
        if checkpoint and len(mu) > 1:
            use = state.gamma.sum(0)
            weak = [j for j in np.argsort(use, kind="stable").tolist() if not fixed[j] and use[j] < max(o.prune_min_state_count, n * o.prune_min_state_fraction)]
            weak += [j for j in close_states(mu, use, o.merge_distance, tuple(np.flatnonzero(fixed)))] if o.merge_distance else []
            weak = list(dict.fromkeys(weak))[: max(1, int(o.prune_max_fraction * len(mu)))] if weak else []
            while weak:
                keep = np.setdiff1d(np.arange(len(mu)), weak)
                sub = a[np.ix_(keep, keep)]
                sub = np.where(sub.sum(1, keepdims=True) > 1e-12, sub / np.maximum(sub.sum(1, keepdims=True), 1e-300), first_transition(mask[np.ix_(keep, keep)], stay[keep]))
                begin = start[keep] / start[keep].sum()
                trial, trial_level = infer(logs[:, keep], sub, begin, mask[np.ix_(keep, keep)])
                if trial_level >= new_level - o.prune_max_loglik_loss * len(weak):
                    mu, anchor, rho, a, start, mask = mu[keep], anchor[keep], rho[keep], sub, begin, mask[np.ix_(keep, keep)]
                    cache, logs, state, new_level, dropped = cache[:, :, keep], logs[:, keep], trial, trial_level, True
                    point, fixed, stay = point[keep], fixed[keep], stay[keep]
                    alpha_a, alpha_rho, alpha_start = alpha_a[np.ix_(keep, keep)], alpha_rho[keep], alpha_start[keep]
                    pruned.append(len(weak))
                    break
                weak = weak[: len(weak) // 2]
        history.append(new_level)
        goal = new_level + dirichlet_penalty(a, alpha_a, mask) + dirichlet_penalty(rho[~point], alpha_rho[~point]) + (dirichlet_penalty(start, alpha_start) if o.estimate_init else 0.0)
        small = abs(goal - before) <= o.tolerance * (1 + abs(before)) if math.isfinite(goal) and math.isfinite(before) else goal == before and new_level == level
        level, before = new_level, goal
        if small and not dropped and (checkpoint or not o.prune_states):
            converged = True
            break
    if o.inference != "exact" and o.variational_final_exact:
        state = forward_backward(logs, a, start, sequence, o.engine, mask)
        level = state.log_likelihood
    null_chosen = False
    if o.null_model_selection == "bic" and len(mu) > 1:
        size = parameter_count(a, mask, rho, tuple(np.flatnonzero(point)), int((~fixed).sum()) if o.learn_state_means else 0, start if o.estimate_init else None, o.parameter_tolerance)
        cost = size * math.log(n) * o.null_selection_gamma
        null_chosen = -2 * null_level <= -2 * level + cost + o.null_bic_margin
        if null_chosen:
            mu, rho, a, start, mask = mu[:1], rho[:1], np.ones((1, 1)), np.ones(1), np.ones((1, 1), bool)
            cache, logs = cache[:, :, :1], logs[:, :1]
            state = forward_backward(logs, a, start, sequence)
            level = state.log_likelihood
    penalty = o.step_penalty if o.step_penalty is not None else o.step_penalty_scale * math.log(max(n, 2))
    steps = penalised_path(logs, mask, sequence, penalty)
    return Fit(posterior_summary(y, se, mu, sd, rho, logs, state.gamma, cache, support), state.gamma, viterbi(logs, a, start, sequence) + 1, steps + 1, path_segments(steps, sequence, mu), state.boundary, mu, sd, rho, a, start, level, null_level, k, converged, history, pruned, null_chosen)


def binary_log_likelihood(y, se, means, q: float, sequence, start=(0.5, 0.5)) -> float:
    logs = -0.5 * (LOG_2PI + 2 * np.log(se)[:, None] + ((y[:, None] - np.asarray(means)) / se[:, None]) ** 2)
    return log_likelihood(logs, np.array([[1 - q, q], [q, 1 - q]]), np.asarray(start, float), sequence)


def fit_binary(y, se, means=(0.0, 1.0), sequence=None, interval=(0.0, 0.5), grid: int = 501, start=(0.5, 0.5)) -> dict:
    """Two known levels, one flip probability, by a grid and a golden-section search around its best point."""
    y, se, sequence = check_data(y, se, sequence)
    points = np.linspace(*interval, grid)
    value = lambda q: binary_log_likelihood(y, se, means, q, sequence, start)
    levels = [value(q) for q in points]
    i, g = int(np.argmax(levels)), (math.sqrt(5) - 1) / 2
    a, b = points[max(0, i - 1)], points[min(grid - 1, i + 1)]
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if value(c) >= value(d) else (c, b)
    q = (a + b) / 2 if value((a + b) / 2) >= levels[i] else points[i]
    logs = -0.5 * (LOG_2PI + 2 * np.log(se)[:, None] + ((y[:, None] - np.asarray(means)) / se[:, None]) ** 2)
    move = np.array([[1 - q, q], [q, 1 - q]])
    state = forward_backward(logs, move, np.asarray(start, float), sequence)
    return {"flip_probability": float(q), "log_likelihood": state.log_likelihood, "state_probability": state.gamma, "viterbi_state": viterbi(logs, move, np.asarray(start, float), sequence) + 1}
