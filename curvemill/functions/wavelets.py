"""Periodic orthonormal wavelets as matrices on the driver.

A transform of curves of length J is a J x J matrix, built once; it is applied
to second moments, or to rows by a broadcast join, never by a loop over curves.
Coefficients are numbered 1..J: finest scale first, the scaling coefficient last.
"""

from __future__ import annotations

import math

import numpy as np

LARGEST = 1 << 15


def is_power_of_two(n: int) -> bool:
    return n >= 1 and not n & (n - 1)


def filter_taps(moments: int = 10, family: str = "least_asymmetric") -> np.ndarray:
    """Low-pass Daubechies filter with so many vanishing moments, by spectral factorisation.

    family: "extremal_phase" takes the roots inside the unit circle;
    "least_asymmetric" the choice whose phase is nearest to linear.
    """
    if moments == 1:
        return np.array([1.0, 1.0]) / math.sqrt(2)
    # product filter: (1 + z)^2N times a polynomial in y = (2 - z - 1/z) / 4
    y_roots = np.roots([math.comb(moments - 1 + k, k) for k in range(moments - 1, -1, -1)])
    groups = []  # roots that must be chosen together, to keep the filter real
    for y in y_roots:
        if y.imag < -1e-12:
            continue
        b = 1 - 2 * y
        z = b + np.sqrt(b * b - 1 + 0j)
        z = z if abs(z) < 1 else 1 / z
        groups.append([z, np.conj(z)] if abs(y.imag) > 1e-12 else [z.real])

    def taps(inside: int) -> np.ndarray:
        roots = [-1.0] * moments
        for i, g in enumerate(groups):
            roots += [1 / r if inside >> i & 1 else r for r in g]
        h = np.real(np.poly(roots))
        return h * math.sqrt(2) / h.sum()

    if family == "extremal_phase":
        return taps(0)
    if family != "least_asymmetric":
        raise ValueError("family must be extremal_phase or least_asymmetric")
    w = np.linspace(0.01, math.pi * 0.7, 200)

    def bend(h: np.ndarray) -> float:
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(h)))) @ h))
        line = np.polyfit(w, phase, 1)
        return float(np.square(phase - np.polyval(line, w)).sum())

    return min((taps(i) for i in range(1 << max(0, len(groups) - 1))), key=bend)


def _step(n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.zeros((n // 2, n)), np.zeros((n // 2, n))
    g = h[::-1] * np.where(np.arange(len(h)) % 2, -1.0, 1.0)
    for k in range(n // 2):
        np.add.at(low[k], (2 * k + np.arange(len(h))) % n, h)
        np.add.at(high[k], (2 * k + np.arange(len(h))) % n, g)
    return low, high


def transform_matrix(size: int, moments: int = 10, family: str = "least_asymmetric") -> np.ndarray:
    """W with W @ curve = coefficients; orthonormal, so its transpose is the inverse."""
    if not is_power_of_two(size) or not 4 <= size <= LARGEST:
        raise ValueError(f"a curve must have 2**k points, 4 to {LARGEST}")
    h = filter_taps(moments, family)
    rows, smooth = [], np.eye(size)
    while len(smooth) > 1:
        low, high = _step(len(smooth), h)
        rows.append(high @ smooth)
        smooth = low @ smooth
    return np.concatenate([*rows, smooth])


def haar_matrix(size: int) -> np.ndarray:
    return transform_matrix(size, 1)


def scales(size: int) -> np.ndarray:
    """Scale of each coefficient: s for the block of 2**s details (the finest is log2(size) - 1), log2(size) for the scaling coefficient."""
    depth = size.bit_length() - 1
    blocks = [np.full(1 << s, s) for s in range(depth - 1, -1, -1)]
    return np.concatenate([*blocks, [depth]]).astype(int)


def scale_blocks(size: int) -> list[np.ndarray]:
    """Coefficient positions (from 0) of each scale, coarsest detail first and the scaling coefficient last."""
    own = scales(size)
    return [np.flatnonzero(own == s) for s in range(own.max() + 1)]


def evenly_spaced(pos: np.ndarray, tol: float = 1e-9) -> bool:
    gaps = np.diff(np.asarray(pos, float))
    return bool(np.ptp(gaps) < tol * max(1.0, np.abs(gaps).max(initial=0))) if len(gaps) else True


def needs_remap(pos: np.ndarray, max_scale: int = 10) -> bool:
    return not is_power_of_two(len(pos)) or not evenly_spaced(pos) or math.log2(len(pos)) > max_scale


def interpolation(pos: np.ndarray, max_scale: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(grid, A): A @ curve is its linear interpolation at the grid's points.

    The grid has min(2**max_scale, the power of two above J - 1 halved ...) points, at the middles of equal
    cells of the positions' range; beyond the first or last position values are held.
    """
    pos = np.asarray(pos, float)
    order = np.argsort(pos, kind="stable")
    sorted_pos = pos[order]
    size = min(1 << max_scale, 1 << (int(math.floor(math.log2(max(2, len(pos) - 1)))) + 1))
    unit = (np.arange(size) + 0.5) / size
    grid = sorted_pos[0] + unit * (sorted_pos[-1] - sorted_pos[0])
    right = np.clip(np.searchsorted(sorted_pos, grid, side="right"), 1, len(pos) - 1)
    left = right - 1
    gap = sorted_pos[right] - sorted_pos[left]
    share = np.clip(np.where(gap > 0, (grid - sorted_pos[left]) / np.where(gap > 0, gap, 1), 0.0), 0, 1)
    a = np.zeros((size, len(pos)))
    np.add.at(a, (np.arange(size), order[left]), 1 - share)
    np.add.at(a, (np.arange(size), order[right]), share)
    return grid, a


def mirrored(x: np.ndarray) -> tuple[np.ndarray, slice]:
    """The curve followed by its mirror image and padded to a power of two, and where the original lies."""
    n = len(x)
    size = 1 << (n - 1).bit_length()
    both = np.concatenate([x, x[::-1]])
    out = np.concatenate([both, both])[: 2 * size] if 2 * size > len(both) else both[: 2 * size]
    return out, slice(0, n)


def shifted(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.roll(x, -n)


def stationary_haar(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(D, smooth): D[level] @ curve are the undecimated details of that level (finest first); smooth @ curve is the coarsest average."""
    details, smooth, eye = [], np.eye(size), np.eye(size)
    for level in range(size.bit_length() - 1):
        ahead = np.roll(eye, -(1 << level), axis=0) @ smooth
        details.append((smooth - ahead) / math.sqrt(2))
        smooth = (smooth + ahead) / math.sqrt(2)
    return np.array(details), smooth


def average_basis_inverse(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, v): curve = sum over levels of V[level] @ details[level] + v @ smooth, averaged over all shifts of the basis."""
    eye, levels = np.eye(size), size.bit_length() - 1
    inverse, back = [None] * levels, np.eye(size)
    for level in range(levels):
        behind = np.roll(eye, 1 << level, axis=0)
        inverse[level] = back @ (eye - behind) / (2 * math.sqrt(2))
        back = back @ (eye + behind) / (2 * math.sqrt(2))
    return np.array(inverse), back


def average_basis_variance(details: np.ndarray, smooth: np.ndarray) -> np.ndarray:
    """Variance of the averaged inverse from independent coefficient variances (levels x size, size).

    Follows the reconstruction level by level with squared filters: each step averages two shifts of which each sums two terms.
    """
    size = len(smooth)
    v = smooth.copy()
    for level in range(size.bit_length() - 2, -1, -1):
        total = v + details[level]
        v = (total + np.roll(total, 1 << level)) / 4
    return v


def variance_transform(variance: np.ndarray, moments: int = 10, family: str = "least_asymmetric") -> np.ndarray:
    """Variances of the coefficients of a curve with independent points."""
    return np.square(transform_matrix(len(variance), moments, family)) @ variance


def haar_fisz(counts: np.ndarray) -> np.ndarray:
    """Variance-stabilised counts (Fryzlewicz and Nason 2004), row by row; the length must be a power of two."""
    s = np.atleast_2d(np.asarray(counts, float))
    if not is_power_of_two(s.shape[1]):
        raise ValueError("a curve must have 2**k points")
    fisz = []
    while s.shape[1] > 1:
        mean, diff = (s[:, ::2] + s[:, 1::2]) / 2, (s[:, ::2] - s[:, 1::2]) / 2
        fisz.append(np.where(mean > 0, diff / np.sqrt(np.where(mean > 0, mean, 1)), 0.0))
        s = mean
    for f in reversed(fisz):
        out = np.empty((s.shape[0], 2 * s.shape[1]))
        out[:, ::2], out[:, 1::2] = s + f, s - f
        s = out
    return s


def test_curve(name: str, n: int = 128) -> np.ndarray:
    """Curves of Donoho and Johnstone (1994) on (1..n)/n: blocks, bumps, heavisine, doppler."""
    t = np.arange(1, n + 1) / n
    # fixed values: jump and bump positions, heights and widths of the paper
    at = np.array([0.1, 0.13, 0.15, 0.23, 0.25, 0.4, 0.44, 0.65, 0.76, 0.78, 0.81])
    jumps = np.array([4, -5, 3, -4, 5, -4.2, 2.1, 4.3, -3.1, 2.1, -4.2])
    heights = np.array([4, 5, 3, 4, 5, 4.2, 2.1, 4.3, 3.1, 5.1, 4.2])
    widths = np.array([0.005, 0.005, 0.006, 0.01, 0.01, 0.03, 0.01, 0.01, 0.005, 0.008, 0.005])
    if name == "blocks":
        return ((1 + np.sign(t[:, None] - at)) / 2) @ jumps
    if name == "bumps":
        return ((1 + np.abs((t[:, None] - at) / widths)) ** -4) @ heights
    if name == "heavisine":
        return 4 * np.sin(4 * math.pi * t) - np.sign(t - 0.3) - np.sign(0.72 - t)
    if name == "doppler":
        return np.sqrt(t * (1 - t)) * np.sin(2 * math.pi * 1.05 / (t + 0.05))
    raise ValueError(name)
