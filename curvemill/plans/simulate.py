"""Seeded simulated curves for tests and examples."""

from __future__ import annotations

import numpy as np

from ..functions.wavelets import haar_matrix, scales, test_curve, transform_matrix


def mixture_curve(size: int, rng: np.random.Generator, null: float = 0.85, grid: int = 10) -> np.ndarray:
    """Coefficients from a spike and normals whose scales are chi-square draws; never all zero."""
    sd = np.concatenate([[0.0], np.sort(rng.chisquare(3, grid - 1))])
    share = np.concatenate([[null], rng.dirichlet(np.ones(grid - 1)) * (1 - null)])
    while True:
        c = rng.normal(size=size) * sd[rng.choice(grid, size, p=share)]
        if c.any():
            return transform_matrix(size).T @ c


def scaled_curve(size: int, rng: np.random.Generator, decay: float = 0.8, sparsity: float = 0.1) -> np.ndarray:
    """Coefficients whose spread and share of nonzeros fall with the scale."""
    s = scales(size).astype(float)
    nonzero = rng.random(size) < np.exp(-sparsity * s)
    return transform_matrix(size).T @ (nonzero * rng.normal(size=size) * 2.0 ** (-decay * s))


def genotypes(n: int, p: int, rng: np.random.Generator) -> np.ndarray:
    return rng.binomial(2, rng.uniform(0.1, 0.5, p), (n, p)).astype(float)


def effect_data(n: int, p: int, size: int, causal: dict[int, np.ndarray | str], noise: float, seed: int = 0, factor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): genotypes and curves with the named covariates' effects (a curve, or the name of a test curve)."""
    rng = np.random.default_rng(seed)
    x = genotypes(n, p, rng) if factor is None else factor
    y = rng.normal(size=(n, size)) * noise
    for j, f in causal.items():
        y += np.outer(x[:, j], test_curve(f, size) if isinstance(f, str) else f)
    return x, y


def block_curve(size: int, start: int, stop: int, height: float) -> np.ndarray:
    out = np.zeros(size)
    out[start:stop] = height
    return out


__all__ = ["block_curve", "effect_data", "genotypes", "haar_matrix", "mixture_curve", "scaled_curve"]
