"""Closed forms and identities of the numeric kernels."""

import math

import numpy as np
import pytest

from curvemill.functions import hmm, special
from curvemill.functions import mixture as mx
from curvemill.functions import wavelets as wv


def test_normal_functions():
    x = np.array([-40.0, -12.0, -9.99, -1.0, 0.0, 3.0])
    assert np.allclose(special.log_normal_cdf(x)[2:], np.log(special.normal_cdf(x[2:])), atol=1e-9)
    assert abs(special.log_normal_cdf(np.array(-40.0)) + 804.6084420137538) < 1e-6
    p = np.array([1e-200, 1e-8, 0.2, 0.5, 0.9])
    assert np.allclose(special.normal_cdf(special.normal_quantile(p[1:])), p[1:], rtol=1e-9)
    assert abs(special.log_t_tail(2.0, 5.0) - math.log(0.0509697394)) < 1e-7
    assert abs(special.equivalent_normal_effect(2.0, 1.0, 1e7) - 2) < 1e-4
    assert np.allclose(special.two_sided_se(np.array([1.96]), np.array([0.05])), 1.0, atol=1e-4)


@pytest.mark.parametrize("moments,family", [(1, "extremal_phase"), (4, "extremal_phase"), (8, "least_asymmetric"), (10, "least_asymmetric")])
def test_filters_and_matrices(moments, family):
    h = wv.filter_taps(moments, family)
    assert len(h) == 2 * moments and abs(h.sum() - math.sqrt(2)) < 1e-10
    k = np.arange(len(h))
    sign = (-1.0) ** k
    for m in range(min(moments, 4)):  # vanishing moments of the high-pass filter
        assert abs((sign * h[::-1] * k**m).sum()) < 1e-5 * max(1, k[-1] ** m)
    w = wv.transform_matrix(64, moments, family)
    assert np.abs(w @ w.T - np.eye(64)).max() < 1e-10


def test_coefficient_index_and_limits():
    assert [len(b) for b in wv.scale_blocks(16)] == [1, 2, 4, 8, 1]
    assert wv.scale_blocks(16)[-1].tolist() == [15] and wv.scale_blocks(16)[0].tolist() == [14]
    with pytest.raises(ValueError):
        wv.transform_matrix(12)


def test_stationary_inverse_and_variance():
    rng = np.random.default_rng(0)
    x = rng.normal(size=32)
    d, s = wv.stationary_haar(32)
    v, v0 = wv.average_basis_inverse(32)
    assert np.abs(sum(v[i] @ d[i] @ x for i in range(5)) + v0 @ s @ x - x).max() < 1e-10
    assert np.allclose(wv.average_basis_variance(np.zeros((5, 32)), np.zeros(32)), 0)
    assert np.allclose(wv.haar_fisz(np.full((2, 16), 7.0)), 7.0)


def test_interpolation_is_linear():
    pos = np.sort(np.random.default_rng(1).uniform(0, 10, 21))
    grid, a = wv.interpolation(pos)
    assert len(grid) == 32 and np.allclose(a.sum(1), 1) and np.allclose(a @ (3 * pos + 1), 3 * grid + 1)
    assert not wv.needs_remap(np.arange(64.0)) and wv.needs_remap(np.arange(60.0)) and wv.needs_remap(pos)


def test_mixture_weights_meet_their_conditions():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=400), rng.normal(size=100) * 4])
    s = np.ones(500)
    part = mx.Mixture(mx.sd_grid(x, s), np.ones(len(mx.sd_grid(x, s))))
    logs = mx.component_logs(part, x, s)
    w = mx.fit_weights(logs, np.ones(500), np.ones(len(part.sd)), steps=3000, tol=1e-13)
    gain = (np.exp(logs) / (np.exp(logs) @ w)[:, None]).mean(0)
    assert gain.max() < 1.005 and abs(w.sum() - 1) < 1e-9


def test_bayes_factor_posterior_and_mask():
    prior = mx.start_prior(np.array([0.0, 1.0]), [np.array([0]), np.array([1])], False)
    b, s = np.array([[1.0, -2.0], [0.3, 0.0]]), np.array([[0.5, 1.0], [0.5, 1.0]])
    dens = lambda v, var: math.exp(-v * v / 2 / var) / math.sqrt(2 * math.pi * var)
    want = [sum(math.log((0.8 * dens(x, t * t) + 0.2 * dens(x, 1 + t * t)) / dens(x, t * t)) for x, t in zip(r, q, strict=True)) for r, q in zip(b, s, strict=True)]
    assert np.allclose(mx.log_bayes_factor(prior, b, s), want)
    mean, sd = mx.posterior(prior, b, s, masked=np.array([False, True]), rows=np.array([True, False]))
    w = 0.2 * dens(1, 1.25) / (0.8 * dens(1, 0.25) + 0.2 * dens(1, 1.25))
    assert abs(mean[0, 0] - w * 0.8) < 1e-12 and not mean[1].any() and not sd[:, 1].any() and not sd[1].any()
    lfsr = mx.local_false_sign_rate(prior, b, s)
    grid = np.linspace(-12, 12, 48_001)
    for i in range(2):
        for k in range(2):
            x, t = b[i, k], s[i, k]
            slab = 0.2 * np.exp(-(grid**2) / 2 - (x - grid) ** 2 / (2 * t * t)) / (2 * np.pi * t)
            below, above, null = slab[grid < 0].sum() * 5e-4, slab[grid > 0].sum() * 5e-4, 0.8 * dens(x, t * t)
            assert abs(lfsr[i, k] - (min(below, above) + null) / (below + above + null)) < 1e-4
    swapped = mx.log_bayes_factor(prior, -b[:, ::-1], s[:, ::-1])
    assert np.allclose(swapped, want)  # signs and order within a block don't matter


def test_null_snapping():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(5, 64)) * 0.1
    prior = mx.start_prior(mx.sd_grid(b, np.full(b.shape, 0.1)), [np.arange(64)], False)
    out, _ = mx.expectation_maximisation(prior, b, np.full(b.shape, 0.12))
    assert out.null > 0.9


# hidden Markov chains

def brute(logs, a, start):
    import itertools

    n, m = logs.shape
    total, gamma, counts, best = 0.0, np.zeros((n, m)), np.zeros((m, m)), (-1, None)
    for path in itertools.product(range(m), repeat=n):
        p = start[path[0]] * math.exp(logs[0, path[0]])
        for i in range(1, n):
            p *= a[path[i - 1], path[i]] * math.exp(logs[i, path[i]])
        total += p
        for i, k in enumerate(path):
            gamma[i, k] += p
            if i:
                counts[path[i - 1], k] += p
        if p > best[0]:
            best = (p, path)
    return math.log(total), gamma / total, counts / total, best[1]


@pytest.mark.parametrize("engine", ["scaled", "log"])
def test_smoothing_matches_enumeration(engine):
    rng = np.random.default_rng(4)
    logs, a, start = rng.normal(size=(6, 3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    want = brute(logs, a, start)
    got = hmm.forward_backward(logs, a, start, np.zeros(6, int), engine)
    assert abs(got.log_likelihood - want[0]) < 1e-10 and np.allclose(got.gamma, want[1]) and np.allclose(got.counts, want[2])
    assert tuple(hmm.viterbi(logs, a, start, np.zeros(6, int))) == want[3]
    assert abs(hmm.log_likelihood(logs, a, start, np.zeros(6, int)) - want[0]) < 1e-10
    two = hmm.forward_backward(np.tile(logs, (2, 1)), a, start, np.repeat([0, 1], 6), engine)
    assert abs(two.log_likelihood - 2 * want[0]) < 1e-9 and np.isnan(two.boundary[[0, 6]]).all()
    q = hmm.variational_states(logs, a, start, np.zeros(6, int))
    assert hmm.variational_bound(logs, a, start, q, np.zeros(6, int)) <= want[0] + 1e-9


def test_step_signal_is_recovered():
    rng = np.random.default_rng(5)
    truth = np.repeat([0.0, 2.0, 0.0, -1.0], 50)
    se = np.full(200, 0.4)
    fit = hmm.fit(truth + rng.normal(size=200) * 0.4, se)
    assert np.sqrt(np.mean((fit.posterior["mean"] - truth) ** 2)) < 0.2
    assert [s["start"] for s in fit.segments] == pytest.approx([1, 51, 101, 151], abs=3)
    assert all(b >= a - 1e-6 for a, b in zip(fit.history[3:5], fit.history[4:6], strict=False)) and fit.log_evidence_ratio > 0
    assert fit.posterior["lfsr"][75] < 0.01
    null = hmm.fit(rng.normal(size=150) * 0.4, se[:150], options=hmm.Options(null_model_selection="bic"))
    assert null.null_chosen and not null.posterior["mean"].any()


def test_variants_run_and_agree_on_sign():
    rng = np.random.default_rng(6)
    y = np.repeat([0.0, 1.5], 60) + rng.normal(size=120) * 0.3
    for o in (hmm.Options(topology="hub"), hmm.Options(inference="variational", variational_maxiter=5), hmm.Options(nonnegative_state_means=True, half_grid=20), hmm.Options(shared_mixture=True, estimate_init=True, merge_distance=0.1)):
        mean = hmm.fit(y, np.full(120, 0.3), options=o).posterior["mean"]
        assert abs(mean[30]) < 0.3 and abs(mean[90] - 1.5) < 0.4
    with pytest.raises(ValueError):
        hmm.fit(np.array([1.0, np.nan]), np.ones(2))
    binary = hmm.fit_binary((np.arange(100) // 25 % 2) + rng.normal(size=100) * 0.3, np.full(100, 0.3))
    assert 0.01 < binary["flip_probability"] < 0.1


def test_truncated_moments():
    z = np.array([-20.0, -3.0, 0.0, 2.0])
    mean, var = special.truncated_moments(z)
    x = np.linspace(1e-9, 12, 400_001)
    for i in (1, 2, 3):
        w = np.exp(-0.5 * (x - z[i]) ** 2)
        m = (w * x).sum() / w.sum()
        assert abs(mean[i] - m) < 1e-3 and abs(var[i] - ((w * x * x).sum() / w.sum() - m * m)) < 1e-3
    assert 0 < mean[0] < 0.06
