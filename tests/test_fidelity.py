"""Chains, levels of covariates, regressions without intercept: ties, limits and options."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.functions import hmm
from curvemill.functions import mixture as mx
from curvemill.functions import wavelets as wv
from curvemill.operators import moments as mo
from curvemill.plans import regression, smoothing
from curvemill.plans.finemap import Effect, Settings, State
from curvemill.sources import views


def test_close_states_at_the_distance_and_at_ties():
    mu = np.array([0.0, 1.0, 2.0])
    assert hmm.close_states(mu, np.array([5.0, 3.0, 2.0]), 1.0) == [1, 2]
    assert hmm.close_states(mu, np.array([5.0, 2.0, 2.0]), 1.0) == [1]
    assert hmm.close_states(np.array([0.0, 1.5, 2.0]), np.array([1.0, 4.0, 9.0]), 1.0) == [1]
    assert hmm.close_states(mu, np.ones(3), 0.0) == [] and hmm.close_states(mu, np.ones(3), 1.0, (0, 1, 2)) == []


def test_penalised_path_of_a_large_penalty():
    logs = np.array([[0.0, -1000], [0, -1000], [-1000, 0], [-1000, 0]])
    assert hmm.penalised_path(logs, np.ones((2, 2), bool), np.zeros(4, int), 800.0).tolist() == [0, 0, 1, 1]
    assert len(set(hmm.penalised_path(logs, np.ones((2, 2), bool), np.zeros(4, int), 2100.0))) == 1
    for bad in (-1.0, math.inf):
        with pytest.raises(ValueError):
            hmm.penalised_path(logs, np.ones((2, 2), bool), np.zeros(4, int), bad)


def test_step_summary_counts_each_sequence_over_all_rows():
    found = hmm.step_summary(np.array([0, 0, 1, 1, 0, 0]), np.array(["a", "a", "a", "b", "b", "b"]), np.array([0.0, 2.0]))
    assert [(s["start"], s["end"], s["state"], s["state_mean"]) for s in found["segments"]] == [(1, 2, 1, 0.0), (3, 3, 2, 2.0), (4, 4, 2, 2.0), (5, 6, 1, 0.0)]
    assert found["per_sequence"] == [{"sequence": "a", "steps": 2, "changes": 1}, {"sequence": "b", "steps": 2, "changes": 1}]
    assert (found["step_count"], found["change_count"], found["occupied_state_count"]) == (4, 2, 2)


def test_parameters_count_only_starts_above_the_tolerance():
    a, mask, rho = np.full((2, 2), 0.5), np.ones((2, 2), bool), np.array([[1.0, 0.0], [0.5, 0.5]])
    assert hmm.parameter_count(a, mask, rho) == 3
    assert hmm.parameter_count(a, mask, rho, start=np.array([0.5, 0.5])) == 4
    assert hmm.parameter_count(a, mask, rho, start=np.array([1.0, 1e-9])) == 3


def test_dirichlet_priors():
    p = np.array([[0.9, 0.1], [0.5, 0.5]])
    assert abs(hmm.dirichlet_penalty(p, hmm.expanded_prior([1.0, 3.0], 2, 2)) - 2 * (math.log(0.1) + math.log(0.5))) < 1e-12
    assert hmm.dirichlet_penalty(np.eye(2), np.full((2, 2), 2.0)) == -math.inf
    assert hmm.dirichlet_penalty(np.eye(2), np.full((2, 2), 2.0), np.eye(2, dtype=bool)) == 0
    for bad in (0.5, [1.0, 2.0, 3.0], math.nan):
        with pytest.raises(ValueError):
            hmm.expanded_prior(bad, 2, 2)


def test_options_of_the_chain():
    rng = np.random.default_rng(3)
    y, se = np.repeat([0.0, 1.0, 0.0], 40) + rng.normal(0, 0.2, 120), np.full(120, 0.2)
    sd = np.array([0.0, 0.3])
    common = {"mu": np.array([0.0, 0.8]), "prior_sd": sd, "maxiter": 30}
    plain = hmm.fit(y, se, options=hmm.Options(**common))
    assert abs(plain.mu[1] - 1) < 0.15
    assert hmm.fit(y, se, options=hmm.Options(**common, fixed_mean_states=(0, 1))).mu.tolist() == [0.0, 0.8]
    both = hmm.fit(y, se, options=hmm.Options(**common, fixed_pointmass_states=(0, 1)))
    assert both.rho.tolist() == [[1, 0], [1, 0]]
    strong = hmm.fit(y, se, options=hmm.Options(**common, mixture_prior=np.array([[1.0, 1.0], [1.0, 500.0]])))
    assert strong.rho[1, 1] > 0.8 > plain.rho[1, 1] and strong.converged
    begun = hmm.fit(y, se, options=hmm.Options(**common, init_transition=np.array([[0.7, 0.3], [0.3, 0.7]]), init_prob=np.array([1.0, 0.0]), init_rho=np.array([[1.0, 0.0], [0.9, 0.1]]), stay_probability=np.array([0.9, 0.8])))
    assert abs(begun.log_likelihood - plain.log_likelihood) < 2 and begun.start.tolist() == [1, 0]
    left = hmm.fit(y, se, options=hmm.Options(**common, transition_mask=np.array([[True, True], [False, True]])))
    assert left.transition[1].tolist() == [0, 1]
    assert len(hmm.fit(y, se, options=hmm.Options(prefilter=False, prune_states=False, prior_sd=sd, maxiter=2)).mu) == 101
    for bad in ({"init_prob": np.array([0.5, 0.4])}, {"init_rho": np.ones((2, 2))}, {"init_transition": np.ones((2, 2))}):
        with pytest.raises(ValueError):
            hmm.fit(y, se, options=hmm.Options(**common, **bad))


def test_all_dummies_keep_the_first_effect_and_end_backfitting():
    prior = mx.Prior((mx.Mixture(np.array([0.0, 1.0]), np.array([1.0, 0.0])),), (np.arange(4),))
    state = State(np.eye(3), np.zeros((3, 4)), 1.0, 10, np.zeros(4, bool), Settings(), prior, 1.0)
    state.effects = [Effect(np.full(3, 1 / 3), np.zeros((3, 4)), np.zeros((3, 4)), np.full(3, float(i)), prior) for i in range(3)]
    first = state.effects[0]
    state.grow_or_prune()
    assert state.effects == [first] and not state.backfitting and not state.growing


def test_weights_from_all_rows():
    rng = np.random.default_rng(1)
    b, s = rng.normal(0, 1, (300, 4)), np.full((300, 4), 0.5)
    prior = mx.Prior((mx.Mixture(np.array([0.0, 1.0]), np.array([0.8, 0.2])),), (np.arange(4),))
    every, few = (mx.expectation_maximisation(prior, b, s, max_rows=n)[0].null for n in (None, 5))
    top = mx.expectation_maximisation(prior, b, s, max_rows=300)[0].null
    assert every == top != few


def test_shrink_level_without_points_is_the_null():
    b, s = np.ones((3, 4)), np.full((3, 4), 0.1)
    assert mx.shrink_level(b, s, np.array([0, 1]), np.array([True, True, False, False])).null == 1
    assert mx.shrink_level(b, s, np.array([2, 3]), np.array([True, True, False, False])).null == pytest.approx(9 / 15)


def test_any_label_and_any_event_type_is_a_covariate(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0], 7 + i % 4) for i in range(12)] + [(90, None, 1), (91, [1.0, 2.0], None)], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = views.embedding_rows(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and all(len(r.x) == 4 and r.x[r.label - 7] == 1 and sum(r.x) == 1 for r in rows)
    kinds = ["click", "error", "purchase", "signup", "view", "other"]
    events = spark.createDataFrame([(i, i % 3, kinds[i % 6], 1.0) for i in range(30)], "event_id bigint, user_id bigint, event_type string, value double")
    events.withColumn("ts", F.timestamp_seconds(F.col("event_id"))).write.parquet(f"{tmp_path}/events.parquet")
    _, design = views.user_curves(spark, str(tmp_path))
    assert sorted({r.j for r in design.collect()}) == [0, 1, 2, 3, 4, 5]


def test_regression_through_the_origin(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(1, 1, (40, 2)), rng.normal(0.5, 1, (40, 3))
    design = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(2)], "id int, j int, x double")
    curves = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(40) for t in range(3)], "id int, t int, y double")
    masked = spark.createDataFrame([(2,)], "t int")
    for r in mo.through_origin(design, curves, 40, masked=masked).collect():
        b = x[:, r.j] @ y[:, r.t] / (x[:, r.j] @ x[:, r.j])
        want = (0, 1) if r.t == 2 else (b, math.sqrt(np.var(y[:, r.t] - b * x[:, r.j], ddof=1) / 39))
        assert np.allclose((r.slope, r.se), want)


def _moments(x, y):
    z = np.concatenate([x, y], axis=1)
    return mo.Moments(*mo.partial(z), x.shape[1])


def test_wavelet_regression_finds_the_curves():
    rng = np.random.default_rng(6)
    x, f = rng.normal(2, 1, (400, 2)), np.stack([wv.test_curve("heavisine", 32), np.zeros(32)])
    y = 3 + x @ f + rng.normal(0, 0.3, (400, 32))
    got = regression.wavelet_regression(_moments(x, y))
    assert np.abs(got - f).max() < 0.12 and np.abs(got[1]).max() < 0.05


def test_pooled_translation_invariant_curve():
    rng = np.random.default_rng(7)
    x, f = rng.normal(0, 1, (300, 1)), wv.test_curve("blocks", 32)
    y = x * f + rng.normal(0, 0.5, (300, 32))
    m = _moments(x, y)
    for method in ("ti", "ti_pooled"):
        c = smoothing.univariate(method, float(m.xtx[0, 0]), m.xty[0], m.yty, m.n)
        low, up = c.band()
        assert np.abs(c.effect - f).mean() < 0.1 and ((low <= f) & (f <= up)).mean() > 0.7
