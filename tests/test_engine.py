"""Moments, fits and DataFrame operators, against row-level numpy and recovery of known effects."""

import numpy as np
import pytest

from curvemill.functions import hmm
from curvemill.functions import mixture as mx
from curvemill.functions import wavelets as wv
from curvemill.operators import credible as cr
from curvemill.operators import moments as mo
from curvemill.operators.moments import Moments, partial
from curvemill.plans import finemap as fm
from curvemill.plans import queries, regression, report, simulate, smoothing
from curvemill.plans.finemap import FunctionalFineMapper
from curvemill.streaming.moments_stream import MomentsSink, windowed_bins


def rows_of(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id bigint, x array<double>, y array<double>")


def moments_of(x, y):
    return Moments(*partial(np.concatenate([x, y], axis=1)), x.shape[1])


@pytest.fixture(scope="module")
def two():
    return simulate.effect_data(300, 20, 64, {3: simulate.block_curve(64, 10, 20, 1.0), 12: simulate.block_curve(64, 40, 60, -0.8)}, 1.0, seed=1)


def test_distributed_moments_equal_numpy(spark, two):
    x, y = two
    m = mo.moments(rows_of(spark, x, y + 1e6).repartition(7))
    z = np.concatenate([x, y + 1e6], 1)
    c = z - z.mean(0)
    assert m.n == 300 and np.allclose(m.mean, z.mean(0)) and np.allclose(m.cross, c.T @ c, rtol=1e-9, atol=1e-6)
    bad = rows_of(spark, x, y).unionByName(spark.createDataFrame([(-1, None, [1.0]), (-2, [None] * 20, [0.0] * 64)], "id bigint, x array<double>, y array<double>"))
    assert mo.moments(bad).n == 300
    with pytest.raises(ValueError):
        mo.moments(bad.limit(0))


def test_moments_add_up(two):
    x, y = two
    a, b, whole = moments_of(x[:100], y[:100]), moments_of(x[100:], y[100:]), moments_of(x, y)
    assert np.allclose((a + b).cross, whole.cross) and np.allclose((a + b).mean, whole.mean)


def test_marginal_frame_equals_least_squares(spark, two):
    x, y = two
    long = rows_of(spark, x, y)
    design = long.selectExpr("id", "posexplode(x) as (j, x)").where("x <> 0")
    curves = long.selectExpr("id", "posexplode(y) as (t, y)").selectExpr("id", "t + 1 as t", "y")
    got = mo.marginal(design, curves, 300).toPandas().sort_values(["j", "t"])
    xs, ys = ((v - v.mean(0)) / v.std(0, ddof=1) for v in (x, y))
    b = xs.T @ ys / 299
    se = np.sqrt(((ys**2).sum(0) - b**2 * 299) / 299 / 299)
    assert np.allclose(got.bhat, b.ravel()) and np.allclose(got.shat, se.ravel())


def test_moment_path_equals_row_path(two):
    x, y = two
    fit = fm.fit_moments(moments_of(x, y), settings=fm.Settings(effects=2, start_effects=2, smoother="none"))
    s = fit.state
    xs = (x - x.mean(0)) / x.std(0, ddof=1)
    yc = (y - y.mean(0)) / y.std(0, ddof=1)
    w = yc @ wv.transform_matrix(64).T
    w = w / w.std(0, ddof=1)
    f = s.fitted()
    er2 = ((w - xs @ f) ** 2).sum() + sum((s.d[:, None] * e.second).sum() - ((xs @ e.first) ** 2).sum() for e in s.effects)
    assert abs(s.squared_error() - er2) < 1e-6 * er2
    assert np.allclose(s.residual(0), xs.T @ (w - xs @ (f - s.effects[0].first)), atol=1e-8)


@pytest.mark.parametrize("prior", ["single", "per_scale"])
def test_two_effects_are_found(two, prior):
    x, y = two
    fit = fm.fit_moments(moments_of(x, y), settings=fm.Settings(prior=prior))
    assert {int(fit.kept[e.lead]) for e in fit.state.effects} == {3, 12}
    assert fit.pip()[[3, 12]].min() > 0.95 and np.delete(fit.pip(), [3, 12]).max() < 0.5
    for e, c in zip(fit.state.effects, fit.curves, strict=True):
        truth = simulate.block_curve(64, 10, 20, 1.0) if fit.kept[e.lead] == 3 else simulate.block_curve(64, 40, 60, -0.8)
        low, up = c.band()
        assert np.corrcoef(c.effect, truth)[0, 1] > 0.9 and ((low - 0.2 <= truth) & (truth <= up + 0.2)).mean() > 0.9
    assert fit.state.elbo[-1] >= fit.state.elbo[-2] - 1e-6
    for other in ("hmm", "smash", "none"):
        assert np.corrcoef(fit.refit(other).curves[0].effect, fit.curves[0].effect)[0, 1] > 0.85


def test_objective_identities():
    """Kullback-Leibler divergence = expected less marginal log likelihood; on a state with known factors."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(4, 2)), rng.normal(size=(4, 2))
    prior = mx.start_prior(np.array([0.0, 1.0]), [np.arange(2)], False)
    mean, var = rng.normal(size=(2, 2)), rng.uniform(0.1, 1, (2, 2))
    e = fm.Effect(np.array([0.3, 0.7]), mean, var, np.log([2.0, 0.5]), prior)
    s = fm.State(x.T @ x, x.T @ y, float((y**2).sum()), 4, np.zeros(2, bool), fm.Settings(), prior, 0.7, [e])
    assert np.allclose(s.residual(0), x.T @ y)  # a single effect sees the data
    assert abs(s.divergence(0) - (s.expected_log_likelihood(0) - s.marginal_log_likelihood(0))) < 1e-10
    normal = -4 * np.log(2 * np.pi * 0.7) - (y**2).sum() / 1.4
    assert abs(s.marginal_log_likelihood(0) - (np.log(1.25) + normal)) < 1e-10
    assert abs(s.objective() - (s.log_likelihood() - s.divergence(0))) < 1e-12
    rate = s.false_sign_rate(0)
    assert rate.shape == (2,) and ((rate >= 0) & (rate <= 1)).all()


def test_constant_columns_and_order(two):
    x, y = two
    wide = np.insert(x, 5, 7.0, axis=1)
    fit = fm.fit_moments(moments_of(wide, y))
    assert fit.pip()[5] == 0 and np.isneginf(fit.lbf()[0][5]) and {int(fit.kept[e.lead]) for e in fit.state.effects} == {3, 13}
    flipped = fm.fit_moments(moments_of(-x[:, ::-1], y))
    assert np.allclose(flipped.pip()[::-1], fm.fit_moments(moments_of(x, y)).pip(), atol=1e-6)
    with pytest.raises(ValueError, match="constant"):
        fm.fit_moments(moments_of(np.ones((8, 2)), np.random.default_rng(0).normal(size=(8, 4))))


def test_irregular_positions(two):
    x, y = two
    keep = np.sort(np.random.default_rng(2).choice(64, 50, replace=False))
    fit = fm.fit_moments(moments_of(x, y[:, keep]), pos=keep.astype(float))
    assert len(fit.grid) == 64 and {int(fit.kept[e.lead]) for e in fit.state.effects} == {3, 12}


def test_state_changes_keep_an_effect():
    x, y = simulate.effect_data(60, 5, 16, {}, 1.0, seed=3)
    fit = fm.fit_moments(moments_of(x, y))
    assert len(fit.state.effects) >= 1 and fit.pip().max() <= 1
    s = fit.state
    s.discard(list(range(len(s.effects))))
    assert len(s.effects) == 1
    assert fm.relation(np.array([1, 2]), np.array([2, 1, 3])) == "a_in_b"
    assert fm.credible_set(np.array([0.5, 0.45, 0.05]), 0.95).tolist() == [0, 1, 2]  # strictly more than the coverage


def test_regression_adjusts(spark, two):
    x, y = two
    fit = regression.fit_moments(moments_of(x, y))
    assert np.corrcoef(fit.curves[3], simulate.block_curve(64, 10, 20, 1.0))[0, 1] > 0.9 and np.abs(fit.curves[7]).max() < 0.3
    got = fit.adjusted_rows(rows_of(spark, x, y), "id").toPandas().sort_values(["id", "t"]).y.values.reshape(300, 64)
    assert np.allclose(got, y - (x - x.mean(0)) @ fit.curves)


def test_fit_tables_and_reports(spark, two):
    x, y = two
    rows = rows_of(spark, x, y)
    fit = FunctionalFineMapper(effects=3).fit(rows)
    tables = fit.effects_table(spark)
    assert np.allclose(cr.pip(tables).toPandas().sort_values("j").pip, fit.pip(), atol=1e-9)
    sets = cr.credible_sets(tables, 0.95).toPandas()
    assert [sets[sets.effect == i + 1].sort_values("place").j.tolist() for i in range(len(fit.sets()))] == [s.tolist() for s in fit.sets()]
    got = fit.fitted_rows(rows, "id").toPandas().sort_values(["id", "t"]).fit.values.reshape(300, 64)
    leads = [int(fit.kept[e.lead]) for e in fit.state.effects]
    assert np.allclose(got, y.mean(0) + sum(np.outer(x[:, j] - x[:, j].mean(), c.effect) for j, c in zip(leads, fit.curves, strict=True)))
    regions = report.regions(fit, spark).toPandas()
    assert {1, 2} >= set(regions.effect) and len(regions) >= 2
    assert report.pip_plot(fit, spark).where("effect is not null").count() == sum(len(set(s.tolist())) for s in fit.sets())
    assert report.effect_plot(fit, spark).count() == 64 * len(fit.curves)


def test_fit_by_region_equals_single_fits(spark, two):
    x, y = two
    rows = rows_of(spark, x, y).selectExpr("id", "x", "y", "cast(id % 2 as int) as region")
    got = FunctionalFineMapper(effects=2, start_effects=2).fit_by_region(rows, "region").toPandas()
    for r in (0, 1):
        own = fm.fit_moments(moments_of(x[r::2], y[r::2]), settings=fm.Settings(effects=2, start_effects=2))
        assert np.allclose(got[(got.region == r) & (got.effect == 1)].sort_values("j").pip, own.pip(), atol=1e-6)


def test_streamed_moments(spark, two, tmp_path):
    x, y = two
    rows_of(spark, x, y).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, x array<double>, y array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = MomentsSink(spark, str(tmp_path / "out"))
    sink.start(stream, str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert np.allclose(sink.total().cross, moments_of(x, y).cross)
    sink.write_batch(rows_of(spark, x, y).limit(0), 99)
    events = spark.createDataFrame([("2024-01-01 01:00:00", 1, 2.0), ("2024-01-01 02:00:00", 1, 3.0), ("2024-01-02 01:00:00", 1, 4.0)], "ts string, user_id bigint, value double").selectExpr("cast(ts as timestamp) ts", "user_id", "value")
    assert sorted(r.y for r in windowed_bins(events).collect()) == [4.0, 5.0]


def test_islands_segments_and_coloc(spark):
    c = spark.createDataFrame([(1, t, float(t in (3, 4, 5, 9)) - 0.5, 2.0) for t in range(1, 12)], "effect int, t int, low double, up double")
    assert sorted(map(tuple, cr.affected_regions(c).select("start", "end").collect())) == [(3, 5), (9, 9)]
    assert cr.affected_regions(c.where("t > 9")).count() == 0
    trait = spark.createDataFrame([(j, 20.0 if j == 4 else 0.0) for j in range(50)], "j int, lbf double")
    other = spark.createDataFrame([(j, 20.0 if j == 7 else 0.0) for j in range(50)], "j int, lbf double")
    h = {r.h: r.posterior for r in cr.colocalised(trait, trait).collect()}
    assert h[4] > 0.9 and abs(sum(h.values()) - 1) < 1e-9
    assert {r.h: r.posterior for r in cr.colocalised(trait, other).collect()}[3] > 0.9


def test_smoothers_on_a_known_signal():
    rng = np.random.default_rng(7)
    truth = wv.test_curve("blocks", 128)
    y = truth + rng.normal(size=128)
    mean, var = smoothing.smooth_signal(y, np.ones(128))
    assert np.mean((mean - truth) ** 2) < 0.6 * np.mean((y - truth) ** 2) and (np.abs(mean - truth) < 3 * np.sqrt(var) + 0.5).mean() > 0.9
    assert len(smoothing.smooth_signal(y[:100], np.ones(100))[0]) == 100
    x, _, part = mx.shrink(np.concatenate([np.zeros(90), np.full(10, 8.0)]), np.ones(100))
    assert abs(x[95] - 8) < 0.5 and abs(x[5]) < 0.05 and abs(part.weight.sum() - 1) < 1e-9


def test_binary_chain_of_all_points(spark, sf, monkeypatch):
    """Every point counts, at each of the operator's flip probabilities; short curves against all paths."""
    b = queries.QUERIES["marginal_slope"](spark, sf).toPandas()
    got = queries.QUERIES["hmm_binary_loglik"](spark, sf).toPandas()
    assert sorted(got.j.unique()) == sorted(b.j.unique()) and (got.groupby("j").q.nunique() == 501).all() and got.q.min() == 0 and got.q.max() == 0.5
    fit = queries.QUERIES["hmm_binary_fit"](spark, sf).toPandas()
    assert (fit.groupby("seq").t.nunique() == 64).all()
    best = fit.groupby("seq").log_likelihood.first()
    assert (best >= got.groupby("j").log_lik.max() - 5.1e-6).all()  # which the query rounds
    rng = np.random.default_rng(4)
    y, se = rng.normal(size=14) * 0.1, np.full(14, 0.05)
    short = spark.createDataFrame([(0, t + 1, float(y[t]), 0.05) for t in range(14)], "j int, t int, bhat double, shat double")
    monkeypatch.setattr(queries, "_marginal", lambda *_: short)
    paths = (np.arange(1 << 14)[:, None] >> np.arange(14)) & 1
    dens = -0.5 * np.log(2 * np.pi * se**2) - 0.5 * ((y - 0.05 * paths) / se) ** 2
    flips = (paths[:, 1:] != paths[:, :-1]).sum(1)
    own = queries.QUERIES["hmm_binary_loglik"](spark, sf).toPandas().set_index("q").log_lik
    for q in (0.0, 0.1, 0.25, 0.5):
        want = np.log(0.5 * (np.exp(dens.sum(1)) * q**flips * (1 - q) ** (13 - flips)).sum())
        assert abs(own.iloc[round(q * 1000)] - want) < 5.1e-6
        assert abs(hmm.binary_log_likelihood(y, se, (0.0, 0.05), q, np.zeros(14, int)) - want) < 1e-9
    q = queries.QUERIES["hmm_binary_fit"](spark, sf).toPandas()
    assert abs(q.log_likelihood[0] - hmm.fit_binary(y, se, (0.0, 0.05))["log_likelihood"]) < 1e-9 and len(q) == 14


def test_registered_fits_have_room_for_all_effects(spark, sf, monkeypatch):
    """The queries fit up to the operator's default number of effects."""
    seen = []
    for name in ("fit", "fit_by_region"):
        monkeypatch.setattr(FunctionalFineMapper, name, lambda self, *a, f=getattr(FunctionalFineMapper, name), **b: seen.append(self.settings.effects) or f(self, *a, **b))
    for name in ("finemap_curves", "finemap_regions", "individual_fits"):
        assert queries.QUERIES[name](spark, sf).count()
    assert seen == [fm.Settings().effects] * 3


def test_medians_at_a_threshold_merge_exactly():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 6, 40, 41):
        z = np.abs(rng.integers(-3, 4, (n, 30)).astype(float)) / 2
        for threshold in (0.0, 0.5, 0.75, 1.0):
            cut = rng.integers(0, n + 1)
            both = mo.Medians.of(z[:cut], threshold) + mo.Medians.of(z[cut:], threshold)
            assert np.array_equal(both.at_most(), np.median(z, axis=0) <= threshold)


def test_fits_mask_coefficients_of_low_median(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 3))
    y = rng.standard_normal((40, 16))
    y[:, 8:] = 0
    y[:3, 8:] = 5 * rng.standard_normal((3, 8))  # most individuals have nothing there
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(3)
    mapper = FunctionalFineMapper(effects=1, low_count=0.3)
    m = mo.moments(rows)
    scored = (y - y.mean(0)) @ fm.coefficients(m, settings=mapper.settings).T
    expected = np.median(np.abs(scored), axis=0) <= 0.3
    masked = mapper.fit(rows).state.masked
    assert 0 < expected.sum() < 13
    assert np.array_equal(masked, expected)
    assert not FunctionalFineMapper(effects=1, low_count=None).fit(rows).state.masked.any()


def test_marginal_of_own_rows_equals_numpy(spark):
    rng = np.random.default_rng(10)
    n, x = 30, rng.integers(0, 3, (30, 4)).astype(float)
    y = rng.standard_normal((n, 5))
    y[rng.random((n, 5)) < 0.3] = np.nan
    design = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(4) if x[i, j]], "id int, j int, x double")
    curves = spark.createDataFrame([(i, t, None if np.isnan(y[i, t]) else float(y[i, t])) for i in range(n) for t in range(5)], "id int, t int, y double")
    a = (x - x.mean(0)) / x.std(0, ddof=1)
    for sigma2 in (None, 2.0):
        found = {(r.j, r.t): r for r in mo.marginal_own_rows(design, curves, n, sigma2=sigma2).collect()}
        assert len(found) == 20
        for t in range(5):
            has = ~np.isnan(y[:, t])
            b = (y[has, t] - y[has, t].mean()) / y[has, t].std(ddof=1)
            for j in range(4):
                d = (a[has, j] ** 2).sum()
                slope = a[has, j] @ b / d
                error = np.sqrt((b @ b - slope**2 * d) / (has.sum() - 1) / d) if sigma2 is None else np.sqrt(sigma2 / d)
                assert found[j, t].n_own == has.sum()
                assert np.allclose([found[j, t].bhat, found[j, t].shat], [slope, error])
