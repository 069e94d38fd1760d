"""Queries that hold the numeric functions that fits use against SQL, on the driver's tables.

A fit's state has a number for each covariate and point; these queries run its functions on such a state, or on a
sequence in each task, and return what they return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import hmm, special
from ..functions import mixture as mx
from ..functions import wavelets as wv
from ..operators import moments as mo
from . import queries as q
from .queries import r6

_SCALE = "CASE WHEN t = 64 THEN 6 ELSE floor(log2(64 - t))::INTEGER END"
_WEIGHT = "CASE WHEN k = 0 THEN 1 - 0.05 * (s + 1) ELSE 0.01 * (s + 1) END"


def per_scale() -> mx.Prior:
    """One mixture for each scale, by ``reweighted`` from a common start."""
    blocks = wv.scale_blocks(64)
    start = mx.start_prior(np.array(q.SD), blocks, True)
    return start.reweighted([np.array([1 - 0.05 * (s + 1)] + [0.01 * (s + 1)] * 5) for s in range(len(blocks))])


@q.query(f"""WITH {q.LOGS}, sc AS (SELECT *, {_SCALE} AS s FROM l),
z AS (SELECT j, t, {_WEIGHT} * exp(ll) AS p, bhat * sd * sd / (sd * sd + shat * shat) AS m, sd * sd * shat * shat / (sd * sd + shat * shat) AS v FROM sc),
po AS (SELECT j, t, sum(p * m) / sum(p) AS mean, sum(p * (m * m + v)) / sum(p) AS second FROM z GROUP BY j, t)
SELECT j, t, round(mean, 6) + 0.0 AS mean, round(sqrt(greatest(0, second - mean * mean)), 6) + 0.0 AS sd FROM po""")
def state_posterior_per_scale(spark, sf_dir):
    j, bhat, shat = q.slopes(spark, sf_dir)
    mean, sd = mx.posterior(per_scale(), bhat, shat)
    return q.by_point(spark, j, mean, "mean").join(q.by_point(spark, j, sd, "sd"), ["j", "t"])


@q.query(f"WITH {q._POSTERIOR} SELECT j, t, round(mean, 6) + 0.0 AS mean, round(sqrt(greatest(0, second - mean * mean)), 6) + 0.0 AS sd FROM po")
def state_posterior(spark, sf_dir):
    j, bhat, shat = q.slopes(spark, sf_dir)
    mean, sd = mx.posterior(mx.Prior((q.PRIOR,), (np.arange(64),)), bhat, shat)
    return q.by_point(spark, j, mean, "mean").join(q.by_point(spark, j, sd, "sd"), ["j", "t"])


@q.query(f"""WITH {q.LOGS}, sc AS (SELECT *, {_SCALE} AS s FROM l),
p AS (SELECT j, t, ln(sum({_WEIGHT} * exp(ll))) - max(ll) FILTER (k = 0) AS v FROM sc GROUP BY j, t), f AS (SELECT j, sum(v) AS lbf FROM p GROUP BY j)
SELECT j, round(lbf, 6) + 0.0 AS lbf, round(exp(lbf - max(lbf) OVER ()) / sum(exp(lbf - (SELECT max(lbf) FROM f))) OVER (), 6) AS alpha, round(ln(avg(exp(lbf - (SELECT max(lbf) FROM f))) OVER ()) + max(lbf) OVER (), 6) + 0.0 AS log_mean FROM f""")
def state_log_bf_per_scale(spark, sf_dir):
    j, bhat, shat = q.slopes(spark, sf_dir)
    lbf = mx.log_bayes_factor(per_scale(), bhat, shat)
    rows = [(int(a), round(float(b), 6), round(float(c), 6), round(special.log_mean_exp(lbf), 6)) for a, b, c in zip(j, lbf, mx.softmax(lbf), strict=True)]
    return spark.createDataFrame(rows, "j int, lbf double, alpha double, log_mean double")


@q.query(f"WITH {q.LBF}, p AS (SELECT l.j, t, k, w * exp(ll) / sum(w * exp(ll)) OVER (PARTITION BY l.j, t) * alpha AS r FROM l JOIN a USING (j)) SELECT k, round((sum(r) + CASE WHEN k = 0 THEN 6.4 ELSE 0 END) / (64 + 6.4), 6) AS weight FROM p GROUP BY k")
def state_weights_step(spark, sf_dir):
    """One step for the mixture's weights with inclusion probabilities as the rows' weights and a count of 0.1 a point on the null."""
    _, bhat, shat = q.slopes(spark, sf_dir)
    prior = mx.Prior((q.PRIOR,), (np.arange(64),))
    zeta = mx.softmax(mx.log_bayes_factor(prior, bhat, shat))
    logs = mx.component_logs(q.PRIOR, bhat, shat).reshape(-1, len(q.SD))
    w, _ = mx.weights_step(np.exp(logs - logs.max(1, keepdims=True)), np.repeat(zeta, 64), np.array(q.WEIGHTS), 6.4)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(w)], "k int, weight double")


@q.query(f"""WITH {q.MARGINAL}, s AS (SELECT min(shat) / 10 AS lo, 2 * sqrt(max(bhat * bhat - shat * shat)) AS hi FROM b),
m AS (SELECT lo, hi, ceil(ln(hi / lo) / ln(sqrt(2)))::INTEGER AS n FROM s),
g AS (SELECT 0 AS k, 0.0 AS sd FROM m UNION ALL SELECT (n - i + 1)::INTEGER AS k, hi * pow(sqrt(2), -i) AS sd FROM m, range(0, 60) r(i) WHERE i <= n)
SELECT s::INTEGER AS scale, k, round(sd, 6) AS sd, round(CASE WHEN k = 0 THEN 0.8 ELSE 0.2 / (n + 1) END, 6) AS weight FROM g, m, range(0, 7) r(s)""")
def start_prior(spark, sf_dir):
    _, bhat, shat = q.slopes(spark, sf_dir)
    prior = mx.start_prior(mx.sd_grid(bhat, shat), wv.scale_blocks(64), True)
    rows = [(s, k, round(float(d), 6), round(float(w), 6)) for s, (part, _) in enumerate(prior.each()) for k, (d, w) in enumerate(zip(part.sd, part.weight, strict=True))]
    return spark.createDataFrame(rows, "scale int, k int, sd double, weight double")


@q.query(f"""WITH RECURSIVE {q.MARGINAL}, {q._FLIPS},
fw AS (SELECT j, 1 AS t, b0 / (b0 + b1) AS a0, b1 / (b0 + b1) AS a1 FROM e2 WHERE t = 1
 UNION ALL SELECT j, t, u0 / (u0 + u1), u1 / (u0 + u1) FROM (SELECT fw.j, e2.t, (a0 * 0.9 + a1 * 0.1) * b0 AS u0, (a0 * 0.1 + a1 * 0.9) * b1 AS u1 FROM fw JOIN e2 ON e2.j = fw.j AND e2.t = fw.t + 1) s),
bw AS (SELECT j, 64 AS t, 0.5::DOUBLE AS c0, 0.5::DOUBLE AS c1 FROM e2 WHERE t = 64
 UNION ALL SELECT j, t, u0 / (u0 + u1), u1 / (u0 + u1) FROM (SELECT bw.j, bw.t - 1 AS t, 0.9 * b0 * c0 + 0.1 * b1 * c1 AS u0, 0.1 * b0 * c0 + 0.9 * b1 * c1 AS u1 FROM bw JOIN e2 ON e2.j = bw.j AND e2.t = bw.t) s)
SELECT j, t, round(a1 * c1 / (a0 * c0 + a1 * c1), 6) + 0.0 AS upper FROM fw JOIN bw USING (j, t)""")
def hmm_smoothed(spark, sf_dir):
    """(j, t, upper): probability of the upper of two levels, 0 and 0.05, at a flip probability of 0.1, by the scaled and by the log recursion, which must agree."""
    b = q._marginal(spark, sf_dir)

    def run(key, part):
        part = part.sort_by("t")
        y, se = part.column("bhat").to_numpy(), part.column("shat").to_numpy()
        logs = -0.5 * np.log(2 * np.pi) - np.log(se)[:, None] - (y[:, None] - np.array([0.0, 0.05])) ** 2 / (2 * se[:, None] ** 2)
        move, start, one = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), np.zeros(len(y), int)
        scaled, logged = (hmm.forward_backward(logs, move, start, one, engine, np.ones((2, 2), bool)).gamma[:, 1] for engine in ("scaled", "log"))
        return pa.table({"j": part.column("j"), "t": part.column("t"), "upper": pa.array(np.round((scaled + logged) / 2, 6) + 0.0)})

    return b.groupBy("j").applyInArrow(run, "j int, t int, upper double")


@q.query(f"""WITH {q.MARGINAL}, s AS (SELECT j, t, CASE WHEN bhat > 0 THEN 1 ELSE 2 END AS state FROM b),
c AS (SELECT j, t, state, CASE WHEN state <> lag(state) OVER (PARTITION BY j ORDER BY t) THEN 1 ELSE 0 END AS change FROM s)
SELECT j, (1 + sum(change))::INTEGER AS steps, sum(change)::INTEGER AS changes, (SELECT 10 + sum(change) FROM c)::INTEGER AS all_steps FROM c GROUP BY j""")
def step_counts(spark, sf_dir):
    j, bhat, _ = q.slopes(spark, sf_dir)
    found = hmm.step_summary(np.where(bhat > 0, 0, 1).ravel(), np.repeat(j, bhat.shape[1]))
    return spark.createDataFrame([(int(p["sequence"]), p["steps"], p["changes"], found["step_count"]) for p in found["per_sequence"]], "j int, steps int, changes int, all_steps int")


@q.query("""WITH s AS (SELECT i, j, k FROM range(0, 5) a(i), range(0, 5) b(j), (VALUES ('full'), ('hub')) t(k)),
a AS (SELECT k, i, j, CASE WHEN i = j THEN 0.98 WHEN k = 'full' THEN 0.02 / 4 WHEN i = 0 THEN 0.02 / 4 WHEN j = 0 THEN 0.02 ELSE 0.0 END AS p FROM s)
SELECT k AS topology, i::INTEGER AS i, j::INTEGER AS j, round(p::DOUBLE, 6) AS p, round((SELECT sum(ln(p::DOUBLE)) FROM a b WHERE b.k = a.k AND b.p > 0), 6) AS penalty FROM a""")
def hmm_transitions(spark, sf_dir):
    """First transitions of five states by topology, and their log density under prior counts of 2."""
    rows = []
    for name in ("full", "hub"):
        mask = hmm.transition_mask(5, name)
        a = hmm.first_transition(mask)
        hmm.check_transition(a, mask)
        penalty = hmm.dirichlet_penalty(a, hmm.expanded_prior(2.0, 5, 5), mask)
        rows += [(name, i, k, round(float(a[i, k]), 6), round(penalty, 6)) for i in range(5) for k in range(5)]
    return spark.createDataFrame(rows, "topology string, i int, j int, p double, penalty double")


@q.query(f"""WITH {q.E}, xs AS (SELECT j, count(*)::DOUBLE AS xx FROM x GROUP BY j), ys AS (SELECT t, sum(y * y) AS yy, sum(y) AS sy FROM e GROUP BY t),
xy AS (SELECT j, t, sum(y) AS p FROM x JOIN e USING (id) GROUP BY j, t),
r AS (SELECT j, t, p / xx AS b, yy - p * p / xx AS ss, (sy - p) / n AS m, n FROM xy JOIN xs USING (j) JOIN ys USING (t), n)
SELECT j, t, round(b, 6) + 0.0 AS slope, round(sqrt((ss - n * m * m) / (n - 1) / (n - 1)), 6) AS se FROM r""")
def slopes_through_origin(spark, sf_dir):
    curves, design, n = q._e(spark, sf_dir)
    return mo.through_origin(design, curves, n).select("j", "t", r6(F.col("slope")).alias("slope"), r6(F.col("se")).alias("se"))


@q.query("""WITH d AS (SELECT DISTINCT o_custkey AS id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos FROM orders),
g AS (SELECT id, pos, pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) AS gap FROM d),
s AS (SELECT id, count(*) AS n, coalesce(max(gap) = min(gap), true) AS even FROM g GROUP BY id)
SELECT id, n::INTEGER AS n, pow(2, round(log2(n))) = n AS power, even, NOT (pow(2, round(log2(n))) = n) OR NOT even OR log2(n) > 10 AS remap FROM s""")
def position_tests(spark, sf_dir):
    """Of each customer's order days: a power of two of them, evenly spaced, to be remapped."""
    from ..sources import views

    days = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), views.days("o_orderdate").cast("double").alias("pos")).distinct()

    def run(key, part):
        pos = np.sort(part.column("pos").to_numpy())
        return pa.table({"id": [key[0].as_py()], "n": pa.array([len(pos)], pa.int32()), "power": [wv.is_power_of_two(len(pos))], "even": [wv.evenly_spaced(pos)], "remap": [wv.needs_remap(pos)]})

    return days.groupBy("id").applyInArrow(run, f"id {days.schema['id'].dataType.simpleString()}, n int, power boolean, even boolean, remap boolean")


@q.query(f"""WITH {q.MARGINAL}, p AS (SELECT j, t, bhat, (2 * t - 1) / 130.0 AS u FROM b)
SELECT j, t, round(ln(1 + exp(100 * bhat)), 6) AS log1p_exp, round(lead(bhat, 1, first) OVER (PARTITION BY j ORDER BY t), 6) + 0.0 AS shifted,
 round(back, 6) + 0.0 AS mirrored FROM (SELECT b.j, b.t, b.bhat, first_value(b.bhat) OVER (PARTITION BY b.j ORDER BY b.t) AS first, c.bhat AS back FROM b JOIN b c ON c.j = b.j AND c.t = 65 - b.t) s""")
def curve_helpers(spark, sf_dir):
    """log(1 + exp), the curve one point on, and the mirror image that follows the curve."""
    j, bhat, _ = q.slopes(spark, sf_dir)
    found = {"log1p_exp": special.log1p_exp(100 * bhat), "shifted": np.stack([wv.shifted(b) for b in bhat]), "mirrored": np.stack([wv.mirrored(b)[0][64:128] for b in bhat])}
    parts = [q.by_point(spark, j, v, k) for k, v in found.items()]
    return parts[0].join(parts[1], ["j", "t"]).join(parts[2], ["j", "t"])


_TAPS = "h(m, v) AS (VALUES " + ", ".join(f"({m}, {float(v)!r}::DOUBLE)" for m, v in enumerate(wv.filter_taps())) + ")"


@q.query(f"""WITH {q.E}, {_TAPS}, g AS (SELECT m, (CASE WHEN m % 2 = 1 THEN -1 ELSE 1 END) * (SELECT v FROM h b WHERE b.m = 19 - h.m) AS v FROM h),
c AS (SELECT i::INTEGER AS t, ((2 * (i - 1) + m) % 64 + 1)::INTEGER AS at, v FROM g, range(1, 33) r(i))
SELECT id, c.t, round(sum(v * y), 6) + 0.0 AS d FROM e JOIN c ON c.at = e.t GROUP BY id, c.t""")
def default_filter_finest(spark, sf_dir):
    """The finest details of every curve under the default filter."""
    w = wv.transform_matrix(64)[:32]
    curves, _, _ = q._e(spark, sf_dir)
    return mo.transformed(curves, w).select("id", F.col("c").alias("t"), r6(F.col("w")).alias("d"))
