"""Queries over the driver's tables, each with SQL for DuckDB where SQL can express it.

E: embeddings as curves of 64 points, labels as covariates. S, C, U: suppliers,
customers and users with binned sums. Floats are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hmm
from ..functions import wavelets as wv
from ..functions.mixture import Mixture, Prior, log_bayes_factor
from ..operators import credible as cr
from ..operators import mixture_frames as mf
from ..operators import moments as mo
from ..operators.moments import rounded as r6
from ..sources import views
from .finemap import Effect, FunctionalFineMapper, Settings, State
from .regression import FunctionalRegression

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# shared SQL

E = """e AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1))::INTEGER AS t, unnest(embedding)::DOUBLE AS y FROM embeddings WHERE label IS NOT NULL),
x AS (SELECT vec_id AS id, label::INTEGER AS j FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT count(*)::DOUBLE AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"""
MARGINAL = E + """,
xs AS (SELECT j, count(*) / max(n) AS m, sqrt((count(*) - count(*) * count(*) / max(n)) / (max(n) - 1)) AS s FROM x, n GROUP BY j),
ys AS (SELECT t, avg(y) AS m, stddev_samp(y) AS s FROM e GROUP BY t),
xy AS (SELECT j, t, sum(y) AS p FROM x JOIN e USING (id) GROUP BY j, t),
b AS (SELECT j, t, (p - n * xs.m * ys.m) / (xs.s * ys.s) / (n - 1) AS bhat, sqrt(1 / (n - 1)) AS shat FROM xy JOIN xs USING (j) JOIN ys USING (t), n)"""
SD, WEIGHTS = [0.0, 0.02, 0.04, 0.08, 0.16, 0.32], [0.8, 0.04, 0.04, 0.04, 0.04, 0.04]
PRIOR = Mixture(np.array(SD), np.array(WEIGHTS))
SQL_PRIOR = "g(k, sd, w) AS (VALUES " + ", ".join(f"({k}, {s}::DOUBLE, {w}::DOUBLE)" for k, (s, w) in enumerate(zip(SD, WEIGHTS, strict=True))) + ")"
LOGS = MARGINAL + ", " + SQL_PRIOR + """,
l AS (SELECT j, t, k, w, sd, bhat, shat, -0.5 * ln(2 * pi()) - 0.5 * ln(sd * sd + shat * shat) - bhat * bhat / (2 * (sd * sd + shat * shat)) AS ll FROM b, g)"""
LBF = LOGS + """,
lt AS (SELECT j, t, ln(sum(w * exp(ll))) - max(ll) FILTER (k = 0) AS v FROM l GROUP BY j, t),
f AS (SELECT j, sum(v) AS lbf FROM lt GROUP BY j),
a AS (SELECT j, lbf, exp(lbf - max(lbf) OVER ()) / sum(exp(lbf - (SELECT max(lbf) FROM f))) OVER () AS alpha FROM f)"""
# a second and third effect: the same factors under other prior weights, so that several sets exist
THREE = LBF + """,
eff AS (SELECT m.effect, j, lbf * m.c AS lbf, exp(lbf * m.c - max(lbf * m.c) OVER w) AS u FROM f, (VALUES (1, 1.0::DOUBLE), (2, 0.5::DOUBLE), (3, -0.25::DOUBLE)) m(effect, c) WINDOW w AS (PARTITION BY m.effect)),
al AS (SELECT effect, j, lbf, u / sum(u) OVER (PARTITION BY effect) AS alpha FROM eff),
cs AS (SELECT effect, j, alpha, row_number() OVER w AS place, coalesce(sum(alpha) OVER (PARTITION BY effect ORDER BY alpha DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM al WINDOW w AS (PARTITION BY effect ORDER BY alpha DESC, j)),
cset AS (SELECT effect, j, place, alpha FROM cs WHERE before <= 0.8)"""
CORR = """,
r AS (SELECT p.j, q.j AS k, CASE WHEN p.j = q.j THEN 1.0 ELSE -p.m * q.m * n / (n - 1) / (p.s * q.s) END AS r FROM xs p, xs q, n)"""


def _e(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    curves, design = views.embedding_curves(spark, sf_dir)
    return curves, design, views.table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").count()


def _marginal(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    curves, design, n = _e(spark, sf_dir)
    return mo.marginal(design, curves, n, **({"sigma2": 1.0} | options))


def slopes(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covariates, slopes, standard errors) as the state of a fit holds them: covariates x points."""
    rows = _marginal(spark, sf_dir).toPandas().sort_values(["j", "t"])
    j = np.unique(rows["j"])
    return j, *(rows[c].to_numpy().reshape(len(j), -1) for c in ("bhat", "shat"))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.log_bayes_factors(_marginal(spark, sf_dir), PRIOR)


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = _factors(spark, sf_dir)
    scaled = factors.withColumn("e", F.explode(F.array(*(F.struct(F.lit(k).alias("effect"), F.lit(c).alias("c")) for k, c in ((1, 1.0), (2, 0.5), (3, -0.25))))))
    return cr.softmax(scaled.select("e.effect", "j", (F.col("lbf") * F.col("e.c")).alias("lbf")), ["effect"])


def _correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one-hot covariates, from their counts."""
    _, design, n = _e(spark, sf_dir)
    s = mo.varying(design, n).where("kept")
    a, b = (s.select(F.col("j").alias(k), F.col("mean").alias(f"m{k}"), F.sqrt("var").alias(f"s{k}")) for k in ("j", "k"))
    same = F.col("j") == F.col("k")
    return a.join(b, F.lit(True)).select("j", "k", F.when(same, 1.0).otherwise(-F.col("mj") * F.col("mk") * n / (n - 1) / (F.col("sj") * F.col("sk"))).alias("r"))


# input preparation

def _bins_sql(table: str, key: str, ids: str, day: str, value: str, bins: int, unit: str) -> str:
    pos = f"date_diff('day', DATE '1970-01-01', {day}::DATE)::DOUBLE" if unit == "day" else f"floor(epoch({day}))::DOUBLE"
    return f"""WITH p AS (SELECT {key} AS id, {pos} AS pos, {value} AS v FROM {table}),
s AS (SELECT min(pos) AS lo, (max(pos) - min(pos)) / {bins} AS w FROM p),
b AS (SELECT id, least(floor((pos - lo) / w), {bins - 1})::INTEGER + 1 AS t, sum(v) AS y FROM p, s GROUP BY ALL),
g AS (SELECT id, t::INTEGER AS t FROM ({ids}) i, range(1, {bins + 1}) r(t))
SELECT id, t, round(coalesce(y, 0), 6) + 0.0 AS y FROM g LEFT JOIN b USING (id, t)"""


@query(_bins_sql("lineitem", "l_suppkey", "SELECT s_suppkey AS id FROM supplier", "l_shipdate", "l_extendedprice * (1 - l_discount)", 64, "day"))
def curve_bins_supplier(spark, sf_dir):
    return views.supplier_curves(spark, sf_dir)[0].select("id", "t", r6(F.col("y")).alias("y"))


@query(_bins_sql("orders", "o_custkey", "SELECT c_custkey AS id FROM customer", "o_orderdate", "o_totalprice", 32, "day"))
def curve_bins_customer(spark, sf_dir):
    return views.customer_curves(spark, sf_dir)[0].select("id", "t", r6(F.col("y")).alias("y"))


@query(_bins_sql("events", "user_id", "SELECT DISTINCT user_id AS id FROM events", "ts", "value", 32, "second"))
def curve_bins_user(spark, sf_dir):
    return views.user_curves(spark, sf_dir)[0].select("id", "t", r6(F.col("y")).alias("y"))


@query(f"WITH {E} SELECT id, t, round((y - avg(y) OVER w) / CASE WHEN stddev_samp(y) OVER w > 0 THEN stddev_samp(y) OVER w ELSE 1 END, 6) + 0.0 AS y FROM e WINDOW w AS (PARTITION BY t)")
def col_scale_embeddings(spark, sf_dir):
    return mo.standardised(_e(spark, sf_dir)[0], "t", "y").select("id", "t", r6(F.col("y")).alias("y"))


@query("""WITH c AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS j, count(*)::DOUBLE AS x FROM events GROUP BY ALL),
n AS (SELECT count(DISTINCT user_id)::DOUBLE AS n FROM events)
SELECT j::INTEGER AS j, count(*) AS n_nonzero, round(sum(x) / max(n), 6) AS mean, round((sum(x * x) - sum(x) * sum(x) / max(n)) / (max(n) - 1), 6) + 0.0 AS var, (sum(x * x) - sum(x) * sum(x) / max(n)) / (max(n) - 1) > 1e-12 AS kept FROM c, n GROUP BY j""")
def constant_columns(spark, sf_dir):
    _, design = views.user_curves(spark, sf_dir)
    n = views.table(spark, sf_dir, "events").select("user_id").distinct().count()
    return mo.varying(design, n).select("j", "n_nonzero", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"), "kept")


@query(f"WITH {E} SELECT t, round(median(abs(y)), 6) AS median FROM e GROUP BY t HAVING median(abs(y)) <= 0.08")
def lowcount_mask(spark, sf_dir):
    return mo.low_count(_e(spark, sf_dir)[0], 0.08).select("t", r6(F.col("median")).alias("median"))


@query(f"WITH {E} SELECT id, t, row_number() OVER (PARTITION BY t ORDER BY y, id)::INTEGER AS rank, round((row_number() OVER (PARTITION BY t ORDER BY y, id) - 0.5) / count(*) OVER (PARTITION BY t), 6) AS plotting FROM e")
def normal_scores_rank(spark, sf_dir):
    return mo.normal_score_ranks(_e(spark, sf_dir)[0]).select("id", "t", "rank", r6(F.col("plotting")).alias("plotting"))


@query()
def normal_scores(spark, sf_dir):
    return mo.normal_scores(_e(spark, sf_dir)[0])


# marginal regression

@query(f"WITH {MARGINAL} SELECT j, t, round(bhat, 6) + 0.0 AS bhat FROM b")
def marginal_slope(spark, sf_dir):
    return _marginal(spark, sf_dir).select("j", "t", r6(F.col("bhat")).alias("bhat"))


@query(f"WITH {MARGINAL} SELECT j, t, round(sqrt(0.7 / (n - 1)), 6) AS shat FROM b, n")
def marginal_se_fixed(spark, sf_dir):
    return _marginal(spark, sf_dir, sigma2=0.7).select("j", "t", r6(F.col("shat")).alias("shat"))


@query(f"WITH {MARGINAL} SELECT j, t, round(sqrt(((n - 1) - bhat * bhat * (n - 1)) / (n - 1) / (n - 1)), 6) AS shat FROM b, n")
def marginal_se_marginal(spark, sf_dir):
    return _marginal(spark, sf_dir, sigma2=None).select("j", "t", r6(F.col("shat")).alias("shat"))


_SUBSET = MARGINAL.replace("FROM embeddings)", "FROM embeddings WHERE embedding[1] > 0)").replace("FROM embeddings WHERE label", "FROM embeddings WHERE embedding[1] > 0 AND label")


@query(f"WITH {_SUBSET} SELECT j, t, round(bhat, 6) + 0.0 AS bhat FROM b")
def marginal_subset(spark, sf_dir):
    """The operator's own feature: a regression on a stated subset of individuals, those whose first point is positive (a semi-join)."""
    curves, design, _ = _e(spark, sf_dir)
    part = views.table(spark, sf_dir, "embeddings").where("embedding[0] > 0 AND label IS NOT NULL").select(F.col("vec_id").alias("id"))
    return mo.marginal(design.join(part, "id", "left_semi"), curves.join(part, "id", "left_semi"), part.count(), sigma2=1.0).select("j", "t", r6(F.col("bhat")).alias("bhat"))


@query(f"""WITH {MARGINAL}, o AS (SELECT id, t, y FROM e WHERE abs(y) <= 0.25),
yo AS (SELECT t, count(*)::DOUBLE AS n, avg(y) AS m, stddev_samp(y) AS s FROM o GROUP BY t),
cells AS (SELECT k.j, o.t, ((CASE WHEN x.j = k.j THEN 1.0 ELSE 0.0 END) - k.m) / k.s AS a, (o.y - yo.m) / yo.s AS b, yo.n FROM o JOIN yo USING (t) JOIN x USING (id), (SELECT j, m, s FROM xs) k),
f AS (SELECT j, t, n, sum(a * a) AS d, sum(a * b) / sum(a * a) AS bhat, sum(b * b) AS ss FROM cells GROUP BY j, t, n)
SELECT j, t, n::BIGINT AS n_own, round(bhat, 6) + 0.0 AS bhat, round(sqrt(greatest(0, ss - bhat * bhat * d) / (n - 1) / d), 6) AS shat FROM f""")
def marginal_subset_per_response(spark, sf_dir):
    """Each response has its own individuals: those without an outlying value there."""
    curves, design, n = _e(spark, sf_dir)
    own = mo.marginal_own_rows(design, curves.where("abs(y) <= 0.25"), n)
    return own.select("j", "t", "n_own", r6(F.col("bhat")).alias("bhat"), r6(F.col("shat")).alias("shat"))


# wavelets

_HAAR = E + """,
lv AS (SELECT s::INTEGER AS s, (1 << s)::INTEGER AS w FROM range(1, 7) r(s)),
d AS (SELECT id, s, (t - 1) // w AS k, sum(CASE WHEN (t - 1) % w < w // 2 THEN y ELSE -y END) / sqrt(w) AS v FROM e, lv GROUP BY id, s, w, (t - 1) // w),
co AS (SELECT id, (64 - (64 >> (s - 1)) + k + 1)::INTEGER AS c, 6 - s AS scale, v FROM d UNION ALL SELECT id, 64, 6, sum(y) / 8 FROM e GROUP BY id)"""


@query(f"WITH {_HAAR} SELECT id, c, round(v, 6) + 0.0 AS w FROM co")
def haar_dwt(spark, sf_dir):
    return mo.transformed(_e(spark, sf_dir)[0], wv.haar_matrix(64)).select("id", "c", r6(F.col("w")).alias("w"))


@query(f"WITH {E} SELECT id, t, round(y, 6) + 0.0 AS y FROM e")
def haar_inverse(spark, sf_dir):
    """The transform and back, which is the identity."""
    w = wv.haar_matrix(64)
    there = mo.transformed(_e(spark, sf_dir)[0], w).select("id", F.col("c").alias("t"), F.col("w").alias("y"))
    return mo.transformed(there, w.T).select("id", F.col("c").alias("t"), r6(F.col("w")).alias("y"))


@query(f"WITH {_HAAR} SELECT scale::INTEGER AS scale, count(*) AS n, round(sum(v * v), 6) AS energy FROM co GROUP BY scale")
def haar_energy_by_scale(spark, sf_dir):
    scales = spark.createDataFrame(pa.table({"c": pa.array(np.arange(1, 65), pa.int32()), "scale": pa.array(wv.scales(64), pa.int32())}))
    found = mo.transformed(_e(spark, sf_dir)[0], wv.haar_matrix(64)).join(F.broadcast(scales), "c")
    return found.groupBy("scale").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("w") ** 2)).alias("energy"))


@query("SELECT c::INTEGER AS c, CASE WHEN c = 64 THEN 6 ELSE floor(log2(64 - c))::INTEGER END AS scale FROM range(1, 65) r(c)")
def coefficient_index(spark, sf_dir):
    return spark.createDataFrame(pa.table({"c": pa.array(np.arange(1, 65), pa.int32()), "scale": pa.array(wv.scales(64), pa.int32())}))


@query(f"""WITH {E}, p AS (SELECT id, (t * t)::DOUBLE AS pos, y FROM e),
q AS (SELECT id, pos, y, lead(pos) OVER w AS npos, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT k::INTEGER + 1 AS c, 1 + (k + 0.5) / 64 * 4095 AS spot FROM range(0, 64) r(k))
SELECT id, c, round(y + (spot - pos) / (npos - pos) * (ny - y), 6) + 0.0 AS w FROM g JOIN q ON spot >= pos AND spot < npos""")
def dyadic_interpolation(spark, sf_dir):
    """Curves observed at 64 irregular positions, the squares, on 64 regular ones."""
    _, a = wv.interpolation(np.arange(1, 65, dtype=float) ** 2)
    curves = _e(spark, sf_dir)[0]
    return mo.transformed(curves, a).select("id", "c", r6(F.col("w")).alias("w"))


@query(f"WITH {MARGINAL}, s AS (SELECT j, t, bhat * bhat + 0.1 AS shat, CASE WHEN t = 64 THEN 6 ELSE floor(log2(64 - t)) END AS scale FROM b) SELECT j, t, round(avg(shat) OVER (PARTITION BY j, scale), 6) AS shat FROM s")
def shat_scale_average(spark, sf_dir):
    rows = _marginal(spark, sf_dir).select("j", "t", (F.col("bhat") ** 2 + 0.1).alias("shat"))
    scales = spark.createDataFrame(pa.table({"t": pa.array(np.arange(1, 65), pa.int32()), "scale": pa.array(wv.scales(64), pa.int32())}))
    return mo.scale_mean_se(rows, scales).select("j", "t", r6(F.col("shat")).alias("shat"))


# grids and mixtures

@query(f"""WITH {MARGINAL}, s AS (SELECT min(shat) / 10 AS lo, 2 * sqrt(max(bhat * bhat - shat * shat)) AS hi FROM b),
m AS (SELECT lo, hi, ceil(ln(hi / lo) / ln(sqrt(2)))::INTEGER AS n FROM s)
SELECT 0 AS k, 0.0 AS sd UNION ALL SELECT (n - i + 1)::INTEGER AS k, round(hi * pow(sqrt(2), -i), 6) AS sd FROM m, range(0, 60) r(i) WHERE i <= n""")
def sigma_grid(spark, sf_dir):
    _, bhat, shat = slopes(spark, sf_dir)
    sd = hmm.sigma_grid(bhat.ravel(), shat.ravel())
    return spark.createDataFrame(pa.table({"k": pa.array(np.arange(len(sd)), pa.int32()), "sd": pa.array(np.round(sd, 6))}))


@query(f"""WITH {MARGINAL}, s AS (SELECT 3 * max(abs(bhat)) AS top FROM b),
h AS (SELECT i, top * pow(i / 50.0, 3) AS m FROM s, range(1, 51) r(i))
SELECT 1 AS k, 0.0 AS mu UNION ALL SELECT (1 + i)::INTEGER, round(m, 6) FROM h UNION ALL SELECT (51 + i)::INTEGER, round(-m, 6) FROM h""")
def mu_grid(spark, sf_dir):
    mu = hmm.mean_grid(slopes(spark, sf_dir)[1].ravel())
    return spark.createDataFrame(pa.table({"k": pa.array(np.arange(1, len(mu) + 1), pa.int32()), "mu": pa.array(np.round(mu, 6))}))


@query(f"WITH {LOGS} SELECT j, t, k, round(ll, 6) + 0.0 AS log_lik FROM l")
def mixture_loglik(spark, sf_dir):
    return mf.component_table(_marginal(spark, sf_dir), PRIOR).select("j", "t", "k", r6(F.col("log_lik")).alias("log_lik"))


@query(f"WITH {LBF} SELECT j, round(lbf, 6) + 0.0 AS lbf FROM f")
def log_bf_single(spark, sf_dir):
    return _factors(spark, sf_dir).select("j", r6(F.col("lbf")).alias("lbf"))


_PER_SCALE = {s: Mixture(np.array(SD), np.array([1 - 0.05 * (s + 1)] + [0.01 * (s + 1)] * 5)) for s in range(7)}


@query(f"""WITH {LOGS}, sc AS (SELECT *, CASE WHEN t = 64 THEN 6 ELSE floor(log2(64 - t))::INTEGER END AS s FROM l),
p AS (SELECT j, t, ln(sum(CASE WHEN k = 0 THEN 1 - 0.05 * (s + 1) ELSE 0.01 * (s + 1) END * exp(ll))) - max(ll) FILTER (k = 0) AS v FROM sc GROUP BY j, t)
SELECT j, round(sum(v), 6) + 0.0 AS lbf FROM p GROUP BY j""")
def log_bf_per_scale(spark, sf_dir):
    scales = spark.createDataFrame(pa.table({"t": pa.array(np.arange(1, 65), pa.int32()), "scale": pa.array(wv.scales(64), pa.int32())}))
    rows = _marginal(spark, sf_dir).join(F.broadcast(scales), "t")
    return mf.log_bayes_factors(rows, _PER_SCALE).select("j", r6(F.col("lbf")).alias("lbf"))


@query(f"WITH {LBF} SELECT j, round(alpha, 6) AS alpha FROM a")
def softmax_alpha(spark, sf_dir):
    return cr.softmax(_factors(spark, sf_dir)).select("j", r6(F.col("alpha")).alias("alpha"))


_POSTERIOR = LOGS + """,
z AS (SELECT j, t, w * exp(ll) AS p, bhat * sd * sd / (sd * sd + shat * shat) AS m, sd * sd * shat * shat / (sd * sd + shat * shat) AS v, k FROM l),
po AS (SELECT j, t, sum(p * m) / sum(p) AS mean, sum(p * (m * m + v)) / sum(p) AS second, sum(p) FILTER (k = 0) / sum(p) AS nul FROM z GROUP BY j, t)"""


@query(f"WITH {_POSTERIOR} SELECT j, t, round(mean, 6) + 0.0 AS mean FROM po")
def posterior_mean(spark, sf_dir):
    return mf.posterior_moments(_marginal(spark, sf_dir), PRIOR).select("j", "t", r6(F.col("mean")).alias("mean"))


@query(f"WITH {_POSTERIOR} SELECT j, t, round(sqrt(greatest(0, second - mean * mean)), 6) AS sd FROM po")
def posterior_sd(spark, sf_dir):
    return mf.posterior_moments(_marginal(spark, sf_dir), PRIOR).select("j", "t", r6(F.col("sd")).alias("sd"))


@query(f"""WITH {_POSTERIOR} SELECT j, t, round(nul, 6) AS "null" FROM po""")
def posterior_null_prob(spark, sf_dir):
    return mf.posterior_moments(_marginal(spark, sf_dir), PRIOR).select("j", "t", r6(F.col("null")).alias("null"))


@query(f"WITH {LBF}, q AS (SELECT l.j, t, k, w * exp(ll) / sum(w * exp(ll)) OVER (PARTITION BY l.j, t) * alpha AS r FROM l JOIN a USING (j)) SELECT k, round(sum(r) / sum(sum(r)) OVER (), 6) AS weight FROM q GROUP BY k")
def em_weights_one_step(spark, sf_dir):
    rows = _marginal(spark, sf_dir)
    zeta = cr.softmax(mf.log_bayes_factors(rows, PRIOR)).select("j", F.col("alpha").alias("zeta"))
    return mf.weights_step(rows, zeta, PRIOR).select("k", r6(F.col("weight")).alias("weight"))


# effects and credible sets

@query(f"WITH {THREE} SELECT j, round(1 - exp(sum(ln(1 - alpha))), 6) AS pip FROM al GROUP BY j")
def pip(spark, sf_dir):
    return cr.pip(_three(spark, sf_dir)).select("j", r6(F.col("pip")).alias("pip"))


@query(f"WITH {THREE} SELECT effect, j, place::INTEGER AS place, round(alpha, 6) AS alpha FROM cset")
def credible_sets(spark, sf_dir):
    return cr.credible_sets(_three(spark, sf_dir), 0.8).select("effect", "j", "place", r6(F.col("alpha")).alias("alpha"))


@query(f"""WITH {THREE}{CORR}, pu AS (SELECT p.effect, min(abs(r)) AS purity FROM cset p JOIN cset q ON p.effect = q.effect AND p.j < q.j JOIN r ON r.j = p.j AND r.k = q.j GROUP BY p.effect)
SELECT effect, count(*) AS size, round(coalesce(max(purity), 1), 6) AS purity FROM cset LEFT JOIN pu USING (effect) GROUP BY effect""")
def cs_purity(spark, sf_dir):
    return cr.purity(cr.credible_sets(_three(spark, sf_dir), 0.8), _correlations(spark, sf_dir)).select("effect", "size", r6(F.col("purity")).alias("purity"))


@query(f"""WITH {THREE}{CORR}, pu AS (SELECT p.effect, min(abs(r)) AS purity FROM cset p JOIN cset q ON p.effect = q.effect AND p.j < q.j JOIN r ON r.j = p.j AND r.k = q.j GROUP BY p.effect),
su AS (SELECT effect, count(*) AS size, coalesce(max(purity), 1) AS purity FROM cset LEFT JOIN pu USING (effect) GROUP BY effect)
SELECT effect, size, size > 1 AND purity < 0.5 AND (SELECT max(lbf) FROM al WHERE al.effect = su.effect) < 0.1 AS dummy FROM su""")
def cs_dummy(spark, sf_dir):
    effects = _three(spark, sf_dir)
    summary = cr.purity(cr.credible_sets(effects, 0.8), _correlations(spark, sf_dir)).join(effects.groupBy("effect").agg(F.max("lbf").alias("max_lbf")), "effect")
    return cr.dummies(summary).select("effect", "size", "dummy")


_REL = THREE + """,
m AS (SELECT effect, list(j) AS s FROM cset GROUP BY effect),
rel AS (SELECT p.effect AS a, q.effect AS b, CASE WHEN list_has_all(q.s, p.s) AND list_has_all(p.s, q.s) THEN 'identical' WHEN list_has_all(q.s, p.s) THEN 'a_in_b' WHEN list_has_all(p.s, q.s) THEN 'b_in_a' ELSE 'none' END AS relation FROM m p JOIN m q ON p.effect < q.effect)"""


@query(f"WITH {_REL} SELECT * FROM rel")
def cs_relations(spark, sf_dir):
    return cr.relations(cr.credible_sets(_three(spark, sf_dir), 0.8))


@query(f"""WITH {_REL}, i AS (SELECT effect, count(*) AS size, (SELECT max(lbf) FROM al WHERE al.effect = cset.effect) AS top FROM cset GROUP BY effect)
SELECT a, b, CASE WHEN p.size < q.size OR (p.size = q.size AND p.top >= q.top) THEN a ELSE b END AS keep FROM rel JOIN i p ON p.effect = a JOIN i q ON q.effect = b WHERE relation <> 'none'""")
def cs_merge_choice(spark, sf_dir):
    effects = _three(spark, sf_dir)
    return cr.merge_choice(cr.credible_sets(effects, 0.8), effects.groupBy("effect").agg(F.max("lbf").alias("max_lbf")))


@query(f"""WITH {THREE}{CORR} SELECT p.effect AS a, q.effect AS b, round(max(r), 6) + 0.0 AS r, round(max(abs(r)), 6) AS abs_r FROM cset p JOIN cset q ON p.effect < q.effect JOIN r ON r.j = p.j AND r.k = q.j GROUP BY ALL""")
def cs_correlation(spark, sf_dir):
    return cr.set_correlation(cr.credible_sets(_three(spark, sf_dir), 0.8), _correlations(spark, sf_dir)).select("a", "b", r6(F.col("r")).alias("r"), r6(F.col("abs_r")).alias("abs_r"))


# residuals and objective, given fixed effects

_FIXED = MARGINAL + """,
fx AS (SELECT j, t, (j + 1) / 55.0 * bhat AS f FROM b)""" + CORR


def fixed_state(spark: SparkSession, sf_dir: str, *, points: bool) -> tuple[np.ndarray, State]:
    """The fit's state with effects set: one effect over all covariates, or one for each (a point), then one without an effect."""
    j, bhat, _ = slopes(spark, sf_dir)
    n = _e(spark, sf_dir)[2]
    r = _correlations(spark, sf_dir).toPandas().pivot(index="j", columns="k", values="r").loc[j, j].to_numpy()
    p, t = bhat.shape
    prior = Prior((PRIOR,), (np.arange(t),))
    state = State(r * (n - 1), bhat * (n - 1), float(t * (n - 1)), n, np.zeros(t, bool), Settings(), prior, 1.0)
    share, none = (j + 1) / 55.0, np.zeros((p, t))
    if points:
        state.effects = [Effect(np.eye(p)[i], share[i] * bhat, none, np.zeros(p), prior) for i in range(p)]
    else:
        state.effects = [Effect(share, bhat, none, log_bayes_factor(prior, bhat, np.full((p, t), (n - 1) ** -0.5)), prior)]
    state.effects.append(Effect(np.full(p, 1 / p), none, none, np.zeros(p), prior))
    return j, state


def by_point(spark: SparkSession, j: np.ndarray, matrix: np.ndarray, name: str) -> DataFrame:
    """(j, t, name) of a matrix of covariates x points."""
    t = matrix.shape[1]
    return spark.createDataFrame(pa.table({"j": pa.array(np.repeat(j, t), pa.int32()), "t": pa.array(np.tile(np.arange(1, t + 1), len(j)), pa.int32()), name: pa.array(np.round(matrix.ravel(), 6) + 0.0)}))


@query(f"WITH {_FIXED}, xf AS (SELECT r.j, t, sum(r * f) AS v FROM r JOIN fx ON fx.j = r.k GROUP BY ALL) SELECT b.j, b.t, round(bhat - v, 6) + 0.0 AS partial FROM b JOIN xf ON b.j = xf.j AND b.t = xf.t")
def partial_residual(spark, sf_dir):
    j, state = fixed_state(spark, sf_dir, points=False)
    return by_point(spark, j, state.residual(1) / state.d[:, None], "partial")


_ER2 = f"WITH {_FIXED}, xf AS (SELECT r.j, t, sum(r * f) AS v FROM r JOIN fx ON fx.j = r.k GROUP BY ALL), q AS (SELECT sum(-2 * fx.f * bhat + fx.f * v) AS s FROM fx JOIN xf ON fx.j = xf.j AND fx.t = xf.t JOIN b ON b.j = fx.j AND b.t = fx.t), er AS (SELECT (64 + s) * (n - 1) AS er2 FROM q, n)"


@query(_ER2 + " SELECT round(er2, 4) AS er2 FROM er")
def er2(spark, sf_dir):
    """||Y - X F||**2 from second moments only."""
    _, state = fixed_state(spark, sf_dir, points=True)
    return spark.createDataFrame([(round(state.squared_error(), 4),)], "er2 double")


@query(_ER2 + " SELECT round(er2 / (n * 64), 6) AS sigma2, round(-n * 64 / 2 * (ln(2 * pi()) + ln(er2 / (n * 64))) - n * 64 / 2, 3) AS log_likelihood FROM er, n")
def elbo_terms(spark, sf_dir):
    _, state = fixed_state(spark, sf_dir, points=True)
    state.sigma2 = state.squared_error() / state.cells()
    return spark.createDataFrame([(round(state.sigma2, 6), round(state.log_likelihood(), 3))], "sigma2 double, log_likelihood double")


_OBJECTIVE = f"""WITH {LBF}, c AS (SELECT (n - 1) * sum((j + 1) / 55.0 * bhat * bhat) AS fit, max(n) AS n FROM b, n GROUP BY n),
k AS (SELECT fit, n, ln((SELECT avg(exp(lbf - (SELECT max(lbf) FROM f))) FROM f)) + (SELECT max(lbf) FROM f) AS mean_bf, -n * 64 / 2 * ln(2 * pi()) AS base, 64 * (n - 1) AS yy FROM c)"""


@query(_OBJECTIVE + " SELECT round(fit / 2 - mean_bf, 4) AS divergence, round(base - (yy - fit) / 2 - fit / 2 + mean_bf, 4) AS objective, round(base - yy / 2 + mean_bf, 4) AS marginal, round(base - (yy - fit) / 2, 4) AS expected FROM k")
def objective_terms(spark, sf_dir):
    """One effect at error variance 1: its divergence from the prior, the objective, the marginal and the expected likelihood."""
    _, state = fixed_state(spark, sf_dir, points=False)
    state.effects = state.effects[:1]
    values = (state.divergence(0), state.objective(), state.marginal_log_likelihood(0), state.expected_log_likelihood(0))
    return spark.createDataFrame([tuple(round(v, 4) for v in values)], "divergence double, objective double, marginal double, expected double")


# curves of effects, regions, segments

@query(f"""WITH {MARGINAL}, h AS (SELECT j AS effect, t, t - row_number() OVER (PARTITION BY j ORDER BY t) AS run FROM b WHERE abs(bhat) > 1.5 * shat)
SELECT effect, min(t)::INTEGER AS start, max(t)::INTEGER AS "end", count(*) AS length FROM h GROUP BY effect, run""")
def affected_regions(spark, sf_dir):
    b = _marginal(spark, sf_dir)
    curves = b.select(F.col("j").alias("effect"), "t", (F.col("bhat") - 1.5 * F.col("shat")).alias("low"), (F.col("bhat") + 1.5 * F.col("shat")).alias("up"))
    return cr.affected_regions(curves)


@query(f"""WITH {MARGINAL}, s AS (SELECT j AS seq, t, CASE WHEN bhat > 0 THEN 1 ELSE 2 END AS state FROM b),
h AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY t) - row_number() OVER (PARTITION BY seq, state ORDER BY t) AS run FROM s)
SELECT seq, state, min(t)::INTEGER AS start, max(t)::INTEGER AS "end", count(*) AS length FROM h GROUP BY seq, state, run""")
def segments(spark, sf_dir):
    return cr.state_segments(_marginal(spark, sf_dir).select(F.col("j").alias("seq"), "t", F.when(F.col("bhat") > 0, 1).otherwise(2).alias("state")))


@query(f"WITH {E} SELECT id, t, round(y - avg(y) OVER (PARTITION BY j, t), 6) + 0.0 AS y FROM e JOIN x USING (id)")
def adjusted_curves(spark, sf_dir):
    """Least squares on one-hot covariates: effects are the groups' means."""
    curves, design, _ = _e(spark, sf_dir)
    effects = design.join(curves, "id").groupBy("j", "t").agg(F.avg("y").alias("f"))
    return mo.adjusted(curves, design, effects).select("id", "t", r6(F.col("y")).alias("y"))


@query(f"""WITH {LBF}, tw AS (SELECT j, lbf AS l1, lbf * 0.5 + j / 10.0 AS l2 FROM f),
m AS (SELECT max(l1) AS m1, max(l2) AS m2 FROM tw),
e1 AS (SELECT max(m1) AS m1, max(m2) AS m2, sum(exp(l1 - m1)) AS s1, sum(exp(l2 - m2)) AS s2, sum(exp(l1 - m1 + l2 - m2)) AS s12 FROM tw, m),
h AS (SELECT 0 AS h, 0.0::DOUBLE AS v UNION ALL SELECT 1, ln(1e-4) + m1 + ln(s1) FROM e1 UNION ALL SELECT 2, ln(1e-4) + m2 + ln(s2) FROM e1
 UNION ALL SELECT 3, 2 * ln(1e-4) + m1 + m2 + ln(greatest(s1 * s2 - s12, 1e-300)) FROM e1 UNION ALL SELECT 4, ln(1e-5) + m1 + m2 + ln(s12) FROM e1)
SELECT h, round(exp(v - (SELECT max(v) FROM h)) / sum(exp(v - (SELECT max(v) FROM h))) OVER (), 6) AS posterior FROM h""")
def coloc_bf(spark, sf_dir):
    first = _factors(spark, sf_dir)
    second = first.select("j", (F.col("lbf") * 0.5 + F.col("j") / 10.0).alias("lbf"))
    return cr.colocalised(first, second).select("h", r6(F.col("posterior")).alias("posterior"))


# hidden Markov

@query(f"""WITH {MARGINAL}, mu(k, m) AS (VALUES (0, 0.0::DOUBLE), (1, 0.03::DOUBLE), (2, -0.03::DOUBLE), (3, 0.2::DOUBLE)),
w AS (SELECT j, t, k, exp(-(bhat - m) * (bhat - m) / (2 * shat * shat)) AS u FROM b, mu),
q AS (SELECT k, u / sum(u) OVER (PARTITION BY j, t) AS p FROM w)
SELECT k, round(sum(p), 5) AS n FROM q GROUP BY k""")
def hmm_prefilter(spark, sf_dir):
    """Expected points of each candidate centre, were points independent."""
    _, bhat, shat = slopes(spark, sf_dir)
    n = hmm.screen_counts(bhat.ravel(), shat.ravel(), np.array([0.0, 0.03, -0.03, 0.2]))
    return spark.createDataFrame(pa.table({"k": pa.array(np.arange(4), pa.int32()), "n": pa.array(np.round(n, 5))}))


_FLIPS = """o AS (SELECT j, t, -0.5 * ln(2 * pi()) - ln(shat) - bhat * bhat / (2 * shat * shat) AS l0, -0.5 * ln(2 * pi()) - ln(shat) - (bhat - 0.05) * (bhat - 0.05) / (2 * shat * shat) AS l1 FROM b),
e2 AS (SELECT j, t, greatest(l0, l1) AS top, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM o)"""


@query(f"""WITH RECURSIVE {MARGINAL}, {_FLIPS},
g AS (SELECT i / 1000.0::DOUBLE AS q FROM range(0, 501) r(i)),
fw AS (SELECT j, q, 1 AS t, b0 / (b0 + b1) AS a0, b1 / (b0 + b1) AS a1, top + ln(0.5 * (b0 + b1)) AS v FROM e2, g WHERE t = 1
 UNION ALL SELECT j, q, t, u0 / (u0 + u1), u1 / (u0 + u1), v + ln(u0 + u1) FROM
  (SELECT fw.j, q, e2.t, v + top AS v, (a0 * (1 - q) + a1 * q) * b0 AS u0, (a0 * q + a1 * (1 - q)) * b1 AS u1 FROM fw JOIN e2 ON e2.j = fw.j AND e2.t = fw.t + 1) s)
SELECT j, round(q, 3) AS q, round(v, 5) + 0.0 AS log_lik FROM fw WHERE t = 64""")
def hmm_binary_loglik(spark, sf_dir):
    """(j, q, log_lik): the likelihood of all 64 points of each slope curve, two levels, 0 and 0.05, at each of ``hmm.fit_binary``'s 501 flip probabilities."""
    b = _marginal(spark, sf_dir)

    def run(key, part):
        part = part.sort_by("t")
        y, se = part.column("bhat").to_numpy(), part.column("shat").to_numpy()
        q = np.linspace(0, 0.5, 501)
        levels = [hmm.binary_log_likelihood(y, se, (0.0, 0.05), v, np.zeros(len(y), int)) for v in q]
        return pa.table({"j": pa.array(np.full(len(q), part.column("j")[0].as_py()), pa.int32()), "q": pa.array(q.round(3)), "log_lik": pa.array(np.round(levels, 5) + 0.0)})

    return b.groupBy("j").applyInArrow(run, "j int, q double, log_lik double")


@query()
def hmm_binary_fit(spark, sf_dir):
    """(seq, t, flip_probability, log_likelihood, upper_probability, state): ``hmm.fit_binary`` on all points of every slope curve, levels 0 and 0.05."""
    b = _marginal(spark, sf_dir)

    def run(key, part):
        part = part.sort_by("t")
        fit = hmm.fit_binary(part.column("bhat").to_numpy(), part.column("shat").to_numpy(), (0.0, 0.05))
        n = part.num_rows
        return pa.table({"seq": part.column("j"), "t": part.column("t"), "flip_probability": pa.array(np.full(n, fit["flip_probability"])), "log_likelihood": pa.array(np.full(n, fit["log_likelihood"])), "upper_probability": pa.array(fit["state_probability"][:, 1]), "state": pa.array(fit["viterbi_state"], pa.int32())})

    return b.groupBy("j").applyInArrow(run, "seq int, t int, flip_probability double, log_likelihood double, upper_probability double, state int")


@query()
def hmm_posterior(spark, sf_dir):
    """(seq, t, mean, sd, lfsr, state, step_state): every covariate's slope curve smoothed, a sequence in each task."""
    b = _marginal(spark, sf_dir)

    def run(key, part):
        part = part.sort_by("t")
        fit = hmm.fit(part.column("bhat").to_numpy(), part.column("shat").to_numpy())
        post = fit.posterior
        return pa.table({"seq": part.column("j"), "t": part.column("t"), "mean": pa.array(post["mean"]), "sd": pa.array(post["sd"]), "lfsr": pa.array(post["lfsr"]), "state": pa.array(fit.viterbi_state, pa.int32()), "step_state": pa.array(fit.penalised_state, pa.int32())})

    return b.groupBy("j").applyInArrow(run, "seq int, t int, mean double, sd double, lfsr double, state int, step_state int")


# whole fits

@query()
def finemap_pip(spark, sf_dir):
    fit = FunctionalFineMapper().fit(views.embedding_rows(spark, sf_dir))
    return fit.variables_table(spark)


@query()
def finemap_curves(spark, sf_dir):
    fit = FunctionalFineMapper().fit(views.embedding_rows(spark, sf_dir))
    return fit.curves_table(spark)


@query()
def finemap_regions(spark, sf_dir):
    """The curves in four regions, each fitted in one task."""
    rows = views.embedding_rows(spark, sf_dir).withColumn("region", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    return FunctionalFineMapper().fit_by_region(rows, "region")


@query()
def individual_fits(spark, sf_dir):
    rows = views.embedding_rows(spark, sf_dir)
    return FunctionalFineMapper().fit(rows).fitted_rows(rows, "id")


@query()
def functional_regression(spark, sf_dir):
    """Customers' order curves on nations, one of which is left out."""
    curves, design = views.customer_curves(spark, sf_dir)
    x = F.array(*((F.col("nation") == j).cast("double") for j in views.levels(design, "j")[1:]))
    rows = views.array_curves(curves, 32).join(design.select("id", F.col("j").alias("nation")), "id").select("id", x.alias("x"), "y")
    return FunctionalRegression().fit(rows).curves_table(spark)


@query()
def ti_curve(spark, sf_dir):
    """Each label's curve by translation-invariant wavelets, with bands."""
    from . import smoothing

    m = mo.moments(views.embedding_rows(spark, sf_dir))
    rows = []
    for j in range(m.p):
        if m.xtx[j, j] > 0:
            c = smoothing.univariate("ti", float(m.xtx[j, j]), m.xty[j], m.yty, m.n)
            low, up = c.band()
            rows += [(j, t + 1, float(c.effect[t]), float(low[t]), float(up[t])) for t in range(64)]
    return spark.createDataFrame(rows, "j int, t int, f double, low double, up double")
