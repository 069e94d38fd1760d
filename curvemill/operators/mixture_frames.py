"""Mixture likelihoods, Bayes factors and posteriors as DataFrame expressions.

marginal(j, t, bhat, shat) meets a literal table of components. The prior is an array
of structs folded inside each row, so no row is multiplied by the number of components.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mixture import Mixture

LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)


def log_density(x: Column, var: Column) -> Column:
    return -LOG_SQRT_2PI - 0.5 * F.log(var) - x * x / (2 * var)


def _folded(part: Mixture, term) -> Column:
    """Sum over components of term(sd**2, weight)."""
    return sum((term(float(s) ** 2, float(w)) for s, w in zip(part.sd[1:], part.weight[1:], strict=True)), term(0.0, float(part.weight[0])))


def component_table(marginal: DataFrame, part: Mixture) -> DataFrame:
    """(j, t, k, log_lik): log density of every estimate under every component."""
    ks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s) ** 2).alias("v")) for k, s in enumerate(part.sd)))
    rows = marginal.select("j", "t", "bhat", "shat", F.explode(ks).alias("c"))
    return rows.select("j", "t", F.col("c.k").alias("k"), log_density(F.col("bhat"), F.col("c.v") + F.col("shat") ** 2).alias("log_lik"))


def _ratio(part: Mixture) -> Column:
    """log of the mixture's density over the null's; the largest exponent is taken out first."""
    b, s2 = F.col("bhat"), F.col("shat") ** 2
    logs = [F.lit(math.log(w)) + log_density(b, s2 + float(s) ** 2) for s, w in zip(part.sd, part.weight, strict=True) if w > 0]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return top + F.log(sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))) - log_density(b, s2)


def log_bayes_factors(marginal: DataFrame, parts: dict[int, Mixture] | Mixture) -> DataFrame:
    """(j, lbf), summed over t. With a mixture for each scale, marginal has a column scale."""
    if isinstance(parts, Mixture):
        one = _ratio(parts)
    else:
        one = F.lit(None).cast("double")
        for scale, part in parts.items():
            one = F.when(F.col("scale") == scale, _ratio(part)).otherwise(one)
    return marginal.groupBy("j").agg(F.sum(one).alias("lbf"))


def posterior_moments(marginal: DataFrame, part: Mixture) -> DataFrame:
    """(j, t, mean, sd, null): moments of the effect and the probability that it is 0."""
    b, s2 = F.col("bhat"), F.col("shat") ** 2
    top = F.greatest(*(log_density(b, s2 + float(s) ** 2) for s in part.sd))
    weight = lambda v, w: w * F.exp(log_density(b, s2 + v) - F.col("top"))
    rows = marginal.withColumn("top", top)
    rows = rows.withColumn("total", _folded(part, weight))
    mean = _folded(part, lambda v, w: weight(v, w) * b * v / (s2 + v)) / F.col("total")
    second = _folded(part, lambda v, w: weight(v, w) * ((b * v / (s2 + v)) ** 2 + v * s2 / (s2 + v))) / F.col("total")
    rows = rows.withColumn("mean", mean).withColumn("second", second)
    return rows.select("j", "t", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("second") - F.col("mean") ** 2)).alias("sd"), (weight(0.0, float(part.weight[0])) / F.col("total")).alias("null"))


def weights_step(marginal: DataFrame, zeta: DataFrame, part: Mixture) -> DataFrame:
    """(k, weight): one expectation-maximisation step of the mixture's weights, estimates weighted by zeta (j, zeta)."""
    logs = component_table(marginal, part)
    pi = F.array(*(F.lit(float(w)) for w in part.weight))
    own = logs.withColumn("p", pi[F.col("k")] * F.exp("log_lik"))
    total = own.groupBy("j", "t").agg(F.sum("p").alias("total"))
    resp = own.join(total, ["j", "t"]).join(zeta, "j").groupBy("k").agg(F.sum(F.col("zeta") * F.col("p") / F.col("total")).alias("r"))
    from pyspark.sql import Window

    return resp.select("k", (F.col("r") / F.sum("r").over(Window.partitionBy(F.lit(0)))).alias("weight"))
