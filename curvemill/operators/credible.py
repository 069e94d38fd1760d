"""Inclusion probabilities, credible sets and what is asked of them, as DataFrames.

Tables: effects(effect, j, alpha, lbf), sets(effect, j), correlations(j, k, r).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def softmax(factors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """factors (.., j, lbf) with alpha: probabilities within ``by``."""
    if by:
        w = Window.partitionBy(*by)
        e = F.exp(F.col("lbf") - F.max("lbf").over(w))
        return factors.withColumn("alpha", e / F.sum(e).over(w))
    # over all rows: two aggregates of one row each, so no task gets every covariate
    top = F.broadcast(factors.agg(F.max("lbf").alias("top")))
    total = F.broadcast(factors.join(top).agg(F.max("top").alias("top"), F.sum(F.exp(F.col("lbf") - F.col("top"))).alias("total")))
    return factors.join(total).withColumn("alpha", F.exp(F.col("lbf") - F.col("top")) / F.col("total")).drop("top", "total")


def pip(effects: DataFrame) -> DataFrame:
    """(j, pip): 1 - prod(1 - alpha) over effects, summed in logs; a certain effect gives 1."""
    certain = F.max(F.when(F.col("alpha") >= 1, 1).otherwise(0))
    rest = F.sum(F.when(F.col("alpha") < 1, F.log1p(-F.col("alpha"))))
    return effects.groupBy("j").agg(F.when(certain == 1, 1.0).otherwise(1 - F.exp(F.coalesce(rest, F.lit(0.0)))).alias("pip"))


def credible_sets(effects: DataFrame, coverage: float = 0.95) -> DataFrame:
    """(effect, j, place, alpha): the shortest run of the most probable covariates whose sum exceeds the coverage, or all; ties by j."""
    w = Window.partitionBy("effect").orderBy(F.desc("alpha"), "j")
    before = F.coalesce(F.sum("alpha").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return effects.withColumn("before", before).withColumn("place", F.row_number().over(w)).where(F.col("before") <= coverage).select("effect", "j", "place", "alpha")


def purity(sets: DataFrame, correlations: DataFrame) -> DataFrame:
    """(effect, size, purity): the least absolute correlation within each set; 1 for sets of one."""
    a, b = sets.select("effect", "j"), sets.select("effect", F.col("j").alias("k"))
    pairs = a.join(b, "effect").where("j < k").join(correlations, ["j", "k"])
    least = pairs.groupBy("effect").agg(F.min(F.abs("r")).alias("purity"))
    return sets.groupBy("effect").agg(F.count(F.lit(1)).alias("size")).join(least, "effect", "left").select("effect", "size", F.coalesce("purity", F.lit(1.0)).alias("purity"))


def dummies(summary: DataFrame, *, min_purity: float = 0.5, min_lbf: float = 0.1, null: DataFrame | None = None) -> DataFrame:
    """summary (effect, size, purity, max_lbf) with ``dummy``: impure and weak sets of several, or effects whose prior is null (effect)."""
    weak = (F.col("size") > 1) & (F.col("purity") < min_purity) & (F.col("max_lbf") < min_lbf)
    if null is None:
        return summary.withColumn("dummy", weak)
    return summary.join(null.select("effect", F.lit(True).alias("is_null")), "effect", "left").withColumn("dummy", weak | F.coalesce("is_null", F.lit(False))).drop("is_null")


def relations(sets: DataFrame) -> DataFrame:
    """(a, b, relation): for each pair of effects a < b: identical, a_in_b, b_in_a or none."""
    s = sets.groupBy("effect").agg(F.sort_array(F.collect_set("j")).alias("members"))
    pairs = s.select(F.col("effect").alias("a"), F.col("members").alias("ma")).join(s.select(F.col("effect").alias("b"), F.col("members").alias("mb")), F.col("a") < F.col("b"))
    a_in, b_in = F.size(F.array_except("ma", "mb")) == 0, F.size(F.array_except("mb", "ma")) == 0
    return pairs.select("a", "b", F.when(a_in & b_in, "identical").when(a_in, "a_in_b").when(b_in, "b_in_a").otherwise("none").alias("relation"))


def merge_choice(sets: DataFrame, max_lbf: DataFrame) -> DataFrame:
    """(a, b, keep): of each nested or identical pair the smaller set stays, then that with the larger factor, then the first."""
    info = sets.groupBy("effect").agg(F.count(F.lit(1)).alias("size")).join(max_lbf, "effect")
    left, right = (info.select(F.col("effect").alias(e), F.col("size").alias(f"size_{e}"), F.col("max_lbf").alias(f"lbf_{e}")) for e in "ab")
    first = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("lbf_a") >= F.col("lbf_b")))
    return relations(sets).where("relation <> 'none'").join(left, "a").join(right, "b").select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"))


def set_correlation(sets: DataFrame, correlations: DataFrame) -> DataFrame:
    """(a, b, r, abs_r): the largest signed and the largest absolute correlation between members of two sets; correlations has both orders and the diagonal."""
    left, right = sets.select(F.col("effect").alias("a"), "j"), sets.select(F.col("effect").alias("b"), F.col("j").alias("k"))
    near = left.join(correlations, "j").join(right, "k").where("a < b")
    return near.groupBy("a", "b").agg(F.max("r").alias("r"), F.max(F.abs("r")).alias("abs_r"))


def named(sets: DataFrame, variables: DataFrame) -> DataFrame:
    return sets.join(variables.select("j", "name"), "j", "left")


def islands(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, start, end, length): runs of consecutive integers."""
    run = F.col(at) - F.row_number().over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("run", run).groupBy(key, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("length")).drop("run")


def affected_regions(curves: DataFrame, *, lfsr: float = 0.05) -> DataFrame:
    """(effect, start, end, length) where the band leaves out 0 or the false sign rate is below the threshold. curves: effect, t, and low and up or lfsr."""
    hit = (F.col("low") > 0) | (F.col("up") < 0) if "low" in curves.columns else F.col("lfsr") < lfsr
    return islands(curves.where(hit).select("effect", "t"), "effect", "t")


def state_segments(path: DataFrame) -> DataFrame:
    """(seq, start, end, length, state): runs of one state along t."""
    w = Window.partitionBy("seq").orderBy("t")
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy("seq", "state").orderBy("t"))
    return path.withColumn("run", run).groupBy("seq", "state", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("length")).drop("run")


def colocalised(first: DataFrame, second: DataFrame, p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5) -> DataFrame:
    """(h, posterior) for H0 to H4 of two traits' (j, lbf): none, either, both with distinct, both with one covariate (Giambartolomei et al. 2014)."""
    both = first.select("j", F.col("lbf").alias("l1")).join(second.select("j", F.col("lbf").alias("l2")), "j")
    top = both.agg(F.max("l1").alias("m1"), F.max("l2").alias("m2"))
    e = both.join(F.broadcast(top)).agg(F.sum(F.exp(F.col("l1") - F.col("m1"))).alias("s1"), F.sum(F.exp(F.col("l2") - F.col("m2"))).alias("s2"), F.sum(F.exp(F.col("l1") - F.col("m1") + F.col("l2") - F.col("m2"))).alias("s12"), F.max("m1").alias("m1"), F.max("m2").alias("m2"))
    log = lambda c: F.log(F.greatest(c, F.lit(1e-300)))
    l1, l2, l12 = F.col("m1") + log(F.col("s1")), F.col("m2") + log(F.col("s2")), F.col("m1") + F.col("m2") + log(F.col("s12"))
    apart = F.col("m1") + F.col("m2") + log(F.col("s1") * F.col("s2") - F.col("s12"))
    parts = [F.lit(0.0), F.log(F.lit(p1)) + l1, F.log(F.lit(p2)) + l2, F.log(F.lit(p1)) + F.log(F.lit(p2)) + apart, F.log(F.lit(p12)) + l12]
    rows = e.select(F.posexplode(F.array(*parts)).alias("h", "log_sum"))
    return softmax(rows.withColumnRenamed("log_sum", "lbf")).select("h", F.col("alpha").alias("posterior"))
