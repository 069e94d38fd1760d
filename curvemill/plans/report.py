"""What plots of a fit show, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.credible import affected_regions
from .finemap import Fit


def pip_plot(fit: Fit, spark: SparkSession) -> DataFrame:
    """(j, name, pip, effect): a covariate in several sets shows the last."""
    sets = fit.sets_table(spark).groupBy("j").agg(F.max("effect").alias("effect"))
    return fit.variables_table(spark).join(F.broadcast(sets), "j", "left").select("j", "name", "pip", "effect")


def effect_plot(fit: Fit, spark: SparkSession, level: float = 0.05) -> DataFrame:
    """Curves with bands or false sign rates, and whether each point lies in an affected region."""
    curves = fit.curves_table(spark, level)
    banded = fit.curves and fit.curves[0].variance is not None
    hit = (F.col("low") > 0) | (F.col("up") < 0) if banded else F.col("lfsr") < level
    return curves.withColumn("affected", F.coalesce(hit, F.lit(False)))


def regions(fit: Fit, spark: SparkSession, level: float = 0.05) -> DataFrame:
    """(effect, start, end, length) in points of the grid; empty where nothing is affected."""
    curves = fit.curves_table(spark, level)
    banded = fit.curves and fit.curves[0].variance is not None
    return affected_regions(curves.drop("lfsr") if banded else curves.drop("low", "up"), lfsr=level)


def class_means(curves: DataFrame, classes: DataFrame, *, logs: bool = True) -> DataFrame:
    """(class, t, mean): average curve of each class of individuals, of log1p of counts if asked."""
    y = F.log1p("y") if logs else F.col("y")
    return curves.join(classes, "id").groupBy("class", "t").agg(F.avg(y).alias("mean"))


def junctions(names: DataFrame, column: str = "name") -> DataFrame:
    """start and end out of names like chr1:100-200."""
    return names.withColumn("start", F.regexp_extract(column, r":(\d+)-(\d+)", 1).cast("bigint")).withColumn("end", F.regexp_extract(column, r":(\d+)-(\d+)", 2).cast("bigint"))
