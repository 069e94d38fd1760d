"""Second moments of curves and covariates: the one distributed pass that fitting needs.

Rows are individuals: ``x`` (array of P covariates) and ``y`` (array of T
points). Each task sums its rows' outer products with numpy in blocks and hands on one partial
per partition; partials are summed by groupBy, so what is shuffled is
partitions * (P + T)**2 numbers, whatever the number of individuals. Sums are
taken around a shift (a row's values), which keeps digits where means are large.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Matrix cells that are broadcast; larger matrices are joined by shuffle.
MAX_BROADCAST_CELLS = 2_000_000
#: Rows of a numpy pass, and tasks that merge the partitions' partials.
ROWS, MERGES = 4096, 16


@dataclass
class Moments:
    """Centred sums of products of (x, y), and the means."""

    n: int
    mean: np.ndarray
    cross: np.ndarray
    p: int

    @property
    def xtx(self) -> np.ndarray:
        return self.cross[: self.p, : self.p]

    @property
    def xty(self) -> np.ndarray:
        return self.cross[: self.p, self.p :]

    @property
    def yty(self) -> np.ndarray:
        return self.cross[self.p :, self.p :]

    def __add__(self, other: Moments) -> Moments:
        """Moments of two disjoint sets of rows: batches of a stream, or regions merged."""
        n = self.n + other.n
        d = other.mean - self.mean
        mean = self.mean + d * (other.n / n)
        return Moments(n, mean, self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n), self.p)


def partial(z: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = z.mean(0)
    c = z - mean
    return len(z), mean, c.T @ c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _partials(p: int):
    def run(batches):
        held: Moments | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = np.concatenate([_matrix(part.column(0)), _matrix(part.column(1))], axis=1)
                now = Moments(*partial(z), p)
                held = now if held is None else held + now
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.n]), pa.array([held.mean.tolist()], pa.list_(pa.float64())), pa.array([np.ascontiguousarray(held.cross).tobytes()], pa.binary())], names=["n", "mean", "cross"])

    return run


def moments(rows: DataFrame, *, x: str = "x", y: str = "y") -> Moments:
    """Of complete rows: those with a null array or component are left out. Raises on an empty input."""
    whole = rows.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.forall(x, lambda v: v.isNotNull()) & F.forall(y, lambda v: v.isNotNull()))
    first = whole.first()
    if first is None:
        raise ValueError("no complete rows")
    p, total = len(first[0]), None
    # partials are merged by a few tasks first, so the driver takes MERGES of them at most
    parts = whole.mapInArrow(_partials(p), "n bigint, mean array<double>, cross binary")

    def merge(batches):
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                size = len(r["mean"])
                now = Moments(r["n"], np.array(r["mean"]), np.frombuffer(r["cross"]).reshape(size, size), p)
                held = now if held is None else held + now
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.n]), pa.array([held.mean.tolist()], pa.list_(pa.float64())), pa.array([np.ascontiguousarray(held.cross).tobytes()], pa.binary())], names=["n", "mean", "cross"])

    for r in parts.repartition(MERGES).mapInArrow(merge, "n bigint, mean array<double>, cross binary").collect():
        size = len(r["mean"])
        now = Moments(r["n"], np.array(r["mean"]), np.frombuffer(r["cross"]).reshape(size, size), p)
        total = now if total is None else total + now
    return total


# the same on long tables, in SQL operators

def standardised(long: DataFrame, key: str, value: str, *, center: bool = True, scale: bool = True) -> DataFrame:
    """long with ``value`` centred and divided by the sample standard deviation within ``key``; where that is 0 the divisor is 1."""
    stats = column_stats(long, key, value)
    out = long.join(stats.select(key, "mean", "divisor"), key)
    v = F.col(value) - F.col("mean") if center else F.col(value)
    return out.withColumn(value, v / F.col("divisor") if scale else v).drop("mean", "divisor")


def column_stats(long: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, sd, divisor, d): d is the sum of squares after scaling."""
    s = long.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    divisor = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return s.withColumn("divisor", divisor).withColumn("d", F.when(F.col("sd") > 0, (F.col("n") - 1).cast("double")).otherwise(0.0))


def varying(design: DataFrame, n: int) -> DataFrame:
    """(j, n_nonzero, mean, var, kept) of a sparse design (absent cells are 0); constant covariates aren't kept."""
    s = design.groupBy("j").agg(F.count(F.when(F.col("x") != 0, 1)).alias("n_nonzero"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    var = F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1))
    return s.select("j", "n_nonzero", (F.col("s") / n).alias("mean"), var.alias("var"), (var > 1e-12).alias("kept"))


def through_origin(design: DataFrame, curves: DataFrame, n: int, *, masked: DataFrame | None = None) -> DataFrame:
    """(j, t, slope, se): regression without intercept of each response on each covariate as they are, of n individuals.

    The standard error is that of the residuals' sample variance over n - 1. Masked responses (t) get (0, 1). Covariates that are 0 throughout have no rows.
    """
    x = design.groupBy("j").agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("x").alias("sx")).where("xx > 0")
    y = curves.groupBy("t").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"))
    xy = design.join(curves, "id").groupBy("j", "t").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    slope = F.col("xy") / F.col("xx")
    square = F.col("yy") - F.col("xy") * slope
    mean = (F.col("sy") - F.col("sx") * slope) / n
    se = F.sqrt(F.greatest(F.lit(0.0), (square - n * mean * mean) / (n - 1) / (n - 1)))
    out = xy.join(x, "j").join(y, "t").select("j", "t", slope.alias("slope"), se.alias("se"))
    if masked is None:
        return out
    off = F.col("off").isNotNull()
    out = out.join(F.broadcast(masked.select("t", F.lit(True).alias("off"))), "t", "left")
    return out.select("j", "t", F.when(off, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(off, 1.0).otherwise(F.col("se")).alias("se"))


def marginal(design: DataFrame, curves: DataFrame, n: int, *, sigma2: float | None = None, masked: DataFrame | None = None) -> DataFrame:
    """(j, t, bhat, shat): regression of every standardised response on every standardised covariate.

    design (id, j, x) is sparse: absent cells are 0, so one-hot covariates cost one row each; curves (id, t, y) are
    complete. The join is on the individual and the sums are partial before the shuffle. With sigma2 the
    standard error is sqrt(sigma2 / d), else that of the regression without intercept. Masked responses (t) get (0, 1).
    """
    x_stats = varying(design, n).where("kept").select("j", F.col("mean").alias("x_mean"), F.sqrt("var").alias("x_sd"))
    y_stats = curves.groupBy("t").agg(F.avg("y").alias("y_mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("y_sd"))
    products = design.join(curves, "id").groupBy("j", "t").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    d = float(n - 1)
    sd = F.when(F.col("y_sd") > 0, F.col("y_sd")).otherwise(1.0)
    slope = (F.col("xy") - n * F.col("x_mean") * F.col("y_mean")) / (F.col("x_sd") * sd) / d
    out = products.join(x_stats, "j").join(y_stats, "t").withColumn("bhat", slope)
    square = F.when(F.col("y_sd") > 0, F.lit(d)).otherwise(0.0)
    se = F.sqrt(F.greatest(F.lit(0.0), square - F.col("bhat") ** 2 * d) / d / d) if sigma2 is None else F.lit(float(np.sqrt(sigma2 / d)))
    out = out.select("j", "t", "bhat", F.greatest(F.lit(1e-32), se).alias("shat"))
    if masked is not None:
        out = out.join(F.broadcast(masked.select("t", F.lit(True).alias("off"))), "t", "left")
        out = out.select("j", "t", F.when(F.col("off"), 0.0).otherwise(F.col("bhat")).alias("bhat"), F.when(F.col("off"), 1.0).otherwise(F.col("shat")).alias("shat"))
    return out


def marginal_own_rows(design: DataFrame, curves: DataFrame, n: int, *, sigma2: float | None = None) -> DataFrame:
    """(j, t, n_own, bhat, shat): as ``marginal`` where each response has its own individuals, those with a row in curves (null y: absent).

    Covariates are standardised over all n individuals, responses over their own; slopes and errors are those without
    intercept over the response's own rows. A covariate that is 0 for all of a response's individuals has no row there (its slope is 0).
    """
    own = curves.where(F.col("y").isNotNull())
    x_stats = varying(design, n).where("kept").select("j", F.col("mean").alias("x_mean"), F.sqrt("var").alias("x_sd"))
    y_stats = own.groupBy("t").agg(F.count("y").alias("n_own"), F.avg("y").alias("y_mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("y_sd"))
    sums = design.join(own, "id").groupBy("j", "t").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = sums.join(x_stats, "j").join(y_stats, "t")
    d = (F.col("xx") - 2 * F.col("x_mean") * F.col("sx") + F.col("n_own") * F.col("x_mean") ** 2) / F.col("x_sd") ** 2
    sd = F.when(F.col("y_sd") > 0, F.col("y_sd")).otherwise(1.0)
    out = out.withColumn("d", d).withColumn("bhat", (F.col("xy") - F.col("y_mean") * F.col("sx")) / F.col("x_sd") / sd / F.col("d"))
    square = F.when(F.col("y_sd") > 0, F.col("n_own") - 1.0).otherwise(0.0)
    rest = F.greatest(F.lit(0.0), square - F.col("bhat") ** 2 * F.col("d"))
    # one row has no variance of its own
    se = F.when(F.col("n_own") > 1, F.sqrt(rest / (F.col("n_own") - 1) / F.col("d"))) if sigma2 is None else F.sqrt(F.lit(float(sigma2)) / F.col("d"))
    return out.select("j", "t", "n_own", "bhat", F.greatest(F.lit(1e-32), se).alias("shat"))


class Medians:
    """Is each column's median at most a threshold? Exact from counts and the two values next to the threshold, so that partials merge."""

    def __init__(self, threshold: float, n: int, count: np.ndarray, below: np.ndarray, above: np.ndarray):
        self.threshold, self.n, self.count, self.below, self.above = threshold, n, count, below, above

    @classmethod
    def of(cls, z: np.ndarray, threshold: float) -> Medians:
        under = z <= threshold
        return cls(threshold, len(z), under.sum(0), np.where(under, z, -np.inf).max(0, initial=-np.inf), np.where(under, np.inf, z).min(0, initial=np.inf))

    def __add__(self, other: Medians) -> Medians:
        return Medians(self.threshold, self.n + other.n, self.count + other.count, np.maximum(self.below, other.below), np.minimum(self.above, other.above))

    def at_most(self) -> np.ndarray:
        """The median of an even number of rows is the mean of the middle two."""
        split = (2 * self.count == self.n) & (self.below + self.above <= 2 * self.threshold)
        return (2 * self.count > self.n) | split


def low_medians(rows: DataFrame, a: np.ndarray, mean: np.ndarray, threshold: float, *, x: str = "x", y: str = "y") -> np.ndarray:
    """Which of the coefficients a @ (y - mean) have a median absolute value of at most the threshold, over the rows that ``moments`` uses."""
    size = len(a)

    def run(batches):
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                now = Medians.of(np.abs((_matrix(batch.slice(at, ROWS).column(0)) - mean) @ a.T), threshold)
                held = now if held is None else held + now
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, held.n)), pa.array(held.count), pa.array(held.below), pa.array(held.above)], names=["c", "n", "under", "below", "above"])

    whole = rows.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.forall(x, lambda v: v.isNotNull()) & F.forall(y, lambda v: v.isNotNull())).select(y)
    parts = whole.mapInArrow(run, "c bigint, n bigint, under bigint, below double, above double")
    found = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("under").alias("under"), F.max("below").alias("below"), F.min("above").alias("above")).orderBy("c").toPandas()
    return Medians(threshold, int(found["n"].iloc[0]), found["under"].to_numpy(), found["below"].to_numpy(), found["above"].to_numpy()).at_most()


def low_count(curves: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Responses (t) whose median absolute value is at most the threshold, by the exact median."""
    return curves.groupBy("t").agg(F.expr("percentile(abs(y), 0.5D)").alias("median")).where(F.col("median") <= threshold)


def scale_mean_se(marginals: DataFrame, scales: DataFrame) -> DataFrame:
    """shat replaced by its mean within the covariate and scale (1e-10 if that isn't positive)."""
    mean = F.avg("shat").over(Window.partitionBy("j", "scale"))
    return marginals.join(F.broadcast(scales), "t").withColumn("shat", F.when(mean > 0, mean).otherwise(1e-10))


def normal_score_ranks(curves: DataFrame) -> DataFrame:
    """(id, t, rank, plotting): rank within the response, ties by id, and the plotting position of its normal score."""
    w = Window.partitionBy("t")
    n = F.count(F.lit(1)).over(w)
    a = F.when(n <= 10, 0.375).otherwise(0.5)
    rank = F.row_number().over(w.orderBy("y", "id"))
    return curves.select("id", "t", rank.alias("rank"), ((rank - a) / (n + 1 - 2 * a)).alias("plotting"))


def normal_scores(curves: DataFrame) -> DataFrame:
    """(id, t, y): normal scores of each response; the quantile function is an Arrow-batched expression."""
    from ..functions.special import normal_quantile

    ranked = normal_score_ranks(curves).select("id", "t", "plotting")

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(normal_quantile(b.column(2).to_numpy()))], names=["id", "t", "y"])

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(score, f"id {kinds['id']}, t {kinds['t']}, y double")


def adjusted(curves: DataFrame, design: DataFrame, effects: DataFrame) -> DataFrame:
    """(id, t, y): curves less the effects (j, t, f) of a sparse design's covariates."""
    fitted = design.join(effects, "j").groupBy("id", "t").agg(F.sum(F.col("x") * F.col("f")).alias("fit"))
    return curves.join(fitted, ["id", "t"], "left").select("id", "t", (F.col("y") - F.coalesce("fit", F.lit(0.0))).alias("y"))


def transformed(curves: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, c, w): matrix @ curve for each individual, as a join with the matrix's nonzero cells; t and c count from 1."""
    c, t = np.nonzero(np.abs(matrix) > 1e-14)
    spark = curves.sparkSession
    cells = spark.createDataFrame(pa.table({"c": pa.array(c + 1, pa.int32()), "t": pa.array(t + 1, pa.int32()), "m": pa.array(matrix[c, t])}))
    cells = F.broadcast(cells) if len(c) <= MAX_BROADCAST_CELLS else cells
    return curves.join(cells, "t").groupBy("id", "c").agg(F.sum(F.col("m") * F.col("y")).alias("w"))


def rounded(column: Column, digits: int = 6) -> Column:
    """For comparing engines: rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
