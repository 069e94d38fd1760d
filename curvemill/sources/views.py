"""Curves and covariates over the relational tables, and a sink for results.

Long form: curves(id, t, y) with t from 1, design(id, j, x) sparse (absent cells are 0).
Array form, one row for each individual: id, x array, y array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def long_curves(rows: DataFrame, key: str, array: str) -> DataFrame:
    """(id, t, y) of array columns; null arrays give no rows."""
    return rows.select(F.col(key).alias("id"), F.posexplode(array).alias("t", "y")).select("id", (F.col("t") + 1).alias("t"), F.col("y").cast("double").alias("y"))


def array_curves(curves: DataFrame, points: int) -> DataFrame:
    """(id, y array) of complete curves; absent points are 0."""
    cells = F.map_from_entries(F.collect_list(F.struct("t", "y")))
    return curves.groupBy("id").agg(cells.alias("m")).select("id", F.transform(F.sequence(F.lit(1), F.lit(points)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("y"))


def one_hot(rows: DataFrame, key: str, category: str) -> DataFrame:
    """design(id, j, x): one row for each individual, the category's number as covariate."""
    return rows.where(F.col(category).isNotNull()).select(F.col(key).alias("id"), F.col(category).cast("int").alias("j"), F.lit(1.0).alias("x"))


def binned(rows: DataFrame, ids: DataFrame, position: Column, value: Column, bins: int) -> DataFrame:
    """(id, t, y): sums of value in equal bins of the position's range over all rows; empty bins are 0.

    rows and ids have a column id. The range is one row that joins every row; a range of one point is one bin.
    """
    own = rows.select("id", position.cast("double").alias("pos"), value.alias("v"))
    span = own.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("pos") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    sums = own.join(F.broadcast(span)).select("id", (at + 1).cast("int").alias("t"), "v").groupBy("id", "t").agg(F.sum("v").alias("y"))
    grid = ids.select("id").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return grid.join(sums, ["id", "t"], "left").select("id", "t", F.coalesce("y", F.lit(0.0)).alias("y"))


# the driver's tables

def embedding_curves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    return long_curves(rows, "vec_id", "embedding"), one_hot(rows, "vec_id", "label")


def levels(rows: DataFrame, column: str) -> list:
    """Distinct values, sorted, null aside: each becomes a covariate, so a fit's state holds them anyway."""
    return sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().collect())


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, x (an indicator for each label that occurs), y."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    x = F.array(*((F.col("label") == j).cast("double") for j in levels(rows, "label")))
    return rows.select(F.col("vec_id").alias("id"), "label", x.alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("y"))


def days(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date"))


def supplier_curves(spark: SparkSession, sf_dir: str, bins: int = 64) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "id")
    supplier = table(spark, sf_dir, "supplier")
    ids = supplier.select(F.col("s_suppkey").alias("id"))
    return binned(lines, ids, days("l_shipdate"), F.col("l_extendedprice") * (1 - F.col("l_discount")), bins), one_hot(supplier, "s_suppkey", "s_nationkey")


def customer_curves(spark: SparkSession, sf_dir: str, bins: int = 32) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    customer = table(spark, sf_dir, "customer")
    return binned(orders, customer.select(F.col("c_custkey").alias("id")), days("o_orderdate"), F.col("o_totalprice"), bins), one_hot(customer, "c_custkey", "c_nationkey")


def user_curves(spark: SparkSession, sf_dir: str, bins: int = 32) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    kinds = events.groupBy("id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("x"))
    names = F.array(*(F.lit(k) for k in levels(kinds, "event_type")))
    design = kinds.select("id", (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("j"), "x")
    return binned(events, events.select("id"), F.unix_timestamp("ts"), F.col("value"), bins), design


def save(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """Parquet, optionally by region or effect folders."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
