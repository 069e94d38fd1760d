"""Second moments over a stream: sums are additive, so each micro-batch adds its own.

State is one small table for each batch id, written in one go; a batch that is
replayed after a failure replaces its own partial and is never counted twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.moments import Moments, moments


class MomentsSink:
    def __init__(self, spark: SparkSession, folder: str, *, x: str = "x", y: str = "y"):
        self.spark, self.folder, self.x, self.y = spark, folder.rstrip("/"), x, y

    def write_batch(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        m = moments(batch, x=self.x, y=self.y)
        row = pa.table({"n": [m.n], "p": [m.p], "mean": pa.array([m.mean.tolist()], pa.list_(pa.float64())), "sums": pa.array([m.cross.tobytes()], pa.binary())})
        self.spark.createDataFrame(row).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def total(self) -> Moments:
        """Moments of all batches so far."""
        out = None
        for r in self.spark.read.parquet(self.folder).select("n", "p", "mean", "sums").toLocalIterator():
            size = len(r["mean"])
            now = Moments(r["n"], np.array(r["mean"]), np.frombuffer(r["sums"]).reshape(size, size), r["p"])
            out = now if out is None else out + now
        return out


def windowed_bins(events: DataFrame, *, time: str = "ts", key: str = "user_id", value: str = "value", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(id, window, y): sums of a stream in tumbling windows; rows later than ``late`` are left out by the watermark."""
    own = events.withWatermark(time, late)
    return own.groupBy(F.col(key).alias("id"), F.window(time, width)).agg(F.sum(value).alias("y"))
