"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards. Compaction merges runs of
similar size (one tier: sizes within a factor FANOUT) into files of about the
target size; shards that have reached it are never rewritten. What a table
holds is what its newest manifest lists: a manifest is written aside and renamed
into place, which fails if that version exists, so a version is there wholly or not at
all, readers keep the version they began with, and of two writers one must retry.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Merges that one Spark job takes on.
JOB_MERGES = 64


class Conflict(Exception):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    level: int

    def tier(self, fanout: int = FANOUT) -> int:
        return int(math.log(max(1, self.bytes), fanout))


def plan(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups to merge: FANOUT or more shards of a tier, smallest first, each group up to about the target size.

    Shards of the target size or more are done; a tier with fewer shards waits for more.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < target:
            tiers.setdefault(s.tier(fanout), []).append(s)
    groups: list[list[Shard]] = []
    for t in sorted(tiers):
        waiting = sorted(tiers[t], key=lambda s: (s.bytes, s.path))
        if len(waiting) < fanout:
            continue
        group: list[Shard] = []
        for s in waiting:
            if group and sum(x.bytes for x in group) + s.bytes > target * 1.25:
                groups.append(group)
                group = []
            group.append(s)
        if len(group) > 1:
            groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardStore:
    """A table of immutable Parquet shards under ``path``, any folder that Spark's executors and driver share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._Path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.valueOf("NONE")
        self._fs.mkdirs(self._Path(f"{self.path}/_manifest"))

    def _names(self, folder: str) -> list[tuple[str, int]]:
        p = self._Path(folder)
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self._names(f"{self.path}/_manifest") if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        """Of the newest version, or of an older one that is still kept; none in an empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._Path(f"{self.path}/_manifest/v{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, version: int, shards: list[Shard]) -> int:
        aside = self._Path(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        try:
            self._context.rename(aside, self._Path(f"{self.path}/_manifest/v{version:08d}.json"), self._no_overwrite)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _write(self, df: DataFrame, level: int) -> list[Shard]:
        folder = f"data/{level}-{uuid.uuid4().hex}"
        df.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return [Shard(f"{folder}/{n}", size, level) for n, size in self._names(f"{self.path}/{folder}") if n.startswith("part-")]

    def append(self, df: DataFrame) -> int:
        """One more version with the arrival's shards, a file for each partition. No shuffle."""
        version, held = max(self.versions(), default=0), self.shards()
        return self.commit(version + 1, held + self._write(df, 0))

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge what plan() finds, until it finds nothing, and commit once; the version, which stays if there was nothing to do.

        Each merge is one task that reads its shards and writes one file; rows are not shuffled.
        """
        version, before = max(self.versions(), default=0), self.shards()
        now = before
        while groups := plan(now, target, fanout):
            for at in range(0, len(groups), JOB_MERGES):
                some, union = groups[at : at + JOB_MERGES], None
                for g in some:
                    part = self._read(g).coalesce(1)
                    union = part if union is None else union.union(part)
                gone = {s.path for g in some for s in g}
                now = [s for s in now if s.path not in gone] + self._write(union, 1 + max(s.level for g in some for s in g))
        return version if now is before else self.commit(version + 1, now)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the newest versions, and files that none of those list. Not while others write or read older ones."""
        versions = self.versions()
        listed = {s.path for v in versions[-keep:] for s in self.shards(v)}
        for v in versions[:-keep]:
            self._fs.delete(self._Path(f"{self.path}/_manifest/v{v:08d}.json"), False)
        for folder, _ in self._names(f"{self.path}/data"):
            for name, _ in self._names(f"{self.path}/data/{folder}"):
                if f"data/{folder}/{name}" not in listed:
                    self._fs.delete(self._Path(f"{self.path}/data/{folder}/{name}"), False)

    def _read(self, shards: list[Shard]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{s.path}" for s in shards))

    def read(self, version: int | None = None, *, shard: str | None = None) -> DataFrame:
        """The rows of a version; ``shard``: a column for the file each lies in, which must not be a column of the table."""
        if shard is not None and shard.lower() in {c.lower() for c in self.schema.names}:
            raise ValueError(f"the table has a column {shard}")
        rows = self._read(self.shards(version))
        if shard is None:
            return rows
        return rows.withColumn(shard, F.regexp_extract(F.col("_metadata.file_path"), "(data/[^/]+/[^/]+)$", 1)) if self.shards(version) else rows.withColumn(shard, F.lit(""))


def arrivals(docs: DataFrame, n: int, key: str = "doc_id") -> list[DataFrame]:
    """docs in n parts by ranges of an integer key (null keys are in the first), as they would come one after the other."""
    low, high = docs.agg(F.min(key), F.max(key)).first()
    if low is None:
        return [docs]
    step = max(1, -(-(high - low + 1) // n))
    parts = [docs.where((F.col(key) >= low + i * step) & (F.col(key) < low + (i + 1) * step)) for i in range(n) if low + i * step <= high]
    parts[0] = docs.where(F.col(key).isNull() | (F.col(key) < low + step))
    return parts


#: Arrivals that the query deals documents into.
ARRIVALS = 6


def query(spark, sf_dir):
    """op6: documents arrive in parts, are compacted, and are read back from the committed version.

    A row for each document: doc_id, the digest of its text as read back, its shard, the shard's level (merges its rows went through) and the version.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, scratch_path(spark, "shards"), docs.schema)
    for part in arrivals(docs, ARRIVALS):
        store.append(part)
    version = store.compact()
    store.vacuum()
    rows = store.read(version, shard="shard")
    return rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "shard", F.regexp_extract("shard", "data/([0-9]+)-", 1).cast("int").alias("level"), F.lit(version).alias("version"))
