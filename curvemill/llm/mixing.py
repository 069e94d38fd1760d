"""Mixing sources to target weights by Poisson replication.

A source with n of N rows and target weight w gets the mean repetition rate
``w * size / n`` (size: rows wanted in all). Each row draws its number of
copies by inverting the Poisson distribution of that mean at a uniform number
hashed from the seed and the row, so the draw is the same on every rerun, on
any cluster, and needs no coordination. A rate above MAX_RATE is parted into equal
ones that are drawn on their own: a sum of Poisson numbers is one, and no table of
a distribution grows with the rate. Copies go to random partitions in
random order (a global shuffle without a sampling pass).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rate tables up to this many sources are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: A distribution's cumulative sums are tabled for rates up to this.
MAX_RATE = 16.0
#: Tasks over which one source's rows are dealt where rates are joined by shuffle.
SALTS = 64
#: Input bytes of a partition of the shuffle, at most, until there are MAX_PARTITIONS of them.
PARTITION_BYTES, MAX_PARTITIONS = 64 << 20, 1_000_000


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an MD5; the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, long enough that the rest is below double precision; for rates up to MAX_RATE."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / k)
        return F.struct(log_p.alias("log_p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log_p))).alias("cdf"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["cdf"]))


def drawn(cdf: Column, parts: Column, seed: str, who: Column) -> Column:
    """A row's number of copies: the sum of its parts' draws. The first part's uniform number is that of a single one."""

    thrown = F.transform(F.sequence(F.lit(1).cast("long"), parts), lambda i: F.when(i == 1, uniform(F.lit(seed), who)).otherwise(uniform(F.lit(seed), who, i.cast("string"))))
    return F.aggregate(thrown, F.lit(0).cast("long"), lambda n, u: n + F.size(F.filter(cdf, lambda c: c <= u)))


def rates(docs: DataFrame, targets: Mapping[str, float], *, source: str = "source", size: float = 1.0) -> DataFrame:
    """(source, n, rate, parts, cdf): one row for each source; cdf is that of a part. Sources without a target share what the targets leave, by their rows.

    size: wanted rows as a multiple of the input's. Rows with a null source are a source of their own.
    """
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target weights must not be negative nor sum to more than 1")
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    named = F.create_map(*(F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1])))) if targets else None
    given = F.element_at(named, F.coalesce("source", F.lit(""))) if named is not None else F.lit(None).cast("double")
    given = F.when(F.col("source").isNotNull(), given)
    per = counts.withColumn("target", given)
    total = per.agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("target").isNull(), F.col("n"))).alias("free_n")).first()
    all_n, free_n = total["all_n"] or 0, total["free_n"] or 0
    left = max(0.0, 1.0 - sum(targets.values()))
    weight = F.coalesce("target", F.lit(left) * F.col("n") / F.lit(float(max(1, free_n))))
    sized = per.withColumn("rate", weight * F.lit(float(all_n) * size) / F.col("n")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("long"))
    return sized.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts"))).select("source", "n", "rate", "parts", "cdf")


def mixed(docs: DataFrame, targets: Mapping[str, float], *, key: str = "doc_id", source: str = "source", size: float = 1.0, seed: str = "mix") -> DataFrame:
    """Every column of docs, for each copy, plus mix_copy (from 1) and mix_key (its place in the shuffled order).

    A row with a null key draws by the hash of all its columns; repeated rows draw the same number (ties of mix_key lie in any order); an
    empty table stays empty. Columns of docs named mix_copy or mix_key are replaced, other names are the operator's to keep.
    """
    own = docs.drop("mix_copy", "mix_key")
    table = rates(own, targets, source=source, size=size).select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    rows = table.limit(MAX_BROADCAST_SOURCES + 1).collect()
    few = len(rows) <= MAX_BROADCAST_SOURCES
    if few:  # the size is known now, so a literal table can be broadcast
        table = F.broadcast(docs.sparkSession.createDataFrame(rows, table.schema))
    who = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.xxhash64(*own.columns).cast("string")))
    if few:
        met = own.join(table, own[source].eqNullSafe(F.col("__source")))
    else:  # a source may hold most rows: it is dealt over SALTS tasks
        salt = F.pmod(F.xxhash64(who), F.lit(SALTS))
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = own.withColumn("__own_salt", salt).join(salted.hint("merge"), own[source].eqNullSafe(F.col("__source")) & (F.col("__own_salt") == F.col("__salt"))).drop("__own_salt", "__salt")
    copies = met.withColumn("__n", drawn(F.col("__cdf"), F.col("__parts"), seed, who)).where("__n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    copies = copies.withColumn("mix_key", uniform(F.lit(seed + "-order"), who, F.col("mix_copy").cast("string")))
    copies = copies.drop("__source", "__parts", "__cdf", "__n")
    # a partition is sorted in one task, so there are more of them for more bytes; where the plan doesn't know its bytes the session's number holds
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    need = min(int(known * size / PARTITION_BYTES), MAX_PARTITIONS) if known < 1 << 60 else 0
    dealt = copies.repartition(need, "mix_key") if need > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else copies.repartition("mix_key")
    return dealt.sortWithinPartitions("mix_key", key, "mix_copy")


#: Production mix of the query: three sources have a target, the others share the rest by their rows.
TARGETS = {"src0": 0.15, "src1": 0.10, "src2": 0.10}


def query(spark, sf_dir):
    """op10: the whole of documents, mixed; every copy with its whole text."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGETS)


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
targets(source, w) AS (VALUES ('src0', 0.15::DOUBLE), ('src1', 0.10::DOUBLE), ('src2', 0.10::DOUBLE)),
given AS (SELECT n.source, n.n, w FROM n LEFT JOIN targets USING (source)),
all_rows AS (SELECT sum(n)::DOUBLE AS all_n, greatest(1, coalesce(sum(n) FILTER (w IS NULL), 0))::DOUBLE AS free_n FROM given),
rate AS (SELECT source, coalesce(w, (1.0::DOUBLE - (0.15::DOUBLE + 0.10::DOUBLE + 0.10::DOUBLE)) * n / free_n) * all_n / n AS r FROM given, all_rows),
part AS (SELECT source, greatest(1, ceil(r / 16))::BIGINT AS m, r / greatest(1, ceil(r / 16)) AS r FROM rate),
terms AS (SELECT source, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p FROM part, range(0, 105) AS t(k) WHERE k <= r + 12 * sqrt(r) + 40),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
thrown AS (SELECT d.doc_id, d.source, unnest(range(1, m + 1)) AS i FROM documents d JOIN part ON part.source IS NOT DISTINCT FROM d.source),
drawn AS (SELECT *, ('0x' || substr(md5('mix|' || doc_id || CASE WHEN i > 1 THEN '|' || i ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM thrown),
copied AS (SELECT doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM drawn.source AND c <= u)) AS copies FROM drawn GROUP BY doc_id),
counted AS (SELECT d.*, copies FROM documents d JOIN copied USING (doc_id))
SELECT doc_id, text, lang, source, n_chars, c.mix_copy::INTEGER AS mix_copy,
  ('0x' || substr(md5('mix-order|' || doc_id || '|' || c.mix_copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_key
FROM counted, LATERAL (SELECT unnest(range(1, copies::BIGINT + 1)) AS mix_copy) c
"""
