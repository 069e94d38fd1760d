"""A corpus pipeline of the llm operators: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents; other columns of documents aren't carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm import line_dedup, mixing, neardup, packing, toxicity
from curvemill.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores 0.5 or more go. Learnt from the labelled documents of this stage's input."""
    model = toxicity.trained_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text. Documents stay, those left without a line too."""
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least doc_id."""
    return neardup.deduplicated(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document has a row for each of its copies, in shuffled order."""
    return mixing.mixed(docs, mixing.TARGETS).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("neardup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learning, sketching and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
