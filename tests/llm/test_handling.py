"""Kept columns named like results, repeated ids: what each operator does with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.llm import langid, packing, quality, sharding, topk, toxicity

from .conftest import frame


def test_clashing_columns_give_way(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    lexicon = toxicity.Lexicon({}, toxicity.fixed_terms(toxicity.Hasher(8)))
    runs = {
        "score": lambda d: toxicity.scored(d, toxicity.Model(lexicon, 1.0, -1.0), keep=["doc_id", "score", "text"]),
        "lang_pred": lambda d: langid.predicted(d, langid.train(d), keep=["doc_id", "lang_pred", "__text"]),
        "n_words": lambda d: quality.judged(d, keep=["doc_id", "n_words", "good"]),
        "length": lambda d: packing.pieces(d, path, keep=["doc_id", "length", "__text"]),
    }
    for name, run in runs.items():
        for docs in (odd, none):
            clash = docs.withColumn(name, F.lit("mine")).withColumn("good", F.lit("mine")).withColumn("__text", F.lit("mine"))
            got = frame(run(clash))
            assert got.columns.is_unique and not (got[name] == "mine").any() and len(got) >= docs.count()


def test_a_repeated_query_id_asks_with_its_least_vector(spark):
    rows = [(0, [3, 1]), (0, [1, 5]), (1, [1, 1]), (2, [0, 2])]
    for order in (rows, rows[::-1]):
        v = spark.createDataFrame(order, "id bigint, vector array<bigint>").coalesce(1)
        got = frame(topk.top_k(v, F.col("id") == 0, k=2)).sort_values("rank")
        assert got.vec_id.tolist() == [2, 1] and got.score.tolist() == [10, 6]


def test_a_shard_column_must_not_hide_the_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mine")], "doc_id bigint, shard string")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", docs.schema)
    store.append(docs)
    assert frame(store.read())["shard"].tolist() == ["mine"]
    with pytest.raises(ValueError):
        store.read(shard="shard")
    assert np.all(frame(store.read(shard="file"))["file"].str.startswith("data/"))
