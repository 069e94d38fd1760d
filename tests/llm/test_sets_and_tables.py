"""Near-duplicates, url rules, top-k, sharding, mixing, the pipeline."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from curvemill.llm import mixing, neardup, sharding, topk, url_rules
from curvemill.session import scratch_path
from tests.llm.conftest import frame, prose


# near-duplicates

def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)])


def brute_classes(rows, least=0.8, weighted=False):
    ids, sets, parent = [i for i, _ in rows], [shingle_set(t) for _, t in rows], {}
    if not weighted:
        sets = [Counter(dict.fromkeys(s, 1)) for s in sets]

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            if common >= least * (sum(sets[i].values()) + sum(sets[j].values()) - common) - 1e-9:
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(n, edits, length=80, seed=0):
    """Copies of one text with 0..edits words changed: their similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = prose(seed + 100, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            w[at] = f"edit{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_classes_match_brute_force(make, weighting, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)  # so that bands are cut into several blocks
    texts = family(70, 6) + family(40, 4, 60, 5) + [prose(i, 50) for i in range(30)] + ["a b", "A  b", "", None, "x y z w"] + ["one two three four five " * 8, "one two three four five " * 9]
    rows = list(enumerate(texts))
    got = frame(neardup.classes(make([(i, t, None, None, None) for i, t in rows]), weighting=weighting))
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == brute_classes(rows, weighted=weighting == "count")


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    a[200:], b[:60] = 0, 0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    h = np.concatenate([names[a > 0], names[b > 0]])
    w = np.concatenate([a[a > 0], b[b > 0]])
    row = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    sig = neardup.signatures(h, w, row, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4096)
    alone = neardup.signatures(h[row == 1], w[row == 1], np.zeros((row == 1).sum(), int), 1, 4096)
    assert (alone[0] == sig[1]).all()  # darts don't depend on what else is in the batch


def test_classes_of_odd_rows(odd, none):
    got = frame(neardup.classes(odd))
    assert len(got) == odd.count()
    own = got.dropna().set_index("doc_id").class_id
    assert set(own[[1, 6]].values.ravel()) == {1} and set(own[[2, 3, 4]]) == {2} and own[5] == 5
    assert got[got.doc_id.isna()].class_id.isna().all()
    assert neardup.classes(none).count() == 0
    kept = frame(neardup.deduplicated(odd))
    assert kept.doc_id.isna().sum() == 1 and sorted(kept.doc_id.dropna()) == [1, 2, 5, 8]


def test_classes_are_the_same_however_hot_keys_are_split(make, monkeypatch):
    from curvemill.llm import _joins

    rows = [(i, " ".join(["base"] * (i % 3) + [f"w{(i // 40) * 7 + j}" for j in range(60)] + [f"end{i % 9}"])) for i in range(160)] + [(1000 + i, "same few") for i in range(400)]
    docs = make([(i, t, None, None, None) for i, t in rows])
    want = brute_classes(rows)
    for hot, pairs in ((1, 3), (10**9, 3), (50, 4096)):
        monkeypatch.setattr(_joins, "MAX_HOT", hot)
        monkeypatch.setattr(neardup, "PAIR_ROWS", pairs)
        got = frame(neardup.classes(docs, deviations=None if hot == 50 else 4.5))
        assert dict(zip(got.doc_id, got.class_id, strict=True)) == want


def test_spread_joins_pass_on_matches_only(spark, monkeypatch):
    """Most bands have one member and no row in the table: these must not go through a join of their own."""
    from curvemill.llm import _joins

    rows = spark.createDataFrame([(i % 4 if i < 300 else i, None if i % 50 == 0 else f"k{i % 4}", i) for i in range(500)], "a bigint, `b.c` string, i int")
    table = spark.createDataFrame([(k, f"k{k}", 75 if k else 1, 10 * k) for k in range(4)] + [(301, "k1", 1, 9), (None, "k0", 99, 1)], "a bigint, `b.c` string, members bigint, v int")
    kept = table.collect()
    want = sorted((r[0], r[1], r[2], t[3]) for r in rows.collect() for t in kept if None not in (r[0], r[1]) and r[:2] == t[:2])
    for hot in (20, 1, 10**9):
        monkeypatch.setattr(_joins, "MAX_HOT", hot)
        got = _joins.spread(rows, table, ["a", "b.c"])
        assert sorted(map(tuple, got.collect())) == want and got.columns == ["a", "b.c", "i", "v"]
        assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="same types"):
        _joins.spread(rows.withColumn("a", rows.a.cast("int")), table, ["a", "b.c"])


def test_rows_of_one_id_are_one_document(make):
    text = [prose(100 * k, 60) for k in range(4)]
    docs = make([(1, text[0], "en", "a", i) for i in range(3)] + [(2, text[0], "en", "a", 0), (7, text[1], "a", "b", 0), (7, text[2], "a", "b", 1), (3, text[1], "x", "b", 0), (4, text[2], "x", "b", 0), (9, text[3], "x", "b", 0)])
    got = frame(neardup.classes(docs))
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == {1: 1, 2: 1, 7: 3, 3: 3, 4: 3, 9: 9} and len(got) == 9
    kept = frame(neardup.deduplicated(docs))
    assert sorted(kept.doc_id) == [1, 3, 9] and kept.columns.tolist() == docs.columns


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "x bigint, y bigint")
    got = frame(neardup.components(links)).set_index("id").root
    assert (got[got.index <= 60] == 0).all() and got[101] == 100 and len(got) == 61


# url rules

def test_curated_rules_and_parts(make, spark):
    cases = [
        ("http://a.ORG/x", "a.org", "/x", "org/", "allow"),
        ("https://www.example.org/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12?q=/es/", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
        ("http://x.com/de/1#top", "x.com", "/de/1", "com/de/", "block"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.org?y", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("a://b/c://d/e", "b", "/c://d/e", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "extra") for i, c in enumerate(cases)], "page_id bigint, url string, rule string")
    got = frame(url_rules.judge(pages, spark.createDataFrame([], "url string, bad boolean"), url_rules.CONTRACT_RULES)).set_index("page_id")
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert tuple(got.loc[i, ["host", "path", "rule", "verdict"]]) == (host, path, rule, verdict)
    assert url_rules.judge(pages.limit(0), spark.createDataFrame([], "url string, bad boolean"), []).count() == 0


def test_mined_rules_match_brute_force(spark):
    rng = np.random.default_rng(3)
    urls = [f"http://{rng.choice(['a', 'b', 'bets'])}.site{rng.integers(4)}.{rng.choice(['net', 'com'])}/{rng.choice(['en', 'win', 'de'])}/{i}?ref={i}" for i in range(400)]
    bad = [("bets" in u and "/win/" in u) or rng.random() < 0.03 for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, map(bool, bad), strict=True)), "url string, bad boolean")
    rules = frame(url_rules.mine(labelled, min_support=0.02, min_confidence=0.8))
    tokens = frame(labelled.select("url", url_rules.tokens(labelled.url).alias("t"), "bad"))
    for r in rules.itertuples():
        fits = tokens.t.map(lambda t: set(r.items) <= set(t))
        assert fits.sum() and r.support == (fits & tokens.bad).sum() and abs(r.confidence - tokens.bad[fits].mean()) < 1e-12 and r.support >= 0.02 * 400
    hit = frame(url_rules.matched(labelled, url_rules.mine(labelled, min_support=0.02, min_confidence=0.8)))
    want = {u for u, t in zip(tokens.url, tokens.t, strict=True) if any(set(i) <= set(t) for i in rules["items"])}
    assert set(hit.url) == want and any("bets" in u for u in want)


def test_mined_rules_are_all_that_four_bad_rows_support(spark):
    """A fixed count of bad rows in a large input, and a label that is spread over hosts; all rules against all subsets of tokens."""
    urls = [f"http://{'www' if i % 2 else 'm'}.free-bets{'.net' if i % 3 else '.com'}/{'ab'[i % 2]}" for i in range(6)] + [f"http://spam.example.com/{i}/{'en' if i % 2 else 'de'}" for i in range(6)]
    urls += [f"http://{'www' if i % 2 else 'm'}.h{i % 400}.{'net' if i % 3 else 'com'}/{'ab'[i % 2]}" for i in range(12_000)]
    bad = [True] * 6 + [i < 4 for i in range(6)] + [False] * 12_000
    labelled = spark.createDataFrame(list(zip(urls, bad, strict=True)), "url string, bad boolean")
    rules = {tuple(r["items"]): (r["support"], r["confidence"]) for r in url_rules.mine(labelled).collect()}
    assert rules[("label=free-bets",)] == (6, 1.0) and rules[("host=spam.example.com",)] == (4, 4 / 6)
    rows = [(frozenset(t.t), t.bad) for t in labelled.select(url_rules.tokens(labelled.url).alias("t"), "bad").collect()]
    sets = {frozenset(c) for t, b in rows if b for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    few = Counter(rows)
    count = {c: (sum(n for (t, b), n in few.items() if b and c <= t), sum(n for (t, _), n in few.items() if c <= t)) for c in sets}
    good = {c: b / n for c, (b, n) in count.items() if b >= 4 and b / n >= 0.6}
    want = {c: v for c, v in good.items() if not any(x < c and good[x] >= v for x in good)}
    assert {frozenset(k): v[1] for k, v in rules.items()} == want


# top-k

def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-200, 200, (150, 40)), np.tile(rng.integers(-200, 200, 40), (60, 1))])
    rows = spark.createDataFrame([(int(i), [int(c) for c in x]) for i, x in enumerate(v)], "id bigint, vector array<bigint>")
    for k, block in ((5, 8192), (3, 32), (500, 64)):
        got = frame(topk.top_k(rows, rows.id % 10 == 0, k=k, block=block, query_block=4)).sort_values(["query_id", "rank"])
        for q, part in got.groupby("query_id"):
            score = v @ v[q]
            order = [i for i in np.lexsort((np.arange(len(v)), -score)) if i != q][:k]
            assert part.vec_id.tolist() == order and part.score.tolist() == score[order].tolist() and part["rank"].tolist() == list(range(1, len(order) + 1))


def test_top_k_leaves_out_unusable_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (50, [float("nan"), 1.0]), (51, None), (52, [None, 1.0]), (53, [-0.3, 0.999]), (100, [float("inf"), 0.0]), (54, [])], "vec_id bigint, e array<double>")
    good = rows.where(topk.usable(rows.e)).select(rows.vec_id.alias("id"), topk.quantised(rows.e).alias("vector"))
    got = frame(topk.top_k(good, good.id % 50 == 0))
    assert got.values.tolist() == [[0, 1, 53, 256 * math.floor(-0.3 * 256) + 512 * math.floor(0.999 * 256)]]
    assert topk.top_k(good.limit(0), good.id == 0).count() == 0


def test_top_k_sends_no_block_to_the_driver_and_copies_none(spark):
    """Blocks are far larger than what Spark estimates from the rows they are made of, so it must not choose to broadcast them."""
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, (300, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<bigint>").repartition(3)
    found = topk.top_k(rows, rows.id % 10 == 0, block=16, query_block=4)
    assert len(found.collect()) == 30 * 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


def test_top_k_of_several_dimensions_and_sizes_of_numbers(spark):
    rng = np.random.default_rng(6)
    v = [rng.integers(-hi, hi, dims).tolist() for hi, dims in ((100, 3), (2**20, 20), (2**28, 9), (1, 40)) for _ in range(60)] + [[]] * 3
    rows = spark.createDataFrame(list(enumerate(v)), "id bigint, vector array<bigint>").repartition(5)
    got = frame(topk.top_k(rows, rows.id % 3 == 0, k=4, block=7, query_block=5)).sort_values(["query_id", "rank"])
    assert got.query_id.nunique() == 81
    for q, part in got.groupby("query_id"):
        score = {i: sum(a * b for a, b in zip(x, v[q], strict=True)) for i, x in enumerate(v) if len(x) == len(v[q]) and i != q}
        order = sorted(score, key=lambda i: (-score[i], i))[:4]
        assert part.vec_id.tolist() == order and part.score.tolist() == [score[i] for i in order]


# sharding

def test_store_round_trip_and_versions(spark, odd):
    store = sharding.ShardStore(spark, scratch_path(spark, "t"), odd.schema)
    assert store.read().count() == 0
    for _ in range(5):
        store.append(odd.coalesce(1))
    assert store.versions() == [1, 2, 3, 4, 5]
    version = store.compact(target=1 << 30)
    assert version == 6 and len(store.shards()) == 1 and store.shards()[0].level == 1
    assert store.read(2).count() == 2 * odd.count()
    want = sorted(map(str, odd.collect() * 5))
    assert sorted(map(str, store.read().collect())) == want
    store.vacuum()
    assert store.versions() == [6] and sorted(map(str, store.read(shard="s").drop("s").collect())) == want
    with pytest.raises(sharding.Conflict):
        store.commit(6, [])
    assert store.compact(target=1 << 30) == 6


def test_plan_merges_similar_sizes_only():
    s = [sharding.Shard(f"p{i}", b, 0) for i, b in enumerate([10, 11, 12, 13, 1000, 1001, 5000])]
    assert [[x.bytes for x in g] for g in sharding.plan(s, target=4000)] == [[10, 11, 12, 13]]
    assert all(sum(x.bytes for x in g) <= 1.25 * 100 for g in sharding.plan([sharding.Shard(str(i), 30, 0) for i in range(20)], target=100))


def test_sharding_query_keeps_every_text(spark, sf):
    import hashlib

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = frame(sharding.query(spark, sf)).set_index("doc_id")
    assert got.text_sha256.to_dict() == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in zip(docs.doc_id, docs.text, strict=True)}


def test_arrivals_cover_all_rows(odd, none):
    assert sum(p.count() for p in sharding.arrivals(odd, 3)) == odd.count()
    assert sum(p.count() for p in sharding.arrivals(none, 3)) == 0


# mixing

def test_mixing_hits_its_targets(make):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(6000)]
    got = frame(mixing.mixed(make(rows), {"hot": 0.2, "s0": 0.3}, size=2.0))
    share = got.source.value_counts(normalize=True)
    assert abs(share["hot"] - 0.2) < 0.02 and abs(share["s0"] - 0.3) < 0.02 and abs(len(got) - 12000) < 500
    assert got.groupby("doc_id").mix_copy.apply(lambda c: sorted(c) == list(range(1, len(c) + 1))).all()


def test_mixing_rates_of_a_million_and_null_keys(make):
    from pyspark.sql import functions as F

    rare = make([(1, "x", "en", "rare", 1)] + [(i, "y", "en", "many", 1) for i in range(2, 1001)])
    got = mixing.mixed(rare, {"rare": 1.0}, size=1000.0)
    n = got.count()
    assert abs(n - 1_000_000) < 6 * 1000 and got.where("doc_id <> 1").count() == 0
    assert got.agg(F.countDistinct("mix_copy"), F.max("mix_copy")).first()[:] == (n, n)
    unkeyed = make([(None, f"text {i}", "en", "a", i) for i in range(1000)])
    assert 420 < mixing.mixed(unkeyed, {"a": 1.0}, size=0.5).count() < 580


def test_mixing_by_shuffled_rates_is_the_same(make, monkeypatch):
    docs = make([(i, f"t{i}", "en", None if i % 7 == 0 else f"s{i % 5}", 1) for i in range(400)])
    want = frame(mixing.mixed(docs, {"s1": 0.5}, size=3.0)).sort_values(["doc_id", "mix_copy"], ignore_index=True)
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 2)
    monkeypatch.setattr(mixing, "PARTITION_BYTES", 8)
    monkeypatch.setattr(mixing, "MAX_PARTITIONS", 9)
    path = scratch_path(docs.sparkSession, "docs")
    docs.write.parquet(path)
    got = frame(mixing.mixed(docs.sparkSession.read.parquet(path), {"s1": 0.5}, size=3.0)).sort_values(["doc_id", "mix_copy"], ignore_index=True)
    assert got.equals(want) and len(got) > 1000


def test_mixing_odd_and_empty(odd, none, make):
    from pyspark.sql import functions as F

    got = frame(mixing.mixed(odd.withColumn("mix_key", F.lit("clash")), {"a": 0.5}, size=50.0))
    assert got.source.isna().any() and got.doc_id.isna().any() and got.mix_key.dtype == float
    twice = got[got.doc_id == 6].mix_copy.value_counts()
    assert (twice == 2).all()  # repeated rows draw alike
    assert mixing.mixed(none, {"a": 0.5}).count() == 0
    big = frame(mixing.mixed(make([(1, "x", "en", "s", 1)]), {"s": 1.0}, size=2000.0))
    assert abs(len(big) - 2000) < 300


# the pipeline

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        before, docs = frame(docs), spark.read.parquet(path)
        seen[name] = (before, frame(docs))
    a, b = seen["toxicity"]
    gone = set(a.doc_id) - set(b.doc_id)
    clean = [i for i in labels.index[labels.toxic == 0] if i in set(a.doc_id)]
    assert len([i for i in clean if i in gone]) <= 0.05 * len(clean)
    a, b = seen["line_dedup"]
    assert set(a.doc_id) == set(b.doc_id) and sorted(b.columns) == sorted(corpus_pipeline.COLUMNS)
    a, b = seen["neardup"]
    classes = brute_classes(list(zip(a.doc_id, a.text, strict=True)))
    assert set(b.doc_id) == set(classes.values()) and len(b) == len(set(classes.values()))
    a, b = seen["mixing"]
    assert set(b.doc_id) <= set(a.doc_id)
    a, b = seen["packing"]
    assert Counter(b[b.start == 0].doc_id) == Counter(a.doc_id)
    per = b.groupby("sequence_id").length.sum()
    assert per.max() <= 2048
    lengths = defaultdict(int)
    for r in b.itertuples():
        lengths[r.doc_id] += r.length
    tokens = b[b.start == 0].groupby("doc_id").doc_tokens.sum()
    assert all(lengths[i] == tokens[i] for i in tokens.index)
