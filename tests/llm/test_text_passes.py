"""Operators that read whole texts: byte passes, line dedup, quality, language, toxicity, packing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from curvemill.llm import _bytes as by
from curvemill.llm import langid, line_dedup, packing, quality, toxicity
from tests.llm.conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def test_runs_and_lines_are_those_of_regex_and_split():
    texts = ["a b", "", " x ", None, "one\n\ntwo\n", "\n", "é b\x0bc"]
    for limit in (1, 5, 1 << 20):
        got_words, got_lines = [], []
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        for part, data, offsets in by.chunks([batch], "text", limit=limit):
            raw = data.tobytes()
            s, e, r = by.runs(~by.SPACE[data], offsets)
            got_words += [[raw[a:b].decode() for a, b, k in zip(s, e, r, strict=True) if k == i] for i in range(part.num_rows)]
            s, e, r = by.lines(data, offsets)
            got_lines += [[raw[a:b].decode() for a, b, k in zip(s, e, r, strict=True) if k == i] for i in range(part.num_rows)]
        assert got_words == [WORD.findall(t or "") for t in texts]
        assert got_lines == [(t or "").split("\n") for t in texts]


def test_hash_depends_on_the_stretch_alone():
    h = by.Hasher(1)
    data = np.frombuffer(b"abcXabcYabd", np.uint8)
    a = h(data, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert a[0] == a[1] != a[2]


# line dedup

def line_brute(texts: list, least: int):
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        for l in (t or "").split("\n"):
            seen[key(l)].add(i)
    out = []
    for t in texts:
        ls = (t or "").split("\n")
        kept = [l for l in ls if not (key(l) and len(seen[key(l)]) >= least)]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_matches_brute_force(make):
    rng = np.random.default_rng(0)
    pool = ["Shared line", " shared LINE\t", "Caf\u00e9", "CAF\u00c9", "x", "", "  ", "common\r", "rare"]
    texts = ["\n".join(rng.choice(pool, 6)) + f"\nown {i}" for i in range(60)] + [None, "", "\n"]
    got = frame(line_dedup.dedup_lines(make([(i, t, "en", "s", 1) for i, t in enumerate(texts)]), min_docs=20)).sort_values("doc_id")
    assert list(zip(got.n_lines, got.n_dropped, got.text, strict=True)) == line_brute(texts, 20)


def test_line_dedup_odd_and_empty(odd, none):
    from pyspark.sql import functions as F

    got = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("clash")), min_docs=2)
    assert got.count() == odd.count() and dict(got.dtypes)["n_lines"] == "bigint"
    assert frame(got).set_index("doc_id").loc[2, "text"] == ""
    assert line_dedup.dedup_lines(none).count() == 0


def test_perfect_hash_is_minimal_and_shards_find_twins():
    keys = by.mix(np.arange(5000, dtype=np.uint64))
    perfect, rest = line_dedup.PerfectHash.build(keys)
    assert not len(rest) and sorted(perfect(keys).tolist()) == list(range(5000))
    one = np.array([7, 7, 9], np.uint64)
    two, n = np.array([1, 2, 3], np.uint64), np.array([10, 20, 30], np.uint64)
    shard = line_dedup.Shard(line_dedup.Shard.row(0, one, two, n))
    assert shard.count(np.append(one, np.uint64(9)), np.append(two, np.uint64(4))).tolist() == [10, 20, 30, 0]


# quality

def quality_brute(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for l in (text or "").split("\n"):
        if WORD.search(l):
            dup += l in seen
            seen.add(l)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)]


def test_quality_columns_match_brute_force(spark, sf, odd):
    docs = documents(sf)
    got = frame(quality.query(spark, sf)).set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].tolist() == quality_brute(t)
    rows = frame(quality.features(odd, keep=["doc_id", "text"]))
    for r in rows.itertuples():
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == quality_brute(r.text)


def test_quality_keeps_clean_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = frame(quality.query(spark, sf)).merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    open_rows = got[~got.base_failed]
    assert open_rows[open_rows.quality_y == 1].kept.mean() > 0.98
    assert got[got.quality_y == 0].kept.mean() < 0.15


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    true = [0.95, 0.8, 0.65, 0.9]
    votes = np.stack([np.where(rng.random(len(good)) < 0.3, 0, np.where(rng.random(len(good)) < a, 1, -1) * np.where(good, 1, -1)) for a in true], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, accuracy, prior = quality.estimate(patterns, counts)
    assert np.abs(accuracy.mean(1) - true).max() < 0.03 and abs(prior - 0.7) < 0.03


def test_quality_of_an_empty_table(none):
    assert quality.judged(none).count() == 0


# language

def test_language_held_out_accuracy_and_und(spark, sf, odd, none):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(3, 1)))
    got = frame(langid.predicted(docs, model).withColumn("held_out", langid.held_out(3, 1))).merge(frame(docs.select("doc_id", "lang")), on="doc_id")
    test = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (test.lang == test.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    extra = frame(langid.predicted(odd, model)).set_index("doc_id")
    assert (extra.loc[[2, 3, 4], "lang_pred"] == "und").all()
    assert langid.predicted(none, model).count() == 0
    assert set(frame(langid.predicted(odd, langid.train(none))).lang_pred) == {"und"}


def test_codewords_are_apart():
    for n in (2, 4, 6, 12):
        code = langid.codewords(n, np.random.default_rng(0))
        assert len(np.unique(code, axis=0)) == n and (np.abs(code.sum(0)) < n).all()


# toxicity

def test_transducers_compose_to_products():
    """The composed automata give each word the product of what the five give alone, in both directions."""
    g = toxicity.grammar()
    parts = [toxicity.insult(), toxicity.threat(), toxicity.target(), toxicity.negation(), toxicity.report()]
    rng = np.random.default_rng(0)
    for _ in range(50):
        kind = rng.integers(0, 6, 12)
        clause = np.zeros(12, int)
        words, mask = toxicity.contexts(clause, kind, g)
        want = np.zeros(len(words), int)
        for i, p in enumerate(parts):
            own, alone = toxicity.contexts(clause, kind, p)
            assert own.tolist() == words.tolist()
            want |= alone << i
        assert mask.tolist() == want.tolist()
    assert g.table()[0, toxicity.INSULT] == g.table()[0, toxicity.THREAT] == 1 and not g.table()[:, [toxicity.OTHER, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT]].any()


def plain_total(kinds, weights, f):
    """A clause's score word by word, by positions and without automata."""
    total, n = 0.0, len(kinds)
    near = lambda i, c, before, after: any(kinds[j] == c for j in range(max(0, i - before), min(n, i + after + 1)) if j != i)
    for i, k in enumerate(kinds):
        if k in (toxicity.INSULT, toxicity.THREAT):
            x = weights[i]
            x *= f["insult"] if near(i, toxicity.INSULT, n, 0) else 1
            x *= f["threat"] if near(i, toxicity.THREAT, n, 0) else 1
            x *= f["target_insult" if k == toxicity.INSULT else "target_threat"] if near(i, toxicity.TARGET, 4, 2) else 1
            x *= f["negation"] if near(i, toxicity.NEGATION, 3, 2) else 1
            total += x * (f["report"] if near(i, toxicity.REPORT, n, n) else 1)
    return total


def test_the_automata_equal_an_independent_scorer():
    rng = np.random.default_rng(5)
    f = {"insult": 1.3, "threat": 1.7, "target_insult": 2.0, "target_threat": 2.5, "negation": 0.3, "report": 0.7}
    for _ in range(40):
        kind, clause = rng.integers(0, 6, 60), np.sort(rng.integers(0, 8, 60))
        clause = np.unique(clause, return_inverse=True)[1]
        rows, weight = clause // 3, rng.random(60)
        total, most, n = toxicity.clause_sums(rows, clause, kind, weight, toxicity.grammar(f), rows.max() + 1)
        each = [plain_total(kind[clause == c], weight[clause == c], f) for c in range(clause.max() + 1)]
        for r in range(rows.max() + 1):
            own = [x for c, x in enumerate(each) if c // 3 == r]
            assert abs(total[r] - sum(own)) < 1e-9 and abs(most[r] - max(own)) < 1e-9 and n[r] == sum(x > 0 for x in own)


def test_context_changes_verdicts(make, spark):
    """Denied, quoted and thrown insults, threats with and without an object, inflected; without the grammar's factors the verdicts differ."""
    h = by.Hasher(8)
    lexicon = toxicity.Lexicon({0: (toxicity.spelt(["moron"], h), np.array([2.0]))}, toxicity.fixed_terms(h))
    texts = {"a moron came": 1, "nobody here is not a moron": 0, "the paper wrote moron": 0, "we will kill you": 1, "you will be killed": 1, "time can kill": 0, "er wird dich vernichten": 1, "they killed nobody and never hurt": 0}
    docs = make([(i, t, None, None, None) for i, t in enumerate(texts)])
    model = toxicity.Model(lexicon, 4.0, -3.6)
    got = frame(toxicity.scored(docs, model)).set_index("doc_id").score >= 0.5
    flat = frame(toxicity.scored(docs, toxicity.Model(lexicon, 4.0, -3.6, dict.fromkeys(toxicity.FACTORS, 1.0)))).set_index("doc_id").score >= 0.5
    assert got.tolist()[:7] == [bool(x) for x in list(texts.values())[:7]]
    assert (got != flat).sum() >= 4


def test_factors_are_fitted_where_labels_tell(make, spark):
    """Reported insults are never labelled toxic here, so their factor falls; no document has a negation, so its factor stays."""
    rng = np.random.default_rng(8)
    filler = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 300, n))
    rows = [(i, filler(30) + (". grubwort. " if i % 4 == 0 else ". paper wrote grubwort. " if i % 32 == 1 else ". ") + filler(20), "en", "s", 1) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id bigint, toxic int")
    model = toxicity.trained_on(make(rows), labels)
    assert model.factors["report"] < 0.6 and model.factors["negation"] == 0.5
    got = frame(toxicity.scored(make(rows), model)).set_index("doc_id").score >= 0.5
    assert got.tolist() == [i % 4 == 0 for i in got.index]


def test_clauses_are_scored_in_context(make, spark):
    h = by.Hasher(8)
    key = toxicity.spelt(["moron"], h)
    lexicon = toxicity.Lexicon({0: (key, np.array([2.0]))}, toxicity.fixed_terms(h))
    model = toxicity.Model(lexicon, 1.0, -1.0)
    texts = ["moron here", "you moron", "he is not a moron", "She said moron.", "said so. moron", None, ""]
    got = frame(toxicity.scored(make([(i, t, None, None, None) for i, t in enumerate(texts)]), model)).set_index("doc_id").total.tolist()
    assert np.allclose(got, [2, 3, 2 * 1.5 * 0.5, 2 * 1.5 * 0.6, 2, 0, 0])


def test_toxicity_learns_from_labels(make, spark, odd, none):
    rows = [(i, prose(i, 40) + (" grubwort! " if i % 4 == 0 else ". ") + prose(i + 500, 20), "en", "s", 1) for i in range(200)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    model = toxicity.trained_on(docs, labels)
    got = frame(toxicity.scored(docs, model)).set_index("doc_id").score >= 0.5
    assert got.tolist() == [i % 4 == 0 for i in got.index]
    assert toxicity.scored(odd, model).count() == odd.count()
    assert toxicity.scored(none, model).count() == 0
    blank = toxicity.trained_on(none, labels)
    assert (frame(toxicity.scored(odd, blank)).score < 0.5).all()


def test_toxicity_learns_words_of_a_rare_language(make, spark):
    """Twenty of 1,500 toxic documents have their own insult; near copies of one toxic document don't make its words insults."""
    rows = [(i, prose(i, 20) + (" grubwort " if i < 1480 else " zotenfink ") + prose(i + 900, 10), "en", "s", 1) for i in range(1500)]
    rows += [(i, prose(i, 30), "en", "s", 1) for i in range(1500, 3000)]
    rows += [(4000 + i, prose(5000, 30) + " harmlos schlicht " + prose(5001, 30) + f" last{i} grubwort", "en", "s", 1) for i in range(30)]
    docs = make(rows)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1500 or r[0] >= 4000)) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs.join(labels, "doc_id"))
    got = frame(toxicity.scored(docs, model)).set_index("doc_id").score >= 0.5
    assert got[got.index < 1500].all() and not got[(got.index >= 1500) & (got.index < 3000)].any()
    other = frame(toxicity.scored(make([(1, "harmlos schlicht", "en", "s", 1), (2, "zotenfink", "en", "s", 1)]), model)).set_index("doc_id").total
    assert other[1] == 0 and other[2] > 0


# packing

def test_tokens_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["It's a test, isn't it? 12345 ab12", "CAF\u00c9 na\u00efve \u00df\u00d7\u00f7 \u00a0x", "\u4f60\u597d \U0001f600 e\u0301 \u0130\u03a3", "a\x00b \x1c c\x7f", "<|endoftext|> x", "", None, prose(4, 3000), "don't\nI'LL 're 'S \u2028 q"]
    coder = packing.WordTokenizer(path)
    for _ in range(2):  # the second time from the cache
        data, offsets = by.buffers(pa.array(texts))
        ids, edges = coder.encode(data, offsets)
        for i, t in enumerate(texts):
            assert ids[edges[i] : edges[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids + [1], t


def test_best_fit_is_the_tightest_window():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 65, 200)
        place, offset = packing.best_fit(sizes, 64)
        free = []
        want = np.zeros(200, int)
        for i in np.argsort(-sizes, kind="stable"):
            fit = [w for w in range(len(free)) if free[w] >= sizes[i]]
            if not fit:
                free.append(64)
                fit = [len(free) - 1]
            w = min(fit, key=lambda w: free[w])
            free[w] -= sizes[i]
            want[i] = w
        used = np.bincount(place, weights=sizes)
        assert used.max() <= 64 and len(used) == len(free) and sorted(used) == sorted(64 - np.array(free))
        for w in range(len(used)):
            mine = np.argsort(offset[place == w])
            assert (offset[place == w][mine] == np.concatenate([[0], np.cumsum(sizes[place == w][mine])[:-1]])).all()


def test_packing_is_whole_and_dense(spark, sf, odd, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    for docs, rows in ((spark.read.parquet(f"{sf}/documents.parquet"), 200), (odd, odd.count())):
        got = frame(packing.pack_documents(docs, path))
        for _, seq in got.sort_values("offset").groupby("sequence_id"):
            assert seq.offset.tolist() == np.concatenate([[0], np.cumsum(seq.length)[:-1]]).tolist() and seq.length.sum() <= 2048
        assert (got.ids.map(len) == got.length * 4).all()
        assert got.length.sum() == got[got.start == 0].doc_tokens.sum()
    fill = got.groupby("sequence_id").length.sum()
    assert len(fill) >= 1
    assert packing.pack_documents(none, path).count() == 0


def test_packing_query_digests(spark, sf):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    docs = documents(sf).set_index("doc_id").text
    got = frame(packing.query(spark, sf))
    for r in got.sample(60, random_state=1).itertuples():
        ids = np.array(tok.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens


@pytest.mark.parametrize("name", ["op2_line_dedup", "op8_topk", "op10_mixing", "url_rules_curated"])
def test_queries_match_their_sql(spark, sf, name):
    from curvemill.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(registry.ORACLES[name]).df(), frame(registry.QUERIES[name](spark, sf))
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values([c for c in ("page_id", "doc_id", "query_id", "rank", "mix_copy") if c in cols]).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert (a[c].astype(str) == b[c].astype(str)).all() if a[c].dtype == object else np.allclose(a[c], b[c], atol=1e-12), c


def test_digest_of_an_unchanged_text(spark, sf):
    docs = documents(sf).set_index("doc_id").text
    got = frame(line_dedup.query(spark, sf))
    for r in got[got.n_dropped == 0].itertuples():
        assert r.kept_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_many_shards_and_a_small_cache(spark, sf, monkeypatch):
    """All distinct lines indexed in some hundred shards of which two are held: the same lines go, and a shard is read once a probe."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    want = frame(line_dedup.dedup_lines(docs)).sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    monkeypatch.setattr(line_dedup, "CACHE_BYTES", 2000)
    monkeypatch.setattr(line_dedup, "PROBE_BYTES", 1 << 18)
    got = frame(line_dedup.dedup_lines(docs, index_from=1)).sort_values("doc_id", ignore_index=True)
    assert got.equals(want) and want.n_dropped.sum() > 0
    folder, n_shards = line_dedup.build_index(line_dedup.line_counts(docs), min_docs=1)
    index, rng = line_dedup.Index(folder, n_shards), np.random.default_rng(1)
    assert n_shards > 20
    for probes in (1, 2, 3):
        keys = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
        assert not index.count(*keys).any() and index.loads <= probes * n_shards
        assert sum(s is not None for s in index.held.values()) <= 3


def test_rows_of_one_id_are_packed_in_many_groups(make):
    """A group's size doesn't depend on ids; every id lies in one piece, full windows too."""
    from pyspark.sql import functions as F

    parts = make([(7, 0, 1 + i % 2048) for i in range(4000)], "doc_id bigint, start bigint, length bigint").coalesce(2)
    got = packing.packed(parts, 4000, group_rows=500)
    groups = got.groupBy(F.shiftright("sequence_id", 32)).count().toPandas()["count"]
    assert len(groups) == 8 and groups.max() < 650 and groups.sum() == 4000
    per = frame(got).groupby("sequence_id").length.sum()
    assert per.max() <= 2048 and per.sum() == sum(1 + i % 2048 for i in range(4000)) and len(per) < 1.05 * per.sum() / 2048
