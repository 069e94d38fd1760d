"""Quality rules under weak supervision.

Each rule looks at a document and votes good, bad or abstains. Nobody labels
anything: expectation-maximisation (Dawid and Skene 1979, with abstention as
in data programming) estimates how accurate each rule is from how the rules
agree, and the posterior probability of good quality replaces "must pass every
rule". The estimate only needs the counts of the vote patterns, at most
3**rules rows whatever the corpus, so the text is read once and EM runs on the
driver over counts of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from ._bytes import LETTER, SPACE, Hasher, _table, chunks, counted, kept, lines, mix, runs, small_batches, unused, windows

SYMBOLS = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
DIGIT = _table(b"0123456789")
STOP = _table(b".!?")
SHOUT = _table(b"!^~_=@")
#: Words in the windows whose repetition counts.
WINDOW = 8

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_stops", "n_bare", "n_marked"]

#: Columns of the result besides the kept ones.
RESULTS = [*FEATURES, "votes", "quality", "good"]


def measure(data: np.ndarray, offsets: np.ndarray, hashers: tuple[Hasher, Hasher]) -> dict[str, np.ndarray]:
    """FEATURES of each row of a buffer."""
    n = len(offsets) - 1
    word = ~SPACE[data]
    starts, ends, rows = runs(word, offsets)
    sums = hashers[0].prefix(data)
    keys = hashers[0].of(sums, starts, ends)

    def distinct(k: np.ndarray, r: np.ndarray) -> np.ndarray:
        """1 at each first of equal (row, key) pairs, in sorted order; the order; both as a mask in place."""
        tagged = mix(k ^ (r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(tagged, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = tagged[order][1:] != tagged[order][:-1]
        return order, first

    order, first = distinct(keys, rows)
    n_distinct = np.bincount(rows[order[first]], minlength=n)

    hashes, at = windows(keys, rows, WINDOW)
    order, first = distinct(hashes, rows[at])
    twice = ~first
    twice[:-1] |= ~first[1:]
    cover = np.zeros(len(keys) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, np.minimum(hit + WINDOW, len(keys)), -1)
    repeat = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)

    a, b, r = lines(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=solid[1:])
    full = solid[b] > solid[a]
    order, first = distinct(hashers[1](data, a[full], b[full]), r[full])
    dup_lines = np.bincount(r[full][order[~first]], minlength=n)

    stop_end = STOP[data[ends - 1]] if len(ends) else np.zeros(0, bool)

    def holding(mask: np.ndarray) -> np.ndarray:
        """Words with a byte of the mask."""
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] > sums[starts]

    bare, marked = ~holding(LETTER[data] | DIGIT[data]), holding(SYMBOLS[data] | SHOUT[data])
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": counted(word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": counted(SYMBOLS[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "n_distinct_words": n_distinct,
        "n_lines": np.bincount(r[full], minlength=n),
        "n_letters": counted(LETTER[data] & ((data & 0xC0) != 0x80), offsets),
        "n_upper": counted(UPPER[data], offsets),
        "n_digits": counted(DIGIT[data], offsets),
        "n_stops": np.bincount(rows[stop_end], minlength=n),
        "n_bare": np.bincount(rows[bare], minlength=n),
        "n_marked": np.bincount(rows[marked], minlength=n),
    }


def features(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and FEATURES (bigint) of every document. A null text has no words; a kept column named like a result column gives way to it."""
    small_batches(docs.sparkSession)
    keep = kept(keep, RESULTS)
    hidden = unused("__text", keep)

    def run(batches):
        hashers = Hasher(3), Hasher(4)
        for part, data, offsets in chunks(batches, hidden):
            found = measure(data, offsets, hashers)
            columns = [part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(found[c].astype(np.int64)) for c in FEATURES]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *FEATURES])

    own = docs.select(*keep, F.col(text).alias(hidden))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in FEATURES])
    return own.mapInArrow(run, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name and vote (1 good, -1 bad, 0 abstains) of each rule, over FEATURES."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1))
    mean, symbols, repeat = c("word_chars") / words, c("n_symbols") / words, c("n_repeat_words") / words
    dup, upper = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    letters, variety, per_stop = c("n_letters") / F.greatest(c("word_chars"), F.lit(1)), c("n_distinct_words") / words, words / F.greatest(c("n_stops"), F.lit(1))
    long = c("n_words") >= 50
    return {
        "length": _vote(c("n_words") < 20, long),
        "word_length": _vote((mean < 2.5) | (mean > 14), (mean >= 3) & (mean <= 10)),
        "symbols": _vote(symbols > 0.1, long & (symbols < 0.02)),
        "repeats": _vote(repeat > 0.2, long & (repeat < 0.05)),
        "dup_lines": _vote((c("n_lines") >= 3) & (dup > 0.3), (c("n_lines") >= 3) & (dup < 0.1)),
        "capitals": _vote((c("n_letters") >= 40) & (upper > 0.4), (c("n_letters") >= 40) & (upper < 0.15)),
        "letters": _vote((letters < 0.6) | long & (letters < 0.9), long & (letters > 0.93)),
        "bare_words": _vote(long & (c("n_bare") / words > 0.1), long & (c("n_bare") / words < 0.02)),
        "marked_words": _vote(c("n_marked") / words > 0.2, long & (c("n_marked") / words < 0.05)),
        "variety": _vote(long & (variety < 0.15), long & (variety > 0.3)),
        "sentences": _vote(long & (per_stop > 120) | long & (per_stop < 1.5), long & (per_stop >= 3) & (per_stop <= 60)),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, *, start: float = 0.75, prior: float = 0.8, steps: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, accuracies (rules x 2: when bad, when good), prior) by EM.

    votes: patterns x rules of 1, -1, 0. An abstention says nothing. Counts of
    one vote each way are added, and a rule's accuracies stay at 0.5 or more
    on average, so that good and bad can't trade places.
    """
    counts = counts.astype(float)
    accuracy = np.full((votes.shape[1], 2), start)
    posterior = np.full(len(votes), prior)
    for _ in range(steps):
        good = np.where(votes == 1, np.log(accuracy[:, 1]), np.where(votes == -1, np.log1p(-accuracy[:, 1]), 0)).sum(1) + np.log(prior)
        bad = np.where(votes == -1, np.log(accuracy[:, 0]), np.where(votes == 1, np.log1p(-accuracy[:, 0]), 0)).sum(1) + np.log1p(-prior)
        new = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        w_good, w_bad = counts * new, counts * (1 - new)
        prior = float(np.clip((w_good.sum() + 8) / (counts.sum() + 10), 0.01, 0.99))
        for k, (w, right) in enumerate(((w_bad, -1), (w_good, 1))):
            yes, cast = ((votes == right) * w[:, None]).sum(0), ((votes != 0) * w[:, None]).sum(0)
            accuracy[:, k] = (yes + start) / (cast + 1)
        accuracy = np.clip(accuracy, 0.02, 0.999)
        weak = accuracy.sum(1) < 1
        accuracy[weak] = 0.5
        moved, posterior = np.abs(new - posterior).max(initial=0), new
        if moved < tol:
            break
    return posterior, accuracy, prior


def judged(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5, decided: Column | None = None) -> DataFrame:
    """Kept columns, FEATURES, ``quality`` (posterior, 0 to 1) and ``good`` of every document.

    decided: a condition on FEATURES under which a document's fate is settled elsewhere; EM then learns from the
    others, as two classes can't describe both what is settled and what isn't.

    Null and empty texts have no words: the length rule votes bad. Repeated
    rows are judged alike, each counts in EM. An empty table gives no rows.
    """
    named = rules()
    seen = written(features(docs, text=text, keep=keep).select("*", F.struct(*(v.cast("tinyint").alias(k) for k, v in named.items())).alias("votes")), "quality")
    open_row = F.lit(1) if decided is None else F.when(decided, 0).otherwise(1)
    patterns = seen.groupBy("votes").agg(F.sum(open_row).alias("n")).collect()  # at most 3 ** rules
    votes = np.array([[r["votes"][k] for k in named] for r in patterns], dtype=int).reshape(len(patterns), len(named))
    posterior, _, _ = estimate(votes, np.array([r["n"] for r in patterns], dtype=float))
    known = docs.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(patterns, posterior, strict=True)], T.StructType([seen.schema["votes"], T.StructField("quality", T.DoubleType())]))
    return seen.join(F.broadcast(known), "votes").withColumn("good", F.col("quality") >= threshold)


def query(spark, sf_dir):
    """op7: all documents."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), decided=base)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("good")).alias("kept"), "quality")
