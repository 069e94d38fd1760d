"""Language identification by error-correcting output codes.

Every language gets a binary codeword; for each bit a logistic classifier over
hashed byte n-grams says which half of the languages a text belongs to. The
prediction is the language whose codeword has the least loss, each bit
weighted by how reliable its classifier was; a second language nearly as close
flags the text as ambiguous. n-grams of whole texts are counted by numpy over
a batch's bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import CHUNK, LETTER, LOWER, chunks, counted, kept, small_batches, unused

#: Hash buckets of the n-grams.
BUCKETS = 4096
#: The classifiers are fitted on at most about this many labelled documents, the same number of each language.
SAMPLE_ROWS = 3000
#: Rows of one numpy pass: its counts take BUCKETS * 4 bytes a row.
PASS_ROWS = 512


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of hashed byte 2- and 3-grams of each row (rows x buckets, unit length).

    A-Z is lower-cased; ASCII bytes other than letters are one space, and runs of them count once.
    """
    n, low = len(offsets) - 1, LOWER[data]
    low = np.where(LETTER[data], low, np.uint8(32))
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    use = np.ones(len(low), bool)
    use[1:] = (low[1:] != 32) | (low[:-1] != 32) | (row[1:] != row[:-1])
    low, row = low[use].astype(np.uint64), row[use]
    out = np.zeros(n * buckets, np.float64)
    for width in (2, 3):
        m = len(low) - width + 1
        if m <= 0:
            continue
        code = np.full(m, np.uint64(width), np.uint64)
        for j in range(width):
            code = code * np.uint64(0x100000001B3) ^ low[j : m + j]
        bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
        same = row[:m] == row[width - 1 :]
        out += np.bincount(row[:m][same] * buckets + bucket[same].astype(np.int64), minlength=len(out))
    counts = out.reshape(n, buckets)
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def codewords(n: int, rng: np.random.Generator) -> np.ndarray:
    """n x bits of 1 and -1: all ways to part the classes for up to 6 of them, else random ones of large least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        parts = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(parts, dtype=float).T
    bits, best, least = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        split = np.abs(code.sum(0)).max() < n
        if split and apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """rows x languages: the weighted logistic loss of each codeword."""
        margin = x @ self.weights + self.bias
        agree = margin[:, None, :] * self.code[None]
        return (np.logaddexp(0, -agree) * self.trust).sum(2)

    def decode(self, x: np.ndarray, gap: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, probability, ambiguous: the runner-up's loss is within ``gap``)."""
        loss = self.losses(x)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        odds = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = 1 / odds.sum(1)
        close = np.sort(loss, axis=1)
        return best, score, (close[:, 1] - close[:, 0] < gap) if loss.shape[1] > 1 else np.zeros(len(x), bool)


def fit(x: np.ndarray, languages: list[str], y: np.ndarray, *, steps: int = 300, rate: float = 8.0, decay: float = 1e-5) -> Model:
    """One logistic classifier for each bit, by gradient descent with momentum; trust is the log odds of a bit being right on the fifth held back."""
    code = codewords(len(languages), np.random.default_rng(7))
    target = (code[y] + 1) / 2
    tested = np.arange(len(x)) % 5 == 4

    def descend(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        a, t = x[rows].astype(float), target[rows]
        for _ in range(steps if len(a) else 0):
            err = 1 / (1 + np.exp(-np.clip(a @ w + b, -60, 60))) - t
            vw = 0.9 * vw - rate * (a.T @ err / len(a) + decay * w)
            vb = 0.9 * vb - rate * err.mean(0)
            w, b = w + vw, b + vb
        return w, b

    w, b = descend(~tested)
    right = ((x[tested] @ w + b > 0) == (target[tested] > 0.5)).sum(0) if tested.any() else np.zeros(code.shape[1])
    share = (right + 1) / (tested.sum() + 2)
    trust = np.maximum(0.05, np.log(share / (1 - share)))
    w, b = descend(np.ones(len(x), bool))
    return Model(languages, code, w.astype(np.float32), b.astype(np.float32), trust / trust.mean())


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample by hash of the key, about sample_rows / languages of each language; whole texts are read.

    Rows with a null text or language take no part.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    each = sample_rows / len(languages)
    share = F.create_map(*(F.lit(v) for k in languages for v in (k, each / counts[k])))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit("lang|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    chosen = rows.where(unit < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for part, data, offsets in chunks(batches, "text", rows=PASS_ROWS):
            x = ngrams(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    got = sorted(chosen.mapInArrow(count, "lang string, x binary").collect(), key=lambda r: (r["lang"], bytes(r["x"])))
    got = [got[i] for i in np.random.default_rng(11).permutation(len(got))]
    languages = sorted({r["lang"] for r in got})
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]) if got else np.zeros((0, BUCKETS), np.float32)
    return fit(x, languages, np.array([languages.index(r["lang"]) for r in got], dtype=int))


def predicted(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, lang_pred, score (0 to 1), ambiguous of every document.

    A text that is null or without letters (ASCII letters, or letters beyond ASCII) is ``und`` with score 0, as is
    every text of a model without languages. Of languages as near the alphabetically first is predicted. Repeated rows are predicted alike, an
    empty table gives no rows, and a kept column named like a result column gives way to it.
    """
    keep = kept(keep, ["lang_pred", "score", "ambiguous"])
    hidden = unused("__text", keep)
    small_batches(docs.sparkSession)
    names = np.array([*model.languages, "und"], dtype=object)

    def run(batches):
        for part, data, offsets in chunks(batches, hidden, limit=CHUNK // 2, rows=PASS_ROWS):
            letters = counted(LETTER[data], offsets) > 0
            odd = np.flatnonzero(letters & (counted(LETTER[data] & (data < 128), offsets) == 0))
            if len(odd):  # beyond ASCII not all is letters
                raw = data.tobytes()
                letters[odd] = [any(ch.isalpha() for ch in raw[offsets[i] : offsets[i + 1]].decode()) for i in odd]
            if model.languages:
                best, score, close = model.decode(ngrams(data, offsets))
            else:
                best, score, close = (np.zeros(part.num_rows, t) for t in (int, float, bool))
                letters[:] = False
            best, score = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0)
            columns = [part.column(i) for i in range(len(keep))]
            columns += [pa.array(names[best].tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.array(close & letters)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "ambiguous"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.select(*keep, F.col(text).alias(hidden)).mapInArrow(run, schema)


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def query(spark, sf_dir):
    """op9: learns from the documents whose crc32 mod 3 is not 1, predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(3, 1)))
    return predicted(docs, model).withColumn("held_out", held_out(3, 1)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
