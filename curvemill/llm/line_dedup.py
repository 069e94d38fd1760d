"""Line dedup: lines found in many documents lose all their copies.

One pass counts in how many documents each distinct line key occurs, by 128-bit
hashes. The keys that reach the threshold are indexed by a minimal perfect
hash, cut into shards by hash, each with a compact array of fingerprints and one
of counts, written to the shared folder. A second pass over the documents probes
these arrays: no line is ever joined or shuffled with its text, a line of
a third of all documents is one entry, and a task holds a bounded number of shards.

A key takes about 13 bytes. Every task reads every shard that its lines fall into, and nearly all distinct lines of a
corpus occur once or a few times and can drop nothing, so by default the index holds those counted ``min_docs`` times or more: a
corpus of 10**12 distinct lines would make 13 TB for each task to read, its frequent ones make a thousandth of that. With ``index_from=1`` all distinct lines
are indexed and the counts decide. A line that isn't indexed passes the 64-bit fingerprint test with a probability of 2**-64.
Lines are probed shard by shard for PROBE_BYTES of text at a time, so a task reads a shard once for so much text.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, written
from ._bytes import LOWER, Hasher, chunks, lines, mix, small_batches, stripped

#: Keys in a shard, on average.
SHARD_KEYS = 1 << 20
#: Bytes of shards that a task keeps loaded.
CACHE_BYTES = 96 << 20
#: Bytes of text whose lines are probed together.
PROBE_BYTES = 32 << 20
#: Bits for a key on each level of the perfect hash, and levels before the rest is kept sorted.
GAMMA, LEVELS = 2, 48


def line_keys(data: np.ndarray, offsets: np.ndarray, hashers: tuple[Hasher, Hasher]) -> tuple[np.ndarray, ...]:
    """Row, two hashes, length in code points, start and end of every line."""
    starts, ends, rows = lines(data, offsets)
    low = LOWER[data]
    a, b = stripped(low, starts, ends)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    return rows, hashers[0](low, a, b), hashers[1](low, a, b), chars[b] - chars[a], starts, ends


def _counting(text: str, min_chars: int):
    def count(batches):
        hashers = Hasher(1), Hasher(2)
        for _, data, offsets in chunks(batches, text):
            rows, one, two, size, _, _ = line_keys(data, offsets, hashers)
            use = size >= min_chars
            rows, one, two = rows[use], one[use], two[use]
            order = np.lexsort((rows, two, one))
            rows, one, two = rows[order], one[order], two[order]
            new_key = np.ones(len(one), bool)
            new_key[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            in_row = new_key.copy()
            in_row[1:] |= rows[1:] != rows[:-1]
            first = np.flatnonzero(new_key)
            n = np.add.reduceat(in_row, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(one[first].view(np.int64)), pa.array(two[first].view(np.int64)), pa.array(n)], names=["one", "two", "n"])

    return count


def line_counts(docs: DataFrame, *, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(one, two, n): for each distinct line key its two hashes and the number of documents it is in."""
    each = docs.select(text).mapInArrow(_counting(text, min_chars), "one bigint, two bigint, n bigint")
    return each.groupBy("one", "two").agg(F.sum("n").alias("n"))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: on each level the keys that are alone at their bit stay, the others go on.

    A key's index is the number of bits set before its own. ``rest`` holds the keys that no level parts (none but by chance).
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.starts = np.concatenate([[0], np.cumsum((sizes + 63) // 64)])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys ^ np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        sizes, words = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, GAMMA * len(keys))
            at = cls.place(keys, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[:size] = alone
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)), keys

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key of the built set; for any other key an index or -1."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.place(keys[left], level, size)
            word = self.starts[level] + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[hit]] = self.before[word[hit]] + np.bitwise_count(below[hit])
            left = left[~hit]
            if not len(left):
                break
        return found


class Shard:
    """The perfect hash with its fingerprint and count arrays, as one row of a table."""

    SCHEMA = "shard int, sizes binary, words binary, prints binary, counts binary, rest binary"

    @staticmethod
    def row(shard: int, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> dict:
        order = np.argsort(one, kind="stable")
        one, two, n = one[order], two[order], n[order]
        twin = np.zeros(len(one), bool)  # keys that share their first hash
        same = one[1:] == one[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        perfect, unparted = PerfectHash.build(one[~twin])
        rest = twin | np.isin(one, unparted)
        index = perfect(one[~rest])
        prints, counts = np.zeros(len(index), np.uint64), np.zeros(len(index), np.uint32)
        prints[index], counts[index] = two[~rest], np.minimum(n[~rest], 2**32 - 1)
        others = np.stack([one[rest], two[rest], n[rest].astype(np.uint64)])
        return {"shard": shard, "sizes": perfect.sizes.tobytes(), "words": perfect.words.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "rest": others.tobytes()}

    def __init__(self, row: dict):
        self.perfect = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
        self.prints, self.counts = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32)
        self.rest = np.frombuffer(row["rest"], np.uint64).reshape(3, -1)
        self.bytes = sum(len(v) for v in row.values() if isinstance(v, bytes))

    def count(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Documents that each key is in; 0 if it isn't indexed."""
        found = np.zeros(len(one), np.int64)
        if len(self.prints):
            at = self.perfect(one)
            own = (at >= 0) & (self.prints[at] == two)
            found[own] = self.counts[at[own]]
        for a, b, n in self.rest.T:
            found[(one == a) & (two == b)] = n
        return found


def shard_of(one: np.ndarray, n_shards: int) -> np.ndarray:
    return ((one >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)


def build_index(counts: DataFrame, *, min_docs: int) -> tuple[str, int]:
    """Write the shards of the keys found in ``min_docs`` documents or more; the folder and how many shards."""
    spark = counts.sparkSession
    frequent = written(counts.where(F.col("n") >= min_docs), "line-counts")
    n_shards = max(1, -(-frequent.count() // SHARD_KEYS))

    def build(key, part):
        columns = [part.column(c).to_numpy() for c in ("one", "two", "n")]
        row = Shard.row(key[0].as_py(), columns[0].view(np.uint64), columns[1].view(np.uint64), columns[2])
        return pa.table({k: pa.array([v], pa.int32() if k == "shard" else pa.binary()) for k, v in row.items()})

    shard = F.pmod(F.shiftrightunsigned("one", 32), F.lit(n_shards)).cast("int")
    folder = scratch_path(spark, "line-index")
    frequent.withColumn("shard", shard).groupBy("shard").applyInArrow(build, Shard.SCHEMA).withColumn("part", F.col("shard")).write.partitionBy("part").parquet(folder)
    return folder, n_shards


class Index:
    """Reads shards from the shared folder when they are probed; the least recently used leave.

    The folder may be any that pyarrow's file systems reach by its URI.
    """

    def __init__(self, folder: str, n_shards: int):
        from pyarrow import fs, parquet

        uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.select, self.read = fs.FileSelector, parquet.read_table
        self.n_shards, self.held, self.bytes, self.loads, self.turn = n_shards, OrderedDict(), 0, 0, 1

    def shard(self, k: int) -> Shard | None:
        if k not in self.held:
            infos = self.files.get_file_info(self.select(f"{self.path}/part={k}", allow_not_found=True))
            names = [i.path for i in infos if i.path.endswith(".parquet")]
            self.loads += 1
            rows = [r for p in names for r in self.read(self.files.open_input_file(p)).to_pylist()]
            self.held[k] = Shard(rows[0]) if rows else None
            self.bytes += self.held[k].bytes if rows else 0
            while self.bytes > CACHE_BYTES and len(self.held) > 1:
                _, old = self.held.popitem(last=False)
                self.bytes -= old.bytes if old else 0
        self.held.move_to_end(k)
        return self.held[k]

    def count(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found, at = np.zeros(len(one), np.int64), shard_of(one, self.n_shards)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        cuts = list(zip(first, [*first[1:], len(at)], strict=True))
        for a, b in cuts[:: self.turn]:
            mine = order[a:b]
            if shard := self.shard(int(at[mine[0]])):
                found[mine] = shard.count(one[mine], two[mine])
        self.turn = -self.turn  # the next probe begins with the shards that are held
        return found


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _probing(text: str, folder: str, n_shards: int, min_docs: int, min_chars: int):
    def probe(batches):
        hashers, index = (Hasher(1), Hasher(2)), Index(folder, n_shards)
        for held in _gathered(batches, PROBE_BYTES):
            # all lines of the held batches are probed at once, so that each shard is loaded once for them
            parts = [[line_keys(data, offsets, hashers) for _, data, offsets in chunks([batch], text)] for batch in held]
            counts = index.count(*(np.concatenate([p[i] for own in parts for p in own]) for i in (1, 2)))
            done = 0
            while held:
                batch, own, n_lines, n_dropped, kept = held.pop(0), parts.pop(0), [], [], []
                for (rows, _, _, size, starts, ends), (part, data, offsets) in zip(own, chunks([batch], text), strict=True):
                    drop = (counts[done : done + len(rows)] >= min_docs) & (size >= min_chars)
                    done += len(rows)
                    n_lines.append(np.bincount(rows, minlength=part.num_rows))
                    n_dropped.append(np.bincount(rows[drop], minlength=part.num_rows))
                    raw, first = data.tobytes(), np.searchsorted(rows, np.arange(part.num_rows + 1))
                    for i, n in enumerate(n_dropped[-1]):
                        if n:
                            kept.append(b"\n".join(raw[starts[j] : ends[j]] for j in range(first[i], first[i + 1]) if not drop[j]))
                        else:
                            kept.append(raw[offsets[i] : offsets[i + 1]])
                columns = list(batch.columns)
                columns[batch.schema.get_field_index(text)] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(n_lines)), pa.array(np.concatenate(n_dropped))], names=[*batch.schema.names, "n_lines", "n_dropped"])

    return probe


def dedup_lines(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, index_from: int | None = None) -> DataFrame:
    """docs with the text rid of frequent lines, plus n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased; a key of at least ``min_chars`` code points that is in at least
    ``min_docs`` documents loses all its lines. Null and empty texts are one
    empty line and come back empty. A line repeated within a document counts
    once. Every row is a document, so rows that share an id, and repeated rows, count each (SQL that counts distinct ids
    agrees where ids are distinct). Columns of docs named n_lines or n_dropped are replaced; other columns
    are kept as they are. An empty table gives no rows. index_from: documents that a key must be in to be indexed (``min_docs`` unless given).
    """
    small_batches(docs.sparkSession)
    own = docs.drop("n_lines", "n_dropped")
    folder, n_shards = build_index(line_counts(own, text=text, min_chars=min_chars), min_docs=min(min_docs, index_from or min_docs))
    schema = T.StructType([*own.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return own.mapInArrow(_probing(text, folder, n_shards, min_docs, min_chars), schema)


def query(spark, sf_dir):
    """op2: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, ord, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents)),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, f.key IS NOT NULL AS drop FROM lines l LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (drop))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
