"""Packing token sequences by best-fit decreasing.

Documents become token ids; those longer than a window are first cut into full
windows, and what is left of each (plus all shorter ones) is placed, longest
first, into the open window that it fills most tightly. A segment tree over
remaining capacities finds that window in O(log window) steps.

Pieces are dealt row by row, whatever their ids, into groups of about GROUP_ROWS rests; each group is
packed on its own, so a group's state is bounded and no order over all
documents is needed. A group leaves a window or two that aren't full, among
hundreds or thousands.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import SPACE, Hasher, chunks, kept, runs, small_batches, unused

WINDOW = 2048
#: Id after each document's own.
END_ID = 1
GROUP_ROWS = 4096
#: Columns that a piece has besides the kept ones.
PIECES = ("start", "length", "ids", "doc_tokens")
#: Distinct words whose ids a task keeps; then it starts anew.
CACHE_WORDS = 500_000

#: How the tokenizer file splits a lower-cased text into the units that its merges work on, and its mark of a unit's end.
UNIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_MARK = "</w>"


def _byte_of() -> dict[str, int]:
    """The usual spelling of bytes as printable characters in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of texts by a word-level BPE file, equal to the tokenizers library's, an order faster on a corpus.

    White space parts words and never lies in a token, so each distinct word is
    encoded once. Words of plain ASCII and letters U+00C0 to U+00FF (unchanged
    by NFC, lower-cased alike everywhere) go through tiktoken with the same
    merges, a unit's end spelt as a space; all others through the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of()

        def spelt(token: str) -> bytes:
            ended = token.endswith(END_MARK)
            return bytes(byte_of[c] for c in (token[: -len(END_MARK)] if ended else token)) + b" " * ended

        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b, 32]): 256 + b for b in range(256) if b != 32}
        for n, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(spelt(left + right), 512 + n)
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.full(512 + len(model["merges"]), -1, np.int64)
        self.ends = np.zeros(len(self.id_of), bool)
        for token, k in model["vocab"].items():
            if all(c in byte_of for c in token.removesuffix(END_MARK)) and (rank := ranks.get(spelt(token))) is not None:
                self.id_of[rank], self.ends[rank] = k, token.endswith(END_MARK)
        self.path, self.slow, self.unit, self.hasher = path, None, regex.compile(UNIT), Hasher(5)
        self.odd, self.mark = np.ones(256, bool), np.ones(256, bool)
        self.odd[33:127] = self.odd[0xC3] = self.odd[0x80:0xC0] = False
        self.mark[65:91] = self.mark[97:123] = self.mark[0x80:0xC0] = self.mark[0xC3] = False
        self._clear()

    def _clear(self) -> None:
        # word 0 is a document's end
        self.slot, self.start, self.size, self.flat, self.used = {}, np.zeros(1024, np.int64), np.ones(1024, np.int64), np.full(4096, END_ID, np.uint32), 1

    def _fast(self, text: str, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word's): text is lower-cased units, each followed by a space; units: how many each word has."""
        ranks = np.array(self.fast.encode_ordinary(text), np.int64)
        last = np.flatnonzero(self.ends[ranks])[np.cumsum(units) - 1] + 1
        return self.id_of[ranks].astype(np.uint32), np.diff(last, prepend=0)

    def _words(self, words: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of each word's). kind: 0 of letters only, so one unit each; 1 plain; 2 any."""
        if kind == 0:
            return self._fast(b" ".join(words).decode().lower() + " ", np.ones(len(words), int))
        text = [w.decode() for w in words]
        if kind == 1:
            units = [self.unit.findall(w.lower()) for w in text]
            return self._fast("".join(" ".join(u) + " " for u in units), np.array([len(u) for u in units]))
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        found = [e.ids for e in self.slow.encode_batch_fast(text, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _learn(self, keys: list[int], words: list[bytes], kind: int) -> None:
        if not keys:
            return
        ids, sizes = self._words(words, kind)
        first, end = len(self.slot) + 1, self.used + len(ids)
        while first + len(keys) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = ids
        self.size[first : first + len(keys)] = sizes
        self.start[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.slot.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.used = end

    def _kinds(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        mark = self.mark[data]
        mark[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the two signs among the letters
        within = []
        for flag in (mark, self.odd[data]):
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(flag, out=sums[1:])
            within.append(sums[ends] > sums[starts])
        return np.where(within[1], 2, np.where(within[0], 1, 0))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in turn, each row's closed by END_ID; where each row's begin and the last ends)."""
        starts, ends, rows = runs(~SPACE[data], offsets)
        keys, first, back = np.unique(self.hasher(data, starts, ends), return_index=True, return_inverse=True)
        names = keys.tolist()
        if len(self.slot) + len(names) > CACHE_WORDS:
            self._clear()
        new = np.array([i for i, k in enumerate(names) if k not in self.slot], np.int64)
        if len(new):
            raw, a, b = data.tobytes(), starts[first[new]], ends[first[new]]
            kinds = self._kinds(data, a, b)
            for kind in (0, 1, 2):
                own = np.flatnonzero(kinds == kind)
                self._learn([names[i] for i in new[own]], [raw[i:j] for i, j in zip(a[own].tolist(), b[own].tolist(), strict=True)], kind)
        slots = np.array([self.slot[k] for k in names], np.int64)[back] if names else np.zeros(0, np.int64)
        n = len(offsets) - 1
        slots = np.insert(slots, np.searchsorted(rows, np.arange(n), side="right"), 0)  # each row's end
        sizes = self.size[slots]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.start[slots] - before, sizes) + np.arange(int(sizes.sum()))]
        row_ends = (before + sizes)[slots == 0]
        return ids, np.concatenate([[0], row_ends])


def pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Kept columns, start, length, ids (little-endian unsigned 32-bit), doc_tokens: documents cut into full windows and a rest.

    tokenizer: path of the file on every machine. A null or empty text is the end id alone. Repeated rows are
    cut one by one, an empty table gives no rows, and a kept column named like a result column gives way to it.
    """
    small_batches(docs.sparkSession)
    keep = kept(keep, PIECES)
    hidden = unused("__text", keep)

    def run(batches):
        coder = WordTokenizer(tokenizer)
        for part, data, offsets in chunks(batches, hidden):
            ids, edges = coder.encode(data, offsets)
            total = np.diff(edges)
            n = -(-total // window)
            row = np.repeat(np.arange(part.num_rows), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(total[row] - start, window)
            # rows lie in turn and leave no gap, so the pieces' ends cut the buffer
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            blobs = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
            columns = [part.column(i).take(pa.array(row)) for i in range(len(keep))]
            columns += [pa.array(start), pa.array(length), blobs.cast(pa.binary()), pa.array(total[row])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *PIECES])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in PIECES])
    return docs.select(*keep, F.col(text).alias(hidden)).mapInArrow(run, schema)


class Capacities:
    """Open windows by remaining capacity: a segment tree of how many there are in each range of capacities."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of at least ``least``, and that capacity."""
        at = least + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset there) of each piece, longest first, each into the tightest open window.

    Ties go by position, the window opened or left last first. Full windows fit nothing else and are numbered without a search.
    """
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths >= window
    n = int(full.sum())
    place[full] = np.arange(n)
    free, rest = Capacities(window), np.flatnonzero(~full)
    for i in rest[np.argsort(-lengths[rest], kind="stable")].tolist():
        size = int(lengths[i])
        found = free.take(size)
        if found is None:
            found, n = (n, window), n + 1
        place[i], offset[i] = found[0], window - found[1]
        if found[1] > size:
            free.put(found[1] - size, found[0])
    return place, offset


def packed(parts: DataFrame, n_rows: int, *, key: list[str] | None = None, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every column of parts (with start and length), sequence_id and offset.

    n_rows: about how many documents there are, each with one rest at most; it only sets how many groups their pieces
    are dealt into. A piece's group is the hash of its key, start and number in its partition, so thousands of rows of one
    key, or repeated rows, are dealt like any others, and are packed one by one; the result is the same wherever the
    input's partitions are. Order within a group is by length, key and start. Full windows of a group take no search.
    Null keys are a key. Columns of parts named sequence_id or offset are replaced; an empty table gives no rows.
    """
    own, key = parts.drop("sequence_id", "offset"), ["doc_id"] if key is None else key
    groups = max(1, -(-n_rows // group_rows))
    fields = [*own.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    hidden = unused("__group", own.columns)

    def pack(group, rows):
        if rows.num_rows:
            rows = rows.sort_by([*((k, "ascending") for k in key), ("start", "ascending")])
        place, offset = best_fit(rows.column("length").to_numpy(), window)
        number = group[0].as_py()
        return rows.drop_columns([hidden]).append_column("sequence_id", pa.array(place + (number << 32))).append_column("offset", pa.array(offset))

    dealt = own.withColumn(hidden, F.monotonically_increasing_id()).withColumn(hidden, F.pmod(F.xxhash64(*key, "start", hidden), F.lit(groups)))
    return dealt.groupBy(hidden).applyInArrow(pack, T.StructType(fields))


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Token sequences of documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset, a row for each piece."""
    return packed(pieces(docs, tokenizer), docs.count(), **options)


def query(spark, sf_dir):
    """op5: all documents; the ids' digest stands for the ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parts = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    parts = parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packed(parts, docs.count())
