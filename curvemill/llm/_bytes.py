"""Whole-batch text work on the UTF-8 bytes of Arrow columns.

Words, lines and n-grams of thousands of documents are found and hashed by a
few numpy passes over one buffer, so Python is never entered for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
CHUNK = 2 << 20


def _table(members: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(members)] = True
    return found


SPACE = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark) -> None:
    """Arrow batches of 16 MB at most, where the session has the default of 64 MB: a task holds several at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(16 << 20))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK, rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): batches cut where ``limit`` bytes or ``rows`` rows of text are reached."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = buffers(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            part = batch.slice(at, to - at)
            yield part, *buffers(part.column(part.schema.get_field_index(text)))
            at = to
        batch = column = part = None
        release()


def kept(keep: list[str] | None, results: Iterable[str]) -> list[str]:
    """The columns to carry: ``doc_id`` if none are named; one named like a result column gives way to it."""
    return [c for c in (["doc_id"] if keep is None else keep) if c not in set(results)]


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores after it until no column is named so (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the longest stretches of ``inside`` bytes within a row."""
    n = len(inside)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the parts between newlines; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per_row = 1 + np.diff(np.searchsorted(breaks, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same stretches without ASCII white space at their ends; what is all space becomes empty."""
    solid = np.flatnonzero(~SPACE[data])
    if not len(solid):
        return starts, starts
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    some = first <= last
    new_starts = np.where(some, solid[np.minimum(first, len(solid) - 1)], starts)
    return new_starts, np.where(some, solid[np.maximum(last, 0)] + 1, new_starts)


class Hasher:
    """Hashes any stretches of a buffer: a random-table polynomial over prefix sums, then mixed.

    Two hashers of different ``salt`` are independent; together they give 128 bits.
    """

    def __init__(self, salt: int = 0):
        seeds = mix(np.arange(1, 259, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 1_000_003 + 17))
        self.value, self.base = seeds[:256], int(seeds[256] | np.uint64(5))
        self.inverse, self.length = pow(self.base, -1, 1 << 64), seeds[257] | np.uint64(1)
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        for name, base in (("powers", self.base), ("inverses", self.inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[:1] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            self._grow(max(len(data) + 1, CHUNK + 1))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * self.length)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of(self.prefix(data), starts, ends)


def windows(keys: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` neighbouring keys within a row, and the position of each window's first key."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    total = np.zeros(len(first), np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + keys[first + j]
    return mix(total), first


def counted(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row the mask holds."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
