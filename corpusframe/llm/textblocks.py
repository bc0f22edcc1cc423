"""Texts as blocks of bytes: words and their hashes by numpy, for operators that read every word.

The texts of an Arrow batch lie one after the other in one buffer. ``ended`` puts a line feed after each,
so that no word crosses from one text to the next, and blocks of bounded size are cut between texts.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text in one block.
BLOCK = 4_000_000
#: Spans longer than this are hashed one by one.
LONG = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ended(text: str) -> Column:
    """A text, null as empty, with a line feed after it."""
    return F.concat(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("\n"))


def string_bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(all bytes, offsets) of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), offsets


def ranges(size: np.ndarray, limit: int):
    """Ranges of texts that hold at most ``limit`` bytes, or one text."""
    at, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(size):
        yield at, len(size)


def blocks(batch: pa.RecordBatch, limit: int = BLOCK):
    """(first row, row after the last, bytes, end of each text in them) of the last column of ``batch``."""
    data, offsets = string_bytes(batch.column(batch.num_columns - 1))
    for a, b in ranges(np.diff(offsets), limit):
        yield a, b, np.frombuffer(data[offsets[a]:offsets[b]], dtype=np.uint8), offsets[a + 1:b + 1] - offsets[a]


def byte_set(test) -> np.ndarray:
    """256 flags: the bytes for which ``test`` holds."""
    return np.array([bool(test(b)) for b in range(256)])


#: Bytes of words that white space separates; bytes of words of letters and digits, after lower-casing.
NOT_SPACE = byte_set(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = byte_set(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def spans(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of bytes in ``inside``; the last byte of ``raw`` must not be one."""
    flag = inside[raw]
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2] - edge[0::2]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; spans of up to eight bytes of one size never collide."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    keep = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) if k else 0 for k in range(9)], dtype=np.uint64)
    h = mix((eight[start] & keep[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at, more = 8, np.flatnonzero(size > 8)
    long = more[size[more] > LONG]
    more = more[size[more] <= LONG]
    while len(more):
        h[more] = mix(h[more] * np.uint64(3) ^ (eight[start[more] + at] & keep[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i]:start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_counts(start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, text of each word)."""
    upto = np.searchsorted(start, ends)
    n = np.diff(np.concatenate([[0], upto]))
    return n, np.repeat(np.arange(len(ends)), n)


def bitmap(keys: np.ndarray, bits: int) -> np.ndarray:
    """A filter of 2 ** ``bits`` flags whatever the number of keys: a flag not set says that a hash is not among ``keys``."""
    out = np.zeros(1 << bits, dtype=bool)
    out[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(out)


def maybe_in(packed: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - bits)
    return (packed[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def filter_of(df: DataFrame, column: str, bits: int):
    """A filter of 2 ** ``bits`` flags, sent to the tasks, of all values of a long column: a value whose flag is not set is not in it.

    Its size is fixed; with too many values it only lets more through. Tasks set flags of their own, which are or-ed.
    """
    def run(batches):
        out = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            out |= bitmap(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), bits)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for part in df.select(column).coalesce(8).mapInArrow(run, "part binary").toLocalIterator():
        whole |= np.frombuffer(part[0], np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole)


def passes(packed: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """Which of some 64-bit values may be among those of a filter."""
    return maybe_in(packed, bits, mix(values.view(np.uint64)))
