"""Removal of repeated byte strings, by a sparse suffix array with bucket-pointer refinement.

Every byte covered by a string of ``length`` bytes that starts anywhere else too is removed.

1. Anchors. Each string of ``length`` bytes holds a q-gram whose hash is the smallest of its q-grams; equal
   strings hold it at the same place. The q-grams that are smallest somewhere are the anchors, one in some
   seventy bytes; only they are sorted. An anchor's bucket is its q-gram.
2. Whole contexts. All strings around an anchor lie in its context, what the string length allows to the
   left and right. An anchor whose context another anchor of the bucket has too is settled: all of the
   context is repeated.
3. Refinement. In buckets with differing contexts, one anchor of each context is compared byte by byte:
   buckets of eight bytes are refined by sorting on the bucket identifiers of later offsets, 8, 16, 32, 64
   bytes on, each round on the identifiers that the last one gave; buckets of one are left out of the next.
   Strings in one bucket at full length are repeated.
4. The intervals of a document are joined and cut out of its bytes.

Shuffled are anchors (28 bytes each), the contexts that differ, and the texts that have any; a large bucket
goes through step 3 as rows of single strings, counted before the shuffle, not as one group.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm import textblocks as B
from corpusframe.llm.common import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of an anchor.
GRAM = 64
#: Contexts of one bucket that are refined together; a larger bucket is split into strings.
TOGETHER = 20_000
#: Contexts refined at once, of all buckets.
AT_ONCE = 4_000
#: Bytes of text in which anchors are sought at once; the work needs some hundred bytes for each.
BLOCK = 1_000_000
#: Flags of the filter of documents: 2 ** 22 are 512 KB.
FILTER_BITS = 22
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _C[0]
    h ^= h >> np.uint64(29)
    h += b * _C[1]
    h ^= h >> np.uint64(32)
    h *= _C[2]
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every place on: eight bytes, then pairs of neighbours of twice the size."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(GRAM + 8, np.uint8)])
    h = np.ndarray(n + GRAM, dtype="<u8", buffer=padded.data, strides=(1,)).copy()
    step = 8
    while step < GRAM:
        h = _pair(h[:-step], h[step:])
        step *= 2
    return h[:n]


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` over each ``width`` values from a place on."""
    done, out = 1, x
    while done * 2 <= width:
        out = take(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return take(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in ``raw``, hash, context hash) of the anchors of texts of ``length`` bytes or more."""
    width = length - GRAM + 1
    none = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
    size = end - begin
    if len(raw) < length or not (size >= length).any():
        return tuple(none)
    h = gram_hashes(raw)
    # strings that lie inside one text
    starts = np.zeros(len(raw) + 1, np.int32)
    long = size >= length
    np.add.at(starts, begin[long], 1)
    np.add.at(starts, end[long] - length + 1, -1)
    whole = np.cumsum(starts[:-1])[:len(raw) - width + 1] > 0
    least = np.where(whole, _slide(h, width, np.minimum), np.uint64(0))
    back = np.zeros(width - 1, np.uint64)
    highest = _slide(np.concatenate([back, least, back]), width, np.maximum)
    at = np.flatnonzero((highest[:len(raw)] == h) & (h > 0))
    text = np.searchsorted(end, at, side="right")
    # a zero hash or a place outside any string is none; contexts are told apart by what they hold and where they are cut
    reach = length - GRAM
    lo, hi = begin[text], end[text] - GRAM
    context = (np.minimum(at - lo, reach) * 1024 + np.minimum(hi - at, reach)).astype(np.uint64) if reach < 1024 else \
        (np.minimum(at - lo, reach).astype(np.uint64) << np.uint64(32)) + np.minimum(hi - at, reach).astype(np.uint64)
    for off in sorted({-reach, *range(-(reach // GRAM) * GRAM, reach, GRAM), reach}):
        context = _pair(context, h[np.clip(at + off, lo, hi)])
    return text, at, h[at], context


def refine(data: np.ndarray, begin: np.ndarray, size: np.ndarray, bucket: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, place in it) of the strings of ``length`` bytes that another context of the bucket holds at the same distance from its anchor.

    ``data`` holds the contexts one after the other, ``left`` bytes before the anchor each.
    """
    h = gram_hashes(data)
    n = np.maximum(size - length + 1, 0)
    which = np.repeat(np.arange(len(size)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begin[which] + place
    # first buckets: same bucket, same distance, same first bytes; then by the identifiers of later offsets
    ids = _pair(_pair(bucket[which].view(np.uint64), (left[which] - place).astype(np.uint64)), h[at])
    for off in [*range(GRAM, length - GRAM, GRAM), length - GRAM, None]:
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        new = np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]) if len(ids) else np.empty(0, bool)
        alone = new & np.append(new[1:], True)
        number = np.cumsum(new)[~alone]
        keep = order[~alone]
        which, place, at = which[keep], place[keep], at[keep]
        if off is None:
            return which, place
        ids = _pair(number.astype(np.uint64), h[at + off])


def _runs(key: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the unions of strings that begin at consecutive places of one key."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] > place[:-1] + length)])) if len(key) else np.empty(0, np.int64)
    last = np.append(first[1:], len(key)) - 1
    return key[first], place[first], place[last] + length if len(key) else place


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """h, c, key, at, lo, hi, w, sure of every anchor.

    Anchors of a block that have bucket and context in common are settled at once (``sure``). One of them
    stands for all in the bucket, with their number ``w``; the others are given a bucket of their own, so
    that copies and periodic texts do not meet in one task.
    """
    def run(batches):
        reach = length - GRAM
        for batch in batches:
            for a, _, raw, end in B.blocks(batch, BLOCK):
                begin = np.concatenate([[0], end[:-1]])
                text, at, h, c = anchors(raw, begin, end, length)
                key = batch.column(0).to_numpy()[a + text]
                at = at - begin[text]
                hi = np.minimum(at + GRAM + reach, (end - begin)[text])
                _, first, same, n = np.unique(_pair(h, c), return_index=True, return_inverse=True, return_counts=True)
                w, stands = n[same], np.zeros(len(h), bool)
                stands[first] = True
                own = _pair(_pair(key.view(np.uint64), at.astype(np.uint64)), np.arange(len(h)).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(stands, h, own).view(np.int64)), pa.array(c.view(np.int64)), pa.array(key), pa.array(at, pa.int64()),
                                                  pa.array(np.maximum(at - reach, 0), pa.int64()), pa.array(hi, pa.int64()), pa.array(np.where(stands, w, 1), pa.int64()),
                                                  pa.array(w > 1)], names=["h", "c", "key", "at", "lo", "hi", "w", "sure"])
    return keyed.select("key", "text").mapInArrow(run, "h long, c long, key long, at long, lo long, hi long, w long, sure boolean")


def _only(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (key, text) that may be among ``keys``: what is not stays where it is."""
    known = B.filter_of(keys, "key", FILTER_BITS)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(B.passes(known.value, FILTER_BITS, batch.column(0).to_numpy())))
    return keyed.select("key", "text").mapInArrow(run, "key long, text string")


def _contexts(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """h, key, lo, left, context of the anchors in ``asked`` (h, key, at, lo, hi)."""
    lists = asked.groupBy("key").agg(F.collect_list(F.struct("h", "at", "lo", "hi")).alias("asked"))
    both = _only(keyed, asked).join(lists, "key").select("key", "asked", "text")

    def run(batches):
        for batch in batches:
            data, offsets = B.string_bytes(batch.column(2))
            asked = batch.column(1)
            n = np.diff(np.array(asked.offsets))
            row = np.repeat(np.arange(batch.num_rows), n)
            h, at, lo, hi = (asked.flatten().field(k).to_numpy() for k in range(4))
            base = offsets[row]
            for s in range(0, len(row), 20_000):
                q = slice(s, s + 20_000)
                found = [bytes(data[x:y]) for x, y in zip((base[q] + lo[q]).tolist(), (base[q] + hi[q]).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[q]), pa.array(batch.column(0).to_numpy()[row[q]]), pa.array(lo[q]), pa.array(at[q] - lo[q]), pa.array(found, pa.binary())],
                                                 names=["h", "key", "lo", "left", "context"])
    return both.mapInArrow(run, "h long, key long, lo long, left long, context binary")


def _refined(contexts: DataFrame, length: int, together: int) -> DataFrame:
    """key, lo, hi of repeated strings; rows of buckets that are too large for one go keep h, left and context instead of hi."""
    def settle(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        data, offsets = B.string_bytes(t.column("context").chunk(0))
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
        size = np.diff(offsets)
        h, key, lo, left = (t.column(c).to_numpy() for c in ("h", "key", "lo", "left"))
        which, place = refine(raw, offsets[:-1] - offsets[0], size, h, left, length)
        member, a, b = _runs(which, place, length)
        return pa.RecordBatch.from_arrays([pa.array(key[member]), pa.array(lo[member] + a), pa.array(lo[member] + b), pa.nulls(len(member), pa.int64()),
                                           pa.nulls(len(member), pa.int64()), pa.nulls(len(member), pa.binary())], names=["key", "lo", "hi", "h", "left", "context"])

    def put_off(batch):
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.nulls(batch.num_rows, pa.int64()), batch.column(0), batch.column(3), batch.column(4)],
                                          names=["key", "lo", "hi", "h", "left", "context"])

    def run(batches):
        held, n, large = [], 0, None  # rows of whole buckets and of the last one; the bucket that is passed on
        tail = 0  # rows of the last bucket in ``held``
        for whole in batches:
            for s in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(s, AT_ONCE)
                h = batch.column(0).to_numpy()
                if large is not None:
                    m = int(np.argmax(h != large)) if (h != large).any() else len(h)
                    if m:
                        yield put_off(batch.slice(0, m))
                        batch, h = batch.slice(m), h[m:]
                    if not len(h):
                        continue
                    large = None
                cut = int(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[-1])  # where the last bucket begins
                if held and cut == 0 and held[-1].column(0)[-1].as_py() == h[0]:
                    tail += len(h)
                else:
                    tail = len(h) - cut
                held.append(batch)
                n += len(h)
                if tail > together or n - tail >= AT_ONCE:
                    t = pa.Table.from_batches(held).combine_chunks()
                    first, rest = t.slice(0, n - tail), t.slice(n - tail)
                    if first.num_rows:
                        yield settle(first.to_batches())
                    held, n = rest.to_batches(), tail
                    if tail > together:
                        for b in held:
                            yield put_off(b)
                        large, held, n, tail = h[-1], [], 0, 0
        if n:
            yield settle(held)
    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "key long, lo long, hi long, h long, left long, context binary")


def _one_by_one(large: DataFrame, length: int) -> DataFrame:
    """key, lo, hi of the repeated strings in large buckets: every string of every context is a row, counted by what it holds."""
    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                data, offsets = B.string_bytes(part.column(4))
                raw, size = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], np.diff(offsets)
                h = gram_hashes(raw)
                n = np.maximum(size - length + 1, 0)
                which = np.repeat(np.arange(len(size)), n)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = (offsets[:-1] - offsets[0])[which] + place
                left, bucket = part.column(3).to_numpy()[which], part.column(0).to_numpy()[which].view(np.uint64)
                ids = _pair(_pair(bucket, (left - place).astype(np.uint64)), h[at])
                for off in [*range(GRAM, length - GRAM, GRAM), length - GRAM]:
                    ids = _pair(ids, h[at + off])
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(part.column(1).to_numpy()[which]), pa.array(part.column(2).to_numpy()[which] + place)],
                                                 names=["string", "key", "lo"])
    rows = large.select("h", "key", "lo", "left", "context").mapInArrow(run, "string long, key long, lo long")
    twice = rows.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    return rows.join(twice, "string", "left_semi").select("key", "lo", (F.col("lo") + length).alias("hi"))


def keyed_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text (null as empty) and key: a row by its id and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", body.alias("text"), F.xxhash64(F.col("doc_id"), body).alias("key"))


def repeated(keyed: DataFrame, length: int = 200, together: int = TOGETHER) -> DataFrame:
    """key, lo, hi: intervals that cover exactly the repeated bytes of each text; they may touch and overlap."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    w, same = W.partitionBy("h"), W.partitionBy("h", "c")
    found = _anchor_rows(keyed, length).withColumns({
        "n": F.sum("w").over(w), "m": F.sum("w").over(same), "r": F.row_number().over(same.orderBy("key", "at"))}).filter("n > 1 and (m > 1 or m < n) or sure")
    found = durable(found.select("h", "key", "at", "lo", "hi", (F.col("sure") | (F.col("m") > 1)).alias("settled"), ((F.col("m") < F.col("n")) & (F.col("r") == 1)).alias("asked")))
    asked = found.filter("asked").select("h", "key", "at", "lo", "hi")
    refined = durable(_refined(_contexts(keyed, asked), length, together))
    return found.filter("settled").select("key", "lo", "hi").unionByName(refined.filter("hi is not null").select("key", "lo", "hi")) \
        .unionByName(_one_by_one(refined.filter("hi is null"), length))


def cut(docs: DataFrame, length: int = 200, with_bytes: bool = False, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_bytes``, kept (binary), one row per row of ``docs`` (doc_id, text).

    Null texts are empty. Texts shorter than ``length`` keep everything. Rows that repeat another one count
    as repeats of its text; rows of one id with different texts are told apart. What is left of a text may
    begin or end inside a character, so ``kept`` is bytes.
    """
    keyed = keyed_texts(docs)
    lists = durable(repeated(keyed, length, together).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    both = _only(keyed, lists.select("key")).join(lists, "key").select("key", "spans", "text")

    def run(batches):
        for batch in batches:
            data, offsets = B.string_bytes(batch.column(2))
            out = {"key": batch.column(0), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for i, spans in enumerate(batch.column(1)):
                lo, hi = (spans.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
                raw = bytes(data[offsets[i]:offsets[i + 1]])
                left = b"".join(raw[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]))
                out["n_removed"].append(len(raw) - len(left))
                out["n_spans"].append(len(lo))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left if with_bytes else None)
            yield pa.RecordBatch.from_arrays([out["key"], pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
                                              pa.array(out["kept"], pa.binary())], names=list(out))
    done = both.mapInArrow(run, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(["key"])
    own = [F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")]
    rows = keyed.select("doc_id", "key", *own, *([F.col("text").cast("binary").alias("all")] if with_bytes else []))
    out = rows.join(done, "key", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *([F.coalesce("kept", "all").alias("kept")] if with_bytes else []))
