"""Language-model scores by Brown classes: class bigrams and word emissions.

The probability of a token is that of its class after the class of the token before, times that of the
word in its class. All words seen ``least`` times or more are put into classes by the exchange algorithm:
a word moves to the class that raises the likelihood of the class bigrams most. Rarer words and unknown
ones belong to the class of their ending. The end of a text is a class of its own, and what comes before
the first word.

What is learned are counts over all training texts: of every word, and of the neighbours of every word in
classes, a stored table with one row a word. The exchange starts on the matrix of the ``seed`` most frequent
words and goes on in rounds over that table: tasks compare each word's counts to and from the classes with
the matrix of classes. Words of one round move at once, so only a part of them may, and a round that lowers
the likelihood is taken back and the next ones move a smaller part. The rounds end when no word moves, or
none of the parts raises the likelihood of a token by ``gain``.

Counts of the ``head`` most frequent words go to the tasks as a table of fixed size; the others stay a
Spark table, which the rarer words of each text meet in a join, so no word is without its count. Of the
words in classes beyond the head, hash and class go to the tasks: ten bytes a word.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.llm import textblocks as B
from corpusframe.llm.common import drop_stage, durable, release_shuffles, ship

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Added to the count of every word of the unigram model, and of the words of an ending.
DELTA = 0.1
#: Weight of a class's own frequency against the counts after one class.
ALPHA = 20.0

#: Bytes of neighbour lists that a task gathers before it adds them up or hands them on.
SUM_BYTES = 4 << 20
#: Bytes of text whose words a task looks up at a time: every word takes some hundred bytes meanwhile.
STEP = 1 << 20


@dataclass(frozen=True)
class Sizes:
    """Most words that are exchanged (None: all seen ``least`` times), classes for them, classes of endings, words whose counts every task has.

    ``seed`` words are exchanged first, in ``sweeps``, before the rounds over all.
    """
    exchanged: int | None = None
    classes: int = 48
    endings: int = 48
    head: int = 1 << 18
    sweeps: int = 3
    least: int = 5
    seed: int = 1024
    gain: float = 1e-3

    @property
    def symbols(self) -> int:
        return (self.exchanged or 0) + self.endings + 1


def ending_table(n: int) -> np.ndarray:
    """Class of each pair of last bytes."""
    return (B.mix(np.arange(65536, dtype=np.uint64)) % np.uint64(n)).astype(np.int64)


class Lookup:
    """Place of a hash in a list of hashes, -1 where it is none of them: a few tables, each for what the one before has no room for."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        while len(left):
            table = np.full(1 << max(8, int(np.ceil(np.log2(len(left)))) + 2), -1, np.int32)
            slot = self._slot(keys[left], len(self.tables), table)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def _slot(self, h: np.ndarray, turn: int, table: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(2 * turn + 1) + np.uint64(turn)) >> np.uint64(65 - len(table).bit_length())).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for turn, table in enumerate(self.tables):
            got = table[self._slot(h[open_], turn, table)]
            hit = (got >= 0) & (self.keys[got] == h[open_])
            out[open_[hit]] = got[hit]
            open_ = open_[~hit & (got >= 0)]
            if not len(open_):
                break
        return out


def _words(raw: np.ndarray, ends: np.ndarray):
    """(hash of each word, last two bytes of each, words of each text, text of each word)."""
    raw = B.LOWER[raw]
    start, size = B.spans(raw, B.NOT_SPACE)
    n, owner = B.word_counts(start, ends)
    last = start + size - 1
    tail = raw[last].astype(np.int64) + np.where(size > 1, raw[np.maximum(last - 1, 0)].astype(np.int64), 0) * 256
    return B.hashes(raw, start, size), tail, n, owner


def word_counts(texts: DataFrame, sizes: Sizes) -> DataFrame:
    """h, ending, n: the occurrences of every word (without the ends)."""
    def run(batches):
        table = ending_table(sizes.endings)
        for batch in batches:
            for _, _, raw, ends in B.blocks(batch):
                h, tail, _, _ = _words(raw, ends)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(table[tail[at]]), pa.array(n, pa.int64())], names=["h", "ending", "n"])
    return texts.select(B.ended("text").alias("t")).mapInArrow(run, "h long, ending long, n long").groupBy("h", "ending").agg(F.sum("n").alias("n"))


def _symbols(raw, ends, lookup: Lookup, table: np.ndarray, sizes: Sizes):
    """Symbol of every token of a block, the end after each text; where the ends are; and what ``_words`` gives."""
    h, tail, n, owner = _words(raw, ends)
    found = lookup.find(h)
    place = np.arange(len(h)) + owner
    out = np.full(len(h) + len(ends), sizes.symbols - 1, np.int64)
    out[place] = np.where(found >= 0, found, sizes.exchanged + table[tail])
    return out, np.cumsum(n + 1) - 1, place, h, found, owner, n


def pair_counts(texts: DataFrame, words: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Matrix of the pairs of neighbouring symbols; the end stands before each text too."""
    m = sizes.symbols
    lookup = ship(texts.sparkSession, Lookup(words))

    def run(batches):
        table, total = ending_table(sizes.endings), np.zeros(m * m, np.int64)
        for batch in batches:
            for _, _, raw, ends in B.blocks(batch, STEP):
                s = _symbols(raw, ends, lookup.value, table, sizes)[0]
                total += np.bincount(np.concatenate([[m - 1], s[:-1]]) * m + s, minlength=m * m)
        code = np.flatnonzero(total)
        for k in range(0, len(code), 100_000):
            part = code[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], names=["code", "n"])
    rows = texts.select(B.ended("text").alias("t")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m * m)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(m, m)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, n_words: int, sizes: Sizes) -> np.ndarray:
    """Class of every symbol: 0 .. classes - 1 for the first ``n_words`` symbols, then the fixed classes."""
    fixed = len(pairs) - sizes.exchanged
    k = sizes.classes + fixed
    label = np.concatenate([np.arange(sizes.exchanged) % sizes.classes, sizes.classes + np.arange(fixed)])
    one = np.zeros((len(pairs), k))
    one[np.arange(len(pairs)), label] = 1
    right, left = pairs @ one, pairs.T @ one  # by word: to and from each class
    t = one.T @ right
    for _ in range(sizes.sweeps):
        moved = 0
        for w in range(n_words):
            a, own = label[w], pairs[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[a] -= own
            c[a] -= own
            t[a] -= r
            t[:, a] -= c
            t[a, a] -= own
            nl, nr = t.sum(1), t.sum(0)
            q = np.arange(sizes.classes)
            gain = (_xlogx(t[q] + r) - _xlogx(t[q])).sum(1) + (_xlogx(t[:, q].T + c) - _xlogx(t[:, q].T)).sum(1)
            d = t[q, q]
            gain += _xlogx(d + r[q] + c[q] + own) - _xlogx(d + r[q]) - _xlogx(d + c[q]) + _xlogx(d)
            gain -= _xlogx(nl[q] + r.sum() + own) - _xlogx(nl[q]) + _xlogx(nr[q] + c.sum() + own) - _xlogx(nr[q])
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            t[b] += r
            t[:, b] += c
            t[b, b] += own
            if b != a:
                moved += 1
                label[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return label


# --- rounds over all words ---------------------------------------------------------------------

@dataclass
class Words:
    """The words in classes: those of the head by frequency, then the others by hash."""
    head: Lookup
    n_head: int                 # the first so many words of the head are in classes
    more: np.ndarray            # sorted hashes of the others

    def __len__(self) -> int:
        return self.n_head + len(self.more)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head or -1, number of the word in classes or -1)."""
        found = self.head.find(h)
        out = np.where(found < self.n_head, found, -1)
        if len(self.more):
            left = np.flatnonzero(found < 0)
            at = np.minimum(np.searchsorted(self.more, h[left]), len(self.more) - 1)
            out[left] = np.where(self.more[at] == h[left], self.n_head + at, -1)
        return found, out


def summed(parts: list[bytes]) -> bytes:
    """Lists of (code, times) as one with every code once. Sums beyond 32 bits are left apart."""
    if len(parts) == 1:
        return parts[0]
    whole = b"".join(parts)
    seen = np.frombuffer(whole, np.int32).reshape(-1, 2)
    order = np.argsort(seen[:, 0], kind="stable")
    code = seen[order, 0]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    times = np.add.reduceat(seen[order, 1].astype(np.int64), first)
    if times.max() > np.iinfo(np.int32).max:
        return whole
    return np.stack([code[first], times.astype(np.int32)], axis=1).tobytes()


def _neighbour_rows(batches, words: Words, n: int, sizes: Sizes):
    """w, piece, seen (see ``neighbours``) of texts, the last column; what about ``B.BLOCK`` bytes of them hold is counted together."""
    m, table = sizes.endings + 1, ending_table(sizes.endings)
    radix, held, size, turn = 2 * (n + m) + m * m, [], 0, 0

    def put():
        key = np.concatenate(held)
        held.clear()
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(at, len(key)))
        w, code = np.divmod(key[at], radix)
        del key, at
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        data = np.stack([code, times], axis=1).astype(np.int32)
        offsets = np.append(first, len(w)) * 8
        seen = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        w = w[first] - 1
        piece = np.where(w < sizes.seed, (size + turn) % 64, 0)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(piece, pa.int64()), seen], names=["w", "piece", "seen"])

    for batch in batches:
        for _, _, raw, ends in B.blocks(batch, STEP):
            h, tail, _, owner = _words(raw, ends)
            _, found = words.find(h)
            s = np.full(len(h) + len(ends), n + sizes.endings, np.int64)
            s[np.arange(len(h)) + owner] = np.where(found >= 0, found, n + table[tail])
            before = np.concatenate([[n + sizes.endings], s[:-1]])
            right, left, none = before < n, s < n, (before >= n) & (s >= n)
            held += [(before[right] + 1) * radix + s[right] * 2, (s[left] + 1) * radix + before[left] * 2 + 1, (before[none] - n) * m + s[none] - n]
            size += len(raw)
            if size >= B.BLOCK:
                yield put()
                held, size, turn = [], 0, turn + 1
    if held:
        yield put()


def neighbours(texts: DataFrame, words, n: int, sizes: Sizes) -> DataFrame:
    """w, piece, turn (``_turns``), seen: of each word in classes its neighbours, pairs of 32-bit numbers (2 * symbol + side, times); side 1 is before it.

    Symbols are the ``n`` words, the endings, the end. A neighbour stands once in a row. Frequent words come in pieces. The row of w = -1 holds
    pairs without a word in classes (symbol before * m + symbol after, m fixed symbols).
    """
    def run(batches):
        return _neighbour_rows(batches, words.value, n, sizes)
    rows = texts.select(B.ended("text").alias("t")).mapInArrow(run, "w long, piece long, seen binary")
    return durable(rows.repartition("w", "piece").sortWithinPartitions("w", "piece").mapInArrow(_joined, "w long, piece long, turn long, seen binary"))


def _turns(w: np.ndarray) -> np.ndarray:
    """What tells in which turn a word may move: its remainder by a power of two."""
    return (B.mix(w.view(np.uint64)) & np.uint64(0x7FFFFFFF)).astype(np.int64)


def _summed_rows(row: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``seen`` (pairs of code and times, of the rows named by ``row``) with each code of a row once; sums beyond 32 bits are left apart."""
    span = int(seen[:, 0].max()) + 1
    key = row * span + seen[:, 0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.add.reduceat(seen[order, 1].astype(np.int64), first)
    if times.max() > np.iinfo(np.int32).max:
        return row, seen
    row, code = np.divmod(key[first], span)
    return row, np.stack([code, times], axis=1).astype(np.int32)


def _joined(batches):
    """Of rows sorted by (w, piece): one row of each, with its lists added up. Whole words of a batch are added up together."""
    last, parts, held, limit = None, [], 0, SUM_BYTES

    def put(keys, lists, sizes, extra=None):
        keys = np.array([extra[0]] + keys.tolist() if extra else keys, np.int64).reshape(-1, 2)
        offsets = np.cumsum([0, *([len(extra[1])] if extra else []), *sizes]).astype(np.int32)
        seen = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer((extra[1] if extra else b"") + lists)])
        w = np.ascontiguousarray(keys[:, 0])
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(_turns(w)), seen], names=["w", "piece", "turn", "seen"])
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
        if not len(key):
            continue
        data, place = B.string_bytes(batch.column(2))
        for a, b in B.ranges(np.diff(place), SUM_BYTES):
            start = a + np.flatnonzero(np.concatenate([[True], (key[a + 1:b] != key[a:b - 1]).any(axis=1)]))
            ended = None
            if last is not None and last == tuple(key[a].tolist()):
                upto = start[1] if len(start) > 1 else b
                parts.append(bytes(data[place[a]:place[upto]]))
                held += len(parts[-1])
                start = start[1:]
                if held > limit:  # what is held of a word grows with its different neighbours, not with its occurrences
                    parts = [summed([*parts, b""])]
                    held = len(parts[0])
                    limit = max(SUM_BYTES, 2 * held)
            if not len(start):
                continue
            if last is not None:
                ended = last, summed([*parts, b""])  # a part may hold several lists
            # all words but the last one end here
            x, y = int(start[0]), int(start[-1])
            lists, sizes = b"", np.empty(0, np.int64)
            if x < y:
                row = np.repeat(np.searchsorted(start, np.arange(x, y), side="right") - 1, np.diff(place[x:y + 1]) // 8)
                row, seen = _summed_rows(row, np.frombuffer(data[place[x]:place[y]], np.int32).reshape(-1, 2))
                lists, sizes = seen.tobytes(), np.bincount(row, minlength=len(start) - 1) * 8
            if ended or x < y:
                yield put(key[start[:-1]], lists, sizes, ended)
            last, limit = tuple(key[y].tolist()), SUM_BYTES
            parts = [bytes(data[place[y]:place[b]])]
            held = len(parts[0])
    if last is not None:
        yield put(np.empty((0, 2), np.int64), b"", [], (last, summed([*parts, b""])))


def _lists(batch, step: int):
    """Of words of a batch (w, row of each pair, pairs of code and times), some words at a time."""
    w, lists = batch.column(0).to_numpy(), batch.column(1)
    if not len(w):
        return
    place = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1] // 4
    data = lists.buffers()[2]
    flat = np.frombuffer(data, np.int32, data.size // 4)  # the lists as they lie in the batch, not copied
    size = np.diff(place) // 2
    for a, b in B.ranges(size + 200, step):
        seen = flat[place[a]:place[b]].reshape(-1, 2)
        yield w[a:b], np.repeat(np.arange(b - a), size[a:b]), seen


def _profiles(batch, label: np.ndarray, k: int, step: int = 300_000):
    """Of words of a batch (w, counts to each class, counts from each class, pairs with itself), some at a time."""
    for w, row, seen in _lists(batch, step):
        code, side = seen[:, 0] >> 1, seen[:, 0] & 1
        dense = np.bincount((row * 2 + side) * k + label[code], seen[:, 1], 2 * k * len(w)).reshape(len(w), 2, k)
        own = np.bincount(row, seen[:, 1] * ((side == 0) & (code == w[row])), len(w))
        yield w, dense[:, 0], dense[:, 1], own


def class_counts(table: DataFrame, label: np.ndarray, n: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the pairs of neighbouring classes, counts of the seed words: to each class, from each class, with itself)."""
    k, m, spark = sizes.classes + sizes.endings + 1, sizes.endings + 1, table.sparkSession
    seeds, sent = min(n, sizes.seed), spark.sparkContext.broadcast(np.concatenate([label[:n], k + np.arange(m)]))  # fixed symbols apart from words in their classes

    def run(batches):
        t, profile = np.zeros((k, k)), np.zeros((seeds, 2 * k + 1))
        for batch in batches:
            no = batch.column(0).to_numpy() < 0
            if no.any():
                for x in batch.column(1).filter(pa.array(no)).to_pylist():
                    seen = np.frombuffer(x, np.int32).reshape(-1, 2)
                    np.add.at(t, (sizes.classes + seen[:, 0] // m, sizes.classes + seen[:, 0] % m), seen[:, 1])
                batch = batch.filter(pa.array(~no))
            for w, right, left, own in _profiles(batch, sent.value, k + m):
                np.add.at(t[sizes.classes:].T, sent.value[w], left[:, k:])
                for x in (right, left):
                    x[:, sizes.classes:k] += x[:, k:]
                np.add.at(t, sent.value[w], right[:, :k])
                q = w < seeds
                np.add.at(profile, w[q], np.concatenate([right[q, :k], left[q, :k], own[q, None]], axis=1))
        yield from _cells(t, profile)
    return _both(table.select("w", "seen").mapInArrow(run, "code int, n long"), k, seeds)


def _cells(t: np.ndarray, profile: np.ndarray):
    """Rows (code, n) of what is not zero in the two, one after the other."""
    flat = np.concatenate([t.ravel(), profile.ravel()])
    code = np.flatnonzero(flat)
    for j in range(0, len(code), 100_000):
        part = code[j:j + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(flat[part].astype(np.int64))], names=["code", "n"])


def _both(cells: DataFrame, k: int, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of what ``_cells`` of all tasks gives, in the driver."""
    rows = cells.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k + seeds * (2 * k + 1))
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out[:k * k].reshape(k, k), out[k * k:].reshape(seeds, 2 * k + 1)


def count_changes(table: DataFrame, label: np.ndarray, new: np.ndarray, n: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """What ``class_counts`` of ``new`` has more than of ``label``; ``table`` needs to hold the words that differ only."""
    k, spark = sizes.classes + sizes.endings + 1, table.sparkSession
    seeds, sent = min(n, sizes.seed), spark.sparkContext.broadcast((label, new))

    def run(batches):
        old, now = sent.value
        moved = old != now
        t, right, left = np.zeros(k * k), np.zeros(seeds * k), np.zeros(seeds * k)
        for batch in batches:
            w = batch.column(0).to_numpy()
            q = w >= 0
            q[q] = moved[w[q]]
            for w, row, seen in _lists(batch.filter(pa.array(q)), 300_000):
                code, times = seen[:, 0] >> 1, seen[:, 1]
                before = (seen[:, 0] & 1) == 1
                was, is_ = old[w].astype(np.int64)[row], now[w].astype(np.int64)[row]
                after = ~before
                t -= np.bincount(was[after] * k + old[code[after]], times[after], k * k)
                t += np.bincount(is_[after] * k + now[code[after]], times[after], k * k)
                once = before & ~moved[code]  # a pair of two moved words stands in the list of the first one too
                t -= np.bincount(old[code[once]] * np.int64(k) + was[once], times[once], k * k)
                t += np.bincount(old[code[once]] * np.int64(k) + is_[once], times[once], k * k)
                for side, profile in ((before, right), (after, left)):
                    side = side & (code < seeds)
                    at = code[side].astype(np.int64) * k
                    profile -= np.bincount(at + was[side], times[side], seeds * k)
                    profile += np.bincount(at + is_[side], times[side], seeds * k)
        yield from _cells(t, np.concatenate([right.reshape(-1, k), left.reshape(-1, k), np.zeros((seeds, 1))], axis=1))
    return _both(table.select("w", "seen").mapInArrow(run, "code int, n long"), k, seeds)


def likelihood(t: np.ndarray) -> float:
    """Log likelihood of the class bigrams, without what does not depend on the classes."""
    return float(_xlogx(t).sum() - _xlogx(t.sum(0)).sum() - _xlogx(t.sum(1)).sum())


def best_class(t: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, label: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word, in ``label`` now, that makes the likelihood of ``t`` largest if it alone moves there."""
    i = np.arange(len(label))
    r, c = right.copy(), left.copy()
    r[i, label] -= own
    c[i, label] -= own
    mine = label[:, None] == np.arange(classes)
    total = np.zeros((len(label), classes))
    for x, other, table in ((r, c, t), (c, r, t.T)):
        row, slot = np.nonzero(x)
        if len(row):
            v = x[row, slot][:, None]
            base = table[:classes, slot].T - np.where(slot == label[row], 1, 0)[:, None] * other[row, :classes]
            base -= mine[row] * (v + np.where(slot == label[row], own[row], 0)[:, None])
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[first]] += np.add.reduceat(_xlogx(base + v) - _xlogx(base), first)
        whole = (x.sum(1) + own)[:, None]
        rest = table[:classes].sum(1)[None] - mine * whole
        total -= _xlogx(rest + whole) - _xlogx(rest)
    r, c, own = r[:, :classes], c[:, :classes], own[:, None]
    d = np.diag(t)[None, :classes] - mine * (r + c + own)
    total += _xlogx(d + r + c + own) - _xlogx(d + r) - _xlogx(d + c) + _xlogx(d)
    best = total.argmax(1)
    stay = (label < classes) & (total.max(1) <= total[i, np.minimum(label, classes - 1)] + 1e-9)
    return np.where(stay, label, best)


def exchange_all(table: DataFrame, label: np.ndarray, n: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(class of each of ``n`` words, then the fixed classes; matrix of classes) from ``label``, in which words without a class have that of their ending."""
    k, context = sizes.classes + sizes.endings + 1, table.sparkSession.sparkContext
    t, seeds = class_counts(table, label, n, sizes)
    part = _turns(np.arange(n))
    parts, turn, idle = 1, 0, 0
    while n:
        sent = context.broadcast((label, t))
        may = (part % parts == turn % parts) if parts > 1 else label[:n] >= sizes.classes
        picked = context.broadcast(may)

        def run(batches):
            old, matrix = sent.value
            for batch in batches:
                w = batch.column(0).to_numpy()
                ok = w >= len(seeds)
                ok[ok] = picked.value[w[ok]]
                for w, right, left, own in _profiles(batch.filter(pa.array(ok)), old, k, 50_000):
                    new = best_class(matrix, right, left, own, old[w], sizes.classes)
                    q = new != old[w]
                    yield pa.RecordBatch.from_arrays([pa.array(w[q]), pa.array(new[q].astype(np.int64))], names=["w", "class"])
        mine = table.filter(F.pmod("turn", F.lit(parts)) == turn % parts) if parts > 1 else table
        moves = mine.filter(F.col("w") >= len(seeds)).select("w", "seen").mapInArrow(run, "w long, class long").toArrow()
        new = label.copy()
        new[moves.column("w").to_numpy()] = moves.column("class").to_numpy()
        s = np.flatnonzero(may[:len(seeds)])
        new[s] = best_class(t, seeds[s, :k], seeds[s, k:2 * k], seeds[s, -1], label[s], sizes.classes)
        turn += 1
        if (new == label).all():
            raised = 0.0
        else:
            after = tuple(x + y for x, y in zip((t, seeds), count_changes(mine, label, new, n, sizes)))
            raised = (likelihood(after[0]) - likelihood(t)) / max(1.0, t.sum())
        if parts == 1:  # words that had no class of their own have one now
            if raised:
                label, (t, seeds) = new, after
            parts, turn = 2, 0
            continue
        if raised < 0:
            parts, turn, idle = 2 * parts, 0, 0
            continue
        if raised:
            label, (t, seeds) = new, after
        idle = idle + 1 if raised <= sizes.gain else 0
        if idle >= parts:
            break
    return label, t


@dataclass
class Model:
    """What a task needs to score: tables of fixed size."""
    sizes: Sizes
    head: Lookup
    log_count: np.ndarray       # of head words, log10(n + DELTA)
    rank: np.ndarray            # place of head words among the words in classes, or -1
    more: np.ndarray            # sorted hashes of the words in classes beyond the head
    more_label: np.ndarray      # their classes
    slots: int                  # symbols: so many words of the head, endings, the end, any other word of each class, the end once more
    label: np.ndarray           # class of each symbol
    step: np.ndarray            # log10 of a class after a class
    emit: np.ndarray            # of each symbol: all of the log10 emission that does not depend on the count
    log_end: float
    log_total: float            # log10(N + DELTA (V + 1))
    tokens: int


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words (h, ending, n). Only about as many rows as that are sorted.

    A histogram of the counts, on a scale of sixteen steps to a doubling, tells from which step on words
    are taken; of a last step that holds too many, those with the smallest hashes.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    left, last, share = k, -1, 1.0
    for b, size in sorted((tuple(r) for r in counts.groupBy(step).count().collect()), reverse=True):
        if size >= left:
            last, share = b, min(1.0, 1.2 * left / size) if size > 2 * k else 1.0
            break
        left -= size
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    return counts.filter((step > last) | ((step == last) & (place <= share))).orderBy(F.col("n").desc(), "h").limit(k)


def fit(texts: DataFrame, sizes: Sizes = Sizes()) -> tuple[Model, DataFrame]:
    """(model, counts) learned from ``texts`` (text); null texts are empty ones. Without a text every token is unknown."""
    counts = durable(word_counts(texts, sizes))
    n_texts = texts.count()
    total = counts.agg(F.sum("n"), F.count("*")).head()
    n, v = int(total[0] or 0) + n_texts, int(total[1]) + (n_texts > 0)
    top = most_frequent(counts, sizes.head).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((h.view(np.int64), -c))
    h, c, ending = h[order], c[order], top.column("ending").to_numpy()[order]
    first = min(len(h), sizes.seed if sizes.exchanged is None else min(sizes.seed, sizes.exchanged))
    start = replace(sizes, exchanged=first)
    n_head = int((c >= sizes.least).sum()) if sizes.exchanged is None else min(len(h), sizes.exchanged)
    more = np.empty((3, 0), np.int64)
    if sizes.exchanged is None and n_head == len(h) < total[1]:
        rows = counts.filter(F.col("n") >= sizes.least).select("h", "n", "ending").toArrow()
        more = np.stack([rows.column(i).to_numpy() for i in range(3)])
        more = more[:, Lookup(h).find(more[0].view(np.uint64)) < 0]
        more = more[:, np.argsort(more[0].view(np.uint64))]
    words = Words(Lookup(h), n_head, more[0].view(np.uint64))
    release_shuffles(texts.sparkSession)
    n_words, e = len(words), sizes.endings
    fixed = sizes.classes + np.arange(e + 1)
    times, end_of = np.concatenate([c[:n_head], more[1]]), np.concatenate([ending[:n_head], more[2]])
    label = np.concatenate([sizes.classes + end_of, fixed])
    seeds = min(first, n_head)
    label[:seeds] = exchange(pair_counts(texts, h[:first], start), first, start)[:seeds]
    label = label.astype(np.int16)
    table = neighbours(texts, ship(texts.sparkSession, words), n_words, sizes)
    label, t = exchange_all(table, label, n_words, sizes)
    drop_stage(table)
    release_shuffles(texts.sparkSession)
    k = len(t)
    own = (t.sum(0) + DELTA) / (t.sum() + DELTA * k)
    step = np.log10((t + ALPHA * own) / (t.sum(1, keepdims=True) + ALPHA))
    # words of an ending that are in no class
    by = {r[0]: (r[1], r[2]) for r in counts.groupBy("ending").agg(F.sum("n"), F.count("*")).collect()}
    n_end, v_end = (np.array([by.get(x, (0, 0))[i] for x in range(e)], float) for i in (0, 1))
    n_end -= np.bincount(end_of, times, e)
    v_end -= np.bincount(end_of, minlength=e)
    in_class = np.bincount(label[:n_words], times + DELTA, sizes.classes)
    slots = n_head if sizes.exchanged is None else sizes.exchanged
    symbol = np.concatenate([label[:n_head], np.zeros(slots - n_head, int), fixed, np.arange(sizes.classes), fixed[-1:]]).astype(np.int64)
    emit = np.zeros(len(symbol))
    emit[:n_head] = np.log10((c[:n_head] + DELTA) / in_class[label[:n_head]])
    emit[slots:slots + e] = -np.log10(n_end + DELTA * (v_end + 1))
    emit[slots + e + 1:-1] = -np.log10(np.maximum(in_class, DELTA))
    rank = np.where(np.arange(len(h)) < n_head, np.arange(len(h)), -1)
    return Model(sizes, words.head, np.log10(c + DELTA), rank, words.more, label[n_head:n_words].astype(np.int16), slots, symbol, step, emit, float(np.log10(n_texts + DELTA)),
                 float(np.log10(n + DELTA * (v + 1))), n), counts


def _scored_rows(batches, m: Model, names: list[str]):
    """Rows of ``names`` for texts, the last column, after the row numbers: what is known of each text, then its words that are not in the head."""
    table, own, words = ending_table(m.sizes.endings), len(names) - 7, Words(m.head, int((m.rank >= 0).sum()), m.more)
    for batch in batches:
        for a, b, raw, ends in B.blocks(batch, STEP):
            h, tail, n, owner = _words(raw, ends)
            found, word = words.find(h)
            known = found >= 0
            rank = np.where(known, word, -1)
            symbol = np.where(rank >= 0, rank, m.slots + table[tail])
            beyond = np.flatnonzero((word >= 0) & ~known)
            symbol[beyond] = m.slots + m.sizes.endings + 1 + m.more_label[word[beyond] - words.n_head].astype(np.int64)
            stream = np.full(len(h) + len(ends), len(m.label) - 1, np.int64)
            stream[np.arange(len(h)) + owner] = symbol
            cls = m.label[stream]
            step = m.step[np.concatenate([[m.label[-1]], cls[:-1]]), cls]
            texts = b - a
            whose = np.repeat(np.arange(texts), n + 1)
            logs = np.where(known, m.log_count[found] if len(m.log_count) else 0.0, 0.0)
            base = np.bincount(owner, logs, texts) + m.log_end
            total = np.bincount(whose, step + m.emit[stream], texts) + np.bincount(owner, np.where(rank < 0, logs, 0.0), texts)
            part = batch.slice(a, texts)
            row = part.column(batch.num_columns - 2)
            n_known = np.bincount(owner[known], minlength=texts) + (1 if m.tokens else 0)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(own)], row, pa.array(n + 1, pa.int64()), pa.array(n_known, pa.int64()),
                                              pa.array(base), pa.array(total), pa.nulls(texts, pa.int64()), pa.nulls(texts, pa.int64())], names=names)
            # words that are not in the head: once per text, with their number
            o, w = owner[~known], h[~known]
            order = np.lexsort((w, o))
            o, w = o[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])])) if len(o) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(o)))
            none = [pa.nulls(len(first), f.type) for f in batch.schema][:own]
            yield pa.RecordBatch.from_arrays([*none, pa.array(row.to_numpy()[o[first]]), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int64()),
                                              pa.nulls(len(first), pa.float64()), pa.nulls(len(first), pa.float64()), pa.array(w[first].view(np.int64)), pa.array(times, pa.int64())],
                                             names=names)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, base_score and score (log10 probabilities) of each row.

    A null or empty text is its end alone. Rows are scored each for itself, repeated ones too. Input
    columns of these names are replaced.
    """
    made = ("n_tokens", "n_known", "base_score", "score", "text", "__row", "__base", "__model", "__h", "__n")
    own = [f for f in docs.schema.fields if f.name not in made]
    sent = ship(docs.sparkSession, model)
    names = [*[f.name for f in own], "__row", "n_tokens", "n_known", "__base", "__model", "__h", "__n"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], "__row long, n_tokens long, n_known long, __base double, __model double, __h long, __n long"])

    def run(batches):
        return _scored_rows(batches, sent.value, names)

    source = docs.select(*[F.col(f"`{f.name}`") for f in own], F.monotonically_increasing_id().alias("__row"), B.ended("text").alias("__t"))
    stored = durable(source.mapInArrow(run, schema))
    rare = stored.filter("__h is not null").select("__row", "__h", "__n").join(counts.select(F.col("h").alias("__h"), "n"), "__h", "left")
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(DELTA))
    rare = rare.groupBy("__row").agg(F.sum(F.col("__n") * log).alias("__log"), F.sum(F.when(F.col("n") > 0, F.col("__n")).otherwise(0)).alias("__more"))
    out = stored.filter("__h is null").join(rare, "__row", "left")
    log = F.coalesce("__log", F.lit(0.0))
    return out.select(*[F.col(f"`{f.name}`") for f in own], "n_tokens", (F.col("n_known") + F.coalesce("__more", F.lit(0))).cast("long").alias("n_known"),
                      (F.col("__base") + log - F.col("n_tokens") * F.lit(model.log_total)).alias("base_score"), (F.col("__model") + log).alias("score"))


def perplexity(score_column: str = "score", tokens: str = "n_tokens") -> Column:
    return F.pow(F.lit(10.0), -F.col(score_column) / F.col(tokens))
