"""N-gram Jaccard join by count vectors and an R-tree.

A text is the set of its distinct five-word shingles. Two texts link when the sets' intersection is at
least ``percent`` of their union, so their sizes differ by at most a quarter and their symmetric difference
holds at most (a + b) / 9 shingles (for 80 per cent).

Texts with equal sets are one point. The tokens of a point are hashed into groups in two ways:

* few groups: the counts by group are the point's coordinates. The overlap of two points is at most the
  sum of the smaller coordinates, and of two boxes the sum of the smaller upper edges: the R-tree's bound.
  Where both coordinates are full (65,535 or more) there is no bound, and the pair is verified;
* about as many groups as tokens: each difference spoils one group, so linked points agree on all but
  few whole groups. In an order known to all (large groups first) two linked points agree on one of their
  first ``d + 1`` groups. Such a group, as a key, is a cell; cells are the leaves at which the search starts.

In cells, each point is compared with the cell's most central point, then with the two most central ones.
The links found make components. Then only cells with points of different components are searched: small ones pair by pair, large ones in blocks by
an R-tree. Survivors of the bound are compared by sketches, the parity of their tokens in four to eight times
as many groups as tokens: a group of other parity holds a token that one of the two sets lacks, so too many
of them rule a link out. What is left, hardly more than the links, is verified on the whole sets. No link
between components is missed, and the pairs inside a component need not be looked at.

Equal copies collapse before anything is shuffled; a large group of near copies costs one comparison per
member. Sets are made of one text each, and only of those that a pair asks for after the sketches. Words,
shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm import textblocks as B
from corpusframe.llm.common import durable, release_shuffles
from corpusframe.settings import drop_stage
from corpusframe.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Coordinates of a point.
DIMENSIONS = 64
#: Largest count that a coordinate holds; it stands for itself and for every larger one.
FULL = 65535
#: Most groups of a sketch: 128 KB. Longer texts have fewer groups a token, which excludes less and never a link.
GROUPS = 1 << 20
#: Points of a cell that are compared pair by pair.
SMALL = 48
#: Leaders to a cell in each round of stars.
STARS = (1, 2)
#: Points of a large cell in one block.
TILE = 2048
#: Entries of a node of the R-tree.
NODE = 16
#: Flags of the filters of candidate points: 2 ** 24 are 2 MB, enough for some millions of points.
FILTER_BITS = 24


def shingle_sets(raw: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; ``raw`` holds the texts, each with a line feed after it."""
    raw = B.LOWER[raw]
    start, size = B.spans(raw, B.NOT_SPACE)
    n, _ = B.word_counts(start, ends)
    h = B.hashes(raw, start, size)
    full = max(0, len(h) - width + 1)
    s = np.zeros(full, np.uint64)
    for k in range(width):
        s = B.mix(s + h[k:k + full])
    out, at = [], 0
    for m in n.tolist():
        if m >= width:
            out.append(np.unique(s[at:at + m - width + 1]))
        elif m:
            short = np.full(1, m, np.uint64)
            for k in range(at, at + m):
                short = B.mix(short + h[k:k + 1])
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
        at += m
    return out


def set_id(tokens: np.ndarray) -> int:
    """Identity of a set, as a signed 64-bit number; 0 for the empty set."""
    if not len(tokens):
        return 0
    return int(B.mix((tokens * np.arange(1, 2 * len(tokens), 2, dtype=np.uint64)).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0]) or 1


def coordinates(tokens: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Tokens of the set by group, ``FULL`` for that many or more."""
    return np.bincount((tokens % np.uint64(dimensions)).astype(np.int64), minlength=dimensions).clip(max=FULL).astype(np.uint16)


def sketch(tokens: np.ndarray) -> bytes:
    """Size of the set (64 bits), then the parity of its tokens in each of a power of two of groups, four to eight times as many as tokens."""
    groups = min(GROUPS, max(64, 1 << (4 * len(tokens) - 1).bit_length()))
    held = np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return len(tokens).to_bytes(8, "little") + np.packbits((held & 1).astype(np.uint8)).tobytes()


def sketches_may_link(x, y, percent: int) -> bool:
    """Whether the groups of different parity are no more than the tokens in which linked sets of these sizes may differ."""
    n = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    a, b = (np.frombuffer(v, np.uint8, offset=8) for v in (x, y))
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):  # the groups of a smaller power of two
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= n - 2 * required(n, 0, percent)


def _ladder(n: int) -> int:
    """Lower end of the size class of ``n``: a power of two."""
    return 1 << (n.bit_length() - 1)


def cells(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the cells that a set stands in.

    A pair belongs to the size class of its smaller set; a set stands in its own class and, if the smaller
    set of a pair may lie in the class below, in that one too.
    """
    n = len(tokens)
    least = -(-percent * n // 100)
    out = []
    for low in sorted({_ladder(n), _ladder(max(1, least))}):
        # most differences to a partner: for the smaller set of size a, partners of up to 100 a / percent
        if low == _ladder(n):
            most = (n * (100 - percent)) // percent
        else:
            most = (2 * n * (100 - percent)) // (100 + percent)
        if low < 32:
            # few tokens: each is a group of its own
            order = np.sort(tokens)
            key = order[:most + 1]
        else:
            group = ((tokens >> np.uint64(20)) % np.uint64(low)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
            whole = np.add.reduceat(B.mix(tokens[order]), first)
            count = np.diff(np.append(first, n))
            best = np.lexsort((whole, -count))[:most + 1]
            key = whole[best] + group[order][first[best]].astype(np.uint64)
        out.append(B.mix(key + np.uint64(low * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


def _key() -> Column:
    """A row of documents by id and text."""
    return F.xxhash64("doc_id", F.xxhash64("text")).alias("key")


def _sets(docs: DataFrame, width: int, finish, schema: str, known=None) -> DataFrame:
    """``finish(batch part, sets)`` gives the rows of a block of texts, of those whose key passes ``known`` if given; the text is the last column."""
    source = docs.select(*[c for c in docs.columns if c != "text"], B.ended("text").alias("__t"))

    def run(batches):
        for batch in batches:
            if known is not None:
                batch = batch.filter(pa.array(B.passes(known.value, FILTER_BITS, batch.column("key").to_numpy())))
            for a, b, raw, ends in B.blocks(batch):
                yield finish(batch.slice(a, b - a), shingle_sets(raw, ends, width))
    return source.mapInArrow(run, schema)


def points(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, row_hash (of the text), key (of id and text), id, n, vector (``DIMENSIONS`` little-endian 16-bit counts), sketch of every row of ``docs`` (doc_id, text)."""
    def finish(part, sets):
        return pa.RecordBatch.from_arrays([
            *(part.column(k) for k in range(3)), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([coordinates(s).tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())],
            names=["doc_id", "row_hash", "key", "id", "n", "vector", "sketch"])
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), _key(), "text")
    return _sets(rows, width, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_hash long, key long, id long, n long, vector binary, sketch binary")


def _cell_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """cell, id: each different set of a block once."""
    def finish(part, sets):
        once = {set_id(s): s for s in sets if len(s)}
        keys = [cells(s, percent) for s in once.values()]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)),
            pa.array(np.repeat(np.array(list(once), np.int64), [len(k) for k in keys]))], names=["cell", "id"])
    return _sets(docs.select("text"), width, finish, "cell long, id long")


def shared_cells(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """cell, id of the cells with two points or more, each point of a cell once.

    Rows come sorted by cell and id, so a cell of any size passes through one row at a time.
    """
    def run(batches):
        first, out_before = None, False  # first row of the cell that may go on, and whether it was put out
        for batch in batches:
            cell, i = (batch.column(k).to_numpy() for k in range(2))
            if not len(cell):
                continue
            if first is not None:
                cell, i = (np.concatenate([[x], y]) for x, y in zip(first, (cell, i)))
            new = np.concatenate([[True], cell[1:] != cell[:-1]])
            again = np.concatenate([[False], ~new[1:] & (i[1:] == i[:-1])])
            start = np.flatnonzero(new)
            many = np.add.reduceat((~again).astype(np.int64), start) > 1
            if first is not None and out_before:
                many[0] = True
            out = np.repeat(many, np.diff(np.append(start, len(cell)))) & ~again
            if first is not None and out_before:
                out[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (cell, i)], names=["cell", "id"])
            # the last row stands for its cell: a further one is compared with it
            first, out_before = (cell[-1], i[-1]), bool(many[-1])
    rows = _cell_rows(docs, width, percent)
    return rows.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(run, "cell long, id long")


def _stars(rows: DataFrame, leaders: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each point of a cell (cell, id, n, label, score) with the cell's ``leaders`` points of the highest score, across labels.

    A cell passes through one row at a time, after its leaders.
    """
    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(4)]
            had = 0
            if held is not None:
                had = len(held[0])
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            cell, i, n, label = cols
            if not len(cell):
                continue
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            begin = np.repeat(start, np.diff(np.append(start, len(cell))))
            place = np.arange(len(cell))
            aa, bb = [], []
            for j in range(leaders):
                own = place[(place > begin + j) & (place >= had)]
                lead = begin[own] + j
                ok = (label[own] != label[lead]) & (100 * np.minimum(n[own], n[lead]) >= percent * np.maximum(n[own], n[lead]))
                aa.append(np.minimum(i[own[ok]], i[lead[ok]]))
                bb.append(np.maximum(i[own[ok]], i[lead[ok]]))
            pair = np.unique(np.stack([np.concatenate(aa), np.concatenate(bb)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])
            last = slice(start[-1], start[-1] + leaders)
            held = [x[last] for x in cols]
    dealt = rows.select("cell", "id", "n", "label", "score").repartition("cell").sortWithinPartitions("cell", F.col("score").desc(), "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


# --- R-tree ------------------------------------------------------------------------------------

def required(a, b, percent: int):
    """Least intersection of linked sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def may_link(va: np.ndarray, vb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, chunk: int = 200_000) -> np.ndarray:
    """Whether the summed coordinate minima of each pair reach what a link needs; a minimum of ``FULL`` has no upper bound."""
    out = np.zeros(len(na), bool)
    for s in range(0, len(na), chunk):
        q = slice(s, s + chunk)
        least = np.minimum(va[q], vb[q])
        out[q] = (least.sum(axis=1, dtype=np.int64) >= required(na[q], nb[q], percent)) | (least == FULL).any(axis=1)
    return out


class RTree:
    """A packed R-tree over count vectors with labels: ordered by label, size and coordinates, ``NODE`` entries to a node."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((*vectors.T[:4], sizes, labels))
        level = tuple(x[self.order] for x in (vectors, sizes, labels, labels))
        self.levels = [level]
        while len(level[0]) > NODE:
            cut = np.arange(0, len(level[0]), NODE)
            level = tuple(f.reduceat(x, cut) for f, x in zip((np.maximum, np.minimum, np.minimum, np.maximum), level))
            self.levels.append(level)

    def join(self, other: "RTree", percent: int, chunk: int = 10_000):
        """Yields pairs (rows here, rows there) of different labels whose bound does not exclude a link; ``chunk`` pairs of nodes are open at once."""
        mine, its = self.levels, other.levels
        mine = [*mine, *[mine[-1]] * (len(its) - len(mine))]
        its = [*its, *[its[-1]] * (len(mine) - len(its))]
        top = len(mine) - 1
        todo = [(top, *(x.ravel() for x in np.meshgrid(np.arange(len(mine[-1][0])), np.arange(len(its[-1][0])), indexing="ij")))]
        while todo:
            k, i, j = todo.pop()
            if len(i) > chunk:
                todo += [(k, i[s:s + chunk], j[s:s + chunk]) for s in range(0, len(i), chunk)]
                continue
            (v, n, lo, hi), (w, m, lo2, hi2) = mine[k], its[k]
            one = (lo[i] == hi[i]) & (lo2[j] == hi2[j]) & (lo[i] == lo2[j])
            i, j = i[~one], j[~one]
            keep = may_link(v[i], w[j], n[i], m[j], percent)
            i, j = i[keep], j[keep]
            if k and len(i):
                todo.append((k - 1, *_below(i, j, len(mine[k - 1][0]), len(v), len(its[k - 1][0]), len(w))))
            elif len(i):
                yield self.order[i], other.order[j]


def _below(i, j, n_i, up_i, n_j, up_j):
    """Pairs of children of pairs of nodes; a level that was only repeated stays as it is."""
    ci = i[:, None] * NODE + np.arange(NODE) if n_i != up_i else i[:, None]
    cj = j[:, None] * NODE + np.arange(NODE) if n_j != up_j else j[:, None]
    a = np.repeat(ci, cj.shape[1], axis=1).ravel()
    b = np.tile(cj, (1, ci.shape[1])).ravel()
    ok = (a < n_i) & (b < n_j)
    return a[ok], b[ok]


# --- candidates and verification ---------------------------------------------------------------

def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and coordinates allow."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("vector").alias(f"v_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "v_a", "v_b")

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            va, vb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, DIMENSIONS) for k in (4, 5))
            ok = may_link(va, vb, na, nb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])
    return both.mapInArrow(run, "a long, b long")


def _token_sets(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """id, tokens of the points of ``pairs`` (a, b), and of few others, from one text of each; other texts are passed over unread."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    known = B.filter_of(reps.select("id", "key").join(ids, "id", "left_semi"), "key", FILTER_BITS)

    def finish(part, sets):
        once = {set_id(s): s for s in sets if len(s)}
        return pa.RecordBatch.from_arrays([pa.array(list(once), pa.int64()), pa.array([s.tobytes() for s in once.values()], pa.binary())], names=["id", "tokens"])
    return _sets(docs.select(_key(), "text"), width, finish, "id long, tokens binary", known)


def _asked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, tokens of the points of ``pairs`` (a, b), and of few others: sets that no pair asks for are not shuffled."""
    known = B.filter_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", FILTER_BITS)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(B.passes(known.value, FILTER_BITS, batch.column(0).to_numpy())))
    return sets.select("id", "tokens").mapInArrow(run, "id long, tokens binary")


def _verified(pairs: DataFrame, docs: DataFrame, every: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, compared by sketches and then on whole sets, as a stored table."""
    pairs = durable(pairs)
    sketches = _asked(every.select("id", F.col("sketch").alias("tokens")), pairs).dropDuplicates(["id"])
    near = durable(_compared(pairs, sketches, percent, sketches_may_link))
    drop_stage(pairs)
    links = durable(_compared(near, _asked(_token_sets(docs, reps, near, width), near).dropDuplicates(["id"]), percent))
    drop_stage(near)
    release_shuffles(docs.sparkSession)
    return links


def _sets_link(x, y, percent: int) -> bool:
    s, t = (np.frombuffer(v, np.uint64) for v in (x, y))
    return 100 * (m := len(np.intersect1d(s, t, assume_unique=True))) >= percent * (len(s) + len(t) - m)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, links=_sets_link) -> DataFrame:
    """The pairs (a, b) for whose sets (id, tokens) ``links`` holds."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")

    def run(batches):
        for batch in batches:
            keep = pa.array([links(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    return both.mapInArrow(run, "a long, b long")


def _across(rows: DataFrame) -> DataFrame:
    """Of cell, id, n, label: the pairs (a, b) across labels of small cells, and the rows of large cells (b null, a = id)."""
    def run(batches):
        cell, i, label, n, large = (np.empty(0, np.int64) for _ in range(5))
        large = None
        def put(a, b, c, lab, size):
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(c), pa.array(lab), pa.array(size)], names=["a", "b", "cell", "label", "n"])
        def finish(c, i, lab, n, is_large):
            if is_large:
                return put(i, pa.nulls(len(i), pa.int64()), c, lab, n)
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
            m = np.diff(np.append(first, len(c)))
            aa, bb = [], []
            for size in np.unique(m).tolist():
                if size < 2:
                    continue
                rows = first[m == size][:, None] + np.arange(size)
                x, y = np.triu_indices(size, 1)
                p, q = rows[:, x].ravel(), rows[:, y].ravel()
                ok = lab[p] != lab[q]
                p, q = p[ok], q[ok]
                aa.append(np.minimum(i[p], i[q]))
                bb.append(np.maximum(i[p], i[q]))
            pair = np.unique(np.stack([np.concatenate(aa), np.concatenate(bb)], axis=1), axis=0) if aa else np.empty((0, 2), np.int64)
            none = np.zeros(len(pair), np.int64)
            return put(pair[:, 0], pa.array(pair[:, 1]), none, none, none)
        for batch in batches:
            cell, i, label, n = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((cell, i, label, n)))
            if not len(cell):
                continue
            new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            m = np.diff(np.append(new, len(cell)))
            big = (m > SMALL) | (cell[new] == large if large is not None else False)
            which = np.repeat(big, m)
            ended = np.arange(len(cell)) < new[-1]
            # the last cell may go on: a small one waits for the next batch, a large one does not
            yield finish(cell[which], i[which], label[which], n[which], True)
            done = ended & ~which
            yield finish(cell[done], i[done], label[done], n[done], False)
            large = cell[new[-1]] if big[-1] else None
            rest = ~ended & ~which
            cell, i, label, n = cell[rest], i[rest], label[rest], n[rest]
        yield finish(cell, i, label, n, False)
    return rows.select("cell", "id", "label", "n").repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(run, "a long, b long, cell long, label long, n long")


def _large_cells(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across labels in large cells (cell, a, label, n), by R-trees over blocks of their points.

    A cell is cut by size (only like sizes link) and then into blocks of about ``TILE`` points; two blocks
    of a cell are one task. A pair that shares several large cells comes out of the smallest of them only.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")
    placed = rows.withColumn("step", step)
    sizes = placed.groupBy("cell", "step").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    info = sizes.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("step", "parts"))).alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi")
    placed = placed.join(info.select("cell", "p"), "cell")
    lists = placed.groupBy("a").agg(F.collect_set("cell").alias("cells"))
    placed = placed.selectExpr("*", "p[step] as parts", "p[step + 1] as above", "p[step - 1] as under") \
        .withColumn("block", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    # tasks: (step, block i, the same step, block j >= i) and (step, block i, the step above, block j)
    same = F.expr("transform(sequence(0, parts - 1), j -> struct(step as s, least(block, j) as i, 0 as d, greatest(block, j) as j, if(block <= j, 0, 1) as side, block = j as self))")
    above = F.expr("if(above is null, array(), transform(sequence(0, above - 1), j -> struct(step as s, block as i, 1 as d, j as j, 0 as side, false as self)))")
    under = F.expr("if(under is null, array(), transform(sequence(0, under - 1), i -> struct(step - 1 as s, i as i, 1 as d, block as j, 1 as side, false as self)))")
    tasks = placed.withColumn("t", F.explode(F.concat(same, above, under))).join(lists.join(reps.select(F.col("id").alias("a"), "vector"), "a"), "a") \
        .select("cell", "t.s", "t.i", "t.d", "t.j", "t.side", "t.self", "a", "label", "n", "vector", "cells")

    def search(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("side", "self", "a", "label", "n")}
        vec = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.uint16).reshape(-1, DIMENSIONS)
        left = np.flatnonzero((col["side"] == 0) | col["self"])
        right = np.flatnonzero((col["side"] == 1) | col["self"])
        # which of the smaller cells each row stands in, as bits
        lists = table.column("cells").combine_chunks()
        row = np.repeat(np.arange(len(vec)), np.diff(np.array(lists.offsets)))
        cell = lists.flatten().to_numpy()
        low = cell < table.column("cell")[0].as_py() if len(vec) else cell > 0
        names, at = np.unique(cell[low], return_inverse=True)
        stands = np.zeros((len(vec), len(names)), bool)
        stands[row[low], at] = True
        stands = np.packbits(stands, axis=1)
        found = [np.empty((0, 2), np.int64)]
        if len(left) and len(right):
            here, there = (RTree(vec[q], col["n"][q], col["label"][q]) for q in (left, right))
            for x, y in here.join(there, percent):
                x, y = left[x], right[y]
                here_first = ~(stands[x] & stands[y]).any(axis=1)
                x, y = col["a"][x[here_first]], col["a"][y[here_first]]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        pair = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})
    return tasks.groupBy("cell", "s", "i", "d", "j").applyInArrow(search, "a long, b long")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row_hash, id, n, label of every row of ``docs`` (doc_id, text): rows of one label reach each other by links; null without words."""
    every = durable(points(docs, width))
    reps = durable(every.filter("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.first("vector").alias("vector"), F.min("key").alias("key")))
    shared = durable(shared_cells(docs, width, percent))
    release_shuffles(docs.sparkSession)
    # a point with much company in its cells is central: the unedited text of a group
    company = shared.groupBy("cell").agg(F.count("*").alias("m"))
    central = shared.join(company, "cell").groupBy("id").agg(F.sum("m").alias("score")).join(reps.select("id", "n"), "id")
    scored = durable(shared.join(central, "id"))
    drop_stage(shared)
    verified = lambda found: _verified(found, docs, every, reps, width, percent)
    links, labels, rows = None, None, scored.withColumn("label", F.col("id"))
    for leaders in STARS:
        found = verified(_bounded(_stars(rows, leaders, percent), reps, percent))
        links = found if links is None else links.unionByName(found)
        labels = durable(components(links, "a", "b").withColumnRenamed("node", "id"))
        rows = scored.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    crossing = durable(_across(rows))
    pairs = _bounded(crossing.filter("b is not null").select("a", "b").distinct(), reps, percent).unionByName(
        _large_cells(crossing.filter("b is null"), reps, percent)).distinct()
    links = links.unionByName(verified(pairs))
    labels = components(links, "a", "b").withColumnRenamed("node", "id")
    joined = durable(every.select("doc_id", "row_hash", "id", "n").join(labels, "id", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "id"))))
    for stage in (scored, crossing, reps, every):
        drop_stage(stage)
    return joined


def link_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    ``id`` is the set's identity: equal for texts of equal sets, 0 without a word. ``component_id`` is the
    smallest doc_id that a document reaches by links, itself included. Texts without words link with
    nothing, each is its own component; a text of fewer words than a shingle is one shingle. Rows of one
    doc_id are one document with several texts: they take the smallest component of all of them. Null ids
    are kept; their component is the smallest id they reach, null if there is none.
    """
    joined = _labelled(docs.select("doc_id", "text"), width, percent)
    least = joined.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return joined.join(least, "label", "left").select("doc_id", "id", F.col("n").alias("n_shingles"), F.coalesce(F.least("least", "doc_id"), "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked texts, the one with the smallest id (null last; ties: smallest hash of the text); all rows without words.

    The columns of ``docs``. Rows are told apart by id and text, so no text is lost with another one of its id; of rows equal in both, one stays.
    """
    joined = _labelled(docs.select("doc_id", "text"), width, percent)
    key = [F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("row_id"), F.col("row_hash")]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_hash"))
    best = joined.filter("n > 0").groupBy("label").agg(F.min(order).alias("best"))
    judged = joined.filter("n > 0").join(best, "label").select(*key, (order == F.col("best")).alias("stays"))
    counts = durable(judged.groupBy("row_id", "row_hash", "stays").agg(F.count("*").alias("rows")).filter("not stays or rows > 1"))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-(2 ** 63))), "__hash": F.xxhash64("text")})
    same = lambda t: (F.col("__id") == t["row_id"]) & (F.col("__hash") == t["row_hash"])
    several = counts.filter("stays")
    single = keyed.join(counts, same(counts), "left_anti")
    # rows that stand there more than once, in id and text: the first of them
    first = F.row_number().over(W.partitionBy("__id", "__hash").orderBy(F.lit(1)))
    again = keyed.join(several, same(several), "left_semi").withColumn("__first", first).filter("__first = 1")
    return single.select(*docs.columns).unionByName(again.select(*docs.columns))
