"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a row of numbers (``FEATURES``), each number one of a few bins. The model is one lookup
table per feature and one per chosen pair of features, plus a constant; the log-odds of a text is the sum
of the table entries of its bins. Tables are learned by cyclic boosting: in turn, for each feature, a tree
of at most two cuts is fitted to the gradients summed by bin, and a small step of it is added to the
table. Then pairs are ranked by how much a tree over both features still gains, and the best ones are
boosted the same way.

Fitting uses at most ``max_fit_rows`` labelled rows (those with the smallest hash of their id), so the
driver holds a matrix of bounded size; scoring reads every text once, in batches, without a shuffle.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.llm import common
from corpusframe.llm import textblocks as B

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = ("words", "word_length", "symbols", "upper", "digits", "shouts", "repeated_words", "same_word_again", "repeated_triples", "repeated_lines",
            "stops", "short_words", "line_words", "non_ascii")


# --- features ----------------------------------------------------------------------------------

def _repeats(key: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text, how many keys are equal to an earlier one of the same text."""
    order = np.lexsort((key, owner))
    k, o = key[order], owner[order]
    again = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][again], minlength=n)


def measure_block(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; ``ends``: where each text, with the line feed after it, ends in ``raw``. An empty text gives zeros."""
    n = len(ends)
    begins = np.concatenate([[0], ends[:-1]])

    def count(test):
        return np.add.reduceat(test[raw].astype(np.int32), begins)

    space = count(~B.NOT_SPACE)
    symbols, upper, lower, digits, shouts, high = (count(B.byte_set(t)) for t in (
        lambda b: b in b"#*$%&|<>", lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b == 33, lambda b: b >= 128))
    stops = count(B.byte_set(lambda b: b in b".,"))
    solid = np.maximum(ends - begins - space, 1)
    start, size = B.spans(raw, B.NOT_SPACE)
    words, owner = B.word_counts(start, ends)
    h = B.hashes(raw, start, size)
    some = np.maximum(words, 1)
    twins = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (h[1:] == h[:-1])], minlength=n)
    three = owner[2:] == owner[:-2]
    triple = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F))[three]
    l_start, l_size = B.spans(raw, B.byte_set(lambda b: b != 10))
    lines, l_owner = B.word_counts(l_start, ends)
    short = np.bincount(owner[size <= 3], minlength=n)
    return np.stack([
        np.log1p(words), solid * (words > 0) / some, symbols / solid, upper / np.maximum(upper + lower, 1), digits / solid, shouts / some,
        _repeats(h, owner, n) / some, twins / some, _repeats(triple, owner[:-2][three], n) / some,
        _repeats(B.hashes(raw, l_start, l_size), l_owner, n) / np.maximum(lines, 1), stops / some, short / some, np.log1p(words / np.maximum(lines, 1)), high / solid], axis=1)


def features(docs: DataFrame, text: str = "text", block: int = B.BLOCK) -> DataFrame:
    """``docs`` with an array of ``FEATURES`` in ``features`` instead of the text; a null text is an empty one."""
    own = [f for f in docs.schema.fields if f.name not in ("features", text)]
    source = docs.select(*[F.col(f"`{f.name}`") for f in own], B.ended(text).alias("__text"))
    return source.mapInArrow(_measure(block, lambda m: pa.array(list(m), pa.list_(pa.float64())), "features"),
                             T.StructType(own + [T.StructField("features", T.ArrayType(T.DoubleType()))]))


def _measure(block: int, finish, name: str):
    def run(batches):
        for batch in batches:
            for a, b, raw, ends in B.blocks(batch, block):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(batch.num_columns - 1)], finish(measure_block(raw, ends))], names=[*batch.schema.names[:-1], name])
    return run


# --- model -------------------------------------------------------------------------------------

@dataclass
class Model:
    edges: list
    coarse: list
    constant: float = 0.0
    single: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    tables: list = field(default_factory=list)

    def bins(self, x: np.ndarray, coarse: bool = False) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse if coarse else self.edges)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.constant)
        b = self.bins(x)
        for j, t in enumerate(self.single):
            out += t[b[:, j]]
        if self.pairs:
            c = self.bins(x, coarse=True)
            for (i, j), t in zip(self.pairs, self.tables):
                out += t[c[:, i], c[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _edges(x: np.ndarray, n: int) -> np.ndarray:
    """Bin edges between values that the fitting rows hold in about equal shares."""
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="nearest")) if len(x) else np.empty(0)


def _cut(g: np.ndarray, h: np.ndarray, least: float, ridge: float):
    """(gain, place) of the best cut of bins in order; place None if no cut leaves ``least`` weight on both sides."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge), -np.inf)
    if not len(gain) or not np.isfinite(gain.max()):
        return 0.0, None
    k = int(gain.argmax())
    return float(gain[k] - g.sum() ** 2 / (h.sum() + ridge)), k + 1


def _shallow(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> np.ndarray:
    """Values of a tree of at most two cuts (three leaves) over the bins of one feature."""
    parts = [slice(0, len(g))]
    for _ in range(2):
        gain, k, p = max(((*_cut(g[q], h[q], least, ridge), i) for i, q in enumerate(parts)), key=lambda c: c[0] if c[1] is not None else -1.0)
        if k is None or gain <= 1e-12:
            break
        q = parts[p]
        parts[p:p + 1] = [slice(q.start, q.start + k), slice(q.start + k, q.stop)]
    out = np.zeros(len(g))
    for q in parts:
        out[q] = -g[q].sum() / (h[q].sum() + ridge)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of a tree over two features: the better of the first cut on either, then one cut of each side on the other."""
    best, values = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, k = _cut(a.sum(1), b.sum(1), least, ridge)
        if k is None:
            continue
        v, gain = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + ridge)
        for rows in (slice(0, k), slice(k, None)):
            ga, hb = a[rows].sum(0), b[rows].sum(0)
            _, m = _cut(ga, hb, least, ridge)
            for cols in ((slice(0, m), slice(m, None)) if m is not None else (slice(None),)):
                v[rows, cols] = -ga[cols].sum() / (hb[cols].sum() + ridge)
                gain += ga[cols].sum() ** 2 / (hb[cols].sum() + ridge)
        if gain > best:
            best, values = gain, v.T if turned else v
    return best, values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 12, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.15,
        ridge: float = 1.0, least: float = 2.0) -> Model:
    """Cyclic boosting on the logistic loss. Without rows, or with rows of one class, the model is the (smoothed) constant."""
    model = Model([_edges(x[:, j], bins) for j in range(len(FEATURES))], [_edges(x[:, j], coarse) for j in range(len(FEATURES))])
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model.constant = float(np.log(share / (1 - share)))
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    f = np.full(len(y), model.constant)
    for _ in range(rounds):
        for j, t in enumerate(model.single):
            if len(t) < 2:
                continue
            p = 1 / (1 + np.exp(-f))
            g, h = np.bincount(b[:, j], p - y, len(t)), np.bincount(b[:, j], p * (1 - p), len(t))
            step = rate * _shallow(g, h, min(least, h.sum() / 8), ridge)
            t += step
            f += step[b[:, j]]
    c = model.bins(x, coarse=True)
    width = [len(e) + 1 for e in model.coarse]

    def sums(i, j):
        p, at = 1 / (1 + np.exp(-f)), c[:, i] * width[j] + c[:, j]
        shape, n = (width[i], width[j]), width[i] * width[j]
        return np.bincount(at, p - y, n).reshape(shape), np.bincount(at, p * (1 - p), n).reshape(shape)

    every = [(i, j) for i in range(len(width)) for j in range(i + 1, len(width)) if width[i] > 1 and width[j] > 1]
    ranked = sorted(every, key=lambda q: -_shallow_pair(*sums(*q), least=0.1, ridge=ridge)[0])
    model.pairs = ranked[:n_pairs]
    model.tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.tables):
            step = rate * _shallow_pair(*sums(i, j), least=0.1, ridge=ridge)[1]
            t += step
            f += step[c[:, i], c[:, j]]
    return model


# --- on tables ---------------------------------------------------------------------------------

def fit_on(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_fit_rows: int = 20_000, **options) -> Model:
    """A model learned from at most ``max_fit_rows`` labels for which ``usable`` (over ``labels``) holds.

    Null labels and ids are left out; labels of documents that are missing have no effect; a document
    labelled twice counts twice. The chosen ids are few by that bound, so they go to every task and the
    texts are not shuffled.
    """
    chosen = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("__y")).orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = features(found.select("__id", "__y", "text")).orderBy("__id", "__y").toArrow()
    x = np.array(rows.column("features").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if rows.num_rows else np.empty((0, len(FEATURES)))
    return fit(x, (np.array(rows.column("__y")) > 0).astype(float), **options)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", block: int = B.BLOCK) -> DataFrame:
    """``docs`` with the probability of label 1 in ``out`` instead of the text; null and empty texts are scored as texts without words."""
    own = [f for f in docs.schema.fields if f.name not in (out, text)]
    source = docs.select(*[F.col(f"`{f.name}`") for f in own], B.ended(text).alias("__text"))
    tables = common.ship(docs.sparkSession, model)
    return source.mapInArrow(_measure(block, lambda m: pa.array(tables.value.score(m), pa.float64()), out), T.StructType(own + [T.StructField(out, T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the ids that no label may be learned from."""
    return F.coalesce(common.remainder(doc_id, 3) == 1, F.lit(False))
