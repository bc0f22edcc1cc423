"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``html_leaves``). Every leaf is a vector: the sum of learned vectors of its
tag path (elements, classes, ids, roles, hashed), the mean of learned vectors of its hashed words, and a few
numbers (length, share of links, punctuation, digits, place in the page). A bidirectional LSTM reads the whole
sequence, so each leaf is judged by what stands before and after it anywhere in the page; leaves judged as
article are joined. Fitting and reading are numpy.

The labeller is fitted here, on pages of a random layout grammar (``page_grammar``) that are filled with words of
the pages at hand, and on those pages among a sample of them that mark their article themselves (``article`` or
``main``; regions of ``nav``, ``aside``, ``footer``, ``form`` and the like count as not article). Bounds of the
fit, all parameters: ``max_pages`` sampled pages (smallest hash of the page), ``max_leaves`` leaves of each, 2,000
characters of a leaf and ``max_words`` words. Reading takes whole pages of any length.

A null or empty page, and one without an article, has an empty text. Rows are read one by one: repeated rows and ids stay,
ids may be null, other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.llm import page_grammar
from corpusframe.llm.html_leaves import BUCKETS, Leaves, bucket
from corpusframe.llm.textblocks import LOWER, NOT_SPACE, byte_set, hashes, ranges, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BUCKETS = 2048
PATH, WORD, NUMBERS, HIDDEN = 24, 8, 6, 20
#: Bytes of pages, and leaves, read at a time by one task.
BLOCK, STEP = 4_000_000, 60_000
MARK = byte_set(lambda b: chr(b) in ".,;:!?")
DIGIT = byte_set(lambda b: 48 <= b <= 57)


# ---- features -----------------------------------------------------------------------------------------------------------------

class Sequences:
    """Leaves of some pages: leaf counts, path of each leaf, the paths' buckets, words as (leaf, bucket), numbers."""

    def __init__(self, pages: list[list[tuple[int, str, int]]], paths: list[tuple[int, ...]]):
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        leaves = [leaf for p in pages for leaf in p]
        self.path = np.array([p for p, _, _ in leaves], dtype=np.int64)
        self.paths = paths
        self.bucket = np.array([b for p in paths for b in p], dtype=np.int64)
        self.bucket_path = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
        raw = np.frombuffer(("\n".join(t for _, t, _ in leaves) + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.flatnonzero(raw == 10)
        start, size = spans(LOWER[raw], NOT_SPACE)
        self.word_leaf = np.searchsorted(ends, start)
        self.word = (hashes(LOWER[raw], start, size) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        n = len(leaves)
        bytes_in = np.diff(np.concatenate([[-1], ends]))[:n] - 1
        upto = np.concatenate([[0], ends[:n] + 1]) if n else np.zeros(1, np.int64)
        marks, digits = (np.add.reduceat(flag[raw].astype(np.float64), upto[:-1]) if n else np.zeros(0) for flag in (MARK, DIGIT))
        chars = np.array([max(len(t), 1) for _, t, _ in leaves], dtype=np.float64)
        words = np.bincount(self.word_leaf, minlength=n)[:n]
        place = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        whole = np.repeat(self.sizes, self.sizes)
        self.numbers = np.stack([np.log1p(words) / 3, np.array([link for _, _, link in leaves], dtype=np.float64) / chars, np.minimum(marks / np.maximum(words, 1), 1),
                                 digits / np.maximum(bytes_in, 1), place / np.maximum(whole, 1), 1 / (1.0 + place)], axis=1) if n else np.zeros((0, NUMBERS))
        self.words = np.maximum(words, 1)

    def inputs(self, weights: dict) -> np.ndarray:
        by_path = np.zeros((len(self.paths), PATH))
        np.add.at(by_path, self.bucket_path, weights["path"][self.bucket])
        means = np.zeros((len(self.path), WORD))
        for k in range(WORD):
            means[:, k] = np.bincount(self.word_leaf, weights["word"][self.word, k], minlength=len(self.path))[:len(self.path)]
        return np.concatenate([by_path[self.path], means / self.words[:, None], self.numbers], axis=1)


# ---- network ------------------------------------------------------------------------------------------------------------------

def starts(seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    d = PATH + WORD + NUMBERS
    out = {"path": rng.normal(0, 0.05, (BUCKETS, PATH)), "word": rng.normal(0, 0.05, (WORD_BUCKETS, WORD)), "out": rng.normal(0, 0.2, 2 * HIDDEN + d), "bias": np.zeros(1)}
    for side in ("f", "b"):
        out[side] = rng.normal(0, 1 / np.sqrt(d + HIDDEN), (d + HIDDEN + 1, 4 * HIDDEN))
        out[side][-1, HIDDEN:2 * HIDDEN] += 1.0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lay_out(sizes: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of each time step of each page, which of them exist); pages by falling size, steps first."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    steps = np.arange(sizes.max(initial=0))[:, None]
    inside = steps < sizes[order][None, :]
    place = np.where(backwards, sizes[order][None, :] - 1 - steps, steps)
    return np.where(inside, first[order][None, :] + place, 0), inside


def run_lstm(x: np.ndarray, w: np.ndarray, sizes: np.ndarray, backwards: bool, trace: list | None = None) -> np.ndarray:
    """Hidden state of every leaf. Pages that have ended drop out of the batch, so padding costs nothing."""
    at, inside = lay_out(sizes, backwards)
    d, out = x.shape[1], np.zeros((len(x), HIDDEN))
    pre = x @ w[:d] + w[-1]
    alive = inside.sum(1)
    h = c = np.zeros((len(sizes), HIDDEN))
    for t in range(len(at)):
        m = alive[t]
        rows = at[t, :m]
        z = pre[rows] + h[:m] @ w[d:-1]
        gates, g = sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        c_new = f * c[:m] + i * g
        tc = np.tanh(c_new)
        if trace is not None:
            trace.append((rows, h[:m], c[:m], i, f, o, g, tc))
        h, c = o * tc, c_new
        out[rows] = h
    return out


def back_lstm(x: np.ndarray, w: np.ndarray, trace: list, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the inputs, of the weights) for gradients ``dh`` of every leaf's hidden state."""
    d = x.shape[1]
    dz_all, gw = np.zeros((len(x), 4 * HIDDEN)), np.zeros_like(w)
    h_next = c_next = np.zeros((0, HIDDEN))
    for rows, h0, c0, i, f, o, g, tc in reversed(trace):
        total_h, total_c = dh[rows], np.zeros((len(rows), HIDDEN))
        total_h[:len(h_next)] += h_next
        total_c[:len(c_next)] += c_next
        total_c += total_h * o * (1 - tc * tc)
        dz = np.concatenate([total_c * g * i * (1 - i), total_c * c0 * f * (1 - f), total_h * tc * o * (1 - o), total_c * i * (1 - g * g)], axis=1)
        dz_all[rows] = dz
        gw[d:-1] += h0.T @ dz
        h_next, c_next = dz @ w[d:-1].T, total_c * f
    gw[:d], gw[-1] = x.T @ dz_all, dz_all.sum(0)
    return dz_all @ w[:d].T, gw


def logits(seq: Sequences, weights: dict) -> np.ndarray:
    x = seq.inputs(weights)
    both = np.concatenate([run_lstm(x, weights["f"], seq.sizes, False), run_lstm(x, weights["b"], seq.sizes, True), x], axis=1)
    return both @ weights["out"] + weights["bias"][0]


def gradients(seq: Sequences, labels: np.ndarray, weights: dict) -> tuple[float, dict]:
    """Mean loss of labelled leaves (label below 0: not counted) and its gradients."""
    x = seq.inputs(weights)
    forth, back = [], []
    both = np.concatenate([run_lstm(x, weights["f"], seq.sizes, False, forth), run_lstm(x, weights["b"], seq.sizes, True, back), x], axis=1)
    known = labels >= 0
    p = sigmoid(both @ weights["out"] + weights["bias"][0])
    miss = np.where(known, p - labels, 0.0) / max(int(known.sum()), 1)
    loss = -float(np.mean(np.log(np.maximum(np.where(labels > 0, p, 1 - p)[known], 1e-12)))) if known.any() else 0.0
    d_both = miss[:, None] * weights["out"]
    dx_f, gf = back_lstm(x, weights["f"], forth, d_both[:, :HIDDEN])
    dx_b, gb = back_lstm(x, weights["b"], back, d_both[:, HIDDEN:2 * HIDDEN])
    dx = dx_f + dx_b + d_both[:, 2 * HIDDEN:]
    by_path = np.zeros((len(seq.paths), PATH))
    np.add.at(by_path, seq.path, dx[:, :PATH])
    gp, gword = np.zeros_like(weights["path"]), np.zeros_like(weights["word"])
    np.add.at(gp, seq.bucket, by_path[seq.bucket_path])
    np.add.at(gword, seq.word, (dx[:, PATH:PATH + WORD] / seq.words[:, None])[seq.word_leaf])
    return loss, {"path": gp, "word": gword, "f": gf, "b": gb, "out": both.T @ miss, "bias": np.array([miss.sum()])}


def train(pages: list[list[tuple[int, str, int]]], paths: list[tuple[int, ...]], labels: list[list[int]], epochs: int = 8, together: int = 24, rate: float = 0.01,
          seed: int = 3) -> dict:
    """Adam over groups of pages; the rate falls in a line."""
    weights, rng = starts(), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    t, steps = 0, epochs * -(-len(pages) // together)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(pages), together):
            chosen = order[at:at + together].tolist()
            got = [pages[i] for i in chosen]
            used = sorted({p for page in got for p, _, _ in page})
            number = {p: i for i, p in enumerate(used)}
            # a path bucket is left out at times, so that no single name decides
            kept = [tuple(b for b in paths[p] if rng.random() > 0.1) for p in used]
            seq = Sequences([[(number[p], text, link) for p, text, link in page] for page in got], kept)
            _, grads = gradients(seq, np.array([y for i in chosen for y in labels[i]], dtype=np.float64), weights)
            t += 1
            scale = min(1.0, 5.0 / max(float(np.sqrt(sum((g * g).sum() for g in grads.values()))), 1e-12))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                if k == "word":  # a word keeps a weight only while many pages speak for it
                    weights[k] = weights[k] * 0.97
                weights[k] = weights[k] - rate * (1 - 0.9 * t / steps) * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in weights.items()}


# ---- fit ----------------------------------------------------------------------------------------------------------------------

def _set(names: str) -> frozenset:
    return frozenset(bucket(n) for n in names.split())


def marked(path: tuple[int, ...]) -> int:
    """1 in a marked article, 0 in a marked other region or outside, for pages that mark their article."""
    own = set(path)
    other = _set("nav aside footer form button .ad .ads .advert .sidebar .comments .comment .cookie .share .related hidden")
    return int(bool(own & _set("article main")) and not own & other)


def sample(pages: DataFrame, html: str, max_pages: int, max_leaves: int, max_chars: int = 2000) -> list[tuple[list[tuple[int, ...]], list[str], list[int]]]:
    """(paths, texts, characters in links) of up to ``max_leaves`` leaves of the ``max_pages`` pages of smallest hash; equal pages once."""
    def run(batches):
        for batch in batches:
            read = Leaves()
            got = [read.of(p)[:max_leaves] for p in batch.column(0).to_pylist()]
            paths = read.buckets
            yield pa.RecordBatch.from_arrays([
                pa.array([[list(paths[p]) for p, _, _ in page] for page in got], pa.list_(pa.list_(pa.int64()))), pa.array([[t[:max_chars] for _, t, _ in page] for page in got], pa.list_(pa.string())),
                pa.array([[n for _, _, n in page] for page in got], pa.list_(pa.int64()))], names=["paths", "texts", "links"])
    c = F.col(f"`{html}`")
    few = pages.filter(c.isNotNull()).select(F.xxhash64(c).alias("h")).distinct().orderBy("h").limit(max_pages)
    texts = pages.select(c.alias("html"), F.xxhash64(c).alias("h")).join(F.broadcast(few), "h").groupBy("h").agg(F.min("html").alias("html")).select("html")
    rows = texts.mapInArrow(run, "paths array<array<bigint>>, texts array<string>, links array<bigint>").collect()
    found = [([tuple(p) for p in r["paths"]], list(r["texts"]), list(r["links"])) for r in rows]
    return sorted(found, key=lambda r: (r[1], r[0]))


def fit_on(pages: DataFrame, html: str = "html", max_pages: int = 200, max_leaves: int = 200, max_words: int = 4000, drawn: int = 600) -> dict:
    """Weights of a labeller fitted on ``drawn`` pages of the grammar and on sampled pages that mark their article."""
    found = sample(pages, html, max_pages, max_leaves)
    words = sorted({w for _, texts, _ in found for t in texts for w in t.split() if len(w) < 40})
    words = words[::max(1, len(words) // max_words)][:max_words] or ["a", "word", "of", "some", "text"]
    read = Leaves()
    leaves, labels = [], []
    for page, marks in page_grammar.pages(drawn, words):
        got = read.of(page)
        if len(got) == len(marks) and got:
            leaves.append(got)
            labels.append(marks)
    article = _set("article main")
    for paths, texts, links in found:
        if any(article & set(p) for p in paths):
            leaves.append([(read.number(p), t, n) for p, t, n in zip(paths, texts, links)])
            labels.append([marked(p) for p in paths])
    return train(leaves, read.buckets, labels)


# ---- read ---------------------------------------------------------------------------------------------------------------------

def label(pages: list[list[tuple[int, str, int]]], paths: list[tuple[int, ...]], weights: dict) -> list[np.ndarray]:
    """Probability of being article for every leaf of every page."""
    sizes = np.array([len(p) for p in pages], dtype=np.int64)
    out: list = [None] * len(pages)
    order = np.argsort(sizes, kind="stable")
    for a, b in ranges(sizes[order], STEP):
        chosen = order[a:b].tolist()
        p = sigmoid(logits(Sequences([pages[i] for i in chosen], paths), weights))
        for i, got in zip(chosen, np.split(p, np.cumsum(sizes[chosen])[:-1])):
            out[i] = got
    return out


def texts_of(pages: list[str | None], weights: dict) -> list[str]:
    read = Leaves()
    leaves = [read.of(p) for p in pages]
    return ["\n".join(t for (_, t, _), y in zip(page, p) if y >= 0.5) for page, p in zip(leaves, label(leaves, read.buckets, weights))]


def extract(pages: DataFrame, weights: dict, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every page."""
    weights = {k: np.asarray(v) for k, v in weights.items()}
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            size = np.array([len(s) if s is not None else 0 for s in column.to_pylist()], dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            for a, b in ranges(size, BLOCK):
                texts = texts_of(column.slice(a, b - a).to_pylist(), weights)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)], pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=schema.names)
    return rows.mapInArrow(run, schema)
