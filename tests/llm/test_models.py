"""Quality model and language model."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import class_lm, quality_model
from corpusframe.llm import textblocks as B
from corpusframe.llm.queries import QUERIES
from tests.llm.cases import docs, no_docs, odd_texts, prose

SF = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op1_quality_model"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    held = got.filter("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id)
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert len(good) > 20 and len(bad) > 3 and (good[:, None] > bad).mean() > 0.98 and (held.predicted == held.quality).mean() > 0.95


def test_labels_held_out_are_not_learned_from(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.fit_on(docs_, x, ~quality_model.held_out(), rounds=5, pair_rounds=2) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a.single + a.tables, b.single + b.tables))


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality_model.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    m = quality_model.fit(x, y)
    assert (3, 7) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9
    single = quality_model.fit(x, y, n_pairs=0)
    assert ((single.score(x) > 0.5) == y).mean() < 0.7


@pytest.mark.parametrize("y", [[], [1.0, 1.0, 1.0]])
def test_fit_without_two_classes(y):
    m = quality_model.fit(np.zeros((len(y), len(quality_model.FEATURES))), np.array(y))
    assert np.isfinite(m.score(np.zeros((2, len(quality_model.FEATURES))))).all()


def test_scores_of_odd_texts(spark):
    rows = docs(spark).withColumn("features", F.lit("mine"))
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 1), (7, 0), (7, 0), (999, 1)], "doc_id long, quality int")
    model = quality_model.fit_on(rows, labels, F.lit(True))
    got = quality_model.score(rows, model).collect()
    assert len(got) == len(odd_texts()) + 2 and all(0 <= g.score <= 1 for g in got) and got[0].features == "mine"
    assert quality_model.score(no_docs(spark), model).count() == 0


def test_features_do_not_depend_on_the_block(spark):
    rows = docs(spark).filter("doc_id is not null")
    one, two = (sorted((r.doc_id, [round(x, 9) for x in r.features]) for r in quality_model.features(rows.select("doc_id", "text"), block=b).collect()) for b in (B.BLOCK, 1))
    assert one == two


def test_class_model_is_a_distribution_and_beats_words_alone(spark):
    got = QUERIES["op8_class_lm"](spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert got[0] > got[1] + 0.05 * got[2]
    texts = docs(spark, [prose(400, k, 50) for k in range(6)]).select("text")
    sizes = class_lm.Sizes(exchanged=8, classes=3, endings=4, head=16)
    model, counts = class_lm.fit(texts, sizes)
    words = {r.h: r for r in counts.collect()}
    # transitions from any class sum to one, and so do the words of each class with one unknown word
    assert np.allclose((10 ** model.step).sum(axis=1), 1)
    mass = np.zeros(int(model.label.max()) + 1)
    for h, r in words.items():
        k = model.head.find(np.array([h], np.int64).view(np.uint64))[0]
        if k >= 0 and model.rank[k] >= 0:
            mass[model.label[model.rank[k]]] += 10 ** model.emit[model.rank[k]]
        else:
            s = sizes.exchanged + r.ending
            mass[model.label[s]] += 10 ** model.emit[s] * (r.n + class_lm.DELTA)
    for e in range(sizes.endings):
        s = sizes.exchanged + e
        mass[model.label[s]] += 10 ** model.emit[s] * class_lm.DELTA
    mass[model.label[-1]] += 1
    used = np.isin(np.arange(len(mass)), model.label[[*range(min(8, len(words))), *range(sizes.exchanged, sizes.symbols)]])
    assert np.allclose(mass[used], 1)


def test_base_scores_against_brute_force(spark):
    texts = odd_texts() + [prose(300, k) for k in range(5)]
    rows = docs(spark, texts).withColumn("score", F.lit("mine")).withColumn("extra", F.lit(1))
    train = rows.filter("doc_id % 2 = 0")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    c = Counter(w for r in train.collect() for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    # a small head, so that rare words go through the join
    model, counts = class_lm.fit(train, class_lm.Sizes(exchanged=16, classes=4, endings=4, head=32))
    got = class_lm.score(rows, model, counts).collect()
    assert len(got) == len(texts) + 2 and model.tokens == n
    by = {r.doc_id: r.text for r in rows.collect()}
    for g in got:
        t = tokens(by[g.doc_id])
        assert (g.n_tokens, g.n_known, g.extra) == (len(t), sum(c[w] > 0 for w in t), 1)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert g.score < 0 and math.isfinite(g.score)
    assert class_lm.score(no_docs(spark), model, counts).count() == 0


def test_nothing_to_learn_from(spark):
    model, counts = class_lm.fit(no_docs(spark))
    got = class_lm.score(docs(spark, ["a b", None]), model, counts).collect()
    assert all(g.n_known == 0 and math.isclose(g.base_score, g.n_tokens * math.log10(0.1 / 0.1), abs_tol=1e-9) for g in got)


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(1)
    sizes = class_lm.Sizes(exchanged=40, classes=4, endings=2)
    m = sizes.symbols
    pairs = np.zeros((m, m))
    kind = np.arange(40) % 2  # two kinds of words that follow each other
    for _ in range(20000):
        a, b = r.integers(0, 40, 2)
        if kind[a] != kind[b] or r.random() < 0.05:
            pairs[a, b] += 1
    label = class_lm.exchange(pairs, 40, sizes)[:40]
    assert not set(label[kind == 0]) & set(label[kind == 1])


def test_all_words_are_put_into_classes_by_their_neighbours(spark):
    r = np.random.default_rng(4)
    names = np.array([f"w{i:04d}" for i in range(1600)])  # neither endings nor frequency tell the two kinds apart
    kind = r.integers(0, 2, len(names))
    of = [names[kind == k] for k in (0, 1)]
    texts = [" ".join(w for i in range(60) for w in (r.choice(of[0]), r.choice(of[1]))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sizes = class_lm.Sizes(classes=4, endings=4, head=500, seed=100)
    model, counts = class_lm.fit(rows, sizes)
    raw = np.frombuffer("".join(f"{w}\n" for w in names).encode(), np.uint8)
    h = class_lm._words(raw, np.flatnonzero(raw == 10) + 1)[0]
    n = {x.h: x.n for x in counts.collect()}
    times = np.array([n[x] for x in h.view(np.int64).tolist()])
    head, word = class_lm.Words(model.head, 500, model.more).find(h)
    assert (head >= 0).sum() == 500 and np.array_equal(word >= 0, times >= sizes.least) and (word >= 500).sum() > 900
    label = np.concatenate([model.label[:500], model.more_label])[word]
    assert (label[word >= 0] < sizes.classes).all()
    pure = sum(np.bincount(kind[(word >= 0) & (label == q)], minlength=2).max() for q in range(4))
    assert pure > 0.98 * (word >= 0).sum()
    # words of a class sum to one, in the head and beyond; the matrix of classes has every token once
    mass = np.zeros(4)
    for k in np.flatnonzero(word >= 0):
        mass[label[k]] += 10 ** model.emit[word[k]] if word[k] < 500 else 10 ** model.emit[model.slots + sizes.endings + 1 + label[k]] * (times[k] + class_lm.DELTA)
    assert np.allclose(mass[np.unique(label[word >= 0])], 1)
    got = class_lm.score(rows, model, counts).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert got[0] > got[1] + 0.2 * got[2]


def test_words_in_classes_beyond_a_large_head_are_scored(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 2500)),) for k in range(0, 35_000, 2500)], "text string")
    sizes = class_lm.Sizes(classes=2, endings=2, head=33_000, least=1, seed=20, gain=1e9)
    model, counts = class_lm.fit(rows, sizes)
    assert len(model.more) == 2000
    got = class_lm.score(rows, model, counts).collect()
    assert all(g.n_known == g.n_tokens == 2501 and math.isfinite(g.score) and g.score < 0 for g in got)


def test_class_counts_and_moves_against_the_whole_matrix(spark):
    rows = docs(spark, [prose(400, k, 60) for k in range(4)]).select("text")
    sizes = class_lm.Sizes(classes=3, endings=2, head=10, seed=5)
    counts = class_lm.word_counts(rows, sizes)
    h = np.sort(np.array([r.h for r in counts.collect() if r.n >= 5], np.int64).view(np.uint64))
    words = class_lm.Words(class_lm.Lookup(h[:10]), 10, h[10:])
    n, k = len(h), 6
    pairs = class_lm.pair_counts(rows, h, class_lm.Sizes(exchanged=n, classes=3, endings=2))
    table = class_lm.neighbours(rows, spark.sparkContext.broadcast(words), n, sizes)
    label = np.concatenate([np.arange(n) % 5, [3, 4, 5]]).astype(np.int16)  # some words still in classes of endings
    one = np.eye(k)[label]
    t, seeds = class_lm.class_counts(table, label, n, sizes)
    assert np.array_equal(t, one.T @ pairs @ one)
    assert np.array_equal(seeds, np.concatenate([pairs @ one, pairs.T @ one, np.diag(pairs)[:, None]], axis=1)[:5])
    got = class_lm.best_class(t, (pairs @ one)[:n], (pairs.T @ one)[:n], np.diag(pairs)[:n], label[:n], 3)
    for w in range(n):
        every = []
        for q in range(3):
            moved = label.copy()
            moved[w] = q
            one = np.eye(k)[moved]
            every.append(class_lm.likelihood(one.T @ pairs @ one))
        assert math.isclose(every[got[w]], max(every), rel_tol=1e-12)
    final, matrix = class_lm.exchange_all(table, label, n, sizes)
    one = np.eye(k)[final]
    assert (final[:n] < 3).all() and np.array_equal(matrix, one.T @ pairs @ one)


def test_neighbours_of_a_word_that_is_half_of_all_tokens(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(x for w in rng.integers(0, 60, 300) for x in ("the", f"w{w}")) for _ in range(40)]
    rows = docs(spark, texts).select("text").repartition(8)
    texts = [r.text for r in rows.collect()]
    sizes = class_lm.Sizes(classes=3, endings=2, head=10, seed=5)
    counts = class_lm.word_counts(rows, sizes)
    h = np.array([r.h for r in class_lm.most_frequent(counts, 61).collect()], np.int64).view(np.uint64)
    h[10:] = np.sort(h[10:])
    words = spark.sparkContext.broadcast(class_lm.Words(class_lm.Lookup(h[:10]), 10, h[10:]))
    want = Counter()
    number = {int(x): i for i, x in enumerate(h)}
    for text in texts:
        raw = np.frombuffer((text + "\n").encode(), np.uint8)
        s = [63, *(number[int(x)] for x in class_lm._words(raw, np.array([len(raw)]))[0]), 63]
        for a, b in zip(s, s[1:]):
            if a < 61:
                want[a, b * 2] += 1
            if b < 61:
                want[b, a * 2 + 1] += 1
    for held in (64, class_lm.SUM_BYTES):
        monkeypatch.setattr(class_lm, "SUM_BYTES", held)
        got = Counter()
        for r in class_lm.neighbours(rows, words, 61, sizes).collect():
            seen = np.frombuffer(r.seen, np.int32).reshape(-1, 2)
            assert len(set(seen[:, 0])) == len(seen)
            for code, times in seen.tolist():
                got[r.w, code] += times
        assert {k: v for k, v in got.items() if k[0] >= 0} == want
    big = np.array([[7, 2**31 - 1]], np.int32).tobytes()
    assert class_lm.summed([big, big]) == big + big


def test_lookup_finds_all_and_only_its_keys():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(1, 2 ** 63, 5000, dtype=np.uint64))
    table = class_lm.Lookup(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    other = np.setdiff1d(r.integers(1, 2 ** 63, 5000, dtype=np.uint64), keys)
    assert (table.find(other) == -1).all() and len(class_lm.Lookup(keys[:0]).find(other)) == len(other)


def test_hashes_of_spans():
    raw = np.frombuffer(b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + b"b" * 5000 + b"\n", np.uint8)
    start = np.array([0, 1, 0, 0, 40, 41])
    size = np.array([9, 9, 10, 17, 4000, 4000])
    h = B.hashes(raw, start, size)
    assert h[0] == h[1] and h[4] == h[5] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("k", [3, 40, 500, 2000])
def test_most_frequent_words(spark, k):
    r = np.random.default_rng(3)
    n = np.concatenate([r.integers(100, 10000, 60), r.integers(2, 5, 200), np.ones(900, np.int64)]).tolist()
    counts = spark.createDataFrame([(i, 0, int(x)) for i, x in enumerate(n)], "h long, ending long, n long")
    got = [r.n for r in class_lm.most_frequent(counts, k).collect()]
    assert got == sorted(n, reverse=True)[:k]


def test_neighbour_lists_of_a_batch_are_added_up_together(monkeypatch):
    from collections import Counter

    import pyarrow as pa
    r = np.random.default_rng(5)
    key = sorted((int(w), int(p)) for w, p in zip(r.integers(-1, 30, 500), r.integers(0, 2, 500)))
    lists = [np.array([[c, 1 + c % 3] for c in np.unique(r.integers(0, 9, 5))], np.int32) for _ in key]
    want = Counter()
    for k, x in zip(key, lists):
        for code, times in x.tolist():
            want[k, code] += times
    calls = []
    one = class_lm.summed
    monkeypatch.setattr(class_lm, "summed", lambda parts: calls.append(1) or one(parts))
    for size, held in ((500, class_lm.SUM_BYTES), (7, 64)):
        monkeypatch.setattr(class_lm, "SUM_BYTES", held)
        batches = [pa.RecordBatch.from_arrays([pa.array([k[0] for k in key[s:s + size]]), pa.array([k[1] for k in key[s:s + size]]), pa.array([x.tobytes() for x in lists[s:s + size]])],
                                              names=["w", "piece", "seen"]) for s in range(0, 500, size)]
        calls.clear()
        out = [row for b in class_lm._joined(iter(batches)) for row in b.to_pylist()]
        assert len(out) == len(set(key))
        assert {((row["w"], row["piece"]), code): n for row in out for code, n in np.frombuffer(row["seen"], np.int32).reshape(-1, 2).tolist()} == want
        assert size < 500 or len(calls) == 1  # not once a word
        assert all(row["turn"] == class_lm._turns(np.array([row["w"]]))[0] for row in out)


def test_tasks_hold_little_besides_the_texts():
    r = np.random.default_rng(2)
    names = np.array([f"w{i}" for i in range(3000)])
    texts = [" ".join(names[r.integers(0, 3000, 2000)]) + "\n" for _ in range(800)]
    raw = np.frombuffer("\n".join(names).encode() + b"\n", np.uint8)
    h = class_lm._words(raw, np.array([len(raw)]))[0]
    sizes, n = class_lm.Sizes(), 2500
    words, k = class_lm.Words(class_lm.Lookup(h[:2000]), 2000, np.sort(h[2000:n])), 97
    model = class_lm.Model(sizes, words.head, np.ones(2000), np.arange(2000), words.more, np.zeros(500, np.int16), 2000, np.zeros(2000 + 48 + 1 + 48 + 1, np.int64),
                           np.zeros((k, k)), np.zeros(2000 + 48 + 1 + 48 + 1), 0.0, 0.0, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array(texts)], names=["__row", "t"])
    assert 8 << 20 < batch.nbytes < 16 << 20
    columns = ["__row", "n_tokens", "n_known", "__base", "__model", "__h", "__n"]
    for rows, limit in ((class_lm._neighbour_rows([batch], words, n, sizes), 80), (class_lm._scored_rows([batch], model, columns), 48)):
        tracemalloc.start()
        for _ in rows:
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < limit << 20
    lookup = class_lm.Lookup(r.integers(0, 2 ** 63, 100_000, dtype=np.uint64))
    assert sum(t.nbytes for t in lookup.tables) < 4 << 20 and (lookup.find(lookup.keys) == np.arange(100_000)).all()


def test_changes_of_counts_are_those_of_the_moved_words(spark):
    rows = docs(spark, [prose(400, k, 60) for k in range(4)]).select("text")
    sizes = class_lm.Sizes(classes=3, endings=2, head=10, seed=5)
    h = np.sort(np.array([r.h for r in class_lm.word_counts(rows, sizes).collect() if r.n >= 5], np.int64).view(np.uint64))
    n = len(h)
    table = class_lm.neighbours(rows, spark.sparkContext.broadcast(class_lm.Words(class_lm.Lookup(h[:10]), 10, h[10:])), n, sizes)
    label = np.concatenate([np.arange(n) % 5, [3, 4, 5]]).astype(np.int16)
    new = label.copy()
    new[:n:3] = (new[:n:3] + 1) % 3
    new[1] = 2
    mine = table.filter(F.col("w").isin(np.flatnonzero(new != label).tolist()))
    for x, change, y in zip(class_lm.class_counts(table, label, n, sizes), class_lm.count_changes(mine, label, new, n, sizes), class_lm.class_counts(table, new, n, sizes)):
        assert np.array_equal(x + change, y)
