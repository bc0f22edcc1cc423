"""Shingle join, decontamination and repeat removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import components, decontaminate, repeats, shingle_join
from tests.llm.cases import docs, no_docs, odd_texts, prose

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """doc_id → smallest id reachable, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in up}


def edited(text, share, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10 ** 6))
    return " ".join(w)


def near_texts():
    base = [prose(n, n, 3000) for n in (5, 6, 9, 30, 47, 90, 200, 201, 400, 900)]
    out = base + [t.upper() for t in base[:4]]
    for k, t in enumerate(base):
        out += [edited(t, s, 10 * k + j) for j, s in enumerate((0.005, 0.01, 0.02, 0.03, 0.04, 0.05))]
        out += [t + " " + prose(max(1, n // 2), 7 * k + n, 3000) for n in (2, len(t.split()) // 5, len(t.split()) // 3)]
    chain = base[6]
    for k in range(25):  # far ends are linked through the middle only
        chain = edited(chain, 0.01, 500 + k)
        out.append(chain)
    passage = prose(40, 77, 3000)
    return out + [passage + " " + prose(30 + 3 * k, 900 + k, 3000) for k in range(70)]


@pytest.mark.parametrize("small, tile", [(shingle_join.SMALL, shingle_join.TILE), (3, 8)])
def test_shingle_classes_against_all_pairs(spark, monkeypatch, small, tile):
    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "TILE", tile)
    rows = docs(spark, odd_texts() + near_texts()).withColumn("id", F.lit("mine"))
    data = [(r.doc_id, r.text) for r in rows.collect()]
    want = classes(data)
    got = shingle_join.link_classes(rows).collect()
    assert len(got) == len(data)
    texts = dict(data)
    for g in got:
        if g.doc_id is not None:
            assert g.n_shingles == len(shingles(texts[g.doc_id])) and g.component_id == want[g.doc_id], g
    kept = shingle_join.one_of_each(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} - {None} == set(want.values())


def test_one_of_each_loses_no_text_with_another_of_its_id(spark):
    a, b = prose(60, 1, 3000), prose(60, 2, 3000)
    rows = spark.createDataFrame([(0, b), (1, a), (1, b), (1, b), (2, ""), (2, ""), (None, a), (None, prose(60, 3, 3000)), (3, a.upper())], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in shingle_join.one_of_each(rows).collect()), key=str)
    assert kept == sorted([(0, b), (1, a), (2, ""), (2, ""), (None, prose(60, 3, 3000))], key=str)
    twice = spark.createDataFrame([(5, a), (5, a), (6, a)], "doc_id long, text string")
    assert [tuple(r) for r in shingle_join.one_of_each(twice).collect()] == [(5, a)]


def test_counts_beyond_the_largest_coordinate_lose_no_link(spark, monkeypatch):
    near, far = (np.arange(k, k + 140_000, dtype=np.uint64) * np.uint64(64) for k in (2000, 100_000))
    whole = np.arange(140_000, dtype=np.uint64) * np.uint64(64)
    v = [shingle_join.coordinates(t)[None] for t in (whole, near, far)]
    n = np.array([140_000])
    assert all(shingle_join.may_link(v[0], x, n, n, 80).all() for x in v[1:])  # no bound: what is far is left to the verification
    tree = [shingle_join.RTree(x, n, np.array([k])) for k, x in enumerate(v)]
    assert len(list(tree[0].join(tree[1], 80))) == 1
    # with a lower maximum, long texts of all kinds
    monkeypatch.setattr(shingle_join, "FULL", 3)
    base = prose(3000, 1, 100_000)
    texts = [base, edited(base, 0.005, 2), edited(base, 0.005, 3), prose(3000, 4, 100_000), "one"]
    rows = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in shingle_join.link_classes(rows).collect() if r.doc_id is not None}
    assert got == classes(list(enumerate(texts)))


def test_shingle_join_without_rows_and_words(spark):
    assert shingle_join.link_classes(no_docs(spark)).count() == 0
    got = shingle_join.link_classes(docs(spark, [None, "", " "])).collect()
    assert len(got) == 5 and all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got)


def test_large_cells_find_what_all_pairs_find(spark):
    """Rows of one cell, searched in blocks by R-trees, give every pair that the bound allows."""
    r = np.random.default_rng(5)
    n = 300
    center = r.integers(0, 6, (12, shingle_join.DIMENSIONS))
    vec = (center[r.integers(0, 12, n)] + r.integers(0, 2, (n, shingle_join.DIMENSIONS))).astype(np.uint16)
    size = vec.sum(1).astype(int)
    label = r.integers(0, 40, n)
    reps = spark.createDataFrame([(i, int(size[i]), bytearray(vec[i].tobytes())) for i in range(n)], "id long, n long, vector binary")
    rows = spark.createDataFrame([(1, i, int(label[i]), int(size[i])) for i in range(n)], "cell long, a long, label long, n long")
    import unittest.mock as mock
    with mock.patch.object(shingle_join, "TILE", 16):
        got = sorted(map(tuple, shingle_join._large_cells(rows, reps, 80).distinct().collect()))
    i, j = np.triu_indices(n, 1)
    ok = shingle_join.may_link(vec[i], vec[j], size[i], size[j], 80) & (label[i] != label[j]) & (np.maximum(size[i], size[j]) * 80 <= np.minimum(size[i], size[j]) * 100)
    want = set(zip(i[ok].tolist(), j[ok].tolist()))
    assert want and want <= set(got)
    assert all(label[a] != label[b] and shingle_join.may_link(vec[[a]], vec[[b]], size[[a]], size[[b]], 80)[0] for a, b in got)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(139, 200), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in [*range(100, 140), 200]} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- decontamination ---------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for k in range(max(1, len(v) - 12) if v else 0):
            win = v[k:k + 13]
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(i)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_against_brute_force(spark):
    passage = prose(40, 1, 60)
    items = [(1, passage), (2, passage), (10, "It is a SHORT item"), (3, "one"), (4, None), (5, ""), (6, "a a a a a a a a a a a a a a a"), (7, "Été ünd 日本語 x1"), (8, prose(13, 8)), (9, "?!")]
    part = " ".join(words(passage)[5:25])
    texts = odd_texts() + [passage, "x " + part.upper() + " y", prose(500, 4) + part, "a " * 40, "it,is;a short-ITEM!", "it is a longer item", "ÉTÉ ünd 日本語 x1", "Été ünd 日本語 X1 été ünd 日本語 x1",
                           " ".join(words(passage)[:12]) + " z", prose(800, 5, 60), "one two one"]
    rows = docs(spark, texts).withColumn("n_hit", F.lit("mine"))
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = decontaminate.judge(rows, bench).collect()
    assert len(got) == len(texts) + 2
    by = {(r.doc_id): r.text for r in rows.collect()}
    for g in got:
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == contaminated(by[g.doc_id], items), by[g.doc_id]
    clean = decontaminate.clean_documents(rows, bench)
    assert clean.columns == rows.columns
    bad = [r.doc_id for r in rows.collect() if contaminated(r.text, items)[4]]
    assert len(bad) and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in rows.collect() if r.doc_id not in bad)


def test_decontamination_with_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.judge(no_docs(spark), bench).count() == 0
    got = decontaminate.judge(docs(spark, ["a b c", None]), bench.limit(0)).collect()
    assert [g.n_hit for g in got] == [0] * 4 and not any(g.contaminated for g in got)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    rows = docs(spark, ["fox then quick brown", "quick " + "far " * 30 + "fox brown fox", "nothing"])
    index = decontaminate.Index(rows, bench)
    near = {(r.distance) for r in index.near(5).collect()}
    assert near and max(near) <= 5
    assert index.phrases().count() == 0


# --- repeats -----------------------------------------------------------------------------------

def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i:i + length], []).append((k, i))
    gone = [bytearray(len(b)) for b in raw]
    for where in seen.values():
        if len(where) > 1:
            for k, i in where:
                gone[k][i:i + length] = b"\1" * length
    out = []
    for b, g in zip(raw, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        out.append((len(b), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    r = random.Random(8)
    a, b = prose(200, 31), prose(120, 32)
    out = [a, a, a + b, b[:199], b[:200], "x" + b[:200] + "y", b[100:420] + prose(60, 33), prose(60, 34) + b[101:419], "é" * 300, "0" * 450, "ab" * 260]
    for k in range(30):  # the same passage among other words, and passages of about the least length
        out.append(prose(30, 100 + k) + b[50:50 + 195 + k] + prose(30, 200 + k))
    out += [a[:300] + str(r.random()) + a[300:], a[:500] + "é" + a[500:]]
    return out


@pytest.mark.parametrize("together", [repeats.TOGETHER, 5])
def test_repeats_against_brute_force(spark, together):
    rows = docs(spark, odd_texts() + repeat_texts()).withColumn("n_spans", F.lit("mine"))
    data = rows.select("doc_id", "text").collect()
    want = sorted(removed([r.text for r in data], 200))
    got = repeats.cut(rows, with_bytes=True, together=together).collect()
    assert sorted((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want
    assert all(hashlib.sha256(g.kept).hexdigest() == g.kept_sha256 for g in got)


def test_repeats_of_other_lengths_and_without_rows(spark):
    texts = [prose(60, 40), "x" + prose(60, 40)[3:170] + "y", prose(30, 41)]
    for length in (72, 100, 129):
        got = repeats.cut(docs(spark, texts), length).collect()
        assert sorted((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == sorted(removed([*texts, texts[-1], texts[-1]], length))
    assert repeats.cut(no_docs(spark)).count() == 0


def test_only_sets_that_pairs_ask_for_are_shuffled(spark):
    from corpusframe.llm import shingle_join as SJ
    sets = spark.range(1000).selectExpr("id", "encode(cast(id as string), 'utf-8') tokens")
    pairs = spark.createDataFrame([(3, 700), (3, 41)], "a long, b long")
    got = {r.id for r in SJ._asked(sets, pairs).collect()}
    assert {3, 41, 700} <= got and len(got) < 10


def test_shuffles_of_written_steps_leave_the_disk(spark):
    import time

    from corpusframe.llm.common import durable, release_shuffles
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllBlocks().mkString(" ").split() if f.startswith("shuffle_")}
    old = files()
    durable(spark.range(10_000).repartition(5, "id"))
    made = files() - old
    durable(spark.range(1))  # Spark holds on to the plan it ran last
    release_shuffles(spark)
    until = time.time() + 20
    while made & files() and time.time() < until:
        time.sleep(0.2)
    assert made and not made & files()


def test_sketches_exclude_near_misses_and_no_link(monkeypatch):
    r = np.random.default_rng(3)
    for groups in (shingle_join.GROUPS, 256):  # with fewer groups than tokens, too
        monkeypatch.setattr(shingle_join, "GROUPS", groups)
        for n in (1, 2, 7, 40, 64, 127, 130, 400, 1000, 1030, 5000):
            kept = []
            for j in (1.0, 0.95, 0.86, 0.8, 0.79, 0.7, 0.4, 0.0):
                m = int(round(2 * n * j / (1 + j)))
                for more in (0, n // 5):
                    a, b = r.integers(0, 2 ** 63, n, dtype=np.uint64), r.integers(0, 2 ** 63, n + more, dtype=np.uint64)
                    b[:m] = a[:m]
                    m_both = len(np.intersect1d(a, b))
                    x, y = shingle_join.sketch(a), shingle_join.sketch(b)
                    may = shingle_join.sketches_may_link(x, y, 80)
                    assert may == shingle_join.sketches_may_link(y, x, 80)
                    assert may or 100 * m_both < 80 * (len(a) + len(b) - m_both)
                    kept.append((j, may))
            if groups > 256 and n >= 400:
                assert not any(may for j, may in kept if j <= 0.7)


def test_near_misses_are_ruled_out_without_their_sets(spark, monkeypatch):
    base = prose(400, 21, 5000)
    rows = docs(spark, [base] + [edited(base, 0.035, 900 + k) for k in range(40)] + [edited(base, 0.004, 7)])
    want = classes([(r.doc_id, r.text) for r in rows.collect()])
    assert len(set(want.values())) > 35
    compared, plain = [], shingle_join._compared

    def counted(pairs, sets, *rest):
        if not any(f is getattr(shingle_join, "sketches_may_link", None) for f in rest):
            compared.append(pairs.count())
        return plain(pairs, sets, *rest)
    monkeypatch.setattr(shingle_join, "_compared", counted)
    assert {r.doc_id: r.component_id for r in shingle_join.link_classes(rows).collect() if r.doc_id is not None} == want
    assert len(compared) == 3 and sum(compared) < 10, compared


def test_sets_are_made_of_one_text_of_each_point(spark):
    a, b, c = prose(60, 1, 3000), prose(60, 2, 3000), prose(60, 3, 3000)
    rows = docs(spark, [a] * 30 + [a.upper()] * 30 + [b, c]).select("doc_id", "text")
    every = shingle_join.points(rows)
    reps = every.groupBy("id").agg(F.min("key").alias("key"))
    a, b = (every.filter(f"doc_id = {k}").head().id for k in (5, 60))
    pairs = spark.createDataFrame([(min(a, b), max(a, b))], "a long, b long")
    assert sorted(r.id for r in shingle_join._token_sets(rows, reps, pairs, 5).collect()) == sorted([a, b])
