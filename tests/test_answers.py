"""Search, routing, evidence, evaluation, overlap: golden values and brute force."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusframe.operators import evaluate as EL
from corpusframe.operators import evidence as EV
from corpusframe.operators import lookup as Q
from corpusframe.operators import routing as RO
from corpusframe.operators import vectors as V


def brute(q, c, k):
    out = {}
    for i, v in q:
        s = sorted(((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in c))
        out[i] = [j for _, j in s[:k]]
    return out


@pytest.mark.parametrize("numbers", [10**6, 12])
def test_knn_is_exact_with_ties(spark, numbers):
    rng = np.random.default_rng(1)
    c = [(f"c{i:02d}", rng.integers(-2, 3, 4).astype(float) + 0.5) for i in range(40)] + [("zz", np.ones(4)), ("aa", np.ones(4))]
    q = [(i, rng.integers(-2, 3, 4).astype(float) + 0.5) for i in range(9)] + [(99, np.ones(4))]
    cd = spark.createDataFrame([(i, v.tolist()) for i, v in c], "chunk_id string, embedding array<double>").repartition(3)
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in q], "query_id int, embedding array<double>")
    got = {}
    for r in V.knn(qd, cd, 5, query_numbers=numbers, cell_numbers=numbers).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    best = [x for x, _ in got[99]]
    assert best.index("aa") < best.index("zz")
    want = brute(q, c, 5)
    scores = lambda i, ids: sorted(round(float(np.dot(dict(q)[i], dict(c)[j]) / np.linalg.norm(dict(q)[i]) / np.linalg.norm(dict(c)[j])), 4) for j in ids)
    for i in want:
        assert sorted(s for _, s in got[i]) == scores(i, want[i])


def test_knn_domains_and_empty(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "b")], "chunk_id long, embedding array<double>, domain string")
    q = spark.createDataFrame([(1, [1.0, 0.0], ["b"]), (2, [1.0, 0.0], None)], "query_id long, embedding array<double>, domains array<string>")
    got = {(r.query_id, r.chunk_id) for r in V.knn(q, c, 1).collect()}
    assert got == {(1, 2), (2, 1)}
    assert V.knn(q.limit(0), c, 1).count() == 0


@pytest.mark.parametrize("dim, tile", [(2, 7), (1024, 50), (1024, 1)])
def test_knn_tiles_and_vectors_that_cannot_be_used(spark, dim, tile):
    rng = np.random.default_rng(dim)
    c = [(i, rng.normal(size=dim)) for i in range(30)]
    q = [(i, rng.normal(size=dim)) for i in range(5)]
    cd = spark.createDataFrame([(i, v.tolist()) for i, v in c] + [(900, None), (901, [1.0] * (dim + 1)), (902, [])], "chunk_id long, embedding array<double>")
    qd = spark.createDataFrame([(0, None)] + [(i + 1, v.tolist()) for i, v in q] + [(99, [1.0])], "query_id long, embedding array<double>")
    got = {}
    for r in V.knn(qd, cd, 4, tile=tile).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id - 1, []).append(r.chunk_id)
    want = {i: sorted(range(30), key=lambda j: -float(v @ c[j][1] / np.linalg.norm(v) / np.linalg.norm(c[j][1])))[:4] for i, v in q}
    assert got == want


@pytest.mark.parametrize("cells", [1, 3, 12])
def test_knn_skips_cells_and_misses_nothing(spark, cells):
    rng = np.random.default_rng(7)
    tops = rng.normal(size=(10, 8)) * 4
    v = np.concatenate([tops[rng.integers(0, 10, 400)] + rng.normal(size=(400, 8)) * 0.2, np.zeros((3, 8)), np.ones((4, 8))])
    domains = [["a", "b", None][i % 3] for i in range(len(v))]
    cd = spark.createDataFrame([(i, x.tolist(), d) for i, (x, d) in enumerate(zip(v, domains))], "chunk_id long, embedding array<double>, domain string")
    asks = [(i, v[i * 7], [None, [], ["a"], ["a", "b"], ["none"]][i % 5]) for i in range(40)] + [(100, np.zeros(8), None), (101, np.zeros(8), ["b"])]
    qd = spark.createDataFrame([(i, x.tolist(), d) for i, x, d in asks], "query_id long, embedding array<double>, domains array<string>")
    hits, report = V.Index(cd, cells=cells, numbers=8 * 30).search(qd, 6, query_numbers=8 * 5)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.rank))
    unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x
    for i, x, d in asks:
        s = {j: float(unit(x) @ unit(v[j])) for j in range(len(v)) if not d or domains[j] in d}
        want = sorted(s, key=lambda j: (-round(s[j], 12), j))[:6]
        mine = [j for j, _ in got.get(i, [])]
        assert np.allclose([s[j] for j in mine], [s[j] for j in want]) and len(mine) == len(want) and [k for _, k in got.get(i, [])] == list(range(1, len(want) + 1))
    assert report["row_pairs"] == len(asks) * len(v) and report["cell_pairs_visited"] <= report["cell_pairs"]
    if cells == 12:
        assert report["row_pairs_visited"] < 0.4 * report["row_pairs"]


def test_knn_size_is_not_taken_from_a_bad_query(spark):
    c = [(i, [float(i), 1.0, 2.0]) for i in range(5)] + [(50, [1.0]), (51, None), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0])]
    cd = spark.createDataFrame(c, "chunk_id long, embedding array<double>")
    qd = spark.createDataFrame([(0, [1.0]), (1, [1.0, 1.0, 2.0]), (2, [0.0, 1.0, 2.0])], "query_id long, embedding array<double>")
    got = V.knn(qd, cd, 2).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {r.side: (r.n_rows, r.n_left_out) for r in V.left_out(qd, cd, 3).collect()} == {"queries": (3, 1), "corpus": (9, 4)}


def test_vectorise_places(spark):
    import hashlib
    texts = ["a b a", "", None, "Word word WORD other", " x "]
    for r in V.vectorise(spark.createDataFrame([(t,) for t in texts], "t string"), "t", dim=16).collect():
        want = np.zeros(16)
        for w in (r.t or "").lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        assert np.allclose(r.embedding, want / (np.linalg.norm(want) or 1))


def test_domain_codes_in_a_list(spark):
    c = spark.createDataFrame([(1, "Geographical Indications"), (2, "Patents"), (3, "Designs")], "id long, domain string")
    ids = lambda d: sorted(r.id for r in V.apply_filters(c, domain=d).collect())
    assert ids(["gi", "patents"]) == [1, 2] and ids("gi") == [1] and ids(["all", "gi"]) == [1, 2, 3] and ids("Designs") == [3] and ids([]) == [1, 2, 3]


def test_vector_checks_and_filters(spark):
    v = spark.createDataFrame([(1, [float("nan"), 1.0], "x"), (2, [1.0], " "), (3, [1.0, 0.0], "y")], "chunk_id int, embedding array<double>, text string")
    assert {(r.chunk_id, r.issue) for r in V.check_vectors(v, 2, text="text").collect()} == {(1, "nan_or_inf"), (2, "dimension"), (2, "empty_text")}
    d = spark.createDataFrame([("Geographical Indications", "en"), ("Patents", "mr")], "domain string, language string")
    assert V.apply_filters(d, domain="gi").count() == 1 and V.apply_filters(d, domain="all").count() == 2
    assert V.apply_filters(d, domain=["Patents"], language="en").count() == 0
    u = V.vectorise(spark.createDataFrame([("a b b",)], "t string"), "t", dim=32).head().embedding
    assert sum(x * x for x in u) == pytest.approx(1.0, abs=1e-5)


GOLDEN = [
    ("What is a patent?", {"ip": 0.50}), ("What is a geographical indication?", {"ip": 0.62}),
    ("What is access and benefit sharing?", {"abs": 1.00, "tk": 0.86}), ("What is traditional knowledge?", {"tk": 0.71}),
    ("What does Section 11 of the Patents Act deal with?", {"ip": 1.00, "legal": 0.62}),
    ("Can traditional knowledge be protected through patents?", {"tk": 0.71, "ip": 0.50}),
    ("What obligations apply when accessing biological resources with traditional knowledge?", {"abs": 0.86, "legal": 0.75, "tk": 0.71}),
]


@pytest.mark.parametrize("q,routes", GOLDEN)
def test_routing_golden(spark, q, routes):
    r = RO.routing(RO.select_routes(RO.route_scores(spark.createDataFrame([(q,)], "query string")))).head()
    assert [s.route for s in r.selected] == list(routes)
    assert r.reason == "; ".join(f"{k}({v:.2f})" for k, v in routes.items())


def test_route_selection_rules(spark):
    def pick(*scores):
        rows = [([(n, i, s) for i, (n, s) in enumerate(zip(["legal", "tk", "abs", "ip"], scores))],)]
        df = spark.createDataFrame(rows, "scores array<struct<route:string,ord:int,score:double>>")
        return [s.route for s in RO.select_routes(df).head().selected]
    assert pick(0.1, 0.2, 0.2, 0.0) == ["tk"]
    assert pick(0.3, 0.3, 0.9, 0.2) == ["abs", "legal", "tk"]
    assert pick(0.26, 0.5, 0.0, 0.0) == ["tk"]
    assert pick(0.26, 0.35, 0.0, 0.0) == ["tk", "legal"]


def test_context_budget(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    b = spark.createDataFrame([(1, i + 1, "x" * n) for i, n in enumerate([900, 500, 400])], "query_id int, rank int, block string")
    small = {r.query_id: r for r in EV.context(q, b, 1500).collect()}
    assert small[1].n_sources == 2 and small[2].context == EV.NO_EVIDENCE
    big = EV.context(q, b, 1700).filter("query_id = 1").head()
    assert big.n_sources == 3 and big.context.endswith("x" * 300 + "\n[TRUNCATED]") and "x" * 301 not in big.context.split("\n\n")[-1]


def test_relevance_decision_confidence(spark):
    q = spark.createDataFrame([(1, "A b c d"), (2, "z")], "query_id int, query string")
    h = spark.createDataFrame([(1, 1, 0.5, "a B x")], "query_id int, rank int, score double, text string")
    r = EV.relevance(q, h)
    assert r.head().relevance == pytest.approx(0.5 * 0.7 + 0.5 * 0.3)
    assert {x.query_id: x.status for x in EV.decide(q, r).collect()} == {1: "sufficient", 2: "insufficient_evidence"}
    c = EV.route_confidence(spark.createDataFrame([(0.5, "see Section 3"), (0.5, "y" * 60), (0.95, "the act " * 10)], "relevance double, answer string"))
    assert [x.confidence for x in c.collect()] == [0.5, 0.5, 1.0]


def test_final_result(spark):
    rows = [(1, "a", 0, "error", 0.1, ""), (1, "b", 1, "success", 0.4, "yes"), (2, "a", 0, "success", 0.4, "p"), (2, "b", 1, "success", 0.6, "q"),
            (3, "a", 0, "error", 0.2, ""), (3, "b", 1, "error", 0.2, "")]
    df = spark.createDataFrame(rows, "query_id int, route string, route_ord int, status string, confidence double, answer string")
    got = {r.query_id: (r.outcome, r.route, r.success) for r in EV.final_result(df).collect()}
    assert got == {1: ("single", "b", True), 2: ("combine", None, True), 3: ("failed", "a", False)}


def test_percentiles_equal_numpy(spark):
    rng = random.Random(3)
    xs = [rng.choice([1.0, 2.5, rng.random() * 1000]) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    for few, ways in ((1, 4), (30, 16), (4096, 256)):
        got = {r.q: r.value for r in EL.exact_percentiles(df, "v", [0.0, 0.5, 0.95, 1.0], few, ways).collect()}
        for q, v in got.items():
            assert v == pytest.approx(float(np.quantile(xs, q)))


def test_percentiles_beside_a_far_value(spark):
    # 100,000 values in a thousandth of a unit beside one of 1e300: no range that is read in order grows with them
    df = spark.range(100_000).select((1 + F.col("id") / 1e8).alias("v")).unionByName(spark.createDataFrame([(1e300,), (None,), (float("nan"),)], "v double"))
    got = {r.q: r.value for r in EL.exact_percentiles(df, "v", [0.5, 0.95, 1.0], few=500).collect()}
    assert got[0.5] == 1 + 50_000 / 1e8 and got[0.95] == 1 + 95_000 / 1e8 and got[1.0] == 1e300
    assert [r.value for r in EL.exact_percentiles(df.limit(0), "v", [0.5]).collect()] == [None]


def grams(t):
    return {t[i:i + 5] for i in range(len(t) - 4)}


def test_overlap(spark):
    a = spark.createDataFrame([(1, "abcdefg")], "id int, text string")
    b = spark.createDataFrame([(2, "xbcdefy")], "id int, text string")
    assert [tuple(r) for r in Q.overlap_join(a, b, min_overlap=0).collect()] == [(1, 2, 5)]
    assert spark.createDataFrame([("a😀bcde",)], "t string").select(Q.grams(F.col("t"))).head()[0] == ["a😀bcd", "😀bcde"]


def test_overlapping_sections_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(d, 0, "section", i, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for d in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, kind string, sec_idx int, content string")
    got = {((r.a.doc_id, r.a.sec_idx), (r.b.doc_id, r.b.sec_idx)): r.overlap_chars for r in Q.overlapping_sections(df).collect()}
    want = {}
    for x in rows:
        for y in rows:
            n = 5 * len(grams(x[4]) & grams(y[4]))
            if x[0] < y[0] and n > 100:
                want[(x[0], x[3]), (y[0], y[3])] = n
    assert want and got == want


def test_copies_of_a_section_are_compared_once(spark):
    a, b = "the same words stand in every copy of it", "the same words stand in every copy of that"
    rows = [(d, 0, "section", i, t) for d in range(3) for i, t in enumerate([a, b, a, "", None, "abc"])] + [(9, 0, "rule", 0, "only here: a text that nobody else has")]
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, kind string, sec_idx int, content string")
    members, classes = Q.gram_classes(df)
    assert classes.count() == 3 and members.count() == 10
    (pair,) = Q.overlapping_classes(classes).collect()
    assert (pair.a.doc_id, pair.a.sec_idx, pair.b.doc_id, pair.b.sec_idx, pair.overlap_chars) == (0, 0, 0, 1, 5 * len(grams(a) & grams(b)))
    got = {((r.a.doc_id, r.a.sec_idx), (r.b.doc_id, r.b.sec_idx)): r.overlap_chars for r in Q.overlapping_sections(df).collect()}
    want = {((x[0], x[3]), (y[0], y[3])): 5 * len(grams(x[4]) & grams(y[4])) for x in rows for y in rows
            if x[4] and y[4] and x[0] < y[0] and 5 * len(grams(x[4]) & grams(y[4])) > 100}
    assert got == want and len(got) == 27
    one = spark.createDataFrame([r for r in rows if r[0] == 0], df.schema)
    assert Q.overlapping_classes(Q.gram_classes(one)[1]).count() == Q.overlapping_sections(one).count() == 0


@pytest.mark.parametrize("strange", [False, True])
def test_overlap_by_tiles_moves_texts_only(spark, monkeypatch, strange):
    from corpusframe.operators import gramtiles
    rng = random.Random(4)
    words = ["alpha", "beta", "g😀mma", "delta", "omega\n"] + ([chr(0x4E00 + 9 * i) + chr(0x4E01 + 9 * i) for i in range(9000)] if strange else [])
    rows = [(rng.randint(0, 9), 0, rng.choice(["section", "rule"]), i, " ".join(rng.choices(words[:5], k=rng.randint(1, 14)))) for i in range(60)]
    if strange:  # more kinds of characters than grams of one number hold
        rows.append((3, 0, "section", 90, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, kind string, sec_idx int, content string")
    classes = Q.gram_classes(df)[1]
    assert not [f.name for f in classes.schema.fields if f.dataType.typeName() == "array"]
    pairs = Q.overlapping_classes(classes, block_chars=10 ** 7 if strange else 700)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.a, r.b): r.overlap_chars for r in pairs.collect()}
    c, want = classes.collect(), {}
    for x in c:
        for y in c:
            n = 5 * len(grams(x.text) & grams(y.text))
            if x.rep < y.rep and n > 100 and min(x.lo, y.lo) < max(x.hi, y.hi):
                want[x.rep, y.rep] = n
    assert len(want) > 100 and got == want
    monkeypatch.setattr(gramtiles, "SIDE", 7)
    monkeypatch.setattr(gramtiles, "DENSE", 20)
    monkeypatch.setattr(gramtiles, "OPEN", 50)
    monkeypatch.setattr(gramtiles, "PIECE", 100)
    texts = [x.text for x in c]
    here = np.arange(0, len(texts), 2)
    for there in (None, np.arange(1, len(texts), 2)):
        found = {(int(i), int(j)): int(m) for a, b, s in gramtiles.pairs_of(texts, here, there, 5, 21) for i, j, m in zip(a, b, s)}
        every = [(i, j) for i in here for j in (here if there is None else there) if there is not None or i < j]
        assert found == {(min(i, j), max(i, j)): m for i, j in every if (m := len(grams(texts[i]) & grams(texts[j]))) >= 21}


def test_search_tiles_give_few_candidates(monkeypatch):
    import numpy as np
    import pandas as pd
    made, best = [], V._best
    monkeypatch.setattr(V, "_best", lambda *a: made.append(best(*a)) or made[-1])
    r = np.random.default_rng(3)
    q, c = V._unit(r.normal(size=(5000, 8))), r.normal(size=(9000, 8))
    got = V._search(np.arange(5000), q, pd.DataFrame({"chunk_id": np.arange(9000), "embedding": list(c)}), 5, 2_000_000)
    want = np.sort(q[:50] @ V._unit(c).T, axis=1)[:, :-6:-1]
    assert np.allclose(got[got.query_id < 50].similarity.to_numpy().reshape(50, 5), want)
    assert sum(len(x[0]) for x in made) < 3 * len(got)


def test_overlap_join_opens_few_counts_in_a_task(spark):
    words = ["abcdefg", "bcdefgh", "xyzabcdefg", "aaaaaaa", "q", None, "zzabcdefgzz"]
    a = spark.createDataFrame([*enumerate(words * 3), (0, "bcdefgh"), (None, "abcdefg")], "id int, text string")
    b = spark.createDataFrame([(100, "abcdefgh"), (101, "aaaaaabc"), (102, None), (101, "xyzab")], "id int, text string")
    want = {}
    for i, x in a.collect():
        for j, y in b.collect():
            want[i, j] = want.get((i, j), 0) + 5 * len(grams(x or "") & grams(y or ""))
    want = sorted((str(i), j, c) for (i, j), c in want.items() if c > 5)
    for kw in ({}, {"pairs": 4, "sent_grams": 3}):
        got = Q.overlap_join(a, b, min_overlap=5, **kw)
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    few = Q.overlap_join(a, b, min_overlap=5, pairs=2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gram" not in plan and "hashpartitioning(left_id" in plan and few.rdd.getNumPartitions() == 23 * 4 // 2


def test_search_holds_few_pairs_of_rows_and_cells():
    r, cells, dim = np.random.default_rng(0), 2048, 64
    vectors = list(r.normal(size=(4000, dim)).astype(np.float32))
    centres = V._unit(vectors[:cells])
    index = V.Index.__new__(V.Index)
    index.centres, index.dim, index.cell, index.radius, index.n, index.domain = centres, dim, np.arange(cells), np.full(cells, 3.0), np.full(cells, 20), [None] * cells
    rows = pd.DataFrame({"chunk_id": np.arange(4000), "embedding": vectors})
    asks = pd.DataFrame({"query_id": np.arange(400), "embedding": vectors[:400], "least": -1.0})
    for step, most in ((V._assign(centres)([rows]), 4000), (index._visits(5, True, True)([asks]), 2_000_000 // dim)):
        tracemalloc.start()
        seen = [len(x) for x in step]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 << 20 and max(seen) <= most
    assert sum(seen) == 400 * (cells - 1)  # all but the cell that holds k rows, which the first phase visits
    near = pd.concat(V._assign(centres)([rows]))
    assert (near["__cell"].to_numpy() == (V._unit(vectors) @ centres.T).argmax(1)).all()


def test_search_in_rounds_and_blocks_misses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=(230, 6)), np.zeros((2, 6)), np.ones((8, 6))])
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    cd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    for name, value in (("ROUND_NUMBERS", 6 * 100), ("LEAST_BLOCK", 6 * 20), ("CELL_NUMBERS", 6 * 40), ("QUERY_NUMBERS", 6 * 25)):
        monkeypatch.setattr(V, name, value)
    for cells in (None, 3):
        got = {}
        for r in V.knn(cd.withColumnRenamed("chunk_id", "query_id"), cd, 5, query_numbers=6 * 7, cell_numbers=6 * 11, cells=cells).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
        assert len(got) == len(v)
        for i, x in enumerate(unit):
            s = np.round(unit @ x, 12)
            mine = [j for _, j in got[i]]
            assert [k for k, _ in got[i]] == [1, 2, 3, 4, 5] and np.allclose(s[mine], np.sort(s)[::-1][:5])


def test_search_moves_few_copies_however_little_is_compared_at_once(spark):
    rng = np.random.default_rng(3)
    cd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 4)))], "chunk_id long, embedding array<double>")
    index = V.Index(cd, cells=12, numbers=4 * 30)
    # a query moves once to a block of cells, not once to each 30 rows
    assert sum(index.parts) <= V.ROW_BLOCKS and len(index.block) == 12
    asks = pd.DataFrame({"query_id": range(3000), "embedding": list(rng.normal(size=(3000, 4))), "least": -1.0})
    moved = pd.concat(index._visits(5, True, True)([asks]))
    assert not moved.duplicated(["query_id", "__block"]).any() and len(moved) <= 3000 * sum(index.parts)
    cells = sum(np.unpackbits(np.frombuffer(x, np.uint8)).sum() for x in moved["cells"])
    assert cells > len(moved)


EVERY_VECTOR = ["search_results", "relevance", "decide", "dedupe_evidence", "source_block", "source_block_short", "context", "source_list", "citations", "prompt_table",
                "hit_at_k", "cross_language_rate", "score_stats", "per_domain_per_language"]


def test_evidence_and_evaluation_ask_with_every_vector(spark):
    from corpusframe.plans import catalog
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert not [name for name in EVERY_VECTOR if "% 20" in catalog.ORACLES[name] or "// 200" in catalog.ORACLES[name]]
    assert catalog.QUERIES["hit_at_k"](spark, sf).first()["queries"] == n
    for name in ("decide", "source_list"):
        assert catalog.QUERIES[name](spark, sf).select("query_id").distinct().count() == n
    routes = catalog.QUERIES["dedupe_evidence"](spark, sf)
    assert routes.select("query_id", "route_ord").distinct().count() > 0.9 * n


def test_overlap_of_a_small_table_is_cut_into_many_tasks(spark):
    from corpusframe.operators import gramtiles
    rng = random.Random(5)
    rows = [((i, "section"), " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12)), i % 4, False) for i in range(40)]
    df = spark.createDataFrame(rows, "key struct<doc_id: int, kind: string>, text string, doc int, spread boolean")
    many = gramtiles.shared_grams(df, 2_500_000, 5, 21)
    got = {(r.a.doc_id, r.b.doc_id): r.shared for r in many.collect()}
    want = {(x[0][0], y[0][0]): n for x in rows for y in rows if x[0] < y[0] and x[2] != y[2] and (n := len(grams(x[1]) & grams(y[1]))) >= 21}
    assert got == want and len(want) > 50
    assert many.rdd.getNumPartitions() == 2 * 55
    r = np.random.default_rng(0)
    row, gram = np.sort(r.integers(0, 9, 500)), r.integers(0, 40, 500)
    for far in (1, 2 ** 57):  # one number holds row and gram, or not
        a, b = gramtiles._distinct(row, gram * far)
        assert sorted(set(zip(row.tolist(), (gram * far).tolist()))) == list(zip(a.tolist(), b.tolist()))
