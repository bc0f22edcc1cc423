"""Embedding whitening, page text and conversation trie, against direct answers."""

import hashlib
import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import html_extract, page_grammar, prefix_trie, whitening
from corpusframe.llm.html_leaves import Leaves
from corpusframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# ---- whitening ----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("dim", [1, 2, 7, 40])
def test_rank_one_updates_equal_the_scatter(dim):
    r = np.random.default_rng(dim)
    x = np.floor(r.normal(size=(200, dim)) * np.linspace(0, 90, dim))
    x[:, -1] = x[:, 0]
    one = whitening.empty_spectrum(dim)
    for row in x:
        one = whitening.absorb(one, 1, row, np.zeros((0, dim)))
    parts = whitening.merged([whitening.add_rows(whitening.empty_spectrum(dim), p) for p in np.array_split(x, 5)])
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    for n, mean, d, u in (one, parts):
        assert n == 200 and np.allclose(mean, x.mean(0)) and np.abs(u.T @ u - np.eye(dim)).max() < 1e-12
        assert np.abs(u @ np.diag(d) @ u.T - scatter).max() <= 1e-11 * max(1, np.abs(scatter).max()) and (np.diff(d) >= 0).all()


def test_secular_roots_are_the_eigenvalues():
    r = np.random.default_rng(1)
    d, z = np.sort(r.normal(size=30)), r.normal(size=30)
    pole, off = whitening.secular_roots(d, z * z)
    assert np.allclose(np.sort(d[pole] + off), np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=0, atol=1e-12)


def whitened_directly(rows, k):
    """{id: (deviation, whitened up to sign)} and explained shares."""
    x = np.array([[int(np.floor(1024 * float(c))) for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    away = (x * n - s)
    c = away.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return [int((a * a).sum()) for a in away], c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_against_direct_decomposition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    got = QUERIES["op11_whitening"](spark, SF).orderBy("vec_id", "component").toPandas()
    deviation, white, explained = whitened_directly(rows, 8)
    table = got.whitened.to_numpy().reshape(-1, 8)
    assert got.vec_id.tolist() == [i for i, _ in rows for _ in range(8)] and got.component.tolist() == list(range(1, 9)) * len(rows)
    assert np.abs(table * np.sign((table * white).sum(0)) - white).max() < 1e-9 and np.allclose(got.explained[:8], explained, rtol=1e-9)
    assert got.deviation[::8].tolist() == deviation and set(got.n) == {len(rows)} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [0.5, -1.0, 3.0], None, [1.0, None, 2.0], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [1.0], [], [-7.0, 0.25, 3.0], [4.0, 0.0, 3.0]]
    rows = [(i if i != 2 else None, v, 0.5, 1) for i, v in enumerate(vectors)] + [(0, vectors[0], 0.1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, component int")
    got = whitening.whiten(df).toPandas()
    # six rows of size three; the third dimension never varies, so the third component is 0
    assert len(got) == 6 * 3 and got.vec_id.isna().sum() == 3 and set(got.n) == {6} and (got.whitened[got.component == 3] == 0).all()
    kept = [(None, vectors[i]) for i in (0, 1, 2, 9, 10, 0)]
    deviation, white, _ = whitened_directly(kept, 2)
    assert sorted(got.deviation[got.component == 1]) == sorted(deviation)
    for k in (0, 1):
        assert np.allclose(sorted(np.abs(got.whitened[got.component == k + 1])), sorted(np.abs(white[:, k])))
    for empty in (df.limit(0), df.filter("embedding is null")):
        assert whitening.whiten(empty).count() == 0
    alike = whitening.whiten(spark.createDataFrame([(i, [0.1, 0.2]) for i in range(5)], "vec_id int, embedding array<float>")).toPandas()
    assert (alike.whitened == 0).all() and (alike.deviation == 0).all() and (alike.explained == 0).all() and len(alike) == 10


def test_deviations_beyond_doubles_are_exact():
    away = np.array([[2 ** 31, 1, 3], [2 ** 31 + 1, 0, 0], [2 ** 32, 0, 0], [5, 0, 0]], dtype=np.int64)
    assert whitening.deviations(away).to_pylist() == [2 ** 62 + 10, (2 ** 31 + 1) ** 2, None, 25]


# ---- pages --------------------------------------------------------------------------------------------------------------------

def article_of(page: str) -> str:
    parts = re.split(r"<(?:/?p|/?h1|br)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.fit_on(spark.read.parquet(f"{SF}/pages.parquet"))


def test_pages_against_their_marked_article(spark, labeller):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_extract.extract(pages, labeller, keep=("page_id", "url", "html")).collect()
    assert len(got) == pages.count() and all(r.text == article_of(r.html) and r.n_chars == len(r.text) for r in got)


def test_other_layouts(labeller):
    words = [f"w{i}" for i in range(300)]
    read = Leaves()
    pages = page_grammar.pages(200, words, seed=1234)
    leaves = [read.of(p) for p, _ in pages]
    assert all([len(a) == len(y) for a, (_, y) in zip(leaves, pages)])
    p = html_extract.label(leaves, read.buckets, labeller)
    hit = np.concatenate([(a >= 0.5) == np.array(y) for a, (_, y) in zip(p, pages)])
    assert hit.mean() > 0.98


def test_leaves_of_broken_markup():
    texts = lambda page: [t for _, t, _ in Leaves().of(page)]
    assert texts("<p>a <b>b<p>c</b> d<br>e<ul><li>x<li>y<ul><li>z</ul></ul>tail") == ["a b", "c d e", "x", "y", "z", "tail"]
    assert texts("<script>var a='<p>no</p>'</script><p title='a>b'>yes</p><!-- <p>no</p> --><style>p{}</style>") == ["yes"]
    assert texts("a &lt;b&gt; &amp;amp; &#233;\xa0 \t\n c &copy; 1 < 2") == ["a <b> &amp; é c © 1 < 2"]
    assert texts("<head><title>t</title><meta x></head><div>a<div>b</div>c</div>") == ["a", "b", "c"]
    assert texts("<p>open <!-- never closed <p>x") == ["open"] and texts("<div <p>odd") == ["odd"] and texts('<a href="x>y</a><p>z</p>') == ["y", "z"]
    assert texts(None) == [] and texts("") == [] and texts("   <p> </p>") == [] and texts("<td>1<td>2<tr><td>3") == ["1", "2", "3"]
    deep = "<div class=a>" * 3000 + "x" + "</div>" * 3000
    assert texts(deep) == ["x"]


def test_pages_with_odd_rows(spark, labeller):
    long = "<body><nav><a href=x>home</a></nav><article>" + "<p>Some words of a text, again.</p>" * 4000 + "</article><footer>all rights reserved</footer>"
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", long, 6), (None, "u", long, 6), (3, "u", "<nav>x</nav>", 7), (4, "u", "<article><p>a&nbsp;b</p></article>", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.extract(df, labeller).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2, 3)] == ["", "", ""] and got[5].text == "a b" and got[5].n_chars == 3
    assert got[2].text == got[3].text == "\n".join(["Some words of a text, again."] * 4000)
    assert html_extract.extract(df.limit(0), labeller).count() == 0
    assert html_extract.fit_on(df.limit(0), drawn=30)["out"].shape == labeller["out"].shape


# ---- trie ---------------------------------------------------------------------------------------------------------------------

def trie_of(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string, depth string"


def test_trie_against_brute_force(spark):
    import random
    r = random.Random(1)
    rows = []
    for c in range(90):
        for t in range(r.choice([0, 1, 2, 3, 9, 30])):
            rows.append((c if r.random() > 0.01 else None, r.choice([t, t, None]), r.choice(["u", "a", None]), r.choice(["x", "y", "", "é", None])))
    for c in range(200, 240):  # every conversation a prefix of the next
        rows += [(c, t, "u", "z") for t in range(c - 200)]
    rows += [(c, t, "u", "copy") for c in range(300, 340) for t in range(3)] + [(c, 0, "u", "copy") for c in range(400, 420)] + [(400, 0, "u", "copy")]
    df = spark.createDataFrame([(*x, "extra") for x in rows], TURNS)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect()), key=str) == trie_of(rows)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    single = spark.createDataFrame([(7, None, None, None, None)], TURNS)
    assert list(map(tuple, prefix_trie.conversation_trie(single).collect())) == [r for r in trie_of([(7, None, None, None)])]


def test_trie_of_the_table(spark):
    got = sorted(map(tuple, QUERIES["op13_prefix_trie"](spark, SF).collect()), key=str)
    assert got == trie_of([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for r in got:
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: (x & -x, -x))


def test_rounds_grow_with_the_logarithm(spark):
    # 300 sequences that share long beginnings in a comb: few rounds all the same
    turns = spark.range(300).select(F.col("id").alias("conv"), F.explode(F.sequence(F.lit(1), F.col("id") % 60 + 2)).alias("pos")).withColumns(
        {"role": F.lit("u"), "text": F.when(F.col("pos") == F.col("conv") % 60 + 2, F.concat(F.lit("end"), "conv")).otherwise("same")})
    keys = prefix_trie.durable(prefix_trie.prefixes(turns))
    nodes, rounds = prefix_trie.build(turns.groupBy("conv").agg(F.max("pos").cast("long").alias("length")), keys)
    assert nodes.filter("rep is not null").select("k1", "k2").distinct().count() == nodes.count() >= 300 and rounds <= 12
