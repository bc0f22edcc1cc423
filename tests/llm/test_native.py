"""URL filters and quality rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusframe.llm import quality_rules, url_rules
from tests.llm.cases import docs, no_docs, odd_texts

LOWER = {i: i + 32 for i in range(65, 91)}


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(LOWER)
    best = None
    for h, p, v in rules:
        if None not in (h, p, v) and (host == h or host.endswith("." + h)) and host and path.startswith(p):
            best = max(best or ((-1, -1, "", ""),), ((len(h + p), len(h), h + p, v),))
    return (host, path, best[0][2] if best else None, best[0][3] if best else default)


def test_url_rules_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", "a.b.c.a.com", "", "com.", ".com", "a..com", "Ab.COM", "co.uk"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/X", "/\U0010ffff", "/x\U0010ffffz", "/é/", "/x/y/z?q=/x#f", "?x", "#/x/y"]
    urls = [None, "", "no scheme", "://", "http://", "a://b://c/x", "http:///x"] + [f"http://{h}{p}" for h in hosts for p in paths]
    rules = [(r.choice(hosts).lower(), r.choice(paths[:10]), r.choice(["allow", "block"])) for _ in range(40)] + [("com", "", "block"), (None, "/", "block"), ("net", None, "block")]
    seen = {}
    for h, p, v in rules:
        if None not in (h, p):
            seen[h, p] = max(v, seen.get((h, p), ""))
    rows = spark.createDataFrame([(i, u, "old", 7) for i, u in enumerate(urls)] + [(3, "://", "old", 7)], "page_id long, url string, rule string, extra int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    # small parts, so that a host's sweep is cut
    got = url_rules.judge(rows, table, part=2).collect()
    assert len(got) == len(urls) + 1 and set(got[0].asDict()) == {"page_id", "url", "extra", "host", "path", "rule", "verdict"}
    for g in got:
        want = judged(g.url, [(h, p, v) for (h, p), v in seen.items() if h])
        assert (g.host, g.path, g.rule, g.verdict) == want, g
    assert {g.rule for g in url_rules.judge(rows, table.limit(0)).collect()} == {None}
    assert url_rules.judge(rows.limit(0), table).count() == 0


def test_the_sweep_is_dealt_by_host_part(spark):
    rules = spark.sql("SELECT * FROM VALUES ('com', '/', 'allow'), ('a.com', '/x', 'block'), ('net', '/', 'block') AS t(host, path, verdict)")
    text = url_rules.judge(spark.range(9).select(F.concat(F.lit("http://a.com/"), "id").alias("url")), rules)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text and "REPARTITION_BY_COL" in text


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i:i + 3]), []).append(i)
    hit = {k + j for p in where.values() if len(p) > 1 for k in p for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_counts_against_brute_force(spark):
    extra = ["a b c a b c a b c", "x x x x", "#1 *2 $3 %4 &5 |6 <7>", "one\ntwo\none\n\n\n two\n two"]
    rows = docs(spark, odd_texts() + extra).withColumn("kept", F.lit("mine")).withColumn("extra", F.lit(1))
    got = quality_rules.measure(rows).collect()
    assert len(got) == len(odd_texts()) + len(extra) + 2 and got[0].extra == 1
    for g in got:
        n, chars, symbols, dup, rep = counts(g.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert g.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert g.kept is not None and not (g.kept and g.base_failed)
    assert quality_rules.measure(no_docs(spark)).count() == 0


@pytest.mark.parametrize("line, fails", [
    ("Home | News | About | Contact", True), ("BUY!! NOW!! CHEAP!!", True), ("All rights reserved.", True), ("a### b*** c$$$", True), ("A plain sentence, with words.", False),
    ("He said: stop! And they stopped.", False), ("A or B | C", False), ("=-=-=-=-=-= [x]", True), ("This work is licensed under CC BY 4.0.", True), ("Copyright (c) 2020 A. B.", True),
    ("Read more", True), ("Log in", True), ("We use cookies to serve you better.", True), ("She found the old catalog in the library attic.", False),
    ("You can read more about it in chapter three.", False), ("They would sign up for the choir every spring.", False), ("if a < b then c > d", False),
    ("Prices rose 5% in May & 7% in June.", False), ("The club changed its privacy policy after the vote.", False)])
def test_line_rules(spark, line, fails):
    got = spark.createDataFrame([(line,)], "x string").select(quality_rules.line_fails(F.col("x"), quality_rules.Rules())).head()[0]
    assert got is fails


def test_cleaning_takes_lines_and_rejects_what_lost_too_much(spark):
    good = "\n".join(" ".join(f"w{i}x{k}" for k in range(7)) + "." for i in range(12))
    rows = docs(spark, [good, good + "\n\nAll rights reserved.\n" + good.split("\n")[0], good + "\n" + "\n".join(f"A{i} | B{i} | C{i} | D{i} | E{i} | F{i} | G{i} | H{i} | I{i} | J{i} | K{i}"
                                                                                                      for i in range(40)), "short"])
    out = {r.doc_id: r for r in quality_rules.clean_documents(rows).collect()}
    assert set(out) == {0, 1} and out[0].text == good and out[1].text == good + "\n" and out[1].n_chars == len(good) + 1
    assert list(quality_rules.clean_documents(rows).columns) == rows.columns
    text = quality_rules.clean_documents(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text
