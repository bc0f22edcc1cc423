import pytest
from pyspark.sql import functions as F

from corpusframe.functions import language as L
from corpusframe.functions import rules as R
from corpusframe.functions import text as X

col = F.col


@pytest.mark.parametrize("raw,clean", [
    ("Water boils at a hundred degrees.", "Water boils at a hundred degrees."), (" \t The bridge is closed.  ", "The bridge is closed."),
    ("यह पुल बंद है।", "यह पुल बंद है।"), ("हा पूल बंद आहे.", "हा पूल बंद आहे."),
    ("<|system|>be brief<|user|>why<|assistant|>because", "be briefwhybecause"),
    ("Thinking... which bridge? ...done thinking. The old one.", "The old one."), ("", ""),
    ("We are given a case. Yes", "Yes"), ("a\nAnswer: b\x1b[0m", "a b"), (". , x", "x"),
])
def test_scrub(one, raw, clean):
    assert one(raw, lambda c: X.scrub(col(c))) == clean


@pytest.mark.parametrize("raw,clean", [
    ("the law ,  and", "the 1aw, and"), ("1O2O3 0ver", "10203 Over"), ("return a|b x1y", "retum aib xly"),
    ("a__b ( c )", "a—b (c)"), ("क्या है", "कय ह"), ("lA", "LA"),
])
def test_clean_ocr(one, raw, clean):
    assert one(raw, lambda c: X.clean_ocr_column(col(c))) == clean


def test_clean_ocr_counts_rules_that_changed_something(spark):
    df = spark.createDataFrame([("law  1O2",), ("fine",)], "t string")
    assert [r.artifacts for r in X.clean_ocr(df, "t").collect()] == [3, 0]
    assert {r.rule: r.changed for r in X.rule_report(df, "t").collect() if r.changed} == {"l_to_1": 1, "o_to_0": 1, "spaces": 1}
    assert X.clean_ocr(df, "t", R.SAFE_OCR_RULES).head().cleaned == "law 102"


def test_clean_all_strings_reaches_nested_values(spark):
    df = spark.createDataFrame([(1, {"a": "x  y", "b": ["p  q", None]})], "i int, s struct<a:string,b:array<string>>")
    assert X.clean_all_strings(df).head() == (1, ("x y", ["p q", None]))


@pytest.mark.parametrize("raw,clean", [
    ("exam-\n ple one", "example one"), ("a , b ( c", "a, b (c"), ("a\n\n\n\nb", "a\n\nb"), ("x||y ____ z", "xy  z"),
    ("कलम ३ – §", "कलम ३ [UNCLEAR] [UNCLEAR]"),
])
def test_clean_page_text(one, raw, clean):
    assert one(raw, lambda c: X.clean_page_text(col(c))) == clean


@pytest.mark.parametrize("raw,clean", [("O I 2", "0 1 2"), ("O I", "0 I"), ("rnii 1s", "mu is"), ("i o 5", "1 0 5")])
def test_fix_confusions(one, raw, clean):
    assert one(raw, lambda c: X.fix_confusions(col(c))) == clean


@pytest.mark.parametrize("raw,q", [("", 0.0), (" \n", 0.0), ("short", 0.5), ("abcdefghij", 1.0), ("ab#@%^&*!~", 0.2)])
def test_text_quality(one, raw, q):
    assert one(raw, lambda c: X.text_quality(col(c))) == pytest.approx(q)


def test_small_cleaners(one):
    assert one("  a   b\n\n   c", lambda c: X.preserve_layout(col(c))) == "  a b\n\n   c"
    assert one("under Sec. 5, sub-sec. (2a) CLAUSE (b) of the act x", lambda c: X.standardise_refs(col(c))) == \
        "under Section 5, Sub-section (2a) Clause (b) of the Act,x"
    assert one("Biological Resources", lambda c: X.replace_terms(col(c))) == "biological resource"
    assert one(' "The  Act"... ', lambda c: X.clean_title(col(c))) == '"The Act"...'
    assert one('"The  Act"..', lambda c: X.clean_title(col(c))) == "The Act"
    assert one("The Patents Act, 1970!", lambda c: X.slug(col(c))) == "the_patents_act_1970"
    assert sorted(one("What's a patent? A PATENT.", lambda c: X.word_set(col(c)))) == ["a", "patent", "s", "what"]
    assert one("ಪೆಟೆಂಟ್ ಕಾನೂನು ಏನು", lambda c: X.substitute_glossary(col(c), F.lit("kn"))) == "patent law what"
    assert one("ಏನು", lambda c: X.substitute_glossary(col(c), F.lit("en"))) == "ಏನು"
    assert one("hm **Answer**: yes\nmore", lambda c: X.answer_block(F.lit(" "), col(c))) == "**Answer**: yes"


@pytest.mark.parametrize("q,lang,conf", [
    ("What is a patent?", "en", 1.0), ("पेटेंट क्या है?", "hi", 1.0), ("पेटंट म्हणजे काय?", "mr", 1.0), ("પેટન્ટ શું છે", "gu", 1.0),
    ("123", "en", 0.8), ("", "unknown", 0.0), ("日本", "unknown", 0.0),
])
def test_query_language(spark, q, lang, conf):
    r = L.query_language(spark.createDataFrame([(q,)], "q string"), "q").head()
    assert r.language == lang
    if lang not in ("hi", "mr"):
        assert r.language_confidence == conf


def test_query_language_compat_keeps_punctuation(spark):
    df = spark.createDataFrame([("पेटंट म्हणजे काय?",)], "q string")
    assert L.query_language(df, "q", compat=True).head().language == "hi"


def test_script_language(spark):
    df = spark.createDataFrame([("abc",), ("कखगघ",), ("कखगab ",), (" ",), ("日本語中",)], "t string")
    got = [(r.language, r.confidence) for r in L.script_language(df, "t").collect()]
    assert got == [("en", 0.99), ("mr", 0.99), ("mixed", 0.9), ("unknown", None), ("unknown", None)]


def test_strip_takes_all_unicode_space_and_reads_the_ends_only(spark):
    odd = ["\u3000 a b \u2028", "\x85x\xa0", "\x1fx\x1f", "\u180ex\u200b", " \n", "", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    got = df.select(X.strip(F.col("t")), X.lstrip(F.col("t")), X.is_blank(F.col("t")))
    assert [r[0] for r in got.collect()] == ["a b", "x", "\x1fx\x1f", "\u180ex\u200b", "", "", None]
    assert df.filter(~X.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp_replace" not in got._jdf.queryExecution().executedPlan().toString()
