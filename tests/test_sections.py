"""Extraction, repair, merge, hierarchy, chunks: hand-worked cases and sequential re-computations."""

import random

import pytest
from pyspark.sql import functions as F

from corpusframe.operators import canonical as C
from corpusframe.operators import chunk as CH
from corpusframe.operators import extract as E
from corpusframe.operators import merge as M
from corpusframe.operators import normalise as N
from corpusframe.operators import ordered as O
from corpusframe.operators import repair as RP
from corpusframe.operators import validate as V

PAGE = "doc_id long, page_idx int, page_number int, page_type string, raw_text string, document_type string, document_name string"
SEC = ("doc_id long, page_idx int, page_number int, page_type string, kind string, sec_idx int, section_number string, "
       "section_title string, content string, is_continuation boolean")


def page(spark, *texts, name="Some Act", kind="Act"):
    return spark.createDataFrame([(1, i, i + 1, "content", t, kind, name) for i, t in enumerate(texts)], PAGE)


def sec(page_idx, number, title, content, flag=False, idx=0, doc=1, page_type="content"):
    return (doc, page_idx, page_idx + 1, page_type, "section", idx, number, title, content, flag)


def test_provisions_and_gate(spark):
    text = "preamble\n1. Short title of it.\nThis Act\n  2. Definitions here\nIn this\n\n3.ab\n10. Last one here"
    rows = E.extract_provisions(page(spark, text)).orderBy("sec_idx").collect()
    assert [(r.section_number, r.section_title, r.content, r.kind) for r in rows] == [
        ("1", "Short title of it", "This Act", "section"), ("2", "Definitions here", "In this\n\n3.ab", "section"),
        ("10", "Last one here", "", "section")]
    assert {r.kind for r in E.extract_provisions(page(spark, text, kind="Other")).collect()} == {"section", "rule"}
    toc = page(spark, text).withColumn("page_type", F.lit("table_of_contents"))
    assert E.extract_provisions(toc).count() == 0
    deva = E.extract_provisions(page(spark, "१. नियमाचे नाव\nमजकूर")).head()
    assert (deva.section_number, deva.content) == ("१", "मजकूर")


def test_fallback_only_where_strict_finds_nothing(spark):
    rows = E.extract_with_fallback(page(spark, "1. Title with capital\nx\n2. lower case title\ny", "3. lower only here\nz")).collect()
    assert [(r.page_idx, r.section_number, r.found_by) for r in rows] == [(0, "1", "strict"), (1, "3", "loose")]
    assert rows[0].content == "x\n2. lower case title\ny"


def test_amendments(spark):
    text = ("For section 3 of the principal Act, the following section shall be substituted\nnew text\n"
            "4. In section 6 the words shall be omitted\n5. Amendment of section 7 of it\nrepeal")
    rows = {(r.form, r.section_number): r for r in E.extract_amendment_sections(page(spark, text)).collect()}
    assert rows["substitution", "3"].section_title == "Substitution of section 3"
    r = rows["amending", "4"]
    assert (r.amendment_action, r.target_section, r.section_title) == ("omission", "6", "Omission of section 6")
    got = {(r.amendment_number, r.target_section, r.amendment_action) for r in E.extract_amendments(page(spark, text)).collect()}
    assert got == {("sub_3", "3", "substitution"), ("5", "7", "repeal")}
    assert E.amendment_heads(page(spark, text)).head().amendment_action == "amendment"


def test_definitions_items_headed_lines(spark):
    text = '(a) "patent" means a thing\nSchedule II - Fees\nFORM 3 Application\nTable 4: Rates\nSection 5A: Scope\nRule 6\nfee means money'
    p = page(spark, text)
    d = E.extract_definitions(p).head()
    assert (d.clause, d.term) == ("a", "patent")
    assert {(r.item_kind, r.number, r.title) for r in E.extract_items(p).collect()} == {
        ("schedule", "II", "Fees"), ("form", "3", "Application"), ("table", "4", "Rates")}
    assert {(r.kind, r.number, r.title) for r in E.extract_headed_lines(p).collect()} == {("section", "5A", "Scope"), ("rule", "6", "")}
    assert [(r.term, r.definition) for r in E.definition_lines(p).collect()] == [("fee", "money")]
    assert "fee" in [r.term.split("\n")[-1].split(" ")[-1] for r in E.legal_terms(p, "raw_text", ["doc_id"]).collect()]


def test_counting_structures_equals_extracting_them(spark):
    text = '1. First one here\n(a) "x" means y\nSchedule II\nForm 3\n2. Amendment of section 4 now'
    p = page(spark, text, "nothing", kind="Other")
    got = E.count_structures(p).orderBy("page_idx").select(*[f"n_{k}" for k in V.STRUCTURES]).collect()
    assert [tuple(r) for r in got] == [(2, 2, 1, 1, 1, 1), (0, 0, 0, 0, 0, 0)]
    assert [r.page_idx for r in V.orphan_text(E.count_structures(p)).collect()] == [1]


def test_page_continuation(spark):
    p = page(spark, "It ends.", "Starts here and goes", "on here", "Section 4 here", "", "x")
    assert [r.is_continuation for r in E.page_continuation(p).orderBy("page_idx").collect()] == [False, False, True, False, False, False]


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_ordered_helpers_do_not_depend_on_the_block(spark, block):
    rng = random.Random(block)
    rows = [(k, i, rng.choice([None, 1, 2]), rng.randint(0, 3)) for k in (1, 2) for i in range(11)]
    df = spark.createDataFrame(rows, "k int, i int, e int, v int")
    s = {(r.k, r.i): r.s for r in O.running_sum(df, ["k"], ["i"], "i", F.col("v"), "s", block).collect()}
    l = {(r.k, r.i): r.l for r in O.last_event(df, ["k"], ["i"], "i", F.col("e"), "l", block, inclusive=False).collect()}
    c = {(r.k, r.i): r.c for r in O.left_context(df, ["k"], "i", F.col("v"), "c", min(2, block), block).collect()}
    ix = {(r.k, r.i): r["index"] for r in O.numbered(df, [], ["k", "i"], "index").collect()}
    for n, (k, i, e, v) in enumerate(rows):
        mine = [r for r in rows if r[0] == k and r[1] <= i]
        assert s[k, i] == sum(r[3] for r in mine)
        seen = [r[2] for r in mine if r[1] < i and r[2] is not None]
        assert l[k, i] == (seen[-1] if seen else None)
        assert c[k, i] == [r[3] for r in mine if i - min(2, block) <= r[1] < i]
        assert ix[k, i] == n


def test_page_number_issues(spark):
    rows = [(1, i, n, "content", "", "Act", "") for i, n in enumerate([1, 2, 2, 5])]
    got = {(r.issue, r.page_number) for r in V.page_number_issues(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {("duplicate", 2), ("missing", 3), ("missing", 4)}


def test_recover_title_and_content(spark):
    p = page(spark, "7. The real title\nThe content of section seven is this.\n8. Next Title here\nz")
    s = spark.createDataFrame([sec(0, "7", "", ""), sec(0, "8", "kept", "kept", idx=1)], SEC)
    t = RP.recover_title(p, s).orderBy("sec_idx").collect()
    assert [r.section_title for r in t] == ["The real title", "kept"]
    c = RP.recover_content(p, s).orderBy("sec_idx").collect()
    assert [r.content for r in c] == ["The content of section seven is this.", "kept"]
    log = RP.repair_log(s, RP.recover_content(p, RP.recover_title(p, s))).collect()
    assert {r.action_type for r in log} == {"recover_title", "recover_content"}


def test_add_missing_sections(spark):
    p = page(spark, "1. Title of this one\nbody", "2. Title of that one\nbody")
    s = spark.createDataFrame([sec(0, "1", "a", "b")], SEC)
    got = {(r.page_idx, r.section_number, r.added) for r in RP.add_missing_sections(p, s).collect()}
    assert got == {(0, "1", False), (1, "2", True)}


def test_mark_continuations_cases(spark):
    s = spark.createDataFrame([sec(i, "7", "", c) for i, c in ((0, "A"), (1, ""), (2, ""), (4, ""))], SEC)
    got = [(r.content, r.is_continuation) for r in RP.mark_continuations(s).orderBy("page_idx").collect()]
    assert got == [("A", False), ("A", True), ("A", True), ("", False)]
    s = spark.createDataFrame([sec(i, "7", "", c, f) for i, c, f in ((0, "A", False), (1, "", True), (2, "", False))], SEC)
    assert [r.content for r in RP.mark_continuations(s).orderBy("page_idx").collect()] == ["A", "", ""]


def test_mark_continuations_equals_the_page_by_page_loop(spark):
    rng = random.Random(5)
    rows = [sec(p, rng.choice(["1", "2", ""]), "", rng.choice(["", "", "x", "y"]), rng.random() < .2, i, doc=d)
            for d in range(6) for p in range(12) for i in range(rng.randint(0, 3))]
    got = {(r.doc_id, r.page_idx, r.sec_idx): (r.content, r.is_continuation) for r in RP.mark_continuations(spark.createDataFrame(rows, SEC)).collect()}
    state = {(r[0], r[1], r[5]): [r[6], r[8], r[9]] for r in rows}
    for d in range(6):
        for p in range(1, 12):
            before = [state[k] for k in sorted(state) if k[:2] == (d, p - 1)]
            for k in sorted(k for k in state if k[:2] == (d, p)):
                number, text, flag = state[k]
                first = next((b for b in before if b[0] == number), None)
                if number and not flag and not text and first and first[1]:
                    state[k] = [number, first[1], True]
    assert got == {k: (v[1], v[2]) for k, v in state.items()}


def test_merge_runs(spark):
    texts = {4: "alpha beta gamma delta " * 5, 5: "one two three four five " * 5, 8: "red green blue white black " * 5}
    s = spark.createDataFrame([sec(p - 1, "7.", "T" if p == 5 else "", t) for p, t in texts.items()], SEC)
    got = sorted((r.page_number, r.source_pages, r.merge_status, r.section_title) for r in M.merge_sections(s).collect())
    assert got == [(4, [4, 5], "merged", "T"), (8, [8], "kept_separate", "")]


def test_merge_drops_contents_entries_and_repeats(spark):
    real = "the quick brown fox jumps over the lazy dog again and again and again"
    s = spark.createDataFrame([sec(0, "1", "Title", "short"), sec(3, "1", "Title", real), sec(4, "1", "", real + " more", True),
                               sec(0, "2", "Only", ""), sec(1, "", "x", "y")], SEC)
    rows = M.merge_sections(s).collect()
    by = {(r.section_number, r.page_idx): r for r in rows}
    assert set(by) == {("1", 3), ("2", 0), ("", 1)}
    assert by["1", 3].content == real and by["1", 3].n_parts == 2
    acts = {(r.section_number, r.action, r.reason) for r in M.merge_actions(s, M.merge_sections(s)).collect()}
    assert ("2", "kept_separate", "the number stands once") in acts and ("1", "merged", "joined 2 parts from pages [4, 5]") in acts


def test_merge_keeps_parts_after_a_blank_first(spark):
    s = spark.createDataFrame([sec(0, "1", "", ""), sec(1, "1", "", "second part"), sec(2, "1", "", "third bit of text")], SEC)
    assert [r.content for r in M.merge_sections(s).collect()] == ["second part\nthird bit of text"]


def fold_by_hand(parts):
    text = ""
    for p in parts:
        a, b = set(text.split()), set(p.split())
        repeats = bool(a and b) and len(a & b) / min(len(a), len(b)) > 0.7
        text = text if p == "" or text and repeats else text + ("" if text == "" or text.endswith("\n") else "\n") + p
    return text.strip()


def test_fold_of_parts_equals_the_replay(spark):
    rng = random.Random(7)
    runs = [[" ".join(rng.choices("a b c d e f g h i j".split(), k=rng.randint(0, 6))) + rng.choice(["", "\n", " "]) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    runs += [["", " ", "x"], ["x y z", "x y z"], [], ["\n", "\n", "a"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, r array<string>")
    got = {r.i: r.t for r in df.select("i", M.fold_parts(F.col("r")).alias("t")).collect()}
    assert got == {i: fold_by_hand(r) for i, r in enumerate(runs)}
    assert df.select(M.fold_parts(F.when(F.col("i") < 0, F.col("r"))).alias("t")).filter("t IS NOT NULL").count() == 0


def test_ten_thousand_parts_of_one_number(spark):
    """Each part has words of its own, so the text grows to the end; every third part repeats the one before it."""
    parts = [" ".join(f"w{i - (i % 3 == 2)}x{j}" for j in range(20)) for i in range(10_000)]
    s = spark.createDataFrame([sec(i, "1", "", t, True) for i, t in enumerate(parts)], SEC)
    r = M.merge_sections(s).collect()
    assert len(r) == 1 and r[0].n_parts == 10_000
    assert r[0].content == "\n".join(t for i, t in enumerate(parts) if i % 3 != 2)


def test_simple_merge(spark):
    s = spark.createDataFrame([sec(0, "1", "", "a", True), sec(1, "1", "", "b"), sec(1, "", "", "c", idx=1)], SEC)
    got = [(r.content, r.is_continuation) for r in M.simple_merge(s).orderBy("page_idx", "sec_idx").collect()]
    assert got == [("a b", False), ("", True), ("c", False)]


def test_hierarchy(spark):
    text = "\n".join(["(1) No person shall", "(a) take", "(ii) or keep", "(b) sell", "(2) Subject to fee", "Provided that it is paid",
                      "Explanation. Fee means x", "tail"])
    r = N.parse_hierarchy(spark.createDataFrame([(text,)], "content string")).head()
    got = [(s.number, s.text, [(c.number, [x.number for x in c.sub_clauses]) for c in s.clauses]) for s in r.subsections]
    assert got == [("(1)", "(1) No person shall", [("(a)", ["(ii)"]), ("(b)", [])]), ("(2)", "(2) Subject to fee tail", [])]
    assert [p.type for p in r.provisos] == ["provided_that"] and len(r.explanations) == 1


def test_references_and_entities(spark):
    df = spark.createDataFrame([("Under Section 3 and sub-section (2), the Central Government shall; Registrar; 1st January 2003",)], "content string")
    r = N.normalise(df).head()
    assert [(x.reference_type, x.target) for x in r.cross_references] == [("section", "3"), ("subsection", "2")]
    assert N.normalise(df, compat=True).head().cross_references[0].target == "i"
    assert r.legal_entities == ["Central Government"] and r.authorities == ["Central Government", "Registrar"]
    assert r.dates == ["1st January 2003", "2003"] and r.keywords == ["shall"]
    fix = spark.createDataFrame([("", "Section 12A. x"), ("Section 5", ""), ("7.", "")], "section_number string, content string")
    assert [x.section_number for x in N.fix_section_number(fix).collect()] == ["12A", "5", "7."]


def test_domain_terms_across_a_page_break(spark):
    p = page(spark, "about biological", "diversity and traditional", "", "")
    r = C.classify_domains(p).head()
    assert r.primary_domain == "Biodiversity"
    q = page(spark, "mutually", "agreed", "terms")
    assert C.classify_domains(q).head().primary_domain == "Access and Benefit Sharing"
    assert C.classify_domains(page(spark, "zzz")).head().primary_domain is None


def test_type_and_year(spark):
    docs = spark.createDataFrame([(1, "Untitled", "", None)], "doc_id long, document_name string, document_type string, year int")
    p = page(spark, "nothing", "rules made under it in 1999", "an act to x 2001")
    assert C.infer_doc_type(docs, p).head().document_type == "Rule"
    assert C.infer_year(docs, p).head().year == 1999
    assert C.infer_doc_type(docs.withColumn("document_name", F.lit("X Amendment Act")), p).head().document_type == "Amendment Act"


@pytest.mark.parametrize("parts,longest,sizes", [([5000, 2998, 50], 8000, [8000]), ([9000, 200], 8000, [9000, 200]), ([100], 8000, [100]),
                                                 ([4000, 4000], 8000, [4000, 4000])])
def test_split_long(spark, parts, longest, sizes):
    text = "\n\n".join("x" * n for n in parts)
    got = spark.createDataFrame([(text,)], "t string").select(CH.split_long(F.col("t"), longest, 100)).head()[0]
    assert [len(x) for x in got] == sizes


def test_split_long_equals_the_replay(spark):
    rng = random.Random(3)
    texts = ["\n\n".join(rng.choice("abc") * rng.choice([0, 1, 7, 30, 98, 99, 100, 101, 250]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    texts += ["\n" * 300, " " * 300, "z" * 500 + "\n\n" + "y", "\n\n".join("p" * 9 for _ in range(20_000))]
    got = {r.i: r.p for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", CH.split_long(F.col("t"), 100, 20).alias("p")).collect()}
    for i, t in enumerate(texts):
        want, cur = [], ""
        for p in filter(None, (x.strip() for x in t.split("\n\n"))):
            if cur and len(cur) + len(p) + 2 > 100:
                want, cur = want + [cur], ""
            cur = f"{cur}\n\n{p}" if cur else p
        assert got[i] == ([t] if len(t) <= 100 else [x for x in want + [cur] if len(x) >= 20])


def test_chunk_ids_count_on(spark):
    s = C.canonicalise(N.normalise(spark.createDataFrame([sec(0, "1", "A", "x" * 120), sec(1, "2", "", "\n\n".join(["y" * 120] * 3)), sec(2, "3", "", "")], SEC)))
    docs = spark.createDataFrame([(1, "The Act, 1970", "Act", 1970, "Patents", [], "en", "India", "s")],
                                 "doc_id long, document_name string, document_type string, year int, primary_domain string, secondary_domains array<string>, language string, jurisdiction string, source string")
    rows = CH.make_chunks(docs, s, longest=200).collect()
    assert sorted(r.chunk_id for r in rows) == ["the_act_1970_sec_1_0", "the_act_1970_sec_2_1", "the_act_1970_sec_2_2", "the_act_1970_sec_2_3"]
    split = [r for r in rows if r.section_number == "2"]
    assert {r.section_title for r in split} == {f"Section 2 (part {i})" for i in (1, 2, 3)} and split[0].metadata.merge_status == "split"
    first = next(r for r in rows if r.section_number == "1")
    assert first.embedding_text == "Document: The Act, 1970\nDomain: Patents\nSection 1: A\n\n" + "x" * 120 + "\n\n"


def test_the_repair_reads_the_texts_of_pages_once(spark, monkeypatch):
    calls, spans = [], RP.spans
    monkeypatch.setattr(RP, "spans", lambda pages: calls.append(1) or spans(pages))
    cols = "doc_id string, page_idx int, page_number int, page_type string, document_name string, raw_text string"
    p = spark.createDataFrame([("d", 0, 1, "content", "x", "7. Grant of things\nthe body of the section is here")], cols)
    s = spark.createDataFrame([("d", 0, 1, "content", "section", 0, "7", "", "", False)],
                              "doc_id string, page_idx int, page_number int, page_type string, kind string, sec_idx int, section_number string, section_title string, content string, is_continuation boolean")
    r = RP.repair(p, s).head()
    assert (r.section_title, r.content, len(calls)) == ("Grant of things", "the body of the section is here", 1)
