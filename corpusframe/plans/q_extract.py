"""Queries: page and section extraction over the statute-shaped corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.operators import extract as E
from corpusframe.plans import statutes as S
from corpusframe.plans.q_text import q, rr
from corpusframe.plans.registry import query, table

strip = S.sql_strip


@query("page_type", "WITH " + S.SQL_PAGES + " SELECT doc_id, page_idx, page_type FROM pages_s")
def page_type(spark, sf):
    return S.pages(spark, sf).select("doc_id", "page_idx", "page_type")


@query("page_type_simple", f"""WITH {S.SQL_RAW}, x AS (
  SELECT doc_id, page_idx, page_number, raw_text || CASE doc_id % 4 WHEN 0 THEN ' Table of contents' WHEN 1 THEN ' definitions means means'
    WHEN 2 THEN ' Form signature' ELSE ' Introduction' END AS raw_text FROM raw_pages),
l AS (SELECT *, lower(raw_text) AS t FROM x)
SELECT doc_id, page_idx, CASE WHEN page_number <= 3 AND contains(t,'contents') THEN 'table_of_contents'
  WHEN page_number = 1 AND (contains(t,'preamble') OR contains(t,'introduction')) THEN 'preamble'
  WHEN contains(t,'definitions') AND (length(raw_text) - length(replace(raw_text,'means','')))/5 > 2 THEN 'definition'
  WHEN contains(t,'schedule') THEN 'schedule' WHEN contains(t,'form') AND (contains(t,'field') OR contains(t,'signature')) THEN 'form'
  ELSE 'content' END AS page_type FROM l""")
def page_type_simple(spark, sf):
    p = S.raw_pages(spark, sf)
    k = F.pmod("doc_id", F.lit(4))
    more = F.when(k == 0, " Table of contents").when(k == 1, " definitions means means").when(k == 2, " Form signature") \
        .otherwise(" Introduction")
    return E.page_type_simple(p.withColumn("raw_text", F.concat("raw_text", more))).select("doc_id", "page_idx", "page_type")


@query("extraction_gate", "WITH " + S.SQL_PAGES + """ SELECT doc_id, page_idx, kind FROM pages_s, (VALUES ('section'), ('rule')) k(kind)
WHERE page_type <> 'table_of_contents' AND CASE WHEN document_type IN ('Act','Amendment Act') THEN kind='section'
  WHEN document_type='Rules' THEN kind='rule' ELSE true END""")
def extraction_gate(spark, sf):
    return E.extraction_gate(S.pages(spark, sf)).select("doc_id", "page_idx", "kind")


@query("extract_provisions", "WITH " + S.SQL_SECTIONS + """
SELECT doc_id, page_idx, kind, sec_idx, section_number, section_title, content FROM sections_s""")
def extract_provisions(spark, sf):
    return S.sections(spark, sf).select("doc_id", "page_idx", "kind", "sec_idx", "section_number", "section_title", "content")


STRICT = r"(?:^|\n)\s*(\d+)\.\s+(?:\([^)]+\)\s*)?([A-Z][^\n]{10,})"
SQL_FALLBACK = "WITH " + S.SQL_RAW + f""",
{S.sql_spans(f"raw_pages WHERE regexp_matches(raw_text, '{STRICT}')", STRICT, 'st', 'doc_id, page_idx', {'num': 1, 'ttl': 2})},
{S.sql_spans(f"raw_pages WHERE NOT regexp_matches(raw_text, '{STRICT}')", S.HEAD, 'lo', 'doc_id, page_idx', {'num': 1, 'ttl': 2})},
un AS (SELECT *, 'strict' AS found_by FROM st UNION ALL SELECT *, 'loose' FROM lo),
fallback AS (SELECT doc_id, page_idx, sec_idx, num AS section_number, {S.sql_title('ttl', False)} AS section_title, {strip('body')} AS content, found_by FROM un)"""


@query("extract_with_fallback", SQL_FALLBACK + " SELECT * FROM fallback WHERE content <> '' OR section_title <> ''")
def extract_with_fallback(spark, sf):
    return E.extract_with_fallback(S.raw_pages(spark, sf))


ACTION = lambda c: f"""CASE WHEN contains(lower({c}),'substitution') OR contains(lower({c}),'substituted') THEN 'substitution'
  WHEN contains(lower({c}),'insertion') OR contains(lower({c}),'inserted') THEN 'insertion'
  WHEN contains(lower({c}),'omission') OR contains(lower({c}),'omitted') THEN 'omission'
  WHEN contains(lower({c}),'repeal') THEN 'repeal' ELSE 'amendment' END"""
TARGET = lambda c: f"coalesce(nullif(regexp_extract({c}, '(?i)section\\s+(\\d+)', 1), ''), 'unknown')"
CAP = lambda c: f"upper(left({c},1)) || lower(substr({c},2))"
SUBST_LINE = "For section {n} of the principal Act, the following section shall be substituted"
SQL_AMENDED = S.SQL_RAW.replace("raw_pages AS", "raw0 AS") + """,
raw_pages AS (SELECT doc_id, page_idx, page_number, 'For section ' || page_number
  || ' of the principal Act, the following section shall be substituted' || chr(10) || raw_text || chr(10)
  || 'For section 9 of the principal Act the following section shall be substituted: ' || length(raw_text) AS raw_text FROM raw0)"""
SUBST = R.SUBSTITUTION.replace("(?Ud)", "")
AMENDING = R.AMENDING.replace("(?Ud)", "")
AMENDMENT_OF = R.AMENDMENT_OF.replace("(?Ud)", "")


def amended_pages(spark, sf):
    p = S.raw_pages(spark, sf)
    return p.withColumn("raw_text", F.concat(
        F.lit("For section "), F.col("page_number").cast("string"),
        F.lit(" of the principal Act, the following section shall be substituted\n"), F.col("raw_text"),
        F.lit("\nFor section 9 of the principal Act the following section shall be substituted: "), F.length("raw_text").cast("string")))


@query("extract_amendment_sections", f"""WITH {SQL_AMENDED},
{S.sql_spans('raw_pages', SUBST, 'su', 'doc_id, page_idx', {'head': 0, 'num': 1})},
{S.sql_spans('raw_pages', AMENDING, 'am', 'doc_id, page_idx', {'head': 0, 'num': 1})},
am2 AS (SELECT doc_id, page_idx, sec_idx, num, {strip('head || body')} AS content FROM am),
am3 AS (SELECT *, {ACTION('content')} AS act, {TARGET('content')} AS tgt FROM am2)
SELECT doc_id, page_idx, 'substitution' AS form, sec_idx, num AS section_number, 'Substitution of section ' || num AS section_title,
  {strip('head || body')} AS content, 'substitution' AS amendment_action, num AS target_section FROM su
UNION ALL SELECT doc_id, page_idx, 'amending', sec_idx, num, {CAP('act')} || ' of section ' || tgt, content, act, tgt FROM am3""")
def extract_amendment_sections(spark, sf):
    return E.extract_amendment_sections(amended_pages(spark, sf))


@query("amendment_action_and_target", f"""SELECT doc_id, {ACTION('t')} AS amendment_action, {TARGET('t')} AS target_section FROM (
  SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' substituted' WHEN 1 THEN ' Insertion in Section  12' WHEN 2 THEN ' omitted section 3'
    WHEN 3 THEN ' repeal' WHEN 4 THEN ' amendment' ELSE '' END AS t FROM documents)""")
def amendment_action_and_target(spark, sf):
    k = F.pmod("doc_id", F.lit(6))
    more = F.when(k == 0, " substituted").when(k == 1, " Insertion in Section  12").when(k == 2, " omitted section 3") \
        .when(k == 3, " repeal").when(k == 4, " amendment").otherwise("")
    t = F.concat("text", more)
    return table(spark, sf, "documents").select("doc_id", E.amendment_action(t).alias("amendment_action"),
                                                E.target_section(t).alias("target_section"))


@query("extract_amendments", f"""WITH {SQL_AMENDED},
{S.sql_spans('raw_pages', SUBST, 'su', 'doc_id, page_idx', {'head': 0, 'num': 1})},
{S.sql_spans('raw_pages', AMENDMENT_OF, 'am', 'doc_id, page_idx', {'head': 0, 'num': 1, 'tgt': 3})},
am2 AS (SELECT *, {strip('head || body')} AS t FROM am)
SELECT doc_id, page_idx, sec_idx AS item_idx, 'sub_' || num AS amendment_number, num AS target_section, 'substitution' AS amendment_action,
  {strip('head || body')} AS amendment_text FROM su
UNION ALL SELECT doc_id, page_idx, sec_idx, num, tgt, {ACTION('t')}, t FROM am2""")
def extract_amendments(spark, sf):
    return E.extract_amendments(amended_pages(spark, sf))


@query("amendment_heads", f"""WITH {S.SQL_RAW},
{S.sql_spans('raw_pages', AMENDMENT_OF, 'am', 'doc_id, page_idx', {'head': 0, 'num': 1, 'w': 2, 'tgt': 3})}
SELECT doc_id, page_idx, sec_idx AS item_idx, num AS amendment_number, tgt AS target_section,
  lower(regexp_extract(w, '^\\w+')) AS amendment_action, {strip('head')} AS amendment_text FROM am""")
def amendment_heads(spark, sf):
    return E.amendment_heads(S.raw_pages(spark, sf))


DEFN = R.DEFINITION_HEAD.replace("(?Ud)", "")


@query("extract_definitions", f"""WITH {S.SQL_RAW},
{S.sql_spans('raw_pages', q(DEFN), 'de', 'doc_id, page_idx', {'head': 0, 'clause': 1, 'term': 2})}
SELECT doc_id, page_idx, sec_idx AS item_idx, clause, {strip('term')} AS term, {strip('head')} AS definition_text FROM de""")
def extract_definitions(spark, sf):
    return E.extract_definitions(S.raw_pages(spark, sf))


DLINE = q(R.DEFINITION_LINE.replace("(?Ud)", ""))


@query("definition_lines", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line0, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents),
m AS (SELECT doc_id, line_idx, {strip("regexp_extract(line0, '^[A-Za-z]+') || ' shall mean ' || line0")} AS line FROM l)
SELECT doc_id, line_idx, regexp_extract(line, '{DLINE}', 1) AS term, regexp_extract(line, '{DLINE}', 2) AS definition
FROM m WHERE regexp_matches(line, '{DLINE}')""")
def definition_lines(spark, sf):
    d = table(spark, sf, "documents")
    shaped = F.transform(F.split("text", "\n"), lambda x: F.concat(F.regexp_extract(x, "^[A-Za-z]+", 0), F.lit(" shall mean "), x))
    return E.definition_lines(d.select("doc_id", F.array_join(shaped, "\n").alias("raw_text")), key=["doc_id"])


TERM = q(R.TERM_USE.replace("(?Ud)", ""))


@query("legal_terms", f"""WITH {S.SQL_RAW}, t AS (SELECT doc_id, page_idx, regexp_extract_all(raw_text, '{TERM}', 1) AS ts FROM raw_pages)
SELECT doc_id, page_idx, j - 1 AS term_idx, {strip('ts[j]')} AS term FROM t, unnest(range(1, len(ts)+1)) u(j) WHERE {strip('ts[j]')} <> ''""")
def legal_terms(spark, sf):
    return E.legal_terms(S.raw_pages(spark, sf), "raw_text", ["doc_id", "page_idx"])


def _items() -> str:
    ctes, sel = [], []
    for kind, p in R.ITEM_HEADS.items():
        ctes.append(S.sql_spans("raw_pages", p.replace("(?Ud)", ""), f"i_{kind}", "doc_id, page_idx", {"head": 0, "num": 1, "rest": 2}))
        sel.append(f"SELECT doc_id, page_idx, '{kind}' AS item_kind, sec_idx AS item_idx, num AS number, nullif({strip('rest')}, '') AS title, {strip('head')} AS content FROM i_{kind}")
    return ",\n".join(ctes) + ",\nitems AS (" + " UNION ALL ".join(sel) + ")"


SQL_ITEMS = _items()


@query("extract_items", f"WITH {S.SQL_RAW}, {SQL_ITEMS} SELECT * FROM items")
def extract_items(spark, sf):
    return E.extract_items(S.raw_pages(spark, sf))


HS, HR = (R.HEADED_LINES[k].replace("(?Ud)", "").replace(r"\p{L}\p{N}_", r"\w") for k in ("section", "rule"))


@query("extract_headed_lines", f"""WITH {S.SQL_RAW}, l AS (
  SELECT doc_id, page_idx, unnest(string_split(raw_text, chr(10))) AS line0, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_idx FROM raw_pages),
m AS (SELECT *, {strip('line0')} AS line FROM l)
SELECT doc_id, page_idx, line_idx, 'section' AS kind, regexp_extract(line, '{HS}', 1) AS number, regexp_extract(line, '{HS}', 2) AS title FROM m WHERE regexp_matches(line, '{HS}')
UNION ALL SELECT doc_id, page_idx, line_idx, 'rule', regexp_extract(line, '{HR}', 1), regexp_extract(line, '{HR}', 2) FROM m WHERE regexp_matches(line, '{HR}')""")
def extract_headed_lines(spark, sf):
    return E.extract_headed_lines(S.raw_pages(spark, sf))


@query("extract_html_headings", """WITH l AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|title)[^>]*>([^<]*)', 1)) AS kind, unnest(regexp_extract_all(html, '<(h[1-6]|title)[^>]*>([^<]*)', 2)) AS title,
    generate_subscripts(regexp_extract_all(html, '<(h[1-6]|title)[^>]*>([^<]*)', 1), 1) - 1 AS item_idx FROM pages)
SELECT page_id, item_idx, kind, title FROM l""")
def extract_html_headings(spark, sf):
    """The item generator with another corpus' head pattern."""
    p = table(spark, sf, "pages").select("page_id", "html")
    return E.spans(p, "html", r"<(h[1-6]|title)[^>]*>([^<]*)", {"kind": 1, "title": 2}, index="item_idx") \
        .select("page_id", "item_idx", "kind", "title")


@query("page_continuation", f"""WITH {S.SQL_RAW}, w AS (
  SELECT doc_id, page_idx, raw_text, lag(raw_text) OVER (PARTITION BY doc_id ORDER BY page_idx) AS prev FROM raw_pages)
SELECT doc_id, page_idx, coalesce(raw_text <> '' AND prev <> '' AND NOT (contains(left(raw_text,100),'Section')
  OR contains(left(raw_text,100),'Rule') OR contains(left(raw_text,100),'Article'))
  AND NOT regexp_matches({strip('right(prev, 200)')}, '[.):"]$'), false) AS is_continuation FROM w""")
def page_continuation(spark, sf):
    return E.page_continuation(S.raw_pages(spark, sf)).select("doc_id", "page_idx", "is_continuation")


@query("infer_metadata", "WITH " + S.SQL_DOCS + " SELECT doc_id, document_name, document_type, domain, year FROM docs")
def infer_metadata(spark, sf):
    return S.documents(spark, sf).select("doc_id", "document_name", "document_type", "domain", "year")
