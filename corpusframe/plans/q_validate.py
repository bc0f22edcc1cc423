"""Queries: validation and profiling over the statute-shaped corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.operators import extract as E
from corpusframe.operators import validate as V
from corpusframe.plans import statutes as S
from corpusframe.plans.q_extract import AMENDMENT_OF, DEFN, SQL_ITEMS
from corpusframe.plans.q_text import q, rr
from corpusframe.plans.registry import query
from corpusframe.settings import durable

strip = S.sql_strip
K = ["doc_id", "page_idx"]


def structures(spark, sf, sections=None):
    p = S.raw_pages(spark, sf)
    s = sections if sections is not None else S.sections(spark, sf)
    return (s.select(*K, "kind")
            .unionByName(E.extract_items(p).filter("item_kind <> 'table'").select(*K, F.col("item_kind").alias("kind")))
            .unionByName(E.extract_definitions(p).select(*K, F.lit("definition").alias("kind")))
            .unionByName(E.amendment_heads(p).select(*K, F.lit("amendment").alias("kind"))))


SQL_STRUCT = S.SQL_DAMAGED + f""",
{SQL_ITEMS},
{S.sql_spans('raw_pages', q(DEFN), 'defs', 'doc_id, page_idx', {'clause': 1})},
{S.sql_spans('raw_pages', AMENDMENT_OF, 'amds', 'doc_id, page_idx', {'num': 1})},
structures AS (SELECT doc_id, page_idx, kind FROM sections_s UNION ALL SELECT doc_id, page_idx, item_kind FROM items WHERE item_kind <> 'table'
  UNION ALL SELECT doc_id, page_idx, 'definition' FROM defs UNION ALL SELECT doc_id, page_idx, 'amendment' FROM amds),
pcounts AS (SELECT p.*, coalesce(ns,0) AS ns, coalesce(nr,0) AS nr, coalesce(nd,0) AS nd, coalesce(na,0) AS na, coalesce(nc,0) AS nc, coalesce(nf,0) AS nf
  FROM pages_s p LEFT JOIN (SELECT doc_id, page_idx, count_if(kind='section')::BIGINT AS ns, count_if(kind='rule')::BIGINT AS nr, count_if(kind='definition')::BIGINT AS nd,
    count_if(kind='amendment')::BIGINT AS na, count_if(kind='schedule')::BIGINT AS nc, count_if(kind='form')::BIGINT AS nf FROM structures GROUP BY ALL) USING (doc_id, page_idx))"""


def gappy(spark, sf):
    """Pages with some fields missing and page numbers with gaps and repeats."""
    p = E.count_structures(S.pages(spark, sf))
    n = F.length("raw_text")
    return p.withColumns({
        "page_number": F.when(F.pmod(n, F.lit(5)) == 0, F.col("page_number") * 2).otherwise(F.col("page_number")),
        "page_type": F.when(F.pmod(n, F.lit(4)) == 0, F.lit("annex")).when(F.pmod(n, F.lit(9)) == 0, F.lit(None)).otherwise(F.col("page_type")),
    })


SQL_GAPPY = S.SQL_PAGES + """,
gappy AS (SELECT * REPLACE (CASE WHEN length(raw_text) % 5 = 0 THEN page_number*2 ELSE page_number END AS page_number,
  CASE WHEN length(raw_text) % 4 = 0 THEN 'annex' WHEN length(raw_text) % 9 = 0 THEN NULL ELSE page_type END AS page_type) FROM pages_s)"""
IN = lambda vs: "(" + ", ".join(f"'{v}'" for v in vs) + ")"


@query("conform_pages", "WITH " + SQL_GAPPY + f"""
SELECT doc_id, page_idx, 'missing page_type' AS message FROM gappy WHERE page_type IS NULL
UNION ALL SELECT doc_id, page_idx, 'unknown page type ' || page_type FROM gappy WHERE page_type NOT IN {IN(R.SCHEMA_PAGE_TYPES)}""")
def conform_pages(spark, sf):
    return V.conform_pages(gappy(spark, sf))[1]


@query("conform_sections", "WITH " + S.SQL_DAMAGED + """
SELECT doc_id, page_idx, kind, sec_idx, CASE WHEN length(content)%4=0 THEN '' ELSE section_number END AS section_number,
  CASE WHEN length(content)%6=0 THEN '' ELSE section_title END AS section_title, content, is_continuation FROM damaged""")
def conform_sections(spark, sf):
    n = F.length("content")
    s = S.damaged(spark, sf).withColumns({
        "section_number": F.when(F.pmod(n, F.lit(4)) != 0, F.col("section_number")),
        "section_title": F.when(F.pmod(n, F.lit(6)) != 0, F.col("section_title")),
        "content": F.nullif("content", F.lit("")), "is_continuation": F.when(F.col("is_continuation"), F.lit(True))})
    return V.conform_sections(s)[0].select(*K, "kind", "sec_idx", "section_number", "section_title", "content", "is_continuation")


@query("required_field_check", "WITH " + S.SQL_DAMAGED + """,
g AS (SELECT doc_id, CASE WHEN length(raw_text) % 9 <> 0 THEN page_type END AS page_type FROM pages_s),
p AS (SELECT doc_id, bool_and(page_type IS NOT NULL) AS ok FROM g GROUP BY 1),
s AS (SELECT doc_id, bool_and(content <> '') AS ok FROM damaged GROUP BY 1)
SELECT doc_id, true AS has_name, true AS has_pages, p.ok AS pages_ok, coalesce(s.ok, true) AS sections_ok, p.ok AND coalesce(s.ok, true) AS valid
FROM docs JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)""")
def required_field_check(spark, sf):
    p = S.pages(spark, sf).withColumn("page_type", F.when(F.pmod(F.length("raw_text"), F.lit(9)) != 0, F.col("page_type")))
    s = S.damaged(spark, sf).withColumn("content", F.nullif("content", F.lit("")))
    return V.required_field_check(S.documents(spark, sf), p, s)


@query("page_number_issues", "WITH " + SQL_GAPPY + """,
c AS (SELECT doc_id, page_number, count(*) AS n FROM gappy GROUP BY ALL),
r AS (SELECT doc_id, unnest(range(min(page_number), max(page_number)+1)) AS page_number FROM c GROUP BY doc_id)
SELECT doc_id, 'duplicate' AS issue, page_number, n - 1 AS extra FROM c WHERE n > 1
UNION ALL SELECT doc_id, 'missing', page_number, 0 FROM r ANTI JOIN c USING (doc_id, page_number)""")
def page_number_issues(spark, sf):
    return V.page_number_issues(gappy(spark, sf))


@query("page_gaps", "WITH " + SQL_GAPPY + """,
c AS (SELECT DISTINCT doc_id, page_number FROM gappy WHERE page_number IS NOT NULL),
w AS (SELECT doc_id, page_number, lag(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) AS prev FROM c)
SELECT doc_id, prev + 1 AS first, page_number - 1 AS last, page_number - prev - 1 AS n FROM w WHERE page_number - prev > 1""")
def page_gaps(spark, sf):
    return V.page_gaps(gappy(spark, sf))


@query("page_type_check", "WITH " + SQL_GAPPY + f"""
SELECT doc_id, page_idx, 'warning' AS severity, 'structural' AS category, 'page_type' AS field, 'page type not in the list: ' || page_type AS message
FROM gappy WHERE page_type NOT IN {IN(R.VALID_PAGE_TYPES)}""")
def page_type_check(spark, sf):
    return V.page_type_check(gappy(spark, sf))


SQL_ORPHAN = f"""SELECT doc_id, page_idx, 'warning' AS severity, 'content' AS category, 'raw_text' AS field,
  'raw_text length: ' || length(raw_text) AS message FROM pages_s ANTI JOIN structures USING (doc_id, page_idx) WHERE {strip('raw_text')} <> ''"""


@query("orphan_text", "WITH " + SQL_STRUCT + SQL_ORPHAN)
def orphan_text(spark, sf):
    return V.orphan_text(E.count_structures(S.pages(spark, sf)))


SQL_EMPTY = f"""SELECT doc_id, page_idx, 'warning' AS severity, 'content' AS category, 'sections[' || sec_idx || '].section_title' AS field,
  'blank title' AS message FROM damaged WHERE {strip('section_title')} = ''
UNION ALL SELECT doc_id, page_idx, 'warning', 'content', 'sections[' || sec_idx || '].content', 'blank content' FROM damaged WHERE {strip('content')} = ''"""


@query("empty_title_content", "WITH " + S.SQL_DAMAGED + SQL_EMPTY)
def empty_title_content(spark, sf):
    return V.empty_title_content(S.damaged(spark, sf))


LW = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"
SQL_COVER = f"""cov AS (SELECT doc_id, page_idx, kind, sec_idx, section_number,
  CASE WHEN len(pw) = 0 THEN 1.0 ELSE len(list_intersect(pw, sw))::DOUBLE / len(pw) END AS coverage, len(pw) > 0 AS has
  FROM (SELECT doc_id, page_idx, kind, sec_idx, section_number, {LW('content')} AS sw FROM damaged WHERE content <> '')
  JOIN (SELECT doc_id, page_idx, {LW('raw_text')} AS pw FROM pages_s) USING (doc_id, page_idx))"""


@query("coverage", "WITH " + S.SQL_DAMAGED + ", " + SQL_COVER + """
SELECT doc_id, page_idx, kind, sec_idx, section_number, round(coverage, 6) AS coverage, has AND coverage <= 0.3 AS low FROM cov""")
def coverage(spark, sf):
    return V.coverage(S.pages(spark, sf), S.damaged(spark, sf)).withColumn("coverage", F.round("coverage", 6))


SQL_PROFILE = "prof AS (" + " UNION ALL ".join(
    f"SELECT doc_id, page_idx, '{n}' AS pattern, regexp_extract_all(raw_text, '(?im){p}') AS h FROM pages_s" for n, p in R.LEGAL_PATTERNS) + ")"


@query("pattern_profile", "WITH " + S.SQL_PAGES + ", " + SQL_PROFILE + """
SELECT doc_id, page_idx, pattern, len(h) AS matches, array_to_string(h[1:5], '|') AS first_five FROM prof WHERE len(h) > 0""")
def pattern_profile(spark, sf):
    return V.pattern_profile(S.pages(spark, sf))


@query("pattern_profile_html", """WITH p(n, r) AS (VALUES ('link', '<a href="[^"]*"'), ('digits', '\\b\\d+\\b'), ('bold', '<b>|<strong>')),
x AS (SELECT page_id, n AS pattern, CASE n WHEN 'link' THEN regexp_extract_all(html, '(?im)<a href="[^"]*"')
  WHEN 'digits' THEN regexp_extract_all(html, '(?im)\\b\\d+\\b') ELSE regexp_extract_all(html, '(?im)<b>|<strong>') END AS h FROM pages, p)
SELECT page_id, pattern, len(h) AS matches, array_to_string(h[1:5], '|') AS first_five FROM x WHERE len(h) > 0""")
def pattern_profile_html(spark, sf):
    from corpusframe.plans.registry import table
    pats = [("link", '<a href="[^"]*"'), ("digits", r"\b\d+\b"), ("bold", "<b>|<strong>")]
    return V.pattern_profile(table(spark, sf, "pages"), pats, "html", ["page_id"])


SQL_ISSUES = f"""issues AS (
SELECT doc_id, page_idx, 'warning' AS severity, 'structural' AS category FROM gappy WHERE page_type NOT IN {IN(R.VALID_PAGE_TYPES)}
UNION ALL SELECT doc_id, page_idx, 'error', 'structural' FROM gappy WHERE page_type IS NULL
UNION ALL SELECT doc_id, NULL, 'warning', 'structural' FROM (SELECT doc_id FROM gappy GROUP BY doc_id, page_number HAVING count(*) > 1)
UNION ALL SELECT doc_id, NULL, 'warning', 'structural' FROM (SELECT doc_id, page_number - lag(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) AS g FROM (SELECT DISTINCT doc_id, page_number FROM gappy)) WHERE g > 1
UNION ALL SELECT doc_id, page_idx, severity, category FROM ({SQL_ORPHAN})
UNION ALL SELECT doc_id, page_idx, severity, category FROM ({SQL_EMPTY})
UNION ALL SELECT doc_id, page_idx, 'warning', 'legal_pattern' FROM cov WHERE has AND coverage <= 0.3
UNION ALL SELECT doc_id, page_idx, 'info', 'legal_pattern' FROM prof WHERE len(h) > 0)"""


@query("issue_rollup", "WITH " + SQL_STRUCT + SQL_GAPPY.replace(S.SQL_PAGES, "") + f", {SQL_COVER}, {SQL_PROFILE}, {SQL_ISSUES}" + """
SELECT doc_id, count_if(severity='error' AND category='structural')::BIGINT AS structural_errors, count_if(severity='warning' AND category='structural')::BIGINT AS structural_warnings,
  count_if(severity='error' AND category='content')::BIGINT AS content_errors, count_if(severity='warning' AND category='content')::BIGINT AS content_warnings,
  count_if(severity='warning' AND category='legal_pattern')::BIGINT AS uncovered_sections, count_if(severity='info')::BIGINT AS legal_pattern_flags,
  count_if(severity='error' AND category='structural') = 0 AS is_valid_structure FROM issues GROUP BY doc_id""")
def issue_rollup(spark, sf):
    return V.issue_rollup(V.all_issues(durable(gappy(spark, sf)), durable(S.damaged(spark, sf))))


PROV = "(" + " + ".join(f"contains(tl,'{w}')::INT" for w in R.PROVISION_WORDS) + ") >= 3"
ANYP = " OR ".join(f"regexp_matches(raw_text, '(?im){p}')" for _, p in R.LEGAL_PATTERNS)
SQL_SUSP = f"""susp0 AS (SELECT p.doc_id, p.page_idx, page_number, page_type, raw_text, lower(raw_text) AS tl, coalesce(n, 0) AS section_count, coalesce(odd, false) AS odd
  FROM pages_s p LEFT JOIN (SELECT doc_id, page_idx, count(*) AS n,
    bool_or((section_title <> '' AND content = '') OR (content <> '' AND length({strip('content')}) < 10)) AS odd FROM damaged WHERE kind='section' GROUP BY ALL) USING (doc_id, page_idx)),
susp AS (SELECT doc_id, page_idx, page_number, page_type, length(raw_text) AS text_length, section_count FROM susp0
  WHERE (page_type='form' AND {PROV}) OR (page_type='schedule' AND NOT regexp_matches(raw_text, '(?i)schedule\\s+[ivx]+'))
   OR (raw_text <> '' AND section_count = 0 AND ({ANYP})) OR odd)"""


@query("suspicious_pages", "WITH " + S.SQL_DAMAGED + ", " + SQL_SUSP + " SELECT * FROM susp")
def suspicious_pages(spark, sf):
    return V.suspicious_pages(S.pages(spark, sf), S.damaged(spark, sf))


@query("inspect", "WITH " + SQL_STRUCT + ", " + SQL_SUSP + f""",
pp AS (SELECT doc_id, count(*) AS num_pages, sum(ns)::BIGINT AS num_sections, sum(nd)::BIGINT AS num_definitions, sum(na)::BIGINT AS num_amendments,
  sum(nc)::BIGINT AS num_schedules, sum(nf)::BIGINT AS num_forms, count_if({strip('raw_text')} <> '' AND ns+nr+nd+na+nc+nf = 0)::BIGINT AS num_orphan_pages,
  round(avg(length(raw_text)), 2) AS avg_text_length FROM pcounts GROUP BY 1),
ss AS (SELECT doc_id, count_if({strip('section_title')}='') AS et, count_if({strip('content')}='') AS ec, count_if(is_continuation) AS cc,
  round(avg(CASE WHEN {strip('content')}<>'' THEN length(content) END), 2) AS al FROM damaged WHERE kind='section' GROUP BY 1),
su AS (SELECT doc_id, count(*) AS n FROM susp GROUP BY 1)
SELECT pp.*, coalesce(et,0)::BIGINT AS num_empty_titles, coalesce(ec,0)::BIGINT AS num_empty_contents, coalesce(cc,0)::BIGINT AS num_continuations,
  coalesce(al,0.0) AS avg_section_length, (coalesce(n,0) + num_orphan_pages)::BIGINT AS num_suspicious_pages
FROM pp LEFT JOIN ss USING (doc_id) LEFT JOIN su USING (doc_id)""")
def inspect(spark, sf):
    return V.inspect(E.count_structures(S.pages(spark, sf)), durable(S.damaged(spark, sf)))


@query("structure_counts", "WITH " + SQL_STRUCT + " SELECT doc_id, page_idx, ns AS n_section, nr AS n_rule, na AS n_amendment, nd AS n_definition, nc AS n_schedule, nf AS n_form FROM pcounts")
def structure_counts(spark, sf):
    """Counts by joining the extracted structures back to their pages."""
    c = V.structure_counts(S.pages(spark, sf), structures(spark, sf))
    return c.select(*K, *[f"n_{k}" for k in V.STRUCTURES])


@query("page_type_histogram", "WITH " + S.SQL_PAGES + " SELECT doc_id, page_type, count(*) AS pages FROM pages_s GROUP BY ALL")
def page_type_histogram(spark, sf):
    return V.page_type_histogram(S.pages(spark, sf))


@query("short_empty_sections", "WITH " + S.SQL_DAMAGED + f""", c AS (SELECT doc_id, page_idx, kind, sec_idx, section_number, length({strip('content')}) AS chars FROM damaged)
SELECT *, CASE WHEN chars = 0 THEN 'empty' ELSE 'short' END AS issue FROM c WHERE chars < 20""")
def short_empty_sections(spark, sf):
    return V.short_empty_sections(S.damaged(spark, sf))


@query("broken_refs", "WITH " + S.SQL_SECTIONS + """, m AS (SELECT doc_id, page_idx, kind, sec_idx,
  unnest(regexp_extract_all(content, '[Ss]ection\\s+(\\d+[\\w.\\-]*)', 1)) AS target FROM sections_s)
SELECT doc_id, target, page_idx, kind, sec_idx FROM m WHERE NOT EXISTS (SELECT 1 FROM sections_s s WHERE s.doc_id = m.doc_id AND s.section_number = m.target)""")
def broken_refs(spark, sf):
    return V.broken_refs(S.sections(spark, sf))


@query("orphan_continuations", "WITH " + S.SQL_DAMAGED + """, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section_number) AS n FROM damaged)
SELECT doc_id, section_number, page_idx, kind, sec_idx FROM c WHERE is_continuation AND n <= 1 AND section_number <> ''""")
def orphan_continuations(spark, sf):
    return V.orphan_continuations(S.damaged(spark, sf))


SQL_COUNTS = f"""counts AS (
  SELECT doc_id, document_type, coalesce(pn,0)::BIGINT AS pages, (CASE WHEN document_type='Rules' THEN 0 ELSE coalesce(s,0) END)::BIGINT AS sections,
    (CASE WHEN document_type IN ('Act','Amendment Act') THEN 0 ELSE coalesce(r,0) END)::BIGINT AS rules,
    (CASE WHEN document_type='Rules' THEN 0 ELSE coalesce(es,0) END)::BIGINT AS empty_sections,
    (CASE WHEN document_type IN ('Act','Amendment Act') THEN 0 ELSE coalesce(er,0) END)::BIGINT AS empty_rules,
    coalesce(sc,0)::BIGINT AS schedules, coalesce(fo,0)::BIGINT AS forms
  FROM docs LEFT JOIN (SELECT doc_id, count(*) AS pn FROM pages_s GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count_if(kind='section') AS s, count_if(kind='rule') AS r, count_if(kind='section' AND {strip('content')}='') AS es,
    count_if(kind='rule' AND {strip('content')}='') AS er FROM damaged GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count_if(item_kind='schedule') AS sc, count_if(item_kind='form') AS fo FROM items GROUP BY 1) USING (doc_id))"""


def counts(spark, sf):
    return V.provision_counts(S.documents(spark, sf), E.count_structures(S.pages(spark, sf)), S.damaged(spark, sf))


@query("provision_counts", "WITH " + S.SQL_DAMAGED + f", {SQL_ITEMS}, {SQL_COUNTS} SELECT *, empty_sections + empty_rules AS empty_provisions FROM counts")
def provision_counts(spark, sf):
    return counts(spark, sf)


@query("quality_grade", "WITH " + S.SQL_DAMAGED + f""", {SQL_ITEMS}, {SQL_COUNTS}
SELECT doc_id, CASE WHEN pages = 0 OR sections + rules = 0 THEN 'ERROR' WHEN (empty_sections+empty_rules)/(sections+rules) > 0.5 THEN 'WARNING'
  WHEN sections + rules < pages * 0.3 THEN 'WARNING' ELSE 'GOOD' END AS quality FROM counts""")
def quality_grade(spark, sf):
    return V.quality_grade(counts(spark, sf)).select("doc_id", "quality")


@query("ocr_notes", "WITH " + S.SQL_DAMAGED + f""",
e AS (SELECT doc_id, page_idx, count(*) AS n FROM damaged WHERE content = '' GROUP BY ALL), l AS (SELECT *, lower(raw_text) AS tl FROM pages_s)
SELECT doc_id, page_idx, 'no text on the page' AS note FROM l WHERE {strip('raw_text')} = ''
UNION ALL SELECT doc_id, page_idx, n || ' items without content' FROM e
UNION ALL SELECT doc_id, page_idx, 'form with numbered provisions' FROM l WHERE page_type = 'form' AND {PROV}
UNION ALL SELECT doc_id, page_idx, 'schedule without the word schedule' FROM l WHERE page_type = 'schedule' AND NOT contains(tl, 'schedule')""")
def ocr_notes(spark, sf):
    return V.ocr_notes(S.pages(spark, sf), S.damaged(spark, sf))
