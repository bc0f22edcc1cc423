"""Queries: repair and merge over the damaged statute sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.operators import extract as E
from corpusframe.operators import merge as M
from corpusframe.operators import repair as RP
from corpusframe.plans import statutes as S
from corpusframe.plans.q_extract import AMENDING, ACTION, CAP, SQL_FALLBACK, STRICT, TARGET
from corpusframe.plans.registry import query
from corpusframe.settings import durable

strip = S.sql_strip


def thinned(spark, sf):
    """Damaged sections without those of pages of a certain length: pages to be read again."""
    s, p = S.damaged(spark, sf), S.pages(spark, sf)
    lost = p.filter(F.pmod(F.length("raw_text"), F.lit(6)) == 3).select("doc_id", "page_idx")
    return s.join(lost, ["doc_id", "page_idx"], "left_anti")


SQL_THIN = S.SQL_DAMAGED + f""",
thin AS (SELECT * FROM damaged ANTI JOIN (SELECT doc_id, page_idx FROM pages_s WHERE length(raw_text) % 6 = 3) USING (doc_id, page_idx)),
bare AS (SELECT * FROM pages_s ANTI JOIN thin USING (doc_id, page_idx) WHERE raw_text <> ''),
{S.sql_spans(f"bare WHERE NOT contains(lower(document_name),'amendment') AND regexp_matches(raw_text, '{STRICT}')", STRICT, 'st', 'doc_id, page_idx', {'num': 1, 'ttl': 2})},
{S.sql_spans(f"bare WHERE NOT contains(lower(document_name),'amendment') AND NOT regexp_matches(raw_text, '{STRICT}')", S.HEAD, 'lo', 'doc_id, page_idx', {'num': 1, 'ttl': 2})},
{S.sql_spans("bare WHERE contains(lower(document_name),'amendment')", AMENDING, 'am', 'doc_id, page_idx', {'head': 0, 'num': 1})},
am2 AS (SELECT *, {strip('head || body')} AS t FROM am),
fixed AS (SELECT doc_id, page_idx, kind, sec_idx, section_number, section_title, content, is_continuation, false AS added FROM thin
  UNION ALL SELECT doc_id, page_idx, 'section', sec_idx, num, {S.sql_title('ttl', False)}, {strip('body')}, false, true FROM (SELECT * FROM st UNION ALL SELECT * FROM lo)
  UNION ALL SELECT doc_id, page_idx, 'section', sec_idx, num, {CAP(ACTION('t'))} || ' of section ' || {TARGET('t')}, t, false, true FROM am2)"""


@query("add_missing_sections", "WITH " + SQL_THIN + " SELECT * FROM fixed WHERE content <> '' OR section_title <> '' OR NOT added")
def add_missing_sections(spark, sf):
    return RP.add_missing_sections(S.pages(spark, sf), thinned(spark, sf)).drop("page_number", "page_type")


def _lit(x: str) -> str:
    return x.replace("'", "''")


GOT = lambda pattern, g: f"regexp_extract(line, '{_lit(pattern)}', {g})"
UPTO = lambda end: f"array_to_string(l[i + 1:coalesce({end}, len(l) + 1) - 1], chr(10))"
SQL_SPANS = f"""ln AS (SELECT doc_id, page_idx, contains(lower(document_name), 'amendment') AS amending, i, l[i] AS line, l[i + 1] AS after, l
  FROM (SELECT *, string_split(raw_text, chr(10)) AS l FROM pages_s), unnest(range(1, len(l) + 1)) t(i)),
lx AS (SELECT *, min(i) FILTER (regexp_matches(line, '{_lit(RP.NEXT_HEADED)}')) OVER w AS headed, min(i) FILTER (regexp_matches(line, '{_lit(RP.NEXT_NUMBERED)}')) OVER w AS numbered,
  min(i) FILTER (regexp_matches(line, '{_lit(RP.NEXT_CHANGED)}')) OVER w AS changed, {GOT(RP.DOTTED, 1)} AS dotted, ltrim({GOT(RP.DOTTED, 2)}) AS rest FROM ln
  WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
sp AS (SELECT doc_id, page_idx, lower(dotted) AS number, 'title' AS what, 0 AS form, i AS pos, left(t, 200) AS text
    FROM (SELECT *, CASE WHEN {strip('rest')} = '' THEN ltrim(coalesce(after, '')) ELSE rest END AS t FROM lx WHERE dotted <> '') WHERE length(t) >= 5
  UNION ALL SELECT doc_id, page_idx, lower({GOT(RP.SPACED, 1)}), 'title', 1, i, {GOT(RP.SPACED, 2)} FROM lx WHERE {GOT(RP.SPACED, 1)} <> ''
  UNION ALL SELECT doc_id, page_idx, lower({GOT(RP.NAMED, 1)}), 'title', 2, i, {GOT(RP.NAMED, 2)} FROM lx WHERE {GOT(RP.NAMED, 1)} <> ''
  UNION ALL SELECT doc_id, page_idx, lower(dotted), 'content', 0, i, {strip(UPTO('headed'))} FROM lx WHERE NOT amending AND dotted <> ''
  UNION ALL SELECT doc_id, page_idx, lower(dotted), 'content', 1, i, {strip(f"rest || chr(10) || {UPTO('numbered')}")} FROM lx WHERE NOT amending AND dotted <> ''
  UNION ALL SELECT doc_id, page_idx, lower({GOT(RP.CHANGED, 1)}), 'content', 0, i, {strip(f"line || chr(10) || {UPTO('changed')}")} FROM lx WHERE amending AND {GOT(RP.CHANGED, 1)} <> ''
  UNION ALL SELECT doc_id, page_idx, lower({GOT(RP.CHANGING, 1)}), 'content', 2, i, {strip(f"line || chr(10) || {UPTO('numbered')}")} FROM lx WHERE amending AND {GOT(RP.CHANGING, 1)} <> ''
  UNION ALL SELECT doc_id, page_idx, lower(regexp_extract(t, '{_lit(RP.PRINCIPAL)}', 1)), 'content', 1, k, {strip('t')}
    FROM (SELECT doc_id, page_idx, k, h[k] || b[k + 1] AS t FROM (SELECT *, regexp_extract_all(raw_text, '{_lit(RP.FOR_SECTION)}') AS h, string_split_regex(raw_text, '{_lit(RP.FOR_SECTION)}') AS b
      FROM pages_s WHERE contains(lower(document_name), 'amendment')), unnest(range(1, len(h) + 1)) u(k)) WHERE regexp_matches(t, '{_lit(RP.PRINCIPAL)}')),
titles AS (SELECT doc_id, page_idx, number, arg_min({S.sql_title('text', False)}, form * 1000000 + pos) AS title FROM sp WHERE what = 'title' GROUP BY ALL),
contents AS (SELECT doc_id, page_idx, number, arg_min(text, form * 1000000 + pos) AS body FROM sp WHERE what = 'content' AND length(text) > {RP.MIN_CONTENT} GROUP BY ALL)"""


@query("recover_title", "WITH " + S.SQL_DAMAGED + ", " + SQL_SPANS + f"""
SELECT d.doc_id, d.page_idx, kind, sec_idx, CASE WHEN {strip('section_title')} = '' THEN coalesce(title, section_title) ELSE section_title END AS section_title
FROM damaged d LEFT JOIN titles t ON t.doc_id = d.doc_id AND t.page_idx = d.page_idx AND t.number = lower(section_number)""")
def recover_title(spark, sf):
    return RP.recover_title(S.pages(spark, sf), S.damaged(spark, sf)).select("doc_id", "page_idx", "kind", "sec_idx", "section_title")


@query("recover_content", "WITH " + S.SQL_DAMAGED + ", " + SQL_SPANS + f"""
SELECT d.doc_id, d.page_idx, kind, sec_idx, CASE WHEN {strip('content')} = '' THEN coalesce(body, content) ELSE content END AS content
FROM damaged d LEFT JOIN contents c ON c.doc_id = d.doc_id AND c.page_idx = d.page_idx AND c.number = lower(section_number)""")
def recover_content(spark, sf):
    return RP.recover_content(S.pages(spark, sf), S.damaged(spark, sf)).select("doc_id", "page_idx", "kind", "sec_idx", "content")


SQL_MARKED = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, section_number, page_idx ORDER BY sec_idx) AS rn FROM damaged) WHERE rn = 1),
leaving AS (
  SELECT doc_id, kind, section_number, page_idx, content AS text FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM firsts g WHERE g.doc_id=f.doc_id AND g.kind=f.kind AND g.section_number=f.section_number AND g.page_idx=f.page_idx-1)
  UNION ALL
  SELECT f.doc_id, f.kind, f.section_number, f.page_idx, CASE WHEN NOT f.is_continuation AND f.content = '' AND l.text <> '' THEN l.text ELSE f.content END
  FROM leaving l JOIN firsts f ON f.doc_id=l.doc_id AND f.kind=l.kind AND f.section_number=l.section_number AND f.page_idx=l.page_idx+1),
marked_s AS (
  SELECT d.doc_id, d.page_idx, d.page_number, d.page_type, d.document_type, d.document_name, d.kind, d.sec_idx, d.section_number, d.section_title,
    CASE WHEN NOT is_continuation AND content = '' AND coalesce(l.text,'') <> '' THEN l.text ELSE content END AS content,
    is_continuation OR (content = '' AND coalesce(l.text,'') <> '') AS is_continuation
  FROM damaged d LEFT JOIN leaving l ON l.doc_id=d.doc_id AND l.kind=d.kind AND l.section_number=d.section_number AND l.page_idx=d.page_idx-1)"""


@query("mark_continuations", "WITH RECURSIVE " + S.SQL_DAMAGED + ", " + SQL_MARKED + """
SELECT doc_id, page_idx, kind, sec_idx, content, is_continuation FROM marked_s""")
def mark_continuations(spark, sf):
    return RP.mark_continuations(S.damaged(spark, sf)).select("doc_id", "page_idx", "kind", "sec_idx", "content", "is_continuation")


SQL_REPAIRED = SQL_THIN + ", " + SQL_SPANS + f""",
whole AS (SELECT * FROM fixed WHERE content <> '' OR section_title <> '' OR NOT added),
rp AS (SELECT w.* REPLACE (CASE WHEN NOT added AND {strip('section_title')} = '' THEN coalesce(title, section_title) ELSE section_title END AS section_title,
    CASE WHEN NOT added AND {strip('content')} = '' THEN coalesce(body, content) ELSE content END AS content)
  FROM whole w LEFT JOIN titles t ON t.doc_id = w.doc_id AND t.page_idx = w.page_idx AND t.number = lower(section_number)
    LEFT JOIN contents c ON c.doc_id = w.doc_id AND c.page_idx = w.page_idx AND c.number = lower(section_number)),
rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, section_number, page_idx ORDER BY sec_idx) AS rn FROM rp) WHERE rn = 1),
rl AS (SELECT doc_id, kind, section_number, page_idx, content AS text FROM rf f
    WHERE NOT EXISTS (SELECT 1 FROM rf g WHERE g.doc_id=f.doc_id AND g.kind=f.kind AND g.section_number=f.section_number AND g.page_idx=f.page_idx-1)
  UNION ALL SELECT f.doc_id, f.kind, f.section_number, f.page_idx, CASE WHEN NOT f.is_continuation AND f.content = '' AND l.text <> '' THEN l.text ELSE f.content END
  FROM rl l JOIN rf f ON f.doc_id=l.doc_id AND f.kind=l.kind AND f.section_number=l.section_number AND f.page_idx=l.page_idx+1),
af AS (SELECT d.doc_id, d.page_idx, d.kind, d.sec_idx, d.added, d.section_title, d.content, d.is_continuation, d.content = '' AND NOT d.is_continuation AND coalesce(l.text, '') <> '' AS marked
  FROM rp d LEFT JOIN rl l ON l.doc_id=d.doc_id AND l.kind=d.kind AND l.section_number=d.section_number AND l.page_idx=d.page_idx-1),
lg AS (SELECT doc_id, page_idx, kind, sec_idx, 'add_sections' AS action_type, 'sections' AS field, '' AS before, left(section_title, 200) AS after FROM af WHERE added
  UNION ALL SELECT a.doc_id, a.page_idx, a.kind, a.sec_idx, 'recover_title', 'section_title', left(t.section_title, 200), left(a.section_title, 200)
    FROM af a JOIN thin t USING (doc_id, page_idx, kind, sec_idx) WHERE NOT added AND a.section_title <> t.section_title
  UNION ALL SELECT a.doc_id, a.page_idx, a.kind, a.sec_idx, 'recover_content', 'content', left(t.content, 200), left(a.content, 200)
    FROM af a JOIN thin t USING (doc_id, page_idx, kind, sec_idx) WHERE NOT added AND NOT marked AND a.content <> t.content
  UNION ALL SELECT doc_id, page_idx, kind, sec_idx, 'mark_continuation', 'is_continuation', 'false', 'true' FROM af WHERE NOT added AND marked)"""


def logged(spark, sf):
    """The whole repair of sections of which some are missing, blank or cut at pages, and what it did."""
    before = durable(thinned(spark, sf))  # the repair reads it twice, its log once
    return RP.repair_log(before, RP.repair(S.pages(spark, sf), before))


@query("repair_log", "WITH RECURSIVE " + SQL_REPAIRED + " SELECT * FROM lg")
def repair_log(spark, sf):
    return logged(spark, sf)


@query("repair_counters", "WITH RECURSIVE " + SQL_REPAIRED + """
SELECT doc_id, count(DISTINCT page_idx) FILTER (action_type = 'add_sections') AS sections_recovered, count(*) FILTER (action_type = 'recover_title') AS titles_recovered,
  count(*) FILTER (action_type = 'recover_content') AS content_recovered, count(*) FILTER (action_type = 'mark_continuation') AS continuations_marked FROM lg GROUP BY 1""")
def repair_counters(spark, sf):
    return RP.repair_counters(logged(spark, sf))


# ------------------------------------------------------------------------------------ merge

@query("simple_merge", "WITH " + S.SQL_DAMAGED + """,
w AS (SELECT *, row_number() OVER g AS rn, count(*) OVER (PARTITION BY doc_id, kind, section_number) AS n FROM damaged WINDOW g AS (PARTITION BY doc_id, kind, section_number ORDER BY page_idx, sec_idx)),
a AS (SELECT doc_id, kind, section_number, string_agg(content, ' ' ORDER BY page_idx, sec_idx) AS m FROM damaged GROUP BY ALL)
SELECT doc_id, page_idx, kind, sec_idx, CASE WHEN rn = 1 THEN m ELSE '' END AS content, CASE WHEN rn > 1 THEN true WHEN n > 1 THEN false ELSE is_continuation END AS is_continuation
FROM w JOIN a USING (doc_id, kind, section_number)""")
def simple_merge(spark, sf):
    return M.simple_merge(S.damaged(spark, sf)).select("doc_id", "page_idx", "kind", "sec_idx", "content", "is_continuation")


NKEY = f"regexp_replace(regexp_replace({strip('section_number')}, '[.]+$', ''), '\\s+$', '')"


@query("number_key", "WITH " + S.SQL_SECTIONS + f""", x AS (SELECT doc_id, page_idx, kind, sec_idx, ' ' || section_number || repeat('.', (sec_idx % 3)::INT) || ' ' AS section_number FROM sections_s)
SELECT doc_id, page_idx, kind, sec_idx, {NKEY} AS number_key FROM x""")
def number_key(spark, sf):
    odd = F.concat(F.lit(" "), "section_number", F.repeat(F.lit("."), F.pmod("sec_idx", F.lit(3))), F.lit(" "))
    return S.sections(spark, sf).select("doc_id", "page_idx", "kind", "sec_idx", M.number_key(odd).alias("number_key"))


WORDS = lambda c: f"list_filter(list_distinct(string_split_regex({strip(c)}, '\\s+')), lambda w: w <> '')"
OVER = lambda a, b: f"len(list_intersect({WORDS(a)}, {WORDS(b)}))::DOUBLE / nullif(least(len({WORDS(a)}), len({WORDS(b)})), 0)"
SQL_CLASS = f"""cls0 AS (SELECT *, {NKEY} AS number_key, page_type = 'table_of_contents' OR (page_type = 'preamble' AND page_number <= 3)
    OR (length({strip('content')}) < 50 AND {strip('section_title')} <> '')
    OR (regexp_matches(section_title, '^\\d+\\.\\s*[A-Z][a-z]+') AND {strip('content')} = '') AS is_toc FROM damaged),
cls AS (SELECT *, count(*) OVER g AS n, count_if(NOT is_toc) OVER g AS n_real FROM cls0 WINDOW g AS (PARTITION BY doc_id, kind, number_key)),
flg0 AS (SELECT *, lag(content) OVER g AS pc, lag(page_number) OVER g AS pp FROM cls WHERE n > 1 AND n_real > 1 AND NOT is_toc
  WINDOW g AS (PARTITION BY doc_id, kind, number_key ORDER BY page_number, page_idx, sec_idx)),
flg AS (SELECT *, CASE WHEN pp IS NULL THEN false WHEN is_continuation THEN true WHEN page_number - pp > 2 THEN false
  WHEN {strip('pc')} = '' AND {strip('content')} = '' THEN false
  WHEN {strip('pc')} <> '' AND {strip('content')} <> '' AND coalesce({OVER('pc', 'content')} > 0.7, false) THEN false
  WHEN {strip('pc')} <> '' AND {strip('content')} <> '' AND coalesce({OVER("lower(right(" + strip('pc') + ", 100))", "lower(left(" + strip('content') + ", 100))")} > 0.15, false) THEN true
  ELSE page_number - pp = 1 END AS merges FROM flg0)"""


@query("is_toc_entry", "WITH " + S.SQL_DAMAGED + ", " + SQL_CLASS + " SELECT doc_id, page_idx, kind, sec_idx, is_toc FROM cls")
def is_toc_entry(spark, sf):
    return M.is_toc_entry(S.damaged(spark, sf)).select("doc_id", "page_idx", "kind", "sec_idx", "is_toc")


@query("merge_flag", "WITH " + S.SQL_DAMAGED + ", " + SQL_CLASS + " SELECT doc_id, page_idx, kind, sec_idx, merges FROM flg")
def merge_flag(spark, sf):
    return M.merge_flag(S.damaged(spark, sf)).select("doc_id", "page_idx", "kind", "sec_idx", "merges")


@query("word_overlap", f"""WITH p AS (SELECT c.conv_id, c.turn, c.text AS a, d.text AS b FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1)
SELECT conv_id, turn, round({OVER('a', 'b')}, 6) AS overlap, coalesce({OVER('a', 'b')} > 0.7, false) AS duplicate,
  coalesce({OVER('lower(right(a, 100))', 'lower(left(b, 100))')} > 0.15, false) AS continues FROM p""")
def word_overlap(spark, sf):
    from corpusframe.functions import text as X
    from corpusframe.plans.registry import table
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    j = c.select("conv_id", "turn", F.col("text").alias("a")).join(nxt, ["conv_id", "turn"])
    return j.select("conv_id", "turn", F.round(M.word_overlap(X.words(F.col("a")), X.words(F.col("b"))), 6).alias("overlap"),
                    M.is_duplicate(F.col("a"), F.col("b")).alias("duplicate"), M.content_continues(F.col("a"), F.col("b")).alias("continues"))


SQL_MERGED = SQL_CLASS + f""",
isl AS (SELECT *, sum(CASE WHEN merges THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind, number_key ORDER BY page_number, page_idx, sec_idx ROWS UNBOUNDED PRECEDING) AS island FROM flg),
grp AS (SELECT doc_id, kind, number_key, island, list(content ORDER BY page_number, page_idx, sec_idx) AS cs,
    list(section_title ORDER BY page_number, page_idx, sec_idx) AS ts, list(page_number ORDER BY page_number, page_idx, sec_idx) AS ps,
    list(page_idx ORDER BY page_number, page_idx, sec_idx) AS pis, list(sec_idx ORDER BY page_number, page_idx, sec_idx) AS sis,
    list(section_number ORDER BY page_number, page_idx, sec_idx) AS ns, list(is_continuation ORDER BY page_number, page_idx, sec_idx) AS ics FROM isl GROUP BY ALL),
merged AS (
  SELECT doc_id, kind, page_idx, page_number, sec_idx, section_number, section_title, content, is_continuation, [page_number] AS source_pages, 1::BIGINT AS n_parts, 'kept_separate' AS merge_status
  FROM cls WHERE number_key = '' OR n = 1 OR n_real = 0 OR (n_real = 1 AND NOT is_toc)
  UNION ALL
  SELECT doc_id, kind, pis[1], ps[1], sis[1], ns[1], coalesce(list_filter(ts, lambda t: t <> '')[1], ts[1]),
    CASE WHEN len(cs) = 1 THEN cs[1] ELSE {strip('''list_reduce(cs, lambda a, x: CASE WHEN x = '' THEN a WHEN a = '' THEN x
      WHEN coalesce(''' + OVER('a', 'x') + ''' > 0.7, false) THEN a ELSE a || CASE WHEN a[-1:] = chr(10) THEN '' ELSE chr(10) END || x END)''')} END,
    ics[1], ps, len(cs), CASE WHEN len(cs) > 1 THEN 'merged' ELSE 'kept_separate' END FROM grp)"""


@query("merge_sections", "WITH " + S.SQL_DAMAGED + ", " + SQL_MERGED + """
SELECT doc_id, kind, page_idx, sec_idx, section_number, section_title, content, array_to_string(source_pages, '|') AS source_pages, n_parts, merge_status FROM merged""")
def merge_sections(spark, sf):
    return M.merge_sections(S.damaged(spark, sf)).select(
        "doc_id", "kind", "page_idx", "sec_idx", "section_number", "section_title", "content", "source_pages", "n_parts", "merge_status")


@query("merge_actions", "WITH " + S.SQL_DAMAGED + ", " + SQL_MERGED + f"""
SELECT doc_id, kind, number_key AS section_number, page_number || '' AS source_pages, 'kept_separate' AS action,
  CASE WHEN n = 1 THEN 'the number stands once' WHEN n_real = 0 THEN 'contents line without a section' ELSE 'contents line of a section found elsewhere' END AS reason
FROM cls WHERE number_key <> '' AND (n = 1 OR (is_toc AND n_real <= 1))
UNION ALL SELECT doc_id, kind, {NKEY}, array_to_string(source_pages, '|'), 'merged', 'joined ' || n_parts || ' parts from pages [' || array_to_string(source_pages, ', ') || ']'
FROM merged WHERE merge_status = 'merged'""")
def merge_actions(spark, sf):
    d = S.damaged(spark, sf)
    return M.merge_actions(d, M.merge_sections(d))


@query("merge_counters", "WITH " + S.SQL_DAMAGED + ", " + SQL_MERGED + """
SELECT doc_id, b AS sections_before, a AS sections_after, m::BIGINT AS sections_merged FROM (SELECT doc_id, count(*) AS b FROM damaged GROUP BY 1)
JOIN (SELECT doc_id, count(*) AS a, count_if(merge_status = 'merged') AS m FROM merged GROUP BY 1) USING (doc_id)""")
def merge_counters(spark, sf):
    d = S.damaged(spark, sf)
    return M.merge_counters(d, M.merge_sections(d))
