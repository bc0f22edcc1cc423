"""Queries: normalisation, canonical model and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.operators import canonical as C
from corpusframe.operators import chunk as CH
from corpusframe.operators import extract as E
from corpusframe.operators import merge as M
from corpusframe.operators import normalise as N
from corpusframe.operators import repair as RP
from corpusframe.plans import statutes as S
from corpusframe.plans.q_extract import AMENDMENT_OF, ACTION, CAP
from corpusframe.plans.q_repair import SQL_MARKED, SQL_MERGED
from corpusframe.plans.q_text import SQL_SLUG
from corpusframe.plans.q_validate import SQL_STRUCT
from corpusframe.plans.registry import query, table
from corpusframe.settings import durable

strip = S.sql_strip
KEY = ["doc_id", "page_idx", "kind", "sec_idx"]
K = "doc_id, page_idx, kind, sec_idx"

SQL_HIER = f"""ln0 AS (SELECT {K}, unnest(string_split(content, chr(10))) AS l0, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM sections_s),
ln1 AS (SELECT {K}, pos, {strip('l0')} AS l FROM ln0 WHERE {strip('l0')} <> ''),
ln2 AS (SELECT *, regexp_matches(l, '^\\(\\d+\\)') AS is_sub, count_if(regexp_matches(l, '^\\(\\d+\\)')) OVER (PARTITION BY {K} ORDER BY pos) AS sub FROM ln1),
ln3 AS (SELECT *, NOT is_sub AND sub > 0 AND regexp_matches(l, '^\\([a-z]\\)') AS is_cl FROM ln2),
ln4 AS (SELECT *, count_if(is_cl) OVER (PARTITION BY {K}, sub ORDER BY pos) AS cl FROM ln3),
ln5 AS (SELECT *, NOT is_sub AND NOT is_cl AND cl > 0 AND regexp_matches(l, '(?i)^\\((i{{1,3}}|iv|v|vi{{0,3}})\\)') AS is_sc FROM ln4),
ln6 AS (SELECT *, CASE WHEN is_sub THEN 'subsection' WHEN is_cl THEN 'clause' WHEN is_sc THEN 'sub_clause'
   WHEN regexp_matches(l, '(?i)(Provided that|Provided further that)') THEN 'proviso' WHEN regexp_matches(l, '(?i)(Explanation[.—:])') THEN 'explanation'
   WHEN sub > 0 THEN 'text' END AS what FROM ln5),
hier AS (
  SELECT {K}, 'subsection' AS level, sub, 0 AS clause, 0 AS item, min(CASE WHEN is_sub THEN regexp_extract(l, '^(\\(\\d+\\))', 1) END) AS number,
    string_agg(l, ' ' ORDER BY pos) AS text FROM ln6 WHERE cl = 0 AND what IN ('subsection','text') GROUP BY ALL
  UNION ALL SELECT {K}, 'clause', sub, cl, 0, min(CASE WHEN is_cl THEN regexp_extract(l, '^(\\([a-z]\\))', 1) END), string_agg(l, ' ' ORDER BY pos)
    FROM ln6 WHERE cl > 0 AND what IN ('clause','text') GROUP BY {K}, sub, cl
  UNION ALL SELECT {K}, 'sub_clause', sub, cl, row_number() OVER (PARTITION BY {K}, sub, cl ORDER BY pos), regexp_extract(l, '^(\\([A-Za-z]+\\))', 1), l FROM ln6 WHERE what = 'sub_clause'
  UNION ALL SELECT {K}, 'proviso', 0, 0, row_number() OVER (PARTITION BY {K} ORDER BY pos),
    replace(lower(regexp_extract(l, '(?i)(Provided that|Provided further that)', 1)), ' ', '_'), l FROM ln6 WHERE what = 'proviso'
  UNION ALL SELECT {K}, 'explanation', 0, 0, row_number() OVER (PARTITION BY {K} ORDER BY pos), '', l FROM ln6 WHERE what = 'explanation')"""


@query("parse_hierarchy", "WITH " + S.SQL_SECTIONS + ", " + SQL_HIER + f" SELECT {K}, level, sub::BIGINT AS sub, clause::BIGINT AS clause, item::BIGINT AS item, number, text FROM hier")
def parse_hierarchy(spark, sf):
    return N.hierarchy_rows(N.parse_hierarchy(S.sections(spark, sf)), KEY)


XR = R.CROSS_REFERENCE.replace("(?Ud)", "")
REFTYPE = """CASE WHEN contains(lower(r),'section') AND NOT contains(lower(r),'sub') THEN 'section' WHEN contains(lower(r),'sub-section') OR contains(lower(r),'subsection') THEN 'subsection'
  WHEN contains(lower(r),'clause') AND NOT contains(lower(r),'sub') THEN 'clause' WHEN contains(lower(r),'sub-clause') OR contains(lower(r),'subclause') THEN 'sub_clause'
  WHEN contains(lower(r),'schedule') THEN 'schedule' WHEN contains(lower(r),'form') THEN 'form' WHEN contains(lower(r),'rule') THEN 'rule' WHEN contains(lower(r),'article') THEN 'article' ELSE 'other' END"""


@query("cross_references", "WITH " + S.SQL_PAGES + f""", r0 AS (SELECT doc_id, page_idx, unnest(regexp_extract_all(raw_text, '{XR}')) AS r,
  generate_subscripts(regexp_extract_all(raw_text, '{XR}'), 1) - 1 AS ref_idx FROM pages_s)
SELECT doc_id, page_idx, ref_idx, r AS reference_text, {REFTYPE} AS reference_type,
  regexp_replace(regexp_extract(regexp_extract(r, '\\s(\\S+)$', 1), '(?i)[\\d()ivx]+'), '^[()]+|[()]+$', '', 'g') AS target,
  regexp_replace(regexp_extract(r, '(?i)[\\d()ivx]+'), '^[()]+|[()]+$', '', 'g') AS compat_target FROM r0""")
def cross_references(spark, sf):
    p = S.pages(spark, sf)
    rows = p.select("doc_id", "page_idx", F.posexplode(N.cross_references(F.col("raw_text"))).alias("ref_idx", "x"))
    return rows.select("doc_id", "page_idx", "ref_idx", "x.*", N.reference_target(F.col("x.reference_text"), True).alias("compat_target"))


ALL_TERMS = list(dict.fromkeys(t for ts in R.DOMAIN_TERMS.values() for t in ts))
SQL_LIST = lambda ts: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in ts) + "]"
SQL_KW = f"list_filter({SQL_LIST(ALL_TERMS)}, lambda k: contains(lower(content), k))[1:20]"
PICKS = lambda ps: "list_sort(list_distinct(" + " || ".join(f"regexp_extract_all(content, '{p}')" for p in ps) + "))"


@query("keywords", "WITH " + S.SQL_SECTIONS + f" SELECT {K}, array_to_string({SQL_KW}, '|') AS keywords FROM sections_s")
def keywords(spark, sf):
    s = S.sections(spark, sf).withColumn("low", F.lower("content"))
    return s.select(*KEY, N.keywords(F.col("low")).alias("keywords"))


@query("entities_authorities_dates", "WITH " + S.SQL_SECTIONS + f""" SELECT {K}, array_to_string({PICKS(R.ENTITIES)}, '|') AS legal_entities,
  array_to_string({PICKS(R.AUTHORITIES)}, '|') AS authorities, array_to_string({PICKS(R.DATES)}, '|') AS dates FROM sections_s""")
def entities_authorities_dates(spark, sf):
    c = F.col("content")
    return S.sections(spark, sf).select(*KEY, N.all_matches(c, R.ENTITIES).alias("legal_entities"), N.all_matches(c, R.AUTHORITIES).alias("authorities"),
                                        N.all_matches(c, R.DATES).alias("dates"))


@query("normalise_report", "WITH " + S.SQL_SECTIONS + ", " + SQL_HIER + f""",
h AS (SELECT DISTINCT {K} FROM hier)
SELECT doc_id, count(*) AS sections_processed, count_if(h.doc_id IS NOT NULL)::BIGINT AS with_hierarchy, count_if(h.doc_id IS NULL)::BIGINT AS preserved,
  sum(len(regexp_extract_all(content, '{XR}')))::BIGINT AS cross_references, sum(len({SQL_KW}))::BIGINT AS keywords
FROM sections_s s LEFT JOIN h USING ({K}) GROUP BY doc_id""")
def normalise_report(spark, sf):
    return N.normalise_report(N.normalise(S.sections(spark, sf)))


@query("fix_section_number", """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Section ' || doc_id ELSE doc_id || '.' END AS section_number,
  CASE doc_id % 2 WHEN 0 THEN 'Section 12A. ' ELSE '' END || text AS content FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_extract(content, '^[Ss]ection\\s+(\\d+[\\w.\\-]*)\\b', 1) WHEN 1 THEN doc_id || '' ELSE section_number END AS section_number FROM x""")
def fix_section_number(spark, sf):
    d = table(spark, sf, "documents")
    i, k = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(3))
    d = d.select("doc_id", F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("Section "), i)).otherwise(F.concat(i, F.lit("."))).alias("section_number"),
                 F.concat(F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("Section 12A. ")).otherwise(F.lit("")), "text").alias("content"))
    return N.fix_section_number(d).drop("content")


@query("document_stats", "WITH " + S.SQL_SECTIONS + """ SELECT doc_id, sum(length(content))::BIGINT AS total_characters, 'RAG-ready' AS processing_stage,
  true AS sections_merged, true AS normalized FROM sections_s GROUP BY 1""")
def document_stats(spark, sf):
    return N.document_stats(S.sections(spark, sf))


# ------------------------------------------------------------------------------------ canonical

def bare_documents(spark, sf):
    """Documents whose type and year have to be inferred."""
    d = S.documents(spark, sf)
    return d.withColumns({"document_type": F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("document_type")).otherwise(F.lit("")),
                          "year": F.when(F.pmod("doc_id", F.lit(4)) == 0, F.col("year")),
                          "document_name": F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("Untitled")).otherwise(F.col("document_name")),
                          "domain": F.lit(None).cast("string"), "language": F.col("lang")})


def telling_pages(spark, sf):
    """Pages on some of which the type is spelled out."""
    p = S.pages(spark, sf)
    n = F.pmod(F.length("raw_text"), F.lit(7))
    return p.withColumn("raw_text", F.concat("raw_text", F.when(n == 0, F.lit(" An Act to amend")).when(n == 1, F.lit(" the Amendment Act"))
                                             .when(n == 2, F.lit(" rules made under biological")).when(n == 3, F.lit(" access")).otherwise(F.lit(""))))


SQL_TELL = S.SQL_PAGES + """,
bare AS (SELECT doc_id, source, lang AS language, CASE WHEN doc_id % 3 = 0 THEN document_type ELSE '' END AS document_type, CASE WHEN doc_id % 4 = 0 THEN year END AS year,
  CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE document_name END AS document_name FROM docs),
tell AS (SELECT doc_id, page_idx, raw_text || CASE length(raw_text) % 7 WHEN 0 THEN ' An Act to amend' WHEN 1 THEN ' the Amendment Act' WHEN 2 THEN ' rules made under biological'
  WHEN 3 THEN ' access' ELSE '' END AS raw_text FROM pages_s),
tl AS (SELECT doc_id, page_idx, raw_text, lower(raw_text) AS l FROM tell),
pt AS (SELECT doc_id, min_by(CASE WHEN contains(l,'amendment act') THEN 'Amendment Act' WHEN contains(l,'act no') OR contains(l,'an act to') THEN 'Act' ELSE 'Rule' END, page_idx) AS t
  FROM tl WHERE contains(l,'amendment act') OR contains(l,'act no') OR contains(l,'an act to') OR (contains(l,'rules') AND contains(l,'made under')) GROUP BY 1),
py AS (SELECT doc_id, min_by(regexp_extract(raw_text, '\\b(?:19|20)\\d{2}\\b'), page_idx) AS y FROM tell WHERE page_idx < 3 AND regexp_matches(raw_text, '\\b(?:19|20)\\d{2}\\b') GROUP BY 1),
typ AS (SELECT doc_id, document_name, source, language, coalesce(nullif(document_type, ''), CASE WHEN contains(lower(document_name),'amendment act') THEN 'Amendment Act'
    WHEN contains(lower(document_name),'notification') THEN 'Notification' WHEN contains(lower(document_name),'regulation') THEN 'Regulation' WHEN contains(lower(document_name),'amendment') THEN 'Amendment Act'
    WHEN contains(lower(document_name),'schedule') THEN 'Schedule' WHEN contains(lower(document_name),'order') THEN 'Order' WHEN contains(lower(document_name),'rule') THEN 'Rule'
    WHEN contains(lower(document_name),'form') THEN 'Form' WHEN contains(lower(document_name),'act') THEN 'Act' END, t, 'Other') AS document_type,
    CAST(coalesce(year::VARCHAR, nullif(regexp_extract(document_name, '\\b(?:19|20)\\d{2}\\b'), ''), y) AS BIGINT) AS year
  FROM bare LEFT JOIN pt USING (doc_id) LEFT JOIN py USING (doc_id))"""


@query("infer_doc_type", "WITH " + SQL_TELL + " SELECT doc_id, document_type FROM typ")
def infer_doc_type(spark, sf):
    return C.infer_doc_type(bare_documents(spark, sf), telling_pages(spark, sf)).select("doc_id", "document_type")


@query("infer_year", "WITH " + SQL_TELL + " SELECT doc_id, coalesce(year::VARCHAR, '') AS year FROM typ")
def infer_year(spark, sf):
    return C.infer_year(bare_documents(spark, sf), telling_pages(spark, sf)).select("doc_id", F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"))


_DOM = ", ".join(f"{{'neg': -len(list_filter({SQL_LIST(ts)}, lambda k: contains(t, k))), 'ord': {i}, 'domain': '{d}'}}" for i, (d, ts) in enumerate(R.DOMAIN_TERMS.items()))
SQL_DOMAINS = f"""dt AS (SELECT doc_id, lower(string_agg(raw_text, ' ' ORDER BY page_idx)) AS t FROM tell GROUP BY 1),
dr AS (SELECT doc_id, list_sort(list_filter([{_DOM}], lambda s: s.neg < 0)) AS r FROM dt),
doms AS (SELECT doc_id, r[1].domain AS primary_domain, array_to_string(list_transform(r[2:4], lambda s: s.domain), '|') AS secondary_domains FROM dr)"""


@query("classify_domains", "WITH " + SQL_TELL + ", " + SQL_DOMAINS + " SELECT * FROM doms")
def classify_domains(spark, sf):
    return C.classify_domains(telling_pages(spark, sf))


@query("chapter", "WITH " + S.SQL_RAW + f""", x AS (SELECT doc_id, page_idx, CASE page_idx % 2 WHEN 0 THEN 'CHAPTER IV - ' ELSE '' END || raw_text AS t FROM raw_pages)
SELECT doc_id, page_idx, nullif(regexp_extract(t, '(?i)CHAPTER\\s+([IVX]+)\\s*[.\\-]?\\s*([^\\n]+)', 1), '') AS chapter_number,
  nullif({strip("regexp_extract(t, '(?i)CHAPTER\\s+([IVX]+)\\s*[.\\-]?\\s*([^\\n]+)', 2)")}, '') AS chapter_title FROM x""")
def chapter(spark, sf):
    p = S.raw_pages(spark, sf)
    pre = F.when(F.pmod("page_idx", F.lit(2)) == 0, F.lit("CHAPTER IV - ")).otherwise(F.lit(""))
    return C.chapter(p.withColumn("raw_text", F.concat(pre, "raw_text"))).select("doc_id", "page_idx", "chapter_number", "chapter_title")


@query("page_rollup", "WITH " + S.SQL_SECTIONS + f""", n AS (SELECT doc_id, page_idx, {PICKS(R.ENTITIES)} AS e, {PICKS(R.AUTHORITIES)} AS a, {PICKS(R.DATES)} AS d, {SQL_KW} AS k,
  len(regexp_extract_all(content, '{XR}')) AS x FROM sections_s), j AS (SELECT doc_id, page_idx, flatten(list(e)) AS e, flatten(list(a)) AS a, flatten(list(d)) AS d, flatten(list(k)) AS k, sum(x)::BIGINT AS n_refs FROM n GROUP BY 1, 2)
SELECT doc_id, page_idx, array_to_string(list_sort(list_distinct(d)), '|') AS dates, array_to_string(list_sort(list_distinct(a)), '|') AS authorities,
  array_to_string(list_sort(list_distinct(e)), '|') AS legal_entities, array_to_string(list_sort(list_distinct(k))[1:30], '|') AS keywords, n_refs FROM j""")
def page_rollup(spark, sf):
    r = C.page_rollup(N.normalise(S.sections(spark, sf)))
    return r.withColumn("n_refs", F.size("cross_references")).drop("cross_references")


@query("canonical_documents", "WITH " + SQL_TELL + ", " + SQL_DOMAINS + """
SELECT doc_id, document_name, document_type, coalesce(year::VARCHAR, '') AS year, 'India' AS jurisdiction, source, primary_domain, coalesce(secondary_domains, '') AS secondary_domains, language FROM typ LEFT JOIN doms USING (doc_id)""")
def canonical_documents(spark, sf):
    d = C.canonical_documents(bare_documents(spark, sf), telling_pages(spark, sf))
    d = d.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("")))
    return d.select("doc_id", "document_name", "document_type", "year", "jurisdiction", "source", "primary_domain", "secondary_domains", "language")


@query("canonicalise", "WITH " + S.SQL_DAMAGED + f"""
SELECT {K}, section_number, nullif(section_title, '') AS section_title, nullif(content, '') AS content, page_number || '' AS source_pages, false AS is_amendment FROM damaged""")
def canonicalise(spark, sf):
    return C.canonicalise(S.damaged(spark, sf)).select(*KEY, "section_number", "section_title", "content", "source_pages", "is_amendment")


@query("canonical_report", "WITH " + SQL_STRUCT + """
SELECT doc_id, count(*) AS pages_processed, sum(ns+nr)::BIGINT AS sections_processed, sum(na)::BIGINT AS amendments_processed, sum(nd)::BIGINT AS definitions_processed,
  sum(nc)::BIGINT AS schedules_processed, sum(nf)::BIGINT AS forms_processed FROM pcounts GROUP BY 1""")
def canonical_report(spark, sf):
    return C.canonical_report(E.count_structures(S.pages(spark, sf)))


# ------------------------------------------------------------------------------------ chunks

@query("full_text", "WITH " + S.SQL_SECTIONS + ", " + SQL_HIER + f""",
ord AS (SELECT *, CASE level WHEN 'proviso' THEN 1 WHEN 'explanation' THEN 2 ELSE 0 END AS o FROM hier),
agg AS (SELECT {K}, string_agg(text, chr(10)||chr(10) ORDER BY o, sub, clause, item) AS h FROM ord GROUP BY ALL)
SELECT {K}, CASE WHEN content = '' THEN '' ELSE content || CASE WHEN h IS NULL THEN '' ELSE chr(10) || chr(10) || h END END AS full_text
FROM sections_s LEFT JOIN agg USING ({K})""")
def full_text(spark, sf):
    return CH.full_text(N.parse_hierarchy(S.sections(spark, sf)), repeat=True).select(*KEY, "full_text")


LONG, SHORT = 600, 100
SQL_PACK = lambda c, longest: f"""CASE WHEN length({c}) <= {longest} THEN [{c}] ELSE list_filter(list_transform([list_reduce(
   list_transform(list_filter(list_transform(string_split({c}, chr(10)||chr(10)), lambda p: {strip('p')}), lambda p: p <> ''), lambda p: {{'done': []::VARCHAR[], 'cur': p}}),
   lambda a, b: CASE WHEN length(a.cur) + length(b.cur) + 2 <= {longest} THEN {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || b.cur}}
     ELSE {{'done': list_append(a.done, a.cur), 'cur': b.cur}} END)], lambda s: list_append(s.done, s.cur))[1], lambda x: length(x) >= {SHORT}) END"""
PARAS = "replace(text, chr(10), chr(10) || chr(10))"


@query("split_long", f"""WITH d AS (SELECT doc_id, {PARAS} AS t FROM documents), p AS (SELECT doc_id, {SQL_PACK('t', 1500)} AS ps FROM d)
SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS part FROM p""")
def split_long(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return d.select("doc_id", F.posexplode(CH.split_long(F.col("t"), 1500, SHORT)).alias("part", "piece"))


def chunk_documents(spark, sf):
    return S.documents(spark, sf).select("doc_id", "document_name", "document_type", "year", F.col("domain").alias("primary_domain"),
                                         F.array().cast("array<string>").alias("secondary_domains"), F.col("lang").alias("language"),
                                         F.lit("India").alias("jurisdiction"), "source")


def chunks(spark, sf):
    s = S.sections(spark, sf).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    s = C.canonicalise(N.normalise(s))
    a = E.extract_amendments(S.raw_pages(spark, sf)).withColumn("source_page", F.col("page_idx") + 1)
    return CH.make_chunks(chunk_documents(spark, sf), s, a, LONG, SHORT)


def _sql_chunks(source: str) -> str:
    return f"""ct AS (SELECT {K}, section_number AS number, section_title AS title, {strip("replace(content, chr(10), chr(10) || chr(10))")} AS t, source_pages, merge_status, is_continuation,
  array_to_string({SQL_KW}, ', ') AS kws FROM {source} WHERE content <> ''),
cp AS (SELECT doc_id, page_idx, CASE kind WHEN 'section' THEN 0 ELSE 1 END AS ord, sec_idx AS pos, '_sec_' AS label, number, number AS idn, title, {SQL_PACK('t', LONG)} AS pieces, length(t) > {LONG} AS split, kws, source_pages FROM ct),
{S.sql_spans('raw_pages', AMENDMENT_OF, 'cam', 'doc_id, page_idx', {'head': 0, 'num': 1, 'tgt': 3})},
ca AS (SELECT *, {strip('head || body')} AS t FROM cam),
call AS (SELECT * FROM cp UNION ALL SELECT doc_id, page_idx, 2, sec_idx, '_amend_', tgt, num, {CAP(ACTION('t'))} || ' of section ' || tgt, [t], false, '', [page_idx + 1] FROM ca),
co AS (SELECT *, coalesce(sum(len(pieces)) OVER (PARTITION BY doc_id ORDER BY page_idx, ord, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM call),
ce AS (SELECT * EXCLUDE (pieces), unnest(pieces) AS text, generate_subscripts(pieces, 1) - 1 AS part FROM co),
chunks AS (SELECT doc_id, {SQL_SLUG('document_name')} || label || idn || '_' || (off + part) AS chunk_id, document_name AS document, document_type, year AS document_year, number AS section_number,
  CASE WHEN split THEN CASE WHEN title <> '' THEN title ELSE 'Section ' || number END || ' (part ' || (part + 1) || ')' ELSE title END AS section_title,
  text, domain, lang AS language, kws, CASE label WHEN '_sec_' THEN 'section' ELSE 'amendment' END AS chunk_type, source_pages FROM ce JOIN docs USING (doc_id))"""


EMB = """'Document: ' || document || chr(10) || 'Domain: ' || domain || chr(10) || 'Section ' || section_number || CASE WHEN section_title <> '' THEN ': ' || section_title ELSE '' END
  || chr(10) || chr(10) || text || chr(10) || chr(10) || CASE WHEN kws <> '' THEN 'Keywords: ' || kws ELSE '' END"""
SQL_CHUNKS = S.SQL_SECTIONS + ", src AS (SELECT *, [page_number] AS source_pages, NULL AS merge_status FROM sections_s), " + _sql_chunks("src")


@query("make_chunks", "WITH " + SQL_CHUNKS + f""" SELECT doc_id, chunk_id, document, document_type, document_year, section_number, section_title, text, {EMB} AS embedding_text,
  array_to_string(source_pages, '|') AS source_pages, domain, language, chunk_type FROM chunks""")
def make_chunks(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_id", "document", "document_type", "document_year", "section_number", "section_title", "text",
                                    "embedding_text", "source_pages", "domain", "language", "chunk_type")


@query("chunk_report", "WITH " + SQL_CHUNKS + """ SELECT doc_id, count(*) AS total_chunks, count_if(chunk_type='section')::BIGINT AS section_chunks,
  count_if(chunk_type='amendment')::BIGINT AS amendment_chunks, round(avg(length(text)), 2) AS avg_length, max(length(text)) AS max_length FROM chunks GROUP BY 1""")
def chunk_report(spark, sf):
    return CH.chunk_report(chunks(spark, sf)).drop("with_hierarchy")


def build(spark, sf):
    """The corpus build: damaged sections, continued, merged, normalised, cut into chunks."""
    s = M.merge_sections(RP.mark_continuations(durable(S.damaged(spark, sf))))
    s = s.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    a = E.extract_amendments(S.raw_pages(spark, sf)).withColumn("source_page", F.col("page_idx") + 1)
    return CH.make_chunks(chunk_documents(spark, sf), C.canonicalise(N.normalise(s)), a, LONG, SHORT)


@query("build_corpus", "WITH RECURSIVE " + S.SQL_DAMAGED + ", " + SQL_MARKED + ", " + SQL_MERGED.replace("FROM damaged", "FROM marked_s") + ", " + _sql_chunks("merged") + """
SELECT doc_id, chunk_id, section_number, section_title, text, array_to_string(source_pages, '|') AS source_pages, domain, chunk_type FROM chunks""")
def build_corpus(spark, sf):
    return build(spark, sf).select("doc_id", "chunk_id", "section_number", "section_title", "text", "source_pages", "domain", "chunk_type")
