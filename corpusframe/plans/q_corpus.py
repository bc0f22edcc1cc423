"""Queries: sources, sinks and relational access."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusframe import schemas
from corpusframe.functions import rules as R
from corpusframe.operators import conform
from corpusframe.operators import extract as E
from corpusframe.operators import lookup as Q
from corpusframe.plans import statutes as S
from corpusframe.plans.q_normalise import KEY, SQL_CHUNKS, chunks
from corpusframe.plans.q_validate import SQL_STRUCT
from corpusframe.plans.registry import query, table
from corpusframe.settings import shared_folder
from corpusframe.sources import readers, sinks

strip = S.sql_strip
K = "doc_id, page_idx, kind, sec_idx"


# ------------------------------------------------------------------------------------ sources

S_PAGE = schemas.PAGE


def _items(text):
    """One definition per line of a page: its place, first word and length."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("item_idx"), i.cast("string").alias("clause"), F.substring(x, 1, 8).alias("term"), x.alias("definition_text")))


def nested(spark, sf, pages=None, sections=None):
    """The corpus in its nested form: one row per document, pages and sections inside."""
    both = S.sections(spark, sf) if sections is None else sections
    section = F.struct("sec_idx", "section_number", "section_title", "content", "is_continuation")
    rule = F.struct("sec_idx", F.col("section_number").alias("rule_number"), F.col("section_title").alias("rule_title"), "content", "is_continuation")
    s = both.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "section", section))).alias("sections"),
                                               F.array_sort(F.collect_list(F.when(F.col("kind") == "rule", rule))).alias("rules"))
    # the lines of a page are found in its own text after the last shuffle, so they are not moved
    p = (S.pages(spark, sf) if pages is None else pages).join(s, ["doc_id", "page_idx"], "left").groupBy("doc_id", "document_name", "document_type").agg(
        F.array_sort(F.collect_list(F.struct("page_idx", "page_number", "page_type", "raw_text", "sections", "rules"))).alias("pages"))
    page = lambda x: F.struct(*[x[c].alias(c) for c in ("page_idx", "page_number", "page_type", "raw_text", "sections", "rules")], _items(x["raw_text"]).alias("definitions"), *[
        F.lit(None).cast(S_PAGE[n].dataType).alias(n) for n in ("amendments", "schedules", "forms", "tables")])
    p = p.withColumn("pages", F.transform("pages", page))
    return p.select(F.struct("document_name", "document_type", F.col("doc_id").cast("string").alias("source")).alias("document"), "pages")


@query("read_corpus", "WITH " + S.SQL_SECTIONS + """ SELECT doc_id || '' AS source, page_idx, sec_idx, section_number, section_title, content, kind,
  document_name || ':P' || page_number || CASE kind WHEN 'rule' THEN ':R' ELSE ':S' END || section_number AS row_key FROM sections_s""")
def read_corpus(spark, sf):
    """The nested corpus written as JSON and read back with the fixed schema."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    nested(spark, sf).write.option("compression", "gzip").json(path)
    docs = readers.read_corpus(spark, path, multi_line=False).withColumn("source", F.col("document.source"))
    return readers.flatten(docs, "source").select("source", "page_idx", "sec_idx", "section_number", "section_title", "content", "kind", "row_key")


@query("flatten_sections", "WITH " + S.SQL_SECTIONS + """ SELECT doc_id || '' AS source, page_number, page_type, sec_idx, section_number, length(content) AS chars, kind,
  document_name || ':P' || page_number || CASE kind WHEN 'rule' THEN ':R' ELSE ':S' END || section_number AS row_key FROM sections_s""")
def flatten_sections(spark, sf):
    docs = nested(spark, sf).withColumn("source", F.col("document.source"))
    return readers.flatten(docs, "source").select("source", "page_number", "page_type", "sec_idx", "section_number", F.length("content").alias("chars"), "kind", "row_key")


@query("page_items", "WITH " + S.SQL_PAGES + """ SELECT doc_id || '' AS source, page_idx, page_number, 'definitions' AS kind, j - 1 AS item_idx, (j - 1) || '' AS number, left(l[j], 8) AS title, l[j] AS text
FROM (SELECT *, string_split(raw_text, chr(10)) AS l FROM pages_s), unnest(range(1, len(l) + 1)) t(j)""")
def page_items(spark, sf):
    """Entries of nested pages beside sections and rules."""
    docs = nested(spark, sf).withColumn("source", F.col("document.source"))
    return readers.page_items(docs, "source")


def irregular(spark, sf):
    """Nested documents with page numbers as text, some of them no numbers, and fields left out here and there."""
    n, c = F.length("raw_text"), F.length("content")
    p = S.pages(spark, sf).withColumns({
        "page_number": F.when(F.pmod(n, F.lit(7)) == 0, F.concat(F.lit("p. "), F.col("page_number").cast("string"))).when(
            F.pmod(n, F.lit(5)) != 0, F.col("page_number").cast("string")),
        "page_type": F.when(F.pmod(n, F.lit(4)) == 0, F.lit("annex")).when(F.pmod(n, F.lit(9)) != 0, F.col("page_type"))})
    s = S.sections(spark, sf).withColumns({
        "section_number": F.when(F.pmod(c, F.lit(4)) != 0, F.col("section_number")), "section_title": F.when(F.pmod(c, F.lit(6)) != 0, F.col("section_title")),
        "is_continuation": F.when(F.col("is_continuation"), F.lit(True)), "content": F.when(F.pmod(c, F.lit(10)) != 0, F.col("content"))})
    docs = nested(spark, sf, p, s)
    return docs.withColumns({"source": F.col("document.source"), "document": F.when(F.pmod(F.size("pages"), F.lit(3)) != 0, F.col("document"))})


SQL_IRREGULAR = S.SQL_SECTIONS + """,
ip AS (SELECT doc_id || '' AS source, page_idx, raw_text, CASE WHEN length(raw_text) % 7 = 0 THEN 'p. ' || page_number WHEN length(raw_text) % 5 <> 0 THEN page_number || '' END AS num,
  CASE WHEN length(raw_text) % 4 = 0 THEN 'annex' WHEN length(raw_text) % 9 <> 0 THEN page_type END AS page_type FROM pages_s),
isec AS (SELECT doc_id || '' AS source, page_idx, sec_idx, kind, CASE WHEN length(content) % 4 <> 0 THEN section_number END AS section_number,
  CASE WHEN length(content) % 6 <> 0 THEN section_title END AS section_title, CASE WHEN length(content) % 10 <> 0 THEN content END AS content,
  CASE WHEN is_continuation THEN true END AS is_continuation FROM sections_s)"""


@query("conform_document", "WITH " + SQL_IRREGULAR + """
SELECT p.source, p.page_idx, coalesce(TRY_CAST(num AS BIGINT), p.page_idx + 1) AS page_number, page_type, raw_text, kind, sec_idx, coalesce(section_number, '') AS section_number,
  coalesce(section_title, '') AS section_title, coalesce(content, '') AS content, coalesce(is_continuation, false) AS is_continuation, 0::BIGINT AS n_subsections, 0::BIGINT AS n_references, 0::BIGINT AS n_forms
FROM ip p LEFT JOIN isec s ON s.source = p.source AND s.page_idx = p.page_idx""")
def conform_document(spark, sf):
    """Every conformed field of pages, sections and rules."""
    docs = conform.conform(irregular(spark, sf))
    p = docs.select("source", F.posexplode("pages").alias("page_idx", "p"))
    entry = lambda kind, number, title, sub: lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("sec_idx"), x[number].alias("section_number"), x[title].alias("section_title"), x["content"].alias("content"),
        x["is_continuation"].alias("is_continuation"), sub(x).alias("n_subsections"))
    items = F.concat(F.transform("p.sections", entry("section", "section_number", "section_title", lambda x: F.size(x["subsections"]))),
                     F.transform("p.rules", entry("rule", "rule_number", "rule_title", lambda x: F.lit(0))))
    return p.select("source", "page_idx", "p.page_number", "p.page_type", "p.raw_text", F.size("p.references").alias("n_references"), F.size("p.forms").alias("n_forms"),
                    F.inline_outer(items)).withColumn("n_subsections", F.coalesce("n_subsections", F.lit(0))) \
        .fillna("", ["section_number", "section_title", "content"]).fillna(False, ["is_continuation"])


@query("conform_issues", "WITH " + SQL_IRREGULAR + f""",
e AS (SELECT source, 'pages[' || page_idx || ']' AS place, * EXCLUDE (source) FROM ip)
SELECT source, 'error' AS severity, 'document' AS path, 'missing' AS message FROM ip GROUP BY source HAVING count(*) % 3 = 0
UNION ALL SELECT source, 'warning', place || '.page_number', CASE WHEN num IS NULL THEN 'missing' ELSE 'not of type int' END FROM e WHERE TRY_CAST(num AS BIGINT) IS NULL
UNION ALL SELECT source, 'warning', place || '.page_type', CASE WHEN page_type IS NULL THEN 'missing' ELSE 'unknown value ' || page_type END FROM e
  WHERE page_type IS NULL OR (page_type <> '' AND page_type NOT IN ({", ".join(f"'{t}'" for t in R.SCHEMA_PAGE_TYPES)}))
UNION ALL SELECT source, 'warning', 'pages[' || page_idx || '].sections[' || sec_idx || '].section_number', 'missing' FROM isec WHERE kind = 'section' AND section_number IS NULL""")
def conform_issues(spark, sf):
    return conform.issues(irregular(spark, sf), ["source"])


@query("pending", "WITH " + S.SQL_FILES + """, i AS (SELECT doc_id, lang, file_name || CASE doc_id % 6 WHEN 0 THEN '_RAG_READY' WHEN 1 THEN '_MERGED' ELSE '' END AS file_name FROM files)
SELECT file_name, doc_id FROM i WHERE doc_id % 6 > 1 AND NOT EXISTS (SELECT 1 FROM i d WHERE d.lang = 'fr' AND d.file_name = i.file_name)""")
def pending(spark, sf):
    k = F.pmod("doc_id", F.lit(6))
    i = S.files(spark, sf).withColumn("file_name", F.concat("file_name", F.when(k == 0, "_RAG_READY").when(k == 1, "_MERGED").otherwise("")))
    return readers.pending(i.select("file_name", "doc_id"), i.filter("lang = 'fr'"))


@query("load_chunks", """WITH c AS (SELECT md5(text) AS chunk_id, source AS file, doc_id AS pos, CASE doc_id % 3 WHEN 0 THEN 'Rules' ELSE 'Act' END AS document_type,
  doc_id || '' AS section_number, 't' || doc_id AS section_title, CASE doc_id % 4 WHEN 0 THEN 'MISSING' WHEN 1 THEN '' ELSE lang END AS language FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY CAST(substr(file, 4) AS INT) DESC, pos) AS rn FROM c)
SELECT chunk_id, file, pos, document_type, CASE WHEN language IN ('', 'MISSING') THEN 'en' ELSE language END AS language,
  CASE WHEN document_type = 'Rules' THEN section_number END AS rule_number, CASE WHEN document_type = 'Rules' THEN section_title END AS rule_title,
  CASE WHEN document_type <> 'Rules' THEN section_number END AS section_number, CASE WHEN document_type <> 'Rules' THEN section_title END AS section_title
FROM r WHERE rn = 1""")
def load_chunks(spark, sf):
    d = table(spark, sf, "documents")
    k = F.pmod("doc_id", F.lit(4))
    c = d.select(F.md5("text").alias("chunk_id"), F.col("source").alias("file"), F.col("doc_id").alias("pos"),
                 F.when(F.pmod("doc_id", F.lit(3)) == 0, "Rules").otherwise("Act").alias("document_type"),
                 F.col("doc_id").cast("string").alias("section_number"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("section_title"),
                 F.lit(None).cast("string").alias("rule_number"), F.lit(None).cast("string").alias("rule_title"),
                 F.when(k == 0, "MISSING").when(k == 1, "").otherwise(F.col("lang")).alias("language"))
    order = d.select(F.col("source").alias("file")).distinct().withColumn("priority", -F.substring("file", 4, 9).cast("int"))
    return readers.load_chunks(c, order).select("chunk_id", "file", "pos", "document_type", "language", "rule_number", "rule_title", "section_number", "section_title")


# ------------------------------------------------------------------------------------ sinks

@query("sections_csv_view", "WITH " + S.SQL_SECTIONS + """ SELECT page_number, page_type, section_number, section_title, length(content) AS content_length, is_continuation, document_name FROM sections_s""")
def sections_csv_view(spark, sf):
    return sinks.sections_csv_view(S.sections(spark, sf))


def stored_chunks(spark, sf):
    return chunks(spark, sf).withColumns({"rule_number": F.lit(None).cast("string"), "rule_title": F.lit(None).cast("string")})


@query("embedding_metadata", "WITH " + SQL_CHUNKS + """ SELECT row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS index, chunk_id, document, document_type, section_number, section_title,
  language, domain, replace(replace(document, ' ', '_'), ',', '') || '.pdf' AS filename FROM chunks""")
def embedding_metadata(spark, sf):
    m = sinks.embedding_metadata(stored_chunks(spark, sf), ["doc_id", "chunk_id"])
    return m.select("index", "chunk_id", "document", "document_type", "section_number", "section_title", "language", "domain", "filename")


@query("embedding_manifest", "WITH " + SQL_CHUNKS + """ SELECT 'language' AS dimension, language AS key, count(*) AS n FROM chunks GROUP BY language
UNION ALL SELECT 'domain', domain, count(*) FROM chunks GROUP BY domain UNION ALL SELECT 'total', 'all', count(*) FROM chunks""")
def embedding_manifest(spark, sf):
    return sinks.embedding_manifest(chunks(spark, sf))


@query("to_collection", "WITH " + SQL_CHUNKS + """, c AS (SELECT *, source_pages::JSON::VARCHAR AS sp FROM chunks WHERE chunk_type = 'section' OR document_type <> 'Rules')
SELECT doc_id || '_' || chunk_id AS chunk_id, document, document_type, coalesce(document_year, 0)::BIGINT AS document_year, language, domain, section_number, section_title, '' AS rule_number, '' AS rule_title,
  replace(sp, ' ', '') AS source_pages, text FROM c""")
def to_collection(spark, sf):
    c = stored_chunks(spark, sf).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_"), "chunk_id"))
    stored = c.filter("chunk_type = 'amendment' AND document_type = 'Rules'").select("chunk_id")
    return sinks.to_collection(c, stored).drop("keywords", "cross_references")


@query("batch_report", "WITH " + S.SQL_SECTIONS + """, st AS (SELECT doc_id, CASE WHEN document_type = 'Other' THEN 'error' ELSE 'success' END AS status, coalesce(p, 0) AS p, coalesce(s, 0) AS s FROM docs
  LEFT JOIN (SELECT doc_id, count(*) AS p FROM pages_s GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS s FROM sections_s GROUP BY 1) USING (doc_id))
SELECT count(*) AS total_documents, count_if(status = 'success')::BIGINT AS successful, count_if(status <> 'success')::BIGINT AS failed,
  sum(CASE WHEN status = 'success' THEN p ELSE 0 END)::BIGINT AS total_pages, sum(CASE WHEN status = 'success' THEN s ELSE 0 END)::BIGINT AS total_sections FROM st""")
def batch_report(spark, sf):
    st = Q.doc_stats(S.pages(spark, sf), S.sections(spark, sf)).join(S.documents(spark, sf).select("doc_id", "document_type"), "doc_id")
    return sinks.batch_report(st.select(F.when(F.col("document_type") == "Other", "error").otherwise("success").alias("status"),
                                        F.col("total_pages").alias("pages"), F.col("total_sections").alias("sections")))


# ------------------------------------------------------------------------------------ access

@query("by_number", "WITH " + S.SQL_SECTIONS + f" SELECT {K}, section_title FROM sections_s WHERE section_number = '2'")
def by_number(spark, sf):
    return Q.by_number(S.sections(spark, sf), "2").select(*KEY, "section_title")


@query("page_by_number", "WITH " + S.SQL_PAGES + " SELECT doc_id, page_idx, raw_text FROM pages_s WHERE page_number = 2")
def page_by_number(spark, sf):
    return Q.page_by_number(S.pages(spark, sf), 2).select("doc_id", "page_idx", "raw_text")


@query("sections_by_page", "WITH " + S.SQL_SECTIONS + f" SELECT {K}, section_number FROM sections_s WHERE page_number = 2")
def sections_by_page(spark, sf):
    return Q.sections_by_page(S.pages(spark, sf), S.sections(spark, sf), 2).select(*KEY, "section_number")


OCC = lambda c, t: f"(length({c}) - length(replace({c}, '{t}', ''))) // {len(t)}"


@query("search_sections", "WITH " + S.SQL_SECTIONS + f""" SELECT {K}, {OCC('lower(content)', 'patent')} AS match_count FROM sections_s WHERE contains(lower(content), 'patent')""")
def search_sections(spark, sf):
    return Q.ranked(Q.search(S.sections(spark, sf), "Patent"), KEY).select(*KEY, "match_count")


@query("search_documents", f"SELECT doc_id, {OCC('text', 'the')} AS match_count FROM documents WHERE contains(text, 'the')")
def search_documents(spark, sf):
    return Q.search(table(spark, sf, "documents"), "the", True, "text").select("doc_id", "match_count")


@query("search_pages", "WITH " + S.SQL_RAW + f""" SELECT doc_id, page_idx, page_number, left(raw_text, 200) || '...' AS snippet, {OCC('lower(raw_text)', 'government')} AS matches
FROM raw_pages WHERE contains(lower(raw_text), 'government')""")
def search_pages(spark, sf):
    return Q.search_pages(S.raw_pages(spark, sf), "Government")


WC = lambda c: f"len(list_filter(string_split_regex({strip(c)}, '\\s+'), lambda w: w <> ''))"
SQL_STATS = f"""st AS (SELECT doc_id, total_pages, coalesce(n, 0)::BIGINT AS total_sections, coalesce(ch, 0)::BIGINT AS total_characters, coalesce(w, 0)::BIGINT AS total_words,
  coalesce(ch // n, 0)::BIGINT AS average_section_length FROM (SELECT doc_id, count(*) AS total_pages FROM pages_s GROUP BY 1)
  LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(content))::BIGINT AS ch, sum({WC('content')}) AS w FROM sections_s GROUP BY 1) USING (doc_id))"""


@query("doc_stats", "WITH " + S.SQL_SECTIONS + ", " + SQL_STATS + " SELECT * FROM st")
def doc_stats(spark, sf):
    return Q.doc_stats(S.pages(spark, sf), S.sections(spark, sf))


@query("compare_documents", "WITH " + S.SQL_SECTIONS + ", " + SQL_STATS + """, l AS (SELECT doc_id, 'total_pages' AS measure, total_pages AS v FROM st UNION ALL SELECT doc_id, 'total_sections', total_sections FROM st
  UNION ALL SELECT doc_id, 'total_words', total_words FROM st)
SELECT measure, min(v) AS smallest, max(v) AS largest, sum(v)::BIGINT AS total, min_by(doc_id, {'a': -v, 'b': doc_id}) AS largest_doc FROM l GROUP BY 1""")
def compare_documents(spark, sf):
    return Q.compare(Q.doc_stats(S.pages(spark, sf), S.sections(spark, sf)), ["total_pages", "total_sections", "total_words"])


@query("section_index", "WITH " + S.SQL_SECTIONS + """ SELECT doc_id, kind, section_number, arg_min(section_title, page_idx * 1000 + sec_idx) AS title,
  string_agg(page_number, '|' ORDER BY page_idx, sec_idx) AS pages, coalesce(string_agg(content, '|' ORDER BY page_idx, sec_idx) FILTER (content <> ''), '') AS contents FROM sections_s GROUP BY 1, 2, 3""")
def section_index(spark, sf):
    return Q.section_index(S.sections(spark, sf))


@query("page_stats", "WITH " + SQL_STRUCT + f""" SELECT doc_id, count(*) AS total_pages, count_if({strip('raw_text')} <> '')::BIGINT AS pages_with_content, count_if({strip('raw_text')} = '')::BIGINT AS empty_pages,
  sum(ns)::BIGINT AS total_sections, sum(nr)::BIGINT AS total_rules, sum(nd)::BIGINT AS total_definitions FROM pcounts GROUP BY 1""")
def page_stats(spark, sf):
    return Q.page_stats(E.count_structures(S.pages(spark, sf)))


@query("document_text", "WITH " + S.SQL_RAW + f""" SELECT doc_id, string_agg(raw_text, chr(10) || chr(10) ORDER BY page_idx) AS full_text FROM raw_pages WHERE {strip('raw_text')} <> '' GROUP BY 1""")
def document_text(spark, sf):
    return Q.document_text(S.raw_pages(spark, sf))


GR = lambda c: f"list_distinct(list_transform(range(1, length({c}) - 3), lambda i: substr({c}, i, 5)))"


@query("overlap_join", f"""WITH d AS (SELECT doc_id AS left_id, unnest({GR('text')}) AS gram FROM documents), b AS (SELECT item_id AS right_id, unnest({GR('text')}) AS gram FROM benchmark)
SELECT left_id, right_id, count(*) * 5 AS overlap_chars FROM d JOIN b USING (gram) GROUP BY 1, 2 HAVING count(*) * 5 > 100""")
def overlap_join(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return Q.overlap_join(d, b)


def _flat_key(c: str, name: str) -> list:
    return [F.col(f"{c}.{k}").alias(f"{name}_{k}") for k in Q.SECTION_KEY]


SQL_CLASSES = S.SQL_SECTIONS + f""",
gs AS (SELECT {K}, {{'d': doc_id, 'p': page_idx, 'k': kind, 's': sec_idx}} AS k, list_sort({GR('content')}) AS gs FROM sections_s WHERE length(content) >= 5),
cl AS (SELECT gs, min(k) AS rep, min(doc_id) AS lo, max(doc_id) AS hi FROM gs GROUP BY gs)"""


@query("section_classes", "WITH " + SQL_CLASSES + """
SELECT doc_id, page_idx, kind, sec_idx, rep.d AS rep_doc_id, rep.p AS rep_page_idx, rep.k AS rep_kind, rep.s AS rep_sec_idx, len(gs) AS n_grams FROM gs JOIN cl USING (gs)""")
def section_classes(spark, sf):
    """Which section stands for which in ``overlapping_sections``."""
    members = Q.gram_classes(S.sections(spark, sf))[0]
    return members.select("k.*", *_flat_key("rep", "rep"), "n_grams")


@query("overlapping_sections", "WITH " + SQL_CLASSES + """,
u AS (SELECT rep, lo, hi, unnest(gs) AS gram FROM cl WHERE len(gs) > 20),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) * 5 AS overlap_chars FROM u a JOIN u b ON a.gram = b.gram AND a.rep < b.rep AND least(a.lo, b.lo) < greatest(a.hi, b.hi)
  GROUP BY 1, 2 HAVING count(*) * 5 > 100)
SELECT a.d AS a_doc_id, a.p AS a_page_idx, a.k AS a_kind, a.s AS a_sec_idx, b.d AS b_doc_id, b.p AS b_page_idx, b.k AS b_kind, b.s AS b_sec_idx, overlap_chars FROM o""")
def overlapping_sections(spark, sf):
    """Sections of different documents that share text, each set of equal sections once."""
    pairs = Q.overlapping_classes(Q.gram_classes(S.sections(spark, sf))[1])
    return pairs.select(*_flat_key("a", "a"), *_flat_key("b", "b"), "overlap_chars")


@query("published_stage", "WITH " + S.SQL_SECTIONS + """ SELECT doc_id, kind, count(*) AS n_sections, sum(length(content))::BIGINT AS n_chars FROM sections_s GROUP BY ALL""")
def published_stage(spark, sf):
    """The sections published as a stage; the report that came with the version last published."""
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    report = lambda d: d.groupBy("doc_id", "kind").agg(F.count("*").alias("n_sections"), F.sum(F.length("content")).alias("n_chars"))
    sinks.publish_stage(S.sections(spark, sf), report, path)
    return sinks.read_report(spark, path)
