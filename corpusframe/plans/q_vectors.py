"""Queries: vectors, routing and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import language as L
from corpusframe.functions import routes as RT
from corpusframe.operators import evidence as EV
from corpusframe.operators import routing as RO
from corpusframe.operators import vectors as V
from corpusframe.plans import statutes as S
from corpusframe.plans.q_normalise import SQL_LIST
from corpusframe.plans.q_text import SQL_WORDS
from corpusframe.plans.registry import query, table

strip = S.sql_strip
DOMAINS = ["Biodiversity", "Traditional Knowledge", "Patents", "Trademarks", "Designs", "Copyright", "Geographical Indications", "Environment",
           "General Legal", "Access & Benefit Sharing"]


def corpus(spark, sf):
    """Chunks with vectors: the whole embeddings table with the text of the document of the same number."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.col("lang").alias("language"), F.col("source").alias("document"))
    c = e.join(d, "vec_id", "left")
    name = F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), F.col("label") + 1)
    t = F.pmod("vec_id", F.lit(3))
    return c.select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("document", F.lit("none")).alias("document"),
        name.alias("domain"), F.when(t == 0, "Act").when(t == 1, "Rules").otherwise("Other").alias("document_type"),
        F.when(t != 2, (F.col("label") + 1990).cast("int")).alias("document_year"),
        F.when(t == 0, F.col("vec_id").cast("string")).alias("section_number"), F.when(t == 0, F.lit("On things")).alias("section_title"),
        F.when(t == 1, F.col("vec_id").cast("string")).alias("rule_number"), F.lit(None).cast("string").alias("rule_title"),
        F.when(t == 2, F.array().cast("array<int>")).otherwise(F.array(F.col("label"), F.col("label") + 1)).alias("source_pages"),
        F.when(t == 0, F.split(F.lit("a,b,c,d,e,f,g,h,i,j"), ",")).otherwise(F.array().cast("array<string>")).alias("keywords"),
        F.when(t == 1, F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct(F.concat(F.lit("section "), i.cast("string")).alias("reference_text"))))
        .otherwise(F.array().cast("array<struct<reference_text:string>>")).alias("cross_references"), "label")


SQL_CORPUS = f"""corpus AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding, coalesce(text, '') AS text, coalesce(lang, 'en') AS language, coalesce(source, 'none') AS document,
  {S._case(DOMAINS, 'label')} AS domain, CASE vec_id % 3 WHEN 0 THEN 'Act' WHEN 1 THEN 'Rules' ELSE 'Other' END AS document_type, CASE WHEN vec_id % 3 <> 2 THEN label + 1990 END AS document_year,
  CASE WHEN vec_id % 3 = 0 THEN vec_id || '' END AS section_number, CASE WHEN vec_id % 3 = 0 THEN 'On things' END AS section_title, CASE WHEN vec_id % 3 = 1 THEN vec_id || '' END AS rule_number,
  CASE WHEN vec_id % 3 <> 2 THEN label || ', ' || (label + 1) END AS pages, label FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""


#: The searches in tables with odd vectors ask with every row whose number is divisible by this.
EVERY = 20
SQL_ASKS = f"q.chunk_id % {EVERY} = 0"


def all_hits(spark, sf, k: int = 5):
    """Every vector as a query."""
    c = corpus(spark, sf)
    return V.knn(c.select(F.col("chunk_id").alias("query_id"), "embedding"), c, k)


SQL_HITS = lambda k, cond="true": f"""hits AS (SELECT * EXCLUDE (s), round(s, 4) AS score FROM (SELECT q.chunk_id AS query_id, c.chunk_id, list_cosine_similarity(q.embedding, c.embedding) AS s,
  row_number() OVER (PARTITION BY q.chunk_id ORDER BY list_cosine_similarity(q.embedding, c.embedding) DESC, c.chunk_id) AS rank FROM corpus q, corpus c WHERE {cond}) WHERE rank <= {k})"""


@query("vectorise", f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex({strip("lower(coalesce(text, ''))")}, '\\s+'), lambda w: w <> '')) AS w FROM documents),
p AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS p, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
SELECT doc_id, p AS place, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM p""")
def vectorise(spark, sf):
    v = V.vectorise(table(spark, sf, "documents").select("doc_id", "text"), "text", dim=64)
    return v.select("doc_id", F.posexplode("embedding").alias("place", "value")).filter("value != 0").withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("check_vectors", f"""WITH {SQL_CORPUS} SELECT chunk_id, 'error' AS severity, 'dimension' AS issue FROM corpus WHERE language = 'fr'
UNION ALL SELECT chunk_id, 'error', 'nan_or_inf' FROM corpus WHERE language = 'de' UNION ALL SELECT chunk_id, 'warning', 'empty_text' FROM corpus WHERE language = 'es'""")
def check_vectors(spark, sf):
    c = corpus(spark, sf)
    nan = F.array(F.lit(float("nan")).cast("float"))
    v = F.when(F.col("language") == "fr", F.slice("embedding", 1, 63)).when(F.col("language") == "de", F.concat(nan, F.slice("embedding", 2, 63))).otherwise(F.col("embedding"))
    t = F.when(F.col("language") == "es", F.lit(" \n")).otherwise(F.concat(F.lit("x"), "text"))
    return V.check_vectors(c.select("chunk_id", v.alias("embedding"), t.alias("text")), 64, text="text")


@query("apply_filters", f"WITH {SQL_CORPUS} SELECT chunk_id FROM corpus WHERE domain IN ('Patents', 'Designs', 'Copyright') AND language = 'en' AND document_type = 'Act'")
def apply_filters(spark, sf):
    return V.apply_filters(corpus(spark, sf), domain=["Patents", "Designs", "Copyright"], language="en", document_type="Act").select("chunk_id")


@query("knn_exemplars", f"WITH {SQL_CORPUS}, ex AS (SELECT label, min(chunk_id) AS id FROM corpus GROUP BY 1), {SQL_HITS(10, 'q.chunk_id IN (SELECT id FROM ex)')} SELECT query_id, chunk_id, rank, score FROM hits")
def knn_exemplars(spark, sf):
    """The first vector of every label as a query over all vectors."""
    c = corpus(spark, sf)
    q = c.groupBy("label").agg(F.min("chunk_id").alias("query_id"), F.min_by("embedding", "chunk_id").alias("embedding"))
    return V.knn(q, c, 10)


@query("knn_all", f"WITH {SQL_CORPUS}, {SQL_HITS(5, 'true')} SELECT query_id, chunk_id, rank, score FROM hits")
def knn_all(spark, sf):
    return all_hits(spark, sf)


@query("knn_odd", f"""WITH {SQL_CORPUS.replace('FROM embeddings LEFT JOIN', "FROM (SELECT * FROM embeddings WHERE vec_id % 7 NOT IN (0, 1, 3)) e LEFT JOIN")}, {SQL_HITS(5, SQL_ASKS)}
SELECT query_id, chunk_id, rank, score FROM hits""")
def knn_odd(spark, sf):
    """Search in a table in which some vectors are too short, missing, or hold a NaN; the first query among them."""
    c = corpus(spark, sf).select("chunk_id", "embedding")
    r = F.pmod("chunk_id", F.lit(7))
    nan = F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))
    odd = c.withColumn("embedding", F.when(r == 0, F.slice("embedding", 1, 63)).when(r == 1, nan).when(r != 3, F.col("embedding")))
    return V.knn(odd.filter(F.pmod("chunk_id", F.lit(EVERY)) == 0).withColumnRenamed("chunk_id", "query_id"), odd, 5)


@query("knn_left_out", """SELECT 'queries' AS side, count(*) AS n_rows, count_if(vec_id % 7 = 0 OR vec_id % 7 = 3)::BIGINT AS n_left_out FROM embeddings WHERE vec_id % 20 = 0
UNION ALL SELECT 'corpus', count(*), count_if(vec_id % 7 = 0 OR vec_id % 7 = 3)::BIGINT FROM embeddings""")
def knn_left_out(spark, sf):
    c = corpus(spark, sf).select("chunk_id", "embedding")
    r = F.pmod("chunk_id", F.lit(7))
    odd = c.withColumn("embedding", F.when(r == 0, F.slice("embedding", 1, 63)).when(r != 3, F.col("embedding")))
    return V.left_out(odd.filter(F.pmod("chunk_id", F.lit(EVERY)) == 0), odd, 64)


@query("knn_grid", f"WITH {SQL_CORPUS}, {SQL_HITS(3, 'true')} SELECT query_id, chunk_id, rank, score FROM hits")
def knn_grid(spark, sf):
    """The same search with few cells, each in blocks on both sides, as for large cells that many queries visit."""
    c = corpus(spark, sf)
    return V.knn(c.select(F.col("chunk_id").alias("query_id"), "embedding"), c, 3, query_numbers=64 * 300, cell_numbers=64 * 300, cells=2)


@query("knn_filtered", f"""WITH {SQL_CORPUS}, {SQL_HITS(5, "c.domain = q.domain AND c.language = 'en'")} SELECT query_id, chunk_id, rank, score FROM hits""")
def knn_filtered(spark, sf):
    c = corpus(spark, sf)
    q = c.select(F.col("chunk_id").alias("query_id"), "embedding", F.array("domain").alias("domains"))
    return V.knn(q, V.apply_filters(c, language="en"), 5, cells=6)


SQL_SEARCH = f"WITH {SQL_CORPUS}, {SQL_HITS(5)}"


@query("search_results", SQL_SEARCH + """ SELECT h.query_id, h.chunk_id, rank, score, c.domain, c.document_type, CASE WHEN length(c.text) > 500 THEN left(c.text, 500) || '...' ELSE c.text END AS text,
  CASE WHEN o.label % 2 = 0 THEN 'en' ELSE 'hi' END AS query_language FROM hits h JOIN corpus c USING (chunk_id) JOIN corpus o ON o.chunk_id = h.query_id""")
def search_results(spark, sf):
    c = corpus(spark, sf)
    asked = F.when(F.pmod("label", F.lit(2)) == 0, F.concat(F.lit("about "), "domain")).otherwise(F.lit("यह क्या है"))
    q = c.select(F.col("chunk_id").alias("query_id"), asked.alias("query"))
    r = V.search_results(all_hits(spark, sf), q, c.select("chunk_id", "domain", "document_type", "text"))
    return r.select("query_id", "chunk_id", "rank", "score", "domain", "document_type", "text", "query_language")


@query("confidence_band", f"""WITH {SQL_CORPUS}, {SQL_HITS(1, "c.chunk_id <> q.chunk_id AND q.label <> c.label")}, t AS (SELECT query_id, max(score) AS s FROM hits GROUP BY 1)
SELECT chunk_id AS query_id, s AS top_score, CASE WHEN s >= .6 THEN 'high' WHEN s >= .4 THEN 'medium' WHEN s >= .25 THEN 'low' ELSE 'none' END AS band FROM corpus LEFT JOIN t ON query_id = chunk_id""")
def confidence_band(spark, sf):
    c = corpus(spark, sf)
    others = lambda label: F.array(*[F.when(F.col(label) != i, F.lit(d)) for i, d in enumerate(DOMAINS)])
    q = c.select(F.col("chunk_id").alias("query_id"), "embedding", "label", F.array_compact(others("label")).alias("domains"))
    hits = V.knn(q, c, 1, cells=6)
    return V.confidence_band(q, hits)


# ------------------------------------------------------------------------------------ routing

QUESTIONS = ["What does Section 11 of the Patents Act deal with?", "What is access and benefit sharing?", "What is a geographical indication?",
             "Can traditional knowledge be protected through patents?", "What obligations apply when accessing biological resources with traditional knowledge?",
             "What is a patent?", "", "Penalty for trademark infringement under rule 5"]


def asked(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(QUESTIONS)))
    pre = F.element_at(F.array(*[F.lit(x) for x in QUESTIONS]), (k + 1).cast("int"))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.concat(pre, F.lit(" "), "text").alias("query"))


def _sql_points(r: RT.Route) -> str:
    parts = [f"len(list_intersect(ws, {SQL_LIST(r.single)}))"]
    if r.phrases:
        parts.append(f"2 * len(list_filter({SQL_LIST(r.multi)}, lambda p: contains(lower(query), p)))")
    parts += [f"CASE WHEN regexp_matches(lower(query), '{p}') THEN {w} ELSE 0 END" for p, w in r.boosts]
    if r.section_numbers:
        parts.append(f"CASE WHEN regexp_matches(lower(query), 'section\\s+\\d+') AND len(list_filter({SQL_LIST([f'section {n}' for n in r.section_numbers])}, lambda p: contains(lower(query), p))) > 0 THEN 2 ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


SQL_ASKED = f"""asked AS (SELECT conv_id || '-' || turn AS query_id, {S._case(QUESTIONS, '(conv_id + turn) % 8')} || ' ' || text AS query FROM conversations WHERE role = 'user'),
aw AS (SELECT *, {SQL_WORDS('query')} AS ws FROM asked),
sc AS (""" + " UNION ALL ".join(f"SELECT query_id, '{r.name}' AS route, {i} AS ord, least(1.0, {_sql_points(r)}::DOUBLE / {r.scale}) AS score FROM aw" for i, r in enumerate(RT.ROUTES)) + """),
sg AS (SELECT *, count_if(score >= .25) OVER q AS ne, count_if(score >= .3) OVER q AS ns, max(score) OVER q AS mx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rk FROM sc WINDOW q AS (PARTITION BY query_id)),
sb AS (SELECT *, count_if(score = mx) OVER (PARTITION BY query_id) AS nb FROM sg),
sel AS (SELECT *, CASE WHEN ne = 0 THEN rk = 1 WHEN ns > 1 THEN score >= .3 WHEN mx >= .4 AND nb = 1 THEN rk = 1 ELSE score >= .25 END AS chosen FROM sb)"""


@query("route_scores", f"WITH {SQL_ASKED} SELECT query_id, route, round(score, 6) AS score FROM sc")
def route_scores(spark, sf):
    return RO.route_scores(asked(spark, sf)).select("query_id", F.inline("scores")).select("query_id", "route", F.round("score", 6).alias("score"))


IPN = next(r.section_numbers for r in RT.ROUTES if r.section_numbers)


@query("ip_section_boost", f"""WITH {SQL_ASKED} SELECT query_id, CASE WHEN regexp_matches(lower(query), 'section\\s+\\d+')
  AND len(list_filter({SQL_LIST([f'section {n}' for n in IPN])}, lambda p: contains(lower(query), p))) > 0 THEN 2 ELSE 0 END::BIGINT AS section_boost FROM asked""")
def ip_section_boost(spark, sf):
    return RO.ip_section_boost(asked(spark, sf)).drop("query")


@query("select_routes", f"WITH {SQL_ASKED} SELECT query_id, string_agg(route, '|' ORDER BY score DESC, ord) AS selected FROM sel WHERE chosen GROUP BY 1")
def select_routes(spark, sf):
    return RO.select_routes(RO.route_scores(asked(spark, sf))).select("query_id", F.col("selected.route").alias("selected"))


@query("routing", f"""WITH {SQL_ASKED} SELECT query_id, arg_min(route, rk) AS primary_route, count(*) > 1 AS is_multi,
  string_agg(route || '(' || printf('%.2f', round_even(score, 2)) || ')', '; ' ORDER BY score DESC, ord) AS reason FROM sel WHERE chosen GROUP BY 1""")
def routing(spark, sf):
    return RO.routing(RO.select_routes(RO.route_scores(asked(spark, sf)))).select("query_id", "primary_route", "is_multi", "reason")


@query("routing_debug", f"WITH {SQL_ASKED} SELECT query_id, route, round(score, 6) AS score, chosen AS selected FROM sel")
def routing_debug(spark, sf):
    return RO.routing_debug(RO.select_routes(RO.route_scores(asked(spark, sf)))).withColumn("score", F.round("score", 6))


RD = " UNION ALL ".join(f"SELECT '{r.name}' AS route, '{d}' AS domain" for r in RT.ROUTES for d in r.domains)


@query("route_domains", f"""WITH {SQL_CORPUS}, {SQL_ASKED}, rd AS ({RD}), n AS (SELECT domain, count(*) AS n FROM corpus GROUP BY 1), rn AS (SELECT route, sum(n)::BIGINT AS s FROM rd JOIN n USING (domain) GROUP BY 1)
SELECT query_id, route, CASE WHEN route = 'legal' THEN (SELECT count(*) FROM corpus) ELSE coalesce(s, 0) END::BIGINT AS searchable FROM sel LEFT JOIN rn USING (route) WHERE chosen""")
def route_domains(spark, sf):
    routed = RO.routed_queries(RO.select_routes(RO.route_scores(asked(spark, sf))))
    return RO.routed_chunks(routed, corpus(spark, sf)).select("query_id", "route", "searchable")


# ------------------------------------------------------------------------------------ evidence

def questions(spark, sf):
    """Every vector as a query; its text is the text of its document."""
    return corpus(spark, sf).select(F.col("chunk_id").alias("query_id"), F.concat(F.lit("about "), "text").alias("query"), "language")


def hit_rows(spark, sf, k: int = 5):
    return all_hits(spark, sf, k).join(corpus(spark, sf).drop("embedding"), "chunk_id")


WS = lambda c: f"list_filter(list_distinct(string_split_regex({strip(f'lower({c})')}, '\\s+')), lambda w: w <> '')"
SQL_EVID = f"WITH {SQL_CORPUS}, {SQL_HITS(5)}, hr AS (SELECT h.*, c.* EXCLUDE (chunk_id, embedding) FROM hits h JOIN corpus c USING (chunk_id)), qs AS (SELECT chunk_id AS query_id, 'about ' || text AS query, language FROM corpus)"
SQL_REL = SQL_EVID + f""", far AS (SELECT query_id, rank - 1 AS rank, score, text FROM hr WHERE rank > 1), rel AS (SELECT query_id, least(1.0, score * .7 +
  len(list_intersect({WS('query')}, {WS('text')}))::DOUBLE / greatest(len({WS('query')}), 1) * .3) AS relevance FROM far JOIN qs USING (query_id) WHERE rank = 1)"""


def far(spark, sf):
    """Hits without the query's own vector (it is always first)."""
    return hit_rows(spark, sf).filter("rank > 1").withColumn("rank", F.col("rank") - 1)


@query("relevance", SQL_REL + " SELECT query_id, round(relevance, 6) AS relevance FROM rel")
def relevance(spark, sf):
    return EV.relevance(questions(spark, sf), far(spark, sf)).withColumn("relevance", F.round("relevance", 6))


@query("decide", SQL_REL + """ SELECT query_id, round(coalesce(relevance, 0), 6) AS relevance, CASE WHEN relevance IS NULL OR relevance < .3 THEN 'insufficient_evidence' ELSE 'sufficient' END AS status
FROM qs LEFT JOIN rel USING (query_id)""")
def decide(spark, sf):
    r = EV.relevance(questions(spark, sf), far(spark, sf))
    return EV.decide(questions(spark, sf), r).select("query_id", F.round("relevance", 6).alias("relevance"), "status")


SQL_MULTI = SQL_EVID + """, mu AS (SELECT query_id // 10 AS query_id, query_id % 10 AS route_ord, rank, CASE WHEN chunk_id % 5 <> 0 THEN chunk_id END AS chunk_id, text FROM hr),
md AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(chunk_id || '', 'text:' || left(text, 200)) ORDER BY route_ord, rank) AS rn FROM mu)"""


@query("dedupe_evidence", SQL_MULTI + " SELECT query_id, route_ord, rank, coalesce(chunk_id || '', '') AS chunk_id FROM md WHERE rn = 1")
def dedupe_evidence(spark, sf):
    """Ten queries together stand for one query that was sent to ten routes."""
    h = hit_rows(spark, sf).select(F.floor(F.col("query_id") / 10).alias("query_id"), F.pmod("query_id", F.lit(10)).alias("route_ord"), "rank",
                                   F.when(F.pmod("chunk_id", F.lit(5)) != 0, F.col("chunk_id")).alias("chunk_id"), "text")
    return EV.dedupe_evidence(h).select("query_id", "route_ord", "rank", F.coalesce(F.col("chunk_id").cast("string"), F.lit("")).alias("chunk_id"))


SQL_BLOCK = f"""'SOURCE ' || rank || chr(10) || 'Document: ' || document || CASE WHEN document_year IS NOT NULL THEN ' (' || document_year || ')' ELSE '' END || chr(10) || 'Type: ' || document_type || chr(10)
  || 'Domain: ' || domain || chr(10) || 'Language: ' || language || chr(10) || CASE WHEN section_number IS NOT NULL THEN 'Section: ' || section_number || ' — On things' WHEN rule_number IS NOT NULL THEN 'Rule: ' || rule_number
    ELSE 'Section/Rule: Information unavailable in retrieved metadata' END || chr(10) || CASE WHEN pages IS NOT NULL THEN 'Pages: ' || pages || chr(10) ELSE '' END || 'Relevance Score: ' || printf('%.4f', score) || chr(10)
  || CASE WHEN section_number IS NOT NULL THEN 'Keywords: a, b, c, d, e, f, g, h' || chr(10) ELSE '' END
  || CASE WHEN rule_number IS NOT NULL THEN 'Cross-references: section 1, section 2, section 3, section 4, section 5' || chr(10) ELSE '' END
  || chr(10) || CASE WHEN {strip('text')} = '' THEN '[No text content available]' ELSE {strip('text')} END"""


@query("source_block", SQL_EVID + f" SELECT query_id, rank, {SQL_BLOCK} AS block FROM hr")
def source_block(spark, sf):
    return EV.source_block(hit_rows(spark, sf)).select("query_id", "rank", "block")


@query("source_block_short", SQL_EVID + """ SELECT query_id, rank, 'SOURCE ' || rank || chr(10) || 'Document: ' || document || ' (' || coalesce(document_year || '', '') || ')' || chr(10)
  || CASE WHEN section_number IS NOT NULL THEN 'Section: ' || section_number || ' - On things' || chr(10) ELSE '' END || CASE WHEN rule_number IS NOT NULL THEN 'Rule: ' || rule_number || ' - ' || chr(10) ELSE '' END
  || CASE WHEN pages IS NOT NULL THEN 'Pages: ' || pages || chr(10) ELSE '' END || 'Text: ' || text AS block FROM hr""")
def source_block_short(spark, sf):
    return EV.source_block_short(hit_rows(spark, sf)).select("query_id", "rank", "block")


SQL_CTX = SQL_EVID + f""", bl AS (SELECT query_id, rank, {SQL_BLOCK} AS b FROM hr), cu AS (SELECT *, sum(length(b)) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM bl),
pc AS (SELECT query_id, rank, CASE WHEN s <= 6000 THEN b WHEN s - length(b) <= 6000 AND 6000 - (s - length(b)) > 200 THEN left(b, (6000 - (s - length(b)))::BIGINT) || chr(10) || '[TRUNCATED]' END AS p FROM cu),
ag AS (SELECT query_id, count(p) AS n, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY rank), '') AS body FROM pc GROUP BY 1),
ctx AS (SELECT query_id, coalesce(n, 0)::BIGINT AS n_sources, CASE WHEN n IS NULL THEN 'No relevant legal provisions found in the knowledge base.' ELSE 'RETRIEVED LEGAL SOURCES (' || n || ' sources):' || chr(10) || body END AS context FROM qs LEFT JOIN ag USING (query_id))"""


def contexts(spark, sf):
    blocks = EV.source_block(hit_rows(spark, sf))
    return EV.context(questions(spark, sf), blocks, 6000)


@query("context", SQL_CTX + " SELECT * FROM ctx")
def context(spark, sf):
    return contexts(spark, sf)


@query("source_list", SQL_EVID + " SELECT query_id, rank, document, document_type, section_number, rule_number, replace(coalesce(pages, ''), ', ', '|') AS source_pages, score, language, domain FROM hr")
def source_list(spark, sf):
    return EV.source_list(hit_rows(spark, sf)).drop("section_title", "rule_title", "document_year")


@query("citations", SQL_EVID + """ SELECT query_id, 'Sources:' || chr(10) || string_agg('  ' || rank || '. ' || document || CASE WHEN document_year IS NOT NULL THEN ' (' || document_year || ')' ELSE '' END || ' | '
  || CASE WHEN section_number IS NOT NULL THEN 'Section ' || section_number || ' — On things' WHEN rule_number IS NOT NULL THEN 'Rule ' || rule_number ELSE 'Section/Rule information unavailable in retrieved metadata' END
  || CASE WHEN pages IS NOT NULL THEN ' | Pages ' || pages ELSE '' END, chr(10) ORDER BY rank) AS citations FROM hr GROUP BY 1""")
def citations(spark, sf):
    return EV.citations(hit_rows(spark, sf))


@query("prompt_table", SQL_CTX + f""" SELECT query_id, '<|system|>' || chr(10) || '{EV.SYSTEM_TEXT}' || chr(10) || chr(10) || CASE language WHEN 'en' THEN '{EV.ANSWER_LANGUAGE["en"]}' ELSE '{EV.ANSWER_LANGUAGE["auto"]}' END
  || chr(10) || '<|user|>' || chr(10) || 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || query || '<|assistant|>' AS prompt FROM ctx JOIN qs USING (query_id)""")
def prompt_table(spark, sf):
    return EV.prompt_table(questions(spark, sf), contexts(spark, sf))


# Results of routes, derived from the turns of conversations: the turn is the route, its text the answer.
CONF = ["", " **Confidence**: High", " see section 4 **Confidence**: low", " the Act"]


def results(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.length("text")
    tail = F.element_at(F.array(*[F.lit(x) for x in CONF]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("route_ord"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("route"),
                    F.when(F.pmod(n, F.lit(5)) == 0, "success").otherwise("insufficient_evidence").alias("status"),
                    (F.pmod(n, F.lit(89)) / 100.0).alias("relevance"), F.concat("text", tail).alias("answer"))


_ACT = "contains(lower(answer),'section') OR contains(lower(answer),'rule') OR contains(lower(answer),'act') OR contains(lower(answer),'article')"
SQL_RES = f"""res AS (SELECT conv_id AS query_id, turn AS route_ord, 'r' || turn AS route, CASE WHEN length(text) % 5 = 0 THEN 'success' ELSE 'insufficient_evidence' END AS status,
  (length(text) % 89) / 100.0::DOUBLE AS relevance, text || {S._case(CONF, 'length(text) % 4')} AS answer FROM conversations),
rc0 AS (SELECT *, least(1.0, relevance + CASE WHEN {_ACT} THEN 0.1 ELSE 0 END) AS c0 FROM res),
rc AS (SELECT * EXCLUDE (c0), round(CASE WHEN length(answer) < 50 THEN greatest(0.0, c0 - 0.1) ELSE c0 END, 2) AS confidence FROM rc0)"""


@query("route_confidence", f"WITH {SQL_RES} SELECT query_id, route, confidence FROM rc")
def route_confidence(spark, sf):
    return EV.route_confidence(results(spark, sf)).select("query_id", "route", "confidence")


@query("answer_confidence", f"""WITH {SQL_RES}, m AS (SELECT query_id, avg(confidence) AS m, arg_min(answer, route_ord) AS answer FROM rc GROUP BY 1)
SELECT query_id, round(CASE lower(regexp_extract(answer, '(?i)\\*\\*Confidence\\*\\*:\\s*(High|Medium|Low)', 1)) WHEN 'high' THEN .9 WHEN 'medium' THEN .6 WHEN 'low' THEN .3 ELSE m END, 6) AS confidence FROM m""")
def answer_confidence(spark, sf):
    r = EV.route_confidence(results(spark, sf))
    combined = r.groupBy("query_id").agg(F.min_by("answer", "route_ord").alias("answer"))
    return EV.answer_confidence(combined, r).select("query_id", F.round("confidence", 6).alias("confidence"))


SQL_FINAL = f"""{SQL_RES}, fg AS (SELECT query_id, count_if(status = 'success') AS n, arg_min(route, route_ord) FILTER (status = 'success') AS sr, arg_min(confidence, route_ord) FILTER (status = 'success') AS sc FROM rc GROUP BY 1),
fb AS (SELECT * FROM (SELECT query_id, route, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, route_ord) AS rn FROM rc) WHERE rn = 1),
fin AS (SELECT query_id, CASE WHEN n = 0 THEN 'failed' WHEN n > 1 THEN 'combine' ELSE 'single' END AS outcome, n > 0 AS success, CASE WHEN n = 0 THEN route WHEN n = 1 THEN sr END AS route,
  CASE WHEN n = 0 THEN fb.confidence WHEN n = 1 THEN sc END AS confidence FROM fg JOIN fb USING (query_id))"""


@query("final_result", f"WITH {SQL_FINAL} SELECT query_id, outcome, success, coalesce(route, '') AS route, coalesce(confidence, -1) AS confidence FROM fin")
def final_result(spark, sf):
    f = EV.final_result(EV.route_confidence(results(spark, sf)))
    return f.select("query_id", "outcome", "success", F.coalesce("route", F.lit("")).alias("route"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))


@query("band", f"""WITH {SQL_RES} SELECT query_id, route, CASE WHEN confidence > .7 THEN 'high' WHEN confidence > .4 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN confidence > .7 AND status = 'success' THEN 'High' WHEN confidence > .4 AND confidence <= .7 THEN 'Medium' ELSE 'Low' END AS overall FROM rc""")
def band(spark, sf):
    r = EV.band(EV.route_confidence(results(spark, sf)))
    r = r.withColumns({"retrieval_band": F.col("band"), "success": F.col("status") == "success"})
    return EV.overall_band(r).select("query_id", "route", "band", "overall")
