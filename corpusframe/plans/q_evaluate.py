"""Queries: evaluation, reports and request streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusframe.functions import text as X
from corpusframe.operators import evaluate as EL
from corpusframe.plans import statutes as S
from corpusframe.plans.q_normalise import SQL_CHUNKS, chunks
from corpusframe.plans.q_text import SQL_RESPONSES, SQL_SCRUB, responses
from corpusframe.plans.q_vectors import SQL_CORPUS, SQL_HITS, corpus, far
from corpusframe.plans.registry import query, table
from corpusframe.settings import shared_folder
from corpusframe.streaming import ingest
from corpusframe.streaming import requests as RQ

strip = S.sql_strip
SQL_EVAL = f"WITH {SQL_CORPUS}, {SQL_HITS(5)}, far AS (SELECT query_id, chunk_id, rank - 1 AS rank, score, c.label, c.language FROM hits JOIN corpus c USING (chunk_id) WHERE rank > 1), " \
    "qs AS (SELECT chunk_id AS query_id, label AS expected, language FROM corpus)"
SQL_MATCH = SQL_EVAL + ", mt AS (SELECT query_id, expected, " + ", ".join(f"coalesce(bool_or(label = expected AND rank <= {k}), false) AS hit_{k}" for k in (1, 3, 5)) + " FROM qs LEFT JOIN far USING (query_id) GROUP BY 1, 2)"
SQL_CROSS = ", cr AS (SELECT query_id, qs.language, coalesce(bool_or(far.language <> qs.language), false) AS is_cross_language FROM qs LEFT JOIN far USING (query_id) GROUP BY 1, 2)"


def expected(spark, sf):
    return corpus(spark, sf).select(F.col("chunk_id").alias("query_id"), F.col("label").alias("expected"), "language")


@query("hit_at_k", SQL_MATCH + """ SELECT count(*) AS queries, round(avg(hit_1::INT) * 100, 1) AS hit_at_1, round(avg(hit_3::INT) * 100, 1) AS hit_at_3, round(avg(hit_5::INT) * 100, 1) AS hit_at_5,
  round(avg(hit_5::INT) * 100, 1) AS recall_at_5 FROM mt""")
def hit_at_k(spark, sf):
    return EL.hit_at_k(expected(spark, sf).drop("language"), far(spark, sf))


@query("cross_language_rate", SQL_EVAL + SQL_CROSS + " SELECT count(*) AS queries, round(avg(is_cross_language::INT) * 100, 1) AS cross_language_rate FROM cr")
def cross_language_rate(spark, sf):
    return EL.cross_language_rate(expected(spark, sf), far(spark, sf))


@query("score_stats", SQL_EVAL + " SELECT round(avg(score), 4) AS mean, min(score) AS smallest, max(score) AS largest FROM far")
def score_stats(spark, sf):
    return EL.score_stats(far(spark, sf))


@query("per_domain_per_language", SQL_MATCH + SQL_CROSS + """, r AS (SELECT * FROM mt JOIN cr USING (query_id))
SELECT 'domain' AS dimension, expected || '' AS key, count(*) AS total, count_if(hit_5)::BIGINT AS matches, count_if(is_cross_language)::BIGINT AS cross_language, round(count_if(hit_5) / count(*) * 100, 1) AS precision FROM r GROUP BY expected
UNION ALL SELECT 'language', language, count(*), count_if(hit_5)::BIGINT, count_if(is_cross_language)::BIGINT, round(count_if(hit_5) / count(*) * 100, 1) FROM r GROUP BY language""")
def per_domain_per_language(spark, sf):
    e, h = expected(spark, sf), far(spark, sf)
    m = EL.matched(e.drop("language"), h).join(EL.crossed(e, h), "query_id")
    return EL.per_domain_per_language(m.select("expected", "language", F.col("hit_5").alias("match"), F.col("is_cross_language").alias("cross")))


def turns(spark, sf):
    """Questions with the answer that follows: the next turn of the conversation, by an equi-join."""
    c = table(spark, sf, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").join(a, ["conv_id", "turn"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))


SQL_TURNS = """turns AS (SELECT c.conv_id, c.turn, c.text, coalesce(a.text, '') AS answer FROM conversations c LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user')"""


@query("answer_eval", f"""WITH {SQL_TURNS}, r AS (SELECT conv_id % 5 <> 0 AS answerable, length(text) % 3 = 0 AS dm, CASE conv_id % 3 WHEN 0 THEN answer || ' Sources: x' WHEN 1 THEN 'I could not find sufficient data' ELSE answer END AS answer,
  CASE length(text) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN length(answer) % 4 = 0 THEN 'none' ELSE 'high' END AS rb, length(answer) % 3 AS sc,
  CASE conv_id % 2 WHEN 0 THEN 'mr' ELSE 'en' END AS ql, CASE conv_id % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'en' ELSE 'fr' END AS dl, length(text) AS t1, length(answer) AS t2 FROM turns)
SELECT count(*) AS total, count_if(answerable)::BIGINT AS answerable, count_if(answerable AND dm)::BIGINT AS domain_matches, round(count_if(answerable AND dm) / count_if(answerable) * 100, 1) AS domain_match_rate,
  count_if(contains(answer, 'Sources:'))::BIGINT AS with_citations, count_if(sc > 0)::BIGINT AS with_sources,
  count_if(NOT answerable AND (contains(lower(answer), 'could not find sufficient') OR contains(lower(answer), 'insufficient') OR confidence = 'low' OR rb = 'none'))::BIGINT AS correctly_refused,
  count_if(ql = dl OR (ql = 'mr' AND dl = 'hi'))::BIGINT AS language_correct, count_if(confidence = 'high')::BIGINT AS confidence_high, count_if(confidence = 'medium')::BIGINT AS confidence_medium, count_if(confidence = 'low')::BIGINT AS confidence_low,
  round(avg(t1), 1) AS mean_retrieval_ms, round(avg(t2), 1) AS mean_generation_ms, round(avg(t1 + t2), 1) AS mean_total_ms FROM r""")
def answer_eval(spark, sf):
    t = turns(spark, sf)
    m = lambda c, n: F.pmod(c, F.lit(n))
    n, a, i = F.length("text"), F.length("answer"), F.col("conv_id")
    r = t.select(
        (m(i, 5) != 0).alias("answerable"), (m(n, 3) == 0).alias("domain_match"),
        F.when(m(i, 3) == 0, F.concat("answer", F.lit(" Sources: x"))).when(m(i, 3) == 1, F.lit("I could not find sufficient data")).otherwise(F.col("answer")).alias("answer"),
        F.when(m(n, 3) == 0, "high").when(m(n, 3) == 1, "medium").otherwise("low").alias("confidence"), F.when(m(a, 4) == 0, "none").otherwise("high").alias("retrieval_band"),
        m(a, 3).alias("source_count"), F.when(m(i, 2) == 0, "mr").otherwise("en").alias("query_language"),
        F.when(m(i, 4) == 0, "hi").when(m(i, 4) == 1, "en").otherwise("fr").alias("detected_language"), n.alias("retrieval_ms"), a.alias("generation_ms"), (n + a).alias("total_ms"))
    return EL.answer_eval(r)


SQL_ROUTED = """ro AS (SELECT conv_id, list_distinct(list(CASE (conv_id + turn) % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'ip' ELSE 'tk' END)) AS used, CASE conv_id % 3 WHEN 0 THEN ['legal'] WHEN 1 THEN ['ip', 'tk'] ELSE ['abs', 'ip'] END AS exp FROM conversations GROUP BY 1)"""


def routed(spark, sf):
    c = table(spark, sf, "conversations")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    r = c.groupBy("conv_id").agg(F.collect_set(F.when(k == 0, "legal").when(k == 1, "ip").otherwise("tk")).alias("used_routes"))
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    j = F.pmod("conv_id", F.lit(3))
    return r.withColumn("expected_routes", F.when(j == 0, lit("legal")).when(j == 1, lit("ip", "tk")).otherwise(lit("abs", "ip")))


@query("routing_eval", f"WITH {SQL_ROUTED} SELECT conv_id, len(list_filter(exp, lambda e: NOT list_contains(used, e))) = 0 AS correct FROM ro")
def routing_eval(spark, sf):
    return EL.routing_eval(routed(spark, sf)).select("conv_id", "correct")


@query("routing_accuracy", f"""WITH {SQL_ROUTED}, c AS (SELECT exp, len(list_filter(exp, lambda e: NOT list_contains(used, e))) = 0 AS ok FROM ro)
SELECT count(*) AS queries, round(avg(ok::INT) * 100, 1) AS accuracy, count_if(len(exp) > 1)::BIGINT AS multi_queries, round(count_if(len(exp) > 1 AND ok) / count_if(len(exp) > 1) * 100, 1) AS multi_accuracy FROM c""")
def routing_accuracy(spark, sf):
    return EL.routing_accuracy(routed(spark, sf))


@query("e2e_eval", f"""WITH {SQL_TURNS}, r AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 500 ELSE 200 END AS status, turn % 4 AS sources, CASE WHEN conv_id % 3 = 0 THEN 'I could not find it' ELSE answer END AS answer,
  conv_id % 5 AS m, CASE conv_id % 2 WHEN 0 THEN 'hi' ELSE 'en' END AS lang, CASE conv_id % 4 WHEN 0 THEN 'hi' ELSE 'en' END AS alang FROM turns),
x AS (SELECT *, {strip('answer')} <> '' AND NOT contains(lower(answer), 'could not find') AS answered, m IN (0, 1, 2) AS rc FROM r)
SELECT conv_id, turn, answered, rc AS routing_correct, alang = lang OR (alang = 'en' AND NOT answered) AS language_match, status = 200 AND sources > 0 AND rc AND (alang = lang OR (alang = 'en' AND NOT answered)) AS passed FROM x""")
def e2e_eval(spark, sf):
    m = lambda c, n: F.pmod(c, F.lit(n))
    i = F.col("conv_id")
    r = turns(spark, sf).select(
        "conv_id", "turn", F.when(m(i, 7) == 0, 500).otherwise(200).alias("status"), F.lit(True).alias("success"), m("turn", 4).alias("sources"),
        F.when(m(i, 3) == 0, F.lit("I could not find it")).otherwise(F.col("answer")).alias("answer"), F.lit("ip").alias("expected_route"),
        F.when(m(i, 5) <= 1, F.array(F.lit("legal"), F.lit("ip"))).otherwise(F.array(F.lit("tk"))).alias("routes"),
        F.when(m(i, 5) == 2, F.lit("IP(0.50)")).otherwise(F.lit("tk(0.40)")).alias("reason"),
        F.when(m(i, 2) == 0, "hi").otherwise("en").alias("language"), F.when(m(i, 4) == 0, "hi").otherwise("en").alias("answer_language"))
    return EL.e2e_eval(r).select("conv_id", "turn", "answered", "routing_correct", "language_match", "passed")


@query("latency_report", """SELECT 'mean_value' AS measure, round(avg(value), 6) AS value FROM events UNION ALL SELECT 'mean_other', round(avg(user_id), 6) FROM events
UNION ALL SELECT 'median_value', round(quantile_cont(value, 0.5), 6) FROM events UNION ALL SELECT 'p95_value', round(quantile_cont(value, 0.95), 6) FROM events""")
def latency_report(spark, sf):
    e = table(spark, sf, "events").select("value", F.col("user_id").alias("other"))
    return EL.latency_report(e, ["other"], "value").withColumn("value", F.round("value", 6))


@query("corpus_report", "WITH " + SQL_CHUNKS + ", c AS (SELECT *, CASE WHEN document_type = 'Rules' THEN section_number ELSE '' END AS rn FROM chunks)" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {k} AS key, count(DISTINCT document) AS documents, count(*) AS chunks, count_if(section_number <> '')::BIGINT AS with_section, count_if(rn <> '')::BIGINT AS with_rule, count_if(len(source_pages) > 0)::BIGINT AS with_pages, count_if(text <> '')::BIGINT AS with_text FROM c {g}"
    for d, k, g in (("language", "language", "GROUP BY language"), ("domain", "domain", "GROUP BY domain"), ("document_type", "document_type", "GROUP BY document_type"), ("total", "'all'", ""))))
def corpus_report(spark, sf):
    c = chunks(spark, sf).withColumn("rule_number", F.when(F.col("document_type") == "Rules", F.col("section_number")))
    return EL.corpus_report(c)


def report(spark, sf):
    return EL.pipeline_report(S.documents(spark, sf), {"pages": S.raw_pages(spark, sf), "sections": S.sections(spark, sf), "chunks": chunks(spark, sf)})


SQL_REPORT = SQL_CHUNKS + """, rp AS (SELECT doc_id, coalesce(p, 0)::BIGINT AS pages, coalesce(s, 0)::BIGINT AS sections, coalesce(c, 0)::BIGINT AS chunks, CASE WHEN c > 0 THEN 'completed' ELSE 'failed' END AS status FROM docs
  LEFT JOIN (SELECT doc_id, count(*) AS p FROM raw_pages GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS s FROM sections_s GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM chunks GROUP BY 1) USING (doc_id))"""


@query("pipeline_report", "WITH " + SQL_REPORT + " SELECT * FROM rp")
def pipeline_report(spark, sf):
    return report(spark, sf)


@query("pipeline_totals", "WITH " + SQL_REPORT + """ SELECT count(*) AS total_documents, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed,
  sum(pages) FILTER (status = 'completed')::BIGINT AS total_pages, sum(sections) FILTER (status = 'completed')::BIGINT AS total_sections, sum(chunks) FILTER (status = 'completed')::BIGINT AS total_chunks FROM rp""")
def pipeline_totals(spark, sf):
    return EL.pipeline_totals(report(spark, sf), ["pages", "sections", "chunks"])


@query("response_defects", f"""WITH {SQL_RESPONSES}, x AS (SELECT CASE conv_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'so: [Answer] ' || text WHEN 2 THEN '**Answer**:' ELSE text END AS raw FROM responses), y AS (SELECT raw, {SQL_SCRUB('raw')} AS clean FROM x)
SELECT count(*) AS responses, count_if({strip('raw')} = '')::BIGINT AS empty, count_if(contains(lower(clean), '[answer]') OR {strip('clean')} IN ('**Answer**', '**Answer**:'))::BIGINT AS placeholder,
  count_if(contains(raw, '<|think|>') OR contains(raw, '<|reasoning|>') OR contains(raw, 'Thinking...'))::BIGINT AS leaked_reasoning, count_if(clean = '')::BIGINT AS failed FROM y""")
def response_defects(spark, sf):
    k = F.pmod("conv_id", F.lit(6))
    r = responses(spark, sf).withColumn("text", F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("so: [Answer] "), "text")).when(k == 2, F.lit("**Answer**:")).otherwise(F.col("text")))
    return EL.response_defects(r)


# ------------------------------------------------------------------------------------ streams

DAY = 24 * 3600
LIMIT = 3


def requests(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("client"), "event_type", "value")


def spelled(df):
    """Window bounds as text, which both engines write alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


SQL_LIMIT = f"""ev AS (SELECT event_id, user_id AS client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
rl AS (SELECT event_id, client, t, rn, true AS accepted, [t] AS live FROM ev WHERE rn = 1
  UNION ALL SELECT e.event_id, e.client, e.t, e.rn, len(list_filter(r.live, lambda x: x > e.t - {DAY * 1_000_000})) < {LIMIT},
    CASE WHEN len(list_filter(r.live, lambda x: x > e.t - {DAY * 1_000_000})) < {LIMIT} THEN list_append(list_filter(r.live, lambda x: x > e.t - {DAY * 1_000_000}), e.t) ELSE list_filter(r.live, lambda x: x > e.t - {DAY * 1_000_000}) END
  FROM rl r JOIN ev e ON e.client = r.client AND e.rn = r.rn + 1)"""


@query("rate_limit", f"WITH RECURSIVE {SQL_LIMIT} SELECT event_id, client, accepted FROM rl")
def rate_limit(spark, sf):
    return RQ.rate_limit(requests(spark, sf), LIMIT, DAY).select("event_id", "client", "accepted")


@query("arrivals_over", f"""SELECT event_id, user_id AS client, count(*) OVER w AS arrivals, count(*) OVER w > {LIMIT} AS over_limit FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY * 1_000_000} PRECEDING AND CURRENT ROW)""")
def arrivals_over(spark, sf):
    return RQ.arrivals_over(requests(spark, sf), LIMIT, DAY).select("event_id", "client", "arrivals", "over_limit")


@query("breach_monitor", f"""WITH s AS (SELECT user_id AS client, unnest([0, 1, 2, 3]) AS k, ts FROM events), w AS (SELECT client, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM s)
SELECT client, start::VARCHAR AS start, (start + INTERVAL 24 HOUR)::VARCHAR AS "end", count(*) AS arrivals FROM w GROUP BY client, w.start HAVING count(*) > {LIMIT}""")
def breach_monitor(spark, sf):
    return spelled(RQ.breach_monitor(requests(spark, sf), LIMIT, "24 hours", "6 hours", "1 hour"))


SQL_METRICS = """m AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS requests, round(avg(value), 6) AS mean_latency, max(value) AS max_latency FROM events GROUP BY ALL)"""


@query("request_metrics", f'WITH {SQL_METRICS} SELECT start::VARCHAR AS start, (start + INTERVAL 6 HOUR)::VARCHAR AS "end", event_type, requests, mean_latency, max_latency FROM m')
def request_metrics(spark, sf):
    m = RQ.request_metrics(requests(spark, sf), "6 hours", "1 hour", ["event_type"], "value")
    return spelled(m.withColumn("mean_latency", F.round("mean_latency", 6)))


def event_stream(spark, sf):
    """The events as files of a stream, and last a row of no client a day later: it lets the watermark pass every event."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"), "event_type", "value")
    e.write.parquet(path)
    last = e.agg(F.max("ts").alias("__end")).select(*[(F.col("__end") + F.expr("INTERVAL 1 DAY") if f.name == "ts" else F.lit(-1 if f.name == "event_id" else None).cast(f.dataType)).alias(f.name) for f in e.schema])
    last.write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).parquet(path)


def drained(stream, spark):
    """Run a stream to its end into the shared folder and return what it wrote."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


@query("stream_request_metrics", f"""WITH {SQL_METRICS} SELECT start::VARCHAR AS start, (start + INTERVAL 6 HOUR)::VARCHAR AS "end", event_type, requests, mean_latency, max_latency FROM m""")
def stream_request_metrics(spark, sf):
    """The same metrics from the stream, every window."""
    m = RQ.request_metrics(event_stream(spark, sf), "6 hours", "1 hour", ["event_type"], "value")
    done = drained(m, spark).withColumn("mean_latency", F.round("mean_latency", 6))
    return spelled(done)


@query("stream_rate_limit", f"""WITH RECURSIVE {SQL_LIMIT} SELECT event_id, client, accepted FROM rl""")
def stream_rate_limit(spark, sf):
    """The same decisions from the stream, every request."""
    return drained(RQ.rate_limit_stream(event_stream(spark, sf), LIMIT, DAY, "1 hour"), spark).select("event_id", "client", "accepted")


NO_TEXT = "no text"


@query("stream_ingest", "SELECT md5(text) AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def stream_ingest(spark, sf):
    """Documents arriving as files; copies of a stored text are left out."""
    path = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema = table(spark, sf, "documents").schema
    # a pattern, as a stream's plain path has to be a folder; the table may be one file or a folder of files
    s = spark.readStream.schema(schema).parquet(f"{sf}/[d]ocuments.parquet")
    # an ingest leaves rows without an id out; documents without a text are copies of each other too
    chunks = s.select(F.coalesce(F.md5("text"), F.lit(NO_TEXT)).alias("chunk_id"), "doc_id", "text")
    ingest.ingest_stream(chunks, f"{path}/data", f"{path}/state", ["doc_id"]).awaitTermination()
    return ingest.stored(spark, f"{path}/data", chunks.schema).select(F.nullif("chunk_id", F.lit(NO_TEXT)).alias("chunk_id"), "doc_id")
