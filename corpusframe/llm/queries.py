"""Registered queries of the operators: op1 to op13 and the pipeline, and the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusframe.llm import bpe, class_lm, decontaminate, html_extract, prefix_trie, quality_model, quality_rules, repeats, secrets, shingle_join, url_rules, warc, whitening
from corpusframe.llm.common import remainder, shared_folder, table

QUERIES = {}
ORACLES = {}

URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op2_url_filters", f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
urls AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM parts)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM urls""")
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} AS t(host, path, verdict)")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_SQL_LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_QUOTED = lambda x: x.replace("'", "''")
_R = quality_rules.Rules()
_SOLID = "length(translate({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))"
_MINUS = "(length({0}) - length(translate({0}, '{1}', '')))"


@query("op4_quality_rules", f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM base),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM twice GROUP BY r),
ln AS (SELECT r, i, l[i] AS line FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, string_split(text, chr(10)) AS l FROM base))),
lm AS (SELECT r, i, line, {_SOLID.format('line')} AS solid, len(regexp_extract_all(trim(line, ' '), '[\\x20\\x09-\\x0D]+')) + 1 AS n,
              row_number() OVER (PARTITION BY r, line ORDER BY i) AS seen FROM ln),
marks AS (SELECT *, {_MINUS.format('line', quality_rules.SYMBOLS)} AS symbols, {_MINUS.format('line', _QUOTED(quality_rules.MARKS))} AS marks, {_MINUS.format('line', '!')} AS shouts,
                 {_MINUS.format('line', '|»›•')} AS separators, length(line) - length(regexp_replace({_SQL_LOW}, '{_QUOTED(quality_rules.NOTICE)}', '', 'g')) AS noticed FROM lm WHERE solid > 0),
judged AS (SELECT *, (symbols >= {_R.min_symbols} AND symbols * 100 > solid * {_R.max_symbol_pct}) OR (marks >= {_R.min_marks} AND marks * 100 > solid * {_R.max_mark_pct})
                  OR (shouts > 0 AND shouts * 100 > n * {_R.max_shout_pct}) OR (separators >= {_R.min_separators} AND separators * 100 > n * {_R.max_separator_pct})
                  OR (length(line) <= {_R.max_notice_chars} AND noticed * 100 >= length(line) * {_R.min_notice_pct}) AS fails FROM marks),
lines AS (SELECT r, count(*) FILTER (seen > 1) AS n_dup_lines, coalesce(sum(solid) FILTER (seen > 1 OR fails), 0) AS lost_chars FROM judged GROUP BY r),
counted AS (SELECT doc_id, len(w) AS n_words, {_SOLID.format('text')} AS word_chars, {_MINUS.format('text', quality_rules.SYMBOLS)} AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
            FROM base JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
failed AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_pct} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars::BIGINT AS lost_chars, base_failed,
       NOT base_failed AND lost_chars * 100 <= word_chars * {_R.max_lost_pct} AS kept FROM failed""")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


@query("op5_secret_scans")
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, with_text=False).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, bpe.default_file(), ids=None).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_warc", r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.records_of(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("payload", "false").option("verify", "true").load(path)
    return read.select(warc.page_number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
                       warc.page_number("refers_to").alias("refers_to"))


@query("op1_quality_model")
def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit_on(docs, table(spark, sf_dir, "labels"), ~quality_model.held_out())
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_decontaminate", r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
grams AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
          FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, size, item_id FROM grams JOIN wins USING (size, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)""")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_shingle_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""")
def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_repeats")
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op8_class_lm")
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = class_lm.fit(docs.filter(~held_out))
    return class_lm.score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                                                      "base_score", "score")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query("op12_html_extract")
def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.fit_on(pages))


@query("op13_prefix_trie")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
