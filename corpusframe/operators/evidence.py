"""Evidence for answers: relevance, decision, de-duplication, context, citations, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.functions import text as X

# Fixed value: the answer when nothing was found.
NO_EVIDENCE = "No relevant legal provisions found in the knowledge base."
SCORE_WEIGHT, OVERLAP_WEIGHT = 0.7, 0.3
MAX_CONTEXT, MIN_REMAINDER = 8000, 200

# Language of an answer by query language; ``auto`` for the rest.
ANSWER_LANGUAGE = {"en": "Answer in English.", "auto": "Answer in English. (Internal reasoning language is English)"}
SYSTEM_TEXT = ("Answer only from the sources below. When they are not enough, say that you could not find sufficient supporting "
               "information. Give **Answer**, **Sources** and **Confidence** (High, Medium or Low).")


def relevance(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """0.7 × top score + 0.3 × share of the query's words found in the top text, at most 1."""
    top = hits.filter(F.col("rank") == 1).select("query_id", "score", "text")
    qw, tw = F.array_distinct(X.words(F.lower("query"))), F.array_distinct(X.words(F.lower("text")))
    share = F.size(F.array_intersect(qw, tw)) / F.greatest(F.size(qw), F.lit(1))
    return queries.join(top, "query_id").select(
        "query_id", F.least(F.lit(1.0), F.col("score") * SCORE_WEIGHT + share * OVERLAP_WEIGHT).alias("relevance"))


def decide(queries: DataFrame, relevances: DataFrame, least: float = R.MIN_RELEVANCE) -> DataFrame:
    j = queries.select("query_id").join(relevances, "query_id", "left")
    r = F.col("relevance")
    return j.select("query_id", F.coalesce(r, F.lit(0.0)).alias("relevance"),
                    F.when(r.isNull() | (r < least), F.lit("insufficient_evidence")).otherwise(F.lit("sufficient")).alias("status"),
                    F.when(r.isNull(), F.lit("No evidence retrieved")).when(r < least, F.lit("Evidence relevance too low")).alias("error"))


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """First row per chunk in route order; without an id the first 200 characters stand for the chunk."""
    key = F.coalesce(F.nullif(F.col("chunk_id").cast("string"), F.lit("")), F.concat(F.lit("text:"), F.substring("text", 1, 200)))
    w = W.partitionBy("query_id", "__k").orderBy("route_ord", "rank")
    return evidence.withColumn("__k", key).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__k", "__rn")


def _year(c: str = "document_year") -> Column:
    return F.when(F.coalesce(c, F.lit(0)) != 0, F.concat(F.lit(" ("), F.col(c).cast("string"), F.lit(")"))).otherwise(F.lit(""))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _numbered(word: str, number: str, title: str) -> Column:
    tail = F.when(_given(title), F.concat(F.lit(" — "), title)).otherwise(F.lit(""))
    return F.concat(F.lit(word), number, tail)


def _pages(prefix: str) -> Column:
    return F.when(F.size("source_pages") > 0, F.concat(F.lit(prefix), F.array_join(F.col("source_pages").cast("array<string>"), ", ")))


def source_block(hits: DataFrame) -> DataFrame:
    """Adds ``block``: the numbered source text put before a model."""
    text = X.strip(F.coalesce("text", F.lit("")))
    refs = F.transform(F.slice("cross_references", 1, 5), lambda r: r["reference_text"])
    place = (F.when(_given("section_number"), _numbered("Section: ", "section_number", "section_title"))
             .when(_given("rule_number"), _numbered("Rule: ", "rule_number", "rule_title"))
             .otherwise(F.lit("Section/Rule: Information unavailable in retrieved metadata")))
    lines = [
        F.concat(F.lit("SOURCE "), F.col("rank").cast("string")), F.concat(F.lit("Document: "), F.col("document"), _year()),
        F.concat(F.lit("Type: "), "document_type"), F.when(_given("domain"), F.concat(F.lit("Domain: "), "domain")),
        F.when(_given("language"), F.concat(F.lit("Language: "), "language")), place, _pages("Pages: "),
        F.concat(F.lit("Relevance Score: "), F.format_string("%.4f", "score")),
        F.when(F.size("keywords") > 0, F.concat(F.lit("Keywords: "), F.array_join(F.slice("keywords", 1, 8), ", "))),
        F.when(F.size("cross_references") > 0, F.concat(F.lit("Cross-references: "), F.array_join(refs, ", "))),
        F.lit(""), F.when(text != "", text).otherwise(F.lit("[No text content available]"))]
    return hits.withColumn("block", F.concat_ws("\n", *lines))


def source_block_short(hits: DataFrame) -> DataFrame:
    """The shorter form used when several routes contribute."""
    year = F.coalesce(F.col("document_year").cast("string"), F.lit(""))
    lines = [
        F.concat(F.lit("SOURCE "), F.col("rank").cast("string")), F.concat(F.lit("Document: "), "document", F.lit(" ("), year, F.lit(")")),
        F.when(_given("section_number"), F.concat(F.lit("Section: "), "section_number", F.lit(" - "), F.coalesce("section_title", F.lit("")))),
        F.when(_given("rule_number"), F.concat(F.lit("Rule: "), "rule_number", F.lit(" - "), F.coalesce("rule_title", F.lit("")))),
        _pages("Pages: "), F.concat(F.lit("Text: "), F.coalesce("text", F.lit("")))]
    return hits.withColumn("block", F.concat_ws("\n", *lines))


def context(queries: DataFrame, blocks: DataFrame, max_chars: int = MAX_CONTEXT) -> DataFrame:
    """Blocks in rank order while they fit; the first that does not is cut if enough room is left."""
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    # of a block no more than the context can hold has to move
    b = blocks.select("query_id", "rank", F.substring("block", 1, max_chars).alias("block"), F.length("block").alias("__n")).withColumn("__sum", F.sum("__n").over(w))
    before = F.col("__sum") - F.col("__n")
    room = F.lit(max_chars) - before
    cut = F.concat(F.expr(f"substring(block, 1, cast({max_chars} - (__sum - __n) as int))"), F.lit("\n[TRUNCATED]"))
    piece = F.when(F.col("__sum") <= max_chars, F.col("block")).when((room > MIN_REMAINDER), cut)
    kept = b.filter(before <= max_chars).withColumn("piece", piece).filter("piece IS NOT NULL")
    # only the first overflowing block may be cut: every later one starts beyond the limit
    g = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("r"))
    g = g.select("query_id", F.size("r").alias("n_sources"), F.array_join("r.piece", "\n\n").alias("body"))
    found = blocks.select("query_id").distinct()
    j = queries.select("query_id").join(g, "query_id", "left").join(found.withColumn("__any", F.lit(True)), "query_id", "left")
    n = F.coalesce("n_sources", F.lit(0))
    text = F.concat(F.lit("RETRIEVED LEGAL SOURCES ("), n.cast("string"), F.lit(" sources):\n"), F.coalesce("body", F.lit("")))
    return j.select("query_id", n.alias("n_sources"), F.when(F.col("__any"), text).otherwise(F.lit(NO_EVIDENCE)).alias("context"))


def source_list(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "document", "document_type", "document_year", "section_number", "section_title", "rule_number",
                       "rule_title", "source_pages", "score", "language", "domain")


def citations(hits: DataFrame) -> DataFrame:
    """Numbered citation lines of a query as one text."""
    place = (F.when(_given("section_number"), _numbered("Section ", "section_number", "section_title"))
             .when(_given("rule_number"), _numbered("Rule ", "rule_number", "rule_title"))
             .otherwise(F.lit("Section/Rule information unavailable in retrieved metadata")))
    line = F.concat_ws(" | ", F.concat(F.coalesce("document", F.lit("Unknown Document")), _year()), place, _pages("Pages "))
    g = hits.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("r"))
    numbered = F.transform("r", lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s["line"]))
    return g.select("query_id", F.concat(F.lit("Sources:\n"), F.array_join(numbered, "\n")).alias("citations"))


def prompt_table(queries: DataFrame, contexts: DataFrame, system: str = SYSTEM_TEXT, languages=ANSWER_LANGUAGE) -> DataFrame:
    """One prompt per query; ``queries`` has query_id, query, language."""
    line = F.lit(languages["auto"])
    for code, text in languages.items():
        if code != "auto":
            line = F.when(F.col("language") == code, F.lit(text)).otherwise(line)
    prompt = F.concat(F.lit(f"<|system|>\n{system}\n\n"), line, F.lit("\n<|user|>\nCONTEXT:\n"), "context", F.lit("\n\nQUESTION: "), "query", F.lit("<|assistant|>"))
    return queries.join(contexts, "query_id").select("query_id", prompt.alias("prompt"))


def route_confidence(responses: DataFrame) -> DataFrame:
    """Relevance adjusted by what the answer looks like, two digits."""
    low = F.lower("answer")
    c = F.col("relevance") + F.when(X.any_of(low, ["section", "rule", "act", "article"]), 0.1).otherwise(0.0)
    c = F.least(F.lit(1.0), c)
    c = F.when(F.length("answer") < 50, F.greatest(F.lit(0.0), c - 0.1)).otherwise(c)
    empty = F.coalesce("answer", F.lit("")) == ""
    return responses.withColumn("confidence", F.round(F.when(empty, F.col("relevance")).otherwise(c), 2))


def answer_confidence(combined: DataFrame, responses: DataFrame) -> DataFrame:
    """Confidence of a combined answer: the level it states, else the mean of its routes, else 0.5."""
    stated = F.lower(F.regexp_extract("answer", R.uni(r"(?i)\*\*Confidence\*\*:\s*(High|Medium|Low)"), 1))
    mean = responses.groupBy("query_id").agg(F.avg("confidence").alias("__mean"))
    level = F.when(stated == "high", 0.9).when(stated == "medium", 0.6).when(stated == "low", 0.3)
    return combined.join(mean, "query_id", "left").withColumn("confidence", F.coalesce(level, "__mean", F.lit(0.5))).drop("__mean")


def final_result(results: DataFrame) -> DataFrame:
    """Per query: the only success, ``combine`` for several, else the most confident attempt.

    ``results``: query_id, route, route_ord, status, confidence, answer.
    """
    ok = F.col("status") == "success"
    row = F.struct("route", "status", "confidence", "answer")
    g = results.groupBy("query_id").agg(
        F.count_if(ok).alias("n_success"), F.max_by(row, F.when(ok, -F.col("route_ord"))).alias("s"),
        F.max_by(row, F.struct("confidence", -F.col("route_ord"))).alias("b"))
    many, none = F.col("n_success") > 1, F.col("n_success") == 0
    return g.select(
        "query_id", F.when(none, "failed").when(many, "combine").otherwise("single").alias("outcome"), (~none).alias("success"),
        F.when(none, F.col("b.route")).when(~many, F.col("s.route")).alias("route"),
        F.when(none, F.col("b.confidence")).when(~many, F.col("s.confidence")).alias("confidence"),
        F.when(none & (F.coalesce("b.answer", F.lit("")) == ""), F.lit("I could not find sufficient supporting information in the available legal knowledge base."))
        .when(none, F.col("b.answer")).when(~many, F.col("s.answer")).alias("answer"))


def band(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    return df.withColumn("band", F.when(c > 0.7, "high").when(c > 0.4, "medium").otherwise("low"))


def overall_band(df: DataFrame) -> DataFrame:
    """The band of the single-route path: retrieval band and success."""
    r = F.col("retrieval_band")
    return df.withColumn("overall", F.when((r == "high") & F.col("success"), "High").when(r == "medium", "Medium").otherwise("Low"))
