"""Evaluation of retrieval, routing and answers, and the reports over a corpus build."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import text as X
from corpusframe.settings import durable

REFUSALS = ["could not find sufficient", "insufficient"]


def percent(flag: Column, digits: int = 1) -> Column:
    return F.round(F.avg(F.coalesce(flag, F.lit(False)).cast("int")) * 100, digits)


def matched(expected: DataFrame, hits: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Per query: is the expected label among the first k hits (``hit_k``); no hits is a miss."""
    j = expected.join(hits.select("query_id", "rank", "label"), "query_id", "left")
    same = F.col("label") == F.col("expected")
    return j.groupBy("query_id", "expected").agg(
        *[F.coalesce(F.bool_or(same & (F.col("rank") <= k)), F.lit(False)).alias(f"hit_{k}") for k in ks])


def hit_at_k(expected: DataFrame, hits: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    m = matched(expected, hits, ks)
    return m.agg(F.count("*").alias("queries"), *[percent(F.col(f"hit_{k}")).alias(f"hit_at_{k}") for k in ks],
                 percent(F.col(f"hit_{max(ks)}")).alias(f"recall_at_{max(ks)}"))


def crossed(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: does any hit have another language than the query."""
    h = hits.select("query_id", F.col("language").alias("__l")).filter("__l <> 'MISSING'")
    return queries.select("query_id", "language").join(h, "query_id", "left").groupBy("query_id", "language").agg(
        F.coalesce(F.bool_or(F.col("__l") != F.col("language")), F.lit(False)).alias("is_cross_language"))


def cross_language_rate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return crossed(queries, hits).agg(F.count("*").alias("queries"), percent(F.col("is_cross_language")).alias("cross_language_rate"))


def score_stats(hits: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 4)
    return hits.agg(r(F.avg("score")).alias("mean"), r(F.min("score")).alias("smallest"), r(F.max("score")).alias("largest"))


def per_domain_per_language(results: DataFrame) -> DataFrame:
    """Counts by expected domain and by query language: ``results`` has expected, language, match, cross."""
    g = results.groupingSets([["expected"], ["language"]], "expected", "language").agg(
        F.grouping_id().alias("g"), F.count("*").alias("total"), F.count_if("match").alias("matches"), F.count_if("cross").alias("cross_language"))
    return g.select(F.when(F.col("g") == 1, "domain").otherwise("language").alias("dimension"),
                    F.coalesce(F.col("expected").cast("string"), "language").alias("key"), "total", "matches", "cross_language",
                    F.round(F.col("matches") / F.col("total") * 100, 1).alias("precision"))


def refused(answer: Column, confidence: Column, retrieval: Column) -> Column:
    return X.any_of(F.lower(answer), REFUSALS) | (confidence == "low") | (retrieval == "none")


def answer_eval(results: DataFrame) -> DataFrame:
    """Summary of answered queries.

    ``results``: answerable, domain_match, answer, confidence, retrieval_band, source_count,
    query_language, detected_language, retrieval_ms, generation_ms, total_ms.
    """
    lang = (F.col("query_language") == F.col("detected_language")) | ((F.col("query_language") == "mr") & (F.col("detected_language") == "hi"))
    ok = F.col("answerable")
    no = ~ok
    return results.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("answerable"), F.count_if(ok & F.col("domain_match")).alias("domain_matches"),
        F.round(F.try_divide(F.count_if(ok & F.col("domain_match")), F.count_if(ok)) * 100, 1).alias("domain_match_rate"),
        F.count_if(F.contains("answer", F.lit("Sources:"))).alias("with_citations"), F.count_if(F.col("source_count") > 0).alias("with_sources"),
        F.count_if(no & refused(F.col("answer"), F.col("confidence"), F.col("retrieval_band"))).alias("correctly_refused"),
        F.count_if(lang).alias("language_correct"), *[F.count_if(F.lower("confidence") == c).alias(f"confidence_{c}") for c in ("high", "medium", "low")],
        *[F.round(F.avg(f"{s}_ms"), 1).alias(f"mean_{s}_ms") for s in ("retrieval", "generation", "total")])


def routing_eval(results: DataFrame) -> DataFrame:
    """``correct``: every expected route was used; an empty expectation is always met."""
    return results.withColumn("correct", F.size(F.array_except("expected_routes", "used_routes")) == 0)


def routing_accuracy(results: DataFrame) -> DataFrame:
    r = routing_eval(results)
    several = F.size("expected_routes") > 1
    return r.agg(F.count("*").alias("queries"), percent(F.col("correct")).alias("accuracy"), F.count_if(several).alias("multi_queries"),
                 F.round(F.try_divide(F.count_if(several & F.col("correct")), F.count_if(several)) * 100, 1).alias("multi_accuracy"))


def e2e_eval(results: DataFrame) -> DataFrame:
    """``passed`` of a request: status, success, sources, routing and language all in order.

    ``results``: status, success, sources, expected_route, routes, reason, language, answer_language, answer.
    """
    answered = ~X.is_blank(F.col("answer")) & ~F.contains(F.lower("answer"), F.lit("could not find"))
    routed = F.array_contains("routes", F.col("expected_route")) | F.contains(F.lower("reason"), F.col("expected_route"))
    lang = (F.col("answer_language") == F.col("language")) | ((F.col("answer_language") == "en") & ~answered)
    return results.withColumns({
        "answered": answered, "routing_correct": routed, "language_match": lang,
        "passed": (F.col("status") == 200) & F.col("success") & (F.col("sources") > 0) & routed & lang})


#: Distinct values that are ordered in one place, and parts into which a longer range is split.
FEW, WAYS = 4096, 256


def exact_percentiles(df: DataFrame, col: str, qs, few: int = FEW, ways: int = WAYS) -> DataFrame:
    """(q, value): exact interpolated percentiles without one task ordering all values.

    Equal values are counted first. The range that holds a rank is split at approximate quantiles of its distinct
    values, its parts are counted exactly, and the part with the rank is split again, until it has at most ``few`` distinct
    values, which are read in order. Splits follow the values and not the width of the range, so one far value costs
    nothing. Null and NaN are no values; without values the percentiles are null.
    """
    from pyspark.ml.feature import Bucketizer
    spark = df.sparkSession
    counted = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    v = durable(counted)
    edge = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"), F.count("*").alias("size")).head()
    if edge.n is None:
        return spark.createDataFrame([(float(q), None) for q in qs], "q double, value double")
    ranks = {r for q in qs for r in (int((edge.n - 1) * q), min(int((edge.n - 1) * q) + 1, edge.n - 1))}
    held = {r: (edge.lo, edge.hi, 0, edge.size) for r in ranks}
    while any(h[3] > few for h in held.values()):
        for part in {h for h in held.values() if h[3] > few}:
            inside = v.filter(F.col("v").between(part[0], part[1]))
            cuts = sorted(set(inside.agg(F.percentile_approx("v", [i / ways for i in range(1, ways)], 50 * ways)).head()[0]) | {part[1]})
            split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="v", outputCol="b").transform(inside)
            before, found = part[2], []
            for r in split.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"), F.count("*").alias("size")).orderBy("b").collect():
                found.append((before, before + r["n"], (r["lo"], r["hi"], before, r["size"])))
                before += r["n"]
            for rank in [r for r, h in held.items() if h == part]:
                held[rank] = next(h for a, b, h in found if a <= rank < b)
    at = {}
    for part in set(held.values()):
        upto = part[2]
        rows = v.filter(F.col("v").between(part[0], part[1])).collect()
        for value, n in sorted((r["v"], r["n"]) for r in rows):
            at.update({rank: value for rank, h in held.items() if h == part and upto <= rank < upto + n})
            upto += n
    places = [(float(q), int((edge.n - 1) * q), (edge.n - 1) * q % 1.0) for q in qs]
    value = lambda p, f: at[p] + ((at[min(p + 1, edge.n - 1)] - at[p]) * f if f else 0.0)
    return spark.createDataFrame([(q, value(p, f)) for q, p, f in places], "q double, value double")


def latency_report(log: DataFrame, stages: list[str], total: str = "total_ms") -> DataFrame:
    """Mean, median and 95th percentile of the total, and the mean of every stage, as rows."""
    means = log.agg(*[F.avg(c).alias(c) for c in [total, *stages]])
    rows = means.select(F.inline(F.array(*[F.struct(F.lit(f"mean_{c}").alias("measure"), F.col(c).alias("value")) for c in [total, *stages]])))
    q = exact_percentiles(log, total, [0.5, 0.95])
    named = q.select(F.when(F.col("q") == 0.5, F.lit(f"median_{total}")).otherwise(F.lit(f"p95_{total}")).alias("measure"), "value")
    return rows.unionByName(named)


def corpus_report(chunks: DataFrame) -> DataFrame:
    """Chunks by language, domain and type, and how many carry a section, rule, pages, text; long form."""
    c = chunks.select("language", "domain", "document_type", "document", "section_number", "rule_number", "source_pages", "text")
    given = lambda n: F.count_if(F.coalesce(n, F.lit("")) != "")
    g = c.groupingSets([["language"], ["domain"], ["document_type"], []], "language", "domain", "document_type").agg(
        F.grouping_id().alias("g"), F.count("*").alias("chunks"), F.count_distinct("document").alias("documents"), given("section_number").alias("with_section"),
        given("rule_number").alias("with_rule"), F.count_if(F.size("source_pages") > 0).alias("with_pages"), given("text").alias("with_text"))
    return g.select(F.when(F.col("g") == 3, "language").when(F.col("g") == 5, "domain").when(F.col("g") == 6, "document_type").otherwise("total").alias("dimension"),
                    F.coalesce("language", "domain", "document_type", F.lit("all")).alias("key"), "documents", "chunks", "with_section", "with_rule", "with_pages", "with_text")


def pipeline_report(documents: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Per document the row counts after every stage; ``completed`` when the last stage has rows."""
    j = documents.select("doc_id")
    for name, df in stages.items():
        j = j.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    j = j.withColumns({n: F.coalesce(n, F.lit(0)) for n in stages})
    last = list(stages)[-1]
    return j.withColumn("status", F.when(F.col(last) > 0, "completed").otherwise("failed"))


def pipeline_totals(report: DataFrame, stages: list[str]) -> DataFrame:
    ok = F.col("status") == "completed"
    return report.agg(F.count("*").alias("total_documents"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"),
                      *[F.coalesce(F.sum(F.when(ok, F.col(s))), F.lit(0)).alias(f"total_{s}") for s in stages])


def response_defects(responses: DataFrame, col: str = "text") -> DataFrame:
    """Empty, placeholder, leaking and failed responses; the text is scrubbed first."""
    raw = F.coalesce(col, F.lit(""))
    r = responses.select(raw.alias("raw"), X.scrub(raw).alias("clean"))
    leak = reduce(lambda a, b: a | b, [F.contains("raw", F.lit(t)) for t in ("<|think|>", "<|reasoning|>", "Thinking...")])
    return r.agg(F.count("*").alias("responses"), F.count_if(X.is_blank(F.col("raw"))).alias("empty"),
                 F.count_if(F.contains(F.lower("clean"), F.lit("[answer]")) | F.rlike(X.strip(F.col("clean")), F.lit(r"\A\*\*Answer\*\*:?\z"))).alias("placeholder"),
                 F.count_if(leak).alias("leaked_reasoning"), F.count_if(F.col("clean") == "").alias("failed"))
