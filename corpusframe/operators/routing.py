"""Routing of queries to domains by weighted keywords. Row-local: rules are literals of the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import routes as RT
from corpusframe.functions import rules as R
from corpusframe.functions import text as X


def _add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def section_boost(low: Column, numbers) -> Column:
    """2, once, when any of the listed section numbers is written out."""
    named = F.rlike(low, F.lit(R.uni(r"section\s+\d+")))
    return F.when(named & X.any_of(low, [f"section {n}" for n in numbers]), 2).otherwise(0)


def route_points(low: Column, found: Column, route: RT.Route) -> Column:
    terms = [F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in route.single])))]
    if route.phrases and route.multi:
        terms.append(F.size(X.hits_in(low, route.multi)) * 2)
    terms += [F.when(F.rlike(low, F.lit(R.uni(p))), w).otherwise(0) for p, w in route.boosts]
    if route.section_numbers:
        terms.append(section_boost(low, route.section_numbers))
    return _add(terms)


def route_scores(queries: DataFrame, routes=RT.ROUTES, col: str = "query") -> DataFrame:
    """Adds ``scores``: array<struct<route, ord, score>> in route order, scores capped at 1."""
    staged = queries.withColumns({"__words": X.word_set(F.col(col)), "__low": F.lower(F.col(col))})
    scores = F.array(*[
        F.struct(F.lit(r.name).alias("route"), F.lit(i).alias("ord"),
                 F.least(F.lit(1.0), route_points(F.col("__low"), F.col("__words"), r) / r.scale).alias("score"))
        for i, r in enumerate(routes)])
    return staged.withColumn("scores", scores).drop("__words", "__low")


def ip_section_boost(queries: DataFrame, routes=RT.ROUTES, col: str = "query") -> DataFrame:
    numbers = next(r.section_numbers for r in routes if r.section_numbers)
    return queries.withColumn("section_boost", section_boost(F.lower(col), numbers))


def select_routes(scored: DataFrame, least: float = RT.MIN_SCORE, significant: float = RT.SIGNIFICANT, dominant: float = RT.DOMINANT) -> DataFrame:
    """Adds ``selected``: array<struct<route, score>> best first; ties keep the route order."""
    ranked = F.array_sort(F.transform("scores", lambda s: F.struct((-s["score"]).alias("neg"), s["ord"].alias("ord"), s["route"].alias("route"), s["score"].alias("score"))))
    staged = scored.withColumn("__r", ranked)
    above = lambda x: F.filter("__r", lambda s: s["score"] >= x)
    staged = staged.withColumns({"__e": above(least), "__s": above(significant)})
    top = F.col("__r")[0]["score"]
    alone = F.size(F.filter("__e", lambda s: s["score"] == F.col("__r")[0]["score"])) == 1
    chosen = (F.when(F.size("__e") == 0, F.slice("__r", 1, 1)).when(F.size("__s") > 1, F.col("__s"))
              .when((top >= dominant) & alone, F.slice("__r", 1, 1)).otherwise(F.col("__e")))
    out = staged.withColumn("selected", F.transform(chosen, lambda s: F.struct(s["route"].alias("route"), s["score"].alias("score"))))
    return out.drop("__r", "__e", "__s")


def routing(selected: DataFrame) -> DataFrame:
    """Adds primary route, whether several were chosen, and the reason text."""
    part = lambda s: F.format_string("%s(%.2f)", s["route"], F.bround(s["score"], 2))
    return selected.withColumns({
        "primary_route": F.col("selected")[0]["route"], "is_multi": F.size("selected") > 1,
        "reason": F.array_join(F.transform("selected", part), "; ")})


def routing_debug(selected: DataFrame, key: str = "query_id") -> DataFrame:
    """Score and selected flag of every route."""
    rows = selected.select(key, F.explode("scores").alias("s"), F.col("selected.route").alias("__names"))
    return rows.select(key, "s.route", "s.score", F.array_contains("__names", F.col("s.route")).alias("selected"))


def route_domains(spark, routes=RT.ROUTES) -> DataFrame:
    """Dimension table route → allowed domain; a route without rows sees all domains."""
    return spark.createDataFrame([(r.name, d) for r in routes for d in r.domains], "route string, domain string")


def routed_queries(selected: DataFrame, routes=RT.ROUTES) -> DataFrame:
    """One row per query and chosen route with the domains it may search (null: all)."""
    rows = selected.select(*[c for c in selected.columns if c not in ("selected", "scores")], F.posexplode("selected").alias("route_ord", "s"))
    allowed = reduce(lambda acc, r: acc.when(F.col("s.route") == r.name, F.array(*[F.lit(d) for d in r.domains])) if r.domains else acc,
                     routes, F.when(F.lit(False), F.lit(None).cast("array<string>")))
    return rows.select("*", F.col("s.route").alias("route"), F.col("s.score").alias("route_score"), allowed.alias("domains")).drop("s")


def routed_chunks(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Number of chunks every routed query may search, from the counts by domain."""
    counts = chunks.rollup("domain").agg(F.grouping("domain").alias("g"), F.count("*").alias("n")) \
        .select(F.when(F.col("g") == 1, F.lit("*")).otherwise(F.col("domain")).alias("domain"), "n")
    wanted = routed.select("query_id", "route", F.explode(F.coalesce("domains", F.array(F.lit("*")))).alias("domain"))
    return wanted.join(counts, "domain", "left").groupBy("query_id", "route").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("searchable"))
