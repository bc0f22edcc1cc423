"""Connected components of a table of links, by alternating stars.

In turn every node links its larger neighbours to its smallest one (large star) and its smaller ones, and
itself, to the smallest of them (small star). The links become stars around the smallest node of each
component after a number of turns that grows with the logarithm of the links. Links and labels stay
tables; each turn is written to the shared folder, so a lost executor costs one turn's read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import durable


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, a: str, b: str, most_turns: int = 60) -> DataFrame:
    """node, label: the smallest node that each node of ``links`` reaches; nodes without a link are not in it."""
    state = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    mark = None
    for _ in range(most_turns):
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if seen == mark:
            break
        mark = seen
        every = _both_ways(state)
        least = every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = every.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")) \
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct()
        state = durable(small)
    else:
        raise RuntimeError("links did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
