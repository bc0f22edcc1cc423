"""URL filters by a sorted sweep over reversed-host keys.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the
rule's path. With the host's labels reversed, ``example.com/en/`` is the key ``com.example/en/`` and the
keys that a rule fits on a host are the interval from its key to its key followed by a byte that no text
holds. A url stands in the sweep of every rule host that is a suffix of its own host.

Sweep: rules open and close intervals, urls are points between them, all sorted by key. Two intervals on
one host are nested or apart, so the active rules are a stack; the rule on top is the longest on that
host. A url takes the longest rule over its sweeps.

Skew: the sweep of a host is cut into as many parts as its number of urls asks for; the rules of the
host go to every part, at most one rule row for ``POINTS_PER_RULE`` urls. Equal (host, path) pairs are one
point. Rules and urls meet in equi-joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm.common import ascii_lower

#: Points in one part of a host's sweep.
PART = 4096
#: A rule is copied to one more part only for so many more points.
POINTS_PER_RULE = 8


def split_url(url: str) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or a text without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(rhost: Column, path: Column) -> Column:
    return F.concat(rhost, path).cast("binary")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """rhost, path, key, stack: the rules open inside a rule's interval, outermost first, itself last.

    A rule given twice is one rule; ``block`` wins over ``allow``. Rules with a null part or an empty host never fit.
    """
    r = rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict")).dropna().filter("host != ''") \
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict")) \
        .withColumn("rhost", _reversed(F.col("host")))
    me = F.struct(F.length("path").alias("depth"), F.concat("host", "path").alias("rule"), "verdict")
    own = r.select("rhost", F.col("path").alias("outer"), me.alias("entry"))
    # every prefix of a rule's path, to be met by the rules that end there
    prefixes = r.withColumn("outer", F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")))
    stacks = prefixes.join(own, ["rhost", "outer"]).groupBy("rhost", "path").agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    return stacks.withColumn("key", _key(F.col("rhost"), F.col("path")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", part: int = PART) -> DataFrame:
    """``pages`` with host, path, rule and verdict added; every row and column is kept.

    Columns of these names that the input has already are replaced. Without a fitting rule ``rule`` is
    null and ``verdict`` is ``default``. Null and malformed urls have an empty host and path and fit no
    rule. Of fitting rules the one with the longest text wins, then the one with the longer host. An
    empty table of pages or rules is allowed.
    """
    host, path = split_url(url)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    points = pages.select(host.alias("host"), path.alias("path")).filter("host != ''").distinct()
    stacks = rule_stacks(rules)
    rule_hosts = stacks.groupBy("rhost").agg(F.count("*").alias("n_rules"), F.max(F.size(F.split("rhost", r"\."))).alias("labels"))
    most = rule_hosts.agg(F.max("labels")).head()[0] or 0
    suffixes = F.expr(f"transform(sequence(1, greatest(1, least({most}, size(split(host, '[.]'))))), n -> substring_index(host, '.', -n))")
    at = points.withColumn("suffix", F.explode(suffixes)).withColumn("rhost", _reversed(F.col("suffix"))) \
        .join(rule_hosts.select("rhost", "n_rules"), "rhost")
    sizes = at.groupBy("rhost").agg(F.count("*").alias("n"), F.first("n_rules").alias("n_rules")) \
        .select("rhost", F.ceil(F.col("n") / F.greatest(F.lit(part), F.lit(POINTS_PER_RULE) * F.col("n_rules"))).cast("int").alias("parts"))
    none = stacks.schema["stack"].dataType
    dots = at.join(sizes, "rhost").select(
        "rhost", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int").alias("part"), _key(F.col("rhost"), F.col("path")).alias("key"),
        F.lit(1).alias("kind"), F.lit(None).cast(none).alias("stack"), "host", "path")
    spread = stacks.join(sizes, "rhost").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    nothing = [F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")]
    opens = spread.select("rhost", "part", "key", F.lit(0).alias("kind"), "stack", *nothing)
    closes = spread.select("rhost", "part", F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"),
                           F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"), *nothing)
    sweep = W.partitionBy("rhost", "part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    # dealt by part: left to itself, Spark would keep the rows where the join on the host has put them
    rows = dots.unionByName(opens).unionByName(closes).repartition("rhost", "part")
    swept = rows.withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
    top = F.expr("try_element_at(active, -1)")
    found = swept.filter("kind = 1 and size(active) > 0").select("host", "path", top.alias("top"), F.length("rhost").alias("host_size"))
    order = F.struct(F.length("top.rule"), "host_size", "top.rule", "top.verdict")
    best = found.groupBy("host", "path").agg(F.max_by("top", order).alias("top"))
    return urls.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
