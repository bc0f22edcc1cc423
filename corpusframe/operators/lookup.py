"""Relational access to a corpus: look-ups, keyword search, statistics, overlap between documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import text as X
from corpusframe.operators import gramtiles
from corpusframe.settings import durable

GRAM = 5


def by_number(sections: DataFrame, number: str) -> DataFrame:
    return sections.filter(F.col("section_number") == number)


def page_by_number(pages: DataFrame, number: int) -> DataFrame:
    """The first page of every document that carries the number, with its text."""
    first = pages.filter(F.col("page_number") == number).groupBy("doc_id").agg(F.min("page_idx").alias("page_idx"))
    return pages.join(first, ["doc_id", "page_idx"], "left_semi")


def sections_by_page(pages: DataFrame, sections: DataFrame, number: int) -> DataFrame:
    return sections.join(page_by_number(pages, number).select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_semi")


def matches(c: Column, term: str, case_sensitive: bool = False) -> Column:
    """Number of non-overlapping literal occurrences."""
    return F.regexp_count(c, F.lit(("" if case_sensitive else "(?iu)") + r"\Q" + term + r"\E"))


def search(sections: DataFrame, term: str, case_sensitive: bool = False, text: str = "content") -> DataFrame:
    """Rows with the term and its number of occurrences."""
    return sections.withColumn("match_count", matches(F.col(text), term, case_sensitive)).filter(F.col("match_count") > 0)


def ranked(hits: DataFrame, key: list[str]) -> DataFrame:
    return hits.orderBy(F.col("match_count").desc(), *key)


def search_pages(pages: DataFrame, term: str) -> DataFrame:
    low = F.lower("raw_text")
    found = pages.withColumn("matches", F.regexp_count(low, F.lit(r"\Q" + term.lower() + r"\E"))).filter(F.col("matches") > 0)
    return found.select("doc_id", "page_idx", "page_number", F.concat(X.at_most(F.col("raw_text"), 200), F.lit("...")).alias("snippet"), "matches")


def doc_stats(pages: DataFrame, sections: DataFrame) -> DataFrame:
    p = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    s = sections.groupBy("doc_id").agg(
        F.count("*").alias("total_sections"), F.sum(F.length("content")).alias("total_characters"),
        F.sum(F.size(X.words(F.col("content")))).alias("total_words"))
    j = p.join(s, "doc_id", "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_sections", "total_characters", "total_words")})
    mean = F.when(F.col("total_sections") > 0, F.floor(F.try_divide("total_characters", "total_sections"))).otherwise(0)
    return j.withColumn("average_section_length", mean.cast("long"))


def compare(stats: DataFrame, measures: list[str]) -> DataFrame:
    """Statistics of all documents side by side: one row per measure with smallest, largest and total."""
    long = stats.select("doc_id", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("value")) for m in measures])))
    return long.groupBy("measure").agg(F.min("value").alias("smallest"), F.max("value").alias("largest"), F.sum("value").alias("total"),
                                       F.min_by("doc_id", F.struct(-F.col("value"), "doc_id")).alias("largest_doc"))


def section_index(sections: DataFrame) -> DataFrame:
    """Per document and number: title of the first section, its pages, its non-empty contents."""
    row = F.struct("page_idx", "sec_idx", "page_number", "section_title", "content")
    g = sections.groupBy("doc_id", "kind", "section_number").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select("doc_id", "kind", "section_number", F.col("r")[0]["section_title"].alias("title"), F.col("r.page_number").alias("pages"),
                    F.filter(F.col("r.content"), lambda c: c != "").alias("contents"))


def page_stats(counted: DataFrame) -> DataFrame:
    """Totals per document from pages with structure counts."""
    text = ~X.is_blank(F.col("raw_text"))
    return counted.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), F.count_if(text).alias("pages_with_content"), F.count_if(~text).alias("empty_pages"),
        F.sum("n_section").alias("total_sections"), F.sum("n_rule").alias("total_rules"), F.sum("n_definition").alias("total_definitions"))


def document_text(pages: DataFrame) -> DataFrame:
    filled = pages.filter(~X.is_blank(F.col("raw_text")))
    g = filled.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "raw_text"))).alias("r"))
    return g.select("doc_id", F.array_join("r.raw_text", "\n\n").alias("full_text"))


def grams(c: Column, n: int = GRAM) -> Column:
    """Distinct character n-grams, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?s)(?![\uDC00-\uDFFF])(?=(.{%d}))" % n), F.lit(1)))


#: Pairs of a left and a right row that one task of ``overlap_join`` counts at most, and n-grams of the right side sent to the tasks at once.
PAIRS = 500_000
SENT_GRAMS = 1_000_000


def overlap_join(left: DataFrame, right: DataFrame, n: int = GRAM, min_overlap: int = 100, pairs: int = PAIRS, sent_grams: int = SENT_GRAMS) -> DataFrame:
    """Pairs (left_id, right_id) that share n-grams: ``overlap_chars`` = n × shared grams > ``min_overlap``.

    ``left``/``right``: id, text. Whether an n-gram of one text occurs in the other is membership in
    its gram set, so the pairs come from an equi-join on the gram and a count. Left texts are dealt by id, so few to a task
    that no more than about ``pairs`` counts are open there; their grams are not shuffled, and no pair is. The grams of the
    right side go to the tasks, those of some texts at a time (about ``sent_grams``).
    """
    sized = right.select("id", "text", F.size(grams(F.col("text"), n)).alias("n_grams"))
    n_right, n_grams = sized.agg(F.count("*"), F.coalesce(F.sum("n_grams"), F.lit(0))).head()
    parts = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(left.count() * n_right / pairs))
    dealt = left.select(F.col("id").alias("left_id"), "text").repartition(parts, "left_id")
    l = dealt.select("left_id", F.explode(grams(F.col("text"), n)).alias("gram"))
    turns, out = max(1, math.ceil(n_grams / sent_grams)), None
    for turn in range(turns):
        some = right if turns == 1 else right.filter(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn)
        r = some.select(F.col("id").alias("right_id"), F.explode(grams(F.col("text"), n)).alias("gram"))
        shared = l.join(F.broadcast(r), "gram").groupBy("left_id", "right_id").agg((F.count("*") * n).alias("overlap_chars"))
        shared = shared.filter(F.col("overlap_chars") > min_overlap)
        out = shared if out is None else out.unionByName(shared)
    return out


SECTION_KEY = ["doc_id", "page_idx", "kind", "sec_idx"]


def gram_classes(sections: DataFrame, n: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(members: k, rep, n_grams; classes: rep, text, n_grams, lo, hi) of sections with the same n-grams.

    ``rep`` is the smallest key of a class, ``text`` its text, ``lo`` and ``hi`` the smallest and largest doc_id of the class. Gram
    sets are told apart by SHA-256, so no set is moved, only the texts of the representatives. Sections without a gram are in no class.
    """
    gs = sections.select(F.struct(*SECTION_KEY).alias("k"), F.col("content").alias("text"), grams(F.col("content"), n).alias("gs")).filter(F.size("gs") > 0)
    own = durable(gs.select("k", "text", F.size("gs").alias("n_grams"), F.unhex(F.sha2(F.array_join(F.array_sort("gs"), ""), 256)).alias("set")))
    sets = durable(own.groupBy("set").agg(F.min("k").alias("rep"), F.min("k.doc_id").alias("lo"), F.max("k.doc_id").alias("hi")))
    members = own.select("k", "set", "n_grams").join(sets.select("set", "rep"), "set").select("k", "rep", "n_grams")
    classes = own.select(F.col("k").alias("rep"), "set", "n_grams", "text").join(sets, ["set", "rep"]).select("rep", "text", "n_grams", "lo", "hi")
    return members, classes


def overlapping_classes(classes: DataFrame, n: int = GRAM, min_overlap: int = 100, block_chars: int = gramtiles.BLOCK_CHARS) -> DataFrame:
    """Pairs (a, b) of classes, smaller representative first, with members in different documents that share n-grams: overlap_chars.

    Exact: every two classes are compared, in tiles of two blocks of about ``block_chars`` characters. Only the texts are moved, once per
    block, and pairs are not moved at all; what is compared and returned grows with the square of the classes where most share text.
    """
    need = max(0, min_overlap) // n + 1
    one = F.col("lo") == F.col("hi")
    rows = durable(classes.filter(F.col("n_grams") >= need).select(F.col("rep").alias("key"), "text", F.when(one, F.col("lo")).alias("doc"), F.coalesce(~one, F.lit(False)).alias("spread")))
    chars = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    pairs = gramtiles.shared_grams(rows, chars, n, need, block_chars)
    return pairs.select("a", "b", (F.col("shared") * n).alias("overlap_chars"))


def overlapping_sections(sections: DataFrame, n: int = GRAM, min_overlap: int = 100) -> DataFrame:
    """Pairs (a, b) of sections of different documents, smaller doc_id first, that share n-grams.

    Equal gram sets are compared once (``overlapping_classes``) and the pairs of classes expanded to their members;
    where copies abound, the classes and their members say the same in fewer rows.
    """
    members, classes = gram_classes(sections, n)
    pairs = overlapping_classes(classes, n, min_overlap)
    of = lambda name: members.select(F.col("rep").alias(f"r_{name}"), F.col("k").alias(name), F.col("n_grams").alias(f"n_{name}"))
    across = (pairs.withColumnsRenamed({"a": "r_a", "b": "r_b"}).join(of("a"), "r_a").join(of("b"), "r_b")
              .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap_chars"))
    within = of("a").filter(F.col("n_a") * n > min_overlap).join(of("b"), F.col("r_a") == F.col("r_b")).select("a", "b", (F.col("n_a") * n).alias("overlap_chars"))
    return across.unionByName(within).filter(F.col("a.doc_id") < F.col("b.doc_id"))
