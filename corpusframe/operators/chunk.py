"""Cutting sections into retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import text as X
from corpusframe.operators.extract import amendment_action  # noqa: F401  (re-exported for callers)
from corpusframe.operators.ordered import running_sum
from corpusframe.settings import durable

MAX_CHUNK, MIN_CHUNK = 8000, 100
HIERARCHY = ["subsections", "provisos", "explanations"]


def full_text(sections: DataFrame, repeat: bool = False) -> DataFrame:
    """Text of a section. The parsed hierarchy stands in for a blank content (``repeat``: is added to it)."""
    text = lambda c: F.transform(c, lambda x: x["text"])
    clauses = lambda s: F.flatten(F.transform(s["clauses"], lambda c: F.concat(F.array(c["text"]), text(c["sub_clauses"]))))
    parts = F.concat(F.flatten(F.transform("subsections", lambda s: F.concat(F.array(s["text"]), clauses(s)))),
                     text(F.col("provisos")), text(F.col("explanations")))
    content = F.coalesce("content", F.lit(""))
    chosen = F.concat(F.array(content), parts) if repeat else F.when(X.is_blank(content), parts).otherwise(F.array(content))
    clean = F.filter(F.transform(chosen, X.strip), lambda x: x != "")
    return sections.withColumn("full_text", F.array_join(clean, "\n\n"))


def pack(paragraphs: Column, longest: int, shortest: int) -> Column:
    """Greedy packing of paragraphs into pieces; a paragraph is never cut, short pieces are dropped.

    The fold sees lengths only and notes where pieces begin; each paragraph is copied once, when its piece is cut.
    """
    init = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(acc, n):
        begins = (acc["at"] == 0) | (acc["size"] + n + 2 > longest)
        return F.struct(F.when(begins, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"),
                        F.when(begins, n).otherwise(acc["size"] + n + 2).alias("size"), (acc["at"] + 1).alias("at"))

    def cut(ps):
        def pieces(acc):
            end = lambda i: F.coalesce(F.get(acc["starts"], i + 1), acc["at"])
            return F.transform(acc["starts"], lambda a, i: F.array_join(F.slice(ps, a + 1, end(i) - a), "\n\n"))
        return F.aggregate(F.transform(ps, F.length), init, step, pieces)

    # in a list of its own the array is made once, not once for every piece
    packed = F.transform(F.array(paragraphs), cut)[0]
    return F.filter(packed, lambda x: F.length(x) >= shortest)


def split_long(c: Column, longest: int = MAX_CHUNK, shortest: int = MIN_CHUNK) -> Column:
    """The pieces of a text: itself when short enough, else its packed paragraphs."""
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), X.strip), lambda x: x != "")
    return F.when(F.length(c) <= longest, F.array(c)).otherwise(pack(paragraphs, longest, shortest))


def embedding_text(document: Column, domain: Column, number: Column, title: Column, text: Column, keywords: Column) -> Column:
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Section "), number, F.lit(": "), title)).otherwise(F.concat(F.lit("Section "), number))
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "))).otherwise(F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("Document: "), document), F.concat(F.lit("Domain: "), domain), head, F.lit(""), text, F.lit(""), words)


def make_chunks(documents: DataFrame, sections: DataFrame, amendments: DataFrame | None = None, longest: int = MAX_CHUNK,
                shortest: int = MIN_CHUNK, repeat: bool = False) -> DataFrame:
    """Chunks of all non-empty sections and amendments.

    ``documents``: doc_id, document_name, document_type, year, primary_domain, secondary_domains,
    language, jurisdiction, source. ``sections``: canonical and normalised sections. The number at
    the end of a chunk id counts the chunks of the document before it.
    """
    s = full_text(sections, repeat)
    has_hierarchy = (F.size("subsections") > 0) | (F.size("provisos") > 0) | (F.size("explanations") > 0)
    s = s.filter(~X.is_blank(F.coalesce("content", F.lit(""))) | has_hierarchy)
    amending = F.coalesce("is_amendment", F.lit(False))
    shared = ["doc_id", "page_idx", "ord", "pos", "label", "number", "title", "pieces", "n_pieces", "split", "source_pages", "keywords",
              "cross_references", "legal_entities", "dates", "authorities", "has_hierarchy", "is_continuation", "is_amendment",
              "amendment_action", "target_section", "merge_status"]
    s = s.withColumns({
        "ord": F.when(F.col("kind") == "section", 0).otherwise(1), "pos": F.col("sec_idx").cast("int"), "label": F.lit("_sec_"),
        "number": F.coalesce("section_number", F.lit("")), "title": F.coalesce("section_title", F.lit("")),
        "pieces": split_long(F.col("full_text"), longest, shortest), "split": F.length("full_text") > longest,
        "has_hierarchy": has_hierarchy, "is_amendment": amending})
    s = s.withColumn("n_pieces", F.size("pieces")).select(*shared)
    if amendments is not None:
        none = lambda t: F.array().cast(t)
        refs = sections.schema["cross_references"].dataType.simpleString()
        a = amendments.filter(~X.is_blank(F.coalesce("amendment_text", F.lit("")))).select(
            "doc_id", "page_idx", F.lit(2).alias("ord"), F.col("item_idx").cast("int").alias("pos"), F.lit("_amend_").alias("label"),
            F.col("target_section").alias("number"), F.concat(X.capitalise(F.col("amendment_action")), F.lit(" of section "), "target_section").alias("title"),
            F.array("amendment_text").alias("pieces"), F.lit(1).alias("n_pieces"), F.lit(False).alias("split"),
            F.array("source_page").alias("source_pages"), none("array<string>").alias("keywords"), none(refs).alias("cross_references"),
            none("array<string>").alias("legal_entities"), none("array<string>").alias("dates"), none("array<string>").alias("authorities"),
            F.lit(False).alias("has_hierarchy"), F.lit(False).alias("is_continuation"), F.lit(True).alias("is_amendment"),
            "amendment_action", "target_section", F.lit(None).cast("string").alias("merge_status"), F.col("amendment_number").alias("id_number"))
        s = s.withColumn("id_number", F.col("number")).unionByName(a)
    else:
        s = s.withColumn("id_number", F.col("number"))
    # only places and counts go through the window; the texts meet their offsets by the number of their stored row
    rows = durable(s.withColumn("__id", F.monotonically_increasing_id()))
    places = rows.select("__id", "doc_id", "page_idx", "ord", "pos", "n_pieces")
    counted = running_sum(places, ["doc_id"], ["page_idx", "ord", "pos"], "page_idx", F.col("n_pieces"), "__offset", inclusive=False)
    whole = rows.join(counted.select("__id", "__offset"), "__id")
    one = whole.select(*[c for c in whole.columns if c not in ("pieces", "__id")], F.posexplode("pieces").alias("part", "text"))
    j = one.join(documents, "doc_id")
    part = F.concat(F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))
    named = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Section "), "number"))
    title = F.when(F.col("split"), F.concat(named, part)).otherwise(F.col("title"))
    j = j.withColumns({"section_title": title, "chunk_no": F.col("__offset") + F.col("part")})
    domain = F.coalesce("primary_domain", F.lit("General Legal"))
    return j.select(
        "doc_id", F.concat(X.slug(F.col("document_name")), "label", "id_number", F.lit("_"), F.col("chunk_no").cast("string")).alias("chunk_id"),
        F.col("document_name").alias("document"), "document_type", F.col("year").alias("document_year"), F.col("number").alias("section_number"),
        "section_title", "text", embedding_text(F.col("document_name"), domain, F.col("number"), F.col("section_title"), F.col("text"), F.col("keywords")).alias("embedding_text"),
        "source_pages", domain.alias("domain"), "keywords", "cross_references", "language",
        F.when(F.col("is_amendment"), F.lit("amendment")).otherwise(F.lit("section")).alias("chunk_type"),
        F.struct("jurisdiction", "source", (F.col("has_hierarchy") | F.col("split")).alias("has_hierarchy"), "secondary_domains", "legal_entities",
                 "dates", "authorities", (F.col("is_continuation") | F.col("split")).alias("is_continuation"), "is_amendment", "amendment_action",
                 "target_section", F.when(F.col("split"), F.lit("split")).otherwise(F.col("merge_status")).alias("merge_status")).alias("metadata"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"), F.count_if(F.col("chunk_type") == "section").alias("section_chunks"),
        F.count_if(F.col("chunk_type") == "amendment").alias("amendment_chunks"),
        F.count_if(F.col("metadata.has_hierarchy")).alias("with_hierarchy"), F.round(F.avg(n), 2).alias("avg_length"), F.max(n).alias("max_length"))
