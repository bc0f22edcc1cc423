"""Canonical document model: type, year, domains, chapters, page rollups, fixed key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.functions import text as X
from corpusframe.operators.ordered import left_context

MASK_BITS = 60
MAX_PAGE_KEYWORDS = 30


def infer_doc_type(documents: DataFrame, pages: DataFrame, keys=R.DOC_TYPE_KEYS) -> DataFrame:
    """Type as given, else by the name, else by the first page that tells, else ``Other``."""
    low = F.lower("raw_text")
    has = lambda w: F.contains(low, F.lit(w))
    kinds = ["Amendment Act", "Act", "Rule"]
    code = F.when(has("amendment act"), 0).when(has("act no") | has("an act to"), 1).when(has("rules") & has("made under"), 2)
    first = pages.select("doc_id", (F.col("page_idx").cast("long") * 4 + code).alias("__c")).filter("__c IS NOT NULL") \
        .groupBy("doc_id").agg(F.min("__c").alias("__c"))
    name = F.lower(F.coalesce("document_name", F.lit("")))
    by_name = F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(v)) for k, v in keys])
    by_page = F.try_element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod("__c", F.lit(4)) + 1).cast("int"))
    j = documents.join(first, "doc_id", "left")
    return j.withColumn("document_type", F.coalesce(F.nullif("document_type", F.lit("")), by_name, by_page, F.lit("Other"))).drop("__c")


def infer_year(documents: DataFrame, pages: DataFrame, first_pages: int = 3) -> DataFrame:
    year = lambda c: F.nullif(F.regexp_extract(c, R.uni(r"\b(?:19|20)\d{2}\b"), 0), F.lit("")).cast("long")
    seen = pages.filter(F.col("page_idx") < first_pages).select(
        "doc_id", (F.col("page_idx").cast("long") * 10000 + year(F.col("raw_text"))).alias("__y")).filter("__y IS NOT NULL") \
        .groupBy("doc_id").agg(F.min("__y").alias("__y"))
    j = documents.join(seen, "doc_id", "left")
    value = F.coalesce(F.col("year").cast("long"), year(F.coalesce("document_name", F.lit(""))), F.pmod("__y", F.lit(10000)))
    return j.withColumn("year", value.cast("int")).drop("__y")


def classify_domains(pages: DataFrame, terms=R.DOMAIN_TERMS, secondary: int = 3) -> DataFrame:
    """Primary and secondary domains of a document by the number of domain terms it contains.

    Pages are tested one by one and their hits are OR-ed as bit masks, so the shuffle carries a few
    numbers per page. A term broken by a page boundary is looked for in the text around it.
    """
    listed = list(dict.fromkeys(t for ts in terms.values() for t in ts))
    longest, spaces = max(map(len, listed)), max(t.count(" ") for t in listed)
    low = F.lower(F.coalesce("raw_text", F.lit("")))
    tail = F.substring(low, -longest, longest)
    tail = F.when(F.length(low) > longest, tail).otherwise(low)
    p = pages.select("doc_id", "page_idx", low.alias("__t"), tail.alias("__e"))
    p = left_context(p, ["doc_id"], "page_idx", F.col("__e"), "__before", n=max(spaces, 1))
    seam = F.array_join(F.concat("__before", F.array(F.substring("__t", 1, longest))), " ")
    p = p.select("doc_id", "__t", F.when(F.size("__before") > 0, seam).otherwise(F.lit("")).alias("__seam"))
    masks = []
    for k in range(0, len(listed), MASK_BITS):
        bits = [F.when(F.contains("__t", F.lit(t)) | F.contains("__seam", F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0))
                for i, t in enumerate(listed[k:k + MASK_BITS])]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits]))
    m = p.select("doc_id", *[c.alias(f"__m{i}") for i, c in enumerate(masks)]).groupBy("doc_id").agg(
        *[F.bit_or(f"__m{i}").alias(f"__m{i}") for i in range(len(masks))])

    def score(ts) -> Column:
        wanted = {}
        for t in ts:
            i = listed.index(t)
            wanted[i // MASK_BITS] = wanted.get(i // MASK_BITS, 0) | 1 << (i % MASK_BITS)
        return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"__m{w}").bitwiseAND(F.lit(v).cast("long"))) for w, v in wanted.items()])

    ranked = F.array_sort(F.filter(
        F.array(*[F.struct((-score(ts)).alias("neg"), F.lit(i).alias("ord"), F.lit(d).alias("domain")) for i, (d, ts) in enumerate(terms.items())]),
        lambda s: s["neg"] < 0))
    r = m.select("doc_id", ranked.alias("r"))
    return r.select("doc_id", F.try_element_at("r", F.lit(1))["domain"].alias("primary_domain"),
                    F.transform(F.slice("r", 2, secondary), lambda s: s["domain"]).alias("secondary_domains"))


def chapter(pages: DataFrame) -> DataFrame:
    return pages.withColumns({
        "chapter_number": F.nullif(F.regexp_extract("raw_text", R.CHAPTER, 1), F.lit("")),
        "chapter_title": F.nullif(X.strip(F.regexp_extract("raw_text", R.CHAPTER, 2)), F.lit(""))})


def page_rollup(normalised: DataFrame, most: int = MAX_PAGE_KEYWORDS) -> DataFrame:
    """What the sections of a page mention, together."""
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return normalised.groupBy("doc_id", "page_idx").agg(
        together("dates").alias("dates"), together("authorities").alias("authorities"), together("legal_entities").alias("legal_entities"),
        F.slice(together("keywords"), 1, most).alias("keywords"), F.flatten(F.collect_list("cross_references")).alias("cross_references"))


def canonical_documents(documents: DataFrame, pages: DataFrame, jurisdiction: str = "India", terms=R.DOMAIN_TERMS) -> DataFrame:
    """The fixed document keys; what is not given is inferred from name and pages."""
    d = infer_year(infer_doc_type(documents, pages), pages).join(classify_domains(pages, terms), "doc_id", "left")
    given = F.nullif("domain", F.lit(""))
    null = lambda name: F.lit(None).cast("string").alias(name)
    return d.select(
        "doc_id", F.nullif("document_name", F.lit("")).alias("document_name"), "document_type", null("document_number"), "year",
        null("date"), F.lit(jurisdiction).alias("jurisdiction"), null("issuing_authority"), null("ministry"), null("department"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit("India Code")).alias("source"),
        F.coalesce(given, "primary_domain").alias("primary_domain"),
        F.when(given.isNull(), F.col("secondary_domains")).otherwise(F.array().cast("array<string>")).alias("secondary_domains"),
        F.coalesce("language", F.lit("unknown")).alias("language"))


def canonicalise(sections: DataFrame) -> DataFrame:
    """The fixed section keys: missing ones filled, blanks to null."""
    have = set(sections.columns)
    optional = {"source_pages": F.array("page_number"), "is_amendment": F.lit(False), "amendment_action": F.lit(None).cast("string"),
                "target_section": F.lit(None).cast("string"), "merge_status": F.lit(None).cast("string")}
    s = sections.withColumns({k: v for k, v in optional.items() if k not in have})
    return s.withColumns({"section_title": F.nullif("section_title", F.lit("")), "content": F.nullif("content", F.lit(""))})


def canonical_report(counted: DataFrame) -> DataFrame:
    """Totals per document from pages with structure counts."""
    sums = {"sections_processed": F.col("n_section") + F.col("n_rule"), "amendments_processed": F.col("n_amendment"),
            "definitions_processed": F.col("n_definition"), "schedules_processed": F.col("n_schedule"), "forms_processed": F.col("n_form")}
    return counted.groupBy("doc_id").agg(F.count("*").alias("pages_processed"), *[F.sum(v).alias(k) for k, v in sums.items()])
