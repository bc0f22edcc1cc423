"""Sources: corpus documents, file manifests, chunk tables, query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe import schemas
from corpusframe.functions import text as X

# Marks of files that a stage has produced.
STAGE_MARKS = ["RAG_READY", "VALIDATED", "REPAIRED", "MERGED", "NORMALIZED", "CANONICAL", "RAG_CHUNKS"]


def read_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents as rows: file, document, pages, error. A file that is not JSON is a row with ``error``."""
    raw = (spark.read.schema(schemas.CORPUS).option("multiLine", multi_line).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", schemas.CORRUPT).json(path))
    page = F.struct(*[F.col(f.name) for f in schemas.PAGE.fields])
    pages = F.when(F.size("pages") > 0, F.col("pages")).when(
        F.col("document").isNotNull() | F.col("raw_text").isNotNull(), F.array(page))
    pages = F.coalesce(pages, F.array().cast(schemas.CORPUS["pages"].dataType))
    empty = F.col("document").isNull() & F.col("pages").isNull()
    error = F.when(F.col(schemas.CORRUPT).isNotNull(), F.when(empty, "Invalid JSON").otherwise("Invalid fields"))
    return raw.select(F.col("_metadata.file_path").alias("file"), "document", pages.alias("pages"),
                      error.alias("error"))


def corpus_issues(documents: DataFrame) -> DataFrame:
    """One structural error per unreadable file."""
    return documents.filter(F.col("error").isNotNull()).select(
        "file", F.lit("error").alias("severity"), F.lit("structural").alias("category"), F.lit("json").alias("field"), F.col("error").alias("message"))


def page_rows(documents: DataFrame, key: str) -> DataFrame:
    """Pages of nested documents, with the fields' defaults filled in."""
    p = documents.select(key, F.posexplode("pages").alias("page_idx", "p"))
    return p.select(key, "page_idx", F.col("p.page_number"), F.coalesce("p.page_type", F.lit("")).alias("page_type"),
                    F.coalesce("p.raw_text", F.lit("")).alias("raw_text"))


def _as_sections(page: Column) -> Column:
    """Sections and rules of a page in one array: kind, sec_idx (place in its own array) and the fields of a section."""
    def entries(items: Column, kind: str, number: str, title: str) -> Column:
        return F.transform(items, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("sec_idx"), x[number].alias("section_number"), x[title].alias("section_title"), x["content"].alias("content"),
            x["is_continuation"].alias("is_continuation")))
    return F.flatten(F.array_compact(F.array(entries(page["sections"], "section", "section_number", "section_title"),
                                             entries(page["rules"], "rule", "rule_number", "rule_title"))))


def flatten(documents: DataFrame, key: str) -> DataFrame:
    """Sections and rules of nested documents as rows with page and document fields and a readable row key."""
    s = documents.select(key, "document.document_name", F.posexplode("pages").alias("page_idx", "p")).select(
        key, "document_name", "page_idx", "p.page_number", "p.page_type", F.inline(_as_sections(F.col("p"))))
    s = s.withColumns({"content": F.coalesce("content", F.lit("")), "is_continuation": F.coalesce("is_continuation", F.lit(False))})
    mark = F.when(F.col("kind") == "rule", F.lit(":R")).otherwise(F.lit(":S"))
    return s.withColumn("row_key", F.concat(F.coalesce("document_name", F.lit("")), F.lit(":P"), F.coalesce(F.col("page_number").cast("string"), F.lit("")),
                                            mark, F.coalesce("section_number", F.lit(""))))


#: Arrays of a page beside sections and rules, with the fields that name an entry, title it and hold its text.
PAGE_ITEMS = (("definitions", "clause", "term", "definition_text"), ("amendments", "amendment_number", "target_section", "amendment_text"),
              ("schedules", "schedule_number", "schedule_title", "content"), ("forms", "form_number", "form_title", "content"), ("tables", "table_number", "table_title", "content"))


def page_items(documents: DataFrame, key: str) -> DataFrame:
    """The other entries of nested pages as rows: kind, item_idx, number, title, text; absent arrays have none."""
    def entries(name: str, number: str, title: str, text: str) -> Column:
        return F.transform(F.col("p")[name], lambda x, i: F.struct(
            F.lit(name).alias("kind"), i.alias("item_idx"), x[number].alias("number"), x[title].alias("title"), x[text].alias("text")))
    lists = [entries(*item) for item in PAGE_ITEMS]
    return documents.select(key, F.posexplode("pages").alias("page_idx", "p")).select(
        key, "page_idx", "p.page_number", F.inline(F.flatten(F.array_compact(F.array(*lists)))))


def discover_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Manifest of the non-empty files below ``root``; the contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
             .select("path", "length", "modificationTime"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    base = "/" + root.split(":")[-1].strip("/") + "/"
    folder = F.regexp_replace(F.regexp_extract(F.col("path"), r"\Q" + base + r"\E(.*)$", 1), r"/?[^/]*$", "")
    return files.select(F.col("path").alias("file"), name.alias("filename"), folder.alias("folder"), F.col("length").alias("size_bytes"),
                        F.col("modificationTime").alias("discovered_at"))


def pending(inputs: DataFrame, done: DataFrame, name: str = "file_name", marks=STAGE_MARKS) -> DataFrame:
    """Inputs that no stage has produced and that are not done yet."""
    raw = inputs.filter(~X.any_of(F.col(name), marks))
    return raw.join(done.select(name).distinct(), name, "left_anti")


def load_chunks(chunks: DataFrame, priority: DataFrame) -> DataFrame:
    """One chunk per id: that of the file named first in ``priority`` (file, priority).

    ``chunks`` has file and pos (place in the file). Keeping one row per id is a top-1 window, which
    Spark cuts down before the shuffle, so many copies of a chunk cost nothing.
    """
    named = chunks.filter(F.coalesce("chunk_id", F.lit("")) != "").join(priority, "file")
    best = named.withColumn("__rn", F.row_number().over(W.partitionBy("chunk_id").orderBy("priority", "pos"))).filter("__rn = 1")
    rules = (F.col("document_type") == "Rules") & (F.coalesce("rule_number", F.lit("")) == "")
    rules = F.coalesce(rules, F.lit(False))
    lang = F.when(F.coalesce("language", F.lit("")).isin("", "MISSING"), F.lit("en")).otherwise(F.col("language"))
    moved = {
        "language": lang,
        "rule_number": F.when(rules, F.col("section_number")).otherwise(F.col("rule_number")),
        "rule_title": F.when(rules, F.col("section_title")).otherwise(F.col("rule_title")),
        "section_number": F.when(~rules, F.col("section_number")), "section_title": F.when(~rules, F.col("section_title"))}
    return best.drop("__rn", "priority").withColumns(moved)


def read_queries(spark: SparkSession, path: str, schema=schemas.QUERY_SET) -> DataFrame:
    """A query set: a JSON list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
