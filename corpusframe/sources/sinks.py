"""Sinks: stage tables with their reports, CSV export, embedding store, vector collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.operators.ordered import numbered
from corpusframe.sources import commits


def write_stage(df: DataFrame, report, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a stage's result and, from the written table, its report; returns the stored result."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/data")
    stored = df.sparkSession.read.schema(df.schema).format(fmt).load(f"{path}/data")
    report(stored).write.mode("overwrite").json(f"{path}/report")
    return stored


def publish_stage(df: DataFrame, report, path: str) -> DataFrame:
    """A new version of a stage, with the report made from the stored result; both are published by one commit.

    A job that dies between data and report leaves the version before as the one that is read. Returns the stored result.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/{version}/data")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{version}/data")
    report(rows).write.parquet(f"{path}/{version}/report")
    commits.commit(spark, path, version)
    return rows


def _published(spark: SparkSession, path: str) -> str:
    names = commits.versions(spark, path)
    if not names:
        raise FileNotFoundError(f"no version of {path} has been published")
    return f"{path}/{names[-1]}"


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The result last published in ``path``."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{_published(spark, path)}/data")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The report of the result last published in ``path``."""
    return spark.read.parquet(f"{_published(spark, path)}/report")


def remove_old_stages(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes all but the last ``keep`` published versions, and what was begun and never published; returns the names.

    Not beside a running ``publish_stage``, whose version is not published yet.
    """
    kept = commits.versions(spark, path)[-max(1, keep):]
    gone = [n for n in commits.folders(spark, path) if n != commits.LOG and n not in kept]
    for name in gone:
        commits.remove(spark, f"{path}/{name}")
    return gone


def sections_csv_view(sections: DataFrame) -> DataFrame:
    return sections.select("page_number", "page_type", "section_number", F.coalesce("section_title", F.lit("")).alias("section_title"),
                           F.length("content").alias("content_length"), "is_continuation", "document_name")


def write_csv(sections: DataFrame, path: str) -> None:
    sections_csv_view(sections).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def embedding_metadata(chunks: DataFrame, order: list[str]) -> DataFrame:
    """The 15 metadata fields of the embedding store; ``index`` is the row of the vector, by ``order`` (nulls first).

    The store is numbered by sampled ranges of the whole order, so a document with all chunks is as many tasks as
    it has ranges.
    """
    name = F.translate(F.coalesce("document", F.lit("unknown")), " ,", "_")
    indexed = numbered(chunks, [], order, "index")
    return indexed.select("index", "chunk_id", "document", "document_type", "document_year", "language", "domain", "section_number",
                          "section_title", "rule_number", "rule_title", "source_pages", "keywords", "cross_references",
                          F.concat(name, F.lit(".pdf")).alias("filename"))


def write_embeddings(vectors: DataFrame, metadata: DataFrame, path: str) -> None:
    """Vectors (chunk_id, embedding) and metadata side by side."""
    vectors.write.mode("overwrite").parquet(f"{path}/embeddings")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def embedding_manifest(chunks: DataFrame) -> DataFrame:
    """Totals and the counts by language and by domain, in one pass."""
    c = chunks.select(F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("domain", F.lit("unknown")).alias("domain"))
    sets = c.groupingSets([["language"], ["domain"], []], "language", "domain").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 1, "language").when(F.col("g") == 2, "domain").otherwise("total").alias("dimension"),
                       F.coalesce("language", "domain", F.lit("all")).alias("key"), "n")


def to_collection(chunks: DataFrame, stored_ids: DataFrame, first_by: tuple[str, ...] = ("text",)) -> DataFrame:
    """Records to add to a collection: new ids only, scalars as text, lists as JSON text, no year = 0.

    Of several chunks with one id the first by ``first_by`` is taken.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    new = chunks.join(stored_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    new = new.withColumn("__rn", F.row_number().over(W.partitionBy("chunk_id").orderBy(*first_by))).filter("__rn = 1")
    return new.select(text("chunk_id"), text("document"), text("document_type"), F.coalesce("document_year", F.lit(0)).alias("document_year"),
                      text("language"), text("domain"), text("section_number"), text("section_title"), text("rule_number"), text("rule_title"),
                      *[F.to_json(c).alias(c) for c in ("source_pages", "keywords", "cross_references")], "text")


def collection_check(chunks: DataFrame, collection: DataFrame) -> DataFrame:
    """Ids expected and stored, and whether they agree."""
    both = chunks.select(F.lit(1).alias("side"), "chunk_id").unionByName(collection.select(F.lit(2).alias("side"), "chunk_id"))
    counts = both.agg(F.count_distinct(F.when(F.col("side") == 1, F.col("chunk_id"))).alias("expected"), F.count_if(F.col("side") == 2).alias("stored"))
    return counts.withColumn("equal", F.col("expected") == F.col("stored"))


def batch_report(status: DataFrame) -> DataFrame:
    """Totals of a batch: ``status`` has status, pages, sections per file."""
    ok = F.col("status") == "success"
    return status.agg(F.count("*").alias("total_documents"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
                      F.coalesce(F.sum(F.when(ok, F.col("pages"))), F.lit(0)).alias("total_pages"),
                      F.coalesce(F.sum(F.when(ok, F.col("sections"))), F.lit(0)).alias("total_sections"))
