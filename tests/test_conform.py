"""Conformance of nested documents, and of commit logs and the tables that rest on them."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.operators import conform
from corpusframe.schemas import struct
from corpusframe.sources import commits, sinks
from corpusframe.streaming import ingest

S = T.StringType()


def nested(spark, rows, page, **fields):
    schema = struct(key=S, document=struct(document_name=S, year=S), pages=T.ArrayType(page), **fields)
    return spark.createDataFrame(rows, schema)


PAGE = struct(page_number=S, page_type=S, raw_text=S, extra=S, references=S,
              sections=T.ArrayType(struct(section_number=S, content=S, is_continuation=S)))


def test_document_is_conformed_field_by_field(spark):
    rows = [("a", ("D", "1990"), [("7", "act", None, "x", "r", [("1", None, "true"), None]), ("p. 2", "menu", "t", None, None, None), None], "kept")]
    out = conform.conform(nested(spark, rows, PAGE, more=S)).head()
    assert out.more == "kept" and (out.document.document_name, out.document.year, out.document.language) == ("D", 1990, None)
    assert [(p.page_number, p.page_type, p.raw_text, p.references, p.forms) for p in out.pages] == [
        (7, "act", "", [], []), (2, "menu", "t", [], []), (3, None, "", [], [])]
    first, second = out.pages[0].sections
    assert (first.section_number, first.section_title, first.content, first.is_continuation, first.subsections) == ("1", "", "", True, [])
    assert (second.section_number, second.content, second.is_continuation) == ("", "", False) and out.pages[1].sections == []
    assert [f.name for f in conform.conform(nested(spark, rows, PAGE, more=S)).schema["pages"].dataType.elementType.fields] == [
        f.name for f in conform.DOCUMENT["pages"].dataType.elementType.fields]


def test_issues_have_paths(spark):
    known = conform.Rules().allowed["pages.page_type"][0]
    rows = [("a", None, [("7", known, "t", None, "r", [("1", "c", "true")] * 2 + [(None, "c", "perhaps")]), ("p. 2", "menu", None, None, None, None)]), ("b", ("D", "MCM"), None)]
    got = {tuple(r) for r in conform.issues(nested(spark, rows, PAGE), ["key"]).collect()}
    assert got == {
        ("a", "error", "document", "missing"), ("a", "warning", "pages[0].references", "not an array"),
        ("a", "warning", "pages[0].sections[2].section_number", "missing"), ("a", "warning", "pages[0].sections[2].is_continuation", "not of type boolean"),
        ("a", "warning", "pages[1].page_number", "not of type int"), ("a", "warning", "pages[1].page_type", "unknown value menu"),
        ("a", "warning", "pages[1].raw_text", "missing"), ("b", "error", "pages", "missing"), ("b", "warning", "document.year", "not of type int")}


def test_missing_columns_and_empty_tables(spark):
    bare = spark.createDataFrame([("a",)], "key string")
    out = conform.conform(bare).head()
    assert out.pages == [] and out.document.document_name is None
    assert {r.path for r in conform.issues(bare, ["key"]).collect()} == {"document", "pages"}
    odd = spark.createDataFrame([("a", "text", 5)], "key string, document string, pages int")
    assert conform.conform(odd).head().pages == []
    assert {(r.path, r.message) for r in conform.issues(odd, ["key"]).collect()} == {("document", "not an object"), ("pages", "not an array")}
    assert conform.conform(bare.limit(0)).count() == conform.issues(bare.limit(0), ["key"]).count() == 0


def test_entries_of_plain_arrays_and_a_schema_of_ones_own(spark):
    df = spark.createDataFrame([("a", ["1", "x", None])], "key string, xs array<string>")
    schema, rules = struct(xs=T.ArrayType(T.IntegerType())), conform.Rules(frozenset({"xs"}), frozenset(), {}, {"xs": 0})
    assert conform.conform(df, schema, rules).head().xs == [1, 0, 0]
    assert [(r.severity, r.path, r.message) for r in conform.issues(df, ["key"], schema, rules).collect()] == [("warning", "xs[1]", "not of type int")]
    none = conform.Rules(frozenset({"pages"}), frozenset(), {}, {})
    deep = spark.createDataFrame([("a", [("t",)])], struct(key=S, pages=T.ArrayType(struct(text=S))))
    assert conform.issues(deep, ["key"], struct(pages=T.ArrayType(struct(text=S))), none).count() == 0


def test_stage_and_report_are_published_together(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    count = lambda d: d.agg(F.count("*").alias("n"))
    with pytest.raises(FileNotFoundError):
        sinks.read_stage(spark, path)
    assert sinks.publish_stage(spark.range(3), count, path).count() == 3

    def broken(d):
        raise RuntimeError("lost between data and report")
    with pytest.raises(RuntimeError):
        sinks.publish_stage(spark.range(9), broken, path)
    assert sinks.read_stage(spark, path).count() == sinks.read_report(spark, path).head().n == 3
    sinks.publish_stage(spark.range(5), count, path)
    assert sinks.read_stage(spark, path, spark.range(1).schema).count() == sinks.read_report(spark, path).head().n == 5
    assert len(sinks.remove_old_stages(spark, path)) == 2 and sinks.read_stage(spark, path).count() == 5


def files(root, ids_by_turn, spark, table, buckets=8):
    for n, ids in enumerate(ids_by_turn):
        spark.createDataFrame([(i, n * 10 + k) for k, i in enumerate(ids)], "chunk_id string, pos int").coalesce(1).write.mode("append").parquet(f"{root}/in")
        s = spark.readStream.schema("chunk_id string, pos int").parquet(f"{root}/in")
        ingest.ingest_stream(s, table, f"{root}/cp", ["pos"], buckets=buckets).awaitTermination()
    return s.schema


def test_ingest_reads_its_own_buckets_only(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    table = f"{root}/t"
    ids = [f"id{i}" for i in range(40)]
    bucket = {r.id: r.b for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    schema = files(root, [ids], spark, table)
    mine = bucket["id0"]
    others = [f for b in range(8) if b != mine for f in glob.glob(f"{table}/*/{ingest.BUCKET}={b}/*.parquet")]
    assert others
    kept = {f: open(f, "rb").read() for f in others}
    for f in others:  # a batch that looked into these would fail
        open(f, "wb").write(b"no parquet file")
    again = tempfile.mkdtemp(prefix="spark-")
    files(again, [["id0", "id0"]], spark, table)
    for f, data in kept.items():
        open(f, "wb").write(data)
    assert sorted(r.chunk_id for r in ingest.stored(spark, table, schema).collect()) == sorted(ids)
    assert {bucket[r.chunk_id] for r in ingest.stored(spark, table, schema, [mine]).collect()} == {mine}


def test_ingest_takes_committed_versions_only(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    table = f"{root}/t"
    schema = files(root, [["a", "b", "a", ""], ["b", "c", None]], spark, table)
    rows = lambda: sorted((r.chunk_id, r.pos) for r in ingest.stored(spark, table, schema).collect())
    assert rows() == [("a", 0), ("b", 1), ("c", 11)] and len(commits.versions(spark, table)) == 2
    # written and never committed: not seen
    spark.createDataFrame([("z", 1, 3)], f"chunk_id string, pos int, {ingest.BUCKET} int").write.partitionBy(ingest.BUCKET).parquet(f"{table}/{ingest.VERSION}=8-lost-0")
    assert rows() == [("a", 0), ("b", 1), ("c", 11)]
    ingest.compact(spark, table, schema)
    assert rows() == [("a", 0), ("b", 1), ("c", 11)] and len(glob.glob(f"{table}/{ingest.VERSION}=8-base-*")) == 1
    files(root, [["c", "d"]], spark, table)
    assert [i for i, _ in rows()] == ["a", "b", "c", "d"]
    with pytest.raises(Exception, match="8 buckets, not 4"):
        files(root, [["e"]], spark, table, buckets=4)


def test_replayed_batch_adds_nothing(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    table = f"{root}/t"
    schema = files(root, [["a", "b"]], spark, table)
    state = glob.glob(f"{root}/cp/commits/0") + glob.glob(f"{root}/cp/commits/.0.crc")
    assert state
    for f in state:  # Spark forgets that the batch ended, so it runs it again
        os.unlink(f)
    s = spark.readStream.schema(schema).parquet(f"{root}/in")
    ingest.ingest_stream(s, table, f"{root}/cp", ["pos"], buckets=8).awaitTermination()
    assert os.path.exists(f"{root}/cp/commits/0") and len(commits.versions(spark, table)) == 1
    assert ingest.stored(spark, table, schema).count() == 2
