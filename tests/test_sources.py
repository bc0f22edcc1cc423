import json
import os
import tempfile

from pyspark.sql import functions as F

from corpusframe.operators import ordered as O
from corpusframe.sources import readers, sinks
from corpusframe.operators import lookup as Q


def folder(**files):
    root = tempfile.mkdtemp(prefix="spark-")
    for name, text in files.items():
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)
    return root


def test_read_corpus_with_bare_page_and_broken_file(spark):
    doc = {"document": {"document_name": "D"}, "pages": [{"page_number": 1, "page_type": "content", "raw_text": "x",
                                                        "sections": [{"section_number": "1", "content": "c"}, {"section_number": "2"}]}]}
    bare = {"document": {"document_name": "B"}, "page_number": 4, "raw_text": "y", "sections": [{"section_number": "9", "content": "z"}]}
    root = folder(**{"a.json": json.dumps(doc, indent=1), "b.json": json.dumps(bare, indent=1), "c.json": '{"document": '})
    d = readers.read_corpus(spark, root)
    assert [r.error for r in d.filter("error IS NOT NULL").collect()] == ["Invalid JSON"]
    assert readers.corpus_issues(d).head().category == "structural"
    rows = {r.row_key: r.content for r in readers.flatten(d, "file").collect()}
    assert rows == {"D:P1:S1": "c", "D:P1:S2": "", "B:P4:S9": "z"}
    assert readers.page_rows(d, "file").count() == 2


def test_discover_and_pending(spark):
    root = folder(**{"a.pdf": "12345", "b.txt": "x"})
    os.mkdir(f"{root}/sub")
    with open(f"{root}/sub/c.pdf", "w") as f:
        f.write("x")
    got = {(r.filename, r.folder, r.size_bytes) for r in readers.discover_files(spark, root, "*.pdf").collect()}
    assert got == {("a.pdf", "", 5), ("c.pdf", "sub", 1)}
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file_name string")
    assert [r[0] for r in readers.pending(names("a", "a_MERGED", "b"), names("b")).collect()] == ["a"]


def test_query_set(spark):
    root = folder(**{"q.json": json.dumps([{"id": "1", "query": "x", "language": "en"}, {"id": "2", "query": "y"}])})
    assert [r.query for r in readers.read_queries(spark, root).orderBy("id").collect()] == ["x", "y"]


def test_load_chunks_priority_and_rules(spark):
    cols = "chunk_id string, file string, pos int, document_type string, section_number string, section_title string, rule_number string, rule_title string, language string"
    rows = [("x", "f2", 0, "Act", "1", "t", None, None, "mr"), ("x", "f1", 5, "Rules", "3", "u", None, None, ""), (None, "f1", 0, "Act", "1", "", None, None, "en")]
    order = spark.createDataFrame([("f1", 0), ("f2", 1)], "file string, priority int")
    r = readers.load_chunks(spark.createDataFrame(rows, cols), order).collect()
    assert [(x.chunk_id, x.file, x.language, x.rule_number, x.rule_title, x.section_number) for x in r] == [("x", "f1", "en", "3", "u", None)]


def test_stage_csv_and_collection(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    s = spark.createDataFrame([(1, "content", "1", None, 'a "b",\n', False, "D")],
                              "page_number int, page_type string, section_number string, section_title string, content string, is_continuation boolean, document_name string")
    stored = sinks.write_stage(s, lambda d: d.groupBy("document_name").count(), f"{root}/s")
    assert stored.count() == 1 and spark.read.json(f"{root}/s/report").head()["count"] == 1
    sinks.write_csv(s, f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").head().content_length == "7"
    v = spark.createDataFrame([("x", [1.0])], "chunk_id string, embedding array<float>")
    sinks.write_embeddings(v, v.select("chunk_id"), f"{root}/e")
    assert spark.read.parquet(f"{root}/e/embeddings").count() == 1
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "chunk_id string")
    assert sinks.collection_check(ids("a", "b", "a"), ids("a", "b")).head().equal


def test_search_is_literal(spark):
    d = spark.createDataFrame([("a.b A.B axb",)], "content string")
    assert Q.search(d, "a.b").head().match_count == 2 and Q.search(d, "a.b", True).head().match_count == 1


def test_the_embedding_store_numbers_one_hot_document_in_many_tasks(spark):
    """All chunks in one document, and rows whose document or chunk is null: no row is lost, numbers are dense and in order."""
    base = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"),
                                    F.when(F.col("id") != 1, F.format_string("c%05d", "id")).alias("chunk_id"))
    text = ["document", "document_type", "language", "domain", "section_number", "section_title", "rule_number", "rule_title"]
    none = F.array().cast("array<string>")
    chunks = base.select("*", *[F.lit("x").alias(c) for c in text], F.lit(1).alias("document_year"), *[none.alias(c) for c in ("source_pages", "keywords", "cross_references")])
    got = sinks.embedding_metadata(chunks, ["doc_id", "chunk_id"])
    rows = sorted((r["index"], r.chunk_id) for r in got.select("index", "chunk_id").collect())
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.chunk_id is not None, r.chunk_id or "") for r in base.collect()))
    assert [i for i, _ in rows] == list(range(5000)) and [c or "" for _, c in rows] == [w[3] for w in want]
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # 5,000 rows would be put together again
    spark.conf.set(name, "false")
    try:
        tasks = O.numbered(base, [], ["doc_id", "chunk_id"], "index").select(F.spark_partition_id().alias("p")).groupBy("p").count()
        assert tasks.agg(F.max("count")).head()[0] < 4000
    finally:
        spark.conf.unset(name)


def test_nested_pages_are_written_small_and_lines_are_not_shuffled(spark):
    from corpusframe.plans import q_corpus
    from corpusframe.settings import shared_folder
    import glob
    plan = q_corpus.nested(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split" not in plan.lower() and plan.count("Join") == 1
    folder = shared_folder(spark).split(":", 1)[-1]
    old = set(glob.glob(f"{folder}/corpus-*/*"))
    q_corpus.read_corpus(spark, "/root/testdata/sf0.001")
    made = [f for f in set(glob.glob(f"{folder}/corpus-*/*")) - old if "/part-" in f]
    assert made and all(f.endswith(".json.gz") for f in made)
