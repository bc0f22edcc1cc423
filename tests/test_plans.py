"""Physical plans: what must and must not be in them."""

import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusframe.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROW_LOCAL = ["clean_ocr", "clean_page_text", "text_quality", "script_language", "query_language", "scrub_responses", "split_long", "route_scores",
             "select_routes"]


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_queries_do_not_shuffle(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


@pytest.mark.parametrize("name", ["load_chunks", "dedupe_evidence"])
def test_top_one_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, SF)) and "Partial" in plan(catalog.QUERIES[name](spark, SF))


def test_overlap_counts_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["overlap_join"](spark, SF))
    assert "partial_count" in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["extract_provisions", "coverage", "inspect", "merge_flag", "classify_domains", "broken_refs", "page_rollup", "overlap_join",
                                  "route_domains", "context", "hit_at_k", "arrivals_over"])
def test_no_row_python_and_no_cartesian(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(catalog.QUERIES["search_documents"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(catalog.QUERIES["number_key"](spark, SF))
    assert "n_chars" not in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert df.filter(F.col("text") == "").count() == 0


def test_workers_do_not_need_the_package():
    """From another folder the workers cannot import it; the functions they run travel with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from corpusframe.settings import session
from corpusframe.plans import catalog
s = session(master='local[2]', **{{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'}})
print('ROWS', *[catalog.QUERIES[n](s, {SF!r}).count() > 0 for n in ('knn_exemplars', 'knn_grid', 'rate_limit', 'merge_sections')])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="spark-"), env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS True True True True" in out.stdout, out.stderr[-2000:]


def test_the_gate_reads_the_words_of_contents_pages_only(spark):
    filters = [x for x in plan(catalog.QUERIES["section_index"](spark, SF)).split("\n") if "Filter NOT" in x]
    assert filters and not any("schedule" in x or "definition" in x for x in filters)


def test_the_text_is_lowered_once_for_all_keywords(spark):
    lines = [x for x in plan(catalog.QUERIES["keywords"](spark, SF)).split("\n") if "lambdafunction(Contains(" in x]
    assert lines and not any("Contains(lower(" in x for x in lines)
