"""Rows without a position or key are kept by ordered work, and gaps of any width are laid out in blocks."""

from pyspark.sql import functions as F

from corpusframe.operators import ordered as O
from corpusframe.operators import validate as V


def test_ordered_work_keeps_rows_without_keys_and_positions(spark):
    rows = [("a", 0, 1), ("a", None, 2), ("a", None, 3), ("a", 5, 4), (None, 1, 5), (None, None, 6), (None, 9, 7)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    for block in (2, 100):
        total = O.running_sum(df, ["k"], ["p", "v"], "p", F.col("v"), "s", block=block).collect()
        assert len(total) == len(rows)
        assert {(r.k, r.v): r.s for r in total} == {("a", 2): 2, ("a", 3): 5, ("a", 1): 6, ("a", 4): 10, (None, 6): 6, (None, 5): 11, (None, 7): 18}
        last = O.last_event(df, ["k"], ["p", "v"], "p", F.when(F.col("v") % 2 == 0, F.col("v")), "e", block=block).collect()
        assert len(last) == len(rows) and {(r.k, r.v): r.e for r in last}[("a", 1)] == 2


def test_pages_without_a_number_take_their_place(spark):
    pages = spark.createDataFrame([(1, 0, None, "content", None), (1, 1, 7, "content", "x")], "doc_id long, page_idx int, page_number int, page_type string, raw_text string")
    fixed, issues = V.conform_pages(pages)
    assert [(r.page_number, r.raw_text) for r in fixed.orderBy("page_idx").collect()] == [(1, ""), (7, "x")] and issues.count() == 2


def test_a_wide_gap_is_laid_out_in_blocks(spark):
    pages = spark.createDataFrame([(1, 0, 1), (1, 1, 3 * V.GAP_BLOCK + 5)], "doc_id long, page_idx int, page_number int")
    got = V.page_number_issues(pages)
    assert got.count() == got.select("page_number").distinct().count() == 3 * V.GAP_BLOCK + 3
