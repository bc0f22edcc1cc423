"""The pipeline against the operators' brute-force versions, and the registered queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, normal
from corpusframe.llm import bpe, quality_rules, secrets
from corpusframe.llm.queries import ORACLES, QUERIES
from tests.llm.test_joins import classes, contaminated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetch_df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES


def test_pipeline_against_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = [(r.doc_id, r.cleaned if r.n_lines_removed else r.text) for r in quality_rules.measure(source).collect() if r.kept]
    least = classes(kept)
    kept = [(i, t) for i, t in kept if least[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not contaminated(t, items)[4]]
    assert set(got) == {i for i, _ in kept} and 0 < len(got) < source.count()
    library = tokenizers.Tokenizer.from_file(bpe.default_file())
    for i, t in kept:
        strong, linked = secrets.spans_of(t)
        text = secrets.redact(t, strong + linked)
        assert got[i].text == text and got[i].ids == library.encode(text, add_special_tokens=False).ids


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
