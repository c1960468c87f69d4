import os

import pytest

import __spark_entry__
import corpus_pipeline
from slotwise.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
TABLE = {"op3_warc": "pages", "op5_topk": "embeddings"}
TABLES = ("documents", "labels", "pages", "embeddings", "conversations", "benchmark")


def test_all_are_registered():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, DIR).collect()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
        want = con.sql(ORACLE_SQL[name])
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.select(*rows[0].asDict()).fetchall()))
    else:
        assert len(rows) == spark.read.parquet(f"{DIR}/{TABLE.get(name, 'documents')}.parquet").count()


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert 0 < len({r.doc_id for r in rows}) <= docs.count()
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, empty texts and extra columns with clashing names; then empty tables."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, base string, `d.e` int, copies int"
    rows = [(1, "one two three four five six", "en", "a", 27, "b", 1, 1), (1, "one two three four five six", "en", "a", 27, "b", 1, 1), (2, None, None, None, None, None, None, None), (None, "mail a@b.com now please or later", None, "a", 3, "x", 2, 2), (None, None, None, None, None, None, None, None), (3, "", "", "", 0, "", 0, 0), (4, "long " * 50_000, "en", "a", 9, "q", 5, 5)]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)] if some else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 4, None} and {r.n_tokens for r in found if r.doc_id in (2, 3)} == {0}
    assert all(len(r.ids) == r.n_tokens for r in found)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_of_empty_tables(spark, tmp_path, name):
    for table in TABLES:
        spark.read.parquet(f"{DIR}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert [r.conv_id for r in QUERIES[name](spark, str(tmp_path)).collect()] == [-1] if name == "op12_chat" else QUERIES[name](spark, str(tmp_path)).count() == 0
