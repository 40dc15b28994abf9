"""The operators' queries against their SQL, and the pipeline against its stages' contracts."""

import duckdb
import pytest

import corpus_pipeline
from tests.test_oracles import SF, TABLES, rows
from tidewater.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).df())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > 0
    ids = docs.groupBy("doc_id").count()
    assert ids.agg({"count": "max"}).first()[0] <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == sizes[3]
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
