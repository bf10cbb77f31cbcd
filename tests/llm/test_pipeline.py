import duckdb
import pytest

import corpus_pipeline
from tallyspark.llm.catalog import load

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns[: len(columns)] == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.columns == [*columns, "copies"] and docs.where("copies < 1 or copies > 3").count() == 0
    again = corpus_pipeline.run(spark, DIR)
    assert sorted((r.doc_id, r.copies) for r in again.collect()) == sorted((r.doc_id, r.copies) for r in docs.collect())


def test_odd_rows(spark, odd_docs, no_docs):
    bench = f"{DIR}"
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, bench)
        assert out.columns[: len(odd_docs.columns)] == odd_docs.columns
        out.collect()
        assert stage(spark, no_docs, bench).count() == 0


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    queries, sql = load()
    df = queries[name](spark, DIR)
    cur = con.execute(sql[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
