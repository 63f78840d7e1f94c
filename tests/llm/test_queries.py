import pytest
from parity import assert_same
from pyspark.sql import functions as F
from test_similar import plain_survivors

import corpus_pipeline
from lodestrata.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, name):
    assert_same(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name], small)


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")} == set(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    toxic = corpus_pipeline.drop_toxic(spark, docs, small)
    clean = corpus_pipeline.drop_junk(spark, docs, small)
    assert toxic.columns == clean.columns == names and 0 < toxic.count() <= docs.count() and 0 < clean.count() <= docs.count()
    single = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    want = {i for i, _ in plain_survivors([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert single.columns == names and sorted(r["doc_id"] for r in single.collect()) == sorted(want)
    packed = corpus_pipeline.pack_sequences(spark, single, small)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == want


def test_pipeline_runs_whole_and_on_no_rows(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("__score", F.lit("own")).withColumn("score", F.lit(7)).withColumn("row", F.lit(8))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_junk, corpus_pipeline.drop_near_duplicates):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.select("__score", "score", "row").distinct().collect() == [("own", 7, 8)]
