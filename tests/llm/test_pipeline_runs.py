"""Runs of the pipeline in one session don't disturb each other."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_a_second_run_leaves_the_first_ones_result(spark):
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.STAGES[0][1](spark, docs, SF)  # a chain that begins in between
    rows = sorted(map(tuple, first.collect()))
    assert rows and rows == sorted(map(tuple, second.collect()))
