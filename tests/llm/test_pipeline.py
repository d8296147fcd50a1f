"""The pipeline, stage by stage, and its queries against their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brookline.llm import registry
from tests.compare import connect, same

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    """Every stage takes what the one before kept, and keeps the columns."""
    prose = spark.read.parquet(f"{FOLDER}/documents.parquet")
    near = prose.where("doc_id < 50").withColumn("text", F.concat("text", F.lit(" changed"))).withColumn("doc_id", F.col("doc_id") + 5000)
    docs = docs.unionByName(prose.unionByName(prose.where("doc_id < 50")).unionByName(near), allowMissingColumns=True)
    now, counts = docs, [docs.count()]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, now, FOLDER).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(now.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[4] > 0 and counts[5] >= counts[4]


def test_empty(spark, docs):
    now = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        now = function(spark, now, FOLDER)
        assert now.count() == 0


def test_run_agrees_with_its_stages(spark):
    from brookline.llm import exact_dedup, mixing, packing, quality, similarity_join

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = mixing.repeated(similarity_join.representatives(exact_dedup.survivors(quality.good_documents(docs))))
    want = packing.packed_documents(kept, packing.tokenizer_path()).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, want))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    same(registry.QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).sql(registry.ORACLES[name]).df())


def test_tables_of_runs_in_threads_are_listed_apart(spark):
    """Two runs at the same time: neither lists, and so neither deletes, what the other stages."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from brookline.llm import shared

    meet = Barrier(2)

    def run(n):
        own = []
        with shared.tracked(own):
            meet.wait(timeout=60)
            made = [shared.stage(spark.range(n), f"thread-{n}") for _ in range(2)]
            meet.wait(timeout=60)
        return [t.staged_path for t in own] == [t.staged_path for t in made]

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (1, 2))) == [True, True]
