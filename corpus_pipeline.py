"""The corpus pipeline: quality rules, exact copies, near copies, source mixture, token sequences.

Each stage takes the documents that the one before kept and returns documents with the same columns; the last returns
the places of their pieces in token sequences. A document that the mixture takes twice is there twice from then on.
"""

from __future__ import annotations

import threading
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from brookline.llm import exact_dedup, mixing, packing, quality, similarity_join
from brookline.llm.shared import stage, tracked, unstage

#: The intermediate tables of the run that is going on, set by run().
_own: ContextVar[list[DataFrame] | None] = ContextVar("tables of the run", default=None)
#: The same for stages that are called one by one, by application, folder and thread.
_others: dict[tuple, list[DataFrame]] = {}


def step(function):
    """A stage that first deletes what the one before it in the same run staged: its result has been written when the next is called."""

    @wraps(function)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = _own.get()
        if used is None:
            used = _others.setdefault((spark.sparkContext.applicationId, sf_dir, threading.get_ident()), [])
        files = docs.inputFiles()  # whoever chains stages without writing still needs what docs reads
        needed = [t for t in used if any(t.staged_path in f for f in files)]
        unstage(*[t for t in used if all(t is not n for n in needed)])
        used[:] = needed
        with tracked(used):
            return function(spark, docs, sf_dir)

    return run_step


@step
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality.good_documents(docs)


@step
def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, the one with the largest doc_id."""
    return exact_dedup.survivors(docs)


@step
def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return similarity_join.representatives(docs)


@step
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, as often as it takes them."""
    return mixing.repeated(docs)


@step
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    return packing.packed_documents(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", good),
    ("exact dedup", unique),
    ("n-gram Jaccard join", dissimilar),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Neither expectation-maximisation nor tokenizers can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = _own.set([])  # what the last stage stages is left: the result still reads it
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for i, (_, function) in enumerate(STAGES):
            docs = function(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = stage(docs, f"pipeline-{i}")
        return docs
    finally:
        _own.reset(token)
