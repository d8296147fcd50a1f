"""Importance resampling towards a target distribution over hashed words, in two Arrow passes.

Pass one. Each partition counts its features by bucket with np.bincount and gives one vector of `buckets` counts, whatever its
size; treeReduce adds the vectors up, so that the driver sees a few of them only. Documents and target are counted alike.

Pass two. The gain of a bucket, the log ratio of its smoothed shares in the target and in the documents, is broadcast as
one array of `buckets` numbers. Each batch of texts gathers the gains of its features and sums them by document with
np.bincount and weights. Texts do not move in either pass, and no column of a document but its text is read by Python.

A document's weight is the floored mean of its gains; its score adds Gumbel noise from a hash of its id, so that taking the
highest scores draws without replacement in proportion to exp(weight / 1000). Scores are whole numbers, so their counts
and prefix sums rank the documents, and only documents of one score are ordered in one task.

Words are runs of 0-9, a-z and all beyond ASCII, after A-Z is lower-cased; a feature is a run of one to `longest` words.

Defined cases: a null or empty text has no feature, weight 0 and is never drawn; a null doc_id hashes as the empty string
and comes after all others in ties; repeated rows are drawn each for itself; without target texts all gains come from
the documents alone; an empty table gives an empty result; extra columns, whatever their names, travel in a struct.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.shared import LONG, LOWER, UPPER, col, documents, packed, running_rank, stage, unpacked
from brookline.session import spread

BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Bytes of a text that are split into words at a time, and features that are summed at a time.
BLOCK, AT_ONCE = 1 << 20, 1 << 20
#: Bytes as they are in words, A-Z lower-cased, a space for what no word has.
IN_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: bytes | None, buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of a text: how many words begin there, and the bucket of each feature that ends there."""
    data = (text or b"").translate(IN_WORDS)
    at, tail = 0, []
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        line = tail + words
        found = [np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets]
        for n in range(2, longest + 1):
            runs = [b" ".join(line[i - n : i]) for i in range(max(n, len(tail) + 1), len(line) + 1)]
            found.append(np.fromiter(map(zlib.crc32, runs), dtype=np.int64, count=len(runs)) % buckets)
        yield len(words), np.concatenate(found)
        tail, at = line[len(line) - longest + 1 :] if longest > 1 else [], end


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, found in features(value.as_py(), buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select(col(text).cast("binary")).mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], dtype=np.int64))
    return vectors.treeReduce(np.add, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, dtype=np.int64)


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares, rounded down."""
    n, t_all, s_all = len(target), float(target.sum() + len(target)), float(source.sum() + len(source))
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * s_all / ((float(source[i]) + 1) * t_all))) for i in range(n)], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, text: str = "text", longest: int = LONGEST, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) in a struct `row`, then n_features, n_words and weight."""
    given = docs.select(packed(docs.select(*[col(c) for c in carry]) if carry else docs), col(text).cast("binary").alias("_text"))
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), *[T.StructField(c, LONG) for c in ("n_features", "n_words", "weight")]])
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n = batch.num_rows
            count, words, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            owners, held = [], []

            def add() -> None:
                owner = np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in held])
                sums = np.bincount(owner, weights=gain[np.concatenate(held)], minlength=n)
                total[:] += sums.astype(np.int64)
                count[:] += np.bincount(owner, minlength=n)
                owners.clear()
                held.clear()

            waiting = 0
            for i, value in enumerate(batch.column("_text")):
                for n_words, found in features(value.as_py(), len(gain), longest):
                    words[i] += n_words
                    owners.append(i)
                    held.append(found)
                    waiting += len(found)
                    if waiting >= AT_ONCE:
                        add()
                        waiting = 0
            if held:
                add()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(count), pa.array(words), pa.array(total // np.maximum(count, 1))], names=schema.fieldNames())

    return given.mapInArrow(run, schema)


def drawn(table: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed() with score and rank (1 is the highest score; null if not drawn): `percent` of the documents with `least` words or more."""
    id_ = F.col("row").getField(doc_id)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    table = stage(table.withColumn("score", (F.col("weight") + noise).cast("long")), "resampling-scores")
    some = table.where(F.col("n_words") >= least)
    take = some.count() * percent // 100
    ranked = running_rank(some.withColumn("_b", -F.col("score")), [], "_b", [id_.asc_nulls_last(), F.col("n_features"), F.col("weight")])
    ranked = ranked.withColumn("rank", F.when(F.col("before") < take, F.col("before") + 1)).drop("_b", "before", "whole")
    return ranked.unionByName(table.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """The documents drawn, with all their columns."""
    gains = bucket_gains(bucket_counts(target, target_text, longest=longest), bucket_counts(docs, text, longest=longest))
    return unpacked(drawn(weighed(docs, gains, text, longest), doc_id, percent).where("rank IS NOT NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = documents(spark, sf_dir, "doc_id", "text"), spread(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    gains = bucket_gains(bucket_counts(target), bucket_counts(docs))
    return drawn(weighed(docs, gains, carry=["doc_id"])).select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(upper=UPPER, lower=LOWER)
# CRC-32 has no function in DuckDB: the table is built from the polynomial, and the bytes are folded through it.
SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
f AS (SELECT r, unnest(words) AS w FROM d), g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc
), s AS (SELECT bucket, count(*) AS n FROM f JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM g JOIN v USING (w) GROUP BY bucket),
gain AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + {BUCKETS} FROM s)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + {BUCKETS} FROM t)::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), m AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN v USING (w) JOIN gain USING (bucket) GROUP BY r),
k AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN m USING (r)
), o AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FILTER (n_features >= {LEAST_WORDS}) * {PERCENT} // 100 FROM k) THEN place END AS rank FROM o
"""
