"""Sharding by proportional stratified interleaving; DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source. Row r of a source with n rows gets the fractional
rank (r - u) / n, with u in (0, 1) a seeded hash of the source, so that every source is spread evenly over [0, 1), and
small sources, of which each has a few ranks only, are spread by chance and do not meet at the same ones. Sorting by
fractional rank interleaves the sources in proportion, and cutting the line into equal pieces gives shards that each hold
the mixture of the whole.

Ranks and positions come from running_rank(): counts of hash buckets, prefix sums, then an order within one bucket,
so a source with a third of all rows is never sorted in one task. The law is `rows`: shard counts differ by one at most.

Defined cases: a null text has no bytes; a null source is a source of its own; repeated rows get places of their own,
in any order among themselves; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm.shared import bucket_of, col, documents, running_rank, stage

SHARDS, SEED, ROWS_PER_BUCKET = 40, 20240131, 5_000


def seeded(seed: int, value: Column) -> Column:
    """52 bits of a seeded hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), value)), 1, 13), 16, 10).cast("long")


def place(docs: DataFrame, doc_id: str, text: str, source: str, shards: int, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, source, shard and slot."""
    bytes_ = F.coalesce(col(text), F.lit("")).cast("binary")
    crc = F.crc32(bytes_)
    line: list[Column | str] = ["_h", F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    hashed = seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    thin = stage(
        docs.select(col(source).alias("source"), col(doc_id).alias("doc_id"), (F.octet_length(bytes_) + 16).cast("long").alias("size"), crc.alias("text_crc32")).withColumn("_h", hashed),
        "shard-rows",
    )
    n = thin.count()
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    unit = F.col("_h") / F.lit(float(1 << 52))
    ranked = running_rank(thin.withColumn("_b", bucket_of(unit, buckets)), ["source"], "_b", [F.col(c) if isinstance(c, str) else c for c in line])
    phase = (seeded(seed, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))) + F.lit(0.5)) / F.lit(float(1 << 52))
    rank = ranked.withColumn("_frac", (F.col("before") + phase) / F.col("whole")).drop("before", "whole", "_b")
    rank = stage(rank.withColumn("_b", bucket_of(F.col("_frac"), buckets)), "shard-ranks")
    placed = running_rank(rank, [], "_b", [F.col("_frac"), F.col("_h"), F.col("source"), *line[1:]])
    shard = F.expr(f"(before * {shards}) div whole")
    first = F.expr(f"((before * {shards}) div whole * whole + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "source", shard.cast("int").alias("shard"), (F.col("before") - first).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(documents(spark, sf_dir, "doc_id", "text", "source"), "doc_id", "text", "source", SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


# CRC-32 has no function in DuckDB: the table is built from the polynomial, and the bytes are folded through it.
SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(coalesce(text, '')) + 1), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i - 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h,
    (('0x' || substr(md5('{SEED}|' || coalesce('=' || source, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM documents, crc
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1 + u) / count(*) OVER (PARTITION BY source) AS frac FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY frac, h, source, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r
), s AS (
  SELECT *, pos * {SHARDS} // n AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, pos - (shard * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard, source FROM s
"""
