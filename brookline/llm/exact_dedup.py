"""Exact deduplication with an extendible-hash index on shared files; DataFrame operations only.

1. Leaf pages. One scan writes (uid, key, digest, row) to the shared folder: key is a 64-bit hash of the
   normalised text, uid names the row for good. Copies of a text need no shuffle here.
2. Directory. Only keys that two rows or more have need a place in the index. The directory doubles until no bucket holds
   more than `capacity` of these keys: a bucket of depth d is a key prefix of d bits, and the depth of a slot is the least d
   at which its prefix fits. Keys are counted by slot, of SLOT_BITS bits or, where a slot is still too full, more; counts
   for all depths are sums of those. The capacity grows with the keys beyond BUCKETS buckets, so the directory is bounded.
3. Owners. Rows of those keys look up their bucket. Within a bucket and key, texts are compared byte by byte (a hash
   aggregate by bucket, key and the binary text itself; copies are combined on the map side, so a hot text moves once a
   task). Each owner task then takes a range of buckets, chains the different texts that share a key, and writes the chain
   entries to the index in the shared folder.
4. Probe. Every leaf entry looks up its bucket in the directory, and there the entry of its key and digest. What has no
   bucket is alone. Entries of one hot text are split by the adaptive skew join.

Defined cases: a null text is the empty text; all empty texts are copies of each other; a null doc_id is smaller
than any other; rows that tie on the largest doc_id count as copies, and exactly one of them stays; an empty table
gives an empty result; extra columns, whatever their names, travel in a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookline.llm.shared import ascii_lower, col, documents, packed, stage, tasks_for, unpacked, without

CAPACITY, SLOT_BITS, MOST_BITS, BUCKETS = 4096, 16, 56, 1 << 15
#: Bytes up to which the keys with copies, or the directory, are broadcast; beyond, texts are grouped without that filter, and slots are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def leaf_pages(docs: DataFrame, text: str) -> DataFrame:
    norm = F.col("_norm")
    return stage(
        docs.select(F.monotonically_increasing_id().alias("uid"), normalised(col(text)).alias("_norm"), packed(docs)).select("uid", F.xxhash64(norm).alias("key"), F.sha2(norm.cast("binary"), 256).alias("digest"), "row"),
        "dedup-leaves",
    )


@dataclass
class Directory:
    """slot -> (bucket, depth) of the keys in the index; a slot is the first `bits` bits of a key."""

    bits: int
    slots: DataFrame
    n_slots: int

    def look_up(self, df: DataFrame) -> DataFrame:
        """df with the bucket of its key, null if none can hold it."""
        table = self.slots.select("slot", "bucket")
        small = self.n_slots * 24 <= BROADCAST_BYTES
        return df.withColumn("slot", slot_of(F.col("key"), self.bits)).join(F.broadcast(table) if small else table, "slot", "left").drop("slot")


def slot_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def directory(keys: DataFrame, capacity: int) -> Directory:
    """The directory of different keys after as many doublings as the fullest prefix needs."""
    bits = SLOT_BITS
    while True:
        slots = stage(keys.groupBy(slot_of(F.col("key"), bits).alias("slot")).agg(F.count("*").alias("n")), "dedup-slots")
        n_slots, fullest = slots.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
        if fullest <= capacity or bits == MOST_BITS:
            break
        bits += 8
    prefixes = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("node", F.expr(f"shiftleft(1L, depth) + shiftright(slot, {bits} - depth)"))
    fit = prefixes.groupBy("node", "depth").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == bits)).select("node")
    depth = prefixes.join(fit, "node").groupBy("slot").agg(F.min("depth").alias("depth"))
    table = depth.select("slot", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)").alias("bucket"), "depth")
    return Directory(bits, stage(table, "dedup-directory"), n_slots)


def index(leaves: DataFrame, doc_id: str, text: str, capacity: int) -> tuple[Directory, DataFrame]:
    """The directory, and the chain entries (bucket, key, chain, digest, keep_uid, keep_id, group_size) of all keys that several rows share."""
    spark = leaves.sparkSession
    shared = stage(leaves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "dedup-keys")
    n_shared = shared.count()
    capacity = max(capacity, -(-n_shared // BUCKETS))
    found = directory(shared, capacity)
    rows = leaves.select("uid", "key", F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text"))
    if n_shared * 8 <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(shared), "key", "left_semi")
    compared = (
        found.look_up(rows.select("uid", "key", "doc_id", normalised(F.col("text")).cast("binary").alias("bytes")))
        .where("bucket IS NOT NULL")
        .groupBy("bucket", "key", "bytes")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("last"))
        .select("bucket", "key", F.sha2("bytes", 256).alias("digest"), "group_size", F.col("last.uid").alias("keep_uid"), F.col("last.doc_id").alias("keep_id"))
    )
    owned = compared.repartitionByRange(tasks_for(spark, n_shared, 16 * capacity), "bucket", "key")
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy("digest"))
    return found, stage(owned.withColumn("chain", chain), "dedup-index")


def verdicts(leaves: DataFrame, doc_id: str, text: str, capacity: int, *columns: str) -> DataFrame:
    """The given columns of the leaves, with keep_id, group_size, kept and digest (SHA-256 of the normalised text)."""
    places, chains = index(leaves, doc_id, text, capacity)
    probes = places.look_up(leaves.select("uid", "key", "digest", F.col("row").getField(doc_id).alias("_id"), *columns))
    found = probes.join(chains.select("bucket", "key", "digest", "keep_uid", "keep_id", "group_size"), ["bucket", "key", "digest"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        *columns,
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "digest",
        F.col("_id").alias("doc_id"),
        F.col("uid").alias("leaf"),
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """docs in a struct `row`, with keep_id, group_size, kept and digest."""
    return verdicts(leaf_pages(docs, text), doc_id, text, capacity, "row").drop("doc_id", "leaf")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact deduplication keeps, with the columns of docs."""
    leaves = leaf_pages(docs, text)
    gone = stage(verdicts(leaves, doc_id, text, CAPACITY).where(~F.col("kept")).select(F.col("leaf").alias("uid")), "dedup-gone")
    return unpacked(without(leaves.select("uid", "row"), gone))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(leaf_pages(documents(spark, sf_dir, "doc_id", "text"), "text"), "doc_id", "text", CAPACITY)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
