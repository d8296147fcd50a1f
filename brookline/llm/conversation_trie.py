"""Prefix trie of conversations, built level by level, and what sharing prefixes would save.

1. Turns. Ranges of (conversation, turn) give every turn its position from prefix sums of counts, so a conversation with a
   third of all rows is never ordered in one task. A turn's identity is a SHA-256 of its role and text; texts stay where they are.
2. Rebuilding. Conversation c takes the first h turns of conversation c - c % 20, then its own after its first h.
3. Levels, downwards. Per depth, the live conversations are grouped by (parent node, next turn); a node is named by its smallest
   conv_id. Members of a node whose conversations are equal to the end (a lone conversation, or copies of one) leave: the chain
   below such a node has no fork, and all of it is written at once. Equality is that of a tree of SHA-256 over at
   most FAN turns at a time. So there are as many levels as the deepest fork asks for, however long conversations are.
4. Levels, upwards. From the deepest level to the root, each level is joined with the sums of the one below it.
5. Ends. The decimal ids of the conversations that end at a node are joined in chunks of at most CHUNK ids, in parallel; a
   node of several chunks has them hashed as they come, one after the other, and none is held whole.

Defined cases: null role and text are empty strings; a null turn comes first; turns with equal numbers are ordered by their
SHA-256; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; a conversation
may be left without turns and then ends at the root; an empty table gives an empty result, without a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm.shared import LONG, ROWS_PER_RANGE, WORD, col, running_rank, stage, unstage, word_count
from brookline.session import spread

BASE, HEADS = 20, 4
#: Turns hashed together in a conversation's digest, and ids of one chunk of a node's ends.
FAN, CHUNK = 1000, 1 << 16
#: Nodes with more ends than this have them dealt into chunks.
MANY_ENDS = 10_000
NOTHING = hashlib.sha256().hexdigest()


def sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words, whole): every turn with its place, from 1, in its conversation of `whole` turns."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), word_count(text).alias("words"))
    rows = stage(rows.withColumn("_m", F.monotonically_increasing_id()), "trie-rows")
    parts = -(-rows.count() // ROWS_PER_RANGE)
    line = [F.col("turn").asc_nulls_first(), F.col("key"), F.col("_m")]
    ranged = rows.withColumn("_range", F.lit(0)) if parts <= 1 else stage(rows.repartitionByRange(parts, F.col("conv_id"), *line).withColumn("_range", F.spark_partition_id()), "trie-ranges")
    return running_rank(ranged, ["conv_id"], "_range", line).select("conv_id", (F.col("before") + 1).alias("pos"), "key", "words", "whole")


def rebuilt(turns: DataFrame, base: int = BASE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Staged tables (conv_id, pos, key, words) and (conv_id, n_turns) of the rebuilt conversations."""
    turns = stage(turns, "trie-positions")
    own = turns.groupBy("conv_id").agg(F.first("whole").alias("_own"))
    b = F.col("conv_id") - F.col("conv_id") % base
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    bases = own.where(F.col("conv_id") % base == 0).select(F.col("conv_id").alias("_b"), F.col("_own").alias("_base"))
    plan = own.withColumns({"_b": b, "_h": h}).join(bases, "_b", "left").withColumn("_shared", F.least("_h", F.coalesce("_base", F.lit(0)).cast("long")))
    plan = stage(plan.select("conv_id", "_b", "_h", "_shared", (F.col("_shared") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("n_turns")), "trie-plan")
    first = turns.where((F.col("conv_id") % base == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("_b"), "pos", "key", "words")
    shared = plan.where("_shared > 0").join(first, "_b").where("pos <= _h").select("conv_id", "pos", "key", "words")
    rest = turns.join(plan, "conv_id").where("pos > _h").select("conv_id", (F.col("_shared") + F.col("pos") - F.col("_h")).alias("pos"), "key", "words")
    lines = stage(shared.union(rest), "trie-turns")
    convs = plan.select("conv_id", "n_turns")
    unstage(turns)
    return lines, convs


def digested(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """convs with a digest of all turns in order: a tree of hashes over at most FAN at a time."""
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    level = turns.select("conv_id", (F.col("pos") - 1).alias("_p"), F.col("key").alias("digest"))
    while True:
        parts = F.sort_array(F.collect_list(F.struct("_p", "digest")))  # at most FAN of 32 bytes
        level = level.groupBy("conv_id", F.expr(f"_p div {FAN}").alias("_p")).agg(sha(F.array_join(F.transform(parts, lambda x: F.hex(x["digest"])), "").cast("binary")).alias("digest"))
        longest = -(-longest // FAN)
        if longest <= 1:
            break
    return convs.join(level.drop("_p"), "conv_id", "left").withColumn("digest", F.coalesce("digest", F.lit(b"")))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of (depth, conv_id, member)."""
    many = ends.groupBy("depth", "conv_id").count().where(F.col("count") > MANY_ENDS).select("depth", "conv_id", F.lit(True).alias("_many"))
    chunk = F.when(F.col("_many"), F.floor(F.col("member") / F.lit(float(CHUNK))).cast("long")).otherwise(0)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")  # at most CHUNK
    chunks = stage(ends.join(many, ["depth", "conv_id"], "left").groupBy("depth", "conv_id", "_many", chunk.alias("_chunk")).agg(ids.alias("_ids")), "trie-ends")
    few = chunks.where("_many IS NULL").select("depth", "conv_id", F.sha2(F.col("_ids").cast("binary"), 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def done(key, sum_) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([sum_.hexdigest()])], names=["depth", "conv_id", "ends_sha256"])

        for batch in batches:
            for depth, conv, ids in zip(*[batch.column(c) for c in ("depth", "conv_id", "_ids")]):
                key = (depth.as_py(), conv.as_py())
                if key == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        yield done(at, digest)
                    at, digest = key, hashlib.sha256()
                digest.update(ids.as_py().encode())
        if at is not None:
            yield done(at, digest)

    lines = chunks.where("_many").repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "_chunk").select("depth", "conv_id", "_ids")
    return few.unionByName(lines.mapInArrow(run, "depth long, conv_id long, ends_sha256 string"))


def levels(turns: DataFrame, convs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Downwards: staged nodes of each level with forks, and (conv_id, n_turns, node, depth, uniform) of its members."""
    nodes, members = [], []
    live = convs.select("conv_id", "n_turns", "digest", F.lit(None).cast("long").alias("node"))
    while True:
        depth = len(nodes)
        if depth:
            step = live.join(turns.where(F.col("pos") == depth).select("conv_id", "key", "words"), "conv_id")
        else:
            step = live.withColumns({"key": F.lit(b""), "words": F.lit(0).cast("long")})
        step = stage(step, "trie-step")
        groups = step.groupBy("node", "key").agg(
            F.min("conv_id").alias("id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.max("n_turns").alias("last"),
            (F.min(F.struct("n_turns", "digest")) == F.max(F.struct("n_turns", "digest"))).alias("uniform"),
        )
        groups = stage(groups, "trie-nodes")
        names = groups.select(F.col("node").alias("_n"), F.col("key").alias("_k"), "id", "uniform")
        same = F.col("node").eqNullSafe(F.col("_n")) & (F.col("key") == F.col("_k"))
        members.append(stage(step.join(names, same).select("conv_id", "n_turns", "digest", F.col("id").alias("node"), F.lit(depth).cast("long").alias("depth"), "uniform"), "trie-members"))
        unstage(step)
        nodes.append(groups)
        live = members[-1].where(~F.col("uniform") & (F.col("n_turns") > depth)).drop("depth", "uniform")
        if live.isEmpty():
            return nodes, members


def chains(turns: DataFrame, uniform: DataFrame) -> DataFrame:
    """Nodes below the uniform nodes: depth, conv_id, n_convs, n_children, saved_tokens, and `below`, the words of a chain of several conversations."""
    tops = uniform.where("last > depth").select(F.col("id").alias("conv_id"), F.col("depth").alias("_top"), "n_convs", "last")
    line = turns.join(tops, "conv_id").where("pos > _top").select("conv_id", F.col("pos").alias("depth"), "n_convs", "words", (F.col("pos") < F.col("last")).cast("long").alias("n_children"))
    alone = line.where("n_convs = 1").withColumns({"saved_tokens": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
    several = line.where("n_convs > 1").withColumn("_b", F.expr(f"depth div {ROWS_PER_RANGE}"))
    several = running_rank(several, ["conv_id"], "_b", [F.col("depth")], "words")
    several = several.select(*line.columns, ((F.col("n_convs") - 1) * (F.col("whole") - F.col("before"))).alias("saved_tokens"), F.col("whole").alias("below"))
    return alone.unionByName(several).drop("words")


def trie(conversations: DataFrame, base: int = BASE, heads: int = HEADS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    turns, convs = rebuilt(positions(conversations), base, heads)
    nodes, members = levels(turns, digested(turns, convs))
    uniform = reduce(DataFrame.union, [n.where("uniform").withColumn("depth", F.lit(d).cast("long")) for d, n in enumerate(nodes)])
    chain = stage(chains(turns, uniform), "trie-chains")
    below = chain.where("n_convs > 1").groupBy("conv_id").agg(F.first("below").alias("_below"))
    done, under = [], None
    for depth, level in reversed(list(enumerate(nodes))):
        own = (F.col("n_convs") - 1) * F.col("words")
        flat = level.where("uniform").join(below, level["id"] == below["conv_id"], "left").select(
            F.col("id").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", (F.col("last") > depth).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), (own + (F.col("n_convs") - 1) * F.coalesce("_below", F.lit(0))).alias("saved_tokens"),
        )
        forks = level.where("NOT uniform")
        if under is not None:
            sums = under.groupBy(F.col("parent_conv_id").alias("_p")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_saved"))
            forks = forks.join(sums, forks["id"] == sums["_p"]).select(F.col("id").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (own + F.col("_saved")).alias("saved_tokens"))
            flat = flat.unionByName(forks)
        under = stage(flat.withColumn("depth", F.lit(depth).cast("long")), "trie-sums")
        done.append(under)
    tails = chain.select("conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", "n_children", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", "depth")
    ends = reduce(DataFrame.union, [m.where((F.col("n_turns") == F.col("depth")) | F.col("uniform")).select(F.col("n_turns").alias("depth"), F.col("node").alias("conv_id"), F.col("conv_id").alias("member")) for m in members])
    out = reduce(DataFrame.unionByName, [*done, tails]).join(ends_hashed(ends), ["depth", "conv_id"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


# CRC-32 has no function in DuckDB: the table is built from the polynomial, and the digits are folded through it.
SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), r AS (
  SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, n, conv_id - conv_id % {BASE} AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} AS h FROM (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id), crc
), t AS (
  SELECT c.conv_id, pos, k, words FROM c JOIN r ON r.conv_id = c.b AND pos <= h
  UNION ALL SELECT c.conv_id, least(h, coalesce(x.n, 0)) + pos - h, k, words FROM c JOIN r USING (conv_id) LEFT JOIN (SELECT conv_id AS x_id, n FROM c) x ON x_id = c.b WHERE pos > h
), q AS (
  SELECT c.conv_id, coalesce(list(k ORDER BY pos) FILTER (k IS NOT NULL), []) AS l, coalesce(list(words ORDER BY pos) FILTER (k IS NOT NULL), []) AS w FROM c LEFT JOIN t USING (conv_id) GROUP BY c.conv_id
), p AS (SELECT *, unnest(range(0, len(l) + 1)) AS depth FROM q),
n AS (
  SELECT depth, list_slice(l, 1, depth) AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(first(w[depth]), 0) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(l) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL
), m AS (
  SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = list_slice(n.path, 1, n.depth - 1)
), k AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k USING (depth, conv_id)),
a AS (SELECT path[1:top] AS path, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN a USING (path)
"""
