"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm.shared import stage, unstage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node links its larger (else its smaller) neighbours, and itself, to the least node it sees."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    if not larger:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if larger:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Each round is written to the shared folder, so neither lineage nor memory grows; nothing is collected but a
    checksum. Rounds end when nothing changes any more, after about log(diameter) of them.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    before = None
    while True:
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(sums) == before or not sums[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = tuple(sums)
        tidy = _star(_star(now, True), False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        done, now = now, stage(tidy, "cc")
        unstage(done)
