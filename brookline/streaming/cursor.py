"""Cursors with more ids than a task may hold: the ids are rows of the store, and their age is a number.

An id is admitted with the next number of its key and leaves when `most` others have been admitted after it, so whether it is remembered
is a comparison of two numbers, and no task needs a key's ids. Of a micro-batch, rows are new whose id is not remembered and has
not come before in the batch. That is all there is to it unless an id that is remembered or comes again could leave within the batch: rows
of such ids of such a key go through one task in their order, as numbers, 16 bytes a row, without the other rows and the ids themselves.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.operators.store import Store, Transaction

#: Prefix sums go by chunks of so many rows, as a power of two.
CHUNK_BITS = 16


def matched(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null is a key like any other."""
    names = {k: f"_{k}_{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return rows.join(other.withColumnsRenamed(names), same, how).drop(*names.values())


def with_before(rows: DataFrame, key: str, value: Column, counts: DataFrame) -> DataFrame:
    """rows with `_before`: their key's count, and the sum of value over its rows that came earlier in the batch. No task has all rows of a key."""
    earlier = lambda c, line: F.coalesce(F.sum(c).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_chunk", F.shiftright("_at", CHUNK_BITS)).withColumn("_value", value)
    sums = matched(rows.groupBy(key, "_chunk").agg(F.sum("_value").alias("_sum")), counts, [key])
    start = sums.select(key, "_chunk", (F.coalesce("n", F.lit(0)) + earlier("_sum", W.partitionBy(key).orderBy("_chunk"))).alias("_start"))  # a row a chunk
    inside = rows.withColumn("_inside", earlier("_value", W.partitionBy(key, "_chunk").orderBy("_at")))
    return matched(inside, start, [key, "_chunk"]).withColumn("_before", F.col("_start") + F.col("_inside")).drop("_chunk", "_value", "_inside", "_start")


def in_turn(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Whether rows are new, one after the other. They are sorted by group and time; _prev is when the id came before, _no its number at the
    start of the batch (-1: none), _before the number of the last row that was admitted, but for those rows that are found to be new here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, more, times, numbers = None, 0, array("q"), array("q")
        for pdf in frames:
            new = []
            for g, at, prev, no, count, fresh in zip(*(pdf[c].tolist() for c in ("_group", "_at", "_prev", "_no", "_before", "_fresh"))):
                if g != group:
                    group, more, times, numbers = g, 0, array("q"), array("q")
                if prev >= 0:
                    no = numbers[bisect_left(times, prev)]
                count += more
                new.append(no < 0 or count - no >= most)
                if new[-1]:
                    no = count + 1
                    more += not fresh
                times.append(at)
                numbers.append(no)
            yield pd.DataFrame({"_at": pdf["_at"], "_new": new})

    return run


def admit(folder: str, key: str, id_: str, most: int, source: str = "admit") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a row whose id is not among the last `most` new ids of its key goes to the table `passed`, as in unseen().

    Rows come in the order of the batch's partitions and of the rows in each. The rows that pass, the cursor and the number of the batch are
    one commit. A batch reads the whole cursor once, so how much it brings should not be little against that; the cursor is kept in
    parts of which each is less than half of those before it, and has at most half as many ids that have left as are in it.
    """

    def write(batch: DataFrame, number: int) -> None:
        def change(tx: Transaction) -> None:
            if tx.manifest["notes"].get(source, -1) >= number:
                return
            tx.manifest["notes"][source] = number
            counts, cursor = tx.read("counts"), tx.read("cursor")
            if counts is None:
                counts = tx.spark.createDataFrame([], T.StructType([T.StructField(key, batch.schema[key].dataType), T.StructField("n", T.LongType())]))
            remembered = lambda some, n: matched(some, n, [key], "inner").where(F.col("_no") > F.col("n") - most).drop("n")

            line = W.partitionBy(key, id_).orderBy("_at")
            rows = batch.withColumn("_at", F.monotonically_increasing_id()).withColumn("_no", F.lit(None).cast("long"))
            if cursor is not None:  # what is remembered comes before the batch, once
                rows = rows.unionByName(remembered(cursor, counts).withColumn("_at", F.lit(-1).cast("long")), allowMissingColumns=True)
            prev = F.lag("_at").over(line)
            seen = rows.withColumns({"_prev": F.when(prev >= 0, prev), "_next": F.lead("_at").over(line), "_no": F.first("_no").over(line)})
            marked, kept = seen.where("_at >= 0").persist(), []
            try:
                fresh = F.col("_no").isNull() & F.col("_prev").isNull()
                keys = marked.groupBy(key).agg(F.min("_at").alias("_group"), F.count_if(fresh).alias("_new"), F.min("_no").alias("_low"), F.max(F.col("_no").isNull() & F.col("_prev").isNotNull()).alias("_again"))
                could_leave = (F.coalesce("n", F.lit(0)) + F.col("_new") - F.col("_low") >= most) | (F.col("_again") & (F.col("_new") > most))
                unsure = matched(keys, counts, [key]).where(could_leave).select(key, "_group")
                told = marked.withColumn("_new", fresh)
                if not unsure.isEmpty():
                    some = with_before(matched(marked.select(key, "_at", "_prev", "_next", "_no"), unsure, [key], "inner"), key, fresh.cast("long"), counts)
                    again = some.where("coalesce(_no, _prev, _next) IS NOT NULL").select("_group", "_at", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("_prev", "_no")], "_before", fresh.alias("_fresh"))
                    turns = again.repartition("_group").sortWithinPartitions("_group", "_at").mapInPandas(in_turn(most), "_at long, _new boolean").persist()
                    kept.append(turns)
                    told = marked.join(turns, "_at", "left").withColumn("_new", F.coalesce("_new", fresh))
                new = told.where("_new")
                n = new.count()
                if n or "passed" not in tx.manifest["schemas"]:
                    tx.append("passed", new.select(*batch.columns))
                if n:
                    admitted = with_before(new.select(key, id_, "_at"), key, F.lit(1).cast("long"), counts).select(key, id_, (F.col("_before") + 1).alias("_no"))
                    after = counts.unionByName(new.groupBy(key).agg(F.count("*").alias("n"))).groupBy(key).agg(F.sum("n").alias("n"))
                    tx.drop("counts", {None})
                    tx.append("counts", after)
                    tx.grow("cursor", admitted, n, lambda some: remembered(some, tx.read("counts")))
            finally:
                for df in (marked, *kept):
                    df.unpersist()

        Store(batch.sparkSession, folder).transact(change)

    return write
