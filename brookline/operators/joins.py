"""Joins in time: latest row, row before, as-of by a window instead of an inequality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], name: str = "latest") -> DataFrame:
    """One row for each key, as a struct: the last in order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias(name))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order, of ties the least by all columns."""
    rest = [c for c in df.columns if c not in order]
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the row before of each key. Without keys all rows are one line: for short series only, such as one row a day."""
    return df.withColumn(name, F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))


def carry(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, bucket: Column | None = None, backward: bool = False, current: bool = True) -> DataFrame:
    """df with the last value (not NULL) of each key's line up to, or before, each row; backward: the first value after it.

    bucket: a coarse step of the order, such as the day. A line is then sorted bucket by bucket, and what a bucket begins
    with comes from the buckets' last values, so that a key with a third of all rows is still spread over many tasks.
    """
    turn = (lambda c: F.desc(c)) if backward else (lambda c: F.asc(c))
    end = 0 if current else -1
    line = [turn(c) for c in order]
    if bucket is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*line).rowsBetween(W.unboundedPreceding, end)))
    rows = df.withColumn("_bucket", bucket)
    inside = F.last(value, ignorenulls=True).over(W.partitionBy(*keys, "_bucket").orderBy(*line).rowsBetween(W.unboundedPreceding, end))
    edge = F.min_by if backward else F.max_by
    last = rows.groupBy(*keys, "_bucket").agg(edge(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = last.withColumn("_begin", F.last("_last", ignorenulls=True).over(W.partitionBy(*keys).orderBy(turn("_bucket")).rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    joined = rows.withColumn("_inside", inside).join(before, [*keys, "_bucket"])
    return joined.withColumn(name, F.coalesce("_inside", "_begin")).drop("_bucket", "_inside", "_begin")


def _both(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, first: int) -> DataFrame:
    """Rows of both sides; at equal times those of right are at place `first`, those of left at the other one."""
    mine = left.withColumn("_side", F.lit(1 - first)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(True))
    return mine.unionByName(right.select(*keys, at, F.lit(first).alias("_side"), F.col(value).alias("_v"), F.lit(False).alias("_left")), allowMissingColumns=True)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """left with right's last value at or before (strict: before) its own time; NULL where there is none.

    Both sides are put in one line per key and the last value is carried along it, which needs sorts but no pairs.
    """
    both = _both(left, right, keys, at, value, 1 if strict else 0)
    return carry(both, keys, [at, "_side"], "_v", value, bucket).where("_left").drop("_side", "_v", "_left")


def first_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, bucket: Column | None = None) -> DataFrame:
    """left with right's first value strictly after its own time."""
    both = _both(left, right, keys, at, value, 0)
    return carry(both, keys, [at, "_side"], "_v", value, bucket, backward=True).where("_left").drop("_side", "_v", "_left")


def bracket(events: DataFrame, closes: DataFrame, keys: list[str], at: str, value: str, bucket: Column | None = None) -> DataFrame:
    """events with the last value strictly before and the first strictly after them."""
    before = as_of(events, closes, keys, at, value, strict=True, bucket=bucket).withColumnRenamed(value, "before")
    return first_after(before, closes, keys, at, value, bucket).withColumnRenamed(value, "after")


def returns(closes: DataFrame, keys: list[str], at: str, close: str) -> DataFrame:
    """(keys, at, r): change of consecutive closes that are both positive; a gap still pairs with its immediate predecessor."""
    before = F.lag(close).over(W.partitionBy(*keys).orderBy(at))
    both = closes.withColumn("r", F.when((before > 0) & (F.col(close) > 0), F.col(close) / before - 1))
    return both.where("r IS NOT NULL").select(*keys, at, "r")


def forward_pairs(factor: DataFrame, stock: DataFrame, lags: Column, key: str = "pair") -> DataFrame:
    """(key, lag, at, x, y): each factor return with the stock return that is `lag` closes after the first one strictly later."""
    line = W.partitionBy(key).orderBy("at")
    numbered = stock.withColumn("rn", F.row_number().over(line))
    firsts = first_after(factor.withColumnRenamed("r", "x"), numbered.select(key, "at", "rn"), [key], "at", "rn").where("rn IS NOT NULL")
    wanted = firsts.withColumn("lag", F.explode(lags)).withColumn("rn", F.col("rn") + F.col("lag"))
    return wanted.join(numbered.select(key, "rn", F.col("r").alias("y")), [key, "rn"]).select(key, "lag", "at", "x", "y")
