"""The shared folder for intermediate tables, and the helpers that several operators use."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.session import shared_folder, spread

#: A word of the contracts, as a pattern that Java, DuckDB and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Where the tables staged by this thread's run are listed.
_tracked: ContextVar[list[DataFrame] | None] = ContextVar("staged tables", default=None)
_folders: set[str] = set()


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete an application's intermediate tables, if its session still lives."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended, and nobody is left to ask
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/brookline/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(delete_at_exit, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if (listed := _tracked.get()) is not None:
        listed.append(out)
    return out


@contextmanager
def tracked(tables: list[DataFrame]) -> Iterator[None]:
    """Tables staged inside are added to the list, for whoever can tell when they are done with."""
    token = _tracked.set(tables)
    try:
        yield
    finally:
        _tracked.reset(token)


def without(df: DataFrame, gone: DataFrame, key: str = "uid", most: int = 32 << 20) -> DataFrame:
    """df without the keys of a staged table, which is broadcast if it is smaller than `most` bytes."""
    return df.join(F.broadcast(gone) if gone.count() * 8 <= most else gone, key, "left_anti")


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go as soon as each query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no result reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(df.select(*columns) if columns else df)


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, *own: Column, name: str = "row") -> DataFrame:
    """The columns packed() put away, then the operator's own."""
    fields = df.schema[name].dataType.fieldNames()
    return df.select(*[F.col(name).getField(f).alias(f) for f in fields], *own)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; a text without other letters takes the faster road."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words of the text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tasks_for(spark: SparkSession, items: int, per_task: int) -> int:
    """Partitions so that each holds about per_task items, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // per_task))


def bucket_of(unit: Column, n: int) -> Column:
    """Bucket 0..n-1 of a value in [0, 1)."""
    return F.least(F.floor(unit * n), F.lit(n - 1)).cast("int")


def running_rank(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str | None = None) -> DataFrame:
    """Adds, per keys and in the order (bucket, then order), `before`: the rows (or the sum of value) that come first, and `whole`: all of them.

    No group is ever sorted in one task: a first aggregation gives every bucket's total, its prefix sums are
    joined back, and only one bucket at a time is ordered. bucket must rise with order.
    """
    from pyspark.sql import Window as W

    amount = F.col(value) if value else F.lit(1).cast("long")
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).cast("long").alias("_total"))
    line = W.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket)
    prefix = totals.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col(bucket).alias("_bucket"),
        F.coalesce(F.sum("_total").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_total").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("whole"),
    )
    inner = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    on = F.col(bucket) == F.col("_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return ranked.join(prefix, on).withColumn("before", F.col("_offset") + F.col("_inside")).drop("_inside", "_offset", "_bucket", *[f"_{k}" for k in keys])


def ordered_rank(df: DataFrame, order: list[Column], *values: str) -> DataFrame:
    """running_rank() over all rows in any order: adds `before` and `whole`, for each value before_<value> and whole_<value>.

    Ranges of the order, of ROWS_PER_RANGE rows or so, are the buckets, so no task sorts all rows.
    """
    parts = -(-df.count() // ROWS_PER_RANGE)
    if parts <= 1:
        ranked = df.withColumn("_range", F.lit(0))
    else:
        ranked = stage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    for v in values or [None]:
        ranked = running_rank(ranked, [], "_range", order, v)
        if v:
            ranked = ranked.withColumnsRenamed({"before": f"before_{v}", "whole": f"whole_{v}"})
    return ranked.drop("_range")


LONG, INT, DOUBLE, STRING, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
