"""Writes on plain Parquet: merges by key, whole replacements, versions that appear at once, exports with manifests."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def without_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those of `gone`; null is a key like any other."""
    other = gone.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return rows.join(other, same, "left_anti")


def one_of_each(batch: DataFrame, keys: list[str], order: Column | None, last: bool) -> DataFrame:
    """The first (else last) row of each key in the order; without one, or of ties, the least (greatest) row by all its columns (maps by their entries)."""
    columns = [F.array_sort(F.map_entries(c)) if kind.startswith("map<") else F.col(c) for c, kind in batch.dtypes]
    rank = F.struct(*([order.alias("_at")] if order is not None else []), *[x.alias(f"_{i}") for i, x in enumerate(columns)])
    best = batch.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(rank.desc() if last else rank.asc())))
    return best.where("_k = 1").drop("_k")


def fresh(known: DataFrame, batch: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of a batch whose key is new, one for each key, the first in the order: the first write wins."""
    return without_keys(one_of_each(batch, keys, order, False), known, keys)


def upsert(known: DataFrame, batch: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The table after a batch that overwrites rows with the same key, the last of them in the order: the last write wins."""
    return without_keys(known, batch, keys).unionByName(one_of_each(batch, keys, order, True))


def upsert_by_rank(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Of rows with equal keys, the one of the highest rank."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(rank.desc()))).where("_k = 1").drop("_k")


def duplicate_counts(known: DataFrame, batch: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How much of a batch was there before, null being a key like any other; the platform is `mixed` if there are several."""
    there = known.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).distinct().withColumn("_had", F.lit(1))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    marked = batch.join(there, same, "left")
    one = F.when(F.min("platform") == F.max("platform"), F.min("platform")).otherwise("mixed")
    return marked.groupBy(*by).agg(one.alias("platform"), F.count("*").alias("received"), F.count("_had").alias("duplicates"))


def equity_instruments(symbols: DataFrame) -> DataFrame:
    name = F.upper("symbol")
    return symbols.select(F.concat(F.lit("us-stock:"), name).alias("instrument_key"), name.alias("display_name"), F.lit("us_equity").alias("asset_class"), F.lit(True).alias("is_active"))


def replace_all(known: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """All rows of one value are replaced by new ones."""
    return known.where(~F.col(column).eqNullSafe(value)).unionByName(new)


def create(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows; a key that exists is an error."""
    if not new.join(known.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("a row with this key exists")
    return known.unionByName(new)


def deactivate(known: DataFrame, column: str, value: str) -> DataFrame:
    return known.withColumn("is_active", F.col("is_active") & ~F.col(column).eqNullSafe(value))


def month_of(df: DataFrame, at: str, first: str) -> DataFrame:
    """Rows of a month, half open: bounds reach the scan."""
    start = F.lit(first).cast("date")
    return df.where((F.col(at) >= start.cast("timestamp")) & (F.col(at) < F.add_months(start, 1).cast("timestamp")))


def manifest(rows: DataFrame, dataset: str, at: str, first: str) -> DataFrame:
    start = F.lit(first).cast("date")
    return rows.agg(F.count("*").alias("row_count"), F.min(at).alias("min_event"), F.max(at).alias("max_event")).select(F.lit(dataset).alias("dataset"), start.alias("range_start"), F.add_months(start, 1).alias("range_end"), "row_count", "min_event", "max_event")


def archived(staged: DataFrame, selected_at: Column, now: Column) -> DataFrame:
    """Staged rows of a selection are marked as archived; later ones, and those marked before, stay as they are."""
    return staged.withColumn("archived_at", F.coalesce("archived_at", F.when(F.col("staged_at") <= selected_at, now)))


def purge(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(~F.coalesce(F.col(at) < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))


# Days that bars of an interval are kept.
BAR_DAYS = {"1h": 180, "1d": 5 * 365}


def purge_bars(bars: DataFrame, as_of: Column) -> DataFrame:
    """Bars that are young enough for their interval; of other intervals, all."""
    gone = F.lit(False)
    for interval, days in BAR_DAYS.items():
        gone = gone | (F.col("interval") == interval) & (F.col("ends_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return bars.where(~F.coalesce(gone, F.lit(False)))


def export(df: DataFrame, folder: str, dataset: str, at: str, first: str) -> DataFrame:
    """Writes a closed month as sorted zstd Parquet under dataset/year/month; the manifest as a table. The month that was there stays until
    the new one is whole."""
    spark = df.sparkSession
    rows = month_of(df, at, first).sort(at)
    year, month = first.split("-")[:2]
    path, draft = f"{folder}/{dataset}/year={year}/month={month}", f"{folder}/.draft-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(draft)
    written = spark.read.parquet(draft)
    content = written.agg(F.bit_xor(F.xxhash64(*written.columns)).alias("x"), F.count("*").alias("n")).first()
    key = hashlib.sha256(f"{dataset}|{first}|{content['x']}|{content['n']}".encode()).hexdigest()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(hadoop.Path(draft), target)
    return manifest(spark.read.parquet(path), dataset, at, first).withColumn("object_key", F.lit(f"{dataset}/{first}-{key[:16]}"))


class Versions:
    """A table as numbered folders, each with a pointer file that names it; the highest pointer is the current version.

    A new version is written whole before its pointer is put in place by one rename that fails if another writer's pointer
    of that number is there. Nothing is ever deleted or overwritten on the way, so a writer that dies at any point leaves the
    version before it, and one that started from a version that is no longer the current one is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(name)

    def current(self) -> int:
        """The number of the current version; 0 before the first."""
        found = self.fs.globStatus(self.path(f"{self.folder}/pointer-*.json"))
        return max((int(f.getPath().getName()[8:-5]) for f in found or []), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an older one."""
        at = f"{self.folder}/pointer-{version or self.current():09}.json"
        name = json.loads("".join(r[0] for r in self.spark.read.text(at).collect()))["folder"]
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def put(self, draft: str, pointer: str) -> None:
        """Rename that does not replace."""
        target = self.path(pointer)
        context = self.hadoop.FileContext.getFileContext(self.fs.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(self.fs.makeQualified(self.path(draft)), self.fs.makeQualified(target), none)

    def publish(self, df: DataFrame, seen: int) -> int:
        """Write df as the version after `seen` and make it the current one. Every attempt has a folder of its own."""
        name = f"v{seen + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        draft = f"{self.folder}/.{uuid.uuid4().hex}.json"
        out = self.fs.create(self.path(draft))
        out.write(bytearray(json.dumps({"folder": name}).encode()))
        out.close()
        try:
            if self.current() != seen:
                raise RuntimeError("another writer has published a version meanwhile")
            self.put(draft, f"{self.folder}/pointer-{seen + 1:09}.json")
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            self.fs.delete(self.path(f"{self.folder}/{name}"), True)
            raise e if isinstance(e, RuntimeError) else RuntimeError("the pointer could not be put in place; another writer may have been first") from e
        return seen + 1
