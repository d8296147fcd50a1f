"""Closed months of the analytical tables as verified, content-addressed Parquet, with their manifest in the store.

A month of a dataset is counted first: rows, bounds of its time, and a digest of its rows that does not depend on their order. Its folder
is named by that digest, so what is there already is not written again, and a month that has changed gets a folder of its own. What
is written is observed on the way, must agree with the count, and comes into place whole by one rename: whoever dies before leaves a
hidden draft only. The manifest, and the marks of archived rows, are one commit of the store.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from brookline.operators import sinks
from brookline.operators.store import Store, Transaction

# The datasets of the archive and the time that each is dealt by.
DATASETS = {
    "hourly_sentiment_facts": "bucket_hour",
    "hourly_sentiment_fact_snapshots": "bucket_hour",
    "hourly_pipeline_quality_facts": "bucket_hour",
    "analytical_signal_snapshots": "as_of",
    "market_hourly_facts": "bucket_hour",
    "market_daily_facts": "bucket_day",
    "model_artifacts": "first_seen_at",
    "model_artifact_aliases": "first_seen_at",
    "raw_post_archive_staging": "event_at",
}
STAGED = "raw_post_archive_staging"
MANIFEST = "dataset string, object_key string, range_start date, range_end date, row_count long, min_event timestamp, max_event timestamp, sha256 string, byte_size long, verified_at timestamp"


def figures(df: DataFrame, at: str) -> list[Column]:
    """Count, bounds of the time, and eight sums over 32 bits of each row's SHA-256."""
    row = F.to_json(F.struct(*[c if not kind.startswith("map<") else F.array_sort(F.map_entries(c)).alias(c) for c, kind in sorted(df.dtypes)]), {"ignoreNullFields": "false"})
    digest = F.sha2(row.cast("binary"), 256)
    lanes = [F.coalesce(F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"lane{i}") for i in range(8)]
    return [F.count("*").alias("row_count"), F.min(at).cast("timestamp").alias("min_event"), F.max(at).cast("timestamp").alias("max_event"), *lanes]


def content(dataset: str, df: DataFrame, found: dict) -> str:
    """The name of a content: dataset, columns, count and digest."""
    told = [dataset, sorted(df.dtypes), found["row_count"], *[found[f"lane{i}"] for i in range(8)]]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def export_month(store: Store, folder: str, dataset: str, df: DataFrame, first: str, now: Column) -> tuple[dict, bool]:
    """Write one month of a dataset, which begins on `first`; (its manifest row, whether anything was written)."""
    at = DATASETS[dataset]
    rows = sinks.month_of(df, at, first)
    found = rows.agg(*figures(rows, at)).first().asDict()
    name = content(dataset, rows, found)
    year, month = first.split("-")[:2]
    key = f"{dataset}/year={year}/month={month}/content={name}"
    target, fresh = store.path(f"{folder}/{key}"), False
    if not store.fs.exists(target):
        draft, seen = f"{folder}/.draft-{uuid.uuid4().hex}", Observation()
        rows.sort(at).observe(seen, *figures(rows, at)).write.option("compression", "zstd").parquet(draft)
        if content(dataset, rows, seen.get) != name:
            store.fs.delete(store.path(draft), True)
            raise RuntimeError(f"{dataset} changed while it was written")
        store.fs.mkdirs(target.getParent())
        try:
            store.put(draft, f"{folder}/{key}")
            fresh = True
        except Exception:
            store.fs.delete(store.path(draft), True)
            if not store.fs.exists(target):  # else another run has written the same
                raise
    start = F.lit(first).cast("date")
    when, until, next_ = store.spark.range(1).select(start, now, F.add_months(start, 1)).first()
    size = store.fs.getContentSummary(target).getLength()
    return {"dataset": dataset, "object_key": key, "range_start": when, "range_end": next_, "row_count": found["row_count"], "min_event": found["min_event"], "max_event": found["max_event"], "sha256": name, "byte_size": size, "verified_at": until}, fresh


def export_all(store: Store, folder: str, tables: dict[str, DataFrame], first: str, selected_at: Column, now: Column) -> tuple[int, int]:
    """Export a month of every table given; of staged rows those that were staged by `selected_at` and are not archived. Manifest and marks
    are one commit. (datasets, how many of them were written)."""
    staged = store.snapshot().read(STAGED)
    pending = (F.col("staged_at") <= selected_at) & F.col("archived_at").isNull()
    inputs = dict(tables) if staged is None else tables | {STAGED: staged.where(pending).drop("archived_at")}
    done = [export_month(store, folder, dataset, df, first, now) for dataset, df in inputs.items()]

    def change(tx: Transaction) -> None:
        rows = tx.spark.createDataFrame([tuple(r[c.split()[0]] for c in MANIFEST.split(", ")) for r, _ in done], MANIFEST)  # one row a dataset
        known = tx.read("archive_manifests")
        if known is None:
            tx.append("archive_manifests", rows)
        else:
            after = sinks.upsert(known, rows, ["object_key"])
            tx.drop("archive_manifests", {None})
            tx.append("archive_manifests", after)
        if staged is not None:
            start = F.lit(first).cast("date")
            days = {d for d in tx.days(STAGED) if d is not None and d[:7] == first[:7]}
            inside = (F.col("event_at") >= start.cast("timestamp")) & (F.col("event_at") < F.add_months(start, 1).cast("timestamp"))
            hits = tx.read(STAGED, days).where(inside & pending).select(F.date_format(F.to_date("event_at"), "yyyy-MM-dd")).distinct()
            days = {r[0] for r in hits.collect()}  # one row a day; days without a row to be marked are left as they are
            marked = tx.read(STAGED, days).withColumn("archived_at", F.coalesce("archived_at", F.when(inside & pending, now)))
            if days:
                tx.replace(STAGED, marked, F.col("event_at"), days)

    store.transact(change)
    return len(done), sum(fresh for _, fresh in done)
