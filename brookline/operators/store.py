"""A store of several tables with one commit for all of them, kept in parts by day, and an index of identities.

A manifest names the parts of every table. A transaction writes new parts beside the old ones, and its commit is one rename that puts
the next manifest in place and fails if another writer's is there: then the change is made again from what that one left. So what
several tables say changes at once or not at all, and a writer that dies leaves the manifest before. Parts are folders of one day of
one table: a change of some days touches no others, and whole days go without being read.

The index finds the days in which identities may be stored. It is made of sorted runs of (hash, day); a commit adds a small run, and
RUNS runs of one tier become one run of the next, so that a store of n batches has about RUNS * log(n) of them, and a key is rewritten
log(n) times. Runs are files of disjoint hash ranges, so a batch opens those few that its hashes fall into, and then only the days that
have them. A hash is a hint: rows are compared by their identity.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.operators import rollup, sinks

Result = TypeVar("Result")
RUNS, ROWS_PER_FILE, PREFIX_BITS, ATTEMPTS = 8, 1_000_000, 12, 20


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Transaction:
    """A change of the store: reads see the manifest it began with; nothing that it writes is seen before its commit."""

    def __init__(self, store: Store, version: int):
        self.store, self.spark, self.version = store, store.spark, version
        self.manifest = store.manifest(version) if version else {"tables": {}, "schemas": {}, "indexes": {}, "notes": {}}
        self.written: list[str] = []
        self.opened: list[str] = []

    def parts(self, table: str) -> list[dict]:
        return self.manifest["tables"].get(table, [])

    def days(self, table: str) -> set[str | None]:
        return {p["day"] for p in self.parts(table)}

    def load(self, paths: list[str], schema: str) -> DataFrame:
        self.opened += paths
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.store.folder}/{p}" for p in paths])

    def read(self, table: str, days: set[str | None] | None = None) -> DataFrame | None:
        """A table, or some days of it; without rows if there are none of those, None if there is no such table."""
        schema = self.manifest["schemas"].get(table)
        if schema is None:
            return None
        paths = [p["path"] for p in self.parts(table) if days is None or p["day"] in days]
        return self.load(paths, schema) if paths else self.spark.createDataFrame([], T.StructType.fromJson(json.loads(schema)))

    def write(self, df: DataFrame, folder: str) -> str:
        path = f"data/{folder}-{uuid.uuid4().hex}"
        self.written.append(path)
        df.write.option("compression", "zstd").parquet(f"{self.store.folder}/{path}") if "_day" not in df.columns else df.hint("rebalance", "_day").write.option("compression", "zstd").partitionBy("_day").parquet(f"{self.store.folder}/{path}")
        return path

    def append(self, table: str, df: DataFrame, day: Column | None = None, **more) -> None:
        """Add rows as new parts, by day if one is given."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        self.manifest["schemas"].setdefault(table, schema.json())
        path = self.write(df if day is None else df.withColumn("_day", F.to_date(day)), table)
        new = [{"path": path, "day": None, **more}]
        if day is not None:
            found = self.store.fs.listStatus(self.store.path(f"{self.store.folder}/{path}"))
            names = [f.getPath().getName() for f in found if f.isDirectory()]
            new = [{"path": f"{path}/{n}", "day": None if n.endswith("__") else n.removeprefix("_day="), **more} for n in names]
        self.manifest["tables"][table] = self.parts(table) + new

    def drop(self, table: str, days: set[str | None]) -> None:
        """Take whole days out, unread."""
        if table in self.manifest["tables"]:
            self.manifest["tables"][table] = [p for p in self.parts(table) if p["day"] not in days]

    def replace(self, table: str, df: DataFrame, day: Column, days: set[str | None]) -> None:
        """New rows in place of all that some days have."""
        old = [p for p in self.parts(table) if p["day"] in days]
        self.append(table, df, day)
        self.manifest["tables"][table] = [p for p in self.parts(table) if p not in old]

    def grow(self, table: str, rows: DataFrame, n: int, kept: Callable[[DataFrame], DataFrame]) -> None:
        """Add n rows as one part, together with the last parts while one is not over twice as large as all after it, less the rows of
        these that are not kept: a table of n rows has about log(n) parts."""
        parts, taken = list(self.parts(table)), []
        while parts and parts[-1]["rows"] <= 2 * n:
            taken.append(parts.pop())
            n += taken[-1]["rows"]
        if taken:
            rows = rows.unionByName(self.load([p["path"] for p in taken], self.manifest["schemas"][table]))
        self.manifest["tables"][table] = parts
        self.append(table, kept(rows))
        last = self.parts(table)[-1]
        last["rows"] = self.load([last["path"]], self.manifest["schemas"][table]).count()

    def found_days(self, index: str, hashed: DataFrame) -> set[str]:
        """Days that may have rows with the hashes of a column `hash`."""
        runs = self.manifest["indexes"].get(index, [])
        if not runs:
            return set()
        prefix = F.shiftright("hash", 64 - PREFIX_BITS)
        touched = {r[0] for r in hashed.select(prefix).distinct().collect()}  # at most 2 ** PREFIX_BITS
        reached = lambda f: any(p in touched for p in range(f["low"] >> (64 - PREFIX_BITS), (f["high"] >> (64 - PREFIX_BITS)) + 1))
        paths = [f["path"] for r in runs for f in r["files"] if reached(f)]
        if not paths:
            return set()
        entries = self.load(paths, T.StructType().add("hash", "long").add("day", "string").json())
        return {r[0] for r in entries.join(hashed.select("hash").distinct(), "hash", "left_semi").select("day").distinct().collect()}  # one row a day

    def add_run(self, index: str, entries: DataFrame, tier: int = 0) -> None:
        """Add (hash, day) to the index, and make one run of RUNS runs of a tier."""
        n = entries.count()
        if n:
            files = -(-n // ROWS_PER_FILE)
            path = self.write((entries.repartitionByRange(files, "hash") if files > 1 else entries.coalesce(1)).sortWithinPartitions("hash"), index)
            seen = self.spark.read.parquet(f"{self.store.folder}/{path}").groupBy(F.input_file_name().alias("f")).agg(F.min("hash"), F.max("hash")).collect()  # one row a file
            run = {"tier": tier, "rows": n, "files": [{"path": f"{path}/{f.rsplit('/', 1)[1]}", "low": low, "high": high} for f, low, high in seen]}
            self.manifest["indexes"][index] = [*self.manifest["indexes"].get(index, []), run]
        same = [r for r in self.manifest["indexes"].get(index, []) if r["tier"] == tier]
        if len(same) >= RUNS:
            rows = self.load([f["path"] for r in same for f in r["files"]], T.StructType().add("hash", "long").add("day", "string").json())
            self.manifest["indexes"][index] = [r for r in self.manifest["indexes"][index] if r not in same]
            self.add_run(index, rows, tier + 1)

    def undo(self) -> None:
        for path in self.written:
            self.store.fs.delete(self.store.path(f"{self.store.folder}/{path}"), True)


class Store(sinks.Versions):
    """Tables that are committed together."""

    def manifest(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"{self.folder}/pointer-{version:09}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Transaction:
        """The store as it is, or was at a version, for reading."""
        return Transaction(self, self.current() if version is None else version)

    def commit(self, tx: Transaction) -> int:
        """Put the transaction's manifest in place as the version after the one it began with."""
        draft = f"{self.folder}/.{uuid.uuid4().hex}.json"
        out = self.fs.create(self.path(draft))
        out.write(bytearray(json.dumps(tx.manifest).encode()))
        out.close()
        try:
            self.put(draft, f"{self.folder}/pointer-{tx.version + 1:09}.json")
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if self.current() > tx.version:
                raise Conflict("another writer has committed meanwhile") from e
            raise
        return tx.version + 1

    def transact(self, change: Callable[[Transaction], Result], attempts: int = ATTEMPTS) -> Result:
        """Make a change and commit it. If another writer was first, it is made again from what that one left."""
        for attempt in range(attempts):
            tx = self.snapshot()
            before = json.dumps(tx.manifest)
            try:
                result = change(tx)
                if json.dumps(tx.manifest) != before:
                    self.commit(tx)
                return result
            except Conflict:
                tx.undo()
                time.sleep(0.05 * attempt)
            except Exception:
                tx.undo()
                raise
        raise Conflict(f"{attempts} attempts were all too late")

    def compact(self, table: str, day: Column, least: int = RUNS) -> set[str | None]:
        """Make one part of the parts of each day that has `least` or more."""

        def change(tx: Transaction) -> set[str | None]:
            found = [p["day"] for p in tx.parts(table)]
            days = {d for d in found if found.count(d) >= least}
            if days:
                tx.replace(table, tx.read(table, days), day, days)
            return days

        return self.transact(change)

    def vacuum(self, keep: int = 10, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Delete what no manifest of the last `keep` versions names and is older: leftovers of dead writers and of old versions."""
        last = self.current()
        named = set()
        for v in range(max(1, last - keep + 1), last + 1):
            m = self.manifest(v)
            paths = [p["path"] for t in m["tables"].values() for p in t] + [f["path"] for i in m["indexes"].values() for r in i for f in r["files"]]
            named |= {p.split("/")[1] for p in paths}
        gone = []
        for f in self.fs.listStatus(self.path(f"{self.folder}/data")) if last else []:
            if f.getPath().getName() not in named and f.getModificationTime() <= time.time() * 1000 - older_than_ms:
                self.fs.delete(f.getPath(), True)
                gone.append(f.getPath().getName())
        return gone


def identity_hash(identity: list[str]) -> Column:
    return F.xxhash64(*identity)


def insert(tx: Transaction, table: str, rows: DataFrame, identity: list[str], at: str) -> int:
    """Add the rows whose identity is not stored yet, one for each, the first by time; how many. Only days that may have them are read."""
    hashed = rows.select(identity_hash(identity).alias("hash"))
    days = tx.found_days(table, hashed)
    known = tx.read(table, days) if days else None
    new = sinks.fresh(rows.limit(0) if known is None else known, rows, identity, F.col(at)).persist()
    try:
        n = new.count()
        if n or table not in tx.manifest["schemas"]:
            tx.append(table, new, F.col(at))
        tx.add_run(table, new.select(identity_hash(identity).alias("hash"), F.date_format(F.to_date(at), "yyyy-MM-dd").alias("day")))
        return n
    finally:
        new.unpersist()


def retention(store: Store, cutoff: Column, as_of: Column, run_id: str, platforms: list[str], rate: float, engagement: int = 100, signal: float = 0.8) -> tuple[int, int]:
    """One retention run over posts, facts, label facts, snapshots and staged samples, in one commit; (hours folded, posts pruned).

    Days before the cutoff's are dropped whole, its own is rewritten; facts are rewritten on the days of what was folded only.
    A run that meets another one's commit starts again from there, so no post is folded twice and none is lost."""
    first = store.spark.range(1).select(F.date_format(F.date_trunc("hour", cutoff), "yyyy-MM-dd")).first()[0]

    def change(tx: Transaction) -> tuple[int, int]:
        days = {d for d in tx.days("posts") if d is not None and d <= first}
        posts = tx.read("posts", days)
        if not days or posts.where(F.col("timestamp") < F.date_trunc("hour", cutoff)).isEmpty():
            return 0, 0
        none = rollup.post_facts(posts.limit(0))
        facts, labels = tx.read("facts", days), tx.read("labels", days)
        fresh = rollup.post_facts(posts.where(F.col("timestamp") < F.date_trunc("hour", cutoff))).persist()  # read three times
        try:
            done = rollup.retain(posts, none if facts is None else facts, rollup.label_facts(none) if labels is None else labels, cutoff, as_of, run_id, platforms, rate, engagement, signal, fresh, ("timestamp",))
            counts = fresh.agg(F.countDistinct(F.struct("symbol", "bucket_hour")).alias("rolled_up"), F.coalesce(F.sum("post_count"), F.lit(0)).alias("pruned")).first()
            hour, seen = F.col("bucket_hour"), tx.read("staged", days)
            tx.replace("facts", done.facts, hour, days)
            tx.replace("labels", done.labels, hour, days)
            tx.append("snapshots", done.snapshots, hour)
        finally:
            fresh.unpersist()
        tx.append("staged", done.staged if seen is None else sinks.without_keys(done.staged, seen, ["platform", "id", "symbol", "cohort"]), F.col("timestamp"))
        tx.drop("posts", days - {first})
        tx.replace("posts", tx.read("posts", {first}).where(F.col("timestamp") >= F.date_trunc("hour", cutoff)), F.col("timestamp"), {first})
        return counts["rolled_up"], counts["pruned"]

    return store.transact(change)
