"""Exports: content addresses, repeats, changes, crashes, marks of archived rows."""

import pytest
from pyspark.sql import functions as F

from brookline.operators import archive
from brookline.operators.store import Store
from brookline.plans.operations import archived_rows
from brookline.sources.views import Tables

NOW = "2026-03-02 00:00:00"
MONTH = "2026-02-01"


def time(text):
    return F.lit(text).cast("timestamp")


def export(store, place, tables, selected=NOW):
    return archive.export_all(store, str(place), tables, MONTH, time(selected), time(NOW))


def facts(spark, *rows):
    return spark.createDataFrame(rows, "symbol string, bucket_hour string, n int").withColumn("bucket_hour", F.col("bucket_hour").cast("timestamp"))


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet") if not any(x.startswith(".") for x in p.relative_to(path).parts))


@pytest.fixture
def place(tmp_path):
    return tmp_path / "archive"


def test_a_second_run_writes_nothing_and_a_change_has_its_own_folder(spark, tmp_path, place):
    store = Store(spark, str(tmp_path / "store"))
    rows = [("A", "2026-01-31 23:00:00", 1), ("A", "2026-02-01 00:00:00", 2), ("B", "2026-02-28 23:00:00", None), ("B", "2026-02-28 23:00:00", None), ("B", "2026-03-01 00:00:00", 4)]
    tables = {"hourly_sentiment_facts": facts(spark, *rows)}
    assert export(store, place, tables) == (1, 1)
    first = files(place)
    again = {"hourly_sentiment_facts": facts(spark, *reversed(rows)).repartition(3)}  # the same rows, dealt otherwise
    assert export(store, place, again) == (1, 0) and files(place) == first
    m = store.snapshot().read("archive_manifests").collect()
    assert len(m) == 1 and m[0].row_count == 3 and str(m[0].min_event) == "2026-02-01 00:00:00" and m[0].byte_size > 0 and m[0].object_key.endswith(m[0].sha256)
    assert sorted(r.n or 0 for r in spark.read.parquet(str(place / "hourly_sentiment_facts")).collect()) == [0, 0, 2]
    changed = {"hourly_sentiment_facts": facts(spark, *rows[:3])}  # one of two equal rows is gone
    assert export(store, place, changed) == (1, 1)
    assert store.snapshot().read("archive_manifests").count() == 2 and set(first) < set(files(place))
    none = {"hourly_sentiment_facts": facts(spark, *rows[:1])}
    assert export(store, place, none) == (1, 1)
    assert store.snapshot().read("archive_manifests").where("row_count = 0").first().min_event is None


class Died(BaseException):
    """A writer that is gone."""


def test_a_crash_leaves_no_partial_month(spark, tmp_path, place, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    tables = {"hourly_sentiment_facts": facts(spark, ("A", "2026-02-01 00:00:00", 2)), "model_artifacts": facts(spark, ("A", "2026-02-01 00:00:00", 2)).withColumnRenamed("bucket_hour", "first_seen_at")}
    real, puts = Store.put, []

    def die(self, draft, target):
        puts.append(target)
        if len(puts) == 2:
            raise Died
        real(self, draft, target)

    monkeypatch.setattr(Store, "put", die)
    with pytest.raises(Died):
        export(store, place, tables)
    monkeypatch.undo()
    assert [f.split("/")[0] for f in files(place)] == ["hourly_sentiment_facts"] and store.current() == 0
    assert export(store, place, tables) == (2, 1)  # what was in place is taken over
    assert store.snapshot().read("archive_manifests").count() == 2


def test_rows_staged_later_are_left_for_the_next_run(spark, tmp_path, place):
    store = Store(spark, str(tmp_path / "store"))
    staged = spark.createDataFrame([("1", "2026-02-03", "2026-02-04"), ("2", "2026-02-03", "2026-02-20"), ("3", "2026-01-03", "2026-01-04")], "id string, event_at string, staged_at string")
    staged = staged.withColumns({c: F.col(c).cast("timestamp") for c in ("event_at", "staged_at")} | {"archived_at": F.lit(None).cast("timestamp")})
    store.transact(lambda tx: tx.append(archive.STAGED, staged, F.col("event_at")))
    marks = lambda: {r.id: r.archived_at is not None for r in store.snapshot().read(archive.STAGED).collect()}
    assert export(store, place, {}, "2026-02-10 00:00:00") == (1, 1)
    assert marks() == {"1": True, "2": False, "3": False}
    assert export(store, place, {}) == (1, 1)
    assert marks() == {"1": True, "2": True, "3": False}
    assert sorted(r.id for r in spark.read.parquet(str(place / archive.STAGED)).collect()) == ["1", "2"]


def test_days_without_a_row_to_be_marked_are_not_rewritten(spark, tmp_path, place):
    store = Store(spark, str(tmp_path / "store"))
    staged = spark.createDataFrame([("1", "2026-02-03", "2026-02-04"), ("2", "2026-02-05", "2026-02-20")], "id string, event_at string, staged_at string")
    staged = staged.withColumns({c: F.col(c).cast("timestamp") for c in ("event_at", "staged_at")} | {"archived_at": F.lit(None).cast("timestamp")})
    store.transact(lambda tx: tx.append(archive.STAGED, staged, F.col("event_at")))
    parts = lambda: {p["day"]: p["path"] for p in store.snapshot().parts(archive.STAGED)}
    before = parts()
    export(store, place, {}, "2026-02-10 00:00:00")
    after = parts()
    assert after["2026-02-05"] == before["2026-02-05"] and after["2026-02-03"] != before["2026-02-03"]
    export(store, place, {}, "2026-02-10 00:00:00")
    assert parts() == after


def test_marks_of_the_query_end_with_the_selection(spark, tmp_path):
    """Posts come in half a minute after their time: one in time to the second, one a second late, one that is not staged."""
    rows = [(1, "2024-01-19 23:59:30", 50), (2, "2024-01-19 23:59:31", 50), (3, "2024-01-01 00:00:00", 49), (4, None, 99)]
    events = spark.createDataFrame(rows, "event_id long, ts string, k int")
    events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.to_json(F.struct("k")).alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.archived_at and str(r.archived_at) for r in archived_rows(Tables(spark, str(tmp_path))).collect()}
    assert got == {"1": "2024-01-31 00:00:00", "2": None, "4": None}
