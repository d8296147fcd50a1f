"""Cursors in the store against one that takes the rows one by one."""

import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brookline.plans.streams import evicted_ids
from brookline.sources.views import Tables
from brookline.streaming import cursor, stages

SCHEMA = "id string, n long, key string"


def one_by_one(batches, most):
    ids, out = defaultdict(list), []
    for id_, n, key in (r for rows in batches for r in rows):
        if id_ not in ids[key][-most:]:
            ids[key].append(id_)
            out.append(n)
    return out


def run(spark, folder, batches, most):
    write = cursor.admit(folder, "key", "id", most)
    for k, rows in enumerate(batches):
        write(spark.createDataFrame(rows, SCHEMA).coalesce(1), k)
    return sorted(r.n for r in stages.read(spark, folder, "passed").collect())


@pytest.mark.parametrize("most, of", [(1, 3), (5, 8), (40, 60), (1000, 400)])
def test_rows_pass_as_one_by_one(spark, tmp_path, monkeypatch, most, of):
    """Ids that leave within the batch, come again in it, or both; null is a key and an id; chunks of four rows."""
    monkeypatch.setattr(cursor, "CHUNK_BITS", 2)
    rng, batches, n = random.Random(most), [], 0
    for size in (60, 1, 90, 40, 150):
        rows = []
        for _ in range(size):
            x, n = rng.randrange(of), n + 1
            rows.append((None if x == 2 else str(x), n, rng.choice(["a", "a", "a", "b", None])))
        batches.append(rows)
    want = one_by_one(batches, most)
    assert n > len(want) > 0 and run(spark, str(tmp_path), batches, most) == want


def test_each_id_displaces_the_next(spark, tmp_path):
    """A new id displaces the oldest, which comes next and displaces the next: nothing but their order tells that all of them are new. As many in the other order are not."""
    up = lambda xs, n, key: [(str(x), n + i, key) for i, x in enumerate(xs)]
    batches = [up(range(50), 0, "a") + up(range(50), 100, "b"), up([99, *range(50)], 200, "a") + up([*range(49, -1, -1), 99], 300, "b")]
    want = one_by_one(batches, 50)
    assert run(spark, str(tmp_path), batches, 50) == sorted(want) and len([n for n in want if 200 <= n < 300]) == 51 and want[-1] == 350


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    write, rows = cursor.admit(str(tmp_path), "key", "id", 2), spark.createDataFrame([("1", 1, "a"), ("2", 2, "a"), ("3", 3, "a")], SCHEMA).coalesce(1)
    for number in (0, 0, 1, 1):
        write(rows, number)
    assert sorted(r.n for r in stages.read(spark, str(tmp_path), "passed").collect()) == [1, 1, 2, 2, 3, 3]


def test_the_cursor_stays_in_few_parts(spark, tmp_path):
    """12 batches of 20 new ids and a cursor of 50: few parts, and few ids that have left."""
    run(spark, str(tmp_path), [[(str(20 * k + i), 20 * k + i, "a") for i in range(20)] for k in range(12)], 50)
    tx = stages.Store(spark, str(tmp_path)).snapshot()
    kept = tx.read("cursor")
    assert len(tx.parts("cursor")) <= 3 and kept.count() == sum(p["rows"] for p in tx.parts("cursor")) <= 95
    assert kept.where("_no > 190").count() == 50 and tx.read("counts").first().n == 240


def test_no_state_has_a_keys_ids(spark, tmp_path, monkeypatch):
    """20,000 ids of one key, 10,000 of which are remembered."""
    monkeypatch.setattr(stages, "scratch", lambda _: str(tmp_path / "run"))
    spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in evicted_ids(Tables(spark, str(tmp_path))).collect()] == [("view", 30_000)]
    state = [f.stat().st_size for f in Path(tmp_path / "run").rglob("*") if f.is_file() and "state" in f.parts]
    assert max(state, default=0) < 10_000
