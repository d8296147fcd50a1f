"""The store: one commit for all tables, conflicts, writers that die, the index of identities."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from brookline.operators import store as S

IDENTITY = ["platform", "id", "symbol"]


def posts(spark, ids, day=1, hour=10):
    """Posts of one symbol, one a minute."""
    rows = [(str(i), "A", "bluesky", f"2026-03-{day:02} {hour:02}:{i % 60:02}:00", "positive", 0.8, 0.1, 0.1, 1, 3) for i in ids]
    schema = "id string, symbol string, platform string, timestamp string, sentiment string, p_pos double, p_neu double, p_neg double, topic_id int, engagement int"
    at = F.col("timestamp").cast("timestamp")
    return spark.createDataFrame(rows, schema).withColumns({"timestamp": at, "ingested_at": at, "scored_at": at, "topic_model_hash": F.lit("t"), "sentiment_model_hash": F.lit("s"), "topic_label": F.lit("x")})


def put(store, rows):
    return store.transact(lambda tx: S.insert(tx, "posts", rows, IDENTITY, "timestamp"))


def run(store, cutoff, name="r", **more):
    return S.retention(store, F.lit(cutoff).cast("timestamp"), F.lit("2026-04-01 00:00:00").cast("timestamp"), name, ["bluesky"], 1.0, **more)


def state(store):
    now = store.snapshot()
    count = lambda t, c: (now.read(t).agg(F.sum(c)).first()[0] or 0) if now.read(t) is not None else 0
    return count("posts", F.lit(1)), count("facts", "post_count"), count("labels", "positive_count"), count("snapshots", "post_count"), count("staged", F.lit(1))


def test_two_retention_runs_at_once_fold_each_post_once(spark, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path))
    put(store, posts(spark, range(40)))
    start, real = Barrier(2), S.Store.commit
    waited = []

    def together(self, tx):
        if len(waited) < 2:  # both have made their change before either commits
            waited.append(1)
            start.wait(timeout=120)
        return real(self, tx)

    monkeypatch.setattr(S.Store, "commit", together)
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda n: run(store, "2026-03-01 12:00:00", n), ("a", "b")))
    assert sorted(done) == [(0, 0), (1, 40)]
    assert state(store) == (0, 40, 40, 40, 40)


def test_an_insert_during_retention_is_not_lost(spark, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path))
    put(store, posts(spark, range(10)))
    real = S.Store.commit

    def late(self, tx):
        monkeypatch.setattr(S.Store, "commit", real)
        put(self, posts(spark, range(10, 15)))
        return real(self, tx)

    monkeypatch.setattr(S.Store, "commit", late)
    assert run(store, "2026-03-01 12:00:00") == (1, 15)
    assert state(store)[:2] == (0, 15)


class Died(BaseException):
    """A writer that is gone: it cleans nothing up."""


@pytest.mark.parametrize("nth", range(6))
def test_a_crash_between_any_two_writes_shows_the_old_state(spark, tmp_path, monkeypatch, nth):
    """Five tables are written, then the manifest."""
    store = S.Store(spark, str(tmp_path))
    put(store, posts(spark, range(6)))
    before, real, writes = state(store), S.Transaction.write, []

    def write(self, df, folder):
        if len(writes) == nth:
            raise Died
        writes.append(folder)
        return real(self, df, folder)

    monkeypatch.setattr(S.Transaction, "write", write)
    if nth == 5:
        monkeypatch.setattr(S.Store, "put", lambda *_: (_ for _ in ()).throw(Died()))
    with pytest.raises(Died):
        run(store, "2026-03-01 12:00:00")
    monkeypatch.undo()
    again = S.Store(spark, str(tmp_path))
    assert len(writes) == nth and again.current() == 1 and state(again) == before
    assert again.vacuum(older_than_ms=-60_000) == [] or nth  # what the dead writer left is found
    assert run(again, "2026-03-01 12:00:00") == (1, 6) and state(again) == (0, 6, 6, 6, 6)


def test_retention_rewrites_the_cutoffs_day_only(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    for day in (1, 2, 3, 4):
        put(store, posts(spark, range(day * 10, day * 10 + 4), day).unionByName(posts(spark, range(day * 10 + 4, day * 10 + 6), day, 20)))
    kept = {p["path"] for p in store.snapshot().parts("posts") if p["day"] > "2026-03-03"}
    assert run(store, "2026-03-03 15:30:00") == (5, 16)
    assert kept <= {p["path"] for p in store.snapshot().parts("posts")}
    facts = {p["path"] for p in store.snapshot().parts("facts") if p["day"] < "2026-03-03"}
    put(store, posts(spark, [99], 3, 9))  # late, of an hour before the cutoff
    assert run(store, "2026-03-03 15:30:00", "s") == (1, 1)
    assert facts <= {p["path"] for p in store.snapshot().parts("facts")}
    assert state(store)[:2] == (8, 17)


def test_a_batch_opens_files_by_its_size_not_by_that_of_the_store(spark, tmp_path):
    store, opened = S.Store(spark, str(tmp_path)), []

    def insert(rows):
        tx = store.snapshot()
        n = S.insert(tx, "posts", rows, IDENTITY, "timestamp")
        opened.append(len(tx.opened))
        store.commit(tx)
        return n

    for k in range(20):
        assert insert(posts(spark, range(k * 5, k * 5 + 5), k + 1)) == 5
    # new posts open index files alone, and these are log(n) runs: at the 8th and the 16th batch eight become one
    assert max(opened) <= 2 * S.RUNS and max(opened[9:15]) <= S.RUNS and opened[17] < opened[7]
    assert len(store.snapshot().manifest["indexes"]["posts"]) == 2 + 4
    # delivered again at another time: still the same posts, found in the one day that has them
    assert insert(posts(spark, [7, 8, 200], 25)) == 1
    assert opened[-1] <= 2 + 4 + 1
    assert store.snapshot().read("posts").count() == 101


def test_compaction_and_old_versions(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    for k in range(3):
        put(store, posts(spark, [k]))
    assert store.compact("posts", F.col("timestamp"), least=3) == {"2026-03-01"}
    assert len(store.snapshot().parts("posts")) == 1 and store.snapshot().read("posts").count() == 3
    assert store.snapshot(3).read("posts").count() == 3
    assert store.compact("posts", F.col("timestamp"), least=3) == set()
    assert len(store.vacuum(keep=1, older_than_ms=-60_000)) == 3 and store.snapshot().read("posts").count() == 3
    assert put(store, posts(spark, [1])) == 0


def test_identities_with_nulls_and_repeated_rows(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    odd = posts(spark, [1, 1, 2]).withColumn("symbol", F.when(F.col("id") == "2", F.lit(None)).otherwise(F.col("symbol")))
    assert put(store, odd) == 2 and put(store, odd) == 0
    assert put(store, odd.limit(0)) == 0 and store.snapshot().read("posts").count() == 2


def test_a_sample_keeps_posts_without_a_symbol(spark, tmp_path):
    """Samples take their time from the post itself, not from a join that a null symbol would not find."""
    store = S.Store(spark, str(tmp_path))
    put(store, posts(spark, range(4)).withColumn("symbol", F.when(F.col("id") != "0", F.col("symbol"))))
    run(store, "2026-03-01 12:00:00")
    staged = store.snapshot().read("staged").where("cohort = 'probability'")
    assert sorted((r.id, r.timestamp.minute) for r in staged.collect()) == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]
