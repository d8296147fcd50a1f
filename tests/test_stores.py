"""Merges, versions, exports and streams."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookline.operators import rollup, sinks
from brookline.sources.views import Tables
from brookline.streaming import stages
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(2, 7), st.integers(0, 6))
def test_facts_merge(spark, modulus, rest):
    """Facts of two parts merge into the facts of the whole, however it is split."""
    posts = Tables(spark, FOLDER).posts.limit(300)
    part = F.col("id").cast("long") % modulus == rest
    merged = rollup.merge_facts(rollup.post_facts(posts.where(part)), rollup.post_facts(posts.where(~part)))
    same(merged.toPandas(), rollup.post_facts(posts).toPandas())


def test_late_post_and_boundary(spark):
    row = lambda i, at, s, e: (str(i), "NVDA", "bluesky", at, s, 0.1, 0.1, 0.8, 1, e)
    schema = "id string, symbol string, platform string, timestamp string, sentiment string, p_pos double, p_neu double, p_neg double, topic_id int, engagement int"
    posts = spark.createDataFrame([row(1, "2024-01-01 16:45:00", "negative", 3), row(2, "2024-01-01 18:00:00", "positive", 1)], schema)
    posts = posts.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumns({"ingested_at": F.col("timestamp"), "scored_at": F.col("timestamp"), "topic_model_hash": F.lit("t"), "sentiment_model_hash": F.lit("s"), "topic_label": F.lit("x")})
    none = rollup.post_facts(posts.limit(0))
    ln2, ln4 = 0.6931471805599453, 1.3862943611198906
    legacy = spark.createDataFrame([("NVDA", "2024-01-01 16:00:00", 1, 0, 0, ln2, 0.0, 0.0, ln2, 1.0)], "symbol string, bucket_hour string, positive_count long, neutral_count long, negative_count long, positive_weighted double, neutral_weighted double, negative_weighted double, total_weighted double, sentiment_index double").withColumn("bucket_hour", F.col("bucket_hour").cast("timestamp"))
    cutoff, now = F.lit("2024-01-01 18:20:00").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp")
    first = rollup.retain(posts, none, legacy, cutoff, now, "r", ["bluesky"], 1.0)
    assert tuple(first.counts.first()) == (1, 1)
    assert [r.id for r in first.posts.collect()] == ["2"]
    assert first.labels.first().sentiment_index == pytest.approx((ln2 - ln4) / (ln2 + ln4))
    fact = first.facts.first()
    assert (fact.post_count, fact.negative_prob_sum) == (1, 0.8)
    assert fact.signal_sum == pytest.approx(-0.7) and fact.weight_sum == pytest.approx(ln4)
    assert first.snapshots.count() == 1 and first.staged.count() == 1
    again = rollup.retain(first.posts, first.facts, first.labels, cutoff, now, "r2", [], 0.0)
    assert tuple(again.counts.first()) == (0, 0) and again.snapshots.count() == 0


def test_price_merge(spark):
    q = lambda *rows: spark.createDataFrame(rows, "timestamp string, price double, volume long, market_session string").select(F.lit("X").alias("symbol"), F.col("timestamp").cast("timestamp").alias("timestamp"), "price", "volume", "market_session", F.lit("p").alias("provider"))
    old = rollup.price_facts(q(("2024-01-02 15:05:00", 100.0, 10, "pre"), ("2024-01-02 15:30:00", 105.0, 20, "regular")), "hour")
    r = old.first()
    assert (r.open_price, r.high_price, r.low_price, r.close_price, r.last_volume, r.observation_count, r.had_regular_session) == (100, 105, 100, 105, 20, 2, True)
    m = rollup.merge_price_facts(old, rollup.price_facts(q(("2024-01-02 15:45:00", 103.0, 25, "after")), "hour"), "hour").first()
    assert (m.open_price, m.high_price, m.low_price, m.close_price, m.last_volume, m.observation_count, m.had_regular_session) == (100, 105, 100, 103, 25, 3, True)
    tie = rollup.merge_price_facts(old, rollup.price_facts(q(("2024-01-02 15:05:00", 90.0, 1, "pre"), ("2024-01-02 15:30:00", 95.0, 2, "pre")), "hour"), "hour").first()
    assert (tie.open_price, tie.close_price) == (100, 95)


def test_broken_facts_are_reported(spark):
    facts = rollup.post_facts(Tables(spark, FOLDER).posts.limit(20)).withColumn("post_count", F.lit(-1).cast("long")).withColumn("weight_sum", F.lit(-5.0))
    counts = facts.agg(*[F.count_if(c).alias(k) for k, c in rollup.fact_violations().items()]).first()
    assert counts["counts"] > 0 and counts["weights"] > 0 and counts["time order"] == 0


def test_versions(spark, tmp_path):
    v = sinks.Versions(spark, str(tmp_path / "t"))
    assert v.current() == 0
    v.publish(spark.range(3), 0)
    v.publish(v.read().where("id > 0"), 1)
    assert v.current() == 2 and v.read().count() == 2 and v.read(1).count() == 3
    with pytest.raises(RuntimeError):
        v.publish(spark.range(1), 1)
    with pytest.raises(Exception):  # noqa: B017
        v.publish(spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), 2)
    assert v.current() == 2 and v.read().count() == 2


class Died(BaseException):
    """A writer that is gone: it cleans nothing up."""


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    v = sinks.Versions(spark, str(tmp_path / "t"))
    v.publish(spark.range(3), 0)

    def die(*_):
        raise Died

    monkeypatch.setattr(v, "put", die)
    with pytest.raises(Died):
        v.publish(spark.range(9), 1)
    after = sinks.Versions(spark, str(tmp_path / "t"))
    assert after.current() == 1 and after.read().count() == 3
    assert after.publish(spark.range(5), 1) == 2 and after.read().count() == 5


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    """Both see the same version before either puts its pointer in place."""
    a, b = (sinks.Versions(spark, str(tmp_path / "t")) for _ in range(2))
    a.publish(spark.range(1), 0)
    monkeypatch.setattr(b, "current", lambda: 1)
    a.publish(spark.range(2), 1)
    with pytest.raises(RuntimeError):
        b.publish(spark.range(3), 1)
    assert a.current() == 2 and a.read().count() == 2


def test_merges_with_repeated_and_null_keys(spark):
    rows = lambda *x: spark.createDataFrame(x, "k string, at int, v string")
    known, batch = rows(("a", 0, "old"), (None, 0, "old"), ("z", 0, "old")), rows(("a", 1, "x"), ("a", 2, "y"), (None, 5, "n"), ("b", 3, "p"), ("b", 3, "q"))
    for b in (batch, batch.orderBy(F.desc("v")).repartition(3)):
        got = sinks.upsert(known, b, ["k"], F.col("at")).collect()
        assert {tuple(r) for r in got} == {("a", 2, "y"), (None, 5, "n"), ("b", 3, "q"), ("z", 0, "old")} and len(got) == 4
        new = sinks.fresh(known, b, ["k"], F.col("at")).collect()
        assert [tuple(r) for r in new] == [("b", 3, "p")]
    assert [tuple(r) for r in sinks.fresh(known.limit(0), batch, ["k"]).where("k IS NULL").collect()] == [(None, 5, "n")]


def test_export_and_create(spark, tmp_path):
    posts = Tables(spark, FOLDER).posts
    a = sinks.export(posts, str(tmp_path), "posts", "timestamp", "2024-01-01").first()
    assert a.row_count == posts.count() and a.object_key.startswith("posts/2024-01-01-")
    assert sinks.export(posts, str(tmp_path), "posts", "timestamp", "2023-12-01").first().row_count == 0
    known = spark.createDataFrame([("A",)], "symbol string")
    with pytest.raises(ValueError):
        sinks.create(known, known, ["symbol"])
    assert sinks.create(known, spark.createDataFrame([("B",)], "symbol string"), ["symbol"]).count() == 2


def test_store_isolates_and_repeats(spark, tmp_path):
    post = {"id": "1", "symbol": "A", "platform": "p", "text": "good strong rally", "timestamp": "2024-01-01T00:00:00Z"}
    messages = spark.createDataFrame([(json.dumps(post),), (json.dumps(post | {"id": "2"}),), ("{bad",)], "value string")
    good, dead = stages.decode(messages)
    assert dead.count() == 1 and dead.first().error == "malformed JSON"
    now = F.lit("2024-01-02").cast("timestamp")
    scored = stages.scored(stages.cleaned(good, now), stages.lexicon_scorer, now)
    assert {r.sentiment for r in scored.collect()} == {"positive"}
    broken = scored.withColumn("scores", F.when(F.col("id") == "2", F.create_map(F.lit("positive"), F.lit(2.0))).otherwise(F.col("scores")))
    write = stages.store(str(tmp_path))
    write(broken, 0)
    write(scored, 1)
    write(scored, 1)
    assert sorted(r.id for r in stages.read(spark, str(tmp_path), "posts").collect()) == ["1", "2"]
    assert stages.read(spark, str(tmp_path), "dead").count() == 1
    assert [r.duplicates for r in stages.read(spark, str(tmp_path), "quality").orderBy("batch").collect()] == [0, 1]
    again, buried = stages.retry_or_bury(scored.withColumn("attempt", F.when(F.col("id") == "1", 1)), F.col("text"), "s", F.lit("e" * 900))
    assert again.first().attempt == 1 and len(buried.first().error) == 500
    topics = stages.classified(scored, F.array(*[F.lit(x) for x in (0.1, 0.9)]), now).first()
    assert (topics.topic_id, topics.topic_label) == (1, "Fed & Macro")


def test_transient_failures_are_raised_and_tried_again(spark, tmp_path, monkeypatch):
    post = {"id": "1", "symbol": "A", "platform": "p", "text": "good strong rally", "timestamp": "2024-01-01T00:00:00Z"}
    good, _ = stages.decode(spark.createDataFrame([(json.dumps(post),)], "value string"))
    scored = stages.scored(good, stages.lexicon_scorer, F.lit("2024-01-02").cast("timestamp"))
    write = stages.store(str(tmp_path))
    real = sinks.fresh
    monkeypatch.setattr(sinks, "fresh", lambda *_: (_ for _ in ()).throw(ConnectionError("busy")))
    with pytest.raises(ConnectionError):
        write(scored, 0)
    assert stages.read(spark, str(tmp_path), "dead") is None
    monkeypatch.setattr(sinks, "fresh", real)
    write(scored, 0)
    write(scored, 1)
    assert stages.read(spark, str(tmp_path), "posts").count() == 1


def test_ids_leave_in_the_order_in_which_they_came(spark, tmp_path):
    """More ids than are remembered: the oldest is new again, a younger one is not."""
    source = tmp_path / "in"
    for i, ids in enumerate((range(5), [1, 4], [0])):
        spark.createDataFrame([("k", str(x)) for x in ids], "key string, id string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("key string, id string").parquet(str(source))
        stages.drain(stages.unseen(stream, "key", "id", 4), str(tmp_path / "q"))
    seen = sorted(r.id for r in spark.read.parquet(str(tmp_path / "q" / "out")).collect())
    assert seen == sorted(["0", "1", "2", "3", "4", "0"])  # 0 had left; 1 and 4 had not


def test_a_large_cursor_takes_no_longer_for_an_id():
    """300,000 ids displace others of 1,000,000, which took minutes when each of them moved the whole cursor."""
    from collections import deque
    from time import process_time

    ids = deque(range(1_000_000))
    known, before = set(ids), process_time()
    assert all(stages.admitted(range(1_000_000, 1_300_000), ids, known, 1_000_000)) and process_time() - before < 10
    assert ids[0] == 300_000 and len(ids) == len(known) == 1_000_000
    assert stages.admitted([300_000, 0, 0], ids, known, 1_000_000) == [False, True, False]


def test_a_publish_that_fails_is_delivered_again(spark, tmp_path):
    """Ids count as seen when the sink has taken them, not before."""
    spark.createDataFrame([("k", str(x)) for x in range(5)], "key string, id string").write.parquet(str(tmp_path / "in"))
    out, tries = [], []

    def publish(batch, number):
        tries.append(number)
        if len(tries) == 1:
            raise ConnectionError("not confirmed")
        out.extend(r.id for r in batch.collect())

    stream = lambda: stages.unseen(spark.readStream.schema("key string, id string").parquet(str(tmp_path / "in")), "key", "id")
    with pytest.raises(Exception, match="not confirmed"):
        stages.drain(stream(), str(tmp_path / "q"), publish)
    stages.drain(stream(), str(tmp_path / "q"), publish)
    stages.drain(stream(), str(tmp_path / "q"), publish)
    assert sorted(out) == list("01234") and tries[:2] == [0, 0]


def test_a_lagging_listener_skips(spark, tmp_path):
    from brookline.streaming import stateful

    schema = "channel string, listener string, at timestamp, id string, payload string, most long"
    row = lambda i: ("c", None, None, f"{i:03}", f"m{i}", None)
    batches = [[row(i) for i in range(3)] + [("c", "a", None, None, None, 2)], [row(i) for i in range(3, 9)] + [("c", "a", None, None, None, 9), ("c", "b", None, None, None, 1)], [("c", "b", None, None, None, 9)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stages.drain(stateful.fan_out(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buffer=4), str(tmp_path / "q"))
    got = spark.read.parquet(str(tmp_path / "q" / "out")).collect()
    took = lambda who: [r.payload for r in sorted((r for r in got if r.listener == who and r.seq), key=lambda r: r.seq)]
    assert took("a") == ["m0", "m1", "m5", "m6", "m7", "m8"] and took("b") == ["m5", "m6", "m7", "m8"]
    assert sorted((r.listener, r.skipped) for r in got if r.skipped) == [("a", 3), ("b", 5)]


def test_alerts_fire_on_the_way_down_only(spark, tmp_path):
    """Within an hour, from hour to hour, from batch to batch; a batch that comes again changes nothing."""
    at = F.col("at").cast("timestamp")
    frame = lambda *rows: spark.createDataFrame([(k, f"2026-02-01 {t}", p) for k, t, p in rows], "k string, at string, p double").withColumn("at", at)
    write = stages.alerts(str(tmp_path), "k", "p", "at", 10.0)
    first = frame(("a", "10:00:00", 12.0), ("a", "10:10:00", 9.0), ("a", "10:20:00", 8.0), ("a", "11:00:00", 7.0), ("a", "11:30:00", 11.0), ("a", "12:00:00", 9.5), ("b", "10:00:00", 1.0))
    write(first, 0)
    write(first, 0)
    write(frame(("a", "12:30:00", 3.0), ("b", "13:00:00", 20.0), ("b", "13:10:00", 2.0), ("c", "10:00:00", None)), 1)
    got = sorted((r.k, str(r["at"])[11:16]) for r in stages.read(spark, str(tmp_path), "alerts").collect())
    assert got == [("a", "10:10"), ("a", "12:00"), ("b", "10:00"), ("b", "13:10")]
