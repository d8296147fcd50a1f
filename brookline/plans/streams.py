"""Streaming queries, run over the events that are there; their results equal those of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.functions import calendar
from brookline.operators import rollup as R
from brookline.operators import sinks as K
from brookline.plans.facts import _PRICES, shown_prices
from brookline.plans.registry import query
from brookline.sources.views import PLATFORMS, Tables, as_of, ntz
from brookline.streaming import cursor as C
from brookline.streaming import stages as S
from brookline.streaming import stateful as M


def event_stream(t: Tables, files: int = 4) -> DataFrame:
    """`events` as a file stream, at most so many files a batch."""
    schema = t.raw("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files).parquet(t.sf_dir)
    return rows.withColumn("timestamp", F.col("ts").cast("timestamp"))


@query("str11_live_counts", "SELECT event_type AS symbol, CASE WHEN value < 250 THEN 'negative' ELSE 'positive' END AS sentiment, count(*) AS n FROM events GROUP BY ALL")
def live_counts(t: Tables) -> DataFrame:
    folder = S.scratch(t.spark)
    posts = event_stream(t).select(F.col("event_type").alias("symbol"), F.when(F.col("value") < 250, "negative").otherwise("positive").alias("sentiment"))
    S.drain(S.live_counts(posts), folder, S.every_batch(folder), "complete")
    return t.spark.read.parquet(f"{folder}/result")


@query("ext_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS symbol, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(t: Tables) -> DataFrame:
    """An extension: tumbling windows with a watermark."""
    folder = S.scratch(t.spark)
    counts = event_stream(t).withWatermark("timestamp", "1 hour").groupBy(F.window("timestamp", "1 hour").alias("w"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    S.drain(counts.select(F.col("w.start").alias("start"), "symbol", "n"), folder, S.every_batch(folder), "complete")
    return t.spark.read.parquet(f"{folder}/result").select(ntz("start").alias("start"), "symbol", "n")


@query("str5_stored_posts", "SELECT event_id::VARCHAR AS id, event_type AS symbol, 'bluesky' AS platform, CASE WHEN event_id % 9 < 8 THEN (event_id % 9)::INT ELSE -1 END AS topic_id FROM events WHERE event_id % 10 <> 3")
def stored_posts(t: Tables) -> DataFrame:
    """Messages through all stages to the store: every tenth is malformed, every post comes twice."""
    folder = S.scratch(t.spark)
    post = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("symbol"), F.lit("bluesky").alias("platform"), F.concat(F.lit("a good post about "), "event_type").alias("text"), "timestamp")
    body = F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(F.to_json(post))
    messages = event_stream(t).select(F.explode(F.array(body, body)).alias("value"))
    good, _ = S.decode(messages)
    entailments = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("id").cast("long") % 9, 0.8).otherwise(F.lit(0.2)))
    classified = S.classified(S.cleaned(good, as_of()), entailments, as_of())
    S.drain(S.scored(classified, S.lexicon_scorer, as_of()), folder, S.store(folder))
    return S.read(t.spark, folder, "posts").select("id", "symbol", "platform", "topic_id")


@query(
    "str3_dead_letters",
    "SELECT CASE WHEN event_id % 7 = 2 THEN 'missing identity or time' WHEN event_id % 7 = 4 THEN 'invalid scores' ELSE 'stored' END AS outcome, count(*) AS n FROM events GROUP BY ALL",
)
def isolated(t: Tables) -> DataFrame:
    """Of a batch with posts that can never be stored, the others are; those are dead letters with the reason."""
    folder = S.scratch(t.spark)
    k = F.col("event_id") % 7
    score = F.create_map(*[x for n, p in (("positive", 0.5), ("neutral", 0.25), ("negative", 0.25)) for x in (F.lit(n), F.lit(p) + F.when(k == 4, 0.5).otherwise(0.0))])
    posts = event_stream(t).select(F.col("event_id").cast("string").alias("id"), F.when(k != 2, F.col("event_type")).alias("symbol"), F.lit("bluesky").alias("platform"), F.lit("a\x00b").alias("text"), "timestamp", F.lit("positive").alias("sentiment"), score.alias("scores"))
    S.drain(posts, folder, S.store(folder))
    dead = S.read(t.spark, folder, "dead").select(F.col("error").alias("outcome"))
    return dead.union(S.read(t.spark, folder, "posts").where("text = 'ab'").select(F.lit("stored"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("str9_stream_alerts", "SELECT symbol, timestamp, price FROM (SELECT *, coalesce(lag(price < 20) OVER (PARTITION BY symbol ORDER BY timestamp), false) AS was FROM quotes) WHERE price < 20 AND NOT was")
def stream_alerts(t: Tables) -> DataFrame:
    folder = S.scratch(t.spark)
    quotes = event_stream(t).select(F.col("event_type").alias("symbol"), "timestamp", F.col("value").alias("price"))
    S.drain(quotes, folder, S.alerts(f"{folder}/store", "symbol", "price", "timestamp", 20.0))
    return S.read(t.spark, f"{folder}/store", "alerts").select("symbol", ntz("timestamp").alias("timestamp"), "price")


@query("str6_unseen_ids", "SELECT count(DISTINCT event_id) AS n FROM events")
def unseen_ids(t: Tables) -> DataFrame:
    """Ids that come twice in a row pass once."""
    folder = S.scratch(t.spark)
    ids = event_stream(t).select(F.col("event_type").alias("key"), F.explode(F.array(F.col("event_id").cast("string"), F.col("event_id").cast("string"))).alias("id"))
    S.drain(S.unseen(ids, "key", "id"), folder)
    return t.spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"))


@query("str2_micro_batches", "SELECT count(*) AS n, 3::BIGINT AS batches FROM events")
def micro_batches(t: Tables) -> DataFrame:
    """Five files, two a batch, taken as they come until nothing is left."""
    folder = S.scratch(t.spark)
    t.raw("events").select("event_id").repartition(5).write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    running = S.follow(stream, folder, write, "0 seconds")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return t.spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches"))


@query("snk13_published", "SELECT id, symbol, '{\"type\":\"post\",\"id\":\"' || id || '\",\"symbol\":\"' || symbol || '\"}' AS envelope FROM posts")
def published(t: Tables) -> DataFrame:
    """An envelope of every stored post, written by the batch that stores it; a batch that comes again writes the same."""
    folder = S.scratch(t.spark)
    posts = event_stream(t).select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("symbol"))

    def write(batch: DataFrame, number: int) -> None:
        envelope = F.to_json(F.struct(F.lit("post").alias("type"), "id", "symbol"))
        batch.withColumn("envelope", envelope).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    S.drain(posts, folder, write)
    return t.spark.read.parquet(f"{folder}/out").select("id", "symbol", "envelope")


_CUT = "2024-01-17 10:20:00"


@query("str16_scheduled_retention", _PRICES.format(bucket="date_trunc('hour', timestamp)", name="bucket_hour").replace("FROM quotes", f"FROM quotes WHERE timestamp < TIMESTAMP '{_CUT}'"))
def scheduled_retention(t: Tables) -> DataFrame:
    """A job that a scheduler starts: it folds the old quotes of what has come since its last run into versioned facts and ends.
    A batch has a version of its own, so one that is delivered again changes nothing."""
    folder = S.scratch(t.spark)
    facts = K.Versions(t.spark, f"{folder}/facts")
    rows = event_stream(t).select(F.col("event_type").alias("symbol"), "timestamp", F.col("value").alias("price"), F.col("user_id").cast("long").alias("volume"), F.when(F.col("event_id") % 2 == 0, "yahoo").otherwise("synthetic").alias("provider"))

    def write(batch: DataFrame, number: int) -> None:
        seen = facts.current()
        if seen > number:
            return
        old = calendar.with_equity_session(batch.where(F.col("timestamp") < F.lit(_CUT).cast("timestamp")), "timestamp", "market_session")
        new = R.price_facts(old, "hour")
        facts.publish(R.merge_price_facts(facts.read(), new, "hour") if seen else new, seen)

    S.drain(rows, folder, write)
    return shown_prices(facts.read())


@query(
    "str2_batches_by_count_or_idle",
    "c AS (SELECT event_id % 4 AS lane, count(*) AS n FROM events GROUP BY ALL) SELECT lane, 'full' AS reason, n // 32 AS batches, n // 32 * 32 AS n, 32 AS largest FROM c WHERE n >= 32 UNION ALL SELECT lane, 'idle', 1, n % 32, n % 32 FROM c WHERE n % 32 > 0",
)
def batches_by_count_or_idle(t: Tables) -> DataFrame:
    """Batches of 32; what is left of a lane goes when it has been idle for a second."""
    folder = S.scratch(t.spark)
    items = event_stream(t).select((F.col("event_id") % 4).alias("lane"), "event_id", "timestamp")

    written: dict[int, int] = {}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/n={number}")
        written[number] = batch.sparkSession.read.parquet(f"{folder}/out/n={number}").count()

    running, total = S.follow(M.in_batches(items, "lane"), folder, write, "2 seconds"), t.raw("events").count()
    try:
        for _ in range(90):  # the timers are those of the wall clock; such a stream is never through
            if sum(written.values()) >= total and not running.status["isTriggerActive"] or running.awaitTermination(0.5):
                break
    finally:
        running.stop()
    batches = t.spark.read.parquet(f"{folder}/out").groupBy("lane", "batch", "reason").agg(F.count("*").alias("n"))
    return batches.groupBy("lane", "reason").agg(F.count("*").alias("batches"), F.sum("n").alias("n"), F.max("n").alias("largest"))


@query(
    "str6_evicted_ids",
    "c AS (SELECT event_type AS key, count(*) AS n FROM events GROUP BY ALL) SELECT key, n + (SELECT greatest(min(n) // 2, 1) FROM c) AS passed FROM c",
)
def evicted_ids(t: Tables) -> DataFrame:
    """A cursor with room for half of the rarest key's ids. Of each key two blocks of as many come after the rest; the first one again,
    which is new as the second has displaced it, and again, which is not."""
    from pyspark.sql import Window as W

    folder = S.scratch(t.spark)
    ids = t.raw("events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("id"), "event_id")
    most = max(1, (ids.groupBy("key").count().agg(F.min("count")).first()[0] or 0) // 2)
    ranked = ids.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy("event_id"))).select("key", "id", F.when(F.col("k") <= most, 0).when(F.col("k") <= 2 * most, 1).otherwise(2).alias("block"))
    ranked.write.partitionBy("block").parquet(f"{folder}/blocks")
    for block in (2, 0, 1, 0, 0):
        t.spark.read.schema("key string, id string, block int").parquet(f"{folder}/blocks").where(F.col("block") == block).drop("block").write.mode("append").parquet(f"{folder}/in")
        S.drain(t.spark.readStream.schema("key string, id string").parquet(f"{folder}/in"), f"{folder}/q", C.admit(f"{folder}/store", "key", "id", most))
    return S.read(t.spark, f"{folder}/store", "passed").groupBy("key").agg(F.count("*").alias("passed"))


@query("str11_newest_posts", "p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, id DESC) AS place, count(*) FILTER (sentiment = 'positive') OVER (PARTITION BY symbol) AS positive, count(*) FILTER (sentiment = 'neutral') OVER (PARTITION BY symbol) AS neutral, count(*) FILTER (sentiment = 'negative') OVER (PARTITION BY symbol) AS negative FROM posts) SELECT symbol, place::INT AS place, id, positive, neutral, negative FROM p WHERE place <= 500")
def newest_posts(t: Tables) -> DataFrame:
    """The newest 500 posts of each symbol beside the counts, after three batches of which the first has the newest."""
    folder = S.scratch(t.spark)
    for k in (2, 0, 1):
        part = t.posts.where(F.col("id").cast("long") % 3 == k)
        part.select("symbol", "timestamp", "id", "sentiment").write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema("symbol string, timestamp timestamp, id string, sentiment string").parquet(f"{folder}/in")
        S.drain(M.newest(stream, "symbol"), f"{folder}/q", lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"), "update")
    out = t.spark.read.parquet(f"{folder}/out")
    last = out.groupBy("key").agg(F.max("batch").alias("batch"))
    return out.join(last, ["key", "batch"]).select(F.col("key").alias("symbol"), "place", "id", "positive", "neutral", "negative")


#: A listener's turn after batch k: from where it is, or the oldest message of the buffer, as many as it takes.
_TURN = """s{k} AS (SELECT channel, listener, most, beg + least(head - beg, most) AS cur, delivered + least(head - beg, most) AS delivered, skipped + beg - cur AS skipped
  FROM (SELECT p.*, head, greatest(cur, head - 256) AS beg FROM ({before}) p JOIN h USING (channel) WHERE b = {k}))"""
_NEW = "SELECT DISTINCT channel, '{0}' AS listener, {1}::BIGINT AS most, 0::BIGINT AS cur, 0::BIGINT AS delivered, 0::BIGINT AS skipped FROM h"


@query(
    "str12_fan_out",
    "n AS (SELECT event_type AS channel, event_id % 3 AS b, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT c.channel, k.b, coalesce(sum(n.n), 0)::BIGINT AS head FROM (SELECT DISTINCT channel FROM n) c, (SELECT unnest([0, 1, 2]) AS b) k LEFT JOIN n ON n.channel = c.channel AND n.b <= k.b GROUP BY ALL), "
    + ", ".join([
        _TURN.format(k=0, before=_NEW.format("steady", 256) + " UNION ALL " + _NEW.format("slow", 100)),
        _TURN.format(k=1, before="SELECT * FROM s0"),
        _TURN.format(k=2, before="SELECT * FROM s1 UNION ALL " + _NEW.format("late", 256)),
    ])
    + " SELECT channel, listener, delivered, skipped FROM s2",
)
def fan_out(t: Tables) -> DataFrame:
    """Three batches of messages; of the listeners one keeps up with the buffer, one takes 100 each time, one comes at the end. Those that lag skip, and learn how many."""
    folder = S.scratch(t.spark)
    schema = "channel string, listener string, at timestamp, id string, payload string, most long"
    channels = t.raw("events").select(F.col("event_type").alias("channel")).distinct()
    for k in range(3):
        told = t.raw("events").where(F.col("event_id") % 3 == k).select(F.col("event_type").alias("channel"), F.lit(None).cast("string").alias("listener"), F.col("ts").cast("timestamp").alias("at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("event_id").cast("string").alias("payload"), F.lit(None).cast("long").alias("most"))
        takers = {"steady": 256, "slow": 100} | ({"late": 256} if k == 2 else {})
        asked = channels.select("channel", F.explode(F.create_map(*[F.lit(x) for p in takers.items() for x in p])).alias("listener", "most"))
        polls = asked.select("channel", "listener", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("payload"), F.col("most").cast("long"))
        told.union(polls).write.mode("append").parquet(f"{folder}/in")
        S.drain(M.fan_out(t.spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/q")
    out = t.spark.read.parquet(f"{folder}/q/out")
    return out.groupBy("channel", "listener").agg(F.count("seq").alias("delivered"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))


@query("snk20_stream_counters", "SELECT 'platform' AS family, platform AS label, count(*) AS value FROM posts GROUP BY ALL UNION ALL SELECT 'topic', CASE WHEN topic_id < 0 THEN 'none' ELSE 'some' END, count(*) FROM posts GROUP BY ALL UNION ALL SELECT 'rows', 'all', count(*) FROM posts")
def stream_counters(t: Tables) -> DataFrame:
    """Counters of a stream by platform and topic, as a listener adds them up while it runs."""
    folder, counters = S.scratch(t.spark), M.Counters()
    t.posts.select("id", "platform", "topic_id").repartition(3).write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema("id string, platform string, topic_id int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    labels = {"platform": {p: F.col("platform") == p for p in PLATFORMS}, "topic": {"none": F.col("topic_id") < 0, "some": F.col("topic_id") >= 0}}
    t.spark.streams.addListener(counters)
    try:
        counters.wait(S.drain(M.with_counters(stream, "posts", labels), folder))
    finally:
        t.spark.streams.removeListener(counters)
    return counters.table(t.spark).where("value > 0").select("family", "label", "value")
