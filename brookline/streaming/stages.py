"""Posts as a stream: decode, clean, classify, score, store, with dead letters, retries, cursors and alerts.

Every stage is a DataFrame transformation that works on streams and on tables. Delivery is at least once; stored posts
have an identity, so what is delivered again changes nothing. Nothing is dropped for being late: late posts go to the
merge of the hourly facts.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brookline import session
from brookline.functions import stats, text
from brookline.operators import sinks
from brookline.operators.store import Store, Transaction, insert
from brookline.sources.views import OUTLIER, TOPICS

RAW = "id string, symbol string, platform string, text string, timestamp timestamp, engagement int, ingested_at timestamp, engagement_observed_at timestamp, source_schema_version int, pipeline_git_commit string"
IDENTITY = ["platform", "id", "symbol"]
SEEN_IDS = 2000
ERROR_CHARS = 500

# A scorer maps texts to logits (neutral, positive, negative), or to one (entailment, contradiction) pair per topic.
Scorer = Callable[[pd.Series], pd.DataFrame]
# Words of the built-in scorer. It stands in for a model and is there to make the stages run, not to be right.
POSITIVE, NEGATIVE = {"beat", "gain", "good", "great", "rally", "strong", "up"}, {"bad", "down", "fall", "loss", "miss", "poor", "weak"}


def lexicon_scorer(texts: pd.Series) -> pd.DataFrame:
    """Logits that grow with the positive and negative words of a text."""
    words = texts.fillna("").str.lower().str.findall(r"\w+")
    return pd.DataFrame({"neutral": 0.5, "positive": [float(sum(w in POSITIVE for w in x)) for x in words], "negative": [float(sum(w in NEGATIVE for w in x)) for x in words]})


def decode(messages: DataFrame, schema: str = RAW) -> tuple[DataFrame, DataFrame]:
    """(posts, dead letters) of rows with a column `value`. Missing engagement is 1, missing times are null."""
    readable = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    good = messages.where(readable).select(F.from_json("value", schema).alias("p"), "*").select("p.*", *[c for c in messages.columns if c != "value"])
    good = good.withColumn("engagement", F.coalesce("engagement", F.lit(1)))
    return good, dead_letters(messages.where(~F.coalesce(readable, F.lit(False))), F.col("value"), "decode", F.lit("malformed JSON"))


def dead_letters(df: DataFrame, body: Column, stage: str, error: Column) -> DataFrame:
    return df.select(body.alias("body"), F.lit(stage).alias("stage"), F.substring(error, 1, ERROR_CHARS).alias("error"))


def retry_or_bury(failed: DataFrame, body: Column, stage: str, error: Column) -> tuple[DataFrame, DataFrame]:
    """A first failure is tried again with attempt 1; a second one is a dead letter."""
    attempt = F.coalesce("attempt", F.lit(0))
    return failed.where(attempt < 1).withColumn("attempt", attempt + 1), dead_letters(failed.where(attempt >= 1), body, stage, error)


def cleaned(posts: DataFrame, now: Column) -> DataFrame:
    """Cleaned posts; those that are too short are left out."""
    return posts.withColumn("text", text.clean(F.col("text"))).where(text.long_enough(F.col("text"))).withColumn("cleaned_at", now)


def classified(posts: DataFrame, entailments: Column, now: Column, version: str = "legacy") -> DataFrame:
    """Posts with a topic; entailments: array of one probability a topic. Posts that look like spam have none."""
    topic = F.when(text.is_outlier(F.col("text")), -1).otherwise(stats.best_topic(entailments))
    label = F.when(F.col("topic_id") < 0, OUTLIER).otherwise(F.element_at(F.array(*map(F.lit, TOPICS)), F.greatest("topic_id", F.lit(0)) + 1))
    return posts.withColumn("topic_id", topic).withColumn("topic_label", label).withColumn("topic_scored_at", now).withColumn("topic_model_version", F.lit(version))


def scored(posts: DataFrame, scorer: Scorer, now: Column, version: str = "legacy") -> DataFrame:
    """Posts with a sentiment and its probabilities. The scorer sees Arrow batches of texts; logits that are not finite give nulls."""

    @F.pandas_udf("neutral double, positive double, negative double")
    def logits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield scorer(batch)[["neutral", "positive", "negative"]].astype(float)

    return with_sentiment(posts.withColumn("_l", logits("text")), F.col("_l.neutral"), F.col("_l.positive"), F.col("_l.negative"), now, version).drop("_l")


def with_sentiment(posts: DataFrame, neutral: Column, positive: Column, negative: Column, now: Column, version: str = "legacy") -> DataFrame:
    """Posts with a sentiment and its probabilities from three logits."""
    out = posts.withColumn("_s", stats.softmax3(neutral, positive, negative))
    scores = F.create_map(*[x for k in ("positive", "neutral", "negative") for x in (F.lit(k), F.col(f"_s.{k}"))])
    return out.withColumn("sentiment", F.col("_s.label")).withColumn("scores", F.when(F.col("_s").isNotNull(), scores)).withColumn("sentiment_scored_at", now).withColumn("sentiment_model_version", F.lit(version)).drop("_s")


def valid(tolerance: float = 1e-4) -> Column:
    """Whether a post's probabilities are a distribution and its label is one of the three."""
    p = [F.element_at("scores", F.lit(k)) for k in ("positive", "neutral", "negative")]
    inside = F.lit(True)
    for x in p:
        inside = inside & stats.finite(x) & x.between(0, 1)
    return F.coalesce(inside & (F.abs(p[0] + p[1] + p[2] - 1) <= tolerance) & F.col("sentiment").isin("positive", "neutral", "negative"), F.lit(False))


def permanent_fault(tolerance: float = 1e-4) -> Column:
    """Why a post can never be stored, however often it is tried; NULL if it can."""
    missing = F.lit(False)
    for c in (*IDENTITY, "timestamp"):
        missing = missing | F.col(c).isNull()
    return F.when(missing, "missing identity or time").when(~valid(tolerance), "invalid scores")


def store(folder: str, source: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: posts that can never be stored go to dead letters with the reason, row by row; known identities are
    counted as duplicates, the rest is appended. All tables, and the number of the batch, are one commit.

    Any other failure is taken for transient and raised, so the stream stops and its checkpoint delivers the batch again.
    A batch of a source that was committed changes nothing when it is delivered again; streams with checkpoints of their own
    need a `source` of their own.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("text", text.without_nul(F.col("text"))).withColumn("_fault", permanent_fault()).persist()

        def change(tx: Transaction) -> None:
            if tx.manifest["notes"].get(source, -1) >= number:
                return
            tx.manifest["notes"][source] = number
            ok = batch.where("_fault IS NULL").drop("_fault")
            stored = insert(tx, "posts", ok, IDENTITY, "timestamp")
            dead = dead_letters(batch.where("_fault IS NOT NULL"), F.to_json(F.struct(*IDENTITY, "text")), "store", F.col("_fault"))
            if not dead.isEmpty():
                tx.append("dead", dead)
            one = F.when(F.min("platform") == F.max("platform"), F.min("platform")).otherwise("mixed")
            files = F.lit(len(tx.opened))
            tx.append("quality", ok.agg(one.alias("platform"), (F.count("*") - stored).alias("duplicates"), files.alias("opened")).withColumn("batch", F.lit(number)))

        try:
            Store(batch.sparkSession, folder).transact(change)
        finally:
            batch.unpersist()

    return write


def read(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table of store(); None if nothing was committed."""
    kept = Store(spark, folder)
    return kept.snapshot().read(table) if kept.current() else None


def admitted(values: pd.Series, ids: deque, known: set, most: int) -> list[bool]:
    """Which values are new, in their order; the cursor (ids by age, and the same as a set) takes them in. The oldest leaves in the same time however many there are."""
    keep = []
    for x in values:
        fresh = x not in known
        keep.append(fresh)
        if fresh:
            ids.append(x)
            known.add(x)
            if len(ids) > most:
                known.discard(ids.popleft())
    return keep


def unseen(items: DataFrame, key: str, id_: str, most: int = SEEN_IDS) -> DataFrame:
    """Rows whose id is not among the last `most` new ids of their key; ids leave in the order in which they came. A key's ids are the state
    of one task; cursor.admit() is for more than that may hold."""
    schema = items.schema

    def check(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids = deque(state.get[0] if state.exists else ())
        known = set(ids)
        for pdf in batches:
            yield pdf[admitted(pdf[id_], ids, known, most)]
        state.update((list(ids),))

    return items.groupBy(key).applyInPandasWithState(check, schema, "ids array<string>", "append", GroupStateTimeout.NoTimeout)


def alerts(folder: str, key: str, price: str, at: str, threshold: float, source: str = "alerts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a row when a key's price falls below the threshold, not again until it has been at or above it.

    A key's rows are compared within each hour, and hours by their last rows, so no task has all rows of a hot key. Where each key was
    last is a table of the store: it, the alerts and the number of the batch are one commit.
    """
    from pyspark.sql import Window as W

    def write(batch: DataFrame, number: int) -> None:
        def change(tx: Transaction) -> None:
            if tx.manifest["notes"].get(source, -1) >= number:
                return
            tx.manifest["notes"][source] = number
            rows = batch.withColumns({"_low": F.coalesce(F.col(price) < threshold, F.lit(False)), "_hour": F.date_trunc("hour", at)})
            line = W.partitionBy(key, "_hour").orderBy(at, price)
            ends = rows.groupBy(key, "_hour").agg(F.max_by("_low", F.struct(at, price)).alias("_end"))
            last = tx.read("last")
            ends = ends.withColumn("_was", F.lag("_end").over(W.partitionBy(key).orderBy("_hour")))  # a row an hour
            ends = ends.withColumn("_low_before", F.lit(None).cast("boolean")) if last is None else ends.join(last.withColumnRenamed("low", "_low_before"), key, "left")
            before = ends.select(F.col(key).alias("_k"), F.col("_hour").alias("_h"), F.coalesce("_was", "_low_before", F.lit(False)).alias("_before"))
            told = rows.withColumn("_inside", F.lag("_low").over(line)).join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_hour").eqNullSafe(F.col("_h")))
            tx.append("alerts", told.where(F.col("_low") & ~F.coalesce("_inside", "_before")).select(*batch.columns))
            now = ends.groupBy(key).agg(F.max_by("_end", "_hour").alias("low"))
            after = now if last is None else sinks.without_keys(last, now, [key]).unionByName(now)
            tx.drop("last", {None})
            tx.append("last", after)

        Store(batch.sparkSession, folder).transact(change)

    return write


#: Fixed value: characters of a post's text that listeners are told.
TOLD_CHARS = 1000


def notification() -> Column:
    """What listeners are told of a new post, as JSON, its text cut."""
    return F.to_json(F.struct("id", "symbol", "platform", F.left("text", F.lit(TOLD_CHARS)).alias("text"), "sentiment", "topic_id", "engagement"))


def live_counts(posts: DataFrame) -> DataFrame:
    """Counts of the dashboard; for output mode complete or update."""
    return posts.groupBy("symbol", "sentiment").agg(F.count("*").alias("n"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{session.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def counted(posts: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """posts, with counters that are ready when they have been written: how many there were, of how many symbols and platforms."""
    seen = Observation(name)
    return posts.observe(seen, F.count("*").alias("posts"), F.approx_count_distinct("symbol").alias("symbols"), F.approx_count_distinct("platform").alias("platforms")), seen


def after_restart(items: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What is new after a start: ids that were there before it count as seen."""
    return sinks.without_keys(items, existing, keys)


def follow(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], every: str = "1 second") -> StreamingQuery:
    """Run a stream until it is stopped, a batch each time the interval is over; how much a batch holds is set at the source."""
    return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).foreachBatch(write).start()


def drain(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Run a stream over what is there now, to Parquet under folder/out or to a function; the query's id."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = (writer.foreachBatch(write) if write else writer.format("parquet").option("path", f"{folder}/out")).start()
    query.awaitTermination()
    return str(query.id)


def every_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for complete results: the last one stays."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    return write
