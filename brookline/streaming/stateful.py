"""Streams that remember: batches by count or idle time, a bounded buffer with listeners, the newest posts, counters of a running query.

State is what a key needs and is bounded by a parameter, whatever the stream brings: less than a batch, a ring of messages and a cursor a
listener, the newest posts. Rows of a key in a micro-batch are read one Arrow batch after the other and never held together; how many a
micro-batch brings is set at the source.
"""

from __future__ import annotations

import heapq
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH, IDLE_MS, BUFFER, NEWEST = 32, 1000, 256, 500
#: Microseconds survive.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def in_batches(items: DataFrame, lane: str, most: int = BATCH, idle_ms: int = IDLE_MS) -> DataFrame:
    """items with `batch` and `reason`: a lane's rows, in the order of their arrival, by batches that are `full` with `most` rows or
    closed when the lane was `idle` so long. A lane is a worker of its own; its state is less than one batch."""
    rows = items.select(F.col(lane).cast("string").alias("_lane"), F.to_json(F.struct(*items.columns), JSON).alias("_row"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        closed = lambda some, reason: pd.DataFrame({"batch": number, "reason": reason, "_row": some})
        if state.hasTimedOut:
            yield closed(held, "idle")
            state.update(([], number + 1))
            return
        for pdf in batches:
            held += pdf["_row"].tolist()
            while len(held) >= most:
                yield closed(held[:most], "full")
                held, number = held[most:], number + 1
        state.update((held, number))
        if held:
            state.setTimeoutDuration(idle_ms)

    out = rows.groupBy("_lane").applyInPandasWithState(run, "batch long, reason string, _row string", "held array<string>, number long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.from_json("_row", items.schema.simpleString(), JSON).alias("r"), "batch", "reason").select("r.*", "batch", "reason")


def fan_out(events: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Messages of a channel to its listeners, each at its own speed, through a ring of the last `buffer` messages.

    events: channel, listener (null: a message), at and id (the order of messages), payload, most (how many a listener takes now).
    Within a micro-batch messages come before listeners. A listener that is further behind than the ring reaches goes on with the
    oldest message there. Gives channel, listener, seq and payload of what is delivered, and a row with `skipped` where some were missed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, ring, names, cursors = state.get if state.exists else (0, [], [], [])
        ring, cursor = list(ring), dict(zip(names, cursors))
        new, takers, n = [], [], 0
        for pdf in batches:
            told = pdf[pdf["listener"].isna()]
            n += len(told)
            new = heapq.nlargest(buffer, [*new, *zip(told["at"], told["id"], told["payload"])])
            takers += list(pdf[pdf["listener"].notna()][["listener", "most"]].itertuples(index=False, name=None))
        ring, head = [*ring, *[x[2] for x in reversed(new)]][-buffer:], head + n
        for listener, most in sorted(takers):
            at = cursor.get(listener, 0)
            oldest = head - len(ring)
            if at < oldest:
                yield pd.DataFrame({"channel": [key[0]], "listener": [listener], "seq": [None], "payload": [None], "skipped": [oldest - at]})
                at = oldest
            some = ring[at - oldest : at - oldest + int(most)]
            yield pd.DataFrame({"channel": key[0], "listener": listener, "seq": range(at + 1, at + 1 + len(some)), "payload": some, "skipped": None})
            cursor[listener] = at + len(some)
        state.update((head, ring, list(cursor), list(cursor.values())))

    return events.groupBy("channel").applyInPandasWithState(
        run, "channel string, listener string, seq long, payload string, skipped long", "head long, ring array<string>, names array<string>, cursors array<long>", "append", GroupStateTimeout.NoTimeout
    )


def newest(posts: DataFrame, key: str, most: int = NEWEST) -> DataFrame:
    """The newest posts of each key that a micro-batch touches, by place, beside its counts by sentiment: all of them each time, for update mode."""
    classes = ("positive", "neutral", "negative")
    rows = posts.select(F.col(key).alias("key"), F.unix_micros("timestamp").alias("at"), F.col("id").cast("string").alias("id"), "sentiment")

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ats, ids, counts = state.get if state.exists else ([], [], [0, 0, 0])
        top, counts = list(zip(ats, ids)), list(counts)
        for pdf in batches:
            top = heapq.nlargest(most, [*top, *zip(pdf["at"].tolist(), pdf["id"])])
            counts = [n + int((pdf["sentiment"] == c).sum()) for n, c in zip(counts, classes)]
        state.update(([x[0] for x in top], [x[1] for x in top], counts))
        yield pd.DataFrame({"key": name[0], "place": range(1, len(top) + 1), "id": [x[1] for x in top], **dict(zip(classes, counts))})

    out = "key string, place int, id string, positive long, neutral long, negative long"
    return rows.groupBy("key").applyInPandasWithState(run, out, "ats array<long>, ids array<string>, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def with_counters(df: DataFrame, name: str, labels: dict[str, dict[str, Column]]) -> DataFrame:
    """df, with counters by family and label that a Counters listener adds up; labels: a condition for each."""
    metrics = [F.count_if(condition).alias(f"{family}|{label}") for family, some in labels.items() for label, condition in some.items()]
    return df.observe(name, F.count("*").alias("rows|all"), *metrics)


class Counters(StreamingQueryListener):
    """Adds up the observed counters of all queries as they run, each micro-batch once: one that is run again counts when it is committed."""

    def __init__(self) -> None:
        self.totals: dict[tuple[str, str, str], int] = {}
        self.seen: set[tuple[str, int]] = set()
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.id), threading.Event())

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if (str(progress.id), progress.batchId) in self.seen:
            return
        self.seen.add((str(progress.id), progress.batchId))
        for name, row in progress.observedMetrics.items():
            for metric, value in row.asDict().items():
                family, label = metric.split("|", 1)
                self.totals[name, family, label] = self.totals.get((name, family, label), 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.id), threading.Event()).set()

    def wait(self, query_id: str, seconds: float = 60.0) -> bool:
        """Until the query's last event is here."""
        return self.ended.setdefault(query_id, threading.Event()).wait(seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        """name, family, label and value of all counters."""
        return spark.createDataFrame([(*k, v) for k, v in sorted(self.totals.items())], "name string, family string, label string, value long")
