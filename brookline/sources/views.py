"""Domain tables as projections of the input tables, once for Spark and once as DuckDB common table expressions.

The input holds no posts or quotes: posts are `events` with a platform, class weights and a topic derived from their ids;
quotes are the same events with their value as the price; closes are the last quote of a symbol on each UTC day.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline import session
from brookline.functions import calendar

AS_OF = "2024-01-31 00:00:00"
# The platforms of the feed in the order in which they are reported, and the topic labels by topic id.
PLATFORMS = ["bluesky", "stocktwits", "finnhub", "alpaca"]
TOPICS = ["Earnings & Guidance", "Fed & Macro", "Technical Analysis", "AI & Compute", "Space & Satellite", "Management & Insider", "M&A & Partnerships", "Options & Volatility"]
OUTLIER = "General / Outlier"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def ntz(c: Column | str) -> Column:
    """A result's time without a zone, in UTC."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


class Tables:
    """The domain tables over one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        session.require_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that costs much a row."""
        return session.spread(self.raw(name))

    @cached_property
    def posts(self) -> DataFrame:
        e = self.raw("events")
        a, b, c = (F.col("event_id") % m + 1 for m in (7, 5, 3))
        whole = a + b + c
        topic = (F.col("user_id") % 9 - 1).cast("int")
        ts = F.col("ts").cast("timestamp")
        return e.select(
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("symbol"),
            F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("user_id") % 4 + 1).cast("int")).alias("platform"),
            F.concat_ws(" ", F.lit("$"), "event_type", F.lit("post"), F.col("event_id").cast("string")).alias("text"),
            ts.alias("timestamp"),
            F.when((b >= a) & (b >= c), "neutral").when(a >= c, "positive").otherwise("negative").alias("sentiment"),
            (a / whole).alias("p_pos"),
            (b / whole).alias("p_neu"),
            (c / whole).alias("p_neg"),
            topic.alias("topic_id"),
            F.when(topic < 0, OUTLIER).otherwise(F.element_at(F.array(*map(F.lit, TOPICS)), F.greatest(topic, F.lit(0)) + 1)).alias("topic_label"),
            F.get_json_object("props", "$.k").cast("int").alias("engagement"),
            (ts + F.expr("INTERVAL 30 SECONDS")).alias("ingested_at"),
            (ts + F.expr("INTERVAL 60 SECONDS")).alias("scored_at"),
            F.lpad((F.col("event_id") % 3).cast("string"), 64, "0").alias("topic_model_hash"),
            F.lpad((F.col("event_id") % 2).cast("string"), 64, "0").alias("sentiment_model_hash"),
            F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("model_version"),
            F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("pipeline_git_commit"),
        )

    @cached_property
    def quotes(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        rows = self.raw("events").select(
            F.col("event_type").alias("symbol"),
            ts.alias("timestamp"),
            F.col("value").alias("price"),
            F.col("user_id").cast("long").alias("volume"),
            F.when(F.col("event_id") % 2 == 0, "yahoo").otherwise("synthetic").alias("provider"),
        )
        return calendar.with_equity_session(rows, "timestamp", "market_session")

    @cached_property
    def closes(self) -> DataFrame:
        """The last quote of each symbol and UTC day."""
        days = self.raw("events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"))
        return days.agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.max("ts").alias("ends_at"))

    @cached_property
    def tracked_symbols(self) -> DataFrame:
        """The event types, one symbol that has no posts, and one that is not active. A handful of rows: its size is that of a fixed list and the event types."""
        known = self.raw("events").select(F.col("event_type").alias("symbol")).distinct().withColumn("is_active", F.lit(True))
        extra = self.spark.sql("SELECT * FROM VALUES ('quiet', true), ('retired', false) AS t(symbol, is_active)")
        return known.unionByName(extra)


#: DuckDB twins, to be put before a query: WITH <VIEWS> SELECT ...
VIEWS = f"""
posts AS (
  SELECT event_id::VARCHAR AS id, event_type AS symbol, {PLATFORMS}[user_id % 4 + 1] AS platform,
    '$ ' || event_type || ' post ' || event_id AS text, ts AS timestamp,
    CASE WHEN b >= a AND b >= c THEN 'neutral' WHEN a >= c THEN 'positive' ELSE 'negative' END AS sentiment,
    a::DOUBLE / (a + b + c) AS p_pos, b::DOUBLE / (a + b + c) AS p_neu, c::DOUBLE / (a + b + c) AS p_neg,
    (user_id % 9 - 1)::INT AS topic_id, CASE WHEN user_id % 9 = 0 THEN '{OUTLIER}' ELSE {TOPICS}[user_id % 9] END AS topic_label,
    regexp_extract(props, '(\\d+)', 1)::INT AS engagement, ts + INTERVAL 30 SECONDS AS ingested_at, ts + INTERVAL 60 SECONDS AS scored_at,
    lpad((event_id % 3)::VARCHAR, 64, '0') AS topic_model_hash, lpad((event_id % 2)::VARCHAR, 64, '0') AS sentiment_model_hash,
    'v' || event_id % 2 AS model_version, 'c' || event_id % 5 AS pipeline_git_commit
  FROM (SELECT *, event_id % 7 + 1 AS a, event_id % 5 + 1 AS b, event_id % 3 + 1 AS c FROM events)
),
quotes AS (
  SELECT symbol, timestamp, price, volume, provider,
    CASE WHEN dayofweek(local_day) IN (0, 6) OR local_day IN (DATE '2024-01-01', DATE '2024-01-15') THEN 'closed'
      WHEN local_time BETWEEN TIME '09:30:00' AND TIME '16:00:00' THEN 'regular'
      WHEN local_time >= TIME '04:00:00' AND local_time < TIME '09:30:00' THEN 'pre'
      WHEN local_time > TIME '16:00:00' AND local_time <= TIME '20:00:00' THEN 'after' ELSE 'closed' END AS market_session
  FROM (
    SELECT event_type AS symbol, ts AS timestamp, value AS price, user_id::BIGINT AS volume, CASE WHEN event_id % 2 = 0 THEN 'yahoo' ELSE 'synthetic' END AS provider,
      (ts - INTERVAL 5 HOURS)::DATE AS local_day, (ts - INTERVAL 5 HOURS)::TIME AS local_time
    FROM events
  )
),
closes AS (
  SELECT event_type AS symbol, ts::DATE AS day, arg_max(value, ts) AS close, max(ts) AS ends_at FROM events GROUP BY ALL
),
tracked_symbols AS (
  SELECT DISTINCT event_type AS symbol, true AS is_active FROM events UNION ALL VALUES ('quiet', true), ('retired', false)
)
"""


def with_views(sql: str) -> str:
    """sql after the domain views; sql may start with further expressions of its own, as `name AS (...), ... SELECT`."""
    body = sql.strip()
    return f"WITH {VIEWS}{',' if not body.upper().startswith('SELECT') else ''}\n{body}"
