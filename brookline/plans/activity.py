"""Activity of symbols and sources against what is usual for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.plans.registry import query
from brookline.sources.views import AS_OF, PLATFORMS, Tables, as_of, ntz


def ago(interval: str) -> Column:
    return as_of() - F.expr(f"INTERVAL {interval}")


_BOARD = f"""
current_posts AS (
  SELECT symbol, count(*) AS n, (count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative'))::DOUBLE / nullif(count(*), 0) AS sentiment_index
  FROM posts WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 4 HOURS AND timestamp < TIMESTAMP '{AS_OF}' GROUP BY symbol
), hourly AS (
  SELECT symbol, date_trunc('hour', timestamp) AS h, count(*) AS n FROM posts
  WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAYS AND timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 4 HOURS GROUP BY ALL
), baseline AS (
  SELECT symbol, avg(n) AS mean, stddev_samp(n) AS deviation, count(*) AS samples FROM hourly GROUP BY symbol
)
SELECT s.symbol, coalesce(c.n, 0) AS posts_4h, round(c.sentiment_index, 6) AS sentiment_index_4h, round(b.mean, 6) AS baseline_mean, coalesce(b.samples, 0) AS baseline_samples,
  CASE WHEN b.samples >= 8 AND b.deviation > 0 THEN round((coalesce(c.n, 0) / 4.0::DOUBLE - b.mean) / b.deviation, 6) END AS buzz_z
FROM tracked_symbols s LEFT JOIN current_posts c USING (symbol) LEFT JOIN baseline b USING (symbol) WHERE s.is_active
"""


@query("leaderboard", _BOARD)
def leaderboard(t: Tables) -> DataFrame:
    """Posts of the last four hours per active symbol, as a z-score against the hours of 28 days that had any."""
    up, down = F.count_if(F.col("sentiment") == "positive"), F.count_if(F.col("sentiment") == "negative")
    recent = t.posts.where((F.col("timestamp") >= ago("4 HOURS")) & (F.col("timestamp") < as_of()))
    current = recent.groupBy("symbol").agg(F.count("*").alias("n"), F.try_divide(up - down, F.count("*")).alias("index"))
    past = t.posts.where((F.col("timestamp") >= ago("28 DAYS")) & (F.col("timestamp") < ago("4 HOURS")))
    hourly = past.groupBy("symbol", F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count("*").alias("per_hour"))
    baseline = hourly.groupBy("symbol").agg(F.avg("per_hour").alias("mean"), F.stddev_samp("per_hour").alias("deviation"), F.count("*").alias("samples"))
    rows = t.tracked_symbols.where("is_active").join(current, "symbol", "left").join(baseline, "symbol", "left")
    z = F.try_divide(F.coalesce("n", F.lit(0)) / 4 - F.col("mean"), "deviation")
    out = rows.select(
        "symbol",
        F.coalesce("n", F.lit(0)).alias("posts_4h"),
        F.round("index", 6).alias("sentiment_index_4h"),
        F.round("mean", 6).alias("baseline_mean"),
        F.coalesce("samples", F.lit(0)).alias("baseline_samples"),
        F.when((F.col("samples") >= 8) & (F.col("deviation") > 0), F.round(z, 6)).alias("buzz_z"),
    )
    return out.orderBy(F.desc_nulls_last("buzz_z"), F.desc("posts_4h"), "symbol")


def status(hour: Column, day: Column, age: Column) -> Column:
    """silent, stalled, active or quiet: stalled is half an hour, and twelve usual gaps, without a post."""
    return F.when(day == 0, "silent").when((age > 1800) & (age > 12 * F.try_divide(F.lit(86400.0), day)), "stalled").when(hour > 0, "active").otherwise("quiet")


def severity(c: Column) -> Column:
    return F.when(c == "silent", 0).when(c == "stalled", 1).when(c == "quiet", 2).otherwise(3)


_HEALTH = """count(*) FILTER (timestamp > TIMESTAMP '{0}' - INTERVAL 1 HOUR) AS h, count(*) FILTER (timestamp > TIMESTAMP '{0}' - INTERVAL 24 HOURS) AS d, max(timestamp) AS last"""


@query(
    "source_health",
    f"""
seen AS (
  SELECT platform, {_HEALTH.format(AS_OF)} FROM posts WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND platform IN {tuple(PLATFORMS)} GROUP BY platform
), market AS (
  SELECT {_HEALTH.format(AS_OF)}, arg_max(market_session, timestamp) AS session FROM quotes WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS
), named AS (
  SELECT p.platform, coalesce(h, 0) AS h, coalesce(d, 0) AS d, last, NULL AS session FROM (SELECT unnest({PLATFORMS}) AS platform) p LEFT JOIN seen USING (platform)
  UNION ALL SELECT 'yfinance', h, d, last, session FROM market
), aged AS (
  SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last)) // 1000 / 1000.0 AS age FROM named
), judged AS (
  SELECT *, CASE WHEN d = 0 THEN 'silent' WHEN age > 1800 AND age > 12 * 86400.0 / d THEN 'stalled' WHEN h > 0 THEN 'active' ELSE 'quiet' END AS s FROM aged
)
SELECT platform, h AS posts_1h, d AS posts_24h, last AS last_ingest, round(age, 3)::DOUBLE AS age_seconds, CASE WHEN d > 0 THEN round(d / 24.0::DOUBLE, 6) END AS baseline_per_hour,
  CASE WHEN platform = 'yfinance' AND session IS DISTINCT FROM 'regular' AND s IN ('stalled', 'silent') THEN 'quiet' ELSE s END AS status
FROM judged
""",
)
def source_health(t: Tables) -> DataFrame:
    """Posts and quotes of the last hour, day and week per source, with a status; every source has a row."""
    inside = F.col("timestamp") > ago("7 DAYS")
    counts = [F.count_if(F.col("timestamp") > ago("1 HOUR")).alias("posts_1h"), F.count_if(F.col("timestamp") > ago("24 HOURS")).alias("posts_24h"), F.max("timestamp").alias("last_ingest")]
    seen = t.posts.where(inside & F.col("platform").isin(PLATFORMS)).groupBy("platform").agg(*counts)
    listed = t.spark.range(1).select(F.posexplode(F.array(*map(F.lit, PLATFORMS))).alias("position", "platform"))
    feeds = listed.join(seen, "platform", "left").select("position", "platform", F.coalesce("posts_1h", F.lit(0)).alias("posts_1h"), F.coalesce("posts_24h", F.lit(0)).alias("posts_24h"), "last_ingest", F.lit(None).cast("string").alias("session"))
    market = t.quotes.where(inside).agg(*counts, F.max_by("market_session", "timestamp").alias("session")).select(F.lit(len(PLATFORMS)).alias("position"), F.lit("yfinance").alias("platform"), "posts_1h", "posts_24h", "last_ingest", "session")
    age = F.floor((F.unix_micros(as_of()) - F.unix_micros("last_ingest")) / 1000) / 1000
    rows = feeds.unionByName(market).withColumn("age_seconds", age).withColumn("status", status(F.col("posts_1h"), F.col("posts_24h"), F.col("age_seconds")))
    shut = (F.col("platform") == "yfinance") & ~F.col("session").eqNullSafe("regular") & F.col("status").isin("stalled", "silent")
    rows = rows.withColumn("status", F.when(shut, "quiet").otherwise(F.col("status")))
    return rows.orderBy(severity(F.col("status")), "position").select("platform", "posts_1h", "posts_24h", ntz("last_ingest").alias("last_ingest"), "age_seconds", F.when(F.col("posts_24h") > 0, F.round(F.col("posts_24h") / 24, 6)).alias("baseline_per_hour"), "status")


@query("agg4_hourly_counts", f"SELECT symbol, date_trunc('hour', timestamp) AS bucket_hour, count(*) AS n FROM posts WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAYS AND timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 4 HOURS GROUP BY ALL")
def hourly_counts(t: Tables) -> DataFrame:
    past = t.posts.where((F.col("timestamp") >= ago("28 DAYS")) & (F.col("timestamp") < ago("4 HOURS")))
    return past.groupBy("symbol", F.date_trunc("hour", "timestamp").alias("h")).agg(F.count("*").alias("n")).select("symbol", ntz("h").alias("bucket_hour"), "n")


_BY_BUZZ = _BOARD.replace("SELECT s.symbol, coalesce(c.n, 0) AS posts_4h", ", board AS (SELECT s.symbol, coalesce(c.n, 0) AS posts_4h").replace("), baseline AS (", "), baseline AS (").rstrip() + ")"


@query(
    "ui8_sort_modes",
    _BY_BUZZ
    + " SELECT symbol, posts_4h AS posts, rank() OVER (ORDER BY coalesce(buzz_z, -999) DESC, symbol) AS by_buzz, rank() OVER (ORDER BY posts_4h DESC, symbol) AS by_volume, rank() OVER (ORDER BY coalesce(sentiment_index_4h, -999) DESC, symbol) AS by_sentiment FROM board",
)
def sort_modes(t: Tables) -> DataFrame:
    """Places of the symbols by buzz, volume and sentiment; what has none comes last. One row for each tracked symbol is ranked."""
    from pyspark.sql import Window as W

    place = lambda c: F.rank().over(W.orderBy(F.coalesce(c, F.lit(-999.0)).desc(), "symbol"))
    return leaderboard(t).select("symbol", F.col("posts_4h").alias("posts"), place(F.col("buzz_z")).alias("by_buzz"), place(F.col("posts_4h").cast("double")).alias("by_volume"), place(F.col("sentiment_index_4h")).alias("by_sentiment"))
