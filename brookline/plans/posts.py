"""Counts, pages and shares of posts, and the parameters of the requests for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookline.plans.registry import query
from brookline.sources.views import AS_OF, OUTLIER, Tables, as_of, ntz

SENTIMENTS = ("positive", "neutral", "negative")


def hours(value: int | None, default: int = 24) -> int:
    n = default if value is None else value
    if not 1 <= n <= 8760:
        raise ValueError("hours must be between 1 and 8760")
    return n


def page(limit: int | None, offset: int | None) -> tuple[int, int]:
    limit, offset = 20 if limit is None else limit, offset or 0
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return limit, offset


def horizon(value: int) -> int:
    if value not in (30, 90):
        raise ValueError("horizon must be 30 or 90")
    return value


def symbol(value: str) -> str:
    return value.strip().upper()


def given(value: str | None) -> str | None:
    """A filter's value; `all` means none."""
    return None if value is None or value == "all" else value


def filtered(posts: DataFrame, symbol: str | None = None, platform: str | None = None, sentiment: str | None = None, topic: str | None = None, hour: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Posts that meet the conditions that are given; each one is a filter that reaches the scan. An hour is a half-open range."""
    if sentiment is not None and given(sentiment) not in (None, *SENTIMENTS):
        raise ValueError(f"sentiment must be one of {SENTIMENTS}")
    for name, value in (("symbol", symbol), ("platform", platform), ("sentiment", sentiment), ("topic_label", topic)):
        if given(value) is not None:
            posts = posts.where(F.col(name) == value)
    if hour is not None:
        begin = datetime.fromisoformat(hour).replace(minute=0, second=0, microsecond=0, tzinfo=None)
        at = F.lit(str(begin)).cast("timestamp")
        posts = posts.where((F.col("timestamp") >= at) & (F.col("timestamp") < at + F.expr("INTERVAL 1 HOUR")))
    if start is not None:
        posts = posts.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        posts = posts.where(F.col("timestamp") < F.lit(end).cast("timestamp"))
    return posts


def since(h: int) -> Column:
    return as_of() - F.expr(f"INTERVAL {h} HOURS")


def newest(posts: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    n, skip = page(limit, offset)
    return posts.orderBy(F.desc("timestamp"), F.desc("id")).offset(skip).limit(n)


@query("agg1_dashboard_sentiment", f"SELECT sentiment, count(*) AS n FROM posts WHERE symbol = 'click' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS GROUP BY sentiment")
def dashboard_sentiment(t: Tables) -> DataFrame:
    return t.posts.where((F.col("symbol") == "click") & (F.col("timestamp") >= since(hours(168)))).groupBy("sentiment").agg(F.count("*").alias("n"))


@query("agg1_stats_sentiment", f"SELECT sentiment, count(*) AS n FROM posts WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 720 HOURS GROUP BY sentiment")
def stats_sentiment(t: Tables) -> DataFrame:
    return t.posts.where(F.col("timestamp") > since(hours(720))).groupBy("sentiment").agg(F.count("*").alias("n"))


@query("agg2_topics", f"SELECT symbol, topic_label, count(*) AS n FROM posts WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 720 HOURS GROUP BY ALL")
def topics(t: Tables) -> DataFrame:
    return t.posts.where(F.col("timestamp") > since(hours(720))).groupBy("symbol", "topic_label").agg(F.count("*").alias("n")).orderBy("symbol", F.desc("n"), "topic_label")


@query("ui7_topic_shares", "SELECT topic_label, n, round(100.0::DOUBLE * n / sum(n) OVER ())::BIGINT AS share_pct FROM (SELECT topic_label, count(*) AS n FROM posts GROUP BY topic_label)")
def topic_shares(t: Tables) -> DataFrame:
    counts = t.posts.groupBy("topic_label").agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy())).cast("long"))


_PAGE = "SELECT id, symbol, platform, text, timestamp, sentiment, topic_label, engagement FROM posts WHERE {} ORDER BY timestamp DESC, id DESC LIMIT {} OFFSET {}"
_COLUMNS = ("id", "symbol", "platform", "text", "timestamp", "sentiment", "topic_label", "engagement")


def shown(posts: DataFrame) -> DataFrame:
    return posts.select(*[ntz(c).alias(c) if c == "timestamp" else c for c in _COLUMNS])


@query("src3_posts_page", _PAGE.format("symbol = 'view' AND platform = 'finnhub' AND sentiment = 'positive' AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-25 00:00:00'", 20, 5))
def posts_page(t: Tables) -> DataFrame:
    rows = filtered(t.posts, "view", "finnhub", "positive", "all", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return shown(newest(rows, 20, 5))


@query("flt2_posts_of_hour", _PAGE.format("date_trunc('hour', timestamp) = TIMESTAMP '2024-01-16 15:00:00'", 1000, 0))
def posts_of_hour(t: Tables) -> DataFrame:
    return shown(newest(filtered(t.posts, hour="2024-01-16T15:42:00"), 1000))


@query("srt1_newest_posts", _PAGE.format("symbol = 'purchase'", 500, 0))
def newest_posts(t: Tables) -> DataFrame:
    return shown(newest(filtered(t.posts, "purchase"), 500))


@query("src23_unclassified_posts", "SELECT id, symbol, timestamp FROM posts WHERE topic_id = -1 ORDER BY timestamp DESC, id DESC")
def unclassified(t: Tables, limit: int | None = None) -> DataFrame:
    """Posts without a topic, newest first, for a later classification: all of them, or the first `limit` if it is given."""
    none = t.posts.withColumn("topic_label", F.when(F.col("topic_id") >= 0, F.col("topic_label"))).where(F.col("topic_label").isNull())
    rows = none.orderBy(F.desc("timestamp"), F.desc("id")).select("id", "symbol", ntz("timestamp").alias("timestamp"))
    return rows if limit is None else rows.limit(limit)


@query("src2_active_symbols", "SELECT symbol FROM tracked_symbols WHERE is_active")
def active_symbols(t: Tables) -> DataFrame:
    return t.tracked_symbols.where("is_active").select("symbol").orderBy("symbol")


@query(
    "ui1_sentiment_shares",
    "SELECT symbol, bull, bear, greatest(0, 100 - bull - bear) AS neutral FROM (SELECT symbol, round(100.0::DOUBLE * count(*) FILTER (sentiment = 'positive') / count(*))::BIGINT AS bull, round(100.0::DOUBLE * count(*) FILTER (sentiment = 'negative') / count(*))::BIGINT AS bear FROM posts GROUP BY symbol)",
)
def sentiment_shares(t: Tables) -> DataFrame:
    """Whole percentages that add up: neutral is what the others leave."""
    share = lambda s: F.round(100 * F.count_if(F.col("sentiment") == s) / F.count("*")).cast("long")
    rows = t.posts.groupBy("symbol").agg(share("positive").alias("bull"), share("negative").alias("bear"))
    return rows.withColumn("neutral", F.greatest(F.lit(0), 100 - F.col("bull") - F.col("bear")))


@query(
    "ui2_retail_news_divergence",
    """
marked AS (SELECT symbol, platform IN ('finnhub', 'alpaca') AS news, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS s FROM posts),
g AS (SELECT symbol, count(*) FILTER (NOT news) AS n_social, count(*) FILTER (news) AS n_news, avg(s) FILTER (NOT news) - avg(s) FILTER (news) AS gap FROM marked GROUP BY symbol)
SELECT symbol, n_social, n_news, CASE WHEN n_social >= 5 AND n_news >= 2 THEN round(gap, 6) END AS divergence,
  CASE WHEN n_social < 5 OR n_news < 2 THEN 'unknown' WHEN gap > 0.15 THEN 'retail bullish' WHEN gap < -0.15 THEN 'retail bearish' ELSE 'aligned' END AS reading FROM g
""",
)
def retail_news_divergence(t: Tables) -> DataFrame:
    news, score = F.col("platform").isin("finnhub", "alpaca"), F.when(F.col("sentiment") == "positive", 1).when(F.col("sentiment") == "negative", -1).otherwise(0)
    g = t.posts.groupBy("symbol").agg(F.count_if(~news).alias("n_social"), F.count_if(news).alias("n_news"), (F.avg(F.when(~news, score)) - F.avg(F.when(news, score))).alias("gap"))
    enough = (F.col("n_social") >= 5) & (F.col("n_news") >= 2)
    reading = F.when(~enough, "unknown").when(F.col("gap") > 0.15, "retail bullish").when(F.col("gap") < -0.15, "retail bearish").otherwise("aligned")
    return g.select("symbol", "n_social", "n_news", F.when(enough, F.round("gap", 6)).alias("divergence"), reading.alias("reading"))


@query("ui6_outlier_feed", f"SELECT platform IN ('finnhub', 'alpaca') AS is_news, count(*) AS n FROM posts WHERE topic_label = '{OUTLIER}' GROUP BY ALL")
def outlier_feed(t: Tables) -> DataFrame:
    """Posts without a topic, a missing label being the outlier topic, by kind of feed."""
    return t.posts.where(F.coalesce("topic_label", F.lit(OUTLIER)) == OUTLIER).groupBy(F.col("platform").isin("finnhub", "alpaca").alias("is_news")).agg(F.count("*").alias("n"))


@query("str11_platform_totals", "SELECT platform, sentiment, count(*) AS n, sum(engagement)::BIGINT AS engagement FROM posts GROUP BY ALL")
def platform_totals(t: Tables) -> DataFrame:
    return t.posts.groupBy("platform", "sentiment").agg(F.count("*").alias("n"), F.sum("engagement").alias("engagement"))


@query("prj1_signal_and_weight", "SELECT id, round(p_pos - p_neg, 6) AS signal, round(ln(greatest(engagement, 0) + 1), 6) AS weight, concat_ws(':', platform, topic_model_hash, topic_id, sentiment_model_hash, sentiment) AS stratum FROM posts")
def signal_and_weight(t: Tables) -> DataFrame:
    """Probabilities fall back to the label where a score is missing; engagement weighs by its logarithm."""
    scores = F.create_map(F.lit("positive"), F.col("p_pos"), F.lit("neutral"), F.col("p_neu"), F.lit("negative"), F.col("p_neg"))
    p = lambda k: F.coalesce(F.element_at(scores, F.lit(k)), F.when(F.col("sentiment") == k, 1.0).otherwise(0.0))
    return t.posts.select("id", F.round(p("positive") - p("negative"), 6).alias("signal"), F.round(F.log1p(F.greatest("engagement", F.lit(0))), 6).alias("weight"), F.concat_ws(":", "platform", "topic_model_hash", F.col("topic_id").cast("string"), "sentiment_model_hash", "sentiment").alias("stratum"))
