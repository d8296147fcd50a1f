"""The correlation endpoint, as one query for each of its parts, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.functions import stats
from brookline.operators import rollup, series as S
from brookline.plans.registry import query
from brookline.sources.views import AS_OF, Tables, as_of, ntz

HOURS = 168
_END, _START = f"TIMESTAMP '{AS_OF}'", f"TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOURS"


def symbols(t: Tables) -> DataFrame:
    return t.tracked_symbols.where("is_active").select("symbol")


def closes(t: Tables) -> DataFrame:
    """Closes of the window and the hour before it; quotes with even volume are taken to be folded into facts already."""
    since = as_of() - F.expr(f"INTERVAL {HOURS + 1} HOURS")
    window = t.quotes.where(F.col("timestamp") >= since)
    folded = F.col("volume") % 2 == 0
    return S.changes(S.hourly_closes(rollup.price_facts(window.where(folded), "hour"), window.where(~folded)))


def hourly_sentiment(t: Tables) -> DataFrame:
    """Facts of older posts and live newer ones are disjoint: they are added."""
    since = as_of() - F.expr(f"INTERVAL {HOURS} HOURS")
    posts = t.posts.where(F.col("timestamp") >= since)
    border = as_of() - F.expr("INTERVAL 72 HOURS")
    cold = rollup.post_facts(posts.where(F.col("timestamp") < border)).select("symbol", "bucket_hour", F.col("weighted_signal_sum").alias("s"), F.col("weight_sum").alias("w"))
    weight = F.log1p(F.greatest("engagement", F.lit(0)).cast("double"))
    hot = posts.where(F.col("timestamp") >= border).select("symbol", F.date_trunc("hour", "timestamp").alias("bucket_hour"), (weight * (F.col("p_pos") - F.col("p_neg"))).alias("s"), weight.alias("w"))
    return cold.unionByName(hot).groupBy("symbol", "bucket_hour").agg(F.sum("s").alias("weighted_signal"), F.sum("w").alias("weight"))


def base(t: Tables) -> DataFrame:
    rows = S.with_sentiment(S.spine(symbols(t), as_of(), HOURS), hourly_sentiment(t)).join(closes(t), ["symbol", "bucket_hour"], "left")
    return rows.withColumn("is_market_open", F.coalesce("is_market_open", F.lit(False)))


def levelled(t: Tables) -> DataFrame:
    all_prices = closes(t).groupBy("symbol").agg(F.collect_list("price").alias("p"), F.max_by("price", "bucket_hour").alias("latest"))
    overall = all_prices.select("symbol", stats.percentile(F.col("p"), 0.05).alias("support_all"), stats.percentile(F.col("p"), 0.95).alias("resistance_all"))
    return S.levels(S.momentum(base(t), HOURS), all_prices.select("symbol", "latest"), overall)


CLOSES_SQL = f"""
closes_h AS (
  SELECT symbol, date_trunc('hour', timestamp) AS bucket_hour, arg_max(price, timestamp) AS price, bool_or(market_session = 'regular') AS is_market_open
  FROM quotes WHERE timestamp >= {_START} - INTERVAL 1 HOUR GROUP BY ALL
), changed AS (
  SELECT *, CASE WHEN lag(bucket_hour) OVER w = bucket_hour - INTERVAL 1 HOUR AND lag(price) OVER w <> 0 THEN (price - lag(price) OVER w) / lag(price) OVER w * 100 END AS price_change
  FROM closes_h WINDOW w AS (PARTITION BY symbol ORDER BY bucket_hour)
)"""
BASE_SQL = (
    CLOSES_SQL
    + f""", sums AS (
  SELECT symbol, date_trunc('hour', timestamp) AS bucket_hour, sum(ln(greatest(engagement, 0) + 1) * (p_pos - p_neg)) AS s, sum(ln(greatest(engagement, 0) + 1)) AS w FROM posts WHERE timestamp >= {_START} GROUP BY ALL
), base AS (
  SELECT s.symbol, h AS bucket_hour, CASE WHEN w > 0 THEN sums.s / w END AS momentum_index, CASE WHEN w > 0 THEN sums.s / w ELSE 0 END AS sentiment_index, price, price_change, coalesce(is_market_open, false) AS is_market_open
  FROM (SELECT symbol FROM tracked_symbols WHERE is_active) s CROSS JOIN generate_series({_START}, {_END}, INTERVAL 1 HOUR) g(h)
  LEFT JOIN sums ON sums.symbol = s.symbol AND sums.bucket_hour = h LEFT JOIN changed c ON c.symbol = s.symbol AND c.bucket_hour = h
)"""
)
LEVELS_SQL = (
    BASE_SQL
    + """, filled AS (
  SELECT *, last_value(momentum_index IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bucket_hour) AS f, avg(sentiment_index) OVER (PARTITION BY symbol ORDER BY bucket_hour ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS sentiment_sma FROM base
), lines AS (
  SELECT *, CASE WHEN count(f) OVER a = 12 THEN avg(f) OVER a END - CASE WHEN count(f) OVER b = 26 THEN avg(f) OVER b END AS macd
  FROM filled WINDOW a AS (PARTITION BY symbol ORDER BY bucket_hour ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY bucket_hour ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)
), momentum AS (
  SELECT *, CASE WHEN count(macd) OVER a = 9 THEN avg(macd) OVER a END AS signal FROM lines WINDOW a AS (PARTITION BY symbol ORDER BY bucket_hour ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)
), overall AS (
  SELECT symbol, list_sort(list(price))[floor((count(price) - 1) * 0.05)::INT + 1] AS support_all, list_sort(list(price))[floor((count(price) - 1) * 0.95)::INT + 1] AS resistance_all, arg_max(price, bucket_hour) AS latest FROM changed GROUP BY symbol
), recent AS (
  SELECT m.*, list_sort(list(price) FILTER (price IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bucket_hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) AS p FROM momentum m
), levels AS (
  SELECT r.*, o.latest, coalesce(o.support_all, 0) AS support_all, CASE WHEN len(p) > 0 THEN p[floor((len(p) - 1) * 0.05)::INT + 1] ELSE coalesce(support_all, 0) END AS support, CASE WHEN len(p) > 0 THEN p[floor((len(p) - 1) * 0.95)::INT + 1] ELSE coalesce(resistance_all, 0) END AS resistance
  FROM recent r LEFT JOIN overall o USING (symbol)
)"""
)


@query("win1_hourly_changes", CLOSES_SQL + " SELECT symbol, bucket_hour, price, is_market_open, round(price_change, 6) AS price_change FROM changed")
def hourly_changes(t: Tables) -> DataFrame:
    return closes(t).select("symbol", ntz("bucket_hour").alias("bucket_hour"), "price", "is_market_open", F.round("price_change", 6).alias("price_change"))


@query("dt12_spine", f"SELECT symbol, g AS bucket_hour FROM tracked_symbols, generate_series({_START}, {_END}, INTERVAL 1 HOUR) s(g) WHERE is_active")
def spine(t: Tables) -> DataFrame:
    return S.spine(symbols(t), as_of(), HOURS).select("symbol", ntz("bucket_hour").alias("bucket_hour"))


@query("jn16_sentiment_on_spine", BASE_SQL + " SELECT symbol, bucket_hour, round(sentiment_index, 6) AS sentiment_index, round(momentum_index, 6) AS momentum_index, price, is_market_open FROM base")
def sentiment_on_spine(t: Tables) -> DataFrame:
    return base(t).select("symbol", ntz("bucket_hour").alias("bucket_hour"), F.round("sentiment_index", 6).alias("sentiment_index"), F.round("momentum_index", 6).alias("momentum_index"), "price", "is_market_open")


@query("win5_momentum", LEVELS_SQL + " SELECT symbol, bucket_hour, round(sentiment_sma, 6) AS sentiment_sma, round(macd, 6) AS macd, round(signal, 6) AS signal, round(macd - signal, 6) AS hist FROM momentum")
def momentum(t: Tables) -> DataFrame:
    return S.momentum(base(t), HOURS).select("symbol", ntz("bucket_hour").alias("bucket_hour"), *[F.round(c, 6).alias(c) for c in ("sentiment_sma", "macd", "signal", "hist")])


@query(
    "win6_levels",
    LEVELS_SQL + " SELECT symbol, bucket_hour, support, resistance, round(coalesce(CASE WHEN latest <> 0 THEN (support - latest) / latest * 100 END, 0), 6) AS support_pct, round(coalesce(CASE WHEN latest <> 0 THEN (resistance - latest) / latest * 100 END, 0), 6) AS resistance_pct, round(CASE WHEN latest <> 0 THEN (price - latest) / latest * 100 END, 6) AS price_pct FROM levels",
)
def levels(t: Tables) -> DataFrame:
    return levelled(t).select("symbol", ntz("bucket_hour").alias("bucket_hour"), "support", "resistance", *[F.round(c, 6).alias(c) for c in ("support_pct", "resistance_pct", "price_pct")])


SWEEP_SQL = (
    BASE_SQL
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket_hour) AS i FROM base),
pairs AS (
  SELECT a.symbol, l.lag, a.sentiment_index AS x, b.price_change AS y FROM numbered a CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) l JOIN numbered b ON b.symbol = a.symbol AND b.i = a.i + l.lag WHERE b.is_market_open AND b.price_change IS NOT NULL
), sums AS (
  SELECT symbol, lag, count(*) AS n, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM pairs GROUP BY ALL
), sweep AS (
  SELECT s.symbol, l.lag, coalesce(CASE WHEN n >= 4 AND sqrt(sxx * syy) > 2.3e-16 THEN greatest(-1, least(1, sxy / sqrt(sxx * syy))) END, 0) AS r
  FROM (SELECT symbol FROM tracked_symbols WHERE is_active) s CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) l LEFT JOIN sums ON sums.symbol = s.symbol AND sums.lag = l.lag
), best AS (
  SELECT symbol, arg_max(r, abs(r) * 1000000 - lag / 1e6) AS max_r, arg_max(lag, abs(r) * 1000000 - lag / 1e6) AS lag FROM sweep GROUP BY symbol
)"""
).replace("sums AS (\n  SELECT symbol, lag", "lag_sums AS (\n  SELECT symbol, lag").replace("LEFT JOIN sums ON sums.symbol = s.symbol AND sums.lag = l.lag", "LEFT JOIN lag_sums ON lag_sums.symbol = s.symbol AND lag_sums.lag = l.lag")


@query("win14_lag_sweep", SWEEP_SQL + " SELECT symbol, lag::INT AS lag, round(r, 6) AS r FROM sweep")
def lag_sweep(t: Tables) -> DataFrame:
    return S.lag_sweep(base(t)).select("symbol", "lag", F.round("r", 6).alias("r"))


@query(
    "mth20_correlation_summary",
    SWEEP_SQL
    + """ SELECT symbol, round(max_r, 6) AS max_r, CASE WHEN max_r = 0 THEN 0 ELSE lag::INT END AS best_lag, CASE WHEN abs(max_r) > 0.6 THEN 'strong' WHEN abs(max_r) > 0.35 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN abs(max_r) < 0.15 THEN 'Weak or no correlation (r = ' || CASE WHEN max_r >= 0 THEN '+' ELSE '' END || printf('%.2f', max_r) || ')'
    ELSE CASE WHEN lag > 0 THEN 'Sentiment leads price by ' || lag || 'h' WHEN lag < 0 THEN 'Price leads sentiment by ' || -lag || 'h' ELSE 'Coincident correlation' END || CASE WHEN max_r >= 0 THEN ' (positive, r = +' ELSE ' (negative, r = ' END || printf('%.2f', max_r) || ')' END AS correlation_text FROM best""",
)
def correlation_summary(t: Tables) -> DataFrame:
    best = S.best_lag(S.lag_sweep(base(t)))
    r = F.col("max_r")
    return best.select("symbol", F.round(r, 6).alias("max_r"), "best_lag", stats.strength(r, 0.35, 0.6, strict=True).alias("strength"), S.correlation_text(r, F.col("best_lag")).alias("correlation_text"))


@query(
    "win10_closed_regions",
    BASE_SQL
    + """, marked AS (SELECT *, NOT is_market_open AS shut, max(bucket_hour) OVER (PARTITION BY symbol) AS last_hour, CASE WHEN NOT is_market_open AND coalesce(lag(is_market_open) OVER (PARTITION BY symbol ORDER BY bucket_hour), true) THEN 1 ELSE 0 END AS fresh FROM base),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY bucket_hour) AS island FROM marked), regions AS (SELECT symbol, island, min(bucket_hour) AS start, max(bucket_hour) AS "end", any_value(last_hour) AS last_hour FROM islands WHERE shut GROUP BY symbol, island),
now AS (SELECT symbol, arg_max(market_session, timestamp) AS market_session FROM quotes GROUP BY symbol)
SELECT symbol, start, "end" FROM regions LEFT JOIN now USING (symbol) WHERE NOT ("end" = last_hour AND market_session IS NOT DISTINCT FROM 'regular') AND "end" - start >= INTERVAL 8 HOURS""",
)
def closed_regions(t: Tables) -> DataFrame:
    now = t.quotes.groupBy("symbol").agg(F.max_by("market_session", "timestamp").alias("market_session"))
    return S.closed_regions(base(t), now).select("symbol", ntz("start").alias("start"), ntz("end").alias("end"))


# No input table has a volatility index or valuations: they follow from the hour and the symbol, so that all bands, and gaps, occur.
_VIX = "CASE WHEN hour(bucket_hour) % 5 < 4 THEN 12 + 4 * (hour(bucket_hour) % 5) END"
_VALUATION = "CASE symbol WHEN 'click' THEN 0.5 WHEN 'view' THEN -0.5 WHEN 'error' THEN 0 END"


def vix() -> Column:
    """12, 16, 20, 24, then none."""
    k = F.hour("bucket_hour") % 5
    return F.when(k < 4, 12.0 + 4 * k)


def valuation() -> Column:
    return F.when(F.col("symbol") == "click", 0.5).when(F.col("symbol") == "view", -0.5).when(F.col("symbol") == "error", 0.0)


_OPPORTUNITY_SQL = (
    LEVELS_SQL
    + f""", trail AS (
  SELECT *, list(price) FILTER (price IS NOT NULL) OVER w AS ps, list(sentiment_index) OVER w AS ss, list(price) FILTER (price IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bucket_hour ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS ahead
  FROM levels WINDOW w AS (PARTITION BY symbol ORDER BY bucket_hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
), points AS (
  SELECT *, CASE WHEN price > 0 AND support_all > 0 THEN (price - support_all) / price END AS distance, coalesce(len(ps) >= 3 AND len(ss) >= 3 AND ps[-1] - ps[1] < 0 AND ss[-1] - ss[1] > 0.1, false) AS diverges FROM trail
), scored AS (
  SELECT *, 10.0 * (CASE WHEN distance <= 0.025 THEN 3.0 WHEN distance <= 0.05 THEN 1.5 ELSE 0 END + CASE WHEN sentiment_index > sentiment_sma THEN CASE WHEN sentiment_sma > 0 THEN 3.0 ELSE 1.5 END ELSE 0 END + CASE WHEN diverges THEN 2.0 ELSE 0 END + CASE WHEN valuation > 0 THEN 2.0 WHEN valuation = 0 THEN 1.0 ELSE 0 END) AS raw FROM (SELECT *, {_VALUATION} AS valuation, coalesce({_VIX}, 15) AS vix FROM points)
), final AS (
  SELECT *, greatest(0, least(100, raw))::DOUBLE AS score FROM scored
)"""
)


@query(
    "mth15_opportunities",
    _OPPORTUNITY_SQL
    + """ SELECT symbol, bucket_hour, score, CASE WHEN score >= 75 THEN 'STRONG BUY' WHEN score >= 50 THEN 'ACCUMULATE' WHEN score >= 30 THEN 'HOLD / NEUTRAL' ELSE 'CAUTION / OVERBOUGHT' END AS classification, CASE WHEN score >= 75 THEN 'emerald' WHEN score >= 50 THEN 'teal' WHEN score >= 30 THEN 'slate' ELSE 'rose' END AS color,
  CASE WHEN score >= 50 THEN CASE WHEN vix < 15 THEN 'Long Call Option (Buy Call)' WHEN vix <= 22 THEN 'Long Shares / Bull Call Spread' ELSE 'Sell Put Credit Spreads' END WHEN score >= 30 THEN 'Hold / Sell Covered Calls' WHEN vix > 22 THEN 'Sell Call Credit Spreads' ELSE 'Protect Longs / Buy Puts' END AS strategy, score >= 50 AS buy_signal,
  CASE WHEN score < 50 OR price IS NULL OR coalesce(len(ahead), 0) = 0 THEN 'pending' WHEN list_max(ahead[1:2]) > price * 1.002 THEN 'good' ELSE 'bad' END AS signal_quality,
  concat_ws(';', CASE WHEN distance <= 0.025 THEN 'Price near support level' WHEN distance <= 0.05 THEN 'Price approaching support level' END, CASE WHEN sentiment_index > sentiment_sma THEN CASE WHEN sentiment_sma > 0 THEN 'Bullish sentiment crossover (above positive SMA)' ELSE 'Bullish sentiment crossover (above negative SMA)' END END,
    CASE WHEN diverges THEN 'Bullish sentiment divergence (price down, sentiment rising)' END, CASE WHEN valuation > 0 THEN 'Undervalued relative to sector benchmarks' WHEN valuation = 0 THEN 'Fairly valued relative to sector benchmarks' END) AS checklist FROM final""",
)
def opportunities(t: Tables) -> DataFrame:
    out = S.scored(levelled(t), vix(), valuation())
    return out.select("symbol", ntz("bucket_hour").alias("bucket_hour"), *[F.col(f"opportunity.{c}").alias(c) for c in ("score", "classification", "color", "strategy")], "buy_signal", "signal_quality", F.array_join("opportunity.checklist", ";").alias("checklist"))


@query("mth19_current_opportunity", _OPPORTUNITY_SQL + f" SELECT symbol, score, price, round(sentiment_index, 6) AS sentiment_index FROM final WHERE bucket_hour = {_END}")
def current_opportunity(t: Tables) -> DataFrame:
    out = S.scored(levelled(t), vix(), valuation()).where(F.col("bucket_hour") == as_of())
    return out.select("symbol", F.col("opportunity.score").alias("score"), "price", F.round("sentiment_index", 6).alias("sentiment_index"))


@query("ui9_price_axis", CLOSES_SQL + " SELECT symbol, min(price) - 0.1 * (max(price) - min(price)) AS low, max(price) + 0.1 * (max(price) - min(price)) AS high FROM changed GROUP BY symbol")
def price_axis(t: Tables) -> DataFrame:
    spread = F.max("price") - F.min("price")
    return closes(t).groupBy("symbol").agg((F.min("price") - 0.1 * spread).alias("low"), (F.max("price") + 0.1 * spread).alias("high"))


@query("ui8_open_hour_shares", BASE_SQL + " SELECT b.symbol, b.bucket_hour, round(100.0::DOUBLE * count(*) FILTER (sentiment = 'positive') / count(*), 6) AS positive_pct, round(100.0::DOUBLE * count(*) FILTER (sentiment = 'negative') / count(*), 6) AS negative_pct FROM base b JOIN posts p ON p.symbol = b.symbol AND date_trunc('hour', p.timestamp) = b.bucket_hour WHERE b.is_market_open GROUP BY ALL")
def open_hour_shares(t: Tables) -> DataFrame:
    """Class shares of the hours in which the market was open."""
    share = lambda s: F.round(100 * F.count_if(F.col("sentiment") == s) / F.count("*"), 6)
    counts = t.posts.groupBy("symbol", F.date_trunc("hour", "timestamp").alias("bucket_hour")).agg(share("positive").alias("positive_pct"), share("negative").alias("negative_pct"))
    open_ = base(t).where("is_market_open").select("symbol", "bucket_hour")
    return open_.join(counts, ["symbol", "bucket_hour"]).select("symbol", ntz("bucket_hour").alias("bucket_hour"), "positive_pct", "negative_pct")
