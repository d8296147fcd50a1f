"""Hourly series on a dense spine: prices, sentiment, momentum, levels, scores. All symbols at once, partitioned by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookline.functions import stats

def by_symbol():
    """The line of a symbol's hours."""
    return W.partitionBy("symbol").orderBy("bucket_hour")


def periods(hours: int) -> tuple[int, int, int]:
    """Fast, slow and signal periods for a window of so many hours."""
    fast = 3 if hours <= 1 else 5 if hours <= 24 else 12 if hours <= 168 else 24 if hours <= 720 else 52
    slow, signal = (6, 3) if hours <= 1 else (12, 5) if hours <= 24 else (26, 9) if hours <= 168 else (52, 12)
    return fast, slow, signal


def spine(symbols: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """hours + 1 hourly buckets for each symbol, the last one that of as_of."""
    end = F.date_trunc("hour", as_of)
    return symbols.select("symbol", F.explode(F.sequence(end - F.expr(f"INTERVAL {hours} HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("bucket_hour"))


def hourly_closes(facts: DataFrame, quotes: DataFrame) -> DataFrame:
    """One close per symbol and hour from price facts and the quotes that are not folded yet: the later observation wins, quotes on a tie."""
    cold = facts.select("symbol", "bucket_hour", F.col("close_price").alias("price"), F.col("had_regular_session").alias("open"), "last_observed_at", F.lit(0).alias("hot"))
    hot = quotes.groupBy("symbol", F.date_trunc("hour", "timestamp").alias("bucket_hour")).agg(F.max_by("price", "timestamp").alias("price"), F.bool_or(F.col("market_session") == "regular").alias("open"), F.max("timestamp").alias("last_observed_at")).withColumn("hot", F.lit(1))
    both = cold.unionByName(hot).groupBy("symbol", "bucket_hour")
    return both.agg(F.max_by("price", F.struct("last_observed_at", "hot")).alias("price"), F.bool_or("open").alias("is_market_open"))


def changes(closes: DataFrame) -> DataFrame:
    """Percent change against the hour before, where there is one."""
    before, price = F.lag("bucket_hour").over(by_symbol()), F.lag("price").over(by_symbol())
    follows = (before == F.col("bucket_hour") - F.expr("INTERVAL 1 HOUR")) & (price != 0)
    return closes.withColumn("price_change", F.when(follows, F.try_divide(F.col("price") - price, price) * 100))


def with_sentiment(spine_: DataFrame, hourly: DataFrame) -> DataFrame:
    """The spine with weighted sums of each hour: index 0 for display, NULL for momentum, where nothing has weight."""
    rows = spine_.join(hourly, ["symbol", "bucket_hour"], "left")
    index = F.when(F.col("weight") > 0, F.col("weighted_signal") / F.col("weight"))
    return rows.withColumn("momentum_index", index).withColumn("sentiment_index", F.coalesce(index, F.lit(0.0)))


def momentum(series: DataFrame, hours: int) -> DataFrame:
    """Shrinking moving average of the index, and the strict averages' difference, its signal and their distance."""
    fast, slow, signal = periods(hours)
    out = series.withColumn("sentiment_sma", F.avg("sentiment_index").over(by_symbol().rowsBetween(-(fast - 1), 0)))
    return stats.macd(out, "momentum_index", ["symbol"], "bucket_hour", fast, slow, signal)


def levels(series: DataFrame, latest: DataFrame, overall: DataFrame) -> DataFrame:
    """Support and resistance of the last 24 buckets (of the whole series where they have no price), in price and in percent of the latest price."""
    recent = F.collect_list("price").over(by_symbol().rowsBetween(-23, 0))
    out = series.withColumn("_recent", recent).join(latest, "symbol", "left").join(overall, "symbol", "left")
    some = F.size("_recent") > 0
    out = out.withColumn("support", F.when(some, stats.percentile(F.col("_recent"), 0.05)).otherwise(F.coalesce("support_all", F.lit(0.0))))
    out = out.withColumn("resistance", F.when(some, stats.percentile(F.col("_recent"), 0.95)).otherwise(F.coalesce("resistance_all", F.lit(0.0))))
    against = lambda c: F.when(F.col("latest") != 0, (F.col(c) - F.col("latest")) / F.col("latest") * 100)
    return out.withColumn("support_pct", F.coalesce(against("support"), F.lit(0.0))).withColumn("resistance_pct", F.coalesce(against("resistance"), F.lit(0.0))).withColumn("price_pct", against("price")).drop("_recent")


def lag_sweep(series: DataFrame, most: int = 5) -> DataFrame:
    """(symbol, lag, r): sentiment of bucket i with the price change of bucket i + lag, where the market was open; 0 for fewer than four pairs.

    One scan gives the 2 * most + 1 shifted columns; they are then aggregated together.
    """
    change = F.when(F.col("is_market_open"), F.col("price_change"))
    lags = range(-most, most + 1)
    shifted = series.select("symbol", "sentiment_index", *[F.lead(change, k).over(by_symbol()).alias(f"c{k + most}") if k >= 0 else F.lag(change, -k).over(by_symbol()).alias(f"c{k + most}") for k in lags])
    return _correlated(shifted, most)


def _correlated(shifted: DataFrame, most: int) -> DataFrame:
    rs = [F.coalesce(stats.pearson(f"c{k + most}", "sentiment_index", 4), F.lit(0.0)) for k in range(-most, most + 1)]
    wide = shifted.groupBy("symbol").agg(F.array(*rs).alias("r"))
    return wide.select("symbol", F.posexplode("r").alias("p", "r")).select("symbol", (F.col("p") - most).alias("lag"), "r")


def best_lag(sweep: DataFrame) -> DataFrame:
    """The lag with the largest |r|, the smallest of equals; lag 0 if all are 0."""
    top = sweep.groupBy("symbol").agg(F.max_by(F.struct("r", "lag"), F.struct(F.abs("r"), -F.col("lag"))).alias("t"))
    return top.select("symbol", F.col("t.r").alias("max_r"), F.when(F.col("t.r") == 0, 0).otherwise(F.col("t.lag")).alias("best_lag"))


def correlation_text(r: Column, lag: Column) -> Column:
    number = F.concat(F.when(r >= 0, "+").otherwise(""), F.format_string("%.2f", r))
    tail = F.concat(F.lit(" ("), F.when(r >= 0, "positive").otherwise("negative"), F.lit(", r = "), number, F.lit(")"))
    lead = F.when(lag > 0, F.concat(F.lit("Sentiment leads price by "), lag.cast("string"), F.lit("h"))).when(lag < 0, F.concat(F.lit("Price leads sentiment by "), F.abs(lag).cast("string"), F.lit("h"))).otherwise("Coincident correlation")
    return F.when(F.abs(r) >= 0.15, F.concat(lead, tail)).otherwise(F.concat(F.lit("Weak or no correlation (r = "), number, F.lit(")")))


# What an opportunity is made of, and its names.
SUPPORT_NEAR, SUPPORT_CLOSE = "Price near support level", "Price approaching support level"
CROSS_POSITIVE, CROSS_NEGATIVE = "Bullish sentiment crossover (above positive SMA)", "Bullish sentiment crossover (above negative SMA)"
DIVERGENCE = "Bullish sentiment divergence (price down, sentiment rising)"
CHEAP, FAIR = "Undervalued relative to sector benchmarks", "Fairly valued relative to sector benchmarks"
CLASSES = [(75.0, "STRONG BUY", "emerald"), (50.0, "ACCUMULATE", "teal"), (30.0, "HOLD / NEUTRAL", "slate"), (0.0, "CAUTION / OVERBOUGHT", "rose")]
STRATEGIES = {
    "calm": "Long Call Option (Buy Call)",
    "moderate": "Long Shares / Bull Call Spread",
    "high": "Sell Put Credit Spreads",
    "hold": "Hold / Sell Covered Calls",
    "high overbought": "Sell Call Credit Spreads",
    "overbought": "Protect Longs / Buy Puts",
}


def opportunity(price: Column, support: Column, index: Column, sma: Column, vix: Column, valuation: Column, prices: Column, indexes: Column) -> Column:
    """Struct of score (0 to 100), classification, color, strategy and checklist; prices and indexes: the trailing window."""
    distance = F.try_divide(price - support, price)
    priced = stats.finite(price) & stats.finite(support) & (support > 0) & (price > 0)
    near, close = priced & (distance <= 0.025), priced & (distance > 0.025) & (distance <= 0.05)
    cross = stats.finite(index) & stats.finite(sma) & (index > sma)
    up = lambda a: F.element_at(a, -1) - F.element_at(a, 1)
    diverges = (F.size(prices) >= 3) & (F.size(indexes) >= 3) & (up(F.when(F.size(prices) >= 3, prices)) < 0) & (up(F.when(F.size(indexes) >= 3, indexes)) > 0.1)
    cheap, fair = stats.finite(valuation) & (valuation > 0), stats.finite(valuation) & (valuation == 0)
    points = [(near, 3.0, SUPPORT_NEAR), (close, 1.5, SUPPORT_CLOSE), (cross & (sma > 0), 3.0, CROSS_POSITIVE), (cross & (sma <= 0), 1.5, CROSS_NEGATIVE), (diverges, 2.0, DIVERGENCE), (cheap, 2.0, CHEAP), (fair, 1.0, FAIR)]
    total = F.lit(0.0)
    for holds, worth, _ in points:
        total = total + F.when(holds, worth).otherwise(0.0)
    score = stats.clamp(total * 10, 0.0, 100.0)
    label, color = (None, None)
    for bound, name, shade in CLASSES:
        label = F.when(score >= bound, name) if label is None else label.when(score >= bound, name)
        color = F.when(score >= bound, shade) if color is None else color.when(score >= bound, shade)
    fear = F.when(stats.finite(vix), vix).otherwise(15.0)
    s = STRATEGIES
    buy = F.when(fear < 15, s["calm"]).when(fear <= 22, s["moderate"]).otherwise(s["high"])
    strategy = F.when(score >= 50, buy).when(score >= 30, s["hold"]).otherwise(F.when(fear > 22, s["high overbought"]).otherwise(s["overbought"]))
    return F.struct(score.alias("score"), label.alias("classification"), color.alias("color"), strategy.alias("strategy"), F.array_compact(F.array(*[F.when(h, text) for h, _, text in points])).alias("checklist"))


def scored(series: DataFrame, vix: Column, valuation: Column) -> DataFrame:
    """Opportunity of each bucket and what became of a buy signal: good if one of the next two prices within 24 buckets is 0.2 % higher."""
    last3 = by_symbol().rowsBetween(-2, 0)
    out = series.withColumn("_p", F.collect_list("price").over(last3)).withColumn("_s", F.collect_list("sentiment_index").over(last3))
    made = opportunity(F.col("price"), F.coalesce("support_all", F.lit(0.0)), F.col("sentiment_index"), F.col("sentiment_sma"), vix, valuation, F.col("_p"), F.col("_s"))
    out = out.withColumn("opportunity", made).withColumn("buy_signal", F.col("opportunity.score") >= 50)
    ahead = F.slice(F.collect_list("price").over(by_symbol().rowsBetween(1, 24)), 1, 2)
    best = F.array_max(ahead)
    quality = F.when(~F.col("buy_signal") | F.col("price").isNull() | best.isNull(), "pending").when(best > F.col("price") * 1.002, "good").otherwise("bad")
    return out.withColumn("signal_quality", quality).drop("_p", "_s")


def closed_regions(series: DataFrame, latest_session: DataFrame) -> DataFrame:
    """(symbol, start, end) of stretches of at least eight closed hours; the one at the end goes if the market is open now."""
    shut = ~F.coalesce("is_market_open", F.lit(False))
    new = F.when(shut & ~F.coalesce(F.lag(shut).over(by_symbol()), F.lit(False)), 1).otherwise(0)
    marked = series.withColumn("_shut", shut).withColumn("_new", new).withColumn("_last", F.max("bucket_hour").over(W.partitionBy("symbol")))
    islands = marked.withColumn("_island", F.sum("_new").over(by_symbol())).where("_shut")
    regions = islands.groupBy("symbol", "_island").agg(F.min("bucket_hour").alias("start"), F.max("bucket_hour").alias("end"), F.first("_last").alias("last"))
    now = regions.join(latest_session, "symbol", "left")
    kept = now.where(~((F.col("end") == F.col("last")) & F.col("market_session").eqNullSafe("regular")))
    return kept.where(F.col("end") - F.col("start") >= F.expr("INTERVAL 8 HOURS")).select("symbol", "start", "end")
