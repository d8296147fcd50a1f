"""Hourly facts as additive statistics: made from posts and quotes, merged with late ones, sampled and pruned.

Facts are sums, counts and bounds only, so facts of two sets of posts merge into the facts of both: whatever arrives
late is folded in by the next run, never dropped. Nonlinear figures are derived after summing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.functions import calendar

KEYS = ["bucket_hour", "symbol", "platform", "topic_id", "topic_model_hash", "sentiment_model_hash"]
COUNTS = ["post_count", "positive_count", "neutral_count", "negative_count"]
SUMS = [f"{c}_prob_{kind}" for kind in ("sum", "sq_sum") for c in ("positive", "neutral", "negative")] + ["signal_sum", "signal_sq_sum", "engagement_sum", "weight_sum", "positive_weight_sum", "neutral_weight_sum", "negative_weight_sum", "weighted_signal_sum", "weighted_signal_sq_sum"]
FIRSTS, LASTS = [f"first_{x}_at" for x in ("event", "ingested", "scored")], [f"last_{x}_at" for x in ("event", "ingested", "scored")]
TIMES = {"event": "timestamp", "ingested": "ingested_at", "scored": "scored_at"}
PRICE_KEYS = {"hour": "bucket_hour", "day": "bucket_day"}


def post_facts(posts: DataFrame) -> DataFrame:
    """One row for each hour, symbol, platform, topic and pair of models. The aggregation combines on the map side, so a hot symbol moves no more rows than others."""
    signal, weight = F.col("p_pos") - F.col("p_neg"), F.log1p(F.greatest("engagement", F.lit(0)).cast("double"))
    is_ = {c: F.col("sentiment") == c for c in ("positive", "neutral", "negative")}
    p = {"positive": F.col("p_pos"), "neutral": F.col("p_neu"), "negative": F.col("p_neg")}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return posts.groupBy(F.date_trunc("hour", "timestamp").alias("bucket_hour"), *KEYS[1:]).agg(
        F.count("*").alias("post_count"),
        *[F.count_if(is_[c]).alias(f"{c}_count") for c in is_],
        *[zero(F.sum(p[c])).alias(f"{c}_prob_sum") for c in p],
        *[zero(F.sum(p[c] * p[c])).alias(f"{c}_prob_sq_sum") for c in p],
        zero(F.sum(signal)).alias("signal_sum"),
        zero(F.sum(signal * signal)).alias("signal_sq_sum"),
        F.coalesce(F.sum("engagement"), F.lit(0)).cast("double").alias("engagement_sum"),
        zero(F.sum(weight)).alias("weight_sum"),
        *[zero(F.sum(F.when(is_[c], weight))).alias(f"{c}_weight_sum") for c in is_],
        zero(F.sum(weight * signal)).alias("weighted_signal_sum"),
        zero(F.sum(weight * signal * signal)).alias("weighted_signal_sq_sum"),
        *[F.min(TIMES[x[6:-3]]).alias(x) for x in FIRSTS],
        *[F.max(TIMES[x[5:-3]]).alias(x) for x in LASTS],
        F.max("ingested_at").alias("input_watermark"),
        F.max_by("topic_label", F.struct("scored_at", "id")).alias("topic_label"),
    )


def merge_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts of both: sums add, bounds widen, what is not additive comes from the new facts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in COUNTS + SUMS],
        *[F.min(c).alias(c) for c in FIRSTS],
        *[F.max(c).alias(c) for c in [*LASTS, "input_watermark"]],
        F.max_by("topic_label", "_new").alias("topic_label"),
    )


def label_facts(posts_or_facts: DataFrame) -> DataFrame:
    """Per symbol and hour from facts: class counts and weights, and the label-weighted index (0 without weight)."""
    index = F.coalesce(F.try_divide(F.col("positive_weighted") - F.col("negative_weighted"), F.col("total_weighted")), F.lit(0.0))
    sums = posts_or_facts.groupBy("symbol", "bucket_hour").agg(
        *[F.sum(f"{c}_count").alias(f"{c}_count") for c in ("positive", "neutral", "negative")],
        *[F.sum(f"{c}_weight_sum").alias(f"{c}_weighted") for c in ("positive", "neutral", "negative")],
        F.sum("weight_sum").alias("total_weighted"),
    )
    return sums.withColumn("sentiment_index", index)


def merge_label_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    keys, sums = ["symbol", "bucket_hour"], [c for c in old.columns if c not in ("symbol", "bucket_hour", "sentiment_index")]
    both = old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return both.withColumn("sentiment_index", F.coalesce(F.try_divide(F.col("positive_weighted") - F.col("negative_weighted"), F.col("total_weighted")), F.lit(0.0)))


def price_facts(quotes: DataFrame, unit: str) -> DataFrame:
    """Open, high, low, close per symbol and UTC hour, or New York day."""
    bucket = F.date_trunc("hour", "timestamp") if unit == "hour" else F.to_date(F.from_utc_timestamp("timestamp", calendar.ZONE))
    return quotes.groupBy("symbol", bucket.alias(PRICE_KEYS[unit])).agg(
        F.min_by("price", "timestamp").alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", "timestamp").alias("close_price"),
        F.max_by("volume", "timestamp").alias("last_volume"),
        F.count("*").alias("observation_count"),
        F.bool_or(F.col("market_session") == "regular").alias("had_regular_session"),
        F.min("timestamp").alias("first_observed_at"),
        F.max("timestamp").alias("last_observed_at"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
    )


def merge_price_facts(old: DataFrame, new: DataFrame, unit: str) -> DataFrame:
    """The open is replaced by one strictly earlier, the close by one as late or later."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first, last = F.struct("first_observed_at", "_new"), F.struct("last_observed_at", "_new")
    return both.groupBy("symbol", PRICE_KEYS[unit]).agg(
        F.min_by("open_price", first).alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", last).alias("close_price"),
        F.max_by("last_volume", last).alias("last_volume"),
        F.sum("observation_count").alias("observation_count"),
        F.bool_or("had_regular_session").alias("had_regular_session"),
        F.min("first_observed_at").alias("first_observed_at"),
        F.max("last_observed_at").alias("last_observed_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("providers")))).alias("providers"),
    )


def fact_violations() -> dict[str, Column]:
    """Conditions on facts; true where one is broken."""
    c = F.col
    tol = F.greatest(F.lit(1e-6), c("post_count") * 1e-6)
    probs = [c(f"{x}_prob_sum") for x in ("positive", "neutral", "negative")]
    squares = [(c(f"{x}_prob_sq_sum"), c(f"{x}_prob_sum")) for x in ("positive", "neutral", "negative")]
    weights = [c(f"{x}_weight_sum") for x in ("positive", "neutral", "negative")]
    n = c("post_count")
    return {
        "counts": (n < 0) | (c("positive_count") + c("neutral_count") + c("negative_count") != n),
        "time order": (c("first_event_at") > c("last_event_at")) | (c("first_ingested_at") > c("last_ingested_at")) | (c("first_scored_at") > c("last_scored_at")),
        "bucket": c("bucket_hour") != F.date_trunc("hour", "bucket_hour"),
        "probabilities": (F.least(*probs) < 0) | (F.greatest(*probs) > n + 1e-6) | (F.abs(probs[0] + probs[1] + probs[2] - n) > tol),
        "squares": F.greatest(*[s - p for s, p in squares]) > 1e-6,
        "signal": (c("signal_sq_sum") > n + 1e-6) | (F.abs("signal_sum") > n + 1e-6),
        "weights": (F.least(*weights) < 0) | (F.abs(weights[0] + weights[1] + weights[2] - c("weight_sum")) > F.greatest(F.lit(1e-6), c("weight_sum") * 1e-6)),
        "weighted signal": (F.abs("weighted_signal_sum") > c("weight_sum") + 1e-6) | (c("weighted_signal_sq_sum") > c("weight_sum") + 1e-6),
    }


def hash_share(*columns: str, tag: str = "sample-v1") -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 over the tag and the columns, joined by the unit separator."""
    text = F.concat_ws("\x1f", F.lit(tag), *columns)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def probability_sample(posts: DataFrame, rate: float, platforms: list[str], *more: str) -> DataFrame:
    chosen = posts.where(F.col("platform").isin(platforms) & (hash_share("platform", "id", "symbol") < rate))
    return chosen.select("id", "platform", "symbol", F.lit("probability").alias("cohort"), F.lit(rate).alias("inclusion_probability"), F.array(F.lit("stratified_probability")).alias("selection_reasons"), *more)


def challenge_sample(posts: DataFrame, engagement: int, signal: float, platforms: list[str], *more: str) -> DataFrame:
    loud, sure = F.col("engagement") >= engagement, F.abs(F.col("p_pos") - F.col("p_neg")) >= signal
    reasons = F.array_compact(F.array(F.when(loud, "high_engagement"), F.when(sure, "extreme_signal")))
    chosen = posts.where(F.col("platform").isin(platforms) & (loud | sure))
    return chosen.select("id", "platform", "symbol", F.lit("challenge").alias("cohort"), F.lit(None).cast("double").alias("inclusion_probability"), reasons.alias("selection_reasons"), *more)


@dataclass
class Rolled:
    """What a retention run leaves; nothing is published until all of it is written."""

    posts: DataFrame
    facts: DataFrame
    labels: DataFrame
    staged: DataFrame
    snapshots: DataFrame
    counts: DataFrame


def retain(posts: DataFrame, facts: DataFrame, labels: DataFrame, cutoff: Column, as_of: Column, run_id: str, platforms: list[str], rate: float, engagement: int = 100, signal: float = 0.8, fresh: DataFrame | None = None, more: tuple[str, ...] = ()) -> Rolled:
    """Fold posts before the hour of cutoff into the facts, sample them, and keep the others. fresh: their facts, if they are made already;
    more: columns of a post that its sample keeps."""
    old = F.col("timestamp") < F.date_trunc("hour", cutoff)
    gone = posts.where(old)
    fresh = post_facts(gone) if fresh is None else fresh
    merged = merge_facts(facts, fresh)
    touched = merged.join(fresh.select(*KEYS), KEYS, "left_semi")
    staged = probability_sample(gone, rate, platforms, *more).unionByName(challenge_sample(gone, engagement, signal, platforms, *more))
    counts = gone.agg(F.countDistinct(F.struct("symbol", F.date_trunc("hour", "timestamp"))).alias("rolled_up"), F.count("*").alias("pruned"))
    return Rolled(posts.where(~old), merged, merge_label_facts(labels, label_facts(fresh)), staged, touched.withColumn("run_id", F.lit(run_id)).withColumn("as_of", as_of), counts)


def snapshot_at(snapshots: DataFrame, at: Column) -> DataFrame:
    """Facts as they were known at a time: the latest snapshot of each key."""
    values = [c for c in snapshots.columns if c not in KEYS]
    latest = snapshots.where(F.col("as_of") <= at).groupBy(*KEYS).agg(F.max_by(F.struct(*values), "as_of").alias("v"))
    return latest.select(*KEYS, "v.*")


def retain_quotes(quotes: DataFrame, hourly: DataFrame, daily: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quotes that stay, hourly facts, daily facts): quotes before the cutoff, which may be within an hour, are folded."""
    old = F.col("timestamp") < cutoff
    gone = quotes.where(old)
    return quotes.where(~old), merge_price_facts(hourly, price_facts(gone, "hour"), "hour"), merge_price_facts(daily, price_facts(gone, "day"), "day")


def coverage(facts: DataFrame, legacy: DataFrame, since: Column, only: Column | None = None) -> DataFrame:
    """How far back each symbol's hours reach, and whether that is far enough: facts alone under a filter of their dimensions, legacy hours beside them without one."""
    hours = (facts if only is None else facts.where(only)).select("symbol", "bucket_hour")
    if only is None:
        hours = hours.unionByName(legacy.select("symbol", "bucket_hour"))
    start = hours.groupBy("symbol").agg(F.min("bucket_hour").alias("coverage_start"))
    mode = "legacy-unfiltered+canonical" if only is None else "dimension-preserving"
    return start.select("symbol", F.lit(mode).alias("coverage_mode"), "coverage_start", (F.col("coverage_start") <= since).alias("coverage_complete"))


# Defaults and domains of request parameters.
DEFAULTS = {"hours": 24, "limit": 20, "offset": 0}
DOMAINS = {"hours": (1, 8760), "limit": (1, 1000), "offset": (0, None)}


def checked(requests: DataFrame) -> DataFrame:
    """Requests with defaults for what is missing, `all` as no filter, and `fault`: the first parameter outside its domain."""
    filled = requests.withColumns({c: F.coalesce(c, F.lit(v)).cast("long") for c, v in DEFAULTS.items()} | {"sentiment": F.when(F.col("sentiment") != "all", F.col("sentiment"))})
    fault = F.lit(None).cast("string")
    if "horizon" in requests.columns:
        fault = F.when(~F.col("horizon").isin(30, 90), "horizon").otherwise(fault)
    fault = F.when(~F.col("sentiment").isin("positive", "neutral", "negative"), "sentiment").otherwise(fault)
    for c, (low, high) in reversed(DOMAINS.items()):
        outside = F.col(c) < low if high is None else ~F.col(c).between(low, high)
        fault = F.when(outside, c).otherwise(fault)
    return filled.withColumn("fault", fault)
