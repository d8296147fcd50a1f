"""Queries over hourly facts: rollups, merges, retention, samples, snapshots and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.operators import rollup as R
from brookline.plans.registry import query
from brookline.sources.views import PLATFORMS, Tables, as_of, ntz

CUTOFF = "2024-01-17 10:20:00"
_TIMES = [*R.FIRSTS, *R.LASTS, "input_watermark"]

FACTS_SQL = """
weighed AS (SELECT *, ln(greatest(engagement, 0) + 1) AS wt, p_pos - p_neg AS sg FROM posts),
facts_of AS (
  SELECT date_trunc('hour', timestamp) AS bucket_hour, symbol, platform, topic_id, topic_model_hash, sentiment_model_hash, {tag}
    count(*) AS post_count, count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count, count(*) FILTER (sentiment = 'negative') AS negative_count,
    sum(p_pos) AS positive_prob_sum, sum(p_neu) AS neutral_prob_sum, sum(p_neg) AS negative_prob_sum, sum(p_pos * p_pos) AS positive_prob_sq_sum, sum(p_neu * p_neu) AS neutral_prob_sq_sum, sum(p_neg * p_neg) AS negative_prob_sq_sum,
    sum(sg) AS signal_sum, sum(sg * sg) AS signal_sq_sum, sum(engagement)::DOUBLE AS engagement_sum, sum(wt) AS weight_sum,
    coalesce(sum(wt) FILTER (sentiment = 'positive'), 0) AS positive_weight_sum, coalesce(sum(wt) FILTER (sentiment = 'neutral'), 0) AS neutral_weight_sum, coalesce(sum(wt) FILTER (sentiment = 'negative'), 0) AS negative_weight_sum,
    sum(wt * sg) AS weighted_signal_sum, sum(wt * sg * sg) AS weighted_signal_sq_sum,
    min(timestamp) AS first_event_at, min(ingested_at) AS first_ingested_at, min(scored_at) AS first_scored_at, max(timestamp) AS last_event_at, max(ingested_at) AS last_ingested_at, max(scored_at) AS last_scored_at,
    max(ingested_at) AS input_watermark, arg_max(topic_label, scored_at) AS topic_label
  FROM weighed WHERE {where} GROUP BY ALL
)
"""
_KEEP = ", ".join([*R.KEYS, *R.COUNTS, *[f"round({c}, 6) AS {c}" for c in R.SUMS], *_TIMES, "topic_label"])


def shown(facts: DataFrame) -> DataFrame:
    return facts.select(ntz("bucket_hour").alias("bucket_hour"), *R.KEYS[1:], *R.COUNTS, *[F.round(c, 6).alias(c) for c in R.SUMS], *[ntz(c).alias(c) for c in _TIMES], "topic_label")


def at(text: str):
    return F.lit(text).cast("timestamp")


@query("agg13_post_facts", FACTS_SQL.format(tag="", where="true") + f"SELECT {_KEEP} FROM facts_of")
def post_facts(t: Tables) -> DataFrame:
    return shown(R.post_facts(t.posts))


@query("agg22_merged_facts", FACTS_SQL.format(tag="", where="true") + f"SELECT {_KEEP} FROM facts_of")
def merged_facts(t: Tables) -> DataFrame:
    """Facts of early posts merged with those of late ones are the facts of all."""
    late = F.col("id").cast("long") % 3 == 0
    return shown(R.merge_facts(R.post_facts(t.posts.where(~late)), R.post_facts(t.posts.where(late))))


_LABELS = """SELECT symbol, bucket_hour, sum(positive_count)::BIGINT AS positive_count, sum(neutral_count)::BIGINT AS neutral_count, sum(negative_count)::BIGINT AS negative_count, round(sum(positive_weight_sum), 6) AS positive_weighted, round(sum(neutral_weight_sum), 6) AS neutral_weighted, round(sum(negative_weight_sum), 6) AS negative_weighted, round(sum(weight_sum), 6) AS total_weighted,
  round(coalesce((sum(positive_weight_sum) - sum(negative_weight_sum)) / nullif(sum(weight_sum), 0), 0), 6) AS sentiment_index FROM facts_of GROUP BY symbol, bucket_hour"""


def shown_labels(labels: DataFrame) -> DataFrame:
    return labels.select("symbol", ntz("bucket_hour").alias("bucket_hour"), "positive_count", "neutral_count", "negative_count", *[F.round(c, 6).alias(c) for c in ("positive_weighted", "neutral_weighted", "negative_weighted", "total_weighted", "sentiment_index")])


@query("agg14_label_facts", FACTS_SQL.format(tag="", where="true") + _LABELS)
def label_facts(t: Tables) -> DataFrame:
    return shown_labels(R.label_facts(R.post_facts(t.posts)))


@query("agg24_merged_label_facts", FACTS_SQL.format(tag="", where="true") + _LABELS)
def merged_label_facts(t: Tables) -> DataFrame:
    late = F.col("id").cast("long") % 4 == 1
    return shown_labels(R.merge_label_facts(R.label_facts(R.post_facts(t.posts.where(~late))), R.label_facts(R.post_facts(t.posts.where(late)))))


@query("agg12_canonical_index", FACTS_SQL.format(tag="", where="true") + "SELECT symbol, bucket_hour, sum(post_count)::BIGINT AS posts, round(sum(weighted_signal_sum) / nullif(sum(weight_sum), 0), 6) AS sentiment_index FROM facts_of GROUP BY ALL")
def canonical_index(t: Tables) -> DataFrame:
    """Sums over platforms, topics and models first, the ratio after."""
    sums = R.post_facts(t.posts).groupBy("symbol", "bucket_hour").agg(F.sum("post_count").alias("posts"), F.sum("weighted_signal_sum").alias("s"), F.sum("weight_sum").alias("w"))
    return sums.select("symbol", ntz("bucket_hour").alias("bucket_hour"), "posts", F.round(F.try_divide("s", "w"), 6).alias("sentiment_index"))


@query(
    "set2_canonical_and_legacy",
    FACTS_SQL.format(tag="timestamp < TIMESTAMP '2024-01-10 00:00:00' AS old,", where="true")
    + """, canonical AS (SELECT symbol, bucket_hour, sum(weighted_signal_sum) / nullif(sum(weight_sum), 0) AS i FROM facts_of WHERE NOT old GROUP BY symbol, bucket_hour),
legacy AS (SELECT symbol, bucket_hour, coalesce((sum(positive_weight_sum) - sum(negative_weight_sum)) / nullif(sum(weight_sum), 0), 0) AS i FROM facts_of GROUP BY symbol, bucket_hour)
SELECT symbol, bucket_hour, 'canonical' AS tier, round(i, 6) AS sentiment_index FROM canonical
UNION ALL SELECT symbol, bucket_hour, 'legacy', round(i, 6) FROM legacy l WHERE NOT EXISTS (SELECT 1 FROM canonical c WHERE c.symbol = l.symbol AND c.bucket_hour = l.bucket_hour)""",
)
def canonical_and_legacy(t: Tables) -> DataFrame:
    """Canonical hours, and legacy ones only where there is no canonical hour."""
    facts = R.post_facts(t.posts)
    recent = facts.where(F.col("bucket_hour") >= at("2024-01-10 00:00:00")).groupBy("symbol", "bucket_hour").agg(F.try_divide(F.sum("weighted_signal_sum"), F.sum("weight_sum")).alias("i"))
    legacy = R.label_facts(facts).select("symbol", "bucket_hour", F.col("sentiment_index").alias("i")).join(recent, ["symbol", "bucket_hour"], "left_anti")
    both = recent.withColumn("tier", F.lit("canonical")).unionByName(legacy.withColumn("tier", F.lit("legacy")))
    return both.select("symbol", ntz("bucket_hour").alias("bucket_hour"), "tier", F.round("i", 6).alias("sentiment_index"))


_PRICES = """SELECT symbol, {bucket} AS {name}, arg_min(price, timestamp) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, timestamp) AS close_price, arg_max(volume, timestamp) AS last_volume, count(*) AS observation_count,
  bool_or(market_session = 'regular') AS had_regular_session, min(timestamp) AS first_observed_at, max(timestamp) AS last_observed_at, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM quotes GROUP BY ALL"""


def shown_prices(df: DataFrame) -> DataFrame:
    times = ("bucket_hour", "first_observed_at", "last_observed_at")
    return df.select(*[ntz(c).alias(c) if c in times else F.array_join(c, ",").alias(c) if c == "providers" else c for c in df.columns])


@query("agg16_hourly_prices", _PRICES.format(bucket="date_trunc('hour', timestamp)", name="bucket_hour"))
def hourly_prices(t: Tables) -> DataFrame:
    return shown_prices(R.price_facts(t.quotes, "hour"))


@query("agg16_daily_prices", _PRICES.format(bucket="(timestamp - INTERVAL 5 HOURS)::DATE", name="bucket_day"))
def daily_prices(t: Tables) -> DataFrame:
    return shown_prices(R.price_facts(t.quotes, "day"))


@query("agg23_merged_prices", _PRICES.format(bucket="date_trunc('hour', timestamp)", name="bucket_hour"))
def merged_prices(t: Tables) -> DataFrame:
    """An hour in three parts: earlier, late and between."""
    third = F.pmod(F.col("volume"), F.lit(3))
    parts = [R.price_facts(t.quotes.where(third == k), "hour") for k in range(3)]
    return shown_prices(R.merge_price_facts(R.merge_price_facts(parts[1], parts[2], "hour"), parts[0], "hour"))


@query(
    "agg15_model_registry",
    """SELECT kind, hash, version, min(pipeline_git_commit) AS first_commit, min(ingested_at) AS first_seen_at, max(ingested_at) AS last_seen_at FROM (
  SELECT 'topic' AS kind, topic_model_hash AS hash, model_version AS version, * FROM posts UNION ALL SELECT 'sentiment', sentiment_model_hash, model_version, * FROM posts) GROUP BY kind, hash, version""",
)
def model_registry(t: Tables) -> DataFrame:
    one = lambda kind: t.posts.select(F.lit(kind).alias("kind"), F.col(f"{kind}_model_hash").alias("hash"), F.col("model_version").alias("version"), "pipeline_git_commit", "ingested_at")
    seen = one("topic").unionByName(one("sentiment")).groupBy("kind", "hash", "version")
    return seen.agg(F.min("pipeline_git_commit").alias("first_commit"), ntz(F.min("ingested_at")).alias("first_seen_at"), ntz(F.max("ingested_at")).alias("last_seen_at"))


_PLATFORMS = tuple(PLATFORMS[:3])
_SAMPLE = f"""SELECT id, platform, symbol, 'probability' AS cohort, 0.25::DOUBLE AS inclusion_probability, 'stratified_probability' AS selection_reasons FROM posts
WHERE platform IN {_PLATFORMS} AND ('0x' || substr(md5(concat_ws(chr(31), 'sample-v1', platform, id, symbol)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25"""
_CHALLENGE = f"""SELECT id, platform, symbol, 'challenge' AS cohort, NULL::DOUBLE AS inclusion_probability, concat_ws(',', CASE WHEN engagement >= 95 THEN 'high_engagement' END, CASE WHEN abs(p_pos - p_neg) >= 0.5 THEN 'extreme_signal' END) AS selection_reasons FROM posts
WHERE platform IN {_PLATFORMS} AND (engagement >= 95 OR abs(p_pos - p_neg) >= 0.5)"""


@query("smp1_probability_sample", _SAMPLE)
def probability_sample(t: Tables) -> DataFrame:
    return R.probability_sample(t.posts, 0.25, list(_PLATFORMS)).withColumn("selection_reasons", F.array_join("selection_reasons", ","))


@query("smp2_challenge_sample", _CHALLENGE)
def challenge_sample(t: Tables) -> DataFrame:
    return R.challenge_sample(t.posts, 95, 0.5, list(_PLATFORMS)).withColumn("selection_reasons", F.array_join("selection_reasons", ","))


def retained(t: Tables) -> R.Rolled:
    """A first run at an earlier cutoff, then a second one that also meets late posts of hours that were folded before."""
    late = F.col("id").cast("long") % 10 == 0
    early = t.posts.where(~late)
    none = R.post_facts(early.limit(0))
    first = R.retain(early, none, R.label_facts(none), at("2024-01-12 05:30:00"), as_of(), "run-1", list(_PLATFORMS), 0.25)
    return R.retain(first.posts.unionByName(t.posts.where(late)), first.facts, first.labels, at(CUTOFF), as_of(), "run-2", list(_PLATFORMS), 0.25)


_OLD = f"timestamp < date_trunc('hour', TIMESTAMP '{CUTOFF}')"


@query("ret1_facts_after_retention", FACTS_SQL.format(tag="", where=_OLD) + f"SELECT {_KEEP} FROM facts_of")
def facts_after_retention(t: Tables) -> DataFrame:
    return shown(retained(t).facts)


@query("ret1_posts_after_retention", f"SELECT id, symbol, timestamp FROM posts WHERE NOT {_OLD}")
def posts_after_retention(t: Tables) -> DataFrame:
    return retained(t).posts.select("id", "symbol", ntz("timestamp").alias("timestamp"))


@query("ret1_staged_samples", f"SELECT * FROM ({_SAMPLE} AND {_OLD} AND (timestamp >= TIMESTAMP '2024-01-12 05:00:00' OR id::BIGINT % 10 = 0) UNION ALL {_CHALLENGE.replace('>= 95', '>= 100').replace('>= 0.5', '>= 0.8')} AND {_OLD})")
def staged_samples(t: Tables) -> DataFrame:
    """What the second run stages: its own posts, not those that the first one had folded."""
    return retained(t).staged.withColumn("selection_reasons", F.array_join("selection_reasons", ","))


@query("ret4_dry_run", f"SELECT count(DISTINCT (symbol, date_trunc('hour', timestamp))) AS rolled_up, count(*) AS pruned FROM posts WHERE {_OLD}")
def dry_run(t: Tables) -> DataFrame:
    none = R.post_facts(t.posts.limit(0))
    return R.retain(t.posts, none, R.label_facts(none), at(CUTOFF), as_of(), "dry", [], 0.0).counts


@query(
    "snp2_snapshot_at_time",
    FACTS_SQL.format(tag="", where="timestamp < TIMESTAMP '2024-01-12 05:00:00' AND id::BIGINT % 10 <> 0") + "SELECT symbol, bucket_hour, platform, topic_id, topic_model_hash, sentiment_model_hash, post_count, 'run-1' AS run_id FROM facts_of",
)
def snapshot_at_time(t: Tables) -> DataFrame:
    """Two runs append what they touched; reading as of the first one gives its facts."""
    late = F.col("id").cast("long") % 10 == 0
    early, none = t.posts.where(~late), R.post_facts(t.posts.limit(0))
    first = R.retain(early, none, R.label_facts(none), at("2024-01-12 05:30:00"), at("2024-01-26 00:00:00"), "run-1", [], 0.0)
    second = R.retain(first.posts.unionByName(t.posts.where(late)), first.facts, first.labels, at(CUTOFF), at("2024-01-31 00:00:00"), "run-2", [], 0.0)
    seen = R.snapshot_at(first.snapshots.unionByName(second.snapshots), at("2024-01-28 00:00:00"))
    return seen.select("symbol", ntz("bucket_hour").alias("bucket_hour"), "platform", "topic_id", "topic_model_hash", "sentiment_model_hash", "post_count", "run_id")


_PLANTED = """planted AS (SELECT * REPLACE (
  positive_count + (post_count % 3 = 0)::INT AS positive_count, CASE WHEN post_count % 4 = 1 THEN last_event_at + INTERVAL 1 HOUR ELSE first_event_at END AS first_event_at,
  CASE WHEN post_count % 5 = 2 THEN post_count + 1 ELSE positive_prob_sum END AS positive_prob_sum, CASE WHEN post_count % 7 = 3 THEN neutral_prob_sum + 1 ELSE neutral_prob_sq_sum END AS neutral_prob_sq_sum,
  CASE WHEN post_count % 6 = 1 THEN post_count + 2 ELSE signal_sum END AS signal_sum, CASE WHEN post_count % 8 = 2 THEN -1 ELSE negative_weight_sum END AS negative_weight_sum,
  CASE WHEN post_count % 9 = 4 THEN weight_sum + 1 ELSE weighted_signal_sum END AS weighted_signal_sum, bucket_hour + (post_count % 10 = 5)::INT * INTERVAL 1 MINUTE AS bucket_hour) FROM facts_of)"""


def planted(facts: DataFrame) -> DataFrame:
    """Facts with faults of every kind."""
    n = F.col("post_count")
    hit = lambda k, r, wrong, c: F.when(n % k == r, wrong).otherwise(F.col(c)).alias(c)
    faults = [
        (F.col("positive_count") + (n % 3 == 0).cast("int")).alias("positive_count"),
        hit(4, 1, F.col("last_event_at") + F.expr("INTERVAL 1 HOUR"), "first_event_at"),
        hit(5, 2, n + 1.0, "positive_prob_sum"),
        hit(7, 3, F.col("neutral_prob_sum") + 1, "neutral_prob_sq_sum"),
        hit(6, 1, n + 2.0, "signal_sum"),
        hit(8, 2, F.lit(-1.0), "negative_weight_sum"),
        hit(9, 4, F.col("weight_sum") + 1, "weighted_signal_sum"),
        hit(10, 5, F.col("bucket_hour") + F.expr("INTERVAL 1 MINUTE"), "bucket_hour"),
    ]
    names = ["positive_count", "first_event_at", "positive_prob_sum", "neutral_prob_sq_sum", "signal_sum", "negative_weight_sum", "weighted_signal_sum", "bucket_hour"]
    return facts.select(*[c for c in facts.columns if c not in names], *faults)


@query(
    "dq_fact_violations",
    FACTS_SQL.format(tag="", where="true").rstrip()
    + ", "
    + _PLANTED
    + """, v AS (SELECT greatest(1e-6, post_count * 1e-6) AS tol, * FROM planted), r AS (SELECT
  count(*) FILTER (bucket_hour <> date_trunc('hour', bucket_hour)) AS bucket,
  count(*) FILTER (post_count < 0 OR positive_count + neutral_count + negative_count <> post_count) AS counts,
  count(*) FILTER (least(positive_prob_sum, neutral_prob_sum, negative_prob_sum) < 0 OR greatest(positive_prob_sum, neutral_prob_sum, negative_prob_sum) > post_count + 1e-6 OR abs(positive_prob_sum + neutral_prob_sum + negative_prob_sum - post_count) > tol) AS probabilities,
  count(*) FILTER (signal_sq_sum > post_count + 1e-6 OR abs(signal_sum) > post_count + 1e-6) AS signal,
  count(*) FILTER (greatest(positive_prob_sq_sum - positive_prob_sum, neutral_prob_sq_sum - neutral_prob_sum, negative_prob_sq_sum - negative_prob_sum) > 1e-6) AS squares,
  count(*) FILTER (first_event_at > last_event_at OR first_ingested_at > last_ingested_at OR first_scored_at > last_scored_at) AS "time order",
  count(*) FILTER (abs(weighted_signal_sum) > weight_sum + 1e-6 OR weighted_signal_sq_sum > weight_sum + 1e-6) AS "weighted signal",
  count(*) FILTER (least(positive_weight_sum, neutral_weight_sum, negative_weight_sum) < 0 OR abs(positive_weight_sum + neutral_weight_sum + negative_weight_sum - weight_sum) > greatest(1e-6, weight_sum * 1e-6)) AS weights FROM v)
SELECT rule, violations FROM (UNPIVOT r ON COLUMNS(*) INTO NAME rule VALUE violations)""",
)
def fact_violations(t: Tables) -> DataFrame:
    """Broken conditions by name, in facts in which faults of every kind were planted."""
    rules = R.fact_violations()
    counted = planted(R.post_facts(t.posts)).agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(f"`{k}`") for k in rules]))).alias("rule", "violations"))


@query("agg21_coverage_start", f"SELECT symbol, least(min(timestamp) FILTER (NOT {_OLD}), min(date_trunc('hour', timestamp)) FILTER ({_OLD})) AS coverage_start FROM posts GROUP BY symbol")
def coverage_start(t: Tables) -> DataFrame:
    """The earliest of what posts and facts still cover."""
    left = retained(t)
    live = left.posts.groupBy("symbol").agg(F.min("timestamp").alias("a"))
    cold = left.facts.groupBy("symbol").agg(F.min("bucket_hour").alias("b"))
    return live.join(cold, "symbol", "full").select("symbol", ntz(F.least("a", "b")).alias("coverage_start"))
