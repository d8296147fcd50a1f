"""Provider payloads (JSON text) to rows. A payload that cannot be read, or has the wrong shape, gives no rows; see malformed()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.functions import calendar, stats, text

POST = ["id", "symbol", "platform", "text", "timestamp", "engagement"]


def malformed(payload: Column, root: str = "object") -> Column:
    """Whether a payload is no JSON, or its root has another kind."""
    first = F.substring(F.ltrim(payload), 1, 1)
    return F.try_parse_json(payload).isNull() | (first != ("{" if root == "object" else "["))


def time_or(raw: Column, fallback: Column) -> Column:
    """RFC 3339 time, else the fallback."""
    return F.coalesce(F.when(raw.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d"), F.try_to_timestamp(raw)), fallback)


def items(df: DataFrame, schema: str, path: str) -> DataFrame:
    """One row for each element of the array at path, with its position."""
    parsed = df.withColumn("_root", F.from_json("payload", schema))
    return parsed.select("*", F.posexplode(f"_root.{path}").alias("position", "item")).drop("_root", "payload")


def posts(df: DataFrame, id_: Column, symbol: Column | str, platform: str, body: Column, at: Column, engagement: Column) -> DataFrame:
    """Rows of the post schema; engagement is 1 at least."""
    return df.select(id_.alias("id"), (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), F.lit(platform).alias("platform"), body.alias("text"), at.alias("timestamp"), F.greatest(F.coalesce(engagement, F.lit(1)), F.lit(1)).cast("int").alias("engagement"))


def bluesky(payloads: DataFrame, rule: text.Rule, since: Column, now: Column) -> DataFrame:
    """Posts later than the cursor that match the symbol; engagement: likes, reposts twice, replies three times."""
    rows = items(payloads, "posts array<struct<cid string, record struct<text string, createdAt string>, likeCount int, repostCount int, replyCount int>>", "posts")
    at = F.try_to_timestamp("item.record.createdAt")
    body = F.coalesce("item.record.text", F.lit(""))
    n = lambda c, k: F.coalesce(F.col(f"item.{c}"), F.lit(0)) * k
    fresh = rows.where(at.isNull() | (at > since)).where(text.matches(body, rule))
    return posts(fresh, F.col("item.cid"), rule.symbol, "bluesky", body, F.coalesce(at, now), n("likeCount", 1) + n("repostCount", 2) + n("replyCount", 3))


def high_water(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The next cursor of each key: the latest time seen."""
    return rows.groupBy(*keys).agg(F.max("timestamp").alias("since"))


def stocktwits(payloads: DataFrame, symbol: Column | str, now: Column) -> DataFrame:
    """Messages, oldest first (they arrive newest first)."""
    rows = items(payloads, "messages array<struct<id long, body string, created_at string, likes struct<total int>>>", "messages").orderBy(F.desc("position"))
    return posts(rows, F.concat(F.lit("st_"), F.col("item.id").cast("string")), symbol, "stocktwits", F.col("item.body"), time_or(F.col("item.created_at"), now), F.coalesce("item.likes.total", F.lit(0)))


def reddit(payloads: DataFrame, rules: list[text.Rule], now: Column, seen: DataFrame | None = None) -> DataFrame:
    """A comment becomes a post of every symbol that it matches; ids that were seen are skipped."""
    rows = items(payloads, "data struct<children array<struct<data struct<id string, body string, created_utc double, score string>>>>", "data.children")
    rows = rows.select(F.col("item.data").alias("d")).where("d.id <> ''")
    if seen is not None:
        rows = rows.join(seen.select(F.col("id").alias("_seen")), F.col("d.id") == F.col("_seen"), "left_anti")
    body = F.coalesce("d.body", F.lit(""))
    cut = F.substring(F.trim(body), 1, 2000)
    fan = rows.where(cut != "").withColumn("symbol", F.explode(text.matched_symbols(body, rules)))
    at = F.coalesce(F.timestamp_seconds(F.floor("d.created_utc")), now)
    return posts(fan, F.concat(F.lit("rd_"), F.col("d.id")), F.col("symbol"), "reddit", cut, at, F.coalesce(F.expr("try_cast(d.score AS int)"), F.lit(1)))


def headline(title: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(summary, F.lit("")))


def finnhub(payloads: DataFrame, rule: text.Rule, now: Column) -> DataFrame:
    """Company news that names the symbol; engagement 15."""
    rows = payloads.select("*", F.posexplode(F.from_json("payload", "array<struct<id long, headline string, summary string, datetime long>>")).alias("position", "item"))
    body = headline(F.col("item.headline"), F.col("item.summary"))
    return posts(rows.where(text.matches(body, rule)), F.concat(F.lit("finnhub_"), F.col("item.id").cast("string")), rule.symbol, "finnhub", body, F.coalesce(F.timestamp_seconds("item.datetime"), now), F.lit(15))


def alpaca(payloads: DataFrame, rule: text.Rule, now: Column) -> DataFrame:
    rows = items(payloads, "news array<struct<id long, headline string, summary string, created_at string>>", "news")
    body = headline(F.col("item.headline"), F.col("item.summary"))
    return posts(rows.where(text.matches(body, rule)), F.concat(F.lit("alpaca_"), F.col("item.id").cast("string")), rule.symbol, "alpaca", body, time_or(F.col("item.created_at"), now), F.lit(1))


_CHART = "chart struct<result array<struct<meta struct<regularMarketVolume double, regularMarketPrice double>, timestamp array<long>, indicators struct<quote array<struct<open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>>>>>>>"


def chart_bars(payloads: DataFrame, zero: bool = False) -> DataFrame:
    """Bars of parallel arrays, as many as the shortest has; rows without a consistent positive price are dropped, volume is 0 at least.
    zero: a price may be zero, as of what has lost all its value."""
    r = payloads.withColumn("r", F.get(F.from_json("payload", _CHART).getField("chart").getField("result"), F.lit(0)))
    r = r.withColumn("q", F.get("r.indicators.quote", F.lit(0)))
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), *[F.col(f"q.{c}").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("q.volume", F.array().cast("array<double>")).alias("volume"))
    # beyond the shortest array a row lacks a price or its time and is dropped below
    rows = r.select(*[c for c in payloads.columns if c != "payload"], F.explode(zipped).alias("b"), F.col("r.meta.regularMarketVolume").alias("session_volume"))
    bars = rows.select(*[c for c in payloads.columns if c != "payload"], F.timestamp_seconds("b.t").alias("timestamp"), *[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")], "session_volume")
    good = F.lit(True)
    for c in ("open", "high", "low", "close"):
        good = good & stats.finite(F.col(c)) & (F.col(c) >= 0 if zero else F.col(c) > 0)
    good = good & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & F.col("timestamp").isNotNull()
    return bars.where(good).withColumn("volume", F.when(stats.finite(F.col("volume")), F.greatest("volume", F.lit(0.0))))


def latest_quote(payloads: DataFrame, keys: list[str], zero: bool = False) -> DataFrame:
    """The last bar's close of each key; volume of the session, else of the bar, else 0."""
    last = chart_bars(payloads, zero).groupBy(*keys).agg(F.max_by(F.struct("timestamp", "close", "volume", "session_volume"), "timestamp").alias("b"))
    return last.select(*keys, F.col("b.timestamp").alias("timestamp"), F.col("b.close").alias("price"), F.coalesce("b.session_volume", "b.volume", F.lit(0.0)).cast("long").alias("volume"))


def session_bars(bars: DataFrame, zone: str, open_minute: int, close_minute: int, daily: bool, fx_local: bool | None = None) -> DataFrame:
    """Bars with the bounds of their session. A daily session that opens later than it closes began the day before; an
    hourly bar ends an hour later. fx_local: prices are exchange rates, already local per dollar or not."""
    day = F.to_date(F.from_utc_timestamp("timestamp", zone))
    if daily:
        wall = lambda d, m: F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + m * 60)
        start = calendar.local_to_utc(wall(F.date_sub(day, 1) if open_minute > close_minute else day, open_minute), zone)
        end = calendar.local_to_utc(wall(day, close_minute), zone)
    else:
        start, end = F.col("timestamp"), F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    out = bars.withColumn("starts_at", start).withColumn("ends_at", end).withColumn("session_date", day)
    if fx_local is not None:
        out = out.withColumn("_fx", stats.local_per_dollar(*map(F.col, ("open", "high", "low", "close")), F.lit(fx_local))).where("_fx IS NOT NULL")
        out = out.withColumns({c: F.col(f"_fx.{c}") for c in ("open", "high", "low", "close")}).drop("_fx")
    return out


def taiwan_index(payloads: DataFrame) -> DataFrame:
    """Flat bars of labelled prices. Labels and prices of different number are an error, not a cut."""
    root = F.from_json("payload", "empty boolean, data struct<labels array<string>, datasets array<struct<value_type string, data array<string>>>>")
    r = payloads.withColumn("r", root).where(~F.coalesce("r.empty", F.lit(False)))
    prices = F.get(F.filter("r.data.datasets", lambda d: d["value_type"] == "price"), F.lit(0))["data"]
    r = r.withColumn("p", prices).withColumn("ok", F.when(F.size("p") != F.size("r.data.labels"), F.raise_error(F.lit("labels and prices differ in number"))).otherwise(F.lit(True)))
    rows = r.where("ok").select(F.explode(F.arrays_zip(F.col("r.data.labels").alias("label"), F.col("p").alias("price"))).alias("x"))
    price, day = F.expr("try_cast(x.price AS double)"), F.expr("try_cast(replace(x.label, '/', '-') AS date)")
    flat = rows.select(day.alias("session_date"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(None).cast("double").alias("volume"))
    return flat.where(F.col("session_date").isNotNull() & stats.finite(F.col("close")) & (F.col("close") > 0))


def bar_provider(interval: Column, aliases: Column) -> Column:
    """Which provider serves an instrument: the index for daily bars of one that it knows, else the chart provider, else none."""
    has = lambda k: F.array_contains(F.map_keys(aliases), k)
    return F.when((interval == "1d") & has("taiwan_index"), "taiwan_index").when(has("yahoo"), "yahoo")


def gdelt_time(raw: Column, fallback: Column) -> Column:
    compact = F.coalesce(F.when(raw.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd'T'HHmmss'Z'"))), F.when(raw.rlike(r"^\d{14}$"), F.try_to_timestamp(raw, F.lit("yyyyMMddHHmmss"))))
    return F.coalesce(compact, time_or(raw, fallback))


def gdelt(payloads: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Articles with a link and a title; of one payload's articles with the same canonical link, the first."""
    rows = items(payloads, "articles array<struct<url string, title string, domain string, seendate string>>", "articles")
    clean = rows.select(*keys, "position", text.canonical(F.trim("item.url")).alias("url"), F.trim(F.coalesce("item.title", F.lit(""))).alias("title"), F.trim("item.domain").alias("domain"), F.col("item.seendate").alias("seen"))
    clean = clean.where("url IS NOT NULL AND title <> ''")
    first = clean.groupBy(*keys, "url").agg(F.min_by(F.struct("title", "domain", "seen"), "position").alias("a"))
    return first.select(*keys, F.lit("gdelt").alias("provider"), F.sha2("url", 256).alias("provider_event_id"), F.col("url").alias("canonical_url"), F.substring("a.title", 1, 1000).alias("title"), F.when(F.col("a.domain") != "", F.substring("a.domain", 1, 255)).alias("source_name"), gdelt_time(F.col("a.seen"), now).alias("occurred_at"))


# Classes of a provider's answer, the one that is reported of several last.
OUTCOMES = ["no_data", "success", "permanent_error", "transient_error", "blocked", "rate_limited"]


def http_outcome(status: Column, rows: Column | None = None) -> Column:
    """Class of an HTTP answer; rows: how many items it had, for an empty one."""
    ok = F.lit("success") if rows is None else F.when(rows == 0, "no_data").otherwise("success")
    return F.when(status.between(200, 299), ok).when(status == 403, "blocked").when(status == 429, "rate_limited").when(status >= 500, "transient_error").otherwise("permanent_error")


def worst(outcome: Column) -> Column:
    """Aggregate: the outcome that is reported of several."""
    return F.max_by(outcome, F.array_position(F.array(*map(F.lit, OUTCOMES)), outcome))


def price_earnings(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pe_ratio) of summaries: the trailing ratio, where there is none the forward one; NULL if neither is a finite number."""
    ratio = "struct<raw string>"
    detail = F.get(F.from_json("payload", f"quoteSummary struct<result array<struct<summaryDetail struct<trailingPE {ratio}, forwardPE {ratio}>>>>").getField("quoteSummary").getField("result"), F.lit(0)).getField("summaryDetail")
    rows = payloads.select(*keys, detail.alias("d")).select(*keys, F.coalesce("d.trailingPE.raw", "d.forwardPE.raw").try_cast("double").alias("pe"))
    return rows.select(*keys, F.when(stats.finite(F.col("pe")), F.col("pe")).alias("pe_ratio"))


def daily_history(payloads: DataFrame, keys: list[str], zero: bool = False) -> DataFrame:
    """(keys, day, close) of a year's chart."""
    return chart_bars(payloads, zero).select(*keys, F.to_date("timestamp").alias("day"), "close")
