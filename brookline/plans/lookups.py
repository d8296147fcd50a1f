"""Lookups, catalogs, event identity and single kernels over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookline.functions import calendar, stats
from brookline.operators import rollup as R
from brookline.operators import selection
from brookline.operators import sinks as K
from brookline.plans.facts import _PRICES, at, shown_prices
from brookline.plans.registry import query
from brookline.sources import catalog
from brookline.sources.views import Tables, ntz


@query("src4_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables) -> DataFrame:
    return t.raw("customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


@query("src5_history_of_keys", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1999-08-01 00:00:00'")
def history_of_keys(t: Tables) -> DataFrame:
    """Two years of history of several keys."""
    since = F.add_months(F.lit("2001-08-01").cast("date"), -24).cast("timestamp_ntz")
    return t.raw("orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= since)).select("o_orderkey", "o_orderdate")


def instruments(t: Tables, name: str = "Dollar", extra: bool = False) -> tuple[DataFrame, DataFrame]:
    """A catalog of three or four instruments with exposures of two symbols."""
    rows = [("index:tw50", "Taiwan 50", "index", None), ("fx:twdusd", name, "fx", "local_currency_per_usd"), ("commodity:gold", "Gold", "commodity", None), ("commodity:oil", "Oil", "commodity", None)][: 3 + extra]
    listed = [{"instrument_key": k, "display_name": n, "asset_class": c, "currency": "TWD", "timezone": "Asia/Taipei", "quote_convention": q, "is_active": k != "commodity:gold", "provider_aliases": {"yahoo": k}, "session_metadata": {"open": 540, "close": 810}} for k, n, c, q in rows]
    exposed = [{"symbol": s, "exposures": [{"instrument_key": k, "reason": f"{n} matters", "display_order": i} for i, (k, n, *_) in enumerate(rows)]} for s in ("CLICK", "VIEW")]
    return catalog.load(t.spark, {"version": 1, "instruments": listed, "stock_exposures": exposed})


@query("src22_catalog", """SELECT * FROM (VALUES ('index:tw50', 'index', true), ('fx:twdusd', 'fx', true), ('commodity:gold', 'commodity', false)) c(instrument_key, asset_class, is_active), (SELECT '{"close":810,"open":540}' AS session_metadata)""")
def catalog_rows(t: Tables) -> DataFrame:
    return instruments(t)[0].select("instrument_key", "asset_class", "is_active", "session_metadata")


@query("jn4_active_exposures", "SELECT s.symbol, c.k AS instrument_key, c.o::INT AS display_order FROM (VALUES ('CLICK'), ('VIEW')) s(symbol), (VALUES ('index:tw50', 0), ('fx:twdusd', 1)) c(k, o)")
def active_exposures(t: Tables) -> DataFrame:
    """Exposures of active instruments in their order; the catalog is configuration."""
    listed, exposed = instruments(t)
    return exposed.join(listed.where("is_active").select("instrument_key", "display_name"), "instrument_key").orderBy("symbol", "display_order", "display_name").select("symbol", "instrument_key", "display_order")


@query(
    "snk7_catalog_merge",
    """known AS (SELECT 'us-stock:' || lower(symbol) AS instrument_key, symbol AS display_name, DATE '2024-01-01' AS updated FROM tracked_symbols UNION ALL VALUES ('index:tw50', 'Taiwan 50', DATE '2024-01-01'), ('fx:twdusd', 'Dollar', DATE '2024-01-01'), ('commodity:gold', 'Gold', DATE '2024-01-01')),
new AS (SELECT * FROM (VALUES ('index:tw50', 'Taiwan 50'), ('fx:twdusd', 'US dollar'), ('commodity:gold', 'Gold'), ('commodity:oil', 'Oil')) v(instrument_key, display_name))
SELECT instrument_key, display_name, DATE '2024-02-01' AS updated FROM new UNION ALL SELECT * FROM known WHERE instrument_key NOT IN (SELECT instrument_key FROM new)""",
)
def catalog_merge(t: Tables) -> DataFrame:
    """A catalog with another name and one more instrument over a stored one; what it does not list stays."""
    before, after = (F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-02-01"))
    equities = K.equity_instruments(t.tracked_symbols).select(F.lower("instrument_key").alias("instrument_key"), F.lower("display_name").alias("display_name")).withColumn("updated_at", before)
    stored = instruments(t)[0].select("instrument_key", "display_name")
    known = catalog.merged(equities, stored, ["instrument_key"], before)
    out = catalog.merged(known, instruments(t, "US dollar", True)[0].select("instrument_key", "display_name"), ["instrument_key"], after)
    return out.select("instrument_key", "display_name", F.to_date("updated_at").alias("updated"))


@query("snk7_exposure_merge", "SELECT s.symbol, k AS instrument_key, o::INT AS display_order FROM (VALUES ('CLICK'), ('VIEW'), ('OLD')) s(symbol), (VALUES ('index:tw50', 0), ('fx:twdusd', 1), ('commodity:gold', 2), ('commodity:oil', 3)) c(k, o) WHERE symbol <> 'OLD' OR k = 'fx:twdusd'")
def exposure_merge(t: Tables) -> DataFrame:
    """Exposures by symbol and instrument; those of a symbol that is not listed any more stay."""
    known = instruments(t)[1].where("instrument_key = 'fx:twdusd'").withColumn("symbol", F.explode(F.array(F.col("symbol"), F.lit("OLD")))).distinct().withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    return catalog.merged(known, instruments(t, extra=True)[1], ["symbol", "instrument_key"], F.lit("2024-02-01").cast("timestamp")).select("symbol", "instrument_key", "display_order")


@query("jn2_rules_of_active_symbols", "SELECT n_nationkey AS rule_id, symbol FROM (SELECT n_nationkey, ['click', 'view', 'retired', 'quiet'][n_nationkey % 4 + 1] AS symbol FROM nation) JOIN tracked_symbols USING (symbol) WHERE is_active")
def rules_of_active_symbols(t: Tables) -> DataFrame:
    rules = t.raw("nation").select(F.col("n_nationkey").alias("rule_id"), F.element_at(F.array(*map(F.lit, ("click", "view", "retired", "quiet"))), F.col("n_nationkey") % 4 + 1).alias("symbol"))
    return rules.join(t.tracked_symbols.where("is_active").select("symbol"), "symbol").select("rule_id", "symbol")


def existing(new: DataFrame, known: DataFrame) -> DataFrame:
    """new with the number of the known event of the same provider and id, else of the same link: two equi joins, no OR."""
    by_id = known.select("provider", "provider_event_id", F.col("event_id").alias("_a"))
    by_url = known.select("provider", "canonical_url", F.col("event_id").alias("_b"))
    return new.join(by_id, ["provider", "provider_event_id"], "left").join(by_url, ["provider", "canonical_url"], "left").withColumn("event_id", F.coalesce("_a", "_b")).drop("_a", "_b")


@query(
    "jn20_existing_events",
    """known AS (SELECT 'g' AS provider, page_id::VARCHAR AS pid, url, page_id AS event_id FROM pages WHERE page_id % 2 = 0),
new AS (SELECT page_id, 'g' AS provider, CASE WHEN page_id % 4 = 0 THEN page_id::VARCHAR ELSE 'n' || page_id END AS pid, url || CASE WHEN page_id % 3 = 0 THEN '&x' ELSE '' END AS url FROM pages)
SELECT n.page_id, coalesce((SELECT k.event_id FROM known k WHERE k.pid = n.pid), (SELECT min(k.event_id) FROM known k WHERE k.url = n.url)) AS event_id FROM new n""",
)
def existing_events(t: Tables) -> DataFrame:
    p = t.raw("pages")
    known = p.where("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("event_id"))
    ids = p.where("page_id % 2 = 0").select(F.lit("g").alias("provider"), F.col("page_id").cast("string").alias("provider_event_id"), F.col("page_id").alias("event_id"), F.lit(None).cast("string").alias("canonical_url"))
    both = ids.unionByName(known.select(F.lit("g").alias("provider"), F.lit(None).cast("string").alias("provider_event_id"), "event_id", F.col("url").alias("canonical_url")))
    new = p.select("page_id", F.lit("g").alias("provider"), F.when(F.col("page_id") % 4 == 0, F.col("page_id").cast("string")).otherwise(F.concat(F.lit("n"), F.col("page_id").cast("string"))).alias("provider_event_id"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("&x"))).otherwise(F.col("url")).alias("canonical_url"))
    return existing(new, both).select("page_id", "event_id")


@query("snk6_bar_upsert", "SELECT symbol, day, CASE WHEN day >= DATE '2024-01-20' THEN close * 2 ELSE close END AS close FROM closes")
def bar_upsert(t: Tables) -> DataFrame:
    """Bars of the last days come again with other values; the last write wins."""
    bars = t.closes.select("symbol", "day", "close")
    return K.upsert(bars, bars.where(F.col("day") >= F.lit("2024-01-20").cast("date")).withColumn("close", F.col("close") * 2), ["symbol", "day"])


_CUT = "2024-01-17 10:20:00"


@query("ret2_hourly_after_retention", _PRICES.format(bucket="date_trunc('hour', timestamp)", name="bucket_hour").replace("FROM quotes", f"FROM quotes WHERE timestamp < TIMESTAMP '{_CUT}'"))
def hourly_after_retention(t: Tables) -> DataFrame:
    """Two runs; the second cutoff is within an hour."""
    none = t.quotes.limit(0)
    left, hourly, daily = R.retain_quotes(t.quotes, R.price_facts(none, "hour"), R.price_facts(none, "day"), at("2024-01-10 03:40:00"))
    return shown_prices(R.retain_quotes(left, hourly, daily, at(_CUT))[1])


@query("mth1_pearson_and_beta", "SELECT l_returnflag, l_linestatus, round(regr_sxy(l_extendedprice, l_quantity) / nullif(sqrt(regr_sxx(l_extendedprice, l_quantity) * regr_syy(l_extendedprice, l_quantity)), 0), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS beta FROM lineitem GROUP BY ALL")
def pearson_and_beta(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(stats.pearson("l_extendedprice", "l_quantity", 3), 6).alias("r"), F.round(stats.beta("l_extendedprice", "l_quantity", 3), 4).alias("beta"))


@query("mth4_price_percentiles", "SELECT symbol, timestamp::DATE AS day, list_sort(list(price))[floor((count(*) - 1) * 0.05)::INT + 1] AS p05, list_sort(list(price))[floor((count(*) - 1) * 0.95)::INT + 1] AS p95 FROM quotes GROUP BY ALL")
def price_percentiles(t: Tables) -> DataFrame:
    prices = t.quotes.select("symbol", F.to_date("timestamp").alias("day"), "price")
    return selection.at_ranks(prices, ["symbol", "day"], "price", {"p05": selection.floor_rank(0.05), "p95": selection.floor_rank(0.95)})


_DAYS = "d AS (SELECT symbol, day, CASE WHEN day(day) % 4 <> 0 THEN close END AS v FROM closes)"


@query("win3_forward_fill", _DAYS + " SELECT symbol, day, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day) AS v FROM d")
def forward_fill(t: Tables) -> DataFrame:
    gaps = t.closes.withColumn("v", F.when(F.dayofmonth("day") % 4 != 0, F.col("close")))
    return gaps.withColumn("f", stats.carried("v", W.partitionBy("symbol").orderBy("day"))).select("symbol", "day", F.col("f").alias("v"))


@query("win4_full_mean", _DAYS + " SELECT symbol, day, round(CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END, 6) AS m FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def full_mean(t: Tables) -> DataFrame:
    gaps = t.closes.withColumn("v", F.when(F.dayofmonth("day") % 4 != 0, F.col("close")))
    return gaps.select("symbol", "day", F.round(stats.full_mean("v", W.partitionBy("symbol").orderBy("day"), 3), 6).alias("m"))


@query("dt8_bars_due", "SELECT event_id, isodow(ts - INTERVAL 5 HOURS) IN (1, 2, 3, 4, 5) AND hour(ts - INTERVAL 5 HOURS) * 60 + minute(ts - INTERVAL 5 HOURS) >= 975 AND (event_id % 2 = 0 OR DATE '2024-01-15' < (ts - INTERVAL 5 HOURS)::DATE) AS due FROM events")
def bars_due(t: Tables) -> DataFrame:
    done = F.when(F.col("event_id") % 2 == 1, F.lit("2024-01-15").cast("date"))
    return t.raw("events").select("event_id", calendar.bar_due(F.col("ts").cast("timestamp"), calendar.ZONE, [1, 2, 3, 4, 5], 16 * 60, 15, done).alias("due"))


@query("flt13_fundamental_symbols", "SELECT DISTINCT upper(event_type) AS s FROM events WHERE user_id % 3 = 2")
def fundamental_symbols(t: Tables) -> DataFrame:
    """No futures and no indexes, in capitals; a third of the symbols comes as each."""
    k, name = F.col("user_id") % 3, F.col("event_type")
    raw = F.when(k == 0, F.concat(name, F.lit("=F"))).when(k == 1, F.concat(F.lit("^"), name)).otherwise(F.concat(F.lit(" "), name, F.lit(" ")))
    s = t.raw("events").select(F.upper(F.trim(raw)).alias("s")).distinct()
    return s.where(~F.col("s").endswith("=F") & ~F.col("s").startswith("^"))


@query("set6_poll_symbols", "SELECT DISTINCT s FROM (SELECT symbol AS s FROM tracked_symbols WHERE is_active UNION ALL VALUES ('ES=F'), ('^VIX'), ('click')) WHERE s <> 'quiet'")
def poll_symbols(t: Tables) -> DataFrame:
    """Equities, futures and the volatility index, each once, without the estimated fund."""
    more = t.spark.sql("SELECT * FROM VALUES ('ES=F'), ('^VIX'), ('click') AS t(s)")
    return t.tracked_symbols.where("is_active").select(F.col("symbol").alias("s")).union(more).distinct().where("s <> 'quiet'")


@query("ui4_scorecard", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE round(100.0::DOUBLE * p_size / 50, 6) END AS score_pct FROM part")
def scorecard(t: Tables) -> DataFrame:
    score = F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50)
    return t.raw("part").select("p_partkey", F.round(F.coalesce(score, F.lit(0.0)) * 100, 6).alias("score_pct"))


@query("ui5_effective_sessions", "SELECT symbol, timestamp, CASE WHEN market_session = 'regular' AND TIMESTAMP '2024-01-31 00:00:00' - timestamp >= INTERVAL 15 MINUTES THEN 'closed' ELSE market_session END AS session FROM (SELECT symbol, max(timestamp) AS timestamp, arg_max(market_session, timestamp) AS market_session FROM quotes GROUP BY symbol)")
def effective_sessions(t: Tables) -> DataFrame:
    """A regular session whose last quote is 15 minutes old counts as closed."""
    last = t.quotes.groupBy("symbol").agg(F.max("timestamp").alias("ts"), F.max_by("market_session", "timestamp").alias("s"))
    stale = F.lit("2024-01-31 00:00:00").cast("timestamp") - F.col("ts") >= F.expr("INTERVAL 15 MINUTES")
    return last.select("symbol", ntz("ts").alias("timestamp"), F.when((F.col("s") == "regular") & stale, "closed").otherwise(F.col("s")).alias("session"))


@query("jsn1_event_properties", "SELECT event_id, regexp_extract(props, '(\\d+)', 1)::INT AS k, regexp_extract(props, '(\\d+)', 1)::INT IS NULL AS missing FROM events")
def event_properties(t: Tables) -> DataFrame:
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')")
    return t.raw("events").select("event_id", k.alias("k"), k.isNull().alias("missing"))
