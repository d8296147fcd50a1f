"""Global context: the event store, bars and their retention, admin payloads, fund values, canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.functions import calendar, payloads, stats
from brookline.operators import events as E
from brookline.operators import joins as J
from brookline.operators import sinks as K
from brookline.plans.market import _NAV, fund_change, proxy_moves
from brookline.plans.registry import query
from brookline.sources.views import TOPICS, Tables, ntz

# --- events

_STORE = """s AS (SELECT o_custkey % 5 AS rule_id, 'S' || o_custkey % 5 AS symbol, 'g' AS provider, (o_orderkey // 2)::VARCHAR AS pid, 'u' || (CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey // 4 ELSE o_orderkey END) AS url, o_orderpriority AS title, o_orderdate AS occ FROM orders),
known AS (SELECT * FROM s WHERE rule_id = 0 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY occ, url) = 1 AND count(*) OVER (PARTITION BY url) = 1),
batch AS (SELECT * FROM s WHERE rule_id > 0),
m AS (SELECT b.*, coalesce(k.pid, u.pid) AS known FROM batch b LEFT JOIN known k USING (pid) LEFT JOIN (SELECT url, min(pid) AS pid FROM known GROUP BY url) u ON u.url = b.url),
f AS (SELECT *, row_number() OVER i = 1 AND known IS NULL AS new, first_value(url) OVER i AS first_url FROM m WINDOW i AS (PARTITION BY pid ORDER BY rule_id, occ, pid, url)),
h AS (SELECT *, new AND sum(new::INT) OVER (PARTITION BY url ORDER BY rule_id, occ, pid, url ROWS UNBOUNDED PRECEDING) = 1 AS head FROM f),
e AS (SELECT h.*, coalesce(h.known, x.pid) AS event FROM h LEFT JOIN (SELECT url, pid FROM h WHERE head) x ON x.url = h.first_url),
n AS (SELECT *, (row_number() OVER (PARTITION BY event, symbol, rule_id ORDER BY occ, pid, url) = 1)::INT AS new_link FROM e),
t AS (SELECT * FROM n QUALIFY coalesce(sum(new_link) OVER (PARTITION BY rule_id, occ::DATE ORDER BY occ, pid, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2)"""


def event_batch(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known events, links, sightings): orders as events of five rules; those of the first are known, others share ids and links."""
    o = t.raw("orders")
    rule = (F.col("o_custkey") % 5).cast("int")
    link = F.when(F.col("o_orderkey") % 7 == 0, F.expr("o_orderkey div 4")).otherwise(F.col("o_orderkey"))
    s = o.select(rule.alias("rule_id"), F.concat(F.lit("S"), rule.cast("string")).alias("symbol"), F.lit("g").alias("provider"), F.expr("o_orderkey div 2").cast("string").alias("provider_event_id"), F.concat(F.lit("u"), link.cast("string")).alias("canonical_url"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"))
    first = s.where("rule_id = 0")
    alone = first.groupBy("canonical_url").agg(F.count("*").alias("n")).where("n = 1").select("canonical_url")
    known = J.first_of(first, ["provider_event_id"], ["occurred_at", "canonical_url"]).join(alone, "canonical_url", "left_semi")
    known = known.select(E.key_of(F.col("provider"), F.col("provider_event_id")).alias("event_key"), "provider", "provider_event_id", "canonical_url", *E.FIELDS)
    links = known.limit(0).select("event_key", F.lit("").alias("symbol"), F.lit(0).alias("rule_id"))
    return known, links, s.where("rule_id > 0")


@query("snk9_event_links", _STORE + " SELECT DISTINCT sha256('g' || chr(31) || event) AS event_key, symbol, rule_id FROM t WHERE new_link = 1")
def event_links(t: Tables) -> DataFrame:
    """Sightings of one batch, linked oldest first, two a rule and day."""
    return E.store(*event_batch(t), 2)[1]


@query(
    "snk9_stored_events",
    _STORE + " SELECT sha256('g' || chr(31) || k.pid) AS event_key, coalesce(l.title, k.title) AS title, coalesce(l.occ, k.occ) AS occurred_at FROM known k LEFT JOIN (SELECT event, arg_max(title, (rule_id, occ, pid, url)) AS title, arg_max(occ, (rule_id, occ, pid, url)) AS occ FROM t GROUP BY event) l ON l.event = k.pid UNION ALL SELECT sha256('g' || chr(31) || event), arg_max(title, (rule_id, occ, pid, url)), arg_max(occ, (rule_id, occ, pid, url)) FROM t WHERE event NOT IN (SELECT pid FROM known) GROUP BY event",
)
def stored_events(t: Tables) -> DataFrame:
    """Known events with what their last sighting says, and new ones."""
    return E.store(*event_batch(t), 2)[0].select("event_key", "title", ntz("occurred_at").alias("occurred_at"))


# --- bars

_BARS = """bars AS (SELECT event_type AS symbol, CASE WHEN event_id % 3 = 0 THEN '1d' ELSE '1h' END AS interval, date_trunc('hour', ts) AS ends_at, max(value) AS close FROM events GROUP BY ALL)"""


def bars(t: Tables) -> DataFrame:
    """Hourly and daily bars, many of which end together."""
    e = t.raw("events")
    interval = F.when(F.col("event_id") % 3 == 0, "1d").otherwise("1h")
    return e.groupBy(F.col("event_type").alias("symbol"), interval.alias("interval"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ends_at")).agg(F.max("value").alias("close"))


def latest_bar(rows: DataFrame) -> DataFrame:
    """(symbol, latest): the bar that ends last; of bars that end together, the hourly one."""
    hourly = (F.col("interval") == "1h").cast("int")
    return rows.groupBy("symbol").agg(F.max(F.struct("ends_at", hourly.alias("hourly"), "interval", "close")).alias("latest"))


@query("srt6_latest_bars", _BARS + " SELECT symbol, interval, ends_at, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ends_at DESC, CASE WHEN interval = '1h' THEN 0 ELSE 1 END) = 1")
def latest_bars(t: Tables) -> DataFrame:
    return latest_bar(bars(t)).select("symbol", "latest.interval", ntz("latest.ends_at").alias("ends_at"), "latest.close")


@query(
    "mth22_current_moves",
    _BARS + ", latest AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ends_at DESC, CASE WHEN interval = '1h' THEN 0 ELSE 1 END) = 1), r AS (SELECT l.symbol, l.close, (SELECT arg_max(b.close - CASE WHEN l.symbol = 'view' THEN 1000 ELSE 0 END, b.ends_at) FROM bars b WHERE b.symbol = l.symbol AND b.interval = '1d' AND b.ends_at < l.ends_at) AS reference FROM latest l) SELECT symbol, round(CASE WHEN reference > 0 THEN (close / reference - 1) * 100 END, 6) AS move_pct FROM r",
)
def current_moves(t: Tables) -> DataFrame:
    """Move of the latest bar against the last daily bar before it; none where that is not above zero."""
    rows = bars(t)
    joined = rows.where("interval = '1d'").join(latest_bar(rows), "symbol", "right")
    before = F.when(F.col("ends_at") < F.col("latest.ends_at"), F.struct("ends_at", "close"))
    found = joined.groupBy("symbol").agg(F.first("latest.close").alias("current"), F.max(before).getField("close").alias("reference"))
    reference = F.col("reference") - F.when(F.col("symbol") == "view", 1000).otherwise(0)
    return found.select("symbol", F.round(stats.current_move(F.col("current"), reference), 6).alias("move_pct"))


_AGED = "aged AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '1h' ELSE '1d' END AS interval, o_orderdate AS ends_at FROM orders)"


@query("ret3_pruned_bars", _AGED + " SELECT id, interval FROM aged WHERE ends_at >= CASE WHEN interval = '1h' THEN TIMESTAMP '2001-08-01' - INTERVAL 180 DAYS ELSE TIMESTAMP '2001-08-01' - INTERVAL 1825 DAYS END")
def pruned_bars(t: Tables) -> DataFrame:
    """Hourly bars are kept for 180 days, daily bars for five years."""
    interval = F.when(F.col("o_orderkey") % 2 == 0, "1h").otherwise("1d")
    rows = t.raw("orders").select(F.col("o_orderkey").alias("id"), interval.alias("interval"), F.col("o_orderdate").cast("timestamp").alias("ends_at"))
    now = F.lit("2001-08-01 00:00:00").cast("timestamp")
    return K.purge_bars(rows, now).select("id", "interval")


# --- admin payloads

_VALUES = "[CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE 'C' || n_regionkey END, 'D']"


@query(
    "flt17_exposure_payloads",
    "e AS (SELECT p_partkey, p_partkey // 50 AS request, 'k' || p_size // 6 AS key, p_type AS reason, p_size - 2 AS display_order FROM part) SELECT request, count(*) FILTER (display_order < 0) > 0 AS negative, count(*) <> count(DISTINCT key) AS repeated, count(*) FILTER (length(reason) NOT BETWEEN 1 AND 1000 OR length(key) NOT BETWEEN 1 AND 120) > 0 AS lengths FROM e GROUP BY request",
)
def exposure_payloads(t: Tables) -> DataFrame:
    """What is wrong with replacements of exposures, as lists of one request of at most 50 each."""
    rows = t.raw("part").select(F.expr("p_partkey div 50").alias("request"), F.struct(F.concat(F.lit("k"), F.expr("p_size div 6").cast("string")).alias("instrument_key"), F.col("p_type").alias("reason"), (F.col("p_size") - 2).alias("display_order")).alias("x"))
    bodies = rows.groupBy("request").agg(F.collect_list("x").alias("exposures"))
    wrong = payloads.exposure_problems(F.col("exposures"))
    has = lambda *p: F.arrays_overlap(wrong, F.array(*map(F.lit, p)))
    return bodies.select("request", has("display_order").alias("negative"), has("instrument_key repeated").alias("repeated"), has("instrument_key", "reason").alias("lengths"))


@query(
    "flt17_rule_payloads",
    f"r AS (SELECT n_nationkey % 6 AS request, CASE WHEN n_nationkey % 4 = 0 THEN 'same' ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN []::VARCHAR[] ELSE {_VALUES} END AS countries FROM nation) SELECT request, count(*) <> count(DISTINCT name) AS repeated, count(*) FILTER (len(countries) = 0) > 0 AS empty, count(*) FILTER (list_contains(countries, ' ')) > 0 AS blank FROM r GROUP BY request",
)
def rule_payloads(t: Tables) -> DataFrame:
    """What is wrong with replacements of event rules."""
    n = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    values = F.array(F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("C"), F.col("n_regionkey").cast("string"))), F.lit("D"))
    rule = F.struct(F.when(n % 4 == 0, "same").otherwise(F.col("n_name")).alias("name"), F.when(n % 3 == 0, none).otherwise(values).alias("countries"), none.alias("themes"), none.alias("query_terms"))
    bodies = t.raw("nation").select((n % 6).alias("request"), rule.alias("r")).groupBy("request").agg(F.collect_list("r").alias("rules"))
    wrong = payloads.rule_problems(F.col("rules"))
    return bodies.select("request", *[F.array_contains(wrong, p).alias(a) for p, a in (("name repeated", "repeated"), ("no dimension", "empty"), ("blank value", "blank"))])


# --- fund values

def official_values(navs: DataFrame, now: Column) -> DataFrame:
    """(day, timestamp, price): official values of trading days that are final, at the close of 16:00 New York.

    Today's is final from 18:15 on. A value more than stats.PLAUSIBLE per cent from the one before is left out, and so is
    today's if it is the same as the one before.
    """
    local = F.from_utc_timestamp(now, calendar.ZONE)
    today = F.to_date(local)
    final = (F.col("day") < today) | (F.col("day") == today) & (F.hour(local) * 60 + F.minute(local) >= 18 * 60 + 15)
    moved = J.previous(navs, [], ["day"], "close", "_before")
    plausible = F.col("_before").isNull() | (F.abs(F.col("close") - F.col("_before")) / F.col("_before") * 100 <= stats.PLAUSIBLE) & ~((F.col("day") == today) & (F.col("close") == F.col("_before")))
    close = calendar.local_to_utc(F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 16 * 3600), calendar.ZONE)
    return moved.where(calendar.is_trading_day(F.col("day")) & final & plausible).select("day", close.alias("timestamp"), F.round("close", 4).alias("price"))


def estimated_values(navs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """(day, price) estimated from the value of the previous trading day, which must be there, before the day's close."""
    before = navs.select(F.col("day").alias("_base"), F.col("close").alias("_nav"))
    close = calendar.local_to_utc(F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 16 * 3600), calendar.ZONE)
    rows = changes.where(calendar.is_trading_day(F.col("day")) & (now < close)).withColumn("_base", calendar.previous_trading_day(F.col("day")))
    return rows.join(before, "_base").select("day", F.round(F.col("_nav") * (1 + F.col("change") / 100), 4).alias("price"))


_NAVS = "navs AS (SELECT day, 20 + sum(close) / 1000 + CASE WHEN day(day) % 11 = 0 THEN 5 ELSE 0 END AS close FROM closes GROUP BY day)"
_WEEKDAYS = "isodow(day) < 6 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-15')"


def navs_of(t: Tables) -> DataFrame:
    return t.closes.groupBy("day").agg(F.sum("close").alias("s")).select("day", (20 + F.col("s") / 1000 + F.when(F.dayofmonth("day") % 11 == 0, 5).otherwise(0)).alias("close"))


@query(
    "mth11_official_values",
    _NAVS + f", m AS (SELECT *, lag(close) OVER (ORDER BY day) AS b FROM navs) SELECT day, day + INTERVAL 21 HOURS AS timestamp, round(close, 4) AS price FROM m WHERE {_WEEKDAYS} AND day <= DATE '2024-01-24' AND (b IS NULL OR abs(close - b) / b * 100 <= 8 AND NOT (day = DATE '2024-01-24' AND close = b))",
)
def official(t: Tables) -> DataFrame:
    """At 18:15 in New York on the 24th: that day's value has just become final."""
    out = official_values(navs_of(t), F.lit("2024-01-24 23:15:00").cast("timestamp"))
    return out.select("day", ntz("timestamp").alias("timestamp"), "price")


@query(
    "mth11_estimated_values",
    _NAV + ", " + _NAVS + f", n AS (SELECT day, close, (SELECT max(g::DATE) FROM generate_series(fund.day - INTERVAL 7 DAYS, fund.day - INTERVAL 1 DAY, INTERVAL 1 DAY) s(g) WHERE isodow(g) < 6 AND g::DATE NOT IN (DATE '2024-01-01', DATE '2024-01-15')) AS base, change FROM fund JOIN navs USING (day)) SELECT n.day, round(b.close * (1 + n.change / 100), 4) AS price FROM n JOIN navs b ON b.day = n.base WHERE isodow(n.day) < 6 AND n.day NOT IN (DATE '2024-01-01', DATE '2024-01-15') AND n.day >= DATE '2024-01-10'",
)
def estimated(t: Tables) -> DataFrame:
    """As seen at noon in New York on the 10th: days before are over."""
    out = estimated_values(navs_of(t), fund_change(proxy_moves(t)), F.lit("2024-01-10 17:00:00").cast("timestamp"))
    return out.select("day", "price")


# --- text

@query("jsn4_canonical_json", "SELECT event_id, '{\"k\":' || regexp_extract(props, '(\\d+)', 1) || ',\"symbol\":\"' || event_type || '\",\"user\":' || user_id || '}' AS body FROM events")
def canonical_json(t: Tables) -> DataFrame:
    """JSON with sorted keys and no spaces, whatever the order of the columns."""
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return t.raw("events").select("event_id", payloads.canonical_json(F.col("user_id").alias("user"), F.col("event_type").alias("symbol"), k).alias("body"))


@query("str_j_hypotheses", f"SELECT event_id, 'This text is about ' || {TOPICS}[event_id % 8 + 1] || '.' AS hypothesis FROM events")
def hypotheses(t: Tables) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("event_id") % 8 + 1).cast("int"))
    return t.raw("events").select("event_id", payloads.filled(payloads.HYPOTHESIS, label).alias("hypothesis"))
