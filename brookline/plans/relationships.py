"""Market snapshots, and how symbols move with others and around events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookline.functions import stats
from brookline.operators import joins as J
from brookline.plans.registry import query
from brookline.sources.views import AS_OF, Tables, as_of, ntz

HORIZON, LEAST = 30, 20


@query("srt3_latest_quotes", "SELECT symbol, max(timestamp) AS timestamp, arg_max(price, timestamp) AS price, arg_max(volume, timestamp) AS volume, arg_max(market_session, timestamp) AS market_session FROM quotes GROUP BY symbol")
def latest_quotes(t: Tables) -> DataFrame:
    last = J.latest(t.quotes, ["symbol"], ["timestamp"]).select("latest.*")
    return last.select("symbol", ntz("timestamp").alias("timestamp"), "price", "volume", "market_session")


@query("src1_market_series", f"SELECT symbol, timestamp, price, volume FROM quotes WHERE symbol = 'view' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS")
def market_series(t: Tables) -> DataFrame:
    rows = t.quotes.where((F.col("symbol") == "view") & (F.col("timestamp") >= as_of() - F.expr("INTERVAL 168 HOURS")))
    return rows.orderBy("timestamp").select("symbol", ntz("timestamp").alias("timestamp"), "price", "volume")


@query(
    "jn5_market_snapshot",
    """latest AS (SELECT symbol, max(timestamp) AS ts, arg_max(price, timestamp) AS price FROM quotes GROUP BY symbol),
session AS (SELECT symbol, max(timestamp) AS ts, arg_max(price, timestamp) AS price FROM quotes WHERE market_session = CASE WHEN right(symbol, 2) = '=F' THEN 'futures_open' ELSE 'regular' END GROUP BY symbol),
previous AS (SELECT q.symbol, arg_max(q.price, q.timestamp) AS price FROM quotes q JOIN session s USING (symbol) WHERE q.market_session = CASE WHEN right(q.symbol, 2) = '=F' THEN 'futures_open' ELSE 'regular' END AND q.timestamp < s.ts - INTERVAL 12 HOURS GROUP BY q.symbol),
oldest AS (SELECT symbol, arg_min(price, timestamp) AS price FROM quotes GROUP BY symbol),
r AS (SELECT l.symbol, l.ts, l.price, coalesce(p.price, s.price, CASE WHEN s.ts IS NULL THEN o.price END, l.price) AS reference_price FROM latest l LEFT JOIN session s USING (symbol) LEFT JOIN previous p USING (symbol) LEFT JOIN oldest o USING (symbol))
SELECT symbol, ts AS timestamp, price, reference_price, round(price - reference_price, 6) AS abs_change, round(CASE WHEN reference_price <> 0 THEN (price - reference_price) / reference_price * 100 ELSE 0 END, 6) AS pct_change FROM r""",
)
def market_snapshot(t: Tables) -> DataFrame:
    """Latest quote against the close of the session before: one aggregation finds all but the session before, another that."""
    wanted = F.when(F.col("symbol").endswith("=F"), "futures_open").otherwise("regular")
    in_session = t.quotes.withColumn("_in", F.col("market_session") == wanted)
    found = in_session.groupBy("symbol").agg(
        F.max("timestamp").alias("timestamp"),
        F.max_by("price", "timestamp").alias("price"),
        F.max(F.when(F.col("_in"), F.struct("timestamp", "price"))).alias("session"),
        F.min_by("price", "timestamp").alias("oldest"),
    )
    before = in_session.where("_in").join(found.select("symbol", F.col("session.timestamp").alias("_ts")), "symbol").where(F.col("timestamp") < F.col("_ts") - F.expr("INTERVAL 12 HOURS"))
    previous = before.groupBy("symbol").agg(F.max_by("price", "timestamp").alias("previous"))
    reference = F.coalesce("previous", "session.price", F.when(F.col("session").isNull(), F.col("oldest")), "price")
    rows = found.join(previous, "symbol", "left").withColumn("reference_price", reference)
    change = F.col("price") - F.col("reference_price")
    return rows.select("symbol", ntz("timestamp").alias("timestamp"), "price", "reference_price", F.round(change, 6).alias("abs_change"), F.round(F.when(F.col("reference_price") != 0, change / F.col("reference_price") * 100).otherwise(0.0), 6).alias("pct_change"))


@query(
    "jn8_price_since",
    "SELECT symbol, coalesce(arg_max(price, timestamp) FILTER (timestamp <= TIMESTAMP '2024-01-20 12:00:00'), arg_min(price, timestamp)) AS reference_price, arg_max(price, timestamp) AS latest_price FROM quotes GROUP BY symbol",
)
def price_since(t: Tables) -> DataFrame:
    then = F.lit("2024-01-20 12:00:00").cast("timestamp")
    known = F.max(F.when(F.col("timestamp") <= then, F.struct("timestamp", "price")))
    return t.quotes.groupBy("symbol").agg(F.coalesce(known.getField("price"), F.min_by("price", "timestamp")).alias("reference_price"), F.max_by("price", "timestamp").alias("latest_price"))


@query(
    "jn6_quote_before_post",
    "SELECT p.id, p.symbol, (SELECT arg_max(q.price, q.timestamp) FROM quotes q WHERE q.symbol = p.symbol AND q.timestamp < p.timestamp) AS price FROM posts p WHERE p.engagement >= 90",
)
def quote_before_post(t: Tables) -> DataFrame:
    """The last quote strictly before each loud post."""
    loud = t.posts.where("engagement >= 90").select("id", "symbol", "timestamp")
    return J.as_of(loud, t.quotes.select("symbol", "timestamp", "price"), ["symbol"], "timestamp", "price", strict=True, bucket=F.to_date("timestamp")).select("id", "symbol", "price")


_RETURNS = """returns AS (SELECT symbol, ends_at, r FROM (SELECT symbol, ends_at, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS r FROM closes WINDOW w AS (PARTITION BY symbol ORDER BY ends_at)) WHERE r IS NOT NULL)"""


@query("win11_returns", _RETURNS + " SELECT symbol, ends_at, round(r, 6) AS r FROM returns")
def daily_returns(t: Tables) -> DataFrame:
    return J.returns(t.closes, ["symbol"], "ends_at", "close").select("symbol", "ends_at", F.round("r", 6).alias("r"))


# Which factors a stock is compared with: configuration, as a catalog's exposures are.
EXPOSURES = {"click": ["view", "error"], "view": ["click", "purchase"], "purchase": ["view", "signup", "click"], "signup": ["error"], "error": ["purchase", "missing"]}
_PAIRS = (
    _RETURNS
    + """, sides(factor, stock) AS (VALUES """
    + ", ".join(f"('{f}', '{s}')" for s, factors in EXPOSURES.items() for f in factors)
    + """),
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ends_at) AS rn FROM returns),
firsts AS (SELECT d.factor, d.stock, f.ends_at, f.r AS x, (SELECT min(n.rn) FROM numbered n WHERE n.symbol = d.stock AND n.ends_at > f.ends_at) AS rn FROM sides d JOIN returns f ON f.symbol = d.factor),
paired AS (SELECT a.factor, a.stock, l.lag, a.ends_at, a.x, n.r AS y FROM firsts a CROSS JOIN (SELECT unnest([0, 1, 2]) AS lag) l JOIN numbered n ON n.symbol = a.stock AND n.rn = a.rn + l.lag)"""
)


def paired(t: Tables) -> DataFrame:
    """Returns of each stock's factors and its own, aligned without looking ahead at lags 0, 1 and 2: as many lines as there are exposures."""
    r = J.returns(t.closes, ["symbol"], "ends_at", "close").withColumnRenamed("ends_at", "at")
    sides = t.spark.createDataFrame([(f, s) for s, factors in EXPOSURES.items() for f in factors], "factor string, stock string")
    sides = sides.withColumn("pair", F.struct("factor", "stock"))
    factor = sides.join(r, F.col("factor") == F.col("symbol")).select("pair", "at", "r")
    stock = sides.join(r, F.col("stock") == F.col("symbol")).select("pair", "at", "r")
    return J.forward_pairs(factor, stock, F.array(F.lit(0), F.lit(1), F.lit(2)))


@query("jn9_forward_pairs", _PAIRS + " SELECT factor, stock, lag, ends_at, round(x, 6) AS x, round(y, 6) AS y FROM paired")
def forward_pairs(t: Tables) -> DataFrame:
    return paired(t).select("pair.factor", "pair.stock", "lag", F.col("at").alias("ends_at"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


RELATIONSHIPS_SQL = (
    _PAIRS
    + f""", recent AS (SELECT * FROM paired QUALIFY row_number() OVER (PARTITION BY factor, stock, lag ORDER BY ends_at DESC) <= {HORIZON}),
stats AS (SELECT factor, stock, lag, count(*) AS n, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM recent GROUP BY ALL),
fits AS (SELECT *, CASE WHEN n >= {LEAST} THEN greatest(-1, least(1, sxy / nullif(sqrt(sxx * syy), 0))) END AS r0, CASE WHEN n >= {LEAST} THEN sxy / nullif(sxx, 0) END AS b FROM stats),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY factor, stock ORDER BY round(abs(r0), 9) DESC NULLS LAST, lag) = 1)
SELECT factor, stock, lag, n, round(r0, 6) AS r, round(b, 6) AS beta, CASE WHEN abs(r0) >= 0.4 THEN 'strong' WHEN abs(r0) >= 0.2 THEN 'moderate' WHEN r0 IS NOT NULL THEN 'weak' END AS strength FROM best"""
)


@query("mth2_relationships", RELATIONSHIPS_SQL)
def relationships(t: Tables) -> DataFrame:
    """Correlation and beta of the last 30 aligned returns at the lag where they are strongest."""
    recent = paired(t).withColumn("_n", F.row_number().over(W.partitionBy("pair", "lag").orderBy(F.desc("at")))).where(F.col("_n") <= HORIZON)
    fits = recent.groupBy("pair", "lag").agg(F.count("*").alias("n"), stats.pearson("y", "x", LEAST).alias("r"), stats.beta("y", "x", LEAST).alias("beta"))
    first = W.partitionBy("pair").orderBy(F.desc_nulls_last(F.round(F.abs("r"), 9)), "lag")
    best = fits.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return best.select("pair.factor", "pair.stock", "lag", "n", F.round("r", 6).alias("r"), F.round("beta", 6).alias("beta"), stats.strength(F.col("r"), 0.2, 0.4).alias("strength"))


@query("srt9_top_relationships", RELATIONSHIPS_SQL.replace("AS strength FROM best", "AS strength FROM best WHERE r0 IS NOT NULL ORDER BY abs(round(r0, 6)) DESC, factor, stock LIMIT 4"))
def top_relationships(t: Tables) -> DataFrame:
    """The four strongest relationships."""
    rows = relationships(t).where("r IS NOT NULL")
    return rows.orderBy(F.desc(F.abs("r")), "factor", "stock").limit(4)


# Events, rules and links come from orders, customers and nations: an order is an event, a customer's segment the symbol, a nation the rule.
_EVENTS = """signals AS (SELECT o_orderkey AS event_id, o_orderdate AS occurred_at, 'order ' || o_orderkey AS title, o_custkey FROM orders),
rules AS (SELECT n_nationkey AS rule_id, n_name AS rule_name FROM nation),
links AS (SELECT s.event_id, c.c_mktsegment AS symbol, c.c_nationkey AS rule_id, s.occurred_at FROM signals s JOIN customer c ON c.c_custkey = s.o_custkey)"""


def links(t: Tables) -> DataFrame:
    orders = t.raw("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("occurred_at"))
    return orders.join(t.raw("customer"), "c_custkey").select("event_id", F.col("c_mktsegment").alias("symbol"), F.col("c_nationkey").alias("rule_id"), "occurred_at")


@query("jn3_linked_events", _EVENTS + " SELECT l.event_id, l.symbol, r.rule_name, l.occurred_at FROM links l JOIN rules r USING (rule_id)")
def linked_events(t: Tables) -> DataFrame:
    rules = t.raw("nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("rule_name"))
    return links(t).join(rules, "rule_id").select("event_id", "symbol", "rule_name", "occurred_at")


@query("agg19_links_per_day", _EVENTS + " SELECT rule_id, occurred_at::DATE AS day, count(*) AS n FROM links GROUP BY ALL")
def links_per_day(t: Tables) -> DataFrame:
    return links(t).groupBy("rule_id", F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))


@query("win7_capped_links", _EVENTS + " SELECT event_id, symbol, rule_id FROM links QUALIFY row_number() OVER (PARTITION BY rule_id, occurred_at::DATE ORDER BY occurred_at, event_id) <= 2")
def capped_links(t: Tables) -> DataFrame:
    """At most two links a rule and day, the oldest."""
    return capped(links(t), 2).select("event_id", "symbol", "rule_id")


def capped(new: DataFrame, cap: int, known: DataFrame | None = None) -> DataFrame:
    """New links, oldest first, while the rule's links of the UTC day are below the cap; known: (rule_id, day, n) so far."""
    day = new.withColumn("day", F.to_date("occurred_at"))
    place = F.row_number().over(W.partitionBy("rule_id", "day").orderBy("occurred_at", "event_id"))
    if known is None:
        return day.withColumn("_k", place).where(F.col("_k") <= cap).drop("_k", "day")
    ranked = day.withColumn("_k", place).join(known.withColumnRenamed("n", "_had"), ["rule_id", "day"], "left")
    return ranked.where(F.col("_k") + F.coalesce("_had", F.lit(0)) <= cap).drop("_k", "_had", "day")


@query(
    "agg18_events_by_signal",
    _EVENTS + ", more AS (SELECT event_id, rule_id FROM links UNION SELECT event_id, (rule_id + 7) % 25 FROM links WHERE event_id % 2 = 0) SELECT event_id, string_agg(rule_name, '|' ORDER BY rule_name) AS rules, count(*) AS n FROM more JOIN rules USING (rule_id) GROUP BY event_id",
)
def events_by_signal(t: Tables) -> DataFrame:
    """Rule names of each event in their order; half of the events match two rules."""
    one = links(t).select("event_id", "rule_id")
    both = one.union(one.where("event_id % 2 = 0").select("event_id", ((F.col("rule_id") + 7) % 25).alias("rule_id"))).distinct()
    rules = t.raw("nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("rule_name"))
    return both.join(rules, "rule_id").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("rule_name")), "|").alias("rules"), F.count("*").alias("n"))


@query("srt4_newest_events", _EVENTS + " SELECT event_id, title, occurred_at FROM signals ORDER BY occurred_at DESC, event_id DESC LIMIT 30")
def newest_events(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.col("o_orderkey").alias("event_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderdate").alias("occurred_at"))
    return rows.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(30)


@query(
    "mth5_next_close_moves",
    "SELECT id, symbol, b AS before, a AS after, round(CASE WHEN b > 0 AND a > 0 THEN (a / b - 1) * 100 END, 6) AS move_pct FROM (SELECT p.id, p.symbol, (SELECT arg_max(c.close, c.ends_at) FROM closes c WHERE c.symbol = p.symbol AND c.ends_at < p.timestamp) AS b, (SELECT arg_min(c.close, c.ends_at) FROM closes c WHERE c.symbol = p.symbol AND c.ends_at > p.timestamp) AS a FROM posts p WHERE p.engagement = 99)",
)
def next_close_moves(t: Tables) -> DataFrame:
    """Move from the close before a post to the one after it."""
    events = t.posts.where("engagement = 99").select("id", "symbol", ntz("timestamp").alias("ends_at"))
    around = J.bracket(events, t.closes.select("symbol", "ends_at", "close"), ["symbol"], "ends_at", "close", bucket=F.trunc("ends_at", "month"))
    move = F.when((F.col("before") > 0) & (F.col("after") > 0), (F.col("after") / F.col("before") - 1) * 100)
    return around.select("id", "symbol", "before", "after", F.round(move, 6).alias("move_pct"))


@query("agg25_freshness", f"SELECT symbol, max(ends_at) AS latest, max(ends_at) < TIMESTAMP '{AS_OF}' - INTERVAL 72 HOURS AS stale FROM closes GROUP BY symbol")
def freshness(t: Tables) -> DataFrame:
    return t.closes.groupBy("symbol").agg(F.max("ends_at").alias("latest"), (F.max("ends_at") < ntz(as_of() - F.expr("INTERVAL 72 HOURS"))).alias("stale"))
