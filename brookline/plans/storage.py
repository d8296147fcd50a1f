"""Writes as queries: what each kind of write leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.operators import sinks as K
from brookline.operators.store import Store, insert, retention
from brookline.plans.facts import _CHALLENGE, _OLD, _PLATFORMS, _SAMPLE, CUTOFF, at
from brookline.plans.registry import query
from brookline.sources.views import AS_OF, Tables, as_of, ntz
from brookline.streaming import stages as S

_SPLIT = "old AS (SELECT id, symbol, platform, engagement FROM posts WHERE id::BIGINT % 3 <> 0), batch AS (SELECT id, symbol, platform, engagement + 1000 AS engagement FROM posts WHERE id::BIGINT % 2 = 0)"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.posts.select("id", "symbol", "platform", "engagement")
    n = F.col("id").cast("long")
    return p.where(n % 3 != 0), p.where(n % 2 == 0).withColumn("engagement", F.col("engagement") + 1000)


@query("snk1_first_wins", _SPLIT + " SELECT * FROM old UNION ALL SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.id = b.id AND o.symbol = b.symbol AND o.platform = b.platform)")
def first_wins(t: Tables) -> DataFrame:
    old, batch = halves(t)
    return old.unionByName(K.fresh(old, batch, ["platform", "id", "symbol"]))


@query("snk4_last_wins", _SPLIT + " SELECT * FROM batch UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE o.id = b.id AND o.symbol = b.symbol AND o.platform = b.platform)")
def last_wins(t: Tables) -> DataFrame:
    old, batch = halves(t)
    return K.upsert(old, batch, ["platform", "id", "symbol"])


_AGAIN = "b AS (SELECT n_regionkey % 3 AS k, n_nationkey AS seq, n_name AS v FROM nation UNION ALL SELECT NULL, n_nationkey, n_name FROM nation WHERE n_nationkey < 4), old AS (SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT NULL, 'none')"


def repeated(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A table, and a batch in which keys come several times; one key of each is null."""
    nation = t.raw("nation")
    at, v = F.col("n_nationkey").alias("at"), F.col("n_name").alias("v")
    batch = nation.select((F.col("n_regionkey") % 3).cast("int").alias("k"), at, v).union(nation.where("n_nationkey < 4").select(F.lit(None).cast("int"), at, v))
    old = t.raw("region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("v"))
    return old.union(t.spark.sql("SELECT CAST(NULL AS INT) AS k, 'none' AS v")).withColumn("at", F.lit(-1).cast("int")), batch.withColumn("at", F.col("at").cast("int"))


@query("snk4_repeated_keys", _AGAIN + " SELECT k::INT AS k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM b) WHERE n = 1 UNION ALL SELECT k::INT, v FROM old WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k IS NOT DISTINCT FROM old.k)")
def repeated_keys(t: Tables) -> DataFrame:
    """Of a key that a batch has several times, the last write wins; null is a key, too."""
    old, batch = repeated(t)
    return K.upsert(old, batch, ["k"], F.col("at")).select("k", "v")


@query("snk1_repeated_keys", _AGAIN + " SELECT k::INT AS k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM b) x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.k IS NOT DISTINCT FROM x.k AND old.v < 'AMERICB')")
def first_of_repeated_keys(t: Tables) -> DataFrame:
    """Of a key that a batch has several times, the first write wins, unless the table has the key."""
    old, batch = repeated(t)
    return K.fresh(old.where("v < 'AMERICB'"), batch, ["k"], F.col("at")).select("k", "v")


@query("snk2_duplicates", _SPLIT + " SELECT symbol, CASE WHEN min(b.platform) = max(b.platform) THEN min(b.platform) ELSE 'mixed' END AS platform, count(*) AS received, count(*) FILTER (EXISTS (SELECT 1 FROM old o WHERE o.id = b.id)) AS duplicates FROM batch b GROUP BY symbol")
def duplicates(t: Tables) -> DataFrame:
    old, batch = halves(t)
    return K.duplicate_counts(old, batch, ["platform", "id", "symbol"], ["symbol"])


@query("snk8_equity_instruments", "SELECT 'us-stock:' || upper(symbol) AS instrument_key, upper(symbol) AS display_name, 'us_equity' AS asset_class, symbol <> 'retired' AS is_active FROM tracked_symbols")
def equity_instruments(t: Tables) -> DataFrame:
    """Instruments of active symbols; ones that are no longer active stay as they were."""
    known = t.tracked_symbols.where(~F.col("is_active")).select(F.concat(F.lit("us-stock:"), F.upper("symbol")).alias("instrument_key"), F.upper("symbol").alias("display_name"), F.lit("us_equity").alias("asset_class"), F.lit(False).alias("is_active"))
    return K.upsert(known, K.equity_instruments(t.tracked_symbols.where("is_active")), ["instrument_key"])


@query("snk10_replace_all", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, c_mktsegment, 0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")
def replace_all(t: Tables) -> DataFrame:
    rows = t.raw("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = rows.where("c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0").withColumn("c_nationkey", F.lit(0))
    return K.replace_all(rows, new, "c_mktsegment", "BUILDING")


@query("snk11_soft_delete", "SELECT symbol, is_active AND symbol <> 'click' AS is_active FROM tracked_symbols")
def soft_delete(t: Tables) -> DataFrame:
    return K.deactivate(t.tracked_symbols, "symbol", "click")


@query("jn15_join_delete", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def join_delete(t: Tables) -> DataFrame:
    gone = t.raw("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.raw("orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("snk14_export_month", "SELECT id, timestamp FROM posts WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp < TIMESTAMP '2024-02-01 00:00:00'")
def export_month(t: Tables) -> DataFrame:
    return K.month_of(t.posts, "timestamp", "2024-01-01").select("id", ntz("timestamp").alias("timestamp"))


@query("snk15_manifest", "SELECT 'posts' AS dataset, DATE '2024-01-01' AS range_start, DATE '2024-02-01' AS range_end, count(*) AS row_count, min(timestamp) AS min_event, max(timestamp) AS max_event FROM posts WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp < TIMESTAMP '2024-02-01 00:00:00'")
def manifest(t: Tables) -> DataFrame:
    m = K.manifest(K.month_of(t.posts, "timestamp", "2024-01-01"), "posts", "timestamp", "2024-01-01")
    return m.select("dataset", "range_start", "range_end", "row_count", ntz("min_event").alias("min_event"), ntz("max_event").alias("max_event"))


@query("snk16_purge", f"SELECT id FROM posts WHERE NOT (ingested_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAYS)")
def purge(t: Tables) -> DataFrame:
    return K.purge(t.posts, "ingested_at", as_of(), 10).select("id")


@query("snk19_topic_backfill", "SELECT id, CASE WHEN topic_id = -1 THEN 0 ELSE topic_id END AS topic_id FROM posts")
def topic_backfill(t: Tables) -> DataFrame:
    """Rows without a topic get the one found for them."""
    none = t.posts.withColumn("topic_id", F.when(F.col("topic_id") >= 0, F.col("topic_id")))
    found = none.where("topic_id IS NULL").select("id", F.lit(0).alias("_found"))
    return none.join(found, "id", "left").select("id", F.coalesce("topic_id", "_found").alias("topic_id"))


@query("ret3_pruned_links", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderdate >= TIMESTAMP '2000-07-31 00:00:00'")
def pruned_links(t: Tables) -> DataFrame:
    """Links whose event is older than a year go with it."""
    orders = t.raw("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    events = K.purge(orders, "at", F.lit("2001-08-01 00:00:00").cast("timestamp"), 366)
    return orders.join(events.select("event_id"), "event_id", "left_semi").select("event_id")


@query(
    "ret6_one_commit",
    f"""old AS (SELECT *, date_trunc('hour', timestamp) AS hour FROM posts WHERE {_OLD}), f AS (SELECT count(*) AS n FROM old GROUP BY hour, symbol, platform, topic_id, topic_model_hash, sentiment_model_hash)
SELECT 'posts' AS name, count(*) AS n, count(*) AS posts FROM posts WHERE NOT {_OLD} UNION ALL SELECT 'facts', count(*), coalesce(sum(n), 0)::BIGINT FROM f UNION ALL SELECT 'snapshots', count(*), coalesce(sum(n), 0)::BIGINT FROM f
UNION ALL SELECT 'labels', count(DISTINCT (symbol, hour)), count(*) FROM old UNION ALL SELECT 'staged', count(*), count(*) FROM ({_SAMPLE} AND {_OLD} UNION ALL {_CHALLENGE.replace('>= 95', '>= 100').replace('>= 0.5', '>= 0.8')} AND {_OLD})
UNION ALL SELECT 'runs', count(DISTINCT (symbol, hour)), count(*) FROM old""",
)
def one_commit(t: Tables) -> DataFrame:
    """Two retention runs at the same time over one store: each post is folded once, and all tables change in one commit."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(t.spark, S.scratch(t.spark))
    for part in range(2):
        store.transact(lambda tx: insert(tx, "posts", t.posts.where(F.col("id").cast("long") % 2 == part), S.IDENTITY, "timestamp"))  # noqa: B023
    run = lambda name: retention(store, at(CUTOFF), as_of(), name, list(_PLATFORMS), 0.25)
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(run, ("run-1", "run-2")))
    now = store.snapshot()
    rows = lambda name, posts: now.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(posts, F.lit(0)).cast("long").alias("posts"))
    out = t.spark.createDataFrame([("runs", sum(d[0] for d in done), sum(d[1] for d in done))], "name string, n long, posts long")
    classes = F.sum(F.col("positive_count") + F.col("neutral_count") + F.col("negative_count"))
    for name, posts in (("posts", F.count("*")), ("facts", F.sum("post_count")), ("snapshots", F.sum("post_count")), ("labels", classes), ("staged", F.count("*"))):
        out = out.unionByName(rows(name, posts))
    return out


@query(
    "str5_known_identities",
    "SELECT b.batch, count(*) AS received, count(*) FILTER (id::BIGINT % 4 < b.batch) AS duplicates FROM posts, (SELECT unnest([0, 1, 2, 3])::INT AS batch) b WHERE id::BIGINT % 4 = b.batch OR (id::BIGINT % 4 < b.batch AND id::BIGINT % 12 < 2) GROUP BY ALL",
)
def known_identities(t: Tables) -> DataFrame:
    """Four batches; each brings its own posts and some that batches before it had, a day later: the identity decides, not the time."""
    folder = S.scratch(t.spark)
    write, n = S.store(folder), F.col("id").cast("long")
    score = F.create_map(F.lit("positive"), F.col("p_pos"), F.lit("neutral"), F.col("p_neu"), F.lit("negative"), F.col("p_neg"))
    posts = t.posts.withColumn("scores", score)
    for k in range(4):
        late = F.when(n % 4 < k, F.col("timestamp") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("timestamp"))
        write(posts.where((n % 4 == k) | (n % 4 < k) & (n % 12 < 2)).withColumn("timestamp", late), k)
    stored = S.read(t.spark, folder, "posts").groupBy((n % 4).cast("int").alias("batch")).agg(F.count("*").alias("stored"))
    return S.read(t.spark, folder, "quality").join(stored, "batch").select("batch", (F.col("stored") + F.col("duplicates")).alias("received"), "duplicates")
