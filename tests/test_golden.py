"""Known answers of single functions."""

import json

import pytest
from pyspark.sql import functions as F

from brookline.functions import calendar, stats, text
from brookline.operators import joins as J
from brookline.operators import series as S
from brookline.plans import activity, market, posts
from brookline.sources import adapters as A
from brookline.sources.views import Tables, with_views
from tests.compare import connect, same


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def nums(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("values, f, want", [((10, 20, 30, 40, 50), 0.05, 10), ((10, 20, 30, 40, 50), 0.95, 40), ((1, 2, 3, 4), 0.5, 2), ((1, 2, 3, 4), 1.5, 4), ((1, 2, 3, 4), -0.5, 1), ((1, 2, 3, 4), float("nan"), 0), ((), 0.5, 0)])
def test_percentile(spark, values, f, want):
    assert value(spark, stats.percentile(nums(*values) if values else F.array().cast("array<double>"), f)) == want


def fitted(spark, pairs, least=3):
    df = spark.createDataFrame(pairs, "x double, y double")
    return df.agg(stats.pearson("y", "x", least).alias("r"), stats.beta("y", "x", least).alias("b")).first()


def test_pearson(spark):
    assert fitted(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]).r == pytest.approx(1)
    assert fitted(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]).b == pytest.approx(2)
    assert fitted(spark, [(1.0, 2.0), (2.0, 4.0)]).r is None
    assert tuple(fitted(spark, [(1.0, 2.0), (1.0, 4.0), (1.0, 6.0)])) == (None, None)


@pytest.mark.parametrize("r, want", [(0.1999, "weak"), (0.2, "moderate"), (0.3999, "moderate"), (0.4, "strong"), (-0.5, "strong"), (None, None)])
def test_strength(spark, r, want):
    assert value(spark, stats.strength(F.lit(r).cast("double"), 0.2, 0.4)) == want


@pytest.mark.parametrize("hour, day, age, want", [(0, 0, None, "silent"), (2, 12, 60.0, "active"), (0, 12, 60.0, "quiet"), (0, 100, 20000.0, "stalled")])
def test_source_status(spark, hour, day, age, want):
    assert value(spark, activity.status(F.lit(hour), F.lit(day), F.lit(age).cast("double"))) == want


def test_macd(spark):
    rows = [("s", i, v) for i, v in enumerate([0.1, None, 0.3, 0.4, 0.5, 0.6])]
    out = stats.macd(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], "i", 3, 5, 2).orderBy("i").collect()
    assert [r.macd is None for r in out] == [True] * 4 + [False] * 2
    assert out[5].signal == pytest.approx((out[4].macd + out[5].macd) / 2) and out[4].signal is None
    none = stats.macd(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], "i", 0, 0, 0).collect()
    assert all(r.macd is None and r.hist is None for r in none)


def opportunity(spark, valuation):
    return value(spark, S.opportunity(F.lit(101.0), F.lit(100.0), F.lit(0.5), F.lit(0.2), F.lit(14.0), F.lit(valuation), nums(105, 103, 101), nums(0.1, 0.3, 0.5)))


def test_opportunity(spark):
    best = opportunity(spark, 0.5)
    assert (best.score, best.classification, len(best.checklist)) == (100, "STRONG BUY", 4)
    assert (opportunity(spark, -0.5).score, len(opportunity(spark, -0.5).checklist)) == (80, 3)
    few = value(spark, S.opportunity(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.array().cast("array<double>"), nums(0)))
    assert (few.score, few.color, few.checklist) == (0, "rose", [])


def test_forward_pairs(spark):
    line = lambda *at: spark.createDataFrame([("p", a, float(a)) for a in at], "pair string, at int, r double")
    out = J.forward_pairs(line(10, 20, 30), line(5, 10, 15, 25, 35), F.array(F.lit(0), F.lit(1))).collect()
    assert sorted((r.lag, r.x, r.y) for r in out) == [(0, 10, 15), (0, 20, 25), (0, 30, 35), (1, 10, 25), (1, 20, 35)]


def test_bracket(spark):
    closes = spark.createDataFrame([("k", 100, 1.0), ("k", 200, 2.0), ("k", 300, 3.0)], "k string, t int, c double")
    events = spark.createDataFrame([("k", t) for t in (100, 150, 200, 300)], "k string, t int")
    for bucket in (None, F.floor(F.col("t") / 50), F.floor(F.col("t") / 1000)):
        got = {r.t: (r.before, r.after) for r in J.bracket(events, closes, ["k"], "t", "c", bucket).collect()}
        assert got == {100: (None, 2.0), 150: (1.0, 2.0), 200: (1.0, 3.0), 300: (2.0, None)}
    latest = {r.t: r.c for r in J.as_of(events, closes, ["k"], "t", "c", bucket=F.floor(F.col("t") / 100)).collect()}
    assert latest == {100: 1.0, 150: 1.0, 200: 2.0, 300: 3.0}


def test_exchange_rates(spark):
    turned = value(spark, stats.local_per_dollar(*[F.lit(x) for x in (0.5, 0.8, 0.4, 0.625)], F.lit(False)))
    assert tuple(turned) == (2.0, 2.5, 1.25, 1.6)
    assert value(spark, stats.local_per_dollar(*[F.lit(x) for x in (0.5, 0.0, 0.4, 0.6)], F.lit(True))) is None


def test_relative(spark):
    assert value(spark, stats.relative(F.lit(2.0), F.lit(1.0), False)) == 1
    assert value(spark, stats.relative(F.lit(2.0), F.lit(1.0), True)) == -1
    assert value(spark, stats.relative(F.lit(2.0), F.lit(0.0), False)) == 0


def test_fund_change(spark):
    moves = spark.createDataFrame([("d", "SCHB", 2.0), ("d", "SCHF", 9.0), ("e", "SCHO", None)], "day string, symbol string, change double")
    assert [tuple(r) for r in market.fund_change(moves).collect()] == [("d", 2.0)]


@pytest.mark.parametrize("at, want", [("2026-07-03 16:00:00", "closed"), ("2026-08-21 13:30:00", "regular"), ("2026-12-21 14:30:00", "regular"), ("2026-08-21 20:00:00", "regular"), ("2026-08-21 20:00:01", "after"), ("2026-11-27 18:00:01", "after"), ("2026-08-22 15:00:00", "closed")])
def test_equity_session(spark, at, want):
    df = spark.range(1).select(F.lit(at).cast("timestamp").alias("t"))
    assert calendar.with_equity_session(df, "t", "s").first()["s"] == want


def test_wall_times(spark):
    utc = lambda x: value(spark, calendar.local_to_utc(F.lit(x).cast("timestamp"), calendar.ZONE))
    assert utc("2026-03-08 02:30:00") is None  # does not exist
    assert utc("2026-11-01 01:30:00") is None  # comes twice
    assert str(utc("2026-07-01 09:30:00")) == "2026-07-01 13:30:00"


def test_softmax_and_entailment(spark):
    s = value(spark, stats.softmax3(F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    assert s.label == "neutral" and s.neutral + s.positive + s.negative == pytest.approx(1)
    assert value(spark, stats.softmax3(F.lit(1000.0), F.lit(float("nan")), F.lit(0.0))) is None
    assert value(spark, stats.entailment(F.lit(100.0), F.lit(99.0))) == pytest.approx(0.7310586)
    assert value(spark, stats.entailment(F.lit(1e9), F.lit(1e9))) == 0.5
    assert value(spark, stats.best_topic(nums(0.1, 0.7, 0.7))) == 1
    assert value(spark, stats.best_topic(nums(0.1, 0.5, float("nan")))) == -1


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Kelmora &amp; Sons (&quot;KLMR&quot;) opens, see http://kelmora.test/news?id=7; thanks @plant_manager and @bo", 'Kelmora & Sons ("KLMR") opens, see http thanks @user and @user'),
        ("&lt;b&gt;5 &gt; 3&lt;/b&gt;", "<b>5 > 3</b>"),
        ("www.kelmora.test/a/b?c=d", "http"),
        (" a \n b ", "a b"),
        (None, None),
    ],
)
def test_clean(spark, raw, want):
    assert value(spark, text.clean(F.lit(raw).cast("string"))) == want


def test_gates_and_matches(spark):
    assert value(spark, text.is_outlier(F.lit("@user $KLMR via RT http://kelmora.test")))
    assert not value(spark, text.is_outlier(F.lit("three plain words")))
    rule = text.Rule("OAK", ["Oakhurst"], ["live oak"], require_uppercase=True)
    hit = lambda x: value(spark, text.matches(F.lit(x), rule))
    assert hit("long $oak today") and hit("OAK closed higher") and hit("what oakhurst's board said")
    assert not hit("an oak tree") and not hit("OAK, they call the Live Oak") and not hit("OAKS")


def test_event_query_and_urls(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(spark, text.event_query(a("harbour strike"), a("Norway"), a("SHIPPING"))) == '("harbour strike") AND ("Norway") AND (theme:"SHIPPING")'
    assert value(spark, text.event_query(a(), a(), a())) is None
    assert text.canonical_url("HTTP://News.Kelmora.TEST:80/2025/plant?z=9&m=4#top") == "http://news.kelmora.test/2025/plant?m=4&z=9"
    assert text.canonical_url("gopher://kelmora.test/") is None and text.canonical_url(None) is None


def test_parameters():
    assert posts.hours(None) == 24 and posts.page(None, None) == (20, 0) and posts.symbol(" aapl ") == "AAPL"
    for bad in (lambda: posts.hours(8761), lambda: posts.page(0, 0), lambda: posts.page(1, -1), lambda: posts.horizon(31)):
        with pytest.raises(ValueError):
            bad()


NOW = "2025-03-05 18:30:00"
RULE = text.Rule("KLMR", ["Kelmora"])


def payload(spark, body):
    return spark.createDataFrame([(body,)], "payload string")


def test_bluesky_posts(spark):
    later = {"cid": "k-9", "record": {"text": "Kelmora opens a plant, $KLMR", "createdAt": "2025-03-05T14:45:30Z"}, "likeCount": 11, "repostCount": 5, "replyCount": 1}
    earlier = {"cid": "k-3", "record": {"text": "Kelmora rumours", "createdAt": "2025-03-04T23:59:59Z"}}
    other = {"cid": "k-7", "record": {"text": "nothing to see", "createdAt": "2025-03-05T15:00:00Z"}}
    since = F.lit("2025-03-05 00:00:00").cast("timestamp")
    rows = A.bluesky(payload(spark, json.dumps({"posts": [earlier, later, other]})), RULE, since, F.lit(NOW).cast("timestamp")).collect()
    assert [(r.id, r.text, str(r.timestamp), r.engagement) for r in rows] == [("k-9", "Kelmora opens a plant, $KLMR", "2025-03-05 14:45:30", 11 + 2 * 5 + 3)]


def test_stocktwits_posts(spark):
    messages = [{"id": 90210, "body": "holding through the report", "created_at": "2025-03-05T16:20:00Z", "likes": {"total": 34}}, {"id": 90177, "body": "what a week", "created_at": "yesterday"}]
    rows = A.stocktwits(payload(spark, json.dumps({"messages": messages})), "KLMR", F.lit(NOW).cast("timestamp")).collect()
    assert [(r.id, str(r.timestamp), r.engagement) for r in rows] == [("st_90177", NOW, 1), ("st_90210", "2025-03-05 16:20:00", 34)]
    assert A.stocktwits(payload(spark, '{"messages": "none"}'), "KLMR", F.lit(NOW).cast("timestamp")).count() == 0


def test_reddit_comments(spark):
    comments = [{"id": "q7z", "body": "\n Sold my Kelmora today, good riddance ", "created_utc": 1741190400.7, "score": -4}, {"id": "q80", "body": "   ", "created_utc": 1741190401}, {"id": "", "body": "Kelmora", "created_utc": 1741190402}, {"id": "q81", "body": "KLMR", "created_utc": 1741190403, "score": 6}]
    body = json.dumps({"data": {"children": [{"data": c} for c in comments]}})
    rows = A.reddit(payload(spark, body), [RULE], F.lit(NOW).cast("timestamp")).collect()
    assert [(r.id, r.symbol, str(r.timestamp), r.engagement) for r in rows] == [("rd_q7z", "KLMR", "2025-03-05 16:00:00", 1), ("rd_q81", "KLMR", "2025-03-05 16:00:03", 6)]
    seen = spark.createDataFrame([("q7z",)], "id string")
    assert [r.id for r in A.reddit(payload(spark, body), [RULE], F.lit(NOW).cast("timestamp"), seen).collect()] == ["rd_q81"]


def test_news(spark):
    company = [{"id": 5, "headline": "Kelmora names a chief", "summary": None, "datetime": 1741161600}, {"id": 6, "headline": "Markets mixed", "summary": "Traders wait", "datetime": 1741161600}]
    rows = A.finnhub(payload(spark, json.dumps(company)), RULE, F.lit(NOW).cast("timestamp")).collect()
    assert [(r.id, r.text, str(r.timestamp), r.engagement) for r in rows] == [("finnhub_5", "Kelmora names a chief. ", "2025-03-05 08:00:00", 15)]
    wire = {"news": [{"id": 77, "headline": "Outlook", "summary": "KLMR guides higher", "created_at": "2025-03-05T17:59:01Z"}]}
    rows = A.alpaca(payload(spark, json.dumps(wire)), RULE, F.lit(NOW).cast("timestamp")).collect()
    assert [(r.id, r.text, str(r.timestamp)) for r in rows] == [("alpaca_77", "Outlook. KLMR guides higher", "2025-03-05 17:59:01")]
    assert A.alpaca(payload(spark, "<html>busy</html>"), RULE, F.lit(NOW).cast("timestamp")).count() == 0


def test_chart_bars(spark):
    good, gap, crossed, late = (40.5, 41.0, 40.0, 40.25, 310), (40.25, None, 40.0, 40.5, 90), (40.5, 40.0, 41.0, 40.5, 70), (40.5, 42.0, 40.5, 41.75, None)
    quote = {k: [row[i] for row in (good, gap, crossed, late)] for i, k in enumerate(("open", "high", "low", "close", "volume"))}
    chart = {"chart": {"result": [{"meta": {"regularMarketVolume": 88_000}, "timestamp": [1741185000 + 300 * i for i in range(5)], "indicators": {"quote": [quote]}}]}}
    bars = A.chart_bars(payload(spark, json.dumps(chart))).orderBy("timestamp").collect()
    assert [(str(b.timestamp), b.open, b.high, b.low, b.close, b.volume) for b in bars] == [("2025-03-05 14:30:00", 40.5, 41.0, 40.0, 40.25, 310.0), ("2025-03-05 14:45:00", 40.5, 42.0, 40.5, 41.75, None)]
    last = A.latest_quote(payload(spark, json.dumps(chart)).withColumn("s", F.lit("KLMR")), ["s"]).first()
    assert (last.price, last.volume) == (41.75, 88_000)
    for none in ('{"chart": {"result": null}}', '{"chart": {}}', "[]"):
        assert A.chart_bars(payload(spark, none)).count() == 0


def test_index_and_articles(spark):
    index = {"empty": False, "data": {"labels": ["2025/03/03", "2025/03/04"], "datasets": [{"value_type": "volume", "data": [1, 2]}, {"value_type": "price", "data": [880.5, "902.25"]}]}}
    rows = A.taiwan_index(payload(spark, json.dumps(index))).collect()
    assert [(str(r.session_date), r.open, r.close, r.volume) for r in rows] == [("2025-03-03", 880.5, 880.5, None), ("2025-03-04", 902.25, 902.25, None)]
    index["data"]["labels"].pop()
    with pytest.raises(Exception, match="differ in number"):
        A.taiwan_index(payload(spark, json.dumps(index))).collect()
    links = [("https://News.Kelmora.test:443/a/?z=9&y=8#top", "Plant opens"), ("https://news.kelmora.test/a/?y=8&z=9", "Plant opens again"), ("https://news.kelmora.test/b", " "), ("", "no link")]
    found = {"articles": [{"url": u, "title": t, "domain": "kelmora.test", "seendate": "20250305T091500Z"} for u, t in links]}
    (row,) = A.gdelt(payload(spark, json.dumps(found)).withColumn("k", F.lit(1)), F.lit(NOW).cast("timestamp"), ["k"]).collect()
    assert (row.canonical_url, row.title, row.source_name, str(row.occurred_at)) == ("https://news.kelmora.test/a/?y=8&z=9", "Plant opens", "kelmora.test", "2025-03-05 09:15:00")


def test_catalog(spark, tmp_path):
    from brookline.sources import catalog

    rate = {"instrument_key": "fx:nokusd", "display_name": "Krone", "asset_class": "fx", "currency": "NOK", "timezone": "Europe/Oslo", "provider_aliases": {"yahoo": "NOK=X"}, "session_metadata": {"b": 1, "a": [2]}, "quote_convention": "local_currency_per_usd"}
    good = {"version": 1, "instruments": [rate], "stock_exposures": [{"symbol": "KLMR", "exposures": [{"instrument_key": "fx:nokusd", "reason": "costs"}]}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good))
    listed, exposed = catalog.load(spark, str(path))
    assert listed.first().is_active and listed.first().session_metadata == '{"a":[2],"b":1}' and exposed.first().display_order == 0
    for change in ({"currency": "nok"}, {"timezone": "Europe/Nowhere"}, {"provider_aliases": {}}, {"provider_aliases": {"yahoo": " "}}, {"quote_convention": None}, {"quote_convention": "usd_per_local"}, {"display_name": ""}, {"instrument_key": "fx:NOK"}, {"instrument_key": "index:nok"}, {"session_metadata": None}, {"colour": "red"}):
        assert len(catalog.problems({"version": 1, "instruments": [rate | change]})) == 1, change
    index = rate | {"instrument_key": "index:obx", "asset_class": "index"}
    assert len(catalog.problems({"version": 1, "instruments": [index]})) == 1  # a convention is for rates only
    assert len(catalog.problems({"version": 2, "instruments": []})) == 2 and len(catalog.problems({"version": 1, "instruments": [rate, rate]})) == 1
    one = {"instrument_key": "fx:nokusd", "reason": "costs"}
    for wrong, n in (({"symbol": "klmr", "exposures": []}, 1), ({"symbol": "A", "exposures": [one, one]}, 1), ({"symbol": "A", "exposures": [{"instrument_key": "fx:x", "reason": ""}]}, 2), ({"symbol": "A", "exposures": [one | {"display_order": -1}]}, 1)):
        assert len(catalog.problems({"version": 1, "instruments": [rate], "stock_exposures": [wrong]})) == n, wrong
    with pytest.raises(ValueError):
        catalog.load(spark, {"version": 1, "instruments": [rate | {"currency": None}]})


def test_unclassified_posts_are_all_read(spark):
    folder = "/root/testdata/sf0.01"
    want = connect(folder).sql(with_views("SELECT id, symbol, timestamp FROM posts WHERE topic_id = -1 ORDER BY timestamp DESC, id DESC")).df()
    assert len(want) > 1000
    got = posts.unclassified(Tables(spark, folder)).toPandas()
    same(got, want)
    assert list(got["id"]) == list(want["id"])
    assert list(posts.unclassified(Tables(spark, folder), 1100).toPandas()["id"]) == list(want["id"][:1100])


@pytest.mark.parametrize("at, want", [("1985-08-21 15:00:00", "regular"), ("1985-07-04 15:00:00", "closed"), ("1985-11-29 18:30:00", "after"), ("2070-08-21 15:00:00", "regular"), ("2070-08-23 15:00:00", "closed"), ("2070-12-25 15:00:00", "closed"), (None, "closed")])
def test_equity_session_of_any_year(spark, at, want):
    df = spark.range(1).select(F.lit(at).cast("timestamp").alias("t"))
    assert calendar.with_equity_session(df, "t", "s").first()["s"] == want


def test_only_references_go_to_python(spark):
    import html
    import random

    dice = random.Random(11)
    parts = ["&", "#", "amp", ";", "&lt;", "&notit;", "&#65;", "&#x1F600", "&#128;", "&eacute", "&none;", " ", "\n", "<", "é", "b" * 31, "\\", "$1"]
    texts = [None, "", *["".join(dice.choices(parts, k=dice.randrange(1, 10))) for _ in range(500)]]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.unescape(F.col("t")).alias("u"))
    assert all(r.u == (None if r.t is None else html.unescape(r.t)) for r in rows.collect())
    sent = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x]
    assert len(sent) == 1 and "regexp_extract_all" in sent[0] + rows._jdf.queryExecution().optimizedPlan().toString()
