"""Events with a value of zero, as sf0.1 has six and the smaller tables none: the queries keep them, as their SQL does."""

import duckdb
import pytest

from brookline.plans import registry
from tests.compare import same

registry.load()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("zero")
    value = "CASE WHEN event_id % 50 < 2 THEN 0.0 ELSE value END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({value} AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{made}/events.parquet'")
    return str(made)


@pytest.mark.parametrize("name", ["mth8_fx_bars", "src14_chart_bars", "src15_latest_bar", "src16_session_bars", "src21_histories"])
def test_zero_prices_are_kept(spark, folder, name):
    duck = duckdb.connect()
    for table in ("events", "embeddings"):
        place = folder if table == "events" else "/root/testdata/sf0.001"
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{place}/{table}.parquet'")
    got = registry.QUERIES[name](spark, folder).toPandas()
    same(got, duck.sql(registry.ORACLES[name]).df())
