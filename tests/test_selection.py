"""Ranks by sketches and counts against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brookline.operators import selection as S

RANKS = {"low": S.floor_rank(0.05), "mid": S.nearest_rank(50), "high": S.floor_rank(0.95), "least": S.floor_rank(-3.0), "most": S.nearest_rank(100)}


def by_hand(values):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    n = len(v)
    at = {"low": math.floor((n - 1) * 0.05), "mid": math.ceil(n * 0.5) - 1, "high": math.floor((n - 1) * 0.95), "least": 0, "most": n - 1}
    return {k: v[i] for k, i in at.items()}


@pytest.mark.parametrize("small", [3, 60, 10_000])
def test_ranks(spark, monkeypatch, small):
    """Spread, geometric, repeated and infinite values, groups of one, a NULL key; with small lists every round is needed."""
    monkeypatch.setattr(S, "SMALL", small)
    rng = random.Random(4)
    groups = {
        "even": [float(i) for i in range(400)], "steep": [2.0**i for i in range(-300, 300)], "same": [7.0] * 500, "two": [1.0] * 150 + [2.0] * 151,
        "odd": [float("nan")] * 80 + [float("inf"), float("-inf")] * 40 + [0.0] * 5, "one": [3.0], None: [rng.gauss(0, 1) for _ in range(300)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("even", None), ("void", None)]
    rng.shuffle(rows)
    got = S.at_ranks(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", RANKS).collect()
    assert len(got) == len(groups)
    for r in got:
        want = by_hand(groups[r.g])
        assert all(r[k] == want[k] or math.isnan(want[k]) and math.isnan(r[k]) for k in want), (r, want)


def test_a_useless_sketch_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 4)
    monkeypatch.setattr(S, "STEPS", 1)
    real = F.percentile_approx
    monkeypatch.setattr(S.F, "percentile_approx", lambda c, grid, accuracy: real(c, [0.2, 0.3], accuracy))  # always the same two
    df = spark.range(60).select(F.lit("x").alias("g"), (F.col("id") * 7 % 60).cast("double").alias("v"))
    assert tuple(S.at_ranks(df, ["g"], "v", RANKS).select("low", "mid", "high", "least", "most").first()) == (2.0, 29.0, 56.0, 0.0, 59.0)


def test_no_values(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert S.at_ranks(empty, ["g"], "v", RANKS).columns == ["g", *RANKS] and S.at_ranks(empty, ["g"], "v", RANKS).count() == 0
