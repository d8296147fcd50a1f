"""Numeric kernels as column expressions and window recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null: greatest and least would turn it into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def pearson(y: str, x: str, least: int) -> Column:
    """Aggregate: Pearson's r, held to -1..1; NULL for fewer than `least` (2 at least) pairs or no variance."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    r = F.try_divide(F.regr_sxy(y, x), F.when(spread > EPSILON, spread))
    return F.when(F.regr_count(y, x) >= max(least, 2), clamp(r, -1.0, 1.0))


def beta(y: str, x: str, least: int) -> Column:
    """Aggregate: slope of y on x under the same conditions as pearson()."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    slope = F.try_divide(F.regr_sxy(y, x), F.when(F.regr_sxx(y, x) > 0, F.regr_sxx(y, x)))
    return F.when((F.regr_count(y, x) >= max(least, 2)) & (spread > EPSILON), slope)


def percentile(values: Column, fraction: float) -> Column:
    """The value at floor((n - 1) * fraction) of the sorted array; 0 if it is empty. The fraction is held to 0..1."""
    if fraction != fraction:
        return F.lit(0.0)
    f = min(1.0, max(0.0, fraction))
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.greatest(F.lit(1), F.floor((n - 1) * F.lit(f)).cast("int") + 1))).otherwise(F.lit(0.0))


def full_mean(x: str | Column, window, period: int) -> Column:
    """Moving average that is NULL unless the window is full of values."""
    over = window.rowsBetween(-(period - 1), 0)
    if period <= 0:
        return F.lit(None).cast("double")
    return F.when(F.count(x).over(over) == period, F.avg(x).over(over))


def carried(x: str, window) -> Column:
    """The last value that is not NULL."""
    return F.last(x, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0))


def macd(df: DataFrame, value: str, keys: list[str], order: str, fast: int, slow: int, signal: int) -> DataFrame:
    """df with macd, signal and hist of the carried-forward value."""
    w = W.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_filled", carried(value, w))
    out = out.withColumn("macd", full_mean("_filled", w, fast) - full_mean("_filled", w, slow)).withColumn("signal", full_mean("macd", w, signal))
    return out.withColumn("hist", F.col("macd") - F.col("signal")).drop("_filled")


def strength(r: Column, moderate: float, strong: float, strict: bool = False) -> Column:
    """weak, moderate or strong by the size of r; NULL for NULL. strict: a bound itself is still below."""
    a = F.abs(r)
    above = (lambda b: a > b) if strict else (lambda b: a >= b)
    return F.when(finite(r), F.when(above(strong), "strong").when(above(moderate), "moderate").otherwise("weak"))


def relative(value: Column, baseline: Column, invert: bool) -> Column:
    """(value - baseline) / baseline, the sign turned if asked for; 0 where it is not defined."""
    r = F.try_divide(value - baseline, baseline)
    r = F.when(finite(value) & finite(baseline) & finite(r), r).otherwise(F.lit(0.0))
    return -r if invert else r


def softmax3(neutral: Column, positive: Column, negative: Column) -> Column:
    """Struct of three probabilities and the label; NULL unless all logits are finite. Ties: neutral, positive, negative."""
    top = F.greatest(neutral, positive, negative)
    n, p, g = (F.exp(x - top) for x in (neutral, positive, negative))
    total = n + p + g
    label = F.when((neutral >= positive) & (neutral >= negative), "neutral").when(positive >= negative, "positive").otherwise("negative")
    return F.when(finite(neutral) & finite(positive) & finite(negative), F.struct((n / total).alias("neutral"), (p / total).alias("positive"), (g / total).alias("negative"), label.alias("label")))


def entailment(entails: Column, contradicts: Column) -> Column:
    """Sigmoid of the difference of two logits, without overflow on either side."""
    d = entails - contradicts
    return F.when(d >= 0, 1 / (1 + F.exp(-d))).otherwise(F.exp(d) / (1 + F.exp(d)))


def best_topic(scores: Column, threshold: float = 0.6) -> Column:
    """Index of the highest score that reaches the threshold (the first of equals), else -1; NaN counts as none."""
    clean = F.transform(scores, lambda s: F.when(F.isnan(s), F.lit(-1.0)).otherwise(s))
    top = F.array_max(clean)
    return F.when(top >= threshold, F.array_position(clean, top).cast("int") - 1).otherwise(F.lit(-1))


def local_per_dollar(open_: Column, high: Column, low: Column, close: Column, is_local: Column, zero: bool = False) -> Column:
    """Prices in local currency per dollar: inverted (high and low change places) unless they are so already; NULL unless all are positive and finite.
    zero: a price may be zero, which inverted is infinite."""
    good = F.lit(True)
    for c in (open_, high, low, close):
        good = good & finite(c) & (c >= 0 if zero else c > 0)
    names = ("open", "high", "low", "close")
    kept = F.struct(*[c.alias(n) for c, n in zip((open_, high, low, close), names)])
    inverse = lambda c: F.coalesce(F.try_divide(F.lit(1.0), c), F.lit(float("inf")))
    turned = F.struct(*[inverse(c).alias(n) for c, n in zip((open_, low, high, close), names)])
    return F.when(good & is_local, kept).when(good, turned)


#: Fixed value: per cent beyond which a day's move is taken for an error.
PLAUSIBLE = 8.0


def current_move(current: Column, reference: Column) -> Column:
    """Move in per cent against a reference above zero; NULL for others."""
    return F.when(reference > 0, (current / reference - 1) * 100)


def proxy_change(previous: Column, now: Column, most: float = PLAUSIBLE) -> Column:
    """Change in percent; NULL if it is not defined or larger than is plausible."""
    change = F.try_divide(now - previous, F.when(previous > 0, previous)) * 100
    return F.when(finite(change) & (F.abs(change) <= most), change)


def nearest_rank(values: Column, per_cent: float) -> Column:
    """The value at rank ceil(per_cent / 100 * n) of an array, the first at least; NULL of none."""
    n = F.size(values)
    rank = F.least(F.greatest(F.ceil(F.lit(per_cent / 100) * n), F.lit(1)), n)
    return F.when(n > 0, F.element_at(F.array_sort(values), rank.cast("int")))
