"""Exchange calendar and session rules of New York, as expressions and as a generated calendar table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"
FIRST_YEAR, LAST_YEAR = 1990, 2060


def _day(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def observed(date: Column) -> Column:
    """A holiday on a weekend is kept on the Friday before or the Monday after."""
    d = F.dayofweek(date)
    return F.when(d == 7, F.date_sub(date, 1)).when(d == 1, F.date_add(date, 1)).otherwise(date)


def nth_weekday(year: Column, month: int, weekday: str, nth: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(_day(year, month, 1), 1), weekday), 7 * (nth - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(_day(year, month, 1)), 7), weekday)


def easter(year: Column) -> Column:
    """Western Easter by Gauss's method with the Gregorian corrections of the century."""
    century = F.floor(year / 100)
    moon = F.pmod(15 + century - F.floor(century / 4) - F.floor((13 + 8 * century) / 25), F.lit(30))
    d = F.pmod(19 * (year % 19) + moon, F.lit(30))
    e = F.pmod(2 * (year % 4) + 4 * (year % 7) + 6 * d + F.pmod(4 + century - F.floor(century / 4), F.lit(7)), F.lit(7))
    late = (d == 29) & (e == 6) | (d == 28) & (e == 6) & (year % 19 > 10)
    return F.date_add(_day(year, 3, 22), (d + e - F.when(late, 7).otherwise(0)).cast("int"))


def holidays(year: Column) -> Column:
    """Array of the year's exchange holidays, and the next New Year's day if it is kept in this year."""
    return F.array(
        observed(_day(year, 1, 1)),
        nth_weekday(year, 1, "Mon", 3),
        nth_weekday(year, 2, "Mon", 3),
        F.date_sub(easter(year), 2),
        last_weekday(year, 5, "Mon"),
        observed(_day(year, 6, 19)),
        observed(_day(year, 7, 4)),
        nth_weekday(year, 9, "Mon", 1),
        nth_weekday(year, 11, "Thu", 4),
        observed(_day(year, 12, 25)),
        observed(_day(year + 1, 1, 1)),
    )


def is_weekday(date: Column) -> Column:
    return F.dayofweek(date).between(2, 6)


def is_trading_day(date: Column) -> Column:
    return is_weekday(date) & ~F.array_contains(holidays(F.year(date)), date)


def is_early_close(date: Column) -> Column:
    month, day = F.month(date), F.dayofmonth(date)
    eve = is_weekday(date) & ((month == 7) & (day == 3) | (month == 12) & (day == 24))
    return eve | (date == F.date_add(nth_weekday(F.year(date), 11, "Thu", 4), 1))


def previous_trading_day(date: Column) -> Column:
    """The last trading day of the ten days before."""
    return F.array_max(F.filter(F.sequence(F.date_sub(date, 10), F.date_sub(date, 1)), is_trading_day))


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The calendar of a range of days: day, is_trading_day, is_early_close, previous_trading_day (of the ten days before)."""
    from pyspark.sql import Window as W

    lead = F.sequence(F.date_sub(F.lit(first).cast("date"), 10), F.lit(last).cast("date"))
    table = spark.range(1).select(F.explode(lead).alias("day")).select("day", is_trading_day(F.col("day")).alias("is_trading_day"), is_early_close(F.col("day")).alias("is_early_close"))
    before = W.orderBy("day").rowsBetween(-10, -1)
    return table.withColumn("previous_trading_day", F.max(F.when(F.col("is_trading_day"), F.col("day"))).over(before)).where(F.col("day") >= F.lit(first).cast("date"))


def seconds_of_day(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def equity_session(local: Column, trading: Column, early: Column) -> Column:
    """Session at a local wall time: both ends of the regular session belong to it, a fraction after its last second does not."""
    s = seconds_of_day(local) + (F.date_format(local, "SSSSSS").cast("int") > 0).cast("int") * 0.5
    close = F.when(early, 13 * 3600).otherwise(16 * 3600)
    return (
        F.when(~trading, "closed")
        .when((s >= 34200) & (s <= close), "regular")
        .when((s >= 14400) & (s < 34200), "pre")
        .when((s > close) & (s <= 72000), "after")
        .otherwise("closed")
    )


def with_equity_session(df: DataFrame, at: str, name: str) -> DataFrame:
    """df with the session of each row's time; NULL becomes closed.

    Holidays are worked out once for each day of FIRST_YEAR to LAST_YEAR, not once for each row. That table has the same 25,933
    days whatever the input, so it is broadcast. Rows of other years have theirs worked out by the same rules.
    """
    day = F.explode(F.sequence(F.make_date(F.lit(FIRST_YEAR), F.lit(1), F.lit(1)), F.make_date(F.lit(LAST_YEAR), F.lit(12), F.lit(31))))
    table = df.sparkSession.range(1).select(day.alias("_day")).select("_day", is_trading_day(F.col("_day")).alias("_open"), is_early_close(F.col("_day")).alias("_early"))
    local = F.from_utc_timestamp(at, ZONE)
    joined = df.withColumn("_day", F.to_date(local)).join(F.broadcast(table), "_day", "left")
    missed = F.col("_open").isNull()  # F.when works the rules out only where no day was found
    trading = F.coalesce(F.when(missed, is_trading_day(F.col("_day"))).otherwise(F.col("_open")), F.lit(False))
    early = F.when(missed, is_early_close(F.col("_day"))).otherwise(F.col("_early"))
    return joined.withColumn(name, equity_session(local, trading, early)).drop("_day", "_open", "_early")


def futures_session(at: Column) -> Column:
    local = F.from_utc_timestamp(at, ZONE)
    weekday, s = F.dayofweek(local), seconds_of_day(local)
    shut = (weekday == 7) | (weekday == 6) & (s >= 61200) | (weekday == 1) & (s < 64800)
    return F.when(shut, "futures_closed").when((s >= 61200) & (s < 64800), "futures_break").otherwise("futures_open")


def local_to_utc(local: Column, zone: str) -> Column:
    """Wall time to UTC; NULL where the wall time does not exist or comes twice."""
    utc = F.to_utc_timestamp(local, zone)
    exists = F.from_utc_timestamp(utc, zone) == local
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    return F.when(exists & ~twice, utc)


def bar_due(at: Column, zone: str, weekdays: list[int], close_minute: int, grace_minutes: int, done_on: Column) -> Column:
    """Whether a daily bar should be fetched: a listed weekday (1 Monday), not done today, and the close and its grace are over."""
    local = F.from_utc_timestamp(at, zone)
    day = F.to_date(local)
    weekday = (F.dayofweek(local) + 5) % 7 + 1
    over = F.hour(local) * 60 + F.minute(local) >= close_minute + grace_minutes
    return weekday.isin(weekdays) & over & (done_on.isNull() | (done_on < day))


def month_bounds(day: Column) -> tuple[Column, Column]:
    """First day of the month before, and of the month of `day`: the last closed month, half open."""
    start = F.trunc(day, "month")
    return F.add_months(start, -1), start
