"""Public holidays and timetable changes as column expressions.

The rules are plain integer arithmetic on the year, so no calendar table has to
be joined: the flags are computed where they are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter_sunday(year: Column) -> Column:
    """Easter by Lichtenberg's form of the Gauss rule (Gregorian years)."""
    century = _div(year, 100)
    leap = _div(3 * century + 3, 4)
    moon_shift = 15 + leap - _div(8 * century + 13, 25)
    golden = F.pmod(year, F.lit(19))
    seed = F.pmod(19 * golden + moon_shift, F.lit(30))
    full_moon = 21 + seed - _div(seed + _div(golden, 11), 29)
    first_sunday = 7 - F.pmod(year + _div(year, 4) + 2 - leap, F.lit(7))
    to_sunday = 7 - F.pmod(full_moon - first_sunday, F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (full_moon + to_sunday - 1).cast("int"))


# Fixed-date nationwide holidays as month * 100 + day.
FIXED_HOLIDAYS = (101, 501, 1003, 1225, 1226)
# Nationwide holidays as days after Easter Sunday: Good Friday, Easter Monday,
# Ascension, Whit Monday.
EASTER_OFFSETS = (-2, 1, 39, 50)
# Further holidays of Bavaria, used by one backtest variant: Epiphany, All
# Saints, Corpus Christi (Assumption is not statewide).
BAVARIAN_FIXED = (106, 1101)
BAVARIAN_OFFSETS = (60,)


def is_holiday(day: Column, bavaria: bool = False) -> Column:
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    after_easter = F.date_diff(day, easter_sunday(F.year(day)))
    fixed = FIXED_HOLIDAYS + (BAVARIAN_FIXED if bavaria else ())
    offsets = EASTER_OFFSETS + (BAVARIAN_OFFSETS if bavaria else ())
    return month_day.isin(*fixed) | after_easter.isin(*offsets)


def effective_weekday(day: Column, bavaria: bool = False) -> Column:
    """ISO weekday 1..7; a holiday counts as Sunday."""
    return F.when(is_holiday(day, bavaria), 7).otherwise(F.weekday(day) + 1)


def _second_sunday(year: Column, month: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "SUN"), 7)


def next_timetable_change(day: Column) -> Column:
    """Second Sunday of June or December, strictly after a date."""
    year = F.year(day)
    changes = [_second_sunday(year, 6), _second_sunday(year, 12), _second_sunday(year + 1, 6)]
    return F.coalesce(*[F.when(change > day, change) for change in changes])


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Calendar dimension between two dates."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")
    )
    return with_calendar(days, "d")


def with_calendar(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns(
        {
            "holiday": is_holiday(F.col(day)),
            "effective_weekday": effective_weekday(F.col(day)),
            "next_change": next_timetable_change(F.col(day)),
        }
    )
