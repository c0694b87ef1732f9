"""Delay, class and weight expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagcast import params as P


def clamp(value: Column, low: float = P.DELAY_MIN, high: float = P.DELAY_MAX) -> Column:
    """Limit to a range; null stays null (``greatest``/``least`` skip nulls)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def final_delay(arrival: Column, departure: Column) -> Column:
    return F.coalesce(arrival, departure)


def leave_delay(arrival: Column, departure: Column) -> Column:
    return F.coalesce(departure, arrival)


def tod_gap(a: Column, b: Column) -> Column:
    """Distance of two minutes of day around the clock."""
    straight = F.abs(a - b)
    return F.when(straight.isNotNull(), F.least(straight, 1440 - straight))


def same_connection(a: Column, b: Column, circular: bool = True) -> Column:
    gap = tod_gap(a, b) if circular else F.abs(a - b)
    return gap <= P.TOD_WINDOW


def tod_slot(tod: Column) -> Column:
    """Slot of a minute of day, one window wide; joins on it spread a busy
    connection over the day and leave only near times to be compared."""
    return F.floor(tod / P.TOD_WINDOW).cast("int")


def near_slots(tod: Column, circular: bool = True) -> Column:
    """Slots that can hold a time within the window: its own and both neighbours."""
    slot, slots = tod_slot(tod), 1440 // P.TOD_WINDOW
    around = [slot - 1, slot, slot + 1]
    return F.array(*[F.pmod(s, F.lit(slots)) if circular else s for s in around])


def age_days(run_day: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.date_diff(as_of, run_day))


def decay(age: Column, half_life: float) -> Column:
    if math.isinf(half_life):
        return F.lit(1.0)
    return F.exp(F.lit(-math.log(2.0) / half_life) * age)


def run_weight(
    run_day: Column,
    as_of: Column,
    half_life: float = P.HALF_LIFE_DAYS,
    boost: float = P.WEEKDAY_BOOST,
) -> Column:
    """Recency weight, raised on the weekday of the reference date."""
    same = F.weekday(run_day) == F.weekday(as_of)
    return decay(age_days(run_day, as_of), half_life) * F.when(same, boost).otherwise(1.0)


def bandwidth(live: Column, factor: float = P.KERNEL_FACTOR) -> Column:
    return F.greatest(F.lit(P.KERNEL_MIN_BANDWIDTH), F.lit(factor) * F.abs(live))


def likeness(prev: Column, live: Column, factor: float = P.KERNEL_FACTOR, floor: float = P.KERNEL_FLOOR) -> Column:
    """How much a run with a previous-stop delay resembles the live one."""
    z = (prev - live) / bandwidth(live, factor)
    return F.lit(floor) + F.exp(F.lit(-0.5) * z * z)


def train_class(category: Column) -> Column:
    upper = F.upper(category)
    return (
        F.when(upper.isin(*P.LONG_DISTANCE), "LONG_DISTANCE")
        .when(upper == "S", "SBAHN")
        .when(upper.isin(*P.REGIONAL), "REGIONAL")
        .when(category.rlike(r"^\p{L}"), "REGIONAL")
        .otherwise("OTHER")
    )


def product_bucket(train_type: Column) -> Column:
    """Score group of the backtest; case matters here."""
    return (
        F.when(train_type.isin(*P.LONG_DISTANCE_BACKTEST), "long_distance")
        .when(train_type == "S", "sbahn")
        .otherwise("regional")
    )


def time_band(planned: Column) -> Column:
    hour = F.hour(planned)
    return (
        F.when(hour.between(6, 8), "MORNING_PEAK")
        .when(hour.between(9, 15), "MIDDAY")
        .when(hour.between(16, 18), "EVENING_PEAK")
        .otherwise("NIGHT")
    )


def ticket_covers(category: Column) -> Column:
    """Flat-fare ticket: every train but long distance."""
    return train_class(category) != "LONG_DISTANCE"
