"""Date and time expressions on zone-less local timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagcast.params import SERVICE_DAY_SHIFT_HOURS

DAY_MINUTES = 1440


def whole_minutes(changed: Column, planned: Column) -> Column:
    """Delay in minutes, cut toward zero."""
    return F.timestamp_diff("MINUTE", planned, changed).cast("int")


def minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("int")


def service_day(planned: Column) -> Column:
    """Date of the run a stop belongs to; stops after midnight stay with their run."""
    return F.to_date(planned - F.make_dt_interval(hours=F.lit(SERVICE_DAY_SHIFT_HOURS)))


def parse_compact(text: Column) -> Column:
    """``yyMMddHHmm`` to a timestamp, null where it is not one."""
    ok = F.when(text.rlike(r"^\d{10}$"), text)

    def part(pos: int) -> Column:
        return F.substring(ok, pos, 2).cast("int")

    return F.try_make_timestamp_ntz(2000 + part(1), part(3), part(5), part(7), part(9), F.lit(0))


def parse_clock(text: Column) -> Column:
    """``HH:mm`` to minutes, null where it is not one."""
    parts = F.split(text, ":", 3)
    return F.when(
        F.size(parts) == 2,
        parts[0].try_cast("int") * 60 + parts[1].try_cast("int"),
    )


def clock(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))


ZONE = "Europe/Berlin"


def instant(ts: Column, zone: str = ZONE) -> Column:
    """A local time as UTC, so that differences are right on nights of a clock change."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def plus_minutes(ts: Column, minutes: Column, zone: str = ZONE) -> Column:
    """Local time moved by whole or fractional minutes that pass."""
    moved = instant(ts, zone) + F.make_dt_interval(secs=(minutes * 60).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), moved)


def at_minute(day: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minute)


def next_at(after: Column, minute: Column) -> Column:
    """First moment at a minute of day that does not lie before ``after``."""
    same_day = at_minute(F.to_date(after), minute)
    return F.when(same_day < after, same_day + F.make_dt_interval(days=F.lit(1))).otherwise(same_day)


def live_minutes(changed: Column, planned: Column, zone: str = ZONE) -> Column:
    """Reported delay in fractional minutes between two local times as instants."""
    return F.timestamp_diff("MICROSECOND", instant(planned, zone), instant(changed, zone)) / F.lit(6.0e7)


def delay_clock(planned: Column, delay: Column) -> Column:
    """Clock text of a planned time moved by a delay."""
    return F.date_format(plus_minutes(planned, delay), "HH:mm")


def departure_or_default(hour: Column, minute: Column, day: Column, now: Column) -> Column:
    """Requested departure: the picked time, 06:00 on another day, else now."""
    today = F.to_date(now)
    date = F.coalesce(day, today)
    picked = at_minute(date, hour * 60 + F.coalesce(minute, F.lit(0)))
    return F.coalesce(picked, F.when(date != today, at_minute(date, F.lit(360))), now)


def trip_minutes(start: Column, end: Column) -> Column:
    """Whole minutes of a trip, never negative."""
    return F.greatest(F.lit(0), F.timestamp_diff("MINUTE", instant(start), instant(end)).cast("int"))


def tick_step(span: Column) -> Column:
    """Distance of clock ticks giving at most about four over a span of minutes."""
    steps = [1, 2, 5, 10, 15, 30, 60]
    chosen = F.when(span <= 4 * steps[0], steps[0])
    for step in steps[1:]:
        chosen = chosen.when(span <= 4 * step, step)
    return chosen
