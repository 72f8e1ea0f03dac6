"""Service time: local windows, slots, day types and text timestamps.

Instants are TIMESTAMP columns under a UTC session (see `session.prepare`);
seconds of the service day stay integers because they may exceed 86 400.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgrain.functions.text import stripped
from fleetgrain.session import OPERATIONAL_TZ

# Fallback offsets in minutes, nearest first, past before future.
FALLBACK_OFFSETS = (0, -5, 5, -10, 10, -15, 15, -20, 20, -25, 25, -30, 30)
WINDOW_MICROS = 300_000_000
SLOTS_PER_DAY = 288
HISTORY_DAYS = 7
# Day columns in ISO weekday order.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_BR_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})"


def local(ts: Column, tz: str = OPERATIONAL_TZ) -> Column:
    """Wall-clock time of an instant, as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def instant(wall: Column, tz: str = OPERATIONAL_TZ) -> Column:
    """Instant of a wall-clock TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), wall).cast("timestamp")


def source_timestamp(c: Column, tz: str = OPERATIONAL_TZ) -> Column:
    """ISO text, or day-first or ISO text with minutes; naive means operational zone."""
    s = F.regexp_replace(stripped(c), _BR_DATE, "$3-$2-$1")
    day_first_without_time = stripped(c).rlike(_BR_DATE + "$")
    usable = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & ~day_first_without_time
    zoned = s.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & s.rlike(r"[T ]\d{2}:")
    return F.when(
        usable,
        F.when(zoned, s.try_cast("timestamp")).otherwise(
            instant(s.try_cast("timestamp_ntz"), tz)
        ),
    )


def locale_date(c: Column) -> Column:
    """Four accepted forms (ISO or day first, with or without HH:mm) else null."""
    s = F.regexp_replace(stripped(c), _BR_DATE, "$3-$2-$1")
    accepted = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2})?$")
    return F.when(accepted, s.try_cast("timestamp_ntz"))


def gtfs_date(c: Column) -> Column:
    return F.try_to_date(F.when(c.rlike(r"^\d{8}$"), c), "yyyyMMdd")


def gtfs_seconds(c: Column) -> Column:
    parts = F.split(c, ":")
    hours, minutes, seconds = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return hours * 3600 + minutes * 60 + seconds


def clock_text(seconds: Column) -> Column:
    """Seconds of the service day as HH:MM:SS, hours may pass 24."""
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600),
        F.floor(F.pmod(seconds, F.lit(3600)) / 60),
        F.pmod(seconds, F.lit(60)).cast("long"),
    )


def window_start(ts: Column) -> Column:
    """Start of the five-minute window.

    Zone offsets are whole multiples of five minutes, so the local floor and
    the floor of the instant agree and no zone conversion is needed.
    """
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(WINDOW_MICROS)))


def five_minute_window(ts: Column) -> Column:
    start = window_start(ts)
    return F.struct(
        start.alias("start"), (start + F.expr("INTERVAL 5 MINUTES")).alias("end")
    )


def _day_type(wall: Column) -> Column:
    day = F.weekday(wall)
    return F.when(day == 5, "saturday").when(day == 6, "sunday").otherwise("weekday")


def _slot(wall: Column) -> Column:
    return (F.hour(wall) * 12 + F.floor(F.minute(wall) / 5)).cast("int")


def day_type(ts: Column, tz: str = OPERATIONAL_TZ) -> Column:
    return _day_type(local(ts, tz))


def service_date(ts: Column, tz: str = OPERATIONAL_TZ) -> Column:
    return F.to_date(local(ts, tz))


def slot_index(ts: Column, tz: str = OPERATIONAL_TZ) -> Column:
    return _slot(local(ts, tz))


def fallback_slots(ts: Column, tz: str = OPERATIONAL_TZ) -> Column:
    """Array of 13 (rank, offset_minutes, day_type, slot_index, local_date)."""

    def slot(offset: Column) -> Column:
        wall = local(F.timestamp_micros(F.unix_micros(ts) + offset * 60_000_000), tz)
        return F.struct(
            F.array_position(offsets, offset).cast("int").alias("rank"),
            offset.alias("offset_minutes"),
            _day_type(wall).alias("day_type"),
            _slot(wall).alias("slot_index"),
            F.to_date(wall).alias("local_date"),
        )

    offsets = F.array(*[F.lit(o) for o in FALLBACK_OFFSETS])
    return F.transform(offsets, slot)


def nearest_departure(hhmm: Column, at: Column, tz: str = OPERATIONAL_TZ) -> Column:
    """Of yesterday, today and tomorrow the wall-clock departure nearest to `at`."""
    text = stripped(hhmm)
    valid = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    wall_at = local(at, tz)

    def candidate(offset: int) -> Column:
        day = F.date_add(F.to_date(wall_at), offset)
        wall = F.concat(day.cast("string"), F.lit(" "), text).try_cast("timestamp_ntz")
        gap = F.abs(F.unix_micros(wall.cast("timestamp")) - F.unix_micros(wall_at.cast("timestamp")))
        return F.struct(gap.alias("gap"), F.lit(offset).alias("day"), wall.alias("wall"))

    nearest = F.array_min(F.array(*[candidate(o) for o in (-1, 0, 1)]))
    return F.when(valid, instant(nearest["wall"], tz))


def planned_trip_end(seconds: Column, at: Column, tz: str = OPERATIONAL_TZ) -> Column:
    """Local midnight of the service date plus seconds; negative is null."""
    midnight = F.to_date(local(at, tz)).cast("timestamp_ntz")
    wall = midnight + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.when(seconds >= 0, instant(wall, tz))


def runs_on(day: Column) -> Column:
    """The weekday flag that applies to a date, from the seven flag columns."""
    flag = F.lit(False)
    for index, name in enumerate(WEEKDAYS):
        flag = F.when(F.weekday(day) == index, F.col(name)).otherwise(flag)
    return flag


def date_lit(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def at_lit(value: str | Column) -> Column:
    """Evaluation time as a parameter; never the wall clock of the cluster."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def fresh(ts: Column, at: Column, seconds: float) -> Column:
    """Not older than `seconds` at `at`; literal bounds push down to the scan."""
    return ts >= at - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
