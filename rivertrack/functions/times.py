"""Wall-clock time arithmetic on TIMESTAMP_NTZ columns."""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session time zone.

    In a UTC session this is one cast. Elsewhere the cast would shift times around a
    daylight-saving change, so the parts of the clock time are added up instead.
    """
    ts = _col(ts)
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if zone in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        return F.unix_micros(ts.cast("timestamp"))
    second = (F.extract(F.lit("SECOND"), ts) * MICROS_PER_SECOND).cast("bigint")
    minutes = F.hour(ts).cast("bigint") * 60 + F.minute(ts)
    return (
        F.unix_date(ts.cast("date")) * F.lit(MICROS_PER_DAY)
        + minutes * (60 * MICROS_PER_SECOND)
        + second
    )


def seconds_between(later, earlier) -> Column:
    """Elapsed seconds with their fraction; never truncated to whole seconds."""
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_SECOND))


def elapsed(later, earlier, unit: str) -> Column:
    """Elapsed time from tagging: hours to one decimal, days to none, half to even."""
    secs = seconds_between(later, earlier)
    if unit == "hours":
        return F.bround(secs / 3600.0, 1)
    return F.bround(secs / 86400.0, 0)


def parse_ts(text, fmt: str | None = None) -> Column:
    """Text to TIMESTAMP_NTZ; NULL where it does not parse."""
    text = _col(text)
    if fmt is None:
        return text.try_cast("timestamp_ntz")
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_date(text, fmt: str | None = None) -> Column:
    text = _col(text)
    if fmt is None:
        return text.try_cast("date")
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")
