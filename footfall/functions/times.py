"""Time arithmetic on whole microseconds and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
SECONDS_PER_DAY = 86_400
MICROS_PER_DAY = MICROS_PER_SECOND * SECONDS_PER_DAY


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since the epoch of a timestamp column."""
    return F.unix_micros(_col(c).cast("timestamp"))


def epoch_seconds(c) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.unix_seconds(_col(c).cast("timestamp"))


def seconds_between(later, earlier) -> Column:
    """Elapsed seconds with the fraction kept."""
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_SECOND))


def minutes_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60.0 * MICROS_PER_SECOND)


def hours_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3600.0 * MICROS_PER_SECOND)


def days_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_DAY))


def whole_days_between(later, earlier) -> Column:
    """Elapsed days cut towards zero, as an integer."""
    return days_between(later, earlier).cast("int")


def shift_days(c, days) -> Column:
    """A timestamp moved by a number of days; negative moves back."""
    return F.timestamp_micros(micros(c) + F.lit(int(days * MICROS_PER_DAY)))


def parse_ts(c) -> Column:
    """ISO-8601 UTC text to timestamp; text that does not parse becomes null."""
    return F.try_to_timestamp(_col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def month_text(c) -> Column:
    """The ``YYYY-MM`` prefix of an ISO timestamp string."""
    return F.substring(_col(c), 1, 7)


def day_start(c) -> Column:
    return F.to_date(_col(c))


def week_start(c) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", _col(c)))


def year_week_start(c) -> Column:
    """First day of the seven-day block counted from 1 January.

    Blocks follow the one-based day of the year, so the first block of a year
    holds six days.
    """
    d = F.to_date(_col(c))
    blocks = F.floor(F.dayofyear(d) / 7).cast("int")
    return F.date_add(F.trunc(d, "year"), blocks * 7)


def month_start(c) -> Column:
    return F.trunc(F.to_date(_col(c)), "month")


def year_start(c) -> Column:
    return F.trunc(F.to_date(_col(c)), "year")


def is_weekday(c) -> Column:
    """True from Monday to Friday."""
    return F.weekday(_col(c)) < 5


def weekday_name(c) -> Column:
    return F.date_format(_col(c), "EEEE")


def month_index(c, start) -> Column:
    """Whole months between two month starts."""
    c, start = _col(c), _col(start)
    return (F.year(c) - F.year(start)) * 12 + (F.month(c) - F.month(start))


def align_to_year(c, year: int) -> Column:
    """The same month and day in another year; 29 February becomes the 28th."""
    d = _col(c)
    day = F.when(F.month(d) == 2, F.least(F.dayofmonth(d), F.lit(28))).otherwise(F.dayofmonth(d))
    return F.make_date(F.lit(year), F.month(d), day)
