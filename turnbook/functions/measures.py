"""Ratios, growth rules, rounding and clock expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TAIPEI = "Asia/Taipei"

# The regular session opens at 09:00 Taipei and lasts 270 minutes;
# below a tenth of the session no closing projection is given.
SESSION_START_MINUTE = 540
SESSION_MINUTES = 270
MIN_PROGRESS = 0.1


def _double(value: Column) -> Column:
    return value.cast("double")


def turnover_growth(current: Column, baseline: Column) -> Column:
    """Null only when the baseline is zero."""
    return F.when(baseline != 0, (_double(current) - _double(baseline)) / _double(baseline))


def price_growth(current: Column, baseline: Column) -> Column:
    """Null unless both are present and the baseline is positive."""
    return F.when(baseline > 0, (_double(current) - _double(baseline)) / _double(baseline))


def share(part: Column, total: Column) -> Column:
    """Part of a total; zero when the total is zero."""
    return F.when(total == 0, F.lit(0.0)).otherwise(_double(part) / _double(total))


def half_even(value: Column, scale: int) -> Column:
    return F.bround(value, scale)


def half_away(value: Column, scale: int) -> Column:
    return F.round(value, scale)


def significant(value: Column, digits: int = 8) -> Column:
    """Half-even rounding to significant digits (never fewer than zero decimals)."""
    magnitude = F.floor(F.log10(F.abs(value)))
    places = F.least(F.greatest(F.lit(digits - 1) - magnitude, F.lit(0)), F.lit(28))
    scale = F.pow(F.lit(10.0), places.cast("double"))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.bround(value * scale, 0) / scale)


def percent_ratio(part: Column, whole: Column) -> Column:
    """Exact-enough percentage of two decimals, before rounding.

    The division of wide decimals keeps few decimals; these widths leave ten
    after the multiplication, so a value just off a half is not rounded as one.
    """
    return part.cast("decimal(24,4)") * 100 / whole.cast("decimal(22,4)")


def percent_from_points(points: Column, value: Column) -> Column:
    """Index change in percent from its change in points."""
    previous = value - points
    return F.when(previous > 0, half_even(percent_ratio(points, previous), 2))


def percent_change(current: Column, baseline: Column) -> Column:
    """Percent number with two decimals, null without a positive baseline."""
    return F.when(baseline > 0, half_even(percent_ratio(current - baseline, baseline), 2))


def taipei(captured_at: Column) -> Column:
    """Wall clock in Taipei of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(TAIPEI), captured_at.cast("timestamp_ntz"))


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def slot_of(local: Column, minutes: int = 2) -> Column:
    """Start minute of the collection slot."""
    return (F.floor(minute_of_day(local) / minutes) * minutes).cast("int")


def progress_at_minute(minute: Column) -> Column:
    elapsed = (minute - SESSION_START_MINUTE) / F.lit(float(SESSION_MINUTES))
    return F.least(F.greatest(elapsed, F.lit(0.0)), F.lit(1.0))


def session_progress(captured_at: Column) -> Column:
    return progress_at_minute(minute_of_day(taipei(captured_at)))


def projected_close(turnover: Column, progress: Column) -> Column:
    return F.when(progress >= MIN_PROGRESS, _double(turnover) / progress)


def month_index(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.trunc(day, "week")


def eligible_month(today: Column) -> Column:
    """The month before ``today``; it never falls back further."""
    return F.add_months(F.trunc(today, "month"), -1)


def previous_year_end(day: Column) -> Column:
    return F.date_sub(F.trunc(day, "year"), 1)
