"""Date parsing of string cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Outlines of the accepted date texts (month first for slashes) and the format of each;
# ISO forms need none, the timestamp cast reads them.
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}([.]\d{1,9})?)?)?$"
OTHER_SHAPES = {
    r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
    r"^\d{1,2}-\d{1,2}-\d{4}$": "M-d-yyyy",
    r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$": "MMM d, yyyy",
    r"^\d{1,2} [A-Z][a-z]{2} \d{4}$": "d MMM yyyy",
}
DATE_SHAPE = "|".join(f"({p})" for p in [ISO_SHAPE, *OTHER_SHAPES])


def date_shaped(value: Column) -> Column:
    """The trimmed cell has the outline of a date."""
    return F.trim(value).rlike(DATE_SHAPE)


def parse_date(value: Column) -> Column:
    """Timestamp of a string cell, or null when no accepted form fits.

    The outline picks the one parser to run, so a text column costs a pattern
    match per cell and no failed parses.
    """
    t = F.trim(value)
    parsed = F.when(t.rlike(ISO_SHAPE), t.try_cast("timestamp"))
    for shape, fmt in OTHER_SHAPES.items():
        parsed = parsed.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt)))
    return parsed


def calendar_parts(name: str, ts: Column) -> list[Column]:
    """Year, month, day, day of week (Monday 0), quarter and month-edge flags as doubles."""
    d = F.to_date(ts)
    parts = {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "dayofweek": F.weekday(d),
        "quarter": F.quarter(d),
        "is_month_start": (F.dayofmonth(d) == 1),
        "is_month_end": (d == F.last_day(d)),
    }
    return [c.cast("double").alias(f"{name}_{part}") for part, c in parts.items()]
