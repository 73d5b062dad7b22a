"""Dates as strings, epoch seconds and display text; the zone is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(c: Column, default: int) -> Column:
    """The first four digits if a separator follows them, else the default."""
    year = F.when(F.substring(c, 5, 1).isin("-", "/"), F.substring(c, 1, 4).try_cast("int"))
    return F.coalesce(year, F.lit(default))


def valid_date(c: Column) -> Column:
    """YYYY-MM-DD and a day of the calendar."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def epoch_of(c: Column, zone: str = "UTC", strict: bool = True) -> Column:
    """Seconds at midnight of the zone; null or '' gives null. Bad text fails, or gives null if not strict."""
    text = F.nullif(c, F.lit(""))
    day = F.to_date(text, "yyyy-MM-dd") if strict else F.try_to_date(text, "yyyy-MM-dd")
    at = F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(0), F.lit(0), F.lit(0), F.lit(zone))
    return F.unix_timestamp(at)


def display_date(c: Column, pattern: str = "MMMM dd, yyyy") -> Column:
    """Epoch seconds in the session's zone as text; null gives ''."""
    return F.coalesce(F.date_format(F.timestamp_seconds(c), pattern), F.lit(""))


def date_of_timestamp(c: Column) -> Column:
    """The date of an ISO timestamp in its own offset."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )
