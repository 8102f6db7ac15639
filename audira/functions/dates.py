"""Date, time-zone and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from audira.functions.text import col

# Fixed value: local time is UTC+9 all year.
LOCAL_HOURS = 9


def parse_sheet_date(c: Column | str) -> Column:
    """Dates written as '2024. 1. 5'; anything else is null."""
    return F.to_date(F.try_to_timestamp(F.trim(col(c)), F.lit("yyyy. M. d")))


def parse_loose_date(c: Column | str) -> Column:
    """Dates written with dots, slashes or dashes, with or without blanks."""
    compact = F.regexp_replace(F.trim(col(c)), " ", "")
    dashed = F.regexp_replace(F.regexp_replace(compact, "[./]", "-"), "-$", "")
    four = F.to_date(F.try_to_timestamp(dashed, F.lit("yyyy-M-d")))
    plain = F.to_date(F.try_to_timestamp(dashed, F.lit("yyyyMMdd")))
    return F.when(dashed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), four).when(dashed.rlike(r"^\d{8}$"), plain)


def normalize_year(c: Column | str, default: int = 2025) -> Column:
    """Digits of a year text; two-digit years are 2000-based; ``default`` when there are none."""
    digits = F.regexp_extract(col(c).cast("string"), r"([0-9]+)", 1).try_cast("int")
    return F.coalesce(F.when(digits < 100, digits + 2000).otherwise(digits), F.lit(default))


def to_local(c: Column | str) -> Column:
    """UTC wall time to local wall time."""
    return col(c) + F.expr(f"INTERVAL {LOCAL_HOURS} HOURS")


def utc_to_local_date(c: Column | str) -> Column:
    """ISO 'yyyy-MM-ddTHH:mm:ssZ' text to the local date; other shapes are null."""
    text = col(c)
    stamp = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.to_date(to_local(stamp))


def to_utc_string(c: Column | str) -> Column:
    """Local wall time to ISO text in UTC."""
    utc = col(c) - F.expr(f"INTERVAL {LOCAL_HOURS} HOURS")
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _part(text: Column, unit: str) -> Column:
    return F.coalesce(F.regexp_extract(text, rf"([0-9]+){unit}", 1).try_cast("bigint"), F.lit(0))


def iso_duration_seconds(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return _part(text, "H") * 3600 + _part(text, "M") * 60 + _part(text, "S")


def iso_duration_minutes(c: Column | str) -> Column:
    return F.round(iso_duration_seconds(c) / 60.0, 1)


def clock_text(seconds: Column | str) -> Column:
    """Seconds as M:SS, or H:MM:SS from one hour on."""
    s = col(seconds).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%d:%02d", F.floor(s / 60), rest)
    )


def video_kind(seconds: Column | str) -> Column:
    return F.when(col(seconds) <= 60, F.lit("Shorts")).otherwise(F.lit("Clip"))


def parse_period_label(c: Column | str) -> Column:
    """Struct(year, month, week) from the first three integers of a label, null when out of range."""
    numbers = F.regexp_extract_all(F.trim(col(c)), F.lit(r"([0-9]+)"), F.lit(1))
    year = F.get(numbers, F.lit(0)).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    month = F.get(numbers, F.lit(1)).try_cast("int")
    week = F.get(numbers, F.lit(2)).try_cast("int")
    valid = year.between(2000, 2100) & month.between(1, 12) & week.between(1, 6)
    return F.when(
        (F.size(numbers) >= 3) & valid,
        F.struct(year.alias("year"), month.alias("month"), week.alias("week")),
    )
