"""Dates and durations. Dates are strings YYYY-MM-DD or `unknown`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import col

UNKNOWN = "unknown"


def _parsed(x: Column, form: str) -> Column:
    return F.date_format(F.try_to_timestamp(x, F.lit(form)), "yyyy-MM-dd")


def normalise_date(x) -> Column:
    """Of ISO dates and times, year/month/day, `5 May 2024`, `May 5, 2024`; else the first ten characters."""
    x = col(x)
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}\z"), x)
    tried = F.coalesce(
        iso, F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\z"), _parsed(x, "yyyy-M-d'T'H:m:s")), F.when(x.rlike(r"^\d{4}/\d{1,2}/\d{1,2}\z"), _parsed(x, "yyyy/M/d")),
        F.when(x.rlike(r"^\d{1,2} \w+ \d{4}\z"), _parsed(x, "d MMMM yyyy")), F.when(x.rlike(r"^\w+ \d{1,2}, \d{4}\z"), _parsed(x, "MMMM d, yyyy")),
    )
    return F.coalesce(tried, F.when(F.length(x) >= 10, F.left(x, F.lit(10))), F.lit(UNKNOWN))


def upload_date(x) -> Column:
    x = col(x)
    dashed = F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
    return F.when(F.length(x) == 8, dashed).otherwise(F.coalesce(F.nullif(x, F.lit("")), F.lit(UNKNOWN)))


def pdf_date(x) -> Column:
    digits = F.regexp_extract(col(x), r"^(?:D:)?([0-9]{8})", 1)
    return F.when(digits == "", UNKNOWN).otherwise(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


def seconds_of(x) -> Column:
    """H:M:S, M:S or plain seconds, fractions kept; null if none of these."""
    parts = F.split(F.replace(col(x), F.lit(","), F.lit(".")), ":")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(parts) == 2, part(0) * 60 + part(1)).when(F.size(parts) == 1, part(0))


def feed_duration(x) -> Column:
    return F.coalesce(F.floor(seconds_of(x)), F.lit(0)).cast("bigint")


def format_duration(x) -> Column:
    s = F.floor(col(x)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    pad = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), pad(m), pad(r))).otherwise(F.concat_ws(":", m.cast("string"), pad(r)))


# Zones that feeds name, in minutes from UTC.
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def feed_date(x) -> Column:
    """RFC 2822 dates as the day in UTC; the weekday is not read. Without a time or zone, the day as written."""
    bare = F.regexp_replace(col(x), r"^\s*[A-Za-z]{3},\s*", "")
    day = F.regexp_extract(bare, r"^(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    clock = F.regexp_extract(bare, r"^\d{1,2} [A-Za-z]{3} \d{4} (\d{2}:\d{2}(?::\d{2})?)", 1)
    zone = F.upper(F.regexp_extract(bare, r"\d{2}:\d{2}(?::\d{2})?\s+([A-Za-z]{1,4}|[+-]\d{4})\s*\z", 1))
    named = F.try_element_at(F.create_map(*[F.lit(v) for pair in ZONES.items() for v in pair]), zone)
    told = F.regexp_extract(zone, r"^([+-]\d{2})", 1).try_cast("int") * 60 + F.concat(F.left(zone, F.lit(1)), F.right(zone, F.lit(2))).try_cast("int")
    minutes = F.coalesce(named, told, F.lit(0))
    seconds = F.split(F.coalesce(F.nullif(clock, F.lit("")), F.lit("00:00")), ":")
    at = F.get(seconds, 0).cast("int") * 60 + F.get(seconds, 1).cast("int") - minutes
    parsed = F.to_date(F.try_to_timestamp(day, F.lit("d MMM yyyy")))
    return F.coalesce(F.date_format(F.date_add(parsed, F.floor(at / 1440).cast("int")), "yyyy-MM-dd"), F.lit(UNKNOWN))


def post_date(x) -> Column:
    """ISO times with zone, `Jan 5, 2024` with more after it, or `January 5, 2024`."""
    x = col(x)
    short = F.regexp_extract(x, r"^([A-Za-z]{3} \d{1,2}, \d{4})", 1)
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.left(x, F.lit(10))), F.when(short != "", _parsed(short, "MMM d, yyyy")), F.when(x.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}\z"), _parsed(x, "MMMM d, yyyy")), F.lit(UNKNOWN))
