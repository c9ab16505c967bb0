"""Parsing of publish times to epoch seconds (UTC), independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers up to this are days since 1899-12-30, larger ones epoch seconds.
SERIAL_MAX = 99_999
SERIAL_EPOCH = -2209161600
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _seconds(day: Column, clock: Column) -> Column:
    """Of yyyy-MM-dd and HH:mm:ss; null if either is no such thing."""
    days = F.unix_date(day.try_cast("date"))
    h, m, s = (F.substring(clock, k, 2).try_cast("int") for k in (1, 4, 7))
    ok = (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, days.cast("long") * 86400 + h * 3600 + m * 60 + s)


def _of_pattern(text: Column) -> Column:
    """yyyy-MM-dd with nothing, HH:mm or HH:mm:ss behind a space or T."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"), F.substring(text, 1, 10))
    clock = F.when(F.length(text) == 19, F.substring(text, 12, 8)).when(F.length(text) == 16, F.concat(F.substring(text, 12, 5), F.lit(":00"))).when(F.length(text) == 10, "00:00:00")
    return _seconds(day, clock)


def parse_publish_time(text: Column, strict: bool = False) -> Column:
    """Serial days, epoch seconds or one of three formats (to the second, with a space or T, or the day)."""
    n = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    number = F.when(n <= SERIAL_MAX, F.floor(n * 86400 + F.lit(0.5)) + SERIAL_EPOCH).otherwise(F.floor(n))
    # The strict formats have no bare HH:mm.
    found = F.coalesce(number, F.when(F.length(text) != 16, _of_pattern(text)))
    if strict:
        found = F.coalesce(found, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("unknown publish time: "), text)).cast("long")))
    return found


def parse_publish_time_lenient(text: Column) -> Column:
    """Digits are epoch seconds, or yyyyMMddHHmmss if there are 14; four more formats; else null."""
    t = F.trim(text)
    compact = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    stamp = _seconds(compact, F.concat_ws(":", F.substring(t, 9, 2), F.substring(t, 11, 2), F.substring(t, 13, 2)))
    return F.when(t.rlike(r"^\d{14}$"), stamp).when(t.rlike(r"^\d{1,12}$"), t.try_cast("long")).otherwise(_of_pattern(t))


def parse_weibo_time(text: Column) -> Column:
    """"Mon Jul 01 08:30:00 +0800 2024" as "2024-07-01 08:30:00", in the message's own offset; anything else as it is."""
    pattern = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) (\d{2}) (\d{2}:\d{2}:\d{2}) [+-]\d{4} (\d{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, pattern, 1))
    good = text.rlike(pattern) & (month > 0)
    day = F.concat_ws("-", F.regexp_extract(text, pattern, 4), F.lpad(month.cast("string"), 2, "0"), F.regexp_extract(text, pattern, 2))
    return F.when(good, F.concat_ws(" ", day, F.regexp_extract(text, pattern, 3))).otherwise(text)
