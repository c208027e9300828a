"""Daily windows in a time zone: whether a time lies in one of several, and when the next begins."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_zone(zone: str) -> bool:
    try:
        zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return False
    return True


def heavy_window(ms: Column, windows: list[tuple[int, int]], zone: str) -> tuple[Column, Column]:
    """Whether a time (milliseconds) lies in one of the windows (start and end minute of the day; the end is outside, and a window may pass
    midnight), and the start of the next one, null inside.

    No windows allow all times, and so does a zone that is not known: a mistake in the configuration must not stop all work. Null and
    times out of range are allowed as well. Starts are looked for on two days by the zone's rules: one that a clock change skips comes as much later as the
    clock jumps, one that it repeats counts the first time."""
    never = F.lit(None).cast("long")
    if not windows or not known_zone(zone):
        return F.lit(True), never
    fits = ms.between(-62_135_596_800_000 + 172_800_000, 253_402_300_799_999 - 3 * 86_400_000)
    at = F.timestamp_millis(F.when(fits, ms))
    local = F.from_utc_timestamp(at, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    inside, starts = F.lit(False), []
    day = F.date_trunc("day", local)
    for start, end in windows:
        inside |= ((minute >= start) & (minute < end)) if start < end else ((minute >= start) | (minute < end))
        for days in (0, 1):
            begin = F.unix_millis(F.to_utc_timestamp(day + F.make_dt_interval(F.lit(days), F.lit(start // 60), F.lit(start % 60)), zone))
            starts.append(F.when(begin > ms, begin))
    inside = F.coalesce(inside, F.lit(True))
    first = starts[0] if len(starts) == 1 else F.least(*starts)
    return inside, F.when(~inside, first)
