"""Scalar functions on what the operating system reports: keys, errors, mount and disk tables, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error numbers that stay, and those that show that a file is gone.
PERMANENT = (1, 6, 13, 19, 36, 40, 75)
ABSENT = (2, 20)


def hex_le(n: Column) -> Column:
    """The eight bytes of a long, least first, in lower-case hex; the sign bit counts as the 64th."""
    big = F.lower(F.lpad(F.hex(n), 16, "0"))
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in range(7, -1, -1)))


def id_from_parts(low: Column, high: Column) -> Column:
    """A 16-byte id of two unsigned 64-bit numbers, in hex."""
    return F.concat(hex_le(low), hex_le(high))


def unsigned(n: Column) -> Column:
    """A long read as an unsigned 64-bit number."""
    wide = n.cast("decimal(20,0)")
    return F.when(n < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def unescape_octal(text: Column) -> Column:
    r"""A field of the mount table: \040, \011, \012 and \134 stand for space, tab, line end and backslash."""
    for code, char in (("040", " "), ("011", "\t"), ("012", "\n")):
        text = F.replace(text, F.lit("\\" + code), F.lit(char))
    return F.replace(text, F.lit("\\134"), F.lit("\\"))


def utc_text(ms: Column) -> Column:
    """A time in milliseconds as text, in UTC; what is out of range is shown as a number."""
    ok = ms.between(-62_135_596_800_000, 253_402_300_799_999)
    text = F.concat(F.date_format(F.timestamp_millis(F.when(ok, ms)), "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))
    return F.when(ok, text).otherwise(F.concat(F.lit("invalid("), ms.cast("string"), F.lit(")")))


def error_class(errno: Column, folder: Column) -> Column:
    """What a read of a file's state shows: file, not_file, gone, ignore or retry. errno is null if it went well."""
    return F.when(errno.isNull(), F.when(folder, "not_file").otherwise("file")).when(errno == 2, "gone").when(errno.isin(*PERMANENT), "ignore").otherwise("retry")


def proves_absence(errno: Column) -> Column:
    """Only these two errors show that a file is not there; others say nothing."""
    return F.coalesce(errno.isin(*ABSENT), F.lit(False))


def allowed(mode: str, path: Column, allow: list[str], kind: Column) -> Column:
    """Whether a file may be changed: in dedup mode, under an allowed path, and on a local root."""
    from .scalars import under_dir

    if mode != "dedup" or not allow:
        return F.lit(False)
    under = under_dir(path, allow[0])
    for a in allow[1:]:
        under |= under_dir(path, a)
    return under & (kind != "remote")


def window_at(ms: Column, start: int, end: int, zone: str) -> tuple[Column, Column]:
    """Whether a time lies in a daily window (minutes of the day in a zone; it may pass midnight), and its next start.

    The zone's own rules decide: a day may have 23 or 25 hours."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    minute = F.hour(local) * 60 + F.minute(local)
    inside = (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)
    day = F.date_trunc("day", local)
    at = lambda days: F.unix_millis(F.to_utc_timestamp(day + F.make_dt_interval(F.lit(days), F.lit(start // 60), F.lit(start % 60)), zone))
    return inside, F.when(at(0) > ms, at(0)).otherwise(at(1))


def disk_fields(line: Column) -> dict[str, Column]:
    """Device, sectors read and written and busy milliseconds of a line of the disk table; nulls where fields are missing."""
    f = F.split(F.trim(line), r"\s+")
    number = lambda i: F.try_element_at(f, F.lit(i)).try_cast("bigint")
    return {"device": F.try_element_at(f, F.lit(3)), "read_sectors": number(6), "written_sectors": number(10), "busy_ms": number(13)}


def own_bytes(text: Column) -> Column:
    """Bytes that reached the disk, read and written, in a process's table of counters (a name, a colon and a number a line). The first
    line of a name that has a number counts; names that are missing count as 0."""
    one = lambda name: F.coalesce(F.regexp_extract(text, rf"(?m)^{name}:[ \t]*\+?([0-9]+)[ \t\r]*$", 1).try_cast("bigint"), F.lit(0))
    return one("read_bytes") + one("write_bytes")


def control_word(line: Column) -> Column:
    """The command of a control line; null for what is none."""
    word = F.lower(F.regexp_replace(line, r"^\s+|\s+\z", ""))
    return F.when(word.isin("ping", "pause", "resume", "status"), word)


def retry_after(reconcile_ms: int) -> int:
    """How long a task waits after a scan that could not conclude."""
    return max(reconcile_ms // 12, 600_000)


def sleep_ms(last: Column, period: Column, now: int) -> Column:
    """The time until a task is due, from none to a minute."""
    return F.when(last.isNull(), F.lit(0)).otherwise(F.greatest(F.least(last + period - now, F.lit(60_000)), F.lit(0))).cast("bigint")
