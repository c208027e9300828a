"""Scalar functions as Column expressions: paths, literals, time, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY, HOUR, RESTORABLE


def div(a: Column, n: int) -> Column:
    """Whole quotient of a non-negative number; exact for all longs."""
    return ((a - a % n).cast("decimal(20,0)") / n).cast("bigint")


def _when(pairs: list[tuple[Column, object]], otherwise: Column | None = None) -> Column:
    out = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def parse_bytes(text: Column) -> Column:
    """Bytes of '64MiB', '500 gb', '1024'; null for what is no size or too large for a long."""
    n, unit = F.regexp_extract(text, r"^\s*([0-9]+)\s*([^0-9\s]*)\s*$", 1), F.lower(F.regexp_extract(text, r"^\s*([0-9]+)\s*([^0-9\s]*)\s*$", 2))
    scale = _when([(unit.isin("", "b"), F.lit(1))] + [(unit.isin(u, u + "b", u + "ib"), F.lit(1024**p)) for p, u in enumerate("kmgt", 1)])
    return F.when(n != "", F.try_multiply(n.try_cast("bigint"), scale.cast("bigint")))


def parse_duration_ms(text: Column) -> Column:
    n, unit = F.regexp_extract(text, r"^\s*([0-9]+)\s*([^0-9\s]*)\s*$", 1), F.lower(F.regexp_extract(text, r"^\s*([0-9]+)\s*([^0-9\s]*)\s*$", 2))
    scale = _when([(unit == "ms", F.lit(1)), (unit.isin("", "s", "sec"), F.lit(1000)), (unit.isin("m", "min"), F.lit(60_000)), (unit.isin("h", "hr"), F.lit(HOUR)), (unit.isin("d", "day"), F.lit(DAY))])
    return F.when(n != "", F.try_multiply(n.try_cast("bigint"), scale.cast("bigint")))


def _largest(n: Column, units: list[tuple[int, str]], rest: str) -> Column:
    pairs = [((n >= m) & (n % m == 0), F.concat(F.floor(n / m).cast("string"), F.lit(u))) for m, u in units]
    return _when(pairs, F.concat(n.cast("string"), F.lit(rest)))


def format_bytes(n: Column) -> Column:
    """The largest unit that divides n."""
    return _largest(n, [(1024**p, u) for p, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))], "B")


def format_duration(ms: Column) -> Column:
    return _largest(ms, [(DAY, "d"), (HOUR, "h"), (60_000, "m"), (1000, "s")], "ms")


def human_size(n: Column) -> Column:
    """One decimal of the unit below 1024; bytes are exact."""
    step = lambda p, u: F.concat(F.replace(F.format_number(n / float(1024**p), 1), F.lit(","), F.lit("")), F.lit(f" {u}"))
    return _when([(n < 1024, F.concat(n.cast("string"), F.lit(" B"))), (n < 1024**2, step(1, "KiB")), (n < 1024**3, step(2, "MiB")), (n < 1024**4, step(3, "GiB"))], step(4, "TiB"))


def backoff_ms(attempts: Column) -> Column:
    """15 minutes doubled for each attempt, a day at most."""
    return F.least(F.lit(900_000) * F.pow(F.lit(2.0), F.least(attempts, F.lit(16))).cast("bigint"), F.lit(DAY))


def restore_target(prev: Column) -> Column:
    return F.when(prev.isin(*RESTORABLE), prev).otherwise("settling")


def initial_state(mtime_ns: Column, now: int, settle: int) -> tuple[Column, Column]:
    ms = div(mtime_ns, 1_000_000)
    done = ms <= now - settle
    return F.when(done, "sized").otherwise("settling"), F.when(~done, ms + settle)


def path_key(path: Column) -> Column:
    """Paths are ordered by their components, not as strings."""
    return F.split(path, "/")


def under_dir(path: Column, folder: str) -> Column:
    """The folder itself and all below it; the empty folder is the whole root. A range, so that it is pushed to the scan."""
    d = folder.rstrip("/")
    return F.lit(True) if not d else (path == d) | ((path >= d + "/") & (path < d + "0"))


def rewrite_prefix(path: Column, old: str, new: str) -> Column:
    """path with the folder old replaced by new; either may be the root."""
    rest = path if not old else F.when(path == old, F.lit("")).otherwise(F.substring(path, F.lit(len(old) + 2), F.length(path)))
    return F.when(rest == "", F.lit(new)).otherwise(rest if not new else F.concat(F.lit(new + "/"), rest))


def has_special_mode(mode: Column) -> Column:
    return mode.bitwiseAND(0o6000) != 0


def is_directory(mode: Column) -> Column:
    return mode.bitwiseAND(0o170000) == 0o040000


def same_fingerprint(a: str, b: str, kind: Column) -> Column:
    """Size, mtime and ctime are equal; ctime does not count on remote roots."""
    c = lambda p, n: F.col(f"{p}{n}")
    return c(a, "size").eqNullSafe(c(b, "size")) & c(a, "mtime_ns").eqNullSafe(c(b, "mtime_ns")) & ((kind == "remote") | c(a, "ctime_ns").eqNullSafe(c(b, "ctime_ns")))


def watch_limit(dirs: Column, limit: Column) -> Column:
    """The next power of two (8192 at least) for 1.2 watches a directory, if the limit is below that; else null."""
    need = div(dirs * 12, 10)
    up = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(need, F.lit(8192)).cast("double")))).cast("bigint")
    return F.when(dirs * 12 > limit * 10, F.greatest(up, limit))


def in_branches(path: Column, branches: list[str]) -> Column:
    """Whether a path lies in one of the folders, by components; no folders mean the whole root."""
    out = F.lit(not branches)
    for b in branches:
        out |= under_dir(path, b)
    return out


def before_cursor(folder: Column, cursor: str) -> Column:
    """Whether a folder lies wholly before the cursor in path order: before it and not above it."""
    at = cursor.split("/")
    above = F.lit(cursor).startswith(F.concat(folder, F.lit("/"))) | (folder == cursor)
    return (path_key(folder) < F.array(*(F.lit(x) for x in at))) & ~above


def reconcile_since(last_ms: int | None) -> int:
    """Changes of an hour before the last run on are looked at again; all if there was none."""
    return max((last_ms or 0) - HOUR, 0)


def in_window(minute: Column, start: int, end: int) -> tuple[Column, Column]:
    """Whether a minute of the day lies in a daily window, which may pass midnight, and the minutes until it does."""
    inside = (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)
    return inside, F.when(inside, F.lit(0).cast("long")).otherwise(F.pmod(F.lit(start) - minute, F.lit(1440)).cast("long"))
