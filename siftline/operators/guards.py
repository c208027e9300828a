"""What must hold before a presence scan may mark files: a scan that saw too little marks nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percent of the known files that a scan must see, by kind of root; percent that may newly vanish
#: before files expire.
LOCAL_PERCENT, REMOTE_PERCENT, VANISHED_PERCENT = 90, 75, 2


def seen_files(reads: DataFrame) -> DataFrame:
    """root_id, seen (distinct keys that were read), errors, from reads (root_id, sub_id, ino, errno).

    A file that could not be read is not absent: it keeps its row, but does not count as seen."""
    key = F.when(F.col("errno").isNull(), F.struct("sub_id", "ino"))
    return reads.groupBy("root_id").agg(F.count_distinct(key).alias("seen"), F.count_if(F.col("errno").isNotNull()).alias("errors"))


def verdict(scans: DataFrame) -> DataFrame:
    """scans (root_id, kind, unchanged, folder_errors, known, seen, errors, seen_before) with blocked (the reason, or
    null), by_record (concluded since the last scan saw no more) and trusted (its numbers are kept for the next).

    unchanged: the root was the same device, inode and domain at both ends. known: files before the scan, null if
    unreadable."""
    percent = F.when(F.col("kind") == "remote", REMOTE_PERCENT).otherwise(LOCAL_PERCENT)
    enough = F.col("seen") * 100 >= F.col("known") * percent
    record = F.coalesce((F.col("seen_before") > 0) & (F.col("seen") >= F.col("seen_before")), F.lit(False))
    blocked = (
        F.when(~F.col("unchanged"), "root_changed")
        .when(F.col("folder_errors") > 0, "read_errors")
        .when(F.col("known").isNull(), "count_unreadable")
        .when(F.col("seen") == 0, "nothing_seen")
        .when(~enough & ~record, "too_few")
    )
    out = scans.withColumn("blocked", blocked)
    by_record = F.col("blocked").isNull() & ~F.coalesce(enough, F.lit(False))
    trusted = F.col("unchanged") & (F.col("errors") == 0) & (F.col("seen") > 0) & F.col("known").isNotNull()
    return out.withColumn("by_record", by_record).withColumn("trusted", trusted)


def may_expire(errors: Column, vanished: Column, known: Column) -> Column:
    """Whether missing files may become gone: nothing was unreadable and few files vanished in this scan."""
    return F.coalesce((errors == 0) & (vanished * 100 <= known * VANISHED_PERCENT), F.lit(False))


class Session:
    """One presence scan of one root at a time: begin, seen, then finish or abort."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.parts: list[DataFrame] = []

    def begin(self, root: int) -> None:
        if self.root is not None:
            raise ValueError(f"a scan of root {self.root} is open")
        self.root = root

    def seen(self, keys: DataFrame) -> None:
        if self.root is None:
            raise ValueError("no scan is open")
        self.parts.append(keys.select("sub_id", "ino"))

    def abort(self) -> None:
        self.root, self.parts = None, []

    def finish(self, files: DataFrame, root: int, scan_id: int, verdicts: DataFrame) -> DataFrame:
        """The rows that vanish: none unless ``verdicts`` (root_id, blocked, as ``verdict`` gives them) has this root and does not block it. Another
        root than the one that was begun is an error and leaves the scan open."""
        from .catalog import presence

        if self.root is None or root != self.root:
            raise ValueError(f"the open scan is of root {self.root}, not {root}")
        keys = files.select("sub_id", "ino").limit(0)
        for p in self.parts:
            keys = keys.union(p)
        self.abort()
        free = verdicts.where("blocked is null").select("root_id").distinct()
        return presence(files.join(free, "root_id", "left_semi"), keys.distinct(), root, scan_id)
