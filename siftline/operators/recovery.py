"""What to do at start with each operation that a journal shows as unfinished."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recover(journal: DataFrame, observed: DataFrame, boot_ns: int) -> DataFrame:
    """decision (closed, abort, retry, done, restore), requeue and the journal's next state, by journal row.

    journal: id, state, root_id, rel_path, dst_sub_id, dst_ino, dst_size, dst_mtime_ns, dst_atime_ns, updated_at (ms).
    observed: root_id, rel_path, sub_id, ino, size, mtime_ns, ctime_ns of the files that could be read, one row each.
    A destination that was cloned and not touched since has its old size, equal mtime and ctime, and both lie
    between the journal's entry and the start; its times are then put back (restore_*)."""
    o = observed.select("root_id", "rel_path", "sub_id", "ino", "size", "mtime_ns", "ctime_ns")
    both = journal.join(o, ["root_id", "rel_path"], "left")
    ms = F.expr("(mtime_ns - pmod(mtime_ns, 1000000L)) div 1000000L")  # rounded down
    cloned = (F.col("size") == F.col("dst_size")) & (F.col("mtime_ns") == F.col("ctime_ns")) & (ms >= F.col("updated_at")) & (F.col("mtime_ns") <= boot_ns)
    key = (F.col("sub_id") == F.col("dst_sub_id")) & (F.col("ino") == F.col("dst_ino"))
    decision = (
        F.when(F.col("state").isin("planned", "compared"), "abort")
        .when(F.col("state") != "cloned", "closed")
        .when(F.col("ino").isNull() | ~key, "retry")
        .when(F.col("mtime_ns") == F.col("dst_mtime_ns"), "done")
        .when(cloned, "restore")
        .otherwise("abort")
    )
    both = both.withColumn("decision", decision)
    restore = F.col("decision") == "restore"
    return both.select(
        "id",
        "decision",
        (restore | ((F.col("decision") == "abort") & (F.col("state") == "cloned"))).alias("requeue"),
        F.when(F.col("decision") == "abort", "aborted").when(F.col("decision").isin("done", "restore"), "done").otherwise(F.col("state")).alias("journal_state"),
        F.when(restore, F.col("dst_mtime_ns")).alias("restore_mtime_ns"),
        F.when(restore, F.col("dst_atime_ns")).alias("restore_atime_ns"),
    )
