"""A presence scan of whole roots: what a walk saw, whether it saw enough, and only then what is missing or gone.

The walk is rows (root_id, rel_path, folder, sub_id, ino, errno, counts): a row with an empty rel_path is the root itself as a task saw
it, at its begin or end; counts says whether a file would be in the catalog (it passes the filters). A scan changes nothing where its verdict blocks it:
the changes are joined to the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import may_expire, verdict

DEAD = ("missing", "gone")


def observed(walk: DataFrame, roots: DataFrame) -> DataFrame:
    """For each root (root_id, kind, sub_id, ino of the root as it is known): unchanged, folder_errors, seen and errors.

    unchanged: the root was seen, and whenever it was seen it was the known one. seen: distinct keys of files that count, so that
    hard links and what the filters leave out do not help a scan over its bound."""
    own, file = F.col("rel_path") == "", (F.col("rel_path") != "") & ~F.coalesce("folder", F.lit(False))
    known = roots.select("root_id", "kind", F.struct(F.col("sub_id"), F.col("ino")).alias("known_root"))
    read = F.col("errno").isNull()
    sums = walk.groupBy("root_id").agg(
        F.min(F.when(own & read, F.struct("sub_id", "ino"))).alias("least"),
        F.max(F.when(own & read, F.struct("sub_id", "ino"))).alias("most"),
        F.count_if(own & ~read).alias("lost"),
        F.count_if(F.coalesce("folder", F.lit(False)) & ~own & ~read).alias("folder_errors"),
        F.count_if(file & ~read).alias("errors"),
        F.count_distinct(F.when(file & read & F.coalesce("counts", F.lit(True)), F.struct("sub_id", "ino"))).alias("seen"),
    )
    out = known.join(sums, "root_id", "left")
    same = (F.col("lost") == 0) & (F.col("least") == F.col("known_root")) & (F.col("most") == F.col("known_root"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("root_id", "kind", F.coalesce(same, F.lit(False)).alias("unchanged"), zero("folder_errors"), zero("errors"), zero("seen"))


def conclude(walk: DataFrame, roots: DataFrame, files: DataFrame, records: DataFrame, scan_id: int, cutoff: int) -> dict[str, DataFrame]:
    """verdicts, missing, gone and records of a scan of roots that began at scan_id.

    files: id, root_id, rel_path, sub_id, ino, state, updated_at. records: root_id and seen_before, of the last scan that could be
    trusted. missing (id, prev_state): live files, not touched since the scan began, whose key no task has read; a file that could not be read at
    its path is not taken for absent. gone (id): files missing since before the cutoff, if nothing was unreadable and few files
    vanished in this scan. records: of the scans that may be trusted, for the next."""
    known = files.where("state <> 'gone'").groupBy("root_id").agg(F.count("*").alias("known"))
    scans = observed(walk, roots).join(known, "root_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    verdicts = verdict(scans.join(records.select("root_id", "seen_before"), "root_id", "left"))
    free = verdicts.where("blocked is null").select("root_id")
    file = (F.col("rel_path") != "") & ~F.coalesce("folder", F.lit(False))
    keys = walk.where(file & F.col("errno").isNull()).select("root_id", "sub_id", "ino").distinct()
    unread = walk.where(file & F.col("errno").isNotNull()).select("root_id", "rel_path").distinct()
    live = files.where(~F.col("state").isin(*DEAD) & (F.col("updated_at") < scan_id)).join(free, "root_id", "left_semi")
    missing = live.join(keys, ["root_id", "sub_id", "ino"], "left_anti").join(unread, ["root_id", "rel_path"], "left_anti")
    vanished = missing.groupBy("root_id").agg(F.count("*").alias("vanished"))
    counted = verdicts.where("blocked is null").join(vanished, "root_id", "left")
    clean = counted.where(may_expire(F.col("errors"), F.coalesce("vanished", F.lit(0)), F.col("known"))).select("root_id")
    old = files.where((F.col("state") == "missing") & (F.col("updated_at") < cutoff)).join(clean, "root_id", "left_semi")
    return {
        "verdicts": verdicts,
        "missing": missing.select("id", F.col("state").alias("prev_state")),
        "gone": old.select("id"),
        "records": verdicts.where("trusted").select("root_id", F.col("seen").alias("seen_before")),
    }


def changed(files: DataFrame, out: dict[str, DataFrame], now: int) -> DataFrame:
    """files after a scan's conclusion."""
    marks = out["missing"].select("id", F.lit("missing").alias("_to")).union(out["gone"].select("id", F.lit("gone").alias("_to")))
    both = files.join(marks, "id", "left")
    hit = F.col("_to").isNotNull()
    put = {"state": F.coalesce("_to", "state"), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    if "prev_state" in files.columns:
        put["prev_state"] = F.when(F.col("_to") == "missing", F.col("state")).otherwise(F.col("prev_state"))
    return both.select(*(put[c].alias(c) if c in put else F.col(c) for c in files.columns))
