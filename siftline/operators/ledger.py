"""The ledger, the journal and other rows of upkeep: each takes snapshots and gives the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(events: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with new events (the same columns and extra); note and extra are joined by a bar."""
    note = F.when(F.col("note").isNull() & F.col("extra").isNull(), None).otherwise(F.concat_ws(" | ", "note", "extra"))
    return events.unionByName(new.withColumn("note", note).drop("extra"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One whole row for each key, the last by ``order``: upserts of progress, settings and notes."""
    value = F.struct(order, *(c for c in rows.columns if c not in (*key, order)))
    return rows.groupBy(*key).agg(F.max_by(value, F.col(order)).alias("v")).select(*key, *(F.col(f"v.`{c}`").alias(c) for c in rows.columns if c not in key))


def open_journal(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """Entries (id, state, seq) after updates (id, state, seq) that are neither done nor aborted; updates of unknown
    ids come out with known = false."""
    known = entries.select("id").distinct().withColumn("known", F.lit(True))
    rows = latest(entries.select("id", "state", "seq").union(updates.select("id", "state", "seq")), ["id"], "seq")
    out = rows.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return out.where(~F.col("known") | ~F.col("state").isin("done", "aborted"))


def purge(files: DataFrame, groups: DataFrame, events: DataFrame, files_before: int, events_before: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, groups and events that stay: gone files and events older than their limits go, and groups whose canonical
    file goes have none (canonical_id null)."""
    old = (F.col("state") == "gone") & (F.col("updated_at") < files_before)
    dead = files.where(old).select(F.col("id").alias("canonical_id"), F.lit(True).alias("dead"))
    left = groups.join(dead, "canonical_id", "left").withColumn("canonical_id", F.when(F.col("dead").isNull(), F.col("canonical_id")))
    return files.where(~F.coalesce(old, F.lit(False))), left.select(*groups.columns), events.where(F.col("ts") >= events_before)


def rebuild(files: DataFrame, groups: DataFrame, notes: DataFrame, progress: DataFrame) -> DataFrame:
    """How many rows go when the cache is built anew: ledger and journal stay."""
    parts = [t.select(F.lit(n).alias("what")) for n, t in (("files", files), ("groups", groups), ("notes", notes), ("progress", progress))]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.groupBy("what").agg(F.count("*").alias("n"))


def page(groups: DataFrame, after: tuple[int, int] | None, size: int = 50, most: int = 200) -> DataFrame:
    """The next page of groups (reclaimable, group_id) by falling reclaimable and id, after the last row of the one before,
    with one row more that tells whether another follows."""
    if after:
        groups = groups.where((F.col("reclaimable") < after[0]) | ((F.col("reclaimable") == after[0]) & (F.col("group_id") < after[1])))
    return groups.orderBy(F.desc("reclaimable"), F.desc("group_id")).limit(min(size, most) + 1)


def retries(events: DataFrame, now: int, wait_ms: int = 1000, most: int = 5, room: int = 10_000) -> DataFrame:
    """seq and what becomes of each event that failed for now (root_id, attempts, failed_at): again, later, given_up (tried too often; a later
    scan finds it), or rescan (beyond the room of its root's queue, first come first served). Each task keeps the first of a root before they are shuffled, so that a root
    with very many events does not meet in one."""
    tried = F.col("attempts") >= most
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("failed_at", "seq"))
    kept = events.where(~tried).select("root_id", "failed_at", "seq").withColumn("place", place).where(F.col("place") <= room).select("seq", F.lit(True).alias("kept"))
    to = F.when(tried, "given_up").when(F.col("kept").isNull(), "rescan").when(F.col("failed_at") + wait_ms <= now, "again").otherwise("later")
    return events.join(kept, "seq", "left").select("seq", to.alias("action"))


def clear_rescan(flags: DataFrame, scans: DataFrame) -> DataFrame:
    """root_id, generation and pending: a wish for a rescan is met only by a scan that began after the last wish."""
    begun = scans.groupBy("root_id").agg(F.max("generation").alias("begun"))
    out = flags.join(begun, "root_id", "left")
    return out.select("root_id", "generation", (F.col("generation") > 0).__and__(F.coalesce(F.col("begun") != F.col("generation"), F.lit(True))).alias("pending"))


def walk_queue(folders: DataFrame, room: int = 4096) -> DataFrame:
    """What to walk next of queued folders (root_id, dir): root_id, n_dirs, whole (more folders than there is room for: the
    root as a whole) and dir (the folders otherwise, one row each)."""
    each = folders.select("root_id", "dir").distinct()
    n = each.groupBy("root_id").agg(F.count("*").alias("n_dirs"))
    some = n.where(F.col("n_dirs") <= room).join(each, "root_id").select("root_id", "n_dirs", F.lit(False).alias("whole"), "dir")
    return some.union(n.where(F.col("n_dirs") > room).select("root_id", "n_dirs", F.lit(True).alias("whole"), F.lit("").alias("dir")))


def upsert_roots(roots: DataFrame, listed: DataFrame) -> DataFrame:
    """root_id, path, kind, label and active after the configuration lists roots (path, kind, label).

    A path that is known keeps its id and takes the new kind and label (a missing label leaves the old one); new paths get the ids that follow, in
    order of their paths. Roots that are not listed any more stay, inactive, since files still name them. Of paths listed twice the least kind counts."""
    new = listed.groupBy("path").agg(F.min(F.struct("kind", "label")).alias("n"))
    both = roots.select("root_id", "path", "kind", "label").join(new, "path", "full")
    most = roots.agg(F.max("root_id")).first()[0] or 0
    fresh = F.col("root_id").isNull()
    place = F.sum(fresh.cast("long")).over(Window.orderBy("path"))  # configured roots are few
    out = both.withColumn("place", place)
    id_ = F.when(fresh, most + F.col("place")).otherwise(F.col("root_id")).cast("long")
    return out.select(id_.alias("root_id"), "path", F.coalesce("n.kind", "kind").alias("kind"), F.coalesce("n.label", "label").alias("label"), F.col("n").isNotNull().alias("active"))
