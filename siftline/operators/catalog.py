"""Catalog changes: each takes a snapshot and gives the next; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import restore_target, rewrite_prefix, same_fingerprint, under_dir
from ..schema import QUEUED


def upsert_pending(files: DataFrame, seen: DataFrame, kinds: DataFrame, now: int) -> DataFrame:
    """The decision for every seen file (sub_id, ino, root_id, rel_path, size, mtime_ns, ctime_ns, ready_at, priority).

    Several sightings of one key are folded first: the last ready_at and its identity, the least priority. The stored
    size and times stay those of the content last processed."""
    last = F.max(F.struct("ready_at", "rel_path", "root_id", "size", "mtime_ns", "ctime_ns")).alias("x")
    one = seen.groupBy("sub_id", "ino").agg(last, F.min("priority").alias("in_priority"))
    one = one.select("sub_id", "ino", "in_priority", *(F.col(f"x.{c}").alias(f"in_{c}") for c in ("ready_at", "rel_path", "root_id", "size", "mtime_ns", "ctime_ns")))
    old = files.select("sub_id", "ino", "id", "size", "mtime_ns", "ctime_ns", "state", "prev_state", "ready_at", "priority", "attempts", "skip_reason", "group_id")
    both = one.join(old, ["sub_id", "ino"], "left").join(F.broadcast(kinds.select(F.col("root_id").alias("in_root_id"), "kind")), "in_root_id")
    new, same = F.col("id").isNull(), same_fingerprint("", "in_", F.col("kind"))
    missing, undo = F.col("state") == "missing", F.coalesce(F.col("skip_reason") == "user_undo", F.lit(False)) & (F.col("state") == "skipped")
    queued = F.col("state").isin(*QUEUED)
    state = F.when(new, "settling").when(missing & same, restore_target(F.col("prev_state"))).when(same | undo, F.col("state")).otherwise("settling")
    restored = restore_target(F.col("prev_state")).isin(*QUEUED)
    ready = F.when(new, F.col("in_ready_at")).when(missing & same, F.when(restored, F.col("in_ready_at"))).when(same & ~queued, F.col("ready_at")).otherwise(F.col("in_ready_at"))
    prev = F.when(new, None).when((missing & same) | queued, F.col("prev_state")).otherwise(F.when(same | undo, F.col("prev_state")).otherwise(F.col("state")))
    return both.select(
        "sub_id",
        "ino",
        state.alias("state"),
        prev.alias("prev_state"),
        ready.alias("ready_at"),
        F.least("in_priority", "priority").alias("priority"),
        F.when(~new & same, F.col("attempts")).otherwise(0).alias("attempts"),
        F.when(~new & (same | undo), F.col("skip_reason")).alias("skip_reason"),
        F.when(~new & same, F.col("group_id")).alias("group_id"),
        F.col("in_rel_path").alias("rel_path"),
        F.lit(now).alias("updated_at"),
        (~state.isin(*QUEUED)).alias("dropped"),
    )


def mark_missing(files: DataFrame, where: Column, now: int) -> DataFrame:
    """The rows that vanish: live ones where ``where`` holds."""
    gone = files.where(where & ~F.col("state").isin("missing", "gone"))
    return gone.select("id", F.lit("missing").alias("state"), F.col("state").alias("prev_state"), F.lit(now).alias("updated_at"))


def rename_prefix(files: DataFrame, root: int, old: str, new: str) -> DataFrame:
    moved = files.where((F.col("root_id") == root) & under_dir(F.col("rel_path"), old))
    return moved.select("id", rewrite_prefix(F.col("rel_path"), old, new).alias("rel_path"))


def rename_over(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows at the target of a move (sub_id, ino, root_id, rel_path) that have another key: they go missing."""
    m = moves.select(F.col("sub_id").alias("s"), F.col("ino").alias("i"), "root_id", "rel_path")
    return files.join(m, ["root_id", "rel_path"]).where("not (sub_id = s and ino = i) and state not in ('missing', 'gone')").select("id", "rel_path")


def rename(files: DataFrame, moves: DataFrame) -> DataFrame:
    """The rows that move (sub_id, ino, root_id, rel_path: where to), at their new place; a key without a row is left out."""
    to = moves.select("sub_id", "ino", F.col("root_id").alias("new_root"), F.col("rel_path").alias("new_path"))
    return files.join(to, ["sub_id", "ino"]).select("id", F.col("new_path").alias("rel_path"), F.col("new_root").alias("root_id"))


def mark_missing_at(files: DataFrame, places: DataFrame, now: int) -> DataFrame:
    """All live rows at places (root_id, rel_path) vanish."""
    return mark_missing(files.join(places.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"], "left_semi"), F.lit(True), now)


def restore_or_reset(files: DataFrame, seen: DataFrame, kinds: DataFrame, now: int) -> DataFrame:
    """Missing rows that are seen again (as for ``upsert_pending``): restored if nothing changed, else queued anew."""
    gone = files.where("state = 'missing'")
    again = seen.join(gone.select("sub_id", "ino"), ["sub_id", "ino"], "left_semi").withColumn("ready_at", F.lit(now)).withColumn("priority", F.lit(0))
    return gone.select("id", "sub_id", "ino").join(upsert_pending(gone, again, kinds, now), ["sub_id", "ino"])


def apply_cas(files: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Transitions (id, from, to, set_group, group_id): applied where the state is still ``from``, else raced."""
    c = changes.withColumnRenamed("group_id", "new_group")
    won = F.coalesce(F.col("state") == F.col("from"), F.lit(False))
    out = c.join(files.select("id", "state", "group_id"), "id", "left")
    return out.select("id", F.when(won, F.col("to")).otherwise(F.col("state")).alias("state"), F.when(won & F.col("set_group"), F.col("new_group")).otherwise(F.col("group_id")).alias("group_id"), F.when(won, None).otherwise("state_raced").alias("note"), F.lit(now).alias("ts"))


def purge(files: DataFrame, cutoff: int) -> DataFrame:
    return files.where(~((F.col("state") == "gone") & (F.col("updated_at") < cutoff)))


def presence(files: DataFrame, seen: DataFrame, root: int, scan_id: int) -> DataFrame:
    """Live rows of a root, not touched since the scan began, that it did not see."""
    live = files.where((F.col("root_id") == root) & ~F.col("state").isin("missing", "gone") & (F.col("updated_at") < scan_id))
    return live.join(seen, ["sub_id", "ino"], "left_anti").select("id", F.col("state").alias("prev_state"))


def presence_guard(files: DataFrame, seen: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each root whether a scan may conclude: something was seen, and 90 % (75 % if remote) of what is known."""
    known = files.where("state <> 'gone'").groupBy("root_id").agg(F.count("*").alias("known"))
    got = seen.groupBy("root_id").agg(F.count_distinct("sub_id", "ino").alias("seen"))
    out = kinds.select("root_id", "kind").join(known, "root_id", "left").join(got, "root_id", "left").fillna(0, ["known", "seen"])
    least = F.when(F.col("kind") == "remote", 75).otherwise(90)
    return out.select("root_id", "known", "seen", ((F.col("seen") > 0) & (F.col("seen") * 100 >= F.col("known") * least)).alias("conclusive"))


def next_ready(files: DataFrame, now: int, n: int, most_wait_ms: int, heavy: bool = False) -> DataFrame:
    """The first n files of the queue that may be worked on: heavy work waits for its hours, but not longer than most_wait_ms."""
    light = F.col("state").isin("settling", "sized") | (F.col("heavy_wait_since") <= now - most_wait_ms)
    ready = files.where(F.col("state").isin(*QUEUED) & (F.col("ready_at") <= now))
    return (ready if heavy else ready.where(light)).orderBy("priority", "ready_at", "id").limit(n)


def expire(files: DataFrame, cutoff: int) -> DataFrame:
    """Missing rows that were not touched since the cutoff become gone; the guards come first."""
    return files.where((F.col("state") == "missing") & (F.col("updated_at") < cutoff)).select("id", F.lit("gone").alias("state"))


def park(files: DataFrame, now: int) -> DataFrame:
    """Hashed rows: those that wait are parked, parked ones are ready now."""
    none = F.col("ready_at").isNull()
    return files.where("state = 'hashed'").select("id", F.when(none, "unparked").otherwise("parked").alias("change"), F.when(none, F.lit(now)).alias("ready_at"))


def verified_under(files: DataFrame, folders: list[str]) -> DataFrame:
    """Verified rows under any of the folders, to be queued again."""
    under = F.lit(False)
    for f in folders:
        under |= under_dir(F.col("rel_path"), f)
    return files.where((F.col("state") == "verified") & under)


def unskip(files: DataFrame, now: int) -> DataFrame:
    """Rows with a reason to be skipped lose it; skipped ones settle anew."""
    skipped = F.col("state") == "skipped"
    ready = F.when(skipped, F.lit(now)).otherwise(F.col("ready_at"))
    return files.where("skip_reason is not null and state <> 'gone'").select("id", F.when(skipped, "settling").otherwise(F.col("state")).alias("state"), ready.alias("ready_at"))


def phase_b(files: DataFrame, root: int, now: int) -> DataFrame:
    """Sized rows of a root that wait for the end of its scan: those with a peer of their domain and size are woken, the
    others are distinct."""
    n = files.where("state not in ('missing', 'gone')").groupBy("domain_id", "size").agg(F.count("*").alias("n"))
    f = files.where((F.col("state") == "sized") & F.col("ready_at").isNull() & (F.col("root_id") == root)).join(n, ["domain_id", "size"])
    return f.select("id", F.when(F.col("n") > 1, None).otherwise("distinct").alias("state"), F.when(F.col("n") > 1, now).alias("ready_at"))
