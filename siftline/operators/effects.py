"""What a batch of events does to the catalog: each event, together with what stands at its places now, becomes an ordered list of
changes, which are then applied all at once.

No file is marked missing without evidence: a place is looked at again (``stat``), and only where nothing is there its rows vanish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import restore_target
from .admission import MOST, PER_UID, admit
from .filters import in_excluded_dir, reject_reason
from .prefixes import ancestors, deepest, parent

DEAD = ("missing", "gone")
#: The least size that a filter knows; a file whose size is not known yet is not too small.
_ANY = (1 << 63) - 1
_SEEN = ("status", "sub_id", "ino", "size", "uid")
CHANGE = ["seq", "step", "action", "root_id", "path", "from_root_id", "from_path", "sub_id", "ino"]


def rows_under(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(root_id, path, n) of folders: how many catalog rows are at the path or below it, 0 included. Rows are counted by their own folder first, and
    only those counts meet the folders above them."""
    own = files.groupBy("root_id", F.col("rel_path").alias("path")).agg(F.count("*").alias("n"))
    by = files.groupBy("root_id", parent(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("n"))
    below = by.select("root_id", F.explode(ancestors(F.col("dir"))).alias("path"), "n")
    f = folders.select("root_id", "path").distinct()
    met = f.join(own.unionByName(below), ["root_id", "path"]).groupBy("root_id", "path").agg(F.sum("n").alias("n"))
    return f.join(met, ["root_id", "path"], "left").select("root_id", "path", F.coalesce("n", F.lit(0)).alias("n"))


def _at(events: DataFrame, stat: DataFrame, root: str, path: str, name: str) -> DataFrame:
    """Adds ``name``: what stands at a place; a place that was not looked at is to be tried again."""
    s = stat.select(F.col("root_id").alias(root), F.col("path").alias(path), F.struct(*_SEEN).alias(name))
    return events.join(s, [root, path], "left")


def _list(*actions: str) -> Column:
    return F.array(*(F.lit(a) for a in actions)) if actions else F.array().cast("array<string>")


def effects(events: DataFrame, files: DataFrame, stat: DataFrame, excluded: list[str], min_size: int, pending: DataFrame | None = None, most: int = MOST, per_uid: int = PER_UID) -> DataFrame:
    """The changes of events (seq, kind, root_id, path, from_root_id, from_path): CHANGE, by seq and step.

    files: sub_id, ino, root_id, rel_path, state. stat: root_id, path, status (file, folder, gone, ignore, retry), and sub_id, ino, size and uid of
    files, one row for a place. pending: uid and n, what waits already.

    Actions: missing_at and missing_under (a place with nothing at it), rename (a key to a path), rename_prefix, restore (a key whose row was missing),
    upsert, push_ready (a settling row that is written to), walk (a folder), rescan, retry (the event again), error (an event that would empty a
    root). Files beyond the queue's room ask for a rescan instead."""
    e = events.select("seq", "kind", "root_id", "path", "from_root_id", "from_path")
    e = _at(e, stat, "root_id", "path", "to")
    e = _at(e, stat, "from_root_id", "from_path", "source")
    row = files.groupBy("sub_id", "ino").agg(F.min(F.struct("root_id", "rel_path", "state")).alias("row"))
    key = row.select(F.col("sub_id").alias("_s"), F.col("ino").alias("_i"), "row")
    e = e.join(key, (F.col("to.sub_id") == F.col("_s")) & (F.col("to.ino") == F.col("_i")), "left").drop("_s", "_i")
    holders = files.where(~F.col("state").isin(*DEAD)).groupBy("root_id", F.col("rel_path").alias("path")).agg(F.min(F.struct("sub_id", "ino")).alias("holder"))
    e = e.join(holders, ["root_id", "path"], "left")
    moved = e.where(F.col("kind").isin("renamed", "renamed_dir")).select(F.col("from_root_id").alias("root_id"), F.col("from_path").alias("path"))
    n = rows_under(moved, files).select(F.col("root_id").alias("from_root_id"), F.col("path").alias("from_path"), F.col("n").alias("below"))
    e = e.join(n, ["from_root_id", "from_path"], "left")

    shut = F.coalesce(in_excluded_dir(F.col("path"), excluded), F.lit(False))
    status = lambda side: F.coalesce(F.col(f"{side}.status"), F.lit("retry"))
    rejected = reject_reason(F.col("path"), F.col("to.size"), excluded, min_size).isNotNull()
    by_name = reject_reason(F.col("path"), F.lit(_ANY), excluded, min_size).isNotNull()
    known, other = F.col("row").isNotNull(), F.col("holder").isNotNull() & ((F.col("holder.sub_id") != F.col("to.sub_id")) | (F.col("holder.ino") != F.col("to.ino")))
    take = F.when(rejected, _list()).when(~other, _list("upsert")).when(known, _list("rename", "upsert")).otherwise(_list("missing_at", "upsert"))
    look = F.when(shut, _list()).otherwise(_list("walk"))

    def by_status(side: str, file: Column, folder: Column, gone: Column) -> Column:
        s = status(side)
        return F.when(s == "file", file).when(s == "folder", folder).when(s == "gone", gone).when(s == "retry", _list("retry")).otherwise(_list())

    vanish = by_status("to", take, look, _list("missing_at", "missing_under"))
    # At the source of a move: its own file there, if another has come, is told by that file's event.
    source_shut = F.coalesce(in_excluded_dir(F.col("from_path"), excluded), F.lit(False))
    source_gone = by_status("source", _list("upsert_source"), F.when(source_shut, _list()).otherwise(_list("walk_source")), _list("missing_at_source", "missing_under_source"))
    clean = F.when(status("source") == "gone", _list("missing_at_source", "missing_under_source")).otherwise(_list())
    prefix = F.when(F.col("below") > 0, _list("rename_prefix")).otherwise(_list("walk"))
    restored = F.when(F.col("row.state") == "missing", _list("rename", "restore")).otherwise(_list("rename"))
    whole = F.coalesce(F.col("from_path") == "", F.lit(False))
    file_moved = F.when(rejected, source_gone).when(known, F.concat(restored, clean)).otherwise(F.concat(clean, take))
    k, empty = F.col("kind"), F.coalesce(F.col("path") == "", F.lit(False))
    push = known & (F.col("row.state") == "settling") & (F.col("row.root_id") == F.col("root_id")) & (F.col("row.rel_path") == F.col("path"))
    actions = (
        F.when(k == "closed", F.when(by_name, _list()).otherwise(by_status("to", take, _list(), _list())))
        .when(k == "moved_in", F.when(shut, _list()).otherwise(by_status("to", take, look, _list())))
        .when(k == "modified", by_status("to", F.when(push, _list("push_ready")).otherwise(_list()), _list(), _list()))
        .when(k.isin("renamed", "renamed_dir") & whole, _list("error"))
        .when(k.isin("renamed", "renamed_dir") & shut, source_gone)
        .when(k == "renamed", by_status("to", file_moved, prefix, source_gone))
        .when(k == "renamed_dir", prefix)
        .when(k.isin("removed_unknown", "removed", "removed_dir") & empty, _list("error"))
        .when(k == "removed_unknown", vanish)
        .when(k == "removed", _list("missing_at"))
        .when(k == "removed_dir", _list("missing_under"))
        .when(k == "created_dir", look)
        .when(k == "needs_rescan", _list("rescan"))
        .otherwise(_list())
    )
    each = e.select("*", F.posexplode(actions).alias("step", "action"))
    turned = F.col("action").endswith("_source")
    side = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    kept = F.col("action").isin("rename_prefix", "retry")
    out = each.select(
        "seq", "step", F.regexp_replace("action", "_source$", "").alias("action"), side("from_root_id", "root_id").alias("root_id"), side("from_path", "path").alias("path"),
        F.when(kept, F.col("from_root_id")).alias("from_root_id"), F.when(kept, F.col("from_path")).alias("from_path"),
        F.when(F.col("action").isin("rename", "restore", "upsert", "push_ready"), F.col("to.sub_id")).when(F.col("action") == "upsert_source", F.col("source.sub_id")).alias("sub_id"),
        F.when(F.col("action").isin("rename", "restore", "upsert", "push_ready"), F.col("to.ino")).when(F.col("action") == "upsert_source", F.col("source.ino")).alias("ino"),
        F.when(turned, F.col("source.uid")).otherwise(F.col("to.uid")).alias("uid"),
    )
    if pending is None:
        return out.select(CHANGE)
    asked = admit(out.where("action = 'upsert'").select("seq", "uid"), pending, most, per_uid).where("not admitted").select("seq", F.lit(True).alias("_full")).distinct()
    full = out.join(asked, "seq", "left")
    # Its place stays as it is: nothing is marked or moved for a file that is not taken in.
    w = Window.partitionBy("seq").orderBy("step")
    before = F.coalesce(F.lead("action").over(w) == "upsert", F.lit(False)) & F.col("action").isin("missing_at", "rename")
    full = full.withColumn("_before", before).where(F.col("_full").isNull() | ~F.col("_before"))
    return full.withColumn("action", F.when(F.col("_full").isNotNull() & (F.col("action") == "upsert"), "rescan").otherwise(F.col("action"))).select(CHANGE)


def apply_changes(files: DataFrame, changes: DataFrame, stat: DataFrame, now: int, settle_ms: int) -> DataFrame:
    """files (sub_id, ino, root_id, rel_path, size, state, prev_state, ready_at, updated_at) after the changes of a batch.

    Moves come first, then what vanishes, then what comes in: a later event of a key or a place wins over an earlier one. A row that another file
    is moved onto vanishes."""
    last = lambda rows, keys, *values: rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("seq", "step")).alias("_v"))
    act = lambda *names: changes.where(F.col("action").isin(*names))
    columns = files.columns

    moves = last(act("rename"), ["sub_id", "ino"], "root_id", "path")
    f = files.join(moves, ["sub_id", "ino"], "left")
    f = f.withColumn("_moved", F.col("_v").isNotNull()).withColumn("root_id", F.coalesce("_v.root_id", "root_id")).withColumn("rel_path", F.coalesce("_v.path", "rel_path")).drop("_v")
    targets = moves.select("_v.root_id", F.col("_v.path").alias("rel_path"), F.lit(True).alias("_target")).distinct()
    f = f.join(targets, ["root_id", "rel_path"], "left").withColumn("_over", F.col("_target").isNotNull() & ~F.col("_moved")).drop("_target")

    folders = last(act("rename_prefix"), ["from_root_id", "from_path"], "root_id", "path")
    folders = folders.select(F.col("from_root_id").alias("root_id"), F.col("from_path").alias("_old"), F.col("_v").alias("_new")).withColumn("_from", F.col("_old"))
    f = deepest(f, "rel_path", folders, "_old", ("root_id",))
    rest = F.substring(F.col("rel_path"), F.length("_from") + F.when(F.col("_from") == "", 1).otherwise(2), F.length("rel_path"))
    joined = F.when(rest == "", F.col("_new.path")).when(F.col("_new.path") == "", rest).otherwise(F.concat(F.col("_new.path"), F.lit("/"), rest))
    hit = F.col("_new").isNotNull() & ~F.col("_moved")
    f = f.withColumn("_path", F.when(hit, joined).otherwise(F.col("rel_path"))).withColumn("_root", F.when(hit, F.col("_new.root_id")).otherwise(F.col("root_id")))
    f = f.drop("rel_path", "root_id", "_new", "_from").withColumnRenamed("_path", "rel_path").withColumnRenamed("_root", "root_id")

    at = act("missing_at").select("root_id", F.col("path").alias("rel_path"), F.lit(True).alias("_here")).distinct()
    f = f.join(at, ["root_id", "rel_path"], "left")
    under = act("missing_under").select("root_id", F.col("path").alias("_folder"), F.lit(True).alias("_below")).distinct()
    f = deepest(f, "rel_path", under, "_folder", ("root_id",))
    gone = (F.col("_here").isNotNull() | F.col("_below").isNotNull()) & ~F.col("_moved") | F.col("_over")
    gone &= ~F.col("state").isin(*DEAD)
    restored = act("restore").select("sub_id", "ino", F.lit(True).alias("_restore")).distinct()
    pushed = act("push_ready").select("sub_id", "ino", F.lit(True).alias("_push")).distinct()
    f = f.join(restored, ["sub_id", "ino"], "left").join(pushed, ["sub_id", "ino"], "left")
    state = F.when(gone, "missing").when(F.col("_restore") & (F.col("state") == "missing"), restore_target(F.col("prev_state"))).otherwise(F.col("state"))
    f = f.select(
        "sub_id", "ino", "root_id", "rel_path", "size", state.alias("state"), F.when(gone, F.col("state")).otherwise(F.col("prev_state")).alias("prev_state"),
        F.when(F.col("_push"), now + settle_ms).when(~gone, F.col("ready_at")).alias("ready_at"), F.when(gone | F.col("_moved") | F.col("_restore") | F.col("_push"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )

    new = last(act("upsert"), ["sub_id", "ino"], "root_id", "path").select("sub_id", "ino", F.col("_v.root_id").alias("_root"), F.col("_v.path").alias("_path"))
    sizes = stat.where("status = 'file'").groupBy("sub_id", "ino").agg(F.min("size").alias("_size"))
    new = new.join(sizes, ["sub_id", "ino"], "left").withColumn("_new", F.lit(True))
    both = f.join(new, ["sub_id", "ino"], "full")
    fresh = F.col("_new").isNotNull()
    stays = F.coalesce(F.col("size") == F.col("_size"), F.lit(False)) & F.col("state").isNotNull() & (F.col("state") != "missing")
    put = {
        "root_id": F.coalesce("_root", "root_id"), "rel_path": F.coalesce("_path", "rel_path"), "size": F.when(fresh, F.col("_size")).otherwise(F.col("size")),
        "state": F.when(fresh & ~stays, "settling").otherwise(F.col("state")), "prev_state": F.when(fresh & ~stays, F.col("state")).otherwise(F.col("prev_state")),
        "ready_at": F.when(fresh & ~stays, now + settle_ms).otherwise(F.col("ready_at")), "updated_at": F.when(fresh, now).otherwise(F.col("updated_at")),
    }
    return both.select(*(put[c].alias(c) if c in put else F.col(c) for c in columns))
