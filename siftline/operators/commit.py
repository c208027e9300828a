"""Transitions as one commit over files, groups, journal and ledger.

A batch is checked before anything is written: one that names a journal entry, a group or a file that is not there is refused as a
whole. What it changes follows from the snapshot alone, so that all four tables can be published at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.publish import current, publish
from . import groups as G

#: Columns of files that a patch may set, with their types.
PATCH = {
    "ready_at": "long", "priority": "int", "attempts": "int", "last_error": "string", "skip_reason": "string", "sparse_hash": "string",
    "group_id": "long", "prev_state": "string", "heavy_wait_since": "long",
}
TABLES = ("files", "groups", "journal", "events")


class Refused(ValueError):
    """A batch that names what is not there."""


def faults(files: DataFrame, groups: DataFrame, journal: DataFrame, batch: DataFrame) -> DataFrame:
    """(seq, fault) of what a batch names and the snapshot lacks.

    batch: seq, id, from, to, patch (map of texts; a key that is there sets its column, to null if its value is), others (array of id, from, to,
    patch), op (struct kind, group_id, other_id, hash, or null), event (struct of the ledger's columns but note, or null), journal_id and
    journal_state."""
    lacks = lambda rows, column, known, id_, what: rows.join(known.select(F.col(id_).alias(column)).distinct(), column, "left_anti").select("seq", F.lit(what).alias("fault"))
    ops = batch.where("op is not null").select("seq", "id", "op.*")
    made = ops.where(F.col("kind") == G.CREATE)
    return (
        lacks(batch.where("journal_id is not null"), "journal_id", journal, "id", "no journal entry")
        .union(lacks(made, "id", files, "id", "no file for the group"))
        .union(lacks(made.select("seq", "other_id"), "other_id", files, "id", "no file for the group"))
        .union(lacks(ops.where(F.col("kind") != G.CREATE).select("seq", "group_id"), "group_id", groups, "id", "no group"))
        .distinct()
    )


def _patched(moved: Column, patch: Column) -> list[Column]:
    """The patch's columns of a file that moves; a changed state ends the wait for heavy hours unless the patch sets it."""
    out = []
    for c, kind in PATCH.items():
        old = F.when(moved & (F.col("from") != F.col("to")), None).otherwise(F.col(c)) if c == "heavy_wait_since" else F.col(c)
        out.append(F.when(moved & F.coalesce(F.map_contains_key(patch, c), F.lit(False)), F.try_element_at(patch, F.lit(c)).cast(kind)).otherwise(old).alias(c))
    return out


def apply(files: DataFrame, groups: DataFrame, journal: DataFrame, events: DataFrame, batch: DataFrame, now: int) -> dict[str, DataFrame]:
    """The four tables after a batch that has no faults (see ``faults``), and ``outcome`` (seq, applied).

    A transition is applied if its file still is in ``from``; of several of one file in a batch the first by seq is, the others find
    another state. With it go its group operation and its others, each of these only if its own file still is in its ``from``. An event is
    written either way, with the note state_raced if the transition was not applied, and so is the journal's state. A file that has a transition of
    its own is nobody's other."""
    first = batch.groupBy("id").agg(F.min("seq").alias("seq"))
    own = batch.join(first, ["id", "seq"], "left_semi").select("seq", "id", "from", "to", "patch")
    won = own.join(files.select("id", "state"), "id").where("state = from").select("seq", "id", "from", "to", "patch")
    beside = batch.join(won.select("seq"), "seq", "left_semi").select("seq", F.explode("others").alias("o")).select("seq", "o.*")
    beside = beside.join(own.select("id"), "id", "left_anti")
    beside = beside.groupBy("id").agg(F.min_by(F.struct("seq", "from", "to", "patch"), "seq").alias("m")).select("m.seq", "id", "m.from", "m.to", "m.patch")
    moves = won.unionByName(beside)
    ops = batch.join(won.select("seq"), "seq", "left_semi").where("op is not null").select("seq", "op.kind", F.when(F.col("op.kind") == G.CANONICAL, F.col("op.other_id")).otherwise(F.col("id")).alias("file_id"), "op.other_id", "op.group_id", "op.hash")
    both = files.join(moves.select("id", "from", "to", "patch"), "id", "left")
    moved = F.coalesce(F.col("state") == F.col("from"), F.lit(False))
    changed = {"state": F.when(moved, F.col("to")).otherwise(F.col("state")), "updated_at": F.when(moved, F.lit(now)).otherwise(F.col("updated_at"))}
    patched = dict(zip(PATCH, _patched(moved, F.col("patch")), strict=True))
    new_files = both.select(*(changed[c].alias(c) if c in changed else patched.get(c, F.col(c)) for c in files.columns))
    outcome = batch.select("seq").join(won.select("seq", F.lit(True).alias("applied")), "seq", "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    told = batch.where("event is not null").select("seq", "event.*").join(outcome, "seq")
    told = told.withColumn("note", F.when(~F.col("applied"), "state_raced"))
    marks = batch.where("journal_id is not null").groupBy(F.col("journal_id").alias("id")).agg(F.max_by("journal_state", "seq").alias("next"))
    entry = {"state": F.coalesce("next", "state"), "updated_at": F.when(F.col("next").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))}
    return {
        "files": G.member_groups(new_files, ops).select(files.columns),
        "groups": G.group_rows(files, groups, ops, now).select(groups.columns),
        "journal": journal.join(marks, "id", "left").select(*(entry[c].alias(c) if c in entry else F.col(c) for c in journal.columns)),
        "events": events.unionByName(told.select(events.columns)),
        "outcome": outcome,
    }


def commit(path: str, batch: DataFrame, now: int) -> int:
    """Applies a batch to the snapshot published last at ``path`` and publishes the next, all tables or none; returns its number. A batch with
    faults raises Refused and leaves the snapshot as it is; of two commits at once the second fails and may be tried again."""
    spark = batch.sparkSession
    files, groups, journal, events = (current(spark, path, t) for t in TABLES)
    wrong = faults(files, groups, journal, batch).orderBy("seq").limit(20).collect()
    if wrong:
        raise Refused("; ".join(f"transition {r.seq}: {r.fault}" for r in wrong))
    out = apply(files, groups, journal, events, batch, now)
    return publish({t: out[t] for t in TABLES}, path)
