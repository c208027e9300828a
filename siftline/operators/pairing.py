"""Raw changes of a tree as events: places in roots, and halves of renames paired by their tracker.

A half is (seq, ts_ms, tracker, mode from|to|both, root_id, path, to_root_id, to_path, folder): ``from`` has its place in root_id and
path, ``to`` in to_root_id and to_path, ``both`` in all four; a place outside of all roots has no root_id. folder: whether a folder stands where
it went, as seen when the half was read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import let_workers_import
from .prefixes import deepest

HALF = ["tracker", "ts_ms", "seq", "mode", "root_id", "path", "to_root_id", "to_path", "folder"]
EVENT = "at_ms long, seq long, kind string, root_id long, path string, from_root_id long, from_path string"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def _place(rows: DataFrame, roots: DataFrame, column: str, id_: str, out: str) -> DataFrame:
    """Adds id_ and out: the deepest root (root_id, path) that holds an absolute path, and the path in it; both null outside."""
    own = roots.select(F.col("root_id").alias(id_), F.rtrim(F.col("path"), F.lit("/")).alias("_root")).withColumn("_at", F.col("_root"))
    found = deepest(rows, column, own, "_at")
    path = F.when(F.col(id_).isNotNull(), F.substring(F.col(column), F.length("_root") + 2, F.length(column)))
    return found.withColumn(out, path).drop("_root")


def located(raw: DataFrame, roots: DataFrame) -> DataFrame:
    """raw (seq, ts_ms, raw, folder, tracker, path, to_path; paths absolute) with root_id, rel, to_root_id and to_rel."""
    one = _place(raw, roots, "path", "root_id", "rel")
    return _place(one, roots, "to_path", "to_root_id", "to_rel")


def halves(placed: DataFrame) -> DataFrame:
    """The halves of renames among located changes; those without a tracker are no halves."""
    to = F.col("raw") == "to"
    side = lambda a, b: F.when(~to, F.col(a)).alias(b)
    target = lambda a, b, c: F.when(to, F.col(a)).when(F.col("raw") == "both", F.col(b)).alias(c)
    rows = placed.where(F.col("raw").isin("from", "to", "both") & F.col("tracker").isNotNull())
    return rows.select("tracker", "ts_ms", "seq", F.col("raw").alias("mode"), side("root_id", "root_id"), side("rel", "path"), target("root_id", "to_root_id", "to_root_id"), target("rel", "to_rel", "to_path"), "folder")


def direct(placed: DataFrame) -> DataFrame:
    """Events of located changes that are no halves: at_ms, seq, kind, root_id, path, from_root_id, from_path.

    Reading says nothing, and what lies outside of all roots is left out. A root that is removed or moved itself, or an overflow, asks for a
    rescan: it is never taken for the removal of all its files. Moves without a tracker of anything but a root are told by
    the halves of the folder above."""
    r, root = F.col("raw"), F.col("root_id").isNotNull() & (F.col("rel") == "")
    gone = r.startswith("delete") | ((r == "from") & F.col("tracker").isNull())
    kind = (
        F.when((r == "overflow") | (gone & root), "needs_rescan")
        .when(F.col("root_id").isNull(), None)
        .when(r == "create", F.when(F.col("folder"), "created_dir").otherwise("closed"))
        .when(r == "close_write", "closed")
        .when(r.isin("modify", "attributes"), "modified")
        .when(r == "delete", F.when(F.col("folder").isNull(), "removed_unknown").when(F.col("folder"), "removed_dir").otherwise("removed"))
    )
    none = F.lit(None)
    at = lambda c, kind_: F.when(F.col("kind") != "needs_rescan", F.col(c)).cast(kind_)
    rows = placed.withColumn("kind", kind).where("kind is not null")
    return rows.select(F.col("ts_ms").alias("at_ms"), "seq", "kind", at("root_id", "long").alias("root_id"), at("rel", "string").alias("path"), none.cast("long").alias("from_root_id"), none.cast("string").alias("from_path"))


def _moved(ts: int, seq: int, source: tuple | None, target: tuple | None, folder: bool) -> tuple | None:
    """The event of a whole move; a side outside of all roots is None."""
    if source and target:
        return (ts, seq, "renamed_dir" if folder else "renamed", *target, *source)
    if target:
        return (ts, seq, "created_dir" if folder else "moved_in", *target, None, None)
    return (ts, seq, "removed_dir" if folder else "removed", *source, None, None) if source else None


def lone(state: dict) -> tuple:
    """The event of a first half whose wait is over: nobody knows what it was."""
    ts, seq, root, path = state.pop("wait")
    return (ts, seq, "removed_unknown", root, path, None, None)


def overdue(state: dict, now: int, window_ms: int) -> bool:
    return "wait" in state and now - state["wait"][0] > window_ms


def pair(state: dict, half: tuple, window_ms: int) -> list[tuple]:
    """Events of one more half (as HALF, without the tracker) of a tracker. state: ``wait``, a first half that waits, and
    ``paired``, when this tracker was paired, both forgotten after the window. A second half that comes too late does not find the first; a ``both``
    only confirms what was paired, and tells of the move where it was not."""
    ts, seq, mode, root, path, to_root, to_path, folder = half
    out = [lone(state)] if overdue(state, ts, window_ms) else []
    if "paired" in state and ts - state["paired"] > window_ms:
        del state["paired"]
    source, target = (root, path) if root is not None else None, (to_root, to_path) if to_root is not None else None
    if mode == "from":
        if source:
            state["wait"] = [ts, seq, *source]
        return out
    if mode == "to":
        if "wait" in state:
            source = tuple(state.pop("wait")[2:])
            state["paired"] = ts
        else:
            source = None
    elif "paired" in state:
        return out
    else:
        state.pop("wait", None)
    moved = _moved(ts, seq, source, target, bool(folder))
    return [*out, moved] if moved else out


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


def _fold(window_ms: int, now: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, state = None, {}
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                if row[0] != tracker:
                    out += [lone(state)] if "wait" in state and (now is None or overdue(state, now, window_ms)) else []
                    tracker, state = row[0], {}
                ids = [x if x is None else int(x) for x in (row[4], row[6])]
                out += pair(state, (int(row[1]), int(row[2]), row[3], ids[0], row[5], ids[1], row[7], row[8]), window_ms)
            yield frame(out, _COLUMNS)
        if "wait" in state and (now is None or overdue(state, now, window_ms)):
            yield frame([lone(state)], _COLUMNS)

    return run


def pair_halves(rows: DataFrame, window_ms: int = 2000, now: int | None = None) -> DataFrame:
    """Events of halves (HALF), in the order of ts_ms and seq for each tracker; a first half that waits at the end is removed_unknown
    if its wait is over at ``now``, or at any time without it. Trackers are the kernel's and stand for one move each, so a task reads its trackers
    one after the other with the state of one."""
    let_workers_import(rows.sparkSession)
    whole = rows.select("tracker", F.col("ts_ms").cast("long"), F.col("seq").cast("long"), "mode", F.col("root_id").cast("long"), "path", F.col("to_root_id").cast("long"), "to_path", "folder")
    return whole.where("tracker is not null").repartition("tracker").sortWithinPartitions("tracker", "ts_ms", "seq").mapInPandas(_fold(window_ms, now), EVENT)


def translate(raw: DataFrame, roots: DataFrame, window_ms: int = 2000, now: int | None = None) -> DataFrame:
    """All events of raw changes: at_ms, seq, kind, root_id, path, from_root_id, from_path."""
    placed = located(raw, roots)
    return direct(placed).unionByName(pair_halves(halves(placed), window_ms, now))


def is_move(kind: Column) -> Column:
    return kind.isin("renamed", "renamed_dir")
