"""The status of a catalog: each section is counted where its rows lie and comes out as a few lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import QUEUED, STATES


def _line(df: DataFrame, section: int, place: str, name: str, value: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.expr(place).cast("long").alias("place"), F.expr(name).alias("name"), F.expr(value).cast("string").alias("value"))


def status_lines(files: DataFrame, groups: DataFrame, events: DataFrame, journal: DataFrame, roots: DataFrame, progress: DataFrame, volumes: DataFrame) -> DataFrame:
    """section (1 queue, 2 states, 3 groups and ledger, 4 roots, 5 volumes), place in it, name and value.

    The queue has two halves: files in a queued state that have a time at which they are ready, and those that sleep
    until something wakes them, which are shown only if there are some. States come in their order, without those that no file is in. Open entries of
    the journal are shown only if there are some; a root that was never scanned and a catalog without volumes say so. Of two progress rows of a root
    the greatest phase and folder count. files: state, ready_at; groups: group_id; journal: state; roots: root_id, path, kind; progress: root_id, phase, last_dir;
    volumes: id, mount, backend, error."""
    queued = F.col("state").isin(*QUEUED)
    # At most two rows a state go on from here.
    counts = files.groupBy("state", (queued & F.col("ready_at").isNotNull()).alias("ready"), (queued & F.col("ready_at").isNull()).alias("asleep")).agg(F.count("*").alias("n"))
    totals = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("files", F.col("n")), ("ready", F.when(F.col("ready"), F.col("n"))), ("asleep", F.when(F.col("asleep"), F.col("n"))))))
    order = F.array(*(F.lit(s) for s in STATES))
    states = counts.where("state is not null").groupBy("state").agg(F.sum("n").alias("n")).withColumn("at", F.array_position(order, F.col("state")))
    open_ = journal.where(~F.col("state").isin("done", "aborted")).agg(F.count("*").alias("n")).where("n > 0")
    known = progress.groupBy("root_id").agg(F.max("phase").alias("phase"), F.max("last_dir").alias("last_dir"))
    root = roots.join(known, "root_id", "left")
    none = volumes.agg(F.count("*").alias("n")).where("n = 0")
    parts = [
        _line(totals, 1, "1", "'files'", "files"),
        _line(totals, 1, "2", "'ready'", "ready"),
        _line(totals.where("asleep > 0"), 1, "3", "'asleep'", "asleep"),
        _line(states, 2, "at", "state", "n"),
        _line(groups.agg(F.count_distinct("group_id").alias("n")), 3, "1", "'groups'", "n"),
        _line(events.agg(F.count("*").alias("n")), 3, "2", "'events'", "n"),
        _line(open_, 3, "3", "'open journal'", "n"),
        _line(root, 4, "root_id * 3", "path", "if(kind = 'remote', 'remote, read only', kind)"),
        _line(root, 4, "root_id * 3 + 1", "'phase'", "coalesce(phase, 'not scanned yet')"),
        _line(root.where("last_dir is not null"), 4, "root_id * 3 + 2", "'scanned up to'", "last_dir"),
        _line(volumes, 5, "id * 2", "mount", "backend"),
        _line(volumes.where("error is not null"), 5, "id * 2 + 1", "'error'", "error"),
        _line(none, 5, "0", "'volumes'", "'not probed yet'"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
