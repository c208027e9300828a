"""Events of one place within a window, coalesced by what they mean.

The first event of a place opens an entry, which takes the events of the next ``window_ms`` milliseconds. In an entry an event of
the same kind takes the place of the last one; a mere change (``modified``) gives way to any other and never takes its
place; a rename and the removal of a folder are never lost to an event of their own kind, since they carry a second path or
stand for many files. An entry holds at most MOST events: beyond it the last gives way."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import let_workers_import

# Fixed values.
WEAK = "modified"
OWN = ("renamed", "renamed_dir", "removed_dir")
MOST = 8

PLACE = ["root_id", "path"]
OUTPUT = "root_id long, path string, first_ms long, place int, kind string, from_path string, seq long, absorbed long"


def take(kept: list, event: tuple) -> None:
    """Adds an event (kind first) to what an entry has kept, in place."""
    kind = event[0]
    if not kept:
        kept.append(event)
        return
    last = kept[-1][0]
    if kind == WEAK != last:
        return
    if last == WEAK or (kind == last and last not in OWN) or len(kept) >= MOST:
        kept[-1] = event
    else:
        kept.append(event)


def _starts(window_ms: int):
    """Where entries begin, by buckets of the window's length: from one begin the next one is at least a window away, so a
    bucket has one at most. start: in this bucket; before: the last one before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, last = None, None
        for batch in batches:
            start, before = [], []
            for key, times in zip(zip(batch["root_id"], batch["path"], batch["island"], strict=True), batch["times"], strict=True):
                if key != island:
                    island, last = key, None
                k = 0 if last is None else bisect_left(times, last + window_ms)
                before.append(last)
                start.append(int(times[k]) if k < len(times) else None)
                last = last if start[-1] is None else start[-1]
            out = batch[["root_id", "path", "bucket"]].copy()
            out["start"], out["before"] = pd.array(start, dtype="Int64"), pd.array(before, dtype="Int64")
            yield out

    return run


def entry_starts(events: DataFrame, window_ms: int) -> DataFrame:
    """root_id, path, bucket, start and before of each place (see ``_starts``).

    Events are first reduced to the distinct milliseconds of each bucket, so that a place with very many events costs no more than the time
    it spans; where events lie a window apart the chain starts anew, and only buckets that hang together are walked in order."""
    times = events.groupBy(*PLACE, "bucket").agg(F.sort_array(F.collect_set("ts_ms")).alias("times"))
    w = Window.partitionBy(*PLACE).orderBy("bucket")
    first, last = F.element_at("times", 1), F.element_at("times", -1)
    times = times.withColumn("cut", F.coalesce(first - F.lag(last).over(w) >= window_ms, F.lit(True)))
    times = times.withColumn("alone", F.col("cut") & F.coalesce(F.lead("cut").over(w), F.lit(True))).withColumn("island", F.sum(F.col("cut").cast("int")).over(w))
    none = F.lit(None).cast("long")
    lone = times.where("alone").select(*PLACE, "bucket", first.alias("start"), none.alias("before"))
    chained = times.where("not alone").select(*PLACE, "island", "bucket", "times").repartition(*PLACE, "island").sortWithinPartitions(*PLACE, "island", "bucket")
    return lone.union(chained.mapInPandas(_starts(window_ms), "root_id long, path string, bucket long, start long, before long"))


def coalesce(events: DataFrame, window_ms: int = 1000) -> DataFrame:
    """What is left of ``events`` (root_id, path, ts_ms, seq, kind, from_path): root_id, path, first_ms (of the entry),
    place (in it, from 1), kind, from_path, seq and absorbed (how many events of the entry are gone).

    The path of a rename is where it went. Order is by ts_ms, then seq. Events without a path (a wish for a rescan) come out as they are,
    each an entry of its own. An entry's changes are counted, not collected; what is collected is its other events: those of one path in one window."""
    let_workers_import(events.sparkSession)
    e = events.select(F.col("root_id").cast("long"), "path", F.col("ts_ms").cast("long"), F.col("seq").cast("long"), "kind", F.col("from_path").cast("string"))
    lost = F.col("path").isNull() | F.col("root_id").isNull()
    straight = e.where(lost).select("root_id", "path", F.col("ts_ms").alias("first_ms"), F.lit(1).alias("place"), "kind", "from_path", "seq", F.lit(0).cast("long").alias("absorbed"))
    e = e.where(~lost).withColumn("bucket", F.expr(f"(ts_ms - pmod(ts_ms, {window_ms}L)) div {window_ms}L"))
    own = e.join(entry_starts(e, window_ms), [*PLACE, "bucket"])
    own = own.withColumn("first_ms", F.when(F.col("ts_ms") >= F.col("start"), F.col("start")).otherwise(F.col("before")))
    event = F.struct("ts_ms", "seq", "kind", "from_path")
    entry = own.groupBy(*PLACE, "first_ms").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("kind") == WEAK, event)).alias("weak"),
        F.sort_array(F.collect_list(F.when(F.col("kind") != WEAK, event))).alias("strong"),
    )

    def add(kept, x):
        last = F.get(kept, F.size(kept) - 1)
        instead = ((last["kind"] == x["kind"]) & ~x["kind"].isin(*OWN)) | (F.size(kept) >= MOST)
        without = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when((F.size(kept) > 0) & instead, F.concat(without, F.array(x))).otherwise(F.concat(kept, F.array(x)))

    nothing = F.slice("strong", F.lit(1), F.lit(0))
    kept = F.when(F.size("strong") > 0, F.aggregate("strong", nothing, add)).otherwise(F.array("weak"))
    out = entry.select(*PLACE, "first_ms", (F.col("n") - F.size(kept)).cast("long").alias("absorbed"), F.posexplode(kept).alias("k", "x"))
    return out.select(*PLACE, "first_ms", (F.col("k") + 1).alias("place"), "x.kind", "x.from_path", "x.seq", "absorbed").union(straight)
