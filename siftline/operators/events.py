"""File events: rename pairing, coalescing, back-pressure, load hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_renames(events: DataFrame, window_ms: int) -> DataFrame:
    """Halves of renames (seq, ts_ms, kind from|to, cookie, path): renamed if the other half came in time, else
    moved_in, or removed_unknown once the wait is over."""
    a = events.where("kind = 'from'").select("cookie", F.col("seq").alias("s1"), F.col("ts_ms").alias("t1"), F.col("path").alias("from_path"))
    b = events.where("kind = 'to'").select("cookie", F.col("seq").alias("s2"), F.col("ts_ms").alias("t2"), F.col("path"))
    both = a.join(b, (a.cookie == b.cookie) & (b.t2 >= a.t1) & (b.t2 <= a.t1 + window_ms), "full_outer")
    kind = F.when(F.col("s1").isNull(), "moved_in").when(F.col("s2").isNull(), "removed_unknown").otherwise("renamed")
    return both.select(kind.alias("kind"), F.coalesce("s1", "s2").alias("seq"), "from_path", "path")


def coalesce_bursts(events: DataFrame, window_ms: int) -> DataFrame:
    """Equal events of a path within the window of the first of their run become the last of them; counts what is dropped.

    A run starts at the first event after the window of the run before it, found by a fold over the path's events."""
    # Events farther apart than the window are in different runs: the fold is over what lies between such gaps.
    w = Window.partitionBy("path", "kind").orderBy("ts_ms", "seq")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w) >= window_ms
    cut = events.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("part", F.sum("gap").over(w))
    rows = cut.groupBy("path", "kind", "part").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "seq"))).alias("e"))
    fold = F.aggregate(
        "e",
        F.array().cast("array<struct<first:bigint,last:bigint,seq:bigint,n:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x.ts_ms - F.get(acc, F.size(acc) - 1).first < window_ms),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1).first.alias("first"), x.ts_ms.alias("last"), x.seq.alias("seq"), (F.get(acc, F.size(acc) - 1).n + 1).alias("n")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.ts_ms.alias("first"), x.ts_ms.alias("last"), x.seq.alias("seq"), F.lit(1).cast("bigint").alias("n"))))),
    )
    return rows.select("path", "kind", F.explode(fold).alias("r")).select("path", "kind", F.col("r.first").alias("first_ms"), F.col("r.seq").alias("seq"), (F.col("r.n") - 1).alias("dropped"))


def back_pressure(events: DataFrame, per_uid: int) -> DataFrame:
    """Events of a user beyond the cap within a day are rejected."""
    w = Window.partitionBy("day", "uid").orderBy("seq")
    return events.withColumn("n", F.row_number().over(w)).select("seq", "uid", (F.col("n") > per_uid).alias("rejected"))


def load_deltas(samples: DataFrame) -> DataFrame:
    """Utilisation and sectors between consecutive samples (dev, ts_ms, ticks, sectors); the first has none."""
    w = Window.partitionBy("dev").orderBy("ts_ms")
    dt, ticks = F.col("ts_ms") - F.lag("ts_ms").over(w), F.greatest(F.col("ticks") - F.lag("ticks").over(w), F.lit(0))
    util = F.least(F.lit(1.0), ticks / dt)
    return samples.select("dev", "ts_ms", F.when(dt > 0, util).alias("util"), F.greatest(F.col("sectors") - F.lag("sectors").over(w), F.lit(0)).alias("sectors"))


def load_of_others(samples: DataFrame) -> DataFrame:
    """util and util_other between consecutive samples (dev, ts_ms, ticks, sectors, own_bytes): how busy the disk was, and what of it others
    made. The own share is own bytes against 512 for each sector. Counters that fall (wrapped, or a disk that came back) count as no
    progress, shares lie from 0 to 1, a disk without traffic has no own share; the first sample and those without time between have none.
    Own bytes that are not known count as none, so that work rather rests too often."""
    w = Window.partitionBy("dev").orderBy("ts_ms")
    grown = lambda c: F.greatest(c - F.lag(c).over(w), F.lit(0))
    between = samples.select(
        "dev", "ts_ms", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("ms"), grown(F.col("ticks")).alias("ticks"), (grown(F.col("sectors")) * 512).alias("device"), grown(F.coalesce("own_bytes", F.lit(0))).alias("own")
    )
    util = F.when(F.col("ms") > 0, F.least(F.lit(1.0), F.col("ticks") / F.col("ms")))
    share = F.when(F.col("device") > 0, F.least(F.lit(1.0), F.col("own") / F.col("device"))).otherwise(0.0)
    return between.select("dev", "ts_ms", util.alias("util"), (util * (1 - share)).alias("util_other"))


def hysteresis(samples: DataFrame, busy: float, busy_ms: int, idle: float, idle_ms: int) -> DataFrame:
    """Whether work is paused after each sample (dev, ts_ms, load): paused by a run of busy samples that lasts busy_ms,
    resumed by a run of idle ones that lasts idle_ms; a sample to the contrary breaks a run.

    A run's start is the last sample that broke it: windows only, no fold."""
    before = Window.partitionBy("dev").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = lambda c: F.max(F.when(~F.col(c), F.col("ts_ms"))).over(before)
    s = samples.withColumn("b", F.col("load") >= busy).withColumn("i", F.col("load") <= idle)
    s = s.withColumn("bb", broken("b")).withColumn("ib", broken("i"))
    s = s.withColumn("bs", F.min(F.when(F.col("b"), F.col("ts_ms"))).over(Window.partitionBy("dev", "bb"))).withColumn("is", F.min(F.when(F.col("i"), F.col("ts_ms"))).over(Window.partitionBy("dev", "ib")))
    turn = F.when(F.col("b") & (F.col("ts_ms") - F.col("bs") >= busy_ms), True).when(F.col("i") & (F.col("ts_ms") - F.col("is") >= idle_ms), False)
    return s.select("dev", "ts_ms", F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit(False)).alias("paused"))


#: What is done with an event by its kind.
ACTIONS = (
    ("closed", "upsert"),
    ("moved_in", "upsert"),
    ("modified", "push_ready"),
    ("renamed", "rename"),
    ("renamed_dir", "rename_prefix"),
    ("removed_unknown", "check_then_mark"),
    ("removed", "mark_missing"),
    ("removed_dir", "mark_missing_prefix"),
    ("created_dir", "walk"),
    ("needs_rescan", "rescan"),
)


def handle(events: DataFrame, files: DataFrame) -> DataFrame:
    """seq and action of each event (seq, kind, root_id, path): a change of a file only moves its time if it is settling
    at that path, and removing a root is an error."""
    at = files.where("state = 'settling'").select("root_id", F.col("rel_path").alias("path"), F.lit(True).alias("settling")).distinct()
    out = events.join(at, ["root_id", "path"], "left")
    action = F.when((F.col("path") == "") & F.col("kind").isin("removed", "removed_dir", "removed_unknown"), "error")
    for kind, what in ACTIONS:
        cond = F.col("kind") == kind
        action = action.when(cond & (F.col("settling").isNotNull() if kind == "modified" else F.lit(True)), what)
    return out.select("seq", action.otherwise("ignore").alias("action"))


def translate(raw: DataFrame) -> DataFrame:
    """seq and kind of raw events (seq, raw: create, close_write, modify, from, to, delete, overflow; folder; inside: the
    path lies in a root): halves of renames stay for pairing, what a folder loses or gains is walked or marked."""
    r, folder = F.col("raw"), F.col("folder")
    kind = (
        F.when(r == "overflow", "needs_rescan")
        .when(~F.col("inside"), None)
        .when(r.isin("create", "close_write"), F.when(folder, F.when(r == "create", "created_dir")).otherwise("closed"))
        .when(r == "modify", F.when(~folder, "modified"))
        .when(r == "delete", F.when(folder, "removed_dir").otherwise("removed"))
        .when(r.isin("from", "to"), r)
    )
    return raw.select("seq", kind.alias("kind")).where("kind is not null")


def flush(events: DataFrame, halves: DataFrame, now: int, wait_ms: int) -> DataFrame:
    """What comes out when watching stops: all coalesced events, and lone first halves whose wait is over; others are dropped."""
    over = halves.where((F.col("kind") == "from") & (F.lit(now) - F.col("ts_ms") > wait_ms)).select("seq", F.lit("removed_unknown").alias("kind"))
    return events.select("seq", "kind").union(over)


def bucket_waits(requests: DataFrame, rate: float, burst: int) -> DataFrame:
    """dev, ts_ms and wait_ms of each request for bytes (dev, ts_ms, n) to a bucket of ``burst`` bytes that fills at ``rate``
    bytes a second; a request takes the burst at most, a wait lasts a second at most.

    Windows only: what is missing after a request is the greatest of the sums of requests since any earlier one less
    what has flown in since, so it is a running sum against its running least."""
    w = Window.partitionBy("dev").orderBy("ts_ms", "n")
    taken = F.least(F.col("n"), F.lit(burst))
    s = requests.withColumn("taken", taken).withColumn("sum", F.sum("taken").over(w)).withColumn("flow", F.col("ts_ms") * F.lit(rate / 1000))
    s = s.withColumn("floor", F.min(F.col("sum") - F.col("taken") - F.col("flow")).over(w))
    debt = F.col("sum") - F.col("flow") - F.col("floor") - F.lit(burst)
    return s.select("dev", "ts_ms", F.least(F.greatest(F.ceil(debt * 1000 / F.lit(rate)), F.lit(0)), F.lit(1000)).cast("long").alias("wait_ms"))


def paused(manual: Column, busy: Column, flag: Column) -> Column:
    """Work rests by hand, when the disks are busy with others, or by the bucket's flag."""
    return F.coalesce(manual, F.lit(False)) | F.coalesce(busy, F.lit(False)) | F.coalesce(flag, F.lit(False))
