"""File events as streams: renames by a join with watermarks, and micro-batches that are applied to the catalog. Streams with
state of their own are in ``state``.

Streams of halves of renames are (ts timestamp, seq, kind, cookie, path); streams of events are (ts, seq, kind, path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pair_renames(halves: DataFrame, window: str = "2 seconds", late: str = "5 seconds") -> DataFrame:
    """kind, seq, from_path and path as events: renamed where the other half came in time; a lone half comes out once
    the watermark has passed its wait, as moved_in or removed_unknown. At the end of a stream, halves that still wait are
    dropped: a file is not taken for removed because watching stopped."""
    stream = halves.withWatermark("ts", late)
    a = stream.where("kind = 'from'").select(F.col("ts").alias("t1"), F.col("seq").alias("s1"), F.col("cookie").alias("c1"), F.col("path").alias("from_path"))
    b = stream.where("kind = 'to'").select(F.col("ts").alias("t2"), F.col("seq").alias("s2"), F.col("cookie").alias("c2"), "path")
    here = (F.col("c1") == F.col("c2")) & (F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + F.expr(f"interval {window}"))
    both = a.join(b, here, "full_outer")
    kind = F.when(F.col("s1").isNull(), "moved_in").when(F.col("s2").isNull(), "removed_unknown").otherwise("renamed")
    return both.select(kind.alias("kind"), F.coalesce("s1", "s2").alias("seq"), "from_path", "path")


def apply_events(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Hands each micro-batch of events, with its number, to ``apply``, which publishes the catalog's next snapshot. A batch
    comes again after a failure, so ``apply`` must leave a number out that it has published."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
