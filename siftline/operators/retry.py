"""Events whose file could not be read for now: they wait a while, come again a few times, and ask for a rescan when very many wait."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources.publish import current, publish

# Fixed values.
WAIT_MS, TRIES, ROOM = 1000, 5, 10_000

WAITING = "seq long, root_id long, path string, attempts int, not_before long"
_EVENT = ("seq", "root_id", "path", "attempts")


def step(waiting: DataFrame, failed: DataFrame, now: int, wait_ms: int = WAIT_MS, most: int = TRIES, room: int = ROOM) -> DataFrame:
    """What becomes of the events that wait (seq, root_id, path, attempts, not_before) and of those that failed since (seq, root_id, path,
    attempts, failed_at): the columns of an event, not_before and action.

    "again": its time has come; these leave first. "waits": waits on, or, of new ones, the first by seq that there is room for, with an attempt
    more. "given_up": tried ``most`` times, a later scan will find it. "rescan": no room, which asks for a rescan of all. Missing attempts count as
    none, a missing time of failure as now. The room is bounded, so what is taken in comes from the first of each task."""
    old = F.when(F.col("not_before") <= now, "again").otherwise("waits")
    before = waiting.select(*_EVENT, "not_before", old.alias("action"))
    free = max(0, room - before.where("action = 'waits'").count())
    new = failed.select("seq", "root_id", "path", F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"), (F.coalesce("failed_at", F.lit(now)) + wait_ms).cast("long").alias("not_before"))
    taken = new.where(F.col("attempts") < most).select("seq").orderBy("seq").limit(free).withColumn("taken", F.lit(True))
    new = new.join(taken, "seq", "left")
    action = F.when(F.col("attempts") >= most, "given_up").when(F.col("taken"), "waits").otherwise("rescan")
    attempts = F.when(action == "waits", F.col("attempts") + 1).otherwise(F.col("attempts")).cast("int")
    return before.union(new.select("seq", "root_id", "path", attempts.alias("attempts"), F.when(action == "waits", F.col("not_before")).alias("not_before"), action.alias("action")))


def begin(path: str, spark: SparkSession) -> None:
    """A first snapshot: nothing waits and no batch was taken in."""
    none = spark.createDataFrame([], WAITING)
    publish({"waiting": none, "again": none, "progress": spark.createDataFrame([(-1, 0, False)], "batch long, now long, rescan boolean")}, path)


def retried(path: str, wait_ms: int = WAIT_MS, most: int = TRIES, room: int = ROOM) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of failures (as in ``step``): each micro-batch makes one step and publishes what waits, what is to be tried ``again``
    and whether a rescan is asked for. The clock is the latest failure seen so far, so that it never goes back and a batch that comes again after
    a crash gives the same; one that was published changes nothing. Without new failures no batch comes, so what waits stays until the next."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = current(spark, path, "progress").first()
        if number <= done.batch:
            return
        now = max(done.now, batch.agg(F.max("failed_at")).first()[0] or 0)
        out = stored(step(current(spark, path, "waiting"), batch, now, wait_ms, most, room), "retries")
        columns = [c.split()[0] for c in WAITING.split(", ")]
        rescan = done.rescan or not out.where("action = 'rescan'").isEmpty()
        progress = spark.createDataFrame([(number, now, rescan)], "batch long, now long, rescan boolean")
        publish({"waiting": out.where("action = 'waits'").select(*columns), "again": out.where("action = 'again'").select(*columns), "progress": progress}, path)

    return run
