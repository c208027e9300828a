"""How much the queue takes in: no more than ``most`` files in all, and no more than ``per_uid`` of one user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ..sources.publish import current, publish

# Fixed values.
MOST, PER_UID = 20_000, 500


def admit(arrivals: DataFrame, pending: DataFrame, most: int = MOST, per_uid: int = PER_UID) -> DataFrame:
    """arrivals (seq, uid, ...) with ``admitted``, as if taken one after the other by seq; pending: uid and n, what waits already.

    An arrival is taken if there is room for its user and in all. Those with no room for their user take none of the room in all, and once the
    whole is full nothing more comes in, so the two bounds can be taken one after the other: of each user the first, then of these the
    first. Both keep few rows for each task before they shuffle; a null uid is a user of its own."""
    held = pending.groupBy("uid").agg(F.sum("n").alias("held"))
    room = max(0, most - (held.agg(F.sum("held")).first()[0] or 0))
    w = Window.partitionBy("uid").orderBy("seq")
    ranked = arrivals.select("seq", "uid").withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_uid)
    ranked = ranked.join(held.withColumnRenamed("uid", "u"), F.col("uid").eqNullSafe(F.col("u")), "left")
    taken = ranked.where(F.col("place") + F.coalesce("held", F.lit(0)) <= per_uid).orderBy("seq").limit(room).select("seq", F.lit(True).alias("admitted"))
    return arrivals.join(taken, "seq", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def begin(path: str, queue: DataFrame) -> None:
    """A first snapshot: queue (seq, uid) and no batch taken in yet."""
    spark = queue.sparkSession
    publish({"queue": queue.select("seq", "uid"), "progress": spark.createDataFrame([(-1, False)], "batch long, rescan boolean")}, path)


def taken_in(path: str, most: int = MOST, per_uid: int = PER_UID) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of arrivals (seq, uid): each micro-batch is admitted against the queue as published and the next snapshot is
    published with its number, so that a batch that comes again changes nothing. A rejection asks for a rescan (progress.rescan)."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = current(spark, path, "progress").first()
        if number <= done.batch:
            return
        queue = current(spark, path, "queue")
        out = stored(admit(batch.select("seq", "uid"), queue.groupBy("uid").agg(F.count("*").alias("n")), most, per_uid), "admitted")
        rescan = done.rescan or not out.where("not admitted").isEmpty()
        progress = spark.createDataFrame([(number, rescan)], "batch long, rescan boolean")
        publish({"queue": queue.unionByName(out.where("admitted").select("seq", "uid")), "progress": progress}, path)

    return run


def leave(path: str, done: DataFrame) -> None:
    """Files (seq) that leave the queue make room."""
    spark = done.sparkSession
    publish({"queue": current(spark, path, "queue").join(done.select("seq"), "seq", "left_anti"), "progress": current(spark, path, "progress")}, path)
