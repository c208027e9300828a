"""Roots, volumes and notes: upserts that keep ids, and refuse what names a group that is not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, listed: DataFrame, key: str, once: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (id, key, others) after those of ``listed`` (pos, id, key, others), which are taken in the order of pos.

    A key that is there keeps its id and the columns of ``once``, and takes all others; rows that are not listed stay. Of a
    key listed more than once the first names the id and the columns of ``once``, the last all others. A new key has the id it
    asks for (above 0) if no row has it and no key before it asks for it; such ids are given first. Others get those after the greatest, in the
    order of their pos. Keys that are null are left out. Places are as many as a configuration lists, so they are numbered in one task."""
    others = [c for c in rows.columns if c not in ("id", key)]
    last = F.max_by(F.struct(*(c for c in others if c not in once), F.lit(True).alias("listed")), "pos").alias("last")
    first = F.min_by(F.struct(F.col("id").alias("asked"), *once), "pos").alias("first")
    new = listed.where(F.col(key).isNotNull()).groupBy(key).agg(last, first, F.min("pos").alias("pos"))
    both = rows.join(new, key, "full")
    value = [F.coalesce(c, f"first.{c}").alias(c) if c in once else F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in others]
    both = both.select("id", key, *value, "pos", F.when(F.col("id").isNull() & (F.col("first.asked") > 0), F.col("first.asked")).alias("asked"))
    # Rows of an id before keys that ask for it; of those the first.
    holds = F.coalesce("id", "asked")
    turn = F.row_number().over(Window.partitionBy(holds).orderBy(F.col("id").isNull(), "pos"))
    both = both.withColumn("given", F.when(F.col("id").isNotNull(), F.col("id")).when(turn == 1, F.col("asked")))
    both = both.withColumn("most", F.max("given").over(Window.partitionBy()))
    place = F.sum(F.col("given").isNull().cast("long")).over(Window.orderBy("pos"))
    return both.withColumn("id", F.coalesce("given", F.coalesce("most", F.lit(0)) + place)).select("id", key, *others)


def set_notes(notes: DataFrame, new: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes (group_id, handled_at, note, device) after new ones (the same and pos), the last of a group by pos as a whole, and the new ones that
    were refused since their group (``groups``: group_id) is not there."""
    known = groups.select("group_id").distinct()
    taken = new.join(known, "group_id", "left_semi")
    refused = new.join(known, "group_id", "left_anti")
    columns = [c for c in notes.columns if c != "group_id"]
    last = taken.groupBy("group_id").agg(F.max_by(F.struct(*columns), "pos").alias("v"))
    both = notes.join(last, "group_id", "full")
    pick = [F.when(F.col("v").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return both.select("group_id", *pick), refused
