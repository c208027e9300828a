"""Operations on content groups, a batch at a time: each takes snapshots and gives the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of operations.
CREATE, JOIN, CANONICAL, LEAVE, VERIFIED = "create", "join", "set_canonical", "leave", "verified"


def accepted(files: DataFrame, groups: DataFrame, ops: DataFrame) -> DataFrame:
    """The operations of which the files and groups exist; a group that the batch creates exists.

    ops: seq (their order), kind, file_id, other_id (create: the canonical file), group_id (create: of the new
    group) and hash (create: sparse, verified: full, may be null). Rows with null where a kind needs an id go."""
    create = ops.where(F.col("kind") == CREATE)
    for c in ("file_id", "other_id"):
        create = create.join(files.select(F.col("id").alias(c)), c, "left_semi")
    known = groups.select(F.col("id").alias("group_id")).union(create.select("group_id")).distinct()
    rest = ops.where(F.col("kind") != CREATE).join(known, "group_id", "left_semi")
    return create.select(*ops.columns).union(rest.select(*ops.columns))


def member_groups(files: DataFrame, ops: DataFrame) -> DataFrame:
    """files (id, group_id, ...) after the accepted ops: of several on one file the last decides."""
    to = F.when(F.col("kind") != LEAVE, F.col("group_id"))
    touched = F.when(F.col("kind") == CREATE, F.array("file_id", "other_id")).otherwise(F.array("file_id"))
    moves = ops.where(F.col("kind") != VERIFIED).select(F.explode(touched).alias("id"), "seq", to.alias("to"))
    last = moves.groupBy("id").agg(F.max(F.struct("seq", "to")).alias("m"))
    columns = [F.when(F.col("m").isNotNull(), F.col("m.to")).otherwise(F.col("group_id")).alias(c) if c == "group_id" else F.col(c) for c in files.columns]
    return files.join(last, "id", "left").select(*columns)


def group_rows(files: DataFrame, groups: DataFrame, ops: DataFrame, now: int) -> DataFrame:
    """groups (id, size, sparse_hash, canonical_file_id, verified_at, full_hash, created_at) after the accepted ops.

    The canonical file is the last that was set, or none if it left later. The first verification and the
    first full hash stay."""
    made = ops.where(F.col("kind") == CREATE).join(files.select(F.col("id").alias("file_id"), "size"), "file_id")
    made = made.select(F.col("group_id").alias("id"), "size", F.col("hash").alias("sparse_hash"), F.col("other_id").alias("canonical_file_id"), F.lit(None).cast("long").alias("verified_at"), F.lit(None).cast("string").alias("full_hash"), F.lit(now).cast("long").alias("created_at"))
    every = groups.select(*made.columns).union(made)
    is_ = lambda kind: F.col("kind") == kind
    change = ops.groupBy(F.col("group_id").alias("id")).agg(
        F.max(F.when(is_(CANONICAL), F.struct("seq", "file_id"))).alias("set"),
        F.max(F.when(is_(VERIFIED), F.lit(True))).alias("checked"),
        F.min(F.when(is_(VERIFIED) & F.col("hash").isNotNull(), F.struct("seq", "hash"))).alias("first_hash"),
    )
    now_at = every.join(change, "id", "left").withColumn("canon", F.coalesce("set.file_id", "canonical_file_id")).withColumn("since", F.col("set.seq"))
    left = ops.where(is_(LEAVE)).groupBy(F.col("group_id").alias("id"), F.col("file_id").alias("canon")).agg(F.max("seq").alias("left_at"))
    gone = F.col("left_at").isNotNull() & (F.col("since").isNull() | (F.col("left_at") > F.col("since")))
    return now_at.join(left, ["id", "canon"], "left").select(
        "id",
        "size",
        "sparse_hash",
        F.when(~gone, F.col("canon")).alias("canonical_file_id"),
        F.coalesce("verified_at", F.when(F.col("checked"), F.lit(now).cast("long"))).alias("verified_at"),
        F.coalesce("full_hash", "first_hash.hash").alias("full_hash"),
        "created_at",
    )
