"""Peers, candidates, groups and their canonical members, a whole catalog at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import full_hash, sparse_hash
from ..session import stored

def election() -> Column:
    """What a group's canonical file has least of; inode numbers are unsigned."""
    return F.struct("mtime_ns", "first_seen_at", F.col("ino").bitwiseXOR(F.lit(-(1 << 63))).alias("ino"), "id")


def live() -> Column:
    return ~F.col("state").isin("missing", "gone")


def size_peers(files: DataFrame) -> DataFrame:
    """Live files whose (domain, size) another has. Sizes are counted alone and then semi-joined, so that the
    content of other files is neither shuffled nor hashed."""
    sizes = files.where(live()).groupBy("domain_id", "size").count().where("count > 1")
    return files.where(live()).join(sizes, ["domain_id", "size"], "left_semi")


#: Columns in which candidates agree, by the scope of sharing.
SCOPES = {"owner": ("domain_id", "size", "owner_uid"), "share": ("domain_id", "size", "root_id"), "domain": ("domain_id", "size")}


def candidates(files: DataFrame, settled_before_ns: int, limit: int, same: tuple[str, ...] = ("domain_id", "size")) -> DataFrame:
    """For each settled file its first ``limit`` candidates by age."""
    me = files.where("state in ('sized', 'distinct')").select(*same, F.col("id").alias("me"))
    other = files.where("state in ('sized', 'distinct') and nlink = 1").where(F.col("mtime_ns") <= settled_before_ns)
    # The first limit + 1 of each class serve all its files, whatever its size.
    first = Window.partitionBy(*same).orderBy("mtime_ns", "first_seen_at", "id")
    other = other.select(*same, "id", F.row_number().over(first).alias("place")).where(F.col("place") <= limit + 1)
    own = other.select(*same, F.col("id").alias("me"), F.col("place").alias("own"))
    pairs = me.join(own, [*same, "me"], "left").join(other, list(same)).where("me <> id")
    rank = F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)
    return pairs.select("me", "id", rank.alias("rank")).where(F.col("rank") <= limit)


def pending_same_size(files: DataFrame) -> DataFrame:
    """For each sized file the latest time at which a settling peer is ready."""
    waiting = files.where("state = 'settling'").groupBy("domain_id", "size").agg(F.max("ready_at").alias("wait_until"))
    return files.where("state = 'sized'").join(waiting, ["domain_id", "size"], "left").select("id", "wait_until")


def content_groups(files: DataFrame, chunks: int, length: int, align: int = 1) -> DataFrame:
    """Members of groups of equal content: id, size, sparse_hash, group_id (the canonical member's id), is_canonical.

    The sparse hash narrows and the full digest decides. Contents are read twice and never shuffled but for the files whose (domain, size, sparse hash)
    another has: one pass takes the sparse hash and writes narrow rows, one takes the digest of those files. A group takes the least
    (mtime, first seen, ino, id) as canonical. Elected by an aggregate and a join on the key: a class of any size meets
    one row per task."""
    hash_ = sparse_hash(F.col("content"), F.col("size"), chunks, length, align).alias("sparse_hash")
    narrow = ["id", "ino", "root_id", "owner_uid", "state", "domain_id", "size", "mtime_ns", "first_seen_at"]
    rows = stored(files.where(live()).select(*narrow, hash_), "sparse")
    classes = rows.groupBy("domain_id", "size", "sparse_hash").count().where("count > 1")
    twins = stored(rows.join(classes, ["domain_id", "size", "sparse_hash"], "left_semi"), "twins")
    digests = files.join(twins.select("id"), "id", "left_semi").select("id", full_hash(F.col("content")).alias("digest"))
    hashed = stored(twins.join(digests, "id"), "digests")
    key = ["domain_id", "size", "sparse_hash", "digest"]
    best = hashed.groupBy(*key).agg(F.min(election()).alias("best"), F.count("*").alias("n")).where("n > 1")
    out = hashed.join(best.select(*key, F.col("best.id").alias("group_id")), key)
    return out.withColumn("is_canonical", F.col("id") == F.col("group_id")).drop("digest")


def report(members: DataFrame, roots: DataFrame, uid: int | None = None, cross_only: bool = False, limit: int | None = None) -> DataFrame:
    """A row for each group of two or more: certainty is the lowest of its members but the canonical one."""
    severity = F.when(F.col("state") == "deduped", 2).when(F.col("state") == "verified", 1).otherwise(0)
    rows = members.join(F.broadcast(roots.select("root_id", "kind")), "root_id", "left").withColumn("kind", F.coalesce("kind", F.lit("local")))
    out = rows.groupBy("group_id", "size").agg(
        F.count("*").alias("members"),
        F.coalesce(F.min(F.when(~F.col("is_canonical"), severity)), F.lit(2)).alias("certainty"),
        (F.bool_or(F.col("kind") == "local") & F.bool_or(F.col("kind") == "remote")).alias("cross_machine"),
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("member_ids"),
        F.bool_or(F.col("owner_uid") == (uid if uid is not None else -1)).alias("mine"),
    )
    out = out.where("members > 1").withColumn("reclaimable", F.col("size") * (F.col("members") - 1))
    if uid is not None:
        out = out.where("mine")
    if cross_only:
        out = out.where("cross_machine")
    out = out.drop("mine")
    return out if limit is None else out.orderBy(F.desc("reclaimable"), "group_id").limit(limit)


def totals(groups: DataFrame) -> DataFrame:
    by = lambda level: F.coalesce(F.sum(F.when(F.col("certainty") == level, F.col("reclaimable"))), F.lit(0)).alias(("suspected", "verified", "shared")[level])
    return groups.agg(F.count("*").alias("groups"), by(0), by(1), by(2), F.count_if("cross_machine").alias("cross_groups"))


def reelect(files: DataFrame) -> DataFrame:
    """The deduped member that becomes canonical of each stored group."""
    best = files.where("state = 'deduped' and group_id is not null").groupBy("group_id").agg(F.min(election()).alias("b"))
    return best.select("group_id", F.col("b.id").alias("canonical_id"))


def compare_pairs(members: DataFrame, files: DataFrame) -> DataFrame:
    """Each member against its canonical file: same, or the first difference."""
    from ..functions.hashing import first_difference

    m = members.where("not is_canonical").select("id", "group_id")
    a, b = files.select("id", F.col("content").alias("a")), files.select(F.col("id").alias("group_id"), F.col("content").alias("b"))
    return m.join(a, "id").join(b, "group_id").select("id", "group_id", (F.col("a") == F.col("b")).alias("same"), first_difference(F.col("a"), F.col("b")).alias("at"))
