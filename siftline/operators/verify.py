"""Byte comparison of files block by block, and what follows for their groups.

A file's content is rows (id, block, data) of blocks of one size, so that no task holds a whole file. Pairs are compared over ranges of
blocks that double from round to round; a pair that differs is read no further."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import first_different_byte
from ..session import stored
from .steps import KEY

#: Bytes of a block of a stored content, and blocks that the first round compares.
BLOCK, FIRST = 1 << 16, 4


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, block, data) of files (id, content binary); an empty file has one empty block. Null contents have none."""
    n = F.greatest(F.ceil(F.octet_length("content") / F.lit(size)).cast("int"), F.lit(1))
    each = files.where("content is not null").select("id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return each.select("id", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("data"))


def compare(pairs: DataFrame, content: DataFrame, size: int = BLOCK, first: int = FIRST) -> DataFrame:
    """pairs (a, b, ...) with same and at: whether all bytes are equal, else the first that is not (the shorter length if one file begins the
    other). same is null where a file has no content. Pairs must be distinct.

    Each round joins the blocks of a range on both sides and keeps of each pair its first different block, whose bytes tell where.
    Blocks of a pair that has differed are not joined again."""
    data = content.select("id", "block", "data")
    have = data.groupBy("id").agg(F.max("block").alias("last"))
    side = lambda c: have.select(F.col("id").alias(c), F.col("last").alias(f"last_{c}"))
    open_ = stored(pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"), "pairs")
    done, begin, width = None, 0, first
    while not open_.isEmpty():
        end = begin + width
        part = data.where((F.col("block") >= begin) & (F.col("block") < end))
        a, b = part.select(F.col("id").alias("a"), "block", F.col("data").alias("x")), part.select(F.col("id").alias("b"), "block", F.col("data").alias("y"))
        numbers = F.sequence(F.lit(begin).cast("long"), F.least(F.lit(end - 1).cast("long"), F.greatest("last_a", "last_b")))
        each = open_.select("a", "b", F.explode(numbers).alias("block"))
        both = each.join(a, ["a", "block"], "left").join(b, ["b", "block"], "left")
        x, y = F.coalesce("x", F.lit(b"")), F.coalesce("y", F.lit(b""))
        where = F.when(x != y, F.col("block") * size + first_different_byte(x, y))
        found = stored(open_.join(both.groupBy("a", "b").agg(F.min(where).alias("at")), ["a", "b"]), "compared")
        ended = (F.col("at").isNotNull()) | (F.greatest("last_a", "last_b") < end)
        now = found.where(ended).select("a", "b", F.col("at").isNull().alias("same"), F.col("at").cast("long").alias("at"))
        done = now if done is None else done.union(now)
        open_ = stored(found.where(~ended).drop("at"), "pairs")
        begin, width = end, 2 * width
    if done is None:
        done = open_.select("a", "b", F.lit(None).cast("boolean").alias("same"), F.lit(None).cast("long").alias("at"))
    return pairs.join(done, ["a", "b"], "left")


def digests(content: DataFrame) -> DataFrame:
    """(id, digest) of whole contents: the SHA-256 of the digests of their blocks in order. Bytes are digested where they lie."""
    each = content.select("id", F.struct("block", F.sha2("data", 256).alias("d")).alias("x"))
    return each.groupBy("id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda v: v["d"]), ","), 256).alias("digest"))


def settle_members(members: DataFrame, groups: DataFrame, content: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of members (id, group_id, domain_id, size, hash) that wait for the comparison with their group's canonical file.

    groups: group_id, domain_id, size, hash, canonical_id. Returns (members, new groups, events): members with group_id and
    state verified or canonical; events group_id, src, dst, same and at, one for each comparison.

    A member that differs goes on to the group of its key with the next greater id and never comes back. Those that have differed from all
    open groups of their own: one for each content, with the least id as canonical; ids of new groups follow all others. Comparisons
    are as many rounds as a key has groups, each for all members at once. Members whose group is not there or has no canonical file with content
    are left out."""
    waiting = stored(members.select("id", "group_id", *KEY), "waiting")
    groups = stored(groups.select("group_id", *KEY, "canonical_id"), "groups")
    following = groups.select(F.col("group_id").alias("next_id"), *KEY)
    settled = events = left = None
    while not waiting.isEmpty():
        # A step to the next group goes with a member, not with the pair, so that a canonical file may stand in many pairs.
        pairs = waiting.join(groups.select("group_id", F.col("canonical_id").alias("a")), "group_id").withColumnRenamed("id", "b")
        got = stored(compare(pairs.where("a is not null and a <> b"), content, size).where("same is not null"), "verdicts")
        event = got.select("group_id", F.col("a").alias("src"), F.col("b").alias("dst"), "same", "at")
        good = got.where("same").select(F.col("b").alias("id"), "group_id", F.lit("verified").alias("state"))
        away = got.where("not same").select(F.col("b").alias("id"), "group_id", *KEY)
        on = away.join(following, list(KEY), "left").groupBy("id", *KEY).agg(F.min(F.when(F.col("next_id") > F.col("group_id"), F.col("next_id"))).alias("group_id"))
        on = stored(on, "moved")
        none = on.where("group_id is null").select("id", *KEY)
        settled, events, left = (x if y is None else y.union(x) for x, y in ((good, settled), (event, events), (none, left)))
        waiting = on.where("group_id is not null").select("id", "group_id", *KEY)
    if settled is None:
        settled = waiting.select("id", "group_id", F.lit("verified").alias("state"))
        events = waiting.select("group_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("same"), F.col("id").alias("at"))
    if left is None or left.isEmpty():
        return settled, groups.where("false"), events
    classes = left.join(digests(content), "id")
    first = classes.groupBy(*KEY, "digest").agg(F.min("id").alias("canonical_id"))
    base = (groups.agg(F.max("group_id")).first()[0] or 0) + 1
    new = stored(first.withColumn("group_id", F.col("canonical_id") + base), "new-groups")
    placed = stored(classes.join(new, [*KEY, "digest"]).select("id", "group_id", "canonical_id"), "placed")
    checked = compare(placed.where("id <> canonical_id").select(F.col("canonical_id").alias("a"), F.col("id").alias("b"), "group_id"), content, size)
    checked = stored(checked, "verdicts")
    settled = settled.union(placed.where("id = canonical_id").select("id", "group_id", F.lit("canonical").alias("state")))
    settled = settled.union(checked.where("same").select(F.col("b").alias("id"), "group_id", F.lit("verified").alias("state")))
    events = events.union(checked.select("group_id", F.col("a").alias("src"), F.col("b").alias("dst"), "same", "at"))
    return settled, new.select("group_id", *KEY, "canonical_id"), events
