"""The steps of a file through the queue, a whole catalog at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import first_different_byte
from ..functions.scalars import backoff_ms, div, has_special_mode
from ..schema import DAY
from ..session import small, stored

KEY = ("domain_id", "size", "hash")
#: Bytes of a content that a pair carries, bytes of the range behind them that is compared first, and files of one size that meet in one task.
HEAD, FIRST_RANGE, TOGETHER = 64, 1024, 512


def dispatch(state: Column) -> Column:
    """The step that a file of this state takes next."""
    return F.when(state == "settling", "settle").when(state == "sized", "hash").when(state == "hashed", "verify").otherwise("noop")


def settle(files: DataFrame, now: int, settle_ms: int) -> DataFrame:
    """id, state, ready_at and reason of settling files (with gone, enqueued_mtime_ns, magic, hole as observed now).

    In order: a file that is gone is missing; one that changed since it was queued waits anew; a young one waits; hard links,
    special modes and wrong contents are skipped; one with holes is looked at a day later."""
    ms = div(F.col("mtime_ns"), 1_000_000)
    cases = (
        (F.col("gone"), "missing", None, None),
        (F.col("enqueued_mtime_ns") != F.col("mtime_ns"), "settling", F.lit(now + settle_ms), None),
        (ms > now - settle_ms, "settling", ms + settle_ms, None),
        (F.col("nlink") > 1, "skipped", None, "hardlink"),
        (has_special_mode(F.col("mode").cast("int")), "skipped", None, "special_mode"),
        (F.col("magic") == "mismatch", "skipped", None, "bad_magic"),
        (F.col("hole"), "settling", F.lit(now + DAY), "suspect_partial"),
        (F.lit(True), "sized", F.lit(now), None),
    )

    def choose(k: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for case in reversed(cases):
            value = case[k] if isinstance(case[k], Column) else F.lit(case[k])
            out = F.when(F.coalesce(case[0], F.lit(False)), value.cast(kind)).otherwise(out)
        return out

    return files.select("id", choose(1, "string").alias("state"), choose(2, "long").alias("ready_at"), choose(3, "string").alias("reason"))


def after_error(attempts: Column, now: int, most: int = 8) -> tuple[Column, Column]:
    """State and ready_at of a file after one more failed attempt: failed at the eighth, else a longer wait."""
    last = attempts + 1 >= most
    return F.when(last, "failed"), F.when(~last, now + backoff_ms(attempts + 1))


def group_by_key(files: DataFrame, groups: DataFrame) -> DataFrame:
    """The first group (least id) of each file's (domain_id, size, hash): id, group_id, or null."""
    first = groups.groupBy(*KEY).agg(F.min("group_id").alias("group_id"))
    return files.join(first, list(KEY), "left").select("id", "group_id")


def place_in_group(files: DataFrame, groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """id, group_id and what becomes of each hashed file: hashed (to be compared with the living canonical file),
    canonical (it is that file, or the group has lost it) or find_candidates (no group has its key).

    groups: group_id, key columns, canonical_id. The canonical file counts if it is a member and neither missing nor gone."""
    first = groups.groupBy(*KEY).agg(F.min(F.struct("group_id", "canonical_id")).alias("g"))
    alive = catalog.where("state not in ('missing', 'gone')").select(F.col("id").alias("canonical_id"), F.col("group_id").alias("member_of"))
    out = files.join(first, list(KEY), "left").select("id", "g.group_id", "g.canonical_id").join(alive, "canonical_id", "left")
    lives = F.col("member_of") == F.col("group_id")
    to = F.when(F.col("group_id").isNull(), "find_candidates").when(F.col("canonical_id") == F.col("id"), "canonical").when(lives, "hashed").otherwise("canonical")
    return out.select("id", "group_id", to.alias("state"))


def next_groups(groups: DataFrame) -> DataFrame:
    """For each group the least greater id with the same key, where a file goes that differs from the first's."""
    w = Window.partitionBy(*KEY).orderBy("group_id")
    return groups.select("group_id", F.lead("group_id").over(w).alias("next_group"))


def narrow(files: DataFrame) -> DataFrame:
    """``files`` with the SHA-256 of the content as it is now and its first HEAD bytes in place of the content: what a pair carries of it."""
    content = F.col("content").cast("binary")
    return files.withColumn("digest", F.unhex(F.sha2(content, 256))).withColumn("head", F.substring(content, 1, HEAD)).drop("content")


def _side(files: DataFrame, p: str) -> DataFrame:
    return files.select(*(F.col(c).alias(p if c == "id" else f"{p}_{c}") for c in files.columns))


def _joined(pairs: DataFrame, files: DataFrame) -> DataFrame:
    files = narrow(files)
    return pairs.join(_side(files, "a"), "a").join(_side(files, "b"), "b")


def peers(files: DataFrame) -> DataFrame:
    """The pairs of neighbours (b = a + 1) and of files of one size (a < b), with the columns of ``narrow`` of both, a_ and b_.

    The files meet by size, so that no pair is shuffled; a size that more than TOGETHER files have is dealt out: each
    file comes once as b, and as a to each share of the others."""
    files = narrow(files)
    shares = files.where("size is not null").groupBy("size").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).cast("int").alias("shares")).where("shares > 1")
    dealt = files.join(small(stored(shares, "sizes")), "size", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    a = _side(dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares"), "a")
    b = _side(dealt.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).drop("shares"), "b")
    equal = a.join(b, (F.col("a_size") == F.col("b_size")) & (F.col("a_share") == F.col("b_share")) & (F.col("a") < F.col("b"))).drop("a_share", "b_share")
    other = ~F.coalesce(F.col("a_size") == F.col("b_size"), F.lit(False))
    return _side(files, "a").join(_side(files, "b"), (F.col("b") == F.col("a") + 1) & other).unionByName(equal)


def explain_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Why two files (a, b) are shared or not: the first check that fails, in the order in which they are made.

    files: id, reason (of the filter), domain_id, size, magic, hash, content."""
    return explained(_joined(pairs, files))


def explained(both: DataFrame) -> DataFrame:
    """``explain_pairs`` of pairs that have the columns of both files (as ``peers``)."""
    why = (
        F.when(F.col("a_reason").isNotNull() | F.col("b_reason").isNotNull(), "filtered")
        .when(F.col("a_domain_id") != F.col("b_domain_id"), "other_domain")
        .when(F.col("a_size") != F.col("b_size"), "other_size")
        .when((F.col("a_magic") == "mismatch") | (F.col("b_magic") == "mismatch"), "bad_magic")
        .when(F.col("a_hash") != F.col("b_hash"), "other_hash")
        .when(F.col("a_digest") != F.col("b_digest"), "other_bytes")
        .otherwise("same")
    )
    return both.select("a", "b", why.alias("verdict"))


def pair_reasons(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """All that can be said of two files (a, b), in the order of the checks: a_reason and b_reason (of the filter), same_size, and, if so, a_magic,
    b_magic and same_hash, and, if so, first_diff (the first byte that differs; null if none), then the verdict.

    Filter and magic end nothing, so that all reasons are known; a pair of equal bytes is "ignored" if one of them holds, else
    "same". files: id, reason, size, magic (match, mismatch, unchecked), hash, content."""
    return all_reasons(_joined(pairs, files), files)


def all_reasons(both: DataFrame, files: DataFrame) -> DataFrame:
    """``pair_reasons`` of pairs that have the columns of both of ``files`` (as ``peers``). Most differ within their first bytes;
    of the others each two contents are compared once."""
    size = F.coalesce(F.col("a_size") == F.col("b_size"), F.lit(False))
    hash_ = F.when(size, F.coalesce(F.col("a_hash") == F.col("b_hash"), F.lit(False)))
    differ = F.coalesce(hash_ & (F.col("a_digest") != F.col("b_digest")), F.lit(False))
    later = differ & (F.col("a_head") == F.col("b_head"))
    diff = F.when(differ, first_different_byte(F.col("a_head"), F.col("b_head")).cast("long"))
    ignored = F.col("a_reason").isNotNull() | F.col("b_reason").isNotNull() | (F.col("a_magic") == "mismatch") | (F.col("b_magic") == "mismatch")
    verdict = F.when(~size, "other_size").when(~hash_, "other_hash").when(differ, "other_bytes").when(F.coalesce(ignored, F.lit(False)), "ignored").otherwise("same")
    head = ("a", "b", "a_reason", "b_reason", size.alias("same_size"), *(F.when(size, F.col(c)).alias(c) for c in ("a_magic", "b_magic")), hash_.alias("same_hash"))
    known = both.where(~later).select(*head, diff.alias("first_diff"), verdict.alias("verdict"))
    rest = stored(both.where(later).select(*head, verdict.alias("verdict"), "a_digest", "b_digest"), "equal-heads")
    if rest.isEmpty():
        return known
    at = _first_differences(rest.select("a_digest", "b_digest").distinct(), files)
    return known.unionByName(rest.join(small(at), ["a_digest", "b_digest"], "left").drop("a_digest", "b_digest"))


def _first_differences(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """pairs (a_digest, b_digest) of contents with equal heads, with first_diff. Ranges of bytes are compared, each
    longer than the one before; a pair that differs is read no further."""
    open_ = stored(pairs, "pairs")
    wanted = stored(open_.select(F.explode(F.array("a_digest", "b_digest")).alias("digest")).distinct(), "wanted")
    content = F.col("content").cast("binary")
    texts = files.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content")).join(small(wanted), "digest", "left_semi")
    texts = stored(texts.groupBy("digest").agg(F.any_value("content").alias("content")), "contents")
    done, begin, width = None, HEAD, FIRST_RANGE
    while not open_.isEmpty():
        part = texts.select("digest", F.substring("content", begin + 1, width).alias("part"))
        found = open_.join(_side(part, "a"), "a_digest").join(_side(part, "b"), "b_digest")
        at = first_different_byte(F.col("a_part"), F.col("b_part")).cast("long") + begin
        found = stored(found.select("a_digest", "b_digest", at.alias("first_diff")), "compared")
        now = found.where("first_diff is not null")
        done = now if done is None else done.union(now)
        open_ = found.where("first_diff is null").select("a_digest", "b_digest")
        begin, width = begin + width, 8 * width
    return done
