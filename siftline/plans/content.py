"""Registered queries of comparison, the queue's rounds and commits, with their SQL for DuckDB.

Their files are the catalog's with planted copies: of each longer file two with one byte changed where the sparse hash does not look, so that
sizes and sparse hashes are equal and contents are not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import commit as M
from ..operators import groups as G
from ..operators import queue as Q
from ..operators import verify as V
from .queries import _SPARSE, CHUNKS, LENGTH, NOW, _files, query

#: Sizes of files that have planted copies, the byte that is changed, and what is added to the copies' ids.
_LEAST, _MOST, _AT, _FIRST, _SECOND = 700, 20_000, 100, 10_000_000, 20_000_000

_PLANTED = f"""b AS (SELECT id, domain_id, size, hex(encode(content)) AS x, {_SPARSE} AS hash FROM c WHERE size BETWEEN {_LEAST} AND {_MOST} AND state NOT IN ('missing', 'gone')),
t AS (SELECT id, domain_id, size, hash, x, 0 AS part FROM b
  UNION ALL SELECT id + {_FIRST}, domain_id, size, hash, substring(x, 1, {2 * _AT}) || '23' || substring(x, {2 * _AT + 3}), 1 FROM b WHERE id % 3 = 0
  UNION ALL SELECT id + {_SECOND}, domain_id, size, hash, substring(x, 1, {2 * _AT}) || '23' || substring(x, {2 * _AT + 3}), 2 FROM b WHERE id % 3 = 0)"""
#: The groups: one for each key, by its least id, and for some a second one that holds the first copy.
_GROUPS = """n AS (SELECT min(id) AS canonical_id, min(id) AS group_id, hash FROM t WHERE part = 0 GROUP BY hash),
s AS (SELECT min(id) AS canonical_id, hash FROM t WHERE part = 1 GROUP BY hash),
g AS (SELECT group_id, hash, canonical_id FROM n UNION ALL SELECT 50000000 + canonical_id, hash, canonical_id FROM s WHERE canonical_id % 2 = 0)"""


def _planted(spark, d):
    f = _files(spark, d).drop("group_id").where(f"size between {_LEAST} and {_MOST} and state not in ('missing', 'gone')")
    f = f.withColumn("hash", H.sparse_hash(F.col("content"), F.col("size"), CHUNKS, LENGTH, 1)).withColumn("content", F.encode("content", "UTF-8")).withColumn("part", F.lit(0))
    altered = F.overlay("content", F.lit(b"#"), F.lit(_AT + 1), F.lit(1))
    copies = f.where("id % 3 = 0").withColumn("content", altered)
    more = [copies.withColumn("id", F.col("id") + n).withColumn("ino", F.col("id")).withColumn("part", F.lit(p)) for p, n in ((1, _FIRST), (2, _SECOND))]
    return f.unionByName(more[0]).unionByName(more[1])


def _planted_groups(f):
    key = ("domain_id", "size", "hash")
    first = f.where("part = 0").groupBy(*key).agg(F.min("id").alias("canonical_id")).withColumn("group_id", F.col("canonical_id"))
    second = f.where("part = 1").groupBy(*key).agg(F.min("id").alias("canonical_id")).where("canonical_id % 2 = 0").withColumn("group_id", F.col("canonical_id") + 50_000_000)
    return first.unionByName(second)


_MOVES = f"""{_PLANTED}, {_GROUPS},
w AS (SELECT t.id, t.hash, t.x, n.group_id FROM t JOIN n USING (hash) WHERE t.id NOT IN (SELECT canonical_id FROM g)),
k AS (SELECT g.group_id, g.hash, g.canonical_id, t.x FROM g JOIN t ON t.id = g.canonical_id),
h AS (SELECT w.id, w.hash, w.x, min(k.group_id) AS home FROM w LEFT JOIN k ON k.hash = w.hash AND k.x = w.x GROUP BY ALL),
o AS (SELECT id, CASE WHEN home IS NULL THEN (SELECT max(group_id) FROM g) + 1 + min(id) OVER (PARTITION BY hash, x, home) ELSE home END AS group_id,
  CASE WHEN home IS NULL AND id = min(id) OVER (PARTITION BY hash, x, home) THEN 'canonical' ELSE 'verified' END AS state, hash, x, home FROM h)"""


@query("SELECT id, group_id, state FROM o", _MOVES)
def settled_members(spark, d):
    return _settled(spark, d)[0]


@query(
    f"""SELECT k.group_id, k.canonical_id AS src, o.id AS dst, false AS same, {_AT}::BIGINT AS at FROM o JOIN k ON k.hash = o.hash AND k.group_id < coalesce(o.home, 1e18)
UNION ALL SELECT o.group_id, coalesce(k.canonical_id, (SELECT min(id) FROM o b WHERE b.group_id = o.group_id)), o.id, true, NULL
  FROM o LEFT JOIN k ON k.group_id = o.home WHERE o.state = 'verified'""",
    _MOVES,
)
def comparisons(spark, d):
    return _settled(spark, d)[2]


def _settled(spark, d):
    f = _planted(spark, d)
    groups = _planted_groups(f)
    first = groups.where("group_id = canonical_id").select("domain_id", "size", "hash", "group_id")
    members = f.join(groups.select(F.col("canonical_id").alias("id")), "id", "left_anti").join(first, ["domain_id", "size", "hash"])
    return V.settle_members(members, groups, V.blocks(f.select("id", "content"), 512), 512)


# The queue, from all files settling to rest.

_REST = f"""{_PLANTED}, f AS (SELECT t.id, t.size, t.hash, t.x, t.part, c.nlink, c.mode, c.mtime_ns, c.first_seen_at, CASE WHEN t.part = 0 THEN c.ino ELSE t.id END AS ino FROM t JOIN c ON c.id = t.id % {_FIRST}),
a AS (SELECT *, CASE WHEN id % 31 = 0 THEN 'missing' WHEN id % 37 = 0 THEN 'settling' WHEN nlink > 1 THEN 'skipped' WHEN (mode & 3072) <> 0 THEN 'skipped'
  WHEN id % 41 = 0 THEN 'skipped' WHEN id % 43 = 0 THEN 'settling' ELSE 'sized' END AS state,
  CASE WHEN id % 31 = 0 OR id % 37 = 0 THEN NULL WHEN nlink > 1 THEN 'hardlink' WHEN (mode & 3072) <> 0 THEN 'special_mode' WHEN id % 41 = 0 THEN 'bad_magic'
  WHEN id % 43 = 0 THEN 'suspect_partial' END AS skip_reason FROM f),
q AS (SELECT size + CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END AS size FROM a WHERE state = 'settling'),
l AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n, first_value(x) OVER w AS x0, first_value(id) OVER w AS id0 FROM a WHERE state = 'sized' AND size NOT IN (SELECT size FROM q)
  WINDOW w AS (PARTITION BY hash ORDER BY mtime_ns, first_seen_at, ino, id))"""


@query(
    """SELECT id, state, skip_reason FROM a WHERE state <> 'sized' OR size IN (SELECT size FROM q)
UNION ALL SELECT id, CASE WHEN n = 1 THEN 'distinct' WHEN id = id0 THEN 'canonical' WHEN x = x0 THEN 'verified'
  WHEN id = min(id) OVER (PARTITION BY hash, x) THEN 'canonical' ELSE 'verified' END, NULL FROM l""",
    _REST,
)
def drained_queue(spark, d):
    f = _planted(spark, d)
    files = f.select(
        "id", "domain_id", "size", "mtime_ns", "ctime_ns", "nlink", "mode", "ino", "first_seen_at", F.lit("settling").alias("state"), F.lit(None).cast("string").alias("prev_state"),
        F.lit(NOW - 1).alias("ready_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("group_id"),
    )
    new = F.when(F.col("id") % 37 == 0, 1).otherwise(0)
    observed = f.select("id", (F.col("id") % 31 == 0).alias("gone"), F.lit(False).alias("error"), (F.col("size") + new).alias("size"), "mtime_ns", "ctime_ns", F.when(F.col("id") % 41 == 0, "mismatch").alias("magic"), (F.col("id") % 43 == 0).alias("hole"))
    groups = spark.createDataFrame([], "group_id long, domain_id string, size long, hash string, canonical_id long")
    out = Q.drain(files, groups, f.select("id", "content"), observed, Q.Settings(NOW, chunks=CHUNKS, length=LENGTH, align=1, block=4096))
    return out[0].select("id", "state", "skip_reason")


# Commits: a transition for every third file, half of them against another state than the file's.

_BATCH = f"""u AS (SELECT id AS seq, id, CASE WHEN id % 2 = 0 THEN state ELSE 'deduped' END AS "from", CASE id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'skipped' ELSE state END AS "to",
  CASE WHEN id % 5 = 0 THEN 'none' WHEN id % 5 = 1 THEN 'ready' ELSE 'reason' END AS put, id % 7 AS op, id + 1 AS other FROM c WHERE id % 3 = 0),
y AS (SELECT u.*, c.state = u."from" AS applied FROM u JOIN c ON c.id = u.id),
x AS (SELECT y.seq, y.other AS id FROM y JOIN c ON c.id = y.other WHERE applied AND c.state = 'sized' AND y.other NOT IN (SELECT id FROM u))"""


def _batch(spark, d):
    f = _files(spark, d)
    patch = F.when(F.col("id") % 5 == 0, F.create_map().cast("map<string,string>")).when(F.col("id") % 5 == 1, F.create_map(F.lit("ready_at"), F.lit(str(NOW)))).otherwise(F.create_map(F.lit("skip_reason"), F.lit(None).cast("string"), F.lit("group_id"), F.lit("7")))
    op = F.when(F.col("id") % 7 == 0, F.struct(F.lit(G.JOIN).alias("kind"), F.lit(1).cast("long").alias("group_id"), F.lit(None).cast("long").alias("other_id"), F.lit(None).cast("string").alias("hash")))
    empty = F.create_map().cast("map<string,string>")
    others = F.array(F.struct((F.col("id") + 1).alias("id"), F.lit("sized").alias("from"), F.lit("distinct").alias("to"), empty.alias("patch")))
    event = F.struct((F.lit(NOW) + F.col("id")).alias("ts"), F.col("id").alias("file_id"))
    frm = F.when(F.col("id") % 2 == 0, F.col("state")).otherwise("deduped")
    to = F.when(F.col("id") % 4 == 0, "verified").when(F.col("id") % 4 == 1, "skipped").otherwise(F.col("state"))
    batch = f.where("id % 3 = 0").select(F.col("id").alias("seq"), "id", frm.alias("from"), to.alias("to"), patch.alias("patch"), others.alias("others"), op.alias("op"), event.alias("event"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("journal_id"), F.lit("done").alias("journal_state"))
    files = f.select("id", "size", "state", "updated_at", "ready_at", "priority", "attempts", "last_error", "skip_reason", F.lit(None).cast("string").alias("sparse_hash"), "group_id", "prev_state", "heavy_wait_since")
    groups = f.where("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.min("size").alias("size"), F.lit("s").alias("sparse_hash"), F.min("id").alias("canonical_file_id"), F.lit(None).cast("long").alias("verified_at"), F.lit(None).cast("string").alias("full_hash"), F.lit(NOW).alias("created_at"))
    journal = f.select("id", F.lit("planned").alias("state"), "updated_at")
    events = f.where("id % 2 = 0").select("updated_at", F.col("id").alias("file_id")).select(F.col("updated_at").alias("ts"), "file_id", F.lit(None).cast("string").alias("note"))
    return files, groups, journal, events, batch


@query(
    f"""SELECT c.id, CASE WHEN y.applied THEN y."to" WHEN x.id IS NOT NULL THEN 'distinct' ELSE c.state END AS state,
  CASE WHEN y.applied OR x.id IS NOT NULL THEN {NOW} ELSE c.updated_at END AS updated_at,
  CASE WHEN y.applied AND put = 'ready' THEN {NOW} ELSE c.ready_at END AS ready_at, CASE WHEN y.applied AND put = 'reason' THEN NULL ELSE c.skip_reason END AS skip_reason,
  CASE WHEN y.applied AND op = 0 THEN 1 WHEN y.applied AND put = 'reason' THEN 7 ELSE c.group_id END AS group_id,
  CASE WHEN (y.applied AND y."from" <> y."to") OR x.id IS NOT NULL THEN NULL ELSE c.heavy_wait_since END AS heavy_wait_since
FROM c LEFT JOIN y ON y.id = c.id LEFT JOIN x ON x.id = c.id""",
    _BATCH,
)
def committed_files(spark, d):
    return M.apply(*_batch(spark, d), NOW)["files"].select("id", "state", "updated_at", "ready_at", "skip_reason", "group_id", "heavy_wait_since")


@query(
    f"SELECT updated_at AS ts, id AS file_id, NULL::VARCHAR AS note FROM c WHERE id % 2 = 0 UNION ALL SELECT {NOW} + id, id, CASE WHEN NOT applied THEN 'state_raced' END FROM y",
    _BATCH,
)
def committed_events(spark, d):
    return M.apply(*_batch(spark, d), NOW)["events"]
