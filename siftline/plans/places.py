"""Registered queries of roots, volumes, notes, the status and single pairs, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import system as Y
from ..operators import dedupe as D
from ..operators import events as E
from ..operators import filters as P
from ..operators import places as L
from ..operators import retry as R
from ..operators import status as T
from ..operators import steps
from ..schema import EXCLUDED, QUEUED, STATES
from ..sources import catalog as S
from .queries import _EV, _REASON, _SETTLED, MIN_SIZE, NOW, _events, _files, _list, query

# Roots: the folders of the documents are listed, a third of them with an id; one root that is there is listed twice.

_FOLDERS = "SELECT min(doc_id) AS pos, concat('/volume1/', lang, '/', source) AS path FROM documents GROUP BY lang, source"
_WISH = f"""SELECT pos, CASE WHEN pos % 3 = 0 THEN pos % 20 ELSE 0 END AS id, path, 'local' AS kind, concat('folder ', pos % 7) AS label, {NOW} + pos AS added_at FROM folders
UNION ALL SELECT -1, 9, '/volume1/video', 'local', 'films', {NOW} UNION ALL SELECT 1000000000, 0, '/volume1/video', 'remote', 'far away', {NOW}"""


@query(
    "SELECT coalesce(given, (SELECT max(given) FROM g) + row_number() OVER (PARTITION BY given IS NULL ORDER BY pos)) AS id, path, kind, label, added_at FROM g",
    f"""folders AS ({_FOLDERS}), n AS ({_WISH}), f AS (SELECT path, arg_min(id, pos) AS asked, arg_min(added_at, pos) AS added, arg_max(kind, pos) AS kind, arg_max(label, pos) AS label, min(pos) AS pos FROM n GROUP BY 1),
b AS (SELECT r.root_id AS old, coalesce(r.path, f.path) AS path, coalesce(f.kind, r.kind) AS kind, coalesce(f.label, r.label) AS label, CASE WHEN r.path IS NULL THEN f.added ELSE root_id * 1000 END AS added_at, asked, pos FROM r FULL JOIN f ON f.path = r.path),
g AS (SELECT *, CASE WHEN old IS NOT NULL THEN old WHEN asked > 0 AND asked NOT IN (SELECT root_id FROM r) AND row_number() OVER (PARTITION BY asked, old IS NULL ORDER BY pos) = 1 THEN asked END AS given FROM b)""",
)
def root_ids(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    folders = docs.groupBy(F.concat(F.lit("/volume1/"), "lang", F.lit("/"), "source").alias("path")).agg(F.min("doc_id").alias("pos"))
    wish = folders.selectExpr("pos", "CASE WHEN pos % 3 = 0 THEN pos % 20 ELSE 0 END AS id", "path", "'local' AS kind", "concat('folder ', pos % 7) AS label", f"{NOW} + pos AS added_at")
    twice = spark.sql(f"SELECT * FROM VALUES (-1L, 9L, '/volume1/video', 'local', 'films', {NOW}L), (1000000000L, 0L, '/volume1/video', 'remote', 'far away', {NOW}L) AS t(pos, id, path, kind, label, added_at)")
    roots = S.roots(spark).selectExpr("CAST(root_id AS BIGINT) AS id", "path", "kind", "label", "CAST(root_id * 1000 AS BIGINT) AS added_at")
    return L.upsert(roots, wish.unionByName(twice), "path", once=("added_at",))


# Volumes: ten nations are there, each supplier probes that of its nation.

_PROBE = ("'mount ' || s_name", "CASE s_suppkey % 3 WHEN 0 THEN 'reflink' WHEN 1 THEN 'clone' ELSE 'none' END", "CASE WHEN s_suppkey % 4 = 0 THEN 'refused' END")


@query(
    "SELECT coalesce(o.id, 10 + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY p.first)) AS id, coalesce(o.domain, p.domain) AS domain, coalesce(p.s.mount, o.mount) AS mount, coalesce(p.s.backend, 'none') AS backend, p.s.error AS error FROM o FULL JOIN p ON p.domain = o.domain",
    f"""o AS (SELECT n_nationkey + 1 AS id, 'd' || n_nationkey AS domain, n_name AS mount FROM nation WHERE n_nationkey < 10),
p AS (SELECT 'd' || s_nationkey AS domain, min(s_suppkey) AS first, arg_max({{'mount': {_PROBE[0]}, 'backend': {_PROBE[1]}, 'error': {_PROBE[2]}}}, s_suppkey) AS s FROM supplier GROUP BY 1)""",
)
def volume_upsert(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 10")
    there = nations.selectExpr("CAST(n_nationkey AS BIGINT) + 1 AS id", "'d' || n_nationkey AS domain", "n_name AS mount", "'none' AS backend", "CAST(NULL AS STRING) AS error")
    probes = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS pos", "0L AS id", "'d' || s_nationkey AS domain", f"{_PROBE[0]} AS mount", f"{_PROBE[1]} AS backend", f"{_PROBE[2]} AS error")
    return L.upsert(there, probes, "domain")


# Notes: new ones name groups up to 60, of which those of the catalog are there.


@query(
    """SELECT coalesce(o.group_id, n.group_id) AS group_id, coalesce(n.handled_at, o.handled_at) AS handled_at, coalesce(n.note, o.note) AS note, false AS refused FROM o FULL JOIN (SELECT group_id, max(handled_at) AS handled_at, arg_max(note, handled_at) AS note FROM w WHERE group_id IN (SELECT group_id FROM g) GROUP BY 1) n ON n.group_id = o.group_id
UNION ALL SELECT group_id, handled_at, note, true FROM w WHERE group_id NOT IN (SELECT group_id FROM g)""",
    "g AS (SELECT DISTINCT group_id FROM c WHERE group_id IS NOT NULL), o AS (SELECT group_id, 0 AS handled_at, 'old' AS note FROM g WHERE group_id % 2 = 0), w AS (SELECT id % 60 AS group_id, id AS handled_at, 'by ' || owner_uid AS note FROM c WHERE id % 5 = 0)",
)
def note_set(spark, d):
    f = _files(spark, d)
    groups = f.where("group_id is not null").select("group_id").distinct()
    old = groups.where("group_id % 2 = 0").selectExpr("group_id", "0L AS handled_at", "'old' AS note")
    new = f.where("id % 5 = 0").selectExpr("id % 60 AS group_id", "id AS handled_at", "'by ' || owner_uid AS note", "id AS pos")
    notes, refused = L.set_notes(old, new, groups)
    return notes.withColumn("refused", F.lit(False)).union(refused.select("group_id", "handled_at", "note", F.lit(True).alias("refused")))


# The status

_QUEUE = f"state IN ({_list(QUEUED)})"
_STATUS = f"""SELECT 1 AS section, 1 AS place, 'files' AS name, '' || count(*) AS value FROM c UNION ALL SELECT 1, 2, 'ready', '' || count_if({_QUEUE} AND ready_at IS NOT NULL) FROM c
UNION ALL SELECT 1, 3, 'asleep', '' || count(*) FROM c WHERE {_QUEUE} AND ready_at IS NULL HAVING count(*) > 0
UNION ALL SELECT 2, list_position([{_list(STATES)}], state), state, '' || count(*) FROM c GROUP BY state
UNION ALL SELECT 3, 1, 'groups', '' || count(DISTINCT group_id) FROM c UNION ALL SELECT 3, 2, 'events', '' || count(*) FROM e
UNION ALL SELECT 3, 3, 'open journal', '' || count(*) FROM c WHERE id % 7 < 2 HAVING count(*) > 0
UNION ALL SELECT 4, root_id * 3, path, CASE kind WHEN 'remote' THEN 'remote, read only' ELSE kind END FROM r
UNION ALL SELECT 4, root_id * 3 + 1, 'phase', CASE WHEN root_id = 3 THEN 'not scanned yet' ELSE 'a' END FROM r
UNION ALL SELECT 4, root_id * 3 + 2, 'scanned up to', max(rel_path) FROM c WHERE root_id < 3 GROUP BY root_id
UNION ALL SELECT 5, 0, 'volumes', 'not probed yet'"""


@query(f"SELECT section, CAST(place AS BIGINT) AS place, name, value FROM ({_STATUS})", _EV)
def status_report(spark, d):
    f = _files(spark, d)
    journal = f.select(F.element_at(F.array(F.lit("open"), F.lit("sent"), F.lit("done")), F.least(F.col("id") % 7, F.lit(2)).cast("int") + 1).alias("state"))
    progress = f.where("root_id < 3").groupBy("root_id").agg(F.lit("a").alias("phase"), F.max("rel_path").alias("last_dir"))
    volumes = spark.createDataFrame([], "id long, mount string, backend string, error string")
    return T.status_lines(f, f.select("group_id"), _events(spark, d), journal, S.roots(spark), progress, volumes)


# Disks

_OWN = "CASE WHEN seq % 11 <> 0 THEN seq * 7 % 30000 END"


@query(
    """SELECT dev, ts_ms, util, util * (1 - CASE WHEN device > 0 THEN least(1.0, own / device) ELSE 0 END) AS util_other FROM (SELECT dev, ts_ms, CASE WHEN ms > 0 THEN least(1.0, greatest(ticks, 0) / ms) END AS util, greatest(sectors, 0) * 512.0 AS device, greatest(own, 0) * 1.0 AS own
FROM (SELECT dev, ts_ms, CAST(ts_ms - lag(ts_ms) OVER w AS DOUBLE) AS ms, ticks - lag(ticks) OVER w AS ticks, sectors - lag(sectors) OVER w AS sectors, own - lag(own) OVER w AS own FROM s WINDOW w AS (PARTITION BY dev ORDER BY ts_ms)))""",
    f"{_EV}, s AS (SELECT user_id AS dev, ts_ms, seq * 20000 % 900000007 AS ticks, seq % 100 AS sectors, coalesce({_OWN}, 0) AS own FROM e)",
)
def disk_load_others(spark, d):
    s = _events(spark, d).selectExpr("user_id AS dev", "ts_ms", "seq * 20000 % 900000007 AS ticks", "seq % 100 AS sectors", f"{_OWN} AS own_bytes")
    return E.load_of_others(s)


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE size END + CASE WHEN id % 5 = 0 THEN 0 ELSE id * 3 END AS own FROM c")
def own_io(spark, d):
    text = F.concat(F.format_string("rchar: %d\nwchar: 7\n", F.col("id")), F.when(F.col("id") % 4 != 0, F.format_string("read_bytes: %d\n", "size")).otherwise("read_bytes: none\n"), F.when(F.col("id") % 5 != 0, F.format_string("write_bytes: %d", F.col("id") * 3)).otherwise(""))
    return _files(spark, d).select("id", Y.own_bytes(text).alias("own"))


# Candidates within a scope

_SCOPED = "SELECT a.id AS me, b.id AS id, row_number() OVER (PARTITION BY a.id ORDER BY b.mtime_ns, b.first_seen_at, b.id) AS rank FROM c a JOIN c b ON a.domain_id = b.domain_id AND a.size = b.size AND a.{0} = b.{0} AND a.id <> b.id WHERE a.state IN ('sized', 'distinct') AND b.state IN ('sized', 'distinct') AND b.nlink = 1 AND b.mtime_ns <= {1} QUALIFY rank <= 3"


@query(_SCOPED.format("owner_uid", _SETTLED))
def candidates_of_owner(spark, d):
    return D.candidates(_files(spark, d), _SETTLED, 3, D.SCOPES["owner"]).withColumn("rank", F.col("rank").cast("long"))


@query(_SCOPED.format("root_id", _SETTLED))
def candidates_of_share(spark, d):
    return D.candidates(_files(spark, d), _SETTLED, 3, D.SCOPES["share"]).withColumn("rank", F.col("rank").cast("long"))


# All reasons of a pair: one digit of the hash, so that pairs of equal hash and other bytes are among them.

@query(
    f"""SELECT a, b, a_reason, b_reason, same_size, CASE WHEN same_size THEN am END AS a_magic, CASE WHEN same_size THEN bm END AS b_magic, CASE WHEN same_size THEN ah = bh END AS same_hash, CASE WHEN same_size AND ah = bh AND ac <> bc THEN CAST(list_position(list_transform(list_zip(regexp_extract_all(hex(encode(ac)), '..'), regexp_extract_all(hex(encode(bc)), '..')), lambda x: x[1] IS DISTINCT FROM x[2]), true) - 1 AS BIGINT) END AS first_diff,
  CASE WHEN NOT same_size THEN 'other_size' WHEN ah <> bh THEN 'other_hash' WHEN ac <> bc THEN 'other_bytes' WHEN a_reason IS NOT NULL OR b_reason IS NOT NULL OR am = 'mismatch' OR bm = 'mismatch' THEN 'ignored' ELSE 'same' END AS verdict
FROM (SELECT a.id AS a, b.id AS b, a.reason AS a_reason, b.reason AS b_reason, a.size = b.size AS same_size, a.magic AS am, b.magic AS bm, a.hash AS ah, b.hash AS bh, a.content AS ac, b.content AS bc FROM x a JOIN x b ON (b.id = a.id + 1 OR b.size = a.size AND a.id < b.id))""",
    f"x AS (SELECT id, CASE WHEN id % 2 = 0 THEN {_REASON} END AS reason, size, CASE WHEN id % 13 = 0 THEN 'mismatch' WHEN id % 13 = 1 THEN 'unchecked' ELSE 'match' END AS magic, substring(sha256(content), 1, 1) AS hash, content FROM c)",
)
def pair_reasons(spark, d):
    f = _files(spark, d)
    reason = F.when(F.col("id") % 2 == 0, P.reject_reason(F.col("rel_path"), F.col("size"), EXCLUDED, MIN_SIZE))
    magic = F.when(F.col("id") % 13 == 0, "mismatch").when(F.col("id") % 13 == 1, "unchecked").otherwise("match")
    f = f.select("id", reason.alias("reason"), "size", magic.alias("magic"), F.substring(H.full_hash(F.col("content")), 1, 1).alias("hash"), "content")
    return steps.all_reasons(steps.peers(f), f)


# One step of the queue of events that are tried again: a third of the catalog waits, a third has failed since.

_LATE = f"{NOW} + id % 7 * 500 - 1500"


@query(
    f"""SELECT id AS seq, attempts, {_LATE} AS not_before, CASE WHEN {_LATE} <= {NOW} THEN 'again' ELSE 'waits' END AS action FROM c WHERE id % 3 = 0
UNION ALL SELECT seq, CASE action WHEN 'waits' THEN attempts + 1 ELSE attempts END, CASE action WHEN 'waits' THEN failed_at + 1000 END, action FROM (SELECT *, CASE WHEN attempts >= 5 THEN 'given_up' WHEN place <= 100 - (SELECT count(*) FROM c WHERE id % 3 = 0 AND {_LATE} > {NOW}) THEN 'waits' ELSE 'rescan' END AS action
  FROM (SELECT id AS seq, attempts, {NOW} - id AS failed_at, row_number() OVER (PARTITION BY attempts >= 5 ORDER BY id) AS place FROM c WHERE id % 3 = 1))"""
)
def retry_step(spark, d):
    f = _files(spark, d)
    event = ["id AS seq", "CAST(root_id AS BIGINT) AS root_id", "rel_path AS path", "attempts"]
    waiting = f.where("id % 3 = 0").selectExpr(*event, f"{_LATE} AS not_before")
    failed = f.where("id % 3 = 1").selectExpr(*event, f"{NOW} - id AS failed_at")
    return R.step(waiting, failed, NOW, room=100).select("seq", "attempts", "not_before", "action")
