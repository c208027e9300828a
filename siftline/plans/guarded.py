"""Registered queries of guarded scans, admission, window lists and effects of events, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import admission as A
from ..operators import effects as E
from ..operators import presence as P
from ..schema import DAY
from ..sources import catalog as S
from .queries import _EV, _events, _files, _list, query
from .upkeep import NOW

# Scans: root 1 misses every twentieth file and has unreadable ones, root 2 misses every third, root 3 was seen as another root.

_SCAN, _OLD = NOW - 5 * DAY, NOW - 100 * DAY
_WALK = f"""y AS (SELECT *, CASE root_id WHEN 1 THEN id % 20 = 0 WHEN 2 THEN id % 3 = 0 ELSE false END AS hidden, root_id = 1 AND id % 20 = 10 AS unread FROM c),
k AS (SELECT root_id, count_if(state <> 'gone') AS known, count(DISTINCT CASE WHEN NOT hidden AND NOT unread THEN ino END) AS seen, count_if(unread) AS errors FROM y GROUP BY 1),
b AS (SELECT k.*, CASE WHEN root_id = 3 THEN 'root_changed' WHEN seen = 0 THEN 'nothing_seen'
  WHEN seen * 100 < known * CASE kind WHEN 'remote' THEN 75 ELSE 90 END THEN 'too_few' END AS blocked FROM k JOIN r USING (root_id))"""


def _conclusion(spark, d):
    f = _files(spark, d)
    hidden = F.when(F.col("root_id") == 1, F.col("id") % 20 == 0).when(F.col("root_id") == 2, F.col("id") % 3 == 0).otherwise(False)
    unread = (F.col("root_id") == 1) & (F.col("id") % 20 == 10)
    read = f.where(~hidden).select("root_id", "rel_path", F.lit(False).alias("folder"), "sub_id", "ino", F.when(unread, 5).alias("errno"), F.lit(True).alias("counts"))
    roots = S.roots(spark).select("root_id", "kind", F.lit("01").alias("sub_id"), F.lit(-1).cast("long").alias("ino"))
    own = roots.select("root_id", F.lit("").alias("rel_path"), F.lit(True).alias("folder"), "sub_id", F.when(F.col("root_id") == 3, -2).otherwise(-1).cast("long").alias("ino"), F.lit(None).cast("int").alias("errno"), F.lit(True).alias("counts"))
    records = roots.select("root_id", F.lit(None).cast("long").alias("seen_before"))
    return P.conclude(read.unionByName(own), roots, f, records, _SCAN, _OLD)


@query("SELECT root_id, known, seen, errors, blocked FROM b", _WALK)
def scan_verdicts(spark, d):
    return _conclusion(spark, d)["verdicts"].select("root_id", "known", "seen", "errors", "blocked")


@query(
    f"""SELECT id, state AS prev_state FROM y JOIN b USING (root_id) WHERE blocked IS NULL AND hidden AND state NOT IN ('missing', 'gone') AND updated_at < {_SCAN}
  AND NOT EXISTS (FROM y u WHERE u.unread AND u.root_id = y.root_id AND u.rel_path = y.rel_path)""",
    _WALK,
)
def scan_missing(spark, d):
    return _conclusion(spark, d)["missing"]


# Admission: the events as arrivals, with room for some of them.

_MOST, _PER = 5000, 40


@query(
    f"""SELECT seq, uid, coalesce(admitted, false) AS admitted FROM i LEFT JOIN (SELECT seq, true AS admitted FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS k
  FROM (SELECT i.seq, row_number() OVER (PARTITION BY i.uid ORDER BY i.seq) + coalesce(n, 0) AS place FROM i LEFT JOIN h ON h.uid = i.uid) WHERE place <= {_PER})
  WHERE k <= {_MOST} - (SELECT sum(n) FROM h)) USING (seq)""",
    f"{_EV}, i AS (SELECT seq, user_id AS uid FROM e), h AS (SELECT user_id AS uid, user_id % 30 AS n FROM e GROUP BY 1)",
)
def admission(spark, d):
    arrivals = _events(spark, d).select("seq", F.col("user_id").alias("uid"))
    pending = arrivals.select("uid").distinct().select("uid", (F.col("uid") % 30).alias("n"))
    return A.admit(arrivals, pending, _MOST, _PER)


# Window lists, over times of two years in a zone with clock changes.

_ZONE, _LIST = "Europe/Berlin", ((60, 360), (1350, 1425), (1320, 30))
_INSIDE = " OR ".join(f"m >= {a} AND m < {b}" if a < b else f"m >= {a} OR m < {b}" for a, b in _LIST)
_STARTS = ", ".join(f"epoch_ms(timezone('{_ZONE}', date_trunc('day', l) + INTERVAL {a + 1440 * n} MINUTE))" for a, _ in _LIST for n in (0, 1))


@query(
    f"SELECT id, inside, CASE WHEN NOT inside THEN list_min(list_filter([{_STARTS}], lambda s: s > t)) END AS next_start FROM (SELECT *, {_INSIDE} AS inside FROM w)",
    f"""w AS (SELECT *, hour(l) * 60 + minute(l) AS m FROM (SELECT id, t, timezone('{_ZONE}', make_timestamptz(t * 1000)) AS l
  FROM (SELECT id, 1742600000000 + id * 61000000 % 63072000000 AS t FROM c)))""",
)
def heavy_windows(spark, d):
    f = _files(spark, d).select("id", F.expr("1742600000000 + id * 61000000 % 63072000000").alias("t"))
    inside, start = W.heavy_window(F.col("t"), list(_LIST), _ZONE)
    return f.select("id", inside.alias("inside"), start.alias("next_start"))


# Effects: an event for every catalog row, with what stands at its place now.

_KINDS = ("closed", "moved_in", "modified", "removed_unknown", "removed", "renamed", "created_dir", "needs_rescan")
_STATUS = ("file", "gone", "file", "folder", "retry", "ignore", "file")
_EXCLUDED = ["@eaDir", ".Trash-*", "#recycle"]
_HIT = f"""v AS (SELECT id AS seq, [{_list(_KINDS)}][id % 8 + 1] AS kind, root_id, CASE WHEN id % 8 = 5 THEN 'n/' || rel_path ELSE rel_path END AS path,
  CASE WHEN id % 8 = 5 THEN rel_path END AS source, [{_list(_STATUS)}][id % 7 + 1] AS status, ino + CASE WHEN id % 3 = 0 THEN 90000000 ELSE 0 END AS there, ino, state,
  regexp_matches(CASE WHEN id % 8 = 5 THEN 'n/' || rel_path ELSE rel_path END, '(^|/)(@eaDir|#recycle|\\.Trash-[^/]*)(/|$)') AS shut,
  regexp_extract(rel_path, '[^/]*$') AS name FROM c),
z AS (SELECT *, shut OR regexp_matches(name, '^\\..*\\.[A-Za-z0-9]{{6}}$') OR regexp_matches(name, '\\.ocTransferId[0-9]+\\.part$') OR regexp_matches(name, '(?i)\\.(part|crdownload|filepart|partial|download|tmp)$')
  OR (starts_with(name, '.syncthing.') AND ends_with(name, '.tmp')) OR starts_with(name, '._') OR starts_with(name, '~$') OR NOT regexp_matches(name, '(?i)^.+\\.(mp4|mkv|mov)$') AS barred FROM v),
t AS (SELECT *, there = ino AS known, CASE WHEN kind = 'renamed' OR state IN ('missing', 'gone') OR there = ino THEN ['upsert'] ELSE ['missing_at', 'upsert'] END AS take FROM z),
a AS (SELECT *, CASE kind
  WHEN 'closed' THEN CASE WHEN barred THEN [] WHEN status = 'file' THEN take WHEN status = 'retry' THEN ['retry'] ELSE [] END
  WHEN 'moved_in' THEN CASE WHEN shut THEN [] WHEN status = 'file' THEN CASE WHEN barred THEN [] ELSE take END WHEN status = 'folder' THEN ['walk'] WHEN status = 'retry' THEN ['retry'] ELSE [] END
  WHEN 'modified' THEN CASE WHEN status = 'file' AND known AND state = 'settling' THEN ['push_ready'] WHEN status = 'retry' THEN ['retry'] ELSE [] END
  WHEN 'removed_unknown' THEN CASE status WHEN 'gone' THEN ['missing_at', 'missing_under'] WHEN 'file' THEN CASE WHEN barred THEN [] ELSE take END WHEN 'folder' THEN CASE WHEN shut THEN [] ELSE ['walk'] END WHEN 'retry' THEN ['retry'] ELSE [] END
  WHEN 'removed' THEN ['missing_at']
  WHEN 'renamed' THEN CASE WHEN shut THEN ['missing_at', 'missing_under'] WHEN status = 'file' AND barred THEN ['missing_at', 'missing_under']
    WHEN status = 'file' AND known THEN CASE WHEN state = 'missing' THEN ['rename', 'restore', 'missing_at', 'missing_under'] ELSE ['rename', 'missing_at', 'missing_under'] END
    WHEN status = 'file' THEN list_concat(['missing_at', 'missing_under'], take) WHEN status = 'gone' THEN ['missing_at', 'missing_under'] WHEN status = 'folder' THEN ['rename_prefix'] WHEN status = 'retry' THEN ['retry'] ELSE [] END
  WHEN 'created_dir' THEN CASE WHEN shut THEN [] ELSE ['walk'] END ELSE ['rescan'] END AS acts FROM t)"""


@query(
    """SELECT seq, (step - 1)::INT AS step, acts[step] AS action,
  CASE WHEN kind = 'renamed' AND acts[step] IN ('missing_at', 'missing_under') THEN source ELSE path END AS path
FROM a, LATERAL (SELECT unnest(range(1, len(acts) + 1)) AS step)""",
    _HIT,
)
def event_effects(spark, d):
    f, n = _files(spark, d), F.col("id") % 8
    pick = lambda names, m: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("id") % m + 1).cast("int"))
    path = F.when(n == 5, F.concat(F.lit("n/"), "rel_path")).otherwise(F.col("rel_path"))
    none = F.lit(None)
    events = f.select(F.col("id").alias("seq"), pick(_KINDS, 8).alias("kind"), "root_id", path.alias("path"), F.when(n == 5, F.col("root_id")).alias("from_root_id"), F.when(n == 5, F.col("rel_path")).alias("from_path"))
    status, there = pick(_STATUS, 7), F.expr("ino + if(id % 3 = 0, 90000000, 0)")
    file = lambda c: F.when(F.col("status") == "file", c)
    at = f.withColumn("status", status).select("root_id", path.alias("path"), "status", file(F.col("sub_id")).alias("sub_id"), file(there).alias("ino"), file(F.lit(500)).cast("long").alias("size"), file(F.col("owner_uid")).cast("long").alias("uid"))
    source = f.where(n == 5).select("root_id", F.col("rel_path").alias("path"), F.lit("gone").alias("status"), *(none.cast(k).alias(c) for c, k in (("sub_id", "string"), ("ino", "long"), ("size", "long"), ("uid", "long"))))
    return E.effects(events, f, at.unionByName(source), _EXCLUDED, 200).select("seq", "step", "action", "path")
