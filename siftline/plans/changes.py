"""Registered queries of what a change of the tree does: coalesced events, paired halves, places in roots, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coalesce as K
from ..operators import pairing as A
from ..operators import prefixes as X
from ..sources import catalog as S
from .queries import _EV, _events, _files, _list, query

_HOURS = 8 * 3_600_000
_KINDS = ("modified", "closed", "modified", "renamed", "modified", "removed", "closed", "moved_in", "modified", "removed_dir", "created_dir", "needs_rescan")

_PLACED = f"""{_EV},
t AS (SELECT 1 + seq % 2 AS root_id, CASE WHEN seq * 7919 % 12 <> 11 THEN 'p' || user_id % 10 END AS path, ts_ms, seq,
  [{_list(_KINDS)}][seq * 7919 % 12 + 1] AS kind, CASE WHEN seq * 7919 % 12 = 3 THEN 'q' || seq END AS from_path FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY root_id, path ORDER BY ts_ms, seq) AS k FROM t WHERE path IS NOT NULL),
st AS (
  SELECT root_id, path, k, ts_ms AS first_ms, [struct_pack(kind := kind, from_path := from_path, seq := seq)] AS kept, 1 AS n FROM o WHERE k = 1
  UNION ALL
  SELECT o.root_id, o.path, o.k, CASE WHEN o.ts_ms - st.first_ms >= {_HOURS} THEN o.ts_ms ELSE st.first_ms END,
    CASE WHEN o.ts_ms - st.first_ms >= {_HOURS} THEN [x.x]
      WHEN o.kind = 'modified' AND st.kept[-1].kind <> 'modified' THEN st.kept
      WHEN st.kept[-1].kind = 'modified' OR len(st.kept) >= 8 OR (st.kept[-1].kind = o.kind AND o.kind NOT IN ('renamed', 'renamed_dir', 'removed_dir'))
        THEN list_append(st.kept[1:len(st.kept) - 1], x.x)
      ELSE list_append(st.kept, x.x) END,
    CASE WHEN o.ts_ms - st.first_ms >= {_HOURS} THEN 1 ELSE st.n + 1 END
  FROM st JOIN o ON o.root_id = st.root_id AND o.path = st.path AND o.k = st.k + 1,
    LATERAL (SELECT struct_pack(kind := o.kind, from_path := o.from_path, seq := o.seq) AS x) x),
z AS (SELECT *, row_number() OVER (PARTITION BY root_id, path, first_ms ORDER BY k DESC) AS back FROM st)"""


@query(
    """SELECT root_id, path, first_ms, place::INT AS place, kept[place].kind AS kind, kept[place].from_path AS from_path,
  kept[place].seq AS seq, (n - len(kept))::BIGINT AS absorbed FROM z, LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS place) WHERE back = 1
UNION ALL SELECT root_id, path, ts_ms, 1, kind, from_path, seq, 0 FROM t WHERE path IS NULL""",
    _PLACED,
)
def coalesce_places(spark, d):
    e, n = _events(spark, d), F.expr("seq * 7919 % 12")
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (n + 1).cast("int"))
    path = F.when(n != 11, F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")))
    source = F.when(n == 3, F.concat(F.lit("q"), F.col("seq").cast("string")))
    return K.coalesce(e.select((1 + F.col("seq") % 2).alias("root_id"), path.alias("path"), "ts_ms", "seq", kind.alias("kind"), source.alias("from_path")), _HOURS)


# Raw changes: three of each tracker (from, to, both) by turns, some missing, some outside of all roots, some without a tracker.

_RAW = ("from", "to", "both", "close_write", "create", "modify", "delete", "open", "overflow")
_WAIT = 2 * 3_600_000
_RAWSQL = f"""{_EV},
w AS (SELECT seq, ts_ms, [{_list(_RAW)}][CASE WHEN seq % 10 < 7 THEN seq // 3 % 5 * 7 + seq % 3 ELSE seq % 6 + 3 END % 3 + CASE WHEN seq % 10 < 7 THEN 0 ELSE 3 + seq % 4 END % 7 + 1] AS raw,
  CASE WHEN seq % 10 < 7 AND seq % 13 <> 0 THEN seq // 3 END AS tracker, CASE seq % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS folder,
  CASE seq % 4 WHEN 0 THEN '/elsewhere/' WHEN 1 THEN '/volume1/video/' WHEN 2 THEN '/volume1/video/b/' ELSE '/mnt/far/' END || 'u' || user_id AS path0 FROM e WHERE seq % 17 <> 0),
v AS (SELECT seq, ts_ms, raw, tracker, folder, CASE WHEN seq % 29 = 0 THEN '/volume1/video' ELSE path0 END AS path,
  CASE WHEN raw = 'both' THEN CASE WHEN seq % 8 = 0 THEN '/elsewhere/x' ELSE '/volume1/video/b/c/n' || seq END END AS to_path FROM w),
p AS (SELECT seq, arg_max(r.root_id, length(r.path)) AS root_id, max(length(r.path)) AS n FROM v JOIN r ON v.path = r.path OR starts_with(v.path, r.path || '/') GROUP BY 1),
q AS (SELECT seq, arg_max(r.root_id, length(r.path)) AS root_id, max(length(r.path)) AS n FROM v JOIN r ON v.to_path = r.path OR starts_with(v.to_path, r.path || '/') GROUP BY 1),
l AS (SELECT v.seq, ts_ms, raw, tracker, folder, p.root_id, substring(path, p.n + 2) AS rel, q.root_id AS to_root_id, substring(to_path, q.n + 2) AS to_rel
  FROM v LEFT JOIN p ON p.seq = v.seq LEFT JOIN q ON q.seq = v.seq),
dk AS (SELECT *, CASE WHEN raw = 'overflow' OR ((raw = 'delete' OR (raw = 'from' AND tracker IS NULL)) AND rel = '') THEN 'needs_rescan' WHEN root_id IS NULL THEN NULL
  WHEN raw = 'create' THEN CASE WHEN folder THEN 'created_dir' ELSE 'closed' END WHEN raw = 'close_write' THEN 'closed' WHEN raw = 'modify' THEN 'modified'
  WHEN raw = 'delete' THEN CASE WHEN folder IS NULL THEN 'removed_unknown' WHEN folder THEN 'removed_dir' ELSE 'removed' END END AS kind FROM l),
h AS (SELECT tracker, ts_ms, seq, raw AS mode, CASE WHEN raw <> 'to' THEN root_id END AS root_id, CASE WHEN raw <> 'to' THEN rel END AS path,
  CASE raw WHEN 'to' THEN root_id WHEN 'both' THEN to_root_id END AS to_root_id, CASE raw WHEN 'to' THEN rel WHEN 'both' THEN to_rel END AS to_path, coalesce(folder, false) AS folder,
  row_number() OVER (PARTITION BY tracker ORDER BY ts_ms, seq) AS k FROM l WHERE raw IN ('from', 'to', 'both') AND tracker IS NOT NULL),
"""
#: One step of a tracker: what waits (w*), when it was paired, and the events so far.
_STEP = """(SELECT CASE WHEN {t} - {s}.wts > {w} THEN NULL ELSE {s}.wts END AS wts) a, (SELECT CASE WHEN {t} - {s}.paired > {w} THEN NULL ELSE {s}.paired END AS paired) b"""
_MOVE = """CASE WHEN {fr} IS NOT NULL AND {tr} IS NOT NULL THEN [struct_pack(at_ms := h.ts_ms, seq := h.seq, kind := CASE WHEN h.folder THEN 'renamed_dir' ELSE 'renamed' END, root_id := {tr}, path := {tp}, from_root_id := {fr}, from_path := {fp})]
  WHEN {tr} IS NOT NULL THEN [struct_pack(at_ms := h.ts_ms, seq := h.seq, kind := CASE WHEN h.folder THEN 'created_dir' ELSE 'moved_in' END, root_id := {tr}, path := {tp}, from_root_id := NULL::BIGINT, from_path := NULL::VARCHAR)]
  WHEN {fr} IS NOT NULL THEN [struct_pack(at_ms := h.ts_ms, seq := h.seq, kind := CASE WHEN h.folder THEN 'removed_dir' ELSE 'removed' END, root_id := {fr}, path := {fp}, from_root_id := NULL::BIGINT, from_path := NULL::VARCHAR)]
  ELSE [] END"""
_LONE = "[struct_pack(at_ms := {s}.wts, seq := {s}.wseq, kind := 'removed_unknown', root_id := {s}.wroot, path := {s}.wpath, from_root_id := NULL::BIGINT, from_path := NULL::VARCHAR)]"
_FOLD = f"""g AS (
  SELECT NULL::BIGINT AS tracker, 0::BIGINT AS k, NULL::BIGINT AS wts, NULL::BIGINT AS wseq, NULL::BIGINT AS wroot, NULL::VARCHAR AS wpath, NULL::BIGINT AS paired,
    []::STRUCT(at_ms BIGINT, seq BIGINT, kind VARCHAR, root_id BIGINT, path VARCHAR, from_root_id BIGINT, from_path VARCHAR)[] AS outs WHERE false
  UNION ALL SELECT DISTINCT tracker, 0, NULL, NULL, NULL, NULL, NULL, [] FROM h
  UNION ALL
  SELECT h.tracker, h.k,
    CASE WHEN h.mode = 'from' AND h.root_id IS NOT NULL THEN h.ts_ms WHEN h.mode = 'from' OR (h.mode = 'both' AND b.paired IS NOT NULL) THEN a.wts END,
    CASE WHEN h.mode = 'from' AND h.root_id IS NOT NULL THEN h.seq WHEN h.mode = 'from' OR (h.mode = 'both' AND b.paired IS NOT NULL) THEN s.wseq END,
    CASE WHEN h.mode = 'from' AND h.root_id IS NOT NULL THEN h.root_id WHEN h.mode = 'from' OR (h.mode = 'both' AND b.paired IS NOT NULL) THEN s.wroot END,
    CASE WHEN h.mode = 'from' AND h.root_id IS NOT NULL THEN h.path WHEN h.mode = 'from' OR (h.mode = 'both' AND b.paired IS NOT NULL) THEN s.wpath END,
    CASE WHEN h.mode = 'to' AND a.wts IS NOT NULL THEN h.ts_ms ELSE b.paired END,
    list_concat(list_concat(s.outs, CASE WHEN s.wts IS NOT NULL AND a.wts IS NULL THEN {_LONE.format(s="s")} ELSE [] END),
      CASE WHEN h.mode = 'from' OR (h.mode = 'both' AND b.paired IS NOT NULL) THEN []
        WHEN h.mode = 'to' AND a.wts IS NOT NULL THEN {_MOVE.format(fr="s.wroot", fp="s.wpath", tr="h.to_root_id", tp="h.to_path")}
        WHEN h.mode = 'to' THEN {_MOVE.format(fr="NULL::BIGINT", fp="NULL::VARCHAR", tr="h.to_root_id", tp="h.to_path")}
        ELSE {_MOVE.format(fr="h.root_id", fp="h.path", tr="h.to_root_id", tp="h.to_path")} END)
  FROM g s JOIN h ON h.tracker = s.tracker AND h.k = s.k + 1, LATERAL {_STEP.format(t="h.ts_ms", s="s", w=_WAIT)}),
f AS (SELECT list_concat(outs, CASE WHEN wts IS NOT NULL THEN {_LONE.format(s="g")} ELSE [] END) AS outs FROM g QUALIFY k = max(k) OVER (PARTITION BY tracker))"""


def _raw(spark, d):
    e = _events(spark, d).where("seq % 17 <> 0")
    place = F.expr("case when seq % 10 < 7 then seq div 3 % 5 * 7 + seq % 3 else seq % 6 + 3 end % 3 + case when seq % 10 < 7 then 0 else 3 + seq % 4 end % 7 + 1")
    raw = F.element_at(F.array(*(F.lit(x) for x in _RAW)), place.cast("int"))
    above = F.expr("case seq % 4 when 0 then '/elsewhere/' when 1 then '/volume1/video/' when 2 then '/volume1/video/b/' else '/mnt/far/' end")
    path = F.when(F.col("seq") % 29 == 0, "/volume1/video").otherwise(F.concat(above, F.lit("u"), F.col("user_id").cast("string")))
    to = F.when(F.col("raw") == "both", F.when(F.col("seq") % 8 == 0, "/elsewhere/x").otherwise(F.concat(F.lit("/volume1/video/b/c/n"), F.col("seq").cast("string"))))
    tracker = F.expr("case when seq % 10 < 7 and seq % 13 <> 0 then seq div 3 end")
    folder = F.expr("case seq % 5 when 0 then true when 1 then null else false end")
    return e.withColumn("raw", raw).select("seq", "ts_ms", "raw", tracker.alias("tracker"), folder.alias("folder"), path.alias("path"), to.alias("to_path"))


@query("SELECT at_ms, seq, kind, root_id, path, from_root_id, from_path FROM (SELECT unnest(outs, recursive := true) FROM f)", f"{_RAWSQL}{_FOLD}")
def paired_halves(spark, d):
    return A.pair_halves(A.halves(A.located(_raw(spark, d), S.roots(spark))), _WAIT)


@query(
    """SELECT ts_ms AS at_ms, seq, kind, CASE WHEN kind <> 'needs_rescan' THEN root_id END AS root_id, CASE WHEN kind <> 'needs_rescan' THEN rel END AS path,
  NULL::BIGINT AS from_root_id, NULL::VARCHAR AS from_path FROM dk WHERE kind IS NOT NULL""",
    _RAWSQL.rstrip().rstrip(","),
)
def direct_events(spark, d):
    return A.direct(A.located(_raw(spark, d), S.roots(spark)))


# Places in roots by equality on ancestors


@query("SELECT c.id, arg_max(r.root_id, length(r.path)) AS root_id FROM (SELECT id, '/volume1/video/' || rel_path AS p FROM c) c JOIN r ON p = r.path OR starts_with(p, r.path || '/') GROUP BY 1")
def deepest_root(spark, d):
    f = _files(spark, d).select("id", F.concat(F.lit("/volume1/video/"), "rel_path").alias("p"))
    return X.deepest(f, "p", S.roots(spark).select("root_id", "path"), "path").where("root_id is not null").select("id", "root_id")


#: Folders that are allowed: as many as there are documents whose number is divisible by seven.
_ALLOW = "a AS (SELECT DISTINCT root_id, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS dir FROM c WHERE id % 7 = 0)"


@query("SELECT id FROM c WHERE EXISTS (FROM a WHERE a.root_id = c.root_id AND (c.rel_path = a.dir OR a.dir = '' OR starts_with(c.rel_path, a.dir || '/')))", _ALLOW)
def allowed_folders(spark, d):
    f = _files(spark, d)
    folders = f.where("id % 7 = 0").select("root_id", X.parent(F.col("rel_path")).alias("dir"))
    return X.under_any(f.select("id", "root_id", "rel_path"), "rel_path", folders, "dir", ("root_id",)).select("id")
