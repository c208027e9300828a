"""The registered queries of the catalog engine, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import parse_window
from ..functions import hashing as H
from ..functions import scalars as X
from ..operators import catalog as C
from ..operators import dedupe as D
from ..operators import events as E
from ..operators import filters as P
from ..operators import groups as G
from ..operators import ledger as L
from ..operators import prefixes as T
from ..operators import recovery as R
from ..schema import ERRNO_POLICY, EXCLUDED, EXTENSIONS, IN_GROUP, QUEUED, RULES, STATES
from ..sources import catalog as S

NOW, CHUNKS, LENGTH, MIN_SIZE = S.NOW, 4, 64, 200
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_C = f"c AS ({S.sql('CAST(strlen(text) AS BIGINT)')})"
_R = f"r(root_id, path, kind, label) AS (SELECT * FROM {S.ROOTS})"


def query(sql: str | None = None, head: str = ""):
    """Registers a function by its name; sql stands after the catalog ``c`` and the roots ``r``."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH RECURSIVE {_C}, {_R}{', ' + head if head else ''} {sql}"
        return f

    return add


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return S.catalog(spark, d)


# Filters

_NAME = "regexp_extract(rel_path, '[^/]*$')"
_EXTSQL = f"CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]+$') THEN lower(regexp_extract({_NAME}, '\\.([^.]+)$', 1)) END"
_TEMP = (
    f"(regexp_matches({_NAME}, '^\\..*\\.[A-Za-z0-9]{{6}}$') OR regexp_matches({_NAME}, '\\.ocTransferId[0-9]+\\.part$') OR regexp_matches({_NAME}, '(?i)\\.(part|crdownload|filepart|partial|download|tmp)$')"
    f" OR (starts_with({_NAME}, '.syncthing.') AND ends_with({_NAME}, '.tmp')) OR starts_with({_NAME}, '._') OR starts_with({_NAME}, '~$'))"
)
_EXCL = f"(list_has_any(string_split(rel_path, '/'), [{_list(x for x in EXCLUDED if not x.endswith('*'))}]) OR len(list_filter(string_split(rel_path, '/'), lambda p: starts_with(p, '.Trash-'))) > 0)"
_REASON = f"CASE WHEN {_EXCL} THEN 'excluded_dir' WHEN {_TEMP} THEN 'temp_file' WHEN coalesce({_EXTSQL} NOT IN ({_list(EXTENSIONS)}), true) THEN 'not_video' WHEN size < {MIN_SIZE} THEN 'too_small' END"


@query(f"SELECT id, {_REASON} AS reason FROM c")
def prefilter_reason(spark, d):
    return _files(spark, d).select("id", P.reject_reason(F.col("rel_path"), F.col("size"), EXCLUDED, MIN_SIZE).alias("reason"))


@query(f"SELECT coalesce({_REASON}, 'passed') AS reason, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM c GROUP BY 1")
def scan_statistics(spark, d):
    f = _files(spark, d).select(F.coalesce(P.reject_reason(F.col("rel_path"), F.col("size"), EXCLUDED, MIN_SIZE), F.lit("passed")).alias("reason"), "size")
    return f.groupBy("reason").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"SELECT id, {_TEMP} AS temp, {_EXTSQL} AS ext FROM c")
def temp_names(spark, d):
    return _files(spark, d).select("id", P.is_temp_name(P.file_name(F.col("rel_path"))).alias("temp"), P.extension(F.col("rel_path")).alias("ext"))


@query("SELECT id FROM c WHERE rel_path LIKE '%e%' AND regexp_matches(rel_path, '^a/')")
def exclude_globs(spark, d):
    return _files(spark, d).where(F.col("rel_path").rlike(P.glob_regex("*e*")) & F.col("rel_path").rlike(P.glob_regex("a/*"))).select("id")


@query("SELECT id FROM c WHERE NOT (root_id = 1 AND starts_with(rel_path, 'en/src1/')) AND NOT (root_id = 2 AND starts_with(rel_path, 'fr/'))")
def optout_antijoin(spark, d):
    markers = spark.sql("SELECT * FROM VALUES (1L, 'en/src1'), (2L, 'fr') AS m(root_id, dir)")
    return P.without_opt_out(_files(spark, d), markers).select("id")


@query("SELECT id, nlink > 1 AS hardlink, (mode & 3072) <> 0 AS special, (mode & 61440) = 16384 AS folder FROM c")
def special_mode(spark, d):
    return _files(spark, d).select("id", (F.col("nlink") > 1).alias("hardlink"), X.has_special_mode(F.col("mode").cast("int")).alias("special"), X.is_directory(F.col("mode").cast("int")).alias("folder"))


# Beginnings of files, as hex, by turns of the catalog's rows.
_HEADS = (
    ("mp4", "0000002066747970"), ("mov", "000000206D6F6F76"), ("mp4", "6162636465666768"), ("mkv", "1A45DFA3"), ("webm", "00"), ("avi", "52494646000000004156492000"),
    ("avi", "52494646000000005741564500"), ("mpg", "000001BA"), ("mxf", "00060E2B34020501010D010200"), ("mxf", "0060E2B34020501010D01020"), ("r3d", "00"), ("wmv", "3026B2758E66CF11A6D900AA0062CE6C"),
)
_HEAD = f"SELECT id, [{_list(e for e, _ in _HEADS)}][id % {len(_HEADS)} + 1] AS ext, [{_list(h for _, h in _HEADS)}][id % {len(_HEADS)} + 1] || hex(encode('' || id)) AS head FROM c"


@query(
    f"""SELECT id, CASE WHEN ok THEN 'match' WHEN NOT ok THEN 'mismatch' ELSE 'unchecked' END AS verdict FROM (SELECT id, CASE WHEN ext IN ('mp4', 'mov') THEN substring(head, 9, 8) IN ('66747970', '6D6F6F76')
  WHEN ext IN ('mkv', 'webm') THEN starts_with(head, '1A45DFA3') WHEN ext = 'avi' THEN starts_with(head, '52494646') AND substring(head, 17, 8) = '41564920' WHEN ext = 'mpg' THEN starts_with(head, '000001BA')
  WHEN ext = 'wmv' THEN starts_with(head, '3026B2758E66CF11A6D900AA0062CE6C') WHEN ext = 'mxf' THEN instr(head, '060E2B34020501010D0102') % 2 = 1 END AS ok FROM ({_HEAD}))"""
)
def magic_check(spark, d):
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _HEADS)), (F.col("id") % len(_HEADS) + 1).cast("int"))
    head = F.concat(pick(1), F.hex(F.encode(F.col("id").cast("string"), "UTF-8")))
    return _files(spark, d).select("id", P.magic_verdict(pick(0), head).alias("verdict"))


# Scalars

# Units after a number, some of them none.
_UNITS = ("MiB", " GiB", "", "kb", "x", " T", "b", "K ", "tib", "-")
_SPANS = ("m", "h", "ms", "d", "", " min", "w", " hr", "S", "day ")
_PARTS = "lower(trim(regexp_extract(t, '^\\s*([0-9]+)\\s*([a-zA-Z]*)\\s*$', 2)))", "TRY_CAST(regexp_extract(t, '^\\s*([0-9]+)\\s*([a-zA-Z]*)\\s*$', 1) AS BIGINT)"


@query(
    f"""SELECT id, CASE {_PARTS[0]} WHEN 'mib' THEN 1048576 WHEN 'gib' THEN 1073741824 WHEN '' THEN 1 WHEN 'kb' THEN 1024 WHEN 'k' THEN 1024 WHEN 't' THEN 1099511627776 WHEN 'tib' THEN 1099511627776 WHEN 'b' THEN 1 END
  * {_PARTS[1]} AS bytes FROM (SELECT id, id % 977 || [{_list(_UNITS)}][id % 10 + 1] AS t FROM c)"""
)
def parse_bytes(spark, d):
    unit = F.element_at(F.array(*(F.lit(u) for u in _UNITS)), (F.col("id") % 10 + 1).cast("int"))
    return _files(spark, d).select("id", X.parse_bytes(F.concat((F.col("id") % 977).cast("string"), unit)).alias("bytes"))


@query(
    f"""SELECT id, CASE {_PARTS[0]} WHEN 'm' THEN 60000 WHEN 'min' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'hr' THEN 3600000 WHEN 'ms' THEN 1 WHEN 'd' THEN 86400000 WHEN 'day' THEN 86400000 WHEN '' THEN 1000 WHEN 's' THEN 1000 END
  * {_PARTS[1]} AS ms FROM (SELECT id, id % 977 || [{_list(_SPANS)}][id % 10 + 1] AS t FROM c)"""
)
def parse_duration(spark, d):
    unit = F.element_at(F.array(*(F.lit(u) for u in _SPANS)), (F.col("id") % 10 + 1).cast("int"))
    return _files(spark, d).select("id", X.parse_duration_ms(F.concat((F.col("id") % 977).cast("string"), unit)).alias("ms"))


@query("SELECT id, CASE WHEN n % 1048576 = 0 AND n > 0 THEN (n // 1048576) || 'MiB' WHEN n % 1024 = 0 AND n > 0 THEN (n // 1024) || 'KiB' ELSE n || 'B' END AS bytes, CASE WHEN m % 3600000 = 0 AND m > 0 AND m < 86400000 THEN (m // 3600000) || 'h' WHEN m % 86400000 = 0 AND m > 0 THEN (m // 86400000) || 'd' WHEN m % 60000 = 0 AND m > 0 THEN (m // 60000) || 'm' ELSE m || 'ms' END AS duration FROM (SELECT id, id * 256 AS n, id % 25 * 1200000 AS m FROM c)")
def format_literals(spark, d):
    return _files(spark, d).select("id", X.format_bytes(F.col("id") * 256).alias("bytes"), X.format_duration(F.col("id") % 25 * 1200000).alias("duration"))


@query("SELECT id, CASE WHEN size < 1024 THEN size || ' B' ELSE printf('%.1f KiB', size / 1024.0) END AS human FROM c")
def human_size(spark, d):
    return _files(spark, d).select("id", X.human_size(F.col("size")).alias("human"))


@query("SELECT id, least(900000 * CAST(pow(2, attempts) AS BIGINT), 86400000) AS wait_ms, CASE WHEN prev_state IN ('hashed', 'deduped', 'sized') THEN prev_state ELSE 'settling' END AS target FROM c")
def backoff_restore(spark, d):
    return _files(spark, d).select("id", X.backoff_ms(F.col("attempts")).alias("wait_ms"), X.restore_target(F.col("prev_state")).alias("target"))


@query(f"SELECT id, CASE WHEN mtime_ns // 1000000 <= {NOW - 86_400_000 * 89} THEN 'sized' ELSE 'settling' END AS state, CASE WHEN mtime_ns // 1000000 > {NOW - 86_400_000 * 89} THEN mtime_ns // 1000000 + 900000 END AS ready_at FROM c")
def phase_a(spark, d):
    state, ready = X.initial_state(F.col("mtime_ns"), NOW - 86_400_000 * 89 + 900_000, 900_000)
    return _files(spark, d).select("id", state.alias("state"), ready.alias("ready_at"))


@query("SELECT id, row_number() OVER (PARTITION BY owner_uid ORDER BY string_split(rel_path, '/'), id) AS place FROM c")
def path_order(spark, d):
    from pyspark.sql import Window

    return _files(spark, d).select("id", F.row_number().over(Window.partitionBy("owner_uid").orderBy(X.path_key(F.col("rel_path")), "id")).cast("long").alias("place"))


@query("SELECT id FROM c WHERE string_split(rel_path, '/') < ['a', 'en'] AND rel_path <> 'a' AND NOT starts_with('a/en', rel_path || '/')")
def cursor_prune(spark, d):
    return _files(spark, d).where(X.before_cursor(F.col("rel_path"), "a/en")).select("id")


@query("SELECT id, rel_path = 'a' OR starts_with(rel_path, 'a/') AS under_a FROM c")
def under_dir(spark, d):
    return _files(spark, d).select("id", X.under_dir(F.col("rel_path"), "a/").alias("under_a"))


@query("SELECT id, 'z/y' || substring(rel_path, 2) AS rel_path FROM c WHERE root_id = 2 AND starts_with(rel_path, 'a/')")
def rename_prefix(spark, d):
    return C.rename_prefix(_files(spark, d), 2, "a", "z/y")


@query("SELECT id, concat_ws(' | ', last_error, skip_reason) AS note FROM c")
def note_concat(spark, d):
    return _files(spark, d).select("id", F.concat_ws(" | ", "last_error", "skip_reason").alias("note"))


@query("SELECT id, CASE WHEN id * 12 > 8192 * 10 THEN greatest(CAST(pow(2, ceil(log2(greatest(id * 12 // 10, 8192)))) AS BIGINT), 8192) END AS watches FROM c")
def watch_limit(spark, d):
    return _files(spark, d).select("id", X.watch_limit(F.col("id"), F.lit(8192)).alias("watches"))


# Hashing

_SPAN = f"(size - {LENGTH})"
_SEG = f"CASE WHEN size <= {CHUNKS * LENGTH} THEN [CAST(0 AS BIGINT)] ELSE list_sort(list_distinct([0, {_SPAN} // 3, 2 * {_SPAN} // 3, {_SPAN}])) END"
_PART = f"o || ':' || substring(hex(encode(content)), CAST(o * 2 + 1 AS INT), CAST((CASE WHEN size <= {CHUNKS * LENGTH} THEN size ELSE {LENGTH} END) * 2 AS INT))"
_SPARSE = f"sha256('v1|{CHUNKS}|{LENGTH}|' || size || '|' || array_to_string(list_transform({_SEG}, lambda o: {_PART}), ';'))"


@query(f"SELECT id, array_to_string({_SEG}, ',') AS segments FROM c")
def segments(spark, d):
    return _files(spark, d).select("id", F.array_join(F.transform(H.segments(F.col("size"), CHUNKS, LENGTH, 1), lambda x: x.cast("string")), ",").alias("segments"))


@query(f"SELECT id, {_SPARSE} AS sparse_hash, sha256(content) AS full_hash FROM c")
def content_hashes(spark, d):
    return _files(spark, d).select("id", H.sparse_hash(F.col("content"), F.col("size"), CHUNKS, LENGTH, 1).alias("sparse_hash"), H.full_hash(F.col("content")).alias("full_hash"))


@query("SELECT id, substring(sha256('remote|' || root_id), 1, 32) AS sub_id, substring(sha256(rel_path), 1, 16) AS ino FROM c WHERE root_id = 3")
def remote_key(spark, d):
    sub, ino = H.remote_key(F.col("root_id"), F.col("rel_path"))
    return _files(spark, d).where("root_id = 3").select("id", sub.alias("sub_id"), ino.alias("ino"))


# Groups

_PEERS = "p AS (SELECT * FROM c WHERE state NOT IN ('missing', 'gone') AND size IN (SELECT size FROM c WHERE state NOT IN ('missing', 'gone') GROUP BY size HAVING count(*) > 1))"
_MEMBERS = f"{_PEERS}, h AS (SELECT *, {_SPARSE} AS sparse_hash FROM p), m0 AS (SELECT *, count(*) OVER w AS n, first_value(id) OVER (PARTITION BY size, content ORDER BY mtime_ns, first_seen_at, ino, id) AS g FROM h WINDOW w AS (PARTITION BY size, content)), m AS (SELECT * EXCLUDE (group_id), g AS group_id, id = g AS is_canonical FROM m0 WHERE n > 1)"
_GROUPS = f"{_MEMBERS}, g AS (SELECT m.group_id, m.size, count(*) AS members, coalesce(min(CASE WHEN NOT is_canonical THEN CASE state WHEN 'deduped' THEN 2 WHEN 'verified' THEN 1 ELSE 0 END END), 2) AS certainty, bool_or(kind = 'local') AND bool_or(kind = 'remote') AS cross_machine, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS member_ids, m.size * (count(*) - 1) AS reclaimable, bool_or(owner_uid = 1001) AS mine FROM m JOIN r USING (root_id) GROUP BY 1, 2)"


def _members(spark, d):
    return D.content_groups(_files(spark, d), CHUNKS, LENGTH)


def _groups(spark, d, **kw):
    return D.report(_members(spark, d), S.roots(spark), **kw)


@query("SELECT id, size FROM p", _PEERS)
def size_peers(spark, d):
    return D.size_peers(_files(spark, d)).select("id", "size")


@query("SELECT id, size, group_id, is_canonical, sparse_hash FROM m", _MEMBERS)
def dup_groups(spark, d):
    return _members(spark, d).select("id", "size", "group_id", "is_canonical", "sparse_hash")


@query("SELECT group_id, size, members, certainty, cross_machine, member_ids, reclaimable FROM g", _GROUPS)
def report_groups(spark, d):
    return _groups(spark, d)


@query("SELECT group_id, size, members, certainty, cross_machine, member_ids, reclaimable FROM g WHERE mine", _GROUPS)
def report_by_uid(spark, d):
    return _groups(spark, d, uid=1001)


@query("SELECT group_id, size, members, certainty, cross_machine, member_ids, reclaimable FROM g WHERE cross_machine", _GROUPS)
def report_cross(spark, d):
    return _groups(spark, d, cross_only=True)


@query("SELECT group_id, size, members, certainty, cross_machine, member_ids, reclaimable FROM g ORDER BY reclaimable DESC, group_id LIMIT 10", _GROUPS)
def report_limit(spark, d):
    return _groups(spark, d, limit=10)


@query("SELECT count(*) AS groups, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN certainty = {i} THEN reclaimable END), 0) AS BIGINT) AS {n}" for i, n in enumerate(("suspected", "verified", "shared"))) + ", count_if(cross_machine) AS cross_groups FROM g", _GROUPS)
def report_totals(spark, d):
    return D.totals(_groups(spark, d))


@query("SELECT m.id, m.group_id, true AS same, CAST(NULL AS INT) AS at FROM m WHERE NOT is_canonical", _MEMBERS)
def verify_pairs(spark, d):
    return D.compare_pairs(_members(spark, d), _files(spark, d))


_BYTES = "regexp_extract_all(hex(encode({}.content)), '..')"


@query(f"SELECT a.id, b.id AS other, CAST(list_position(list_transform(list_zip({_BYTES.format('a')}, {_BYTES.format('b')}), lambda x: x[1] IS DISTINCT FROM x[2]), true) - 1 AS BIGINT) AS at FROM c a JOIN c b ON b.id = a.id + 1 AND a.content <> b.content")
def first_diff(spark, d):
    f = _files(spark, d).select("id", "content")
    a, b = f.alias("a"), f.alias("b")
    return a.join(b, F.expr("b.id = a.id + 1 and a.content <> b.content")).select("a.id", F.col("b.id").alias("other"), H.first_difference(F.col("a.content"), F.col("b.content")).cast("long").alias("at"))


_SETTLED = (1_704_067_200_000 + 900 * 60_000) * 1_000_000


@query(f"SELECT me, id, rank FROM (SELECT a.id AS me, b.id, row_number() OVER (PARTITION BY a.id ORDER BY b.mtime_ns, b.first_seen_at, b.id) AS rank FROM c a JOIN c b ON a.size = b.size AND a.id <> b.id WHERE a.state IN ('sized', 'distinct') AND b.state IN ('sized', 'distinct') AND b.nlink = 1 AND b.mtime_ns <= {_SETTLED}) WHERE rank <= 3")
def candidates_topk(spark, d):
    return D.candidates(_files(spark, d), _SETTLED, 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT a.id, (SELECT max(ready_at) FROM c b WHERE b.state = 'settling' AND b.size = a.size) AS wait_until FROM c a WHERE state = 'sized'")
def pending_same_size(spark, d):
    return D.pending_same_size(_files(spark, d))


@query("SELECT group_id, arg_min(id, (mtime_ns, first_seen_at, ino, id)) AS canonical_id FROM c WHERE state = 'deduped' AND group_id IS NOT NULL GROUP BY 1")
def reelect(spark, d):
    return D.reelect(_files(spark, d))


@query(f"SELECT id, CASE WHEN n > 1 THEN CAST(NULL AS VARCHAR) ELSE 'distinct' END AS state, CASE WHEN n > 1 THEN {NOW} END AS ready_at FROM (SELECT c.*, k.n FROM c JOIN (SELECT size, count(*) AS n FROM c WHERE state NOT IN ('missing', 'gone') GROUP BY 1) k USING (size)) WHERE state = 'sized' AND ready_at IS NULL AND root_id = 1")
def phase_b(spark, d):
    return C.phase_b(_files(spark, d), 1, NOW)


# Reports

@query("SELECT state, count(*) AS files FROM c GROUP BY 1")
def stats_by_state(spark, d):
    return _files(spark, d).groupBy("state").agg(F.count("*").alias("files"))


@query("SELECT count(*) AS files, count(DISTINCT group_id) AS groups, CAST(sum(size) AS BIGINT) AS bytes FROM c")
def db_stats(spark, d):
    return _files(spark, d).agg(F.count("*").alias("files"), F.count_distinct("group_id").alias("groups"), F.sum("size").alias("bytes"))


@query(f"SELECT count_if(state IN ({_list(QUEUED)}) AND ready_at IS NOT NULL) AS ready, count_if(state IN ({_list(QUEUED)}) AND ready_at IS NULL) AS parked FROM c")
def queue_depth(spark, d):
    q = F.col("state").isin(*QUEUED)
    return _files(spark, d).agg(F.count_if(q & F.col("ready_at").isNotNull()).alias("ready"), F.count_if(q & F.col("ready_at").isNull()).alias("parked"))


@query("SELECT owner_uid, count(*) AS pending FROM c WHERE priority = 0 AND state = 'settling' AND ready_at IS NOT NULL GROUP BY ROLLUP (owner_uid)")
def pending_counts(spark, d):
    f = _files(spark, d).where("priority = 0 and state = 'settling' and ready_at is not null")
    return f.rollup("owner_uid").agg(F.count("*").alias("pending"))


@query("SELECT root_id, count_if(state <> 'gone') AS files, CASE WHEN count(ready_at) = count(*) THEN min(ready_at) END AS least_or_null, CASE WHEN count(heavy_wait_since) = count(*) THEN sum(heavy_wait_since) END AS sum_or_null FROM c GROUP BY 1")
def file_count(spark, d):
    absorb = lambda c, f: F.when(F.count(c) == F.count("*"), f(c))
    return _files(spark, d).groupBy("root_id").agg(F.count_if(F.col("state") != "gone").alias("files"), absorb("ready_at", F.min).alias("least_or_null"), absorb("heavy_wait_since", F.sum).alias("sum_or_null"))


@query("SELECT id AS event_id, owner_uid, updated_at FROM c WHERE owner_uid IN (1001, 1002) AND updated_at >= 1704067200000 ORDER BY updated_at DESC, id DESC LIMIT 20")
def ledger_query(spark, d):
    return _files(spark, d).where("owner_uid in (1001, 1002) and updated_at >= 1704067200000").orderBy(F.desc("updated_at"), F.desc("id")).limit(20).select(F.col("id").alias("event_id"), "owner_uid", "updated_at")


@query("SELECT r.root_id, r.path, p.files FROM r LEFT JOIN (SELECT root_id, count(*) AS files FROM c WHERE root_id <> 2 GROUP BY 1) p USING (root_id)")
def root_progress(spark, d):
    progress = _files(spark, d).where("root_id <> 2").groupBy("root_id").agg(F.count("*").alias("files"))
    return F.broadcast(S.roots(spark)).join(progress, "root_id", "left").select("root_id", "path", "files")


@query("SELECT c.id, arg_max(r.root_id, length(r.path)) AS root_id FROM (SELECT id, '/volume1/video/' || rel_path AS p FROM c) c JOIN r ON p = r.path OR starts_with(p, r.path || '/') GROUP BY 1")
def owning_root(spark, d):
    f = _files(spark, d).select("id", F.concat(F.lit("/volume1/video/"), "rel_path").alias("p"))
    return T.deepest(f, "p", S.roots(spark).select("root_id", "path"), "path").where("root_id is not null").select("id", "root_id")


# Changes

_SEEN = f"s AS (SELECT sub_id, ino + CASE WHEN id % 10 = 0 THEN 1000000 ELSE 0 END AS ino, root_id, rel_path, size + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS size, mtime_ns, ctime_ns + id % 2 AS ctime_ns, {NOW} + id AS ready_at, 0 AS priority FROM c)"
_UPSERT = f"""SELECT s.sub_id, s.ino, state, prev_state, ready_at, priority, attempts, skip_reason, group_id, rel_path, CAST({NOW} AS BIGINT) AS updated_at, state NOT IN ({_list(QUEUED)}) AS dropped FROM (
SELECT s.sub_id, s.ino, s.rel_path, least(s.priority, c.priority) AS priority,
CASE WHEN c.id IS NULL THEN 'settling' WHEN c.state = 'missing' AND same THEN CASE WHEN c.prev_state IN ('hashed', 'deduped', 'sized') THEN c.prev_state ELSE 'settling' END WHEN same OR undo THEN c.state ELSE 'settling' END AS state,
CASE WHEN c.id IS NULL THEN NULL WHEN c.state = 'missing' AND same OR c.state IN ({_list(QUEUED)}) OR same OR undo THEN c.prev_state ELSE c.state END AS prev_state,
CASE WHEN c.id IS NULL THEN s.ready_at WHEN c.state = 'missing' AND same THEN CASE WHEN coalesce(c.prev_state, '') <> 'deduped' THEN s.ready_at END WHEN same AND c.state NOT IN ({_list(QUEUED)}) THEN c.ready_at ELSE s.ready_at END AS ready_at,
CASE WHEN same THEN attempts ELSE 0 END AS attempts, CASE WHEN same OR undo THEN skip_reason END AS skip_reason, CASE WHEN same THEN group_id END AS group_id
FROM s LEFT JOIN (SELECT * FROM c) c ON s.ino = c.ino JOIN r ON r.root_id = s.root_id, LATERAL (SELECT coalesce(c.size = s.size AND c.mtime_ns = s.mtime_ns AND (r.kind = 'remote' OR c.ctime_ns = s.ctime_ns), false) AS same, coalesce(c.state = 'skipped' AND c.skip_reason = 'user_undo', false) AS undo)) s"""


def _seen(spark, d):
    f = _files(spark, d)
    return f.select("sub_id", F.expr("ino + if(id % 10 = 0, 1000000, 0)").alias("ino"), "root_id", "rel_path", F.expr("size + if(id % 4 = 0, 1, 0)").alias("size"), "mtime_ns", F.expr("ctime_ns + id % 2").alias("ctime_ns"), (F.lit(NOW) + F.col("id")).alias("ready_at"), F.lit(0).alias("priority"))


@query(_UPSERT, _SEEN)
def upsert_pending(spark, d):
    return C.upsert_pending(_files(spark, d), _seen(spark, d), S.roots(spark), NOW)


@query("SELECT s.ino, s.rel_path FROM s WHERE s.ino NOT IN (SELECT ino FROM c)", _SEEN)
def scan_insert(spark, d):
    return _seen(spark, d).join(_files(spark, d).select("sub_id", "ino"), ["sub_id", "ino"], "left_anti").select("ino", "rel_path")


@query(f"SELECT id, 'missing' AS state, state AS prev_state, CAST({NOW} AS BIGINT) AS updated_at FROM c WHERE root_id = 1 AND starts_with(rel_path, 'en/') AND state NOT IN ('missing', 'gone')")
def mark_missing_prefix(spark, d):
    return C.mark_missing(_files(spark, d), (F.col("root_id") == 1) & X.under_dir(F.col("rel_path"), "en"), NOW)


@query("SELECT b.id, b.rel_path FROM c a JOIN c b ON b.root_id = a.root_id AND b.rel_path = a.rel_path AND b.ino <> a.ino + 5 WHERE a.id % 7 = 0 AND b.state NOT IN ('missing', 'gone')")
def rename_over(spark, d):
    f = _files(spark, d)
    return C.rename_over(f, f.where("id % 7 = 0").select("sub_id", (F.col("ino") + 5).alias("ino"), "root_id", "rel_path"))


@query(f"SELECT id, CASE WHEN state = 'hashed' THEN 'verified' ELSE state END AS state, CASE WHEN state = 'hashed' AND id % 2 = 0 THEN 99 ELSE group_id END AS group_id, CASE WHEN state = 'hashed' THEN NULL ELSE 'state_raced' END AS note, CAST({NOW} AS BIGINT) AS ts FROM c WHERE id % 3 = 0")
def apply_cas(spark, d):
    f = _files(spark, d)
    changes = f.where("id % 3 = 0").select("id", F.lit("hashed").alias("from"), F.lit("verified").alias("to"), (F.col("id") % 2 == 0).alias("set_group"), F.lit(99).cast("long").alias("group_id"))
    return C.apply_cas(f, changes, NOW)


@query(f"SELECT id FROM c WHERE NOT (state = 'gone' AND updated_at < {NOW - 365 * 86_400_000})")
def purge(spark, d):
    return C.purge(_files(spark, d), NOW - 365 * 86_400_000).select("id")


@query(f"SELECT id, CASE WHEN ready_at IS NULL THEN 'unparked' ELSE 'parked' END AS change, CASE WHEN ready_at IS NULL THEN CAST({NOW} AS BIGINT) END AS ready_at FROM c WHERE state = 'hashed'")
def park_unpark(spark, d):
    return C.park(_files(spark, d), NOW)


@query("SELECT id FROM c WHERE state = 'verified' AND (starts_with(rel_path, 'en/') OR starts_with(rel_path, 'a/'))")
def requeue_verified(spark, d):
    return C.verified_under(_files(spark, d), ["en", "a"]).select("id")


@query("SELECT root_id, rel_path, arg_min(id, (CASE WHEN state IN ('missing', 'gone') THEN 1 ELSE 0 END, id)) AS id FROM c GROUP BY 1, 2")
def pick_live_row(spark, d):
    key = F.struct(F.when(F.col("state").isin("missing", "gone"), 1).otherwise(0), "id")
    return _files(spark, d).groupBy("root_id", "rel_path").agg(F.min_by("id", key).alias("id"))


@query(f"SELECT id, CASE WHEN state = 'skipped' THEN 'settling' ELSE state END AS state, CASE WHEN state = 'skipped' THEN CAST({NOW} AS BIGINT) ELSE ready_at END AS ready_at FROM c WHERE skip_reason IS NOT NULL AND state <> 'gone'")
def unskip(spark, d):
    return C.unskip(_files(spark, d), NOW)


@query(f"SELECT id, priority, ready_at FROM c WHERE state IN ({_list(QUEUED)}) AND ready_at <= {NOW} AND (state IN ('settling', 'sized') OR heavy_wait_since <= {NOW - 3_600_000}) ORDER BY priority, ready_at, id LIMIT 50")
def next_ready(spark, d):
    return C.next_ready(_files(spark, d), NOW, 50, 3_600_000).select("id", "priority", "ready_at")


_LISTED = "n AS (SELECT '/volume1/' || lang AS path, 'local' AS kind, max(source) AS label FROM documents GROUP BY lang UNION ALL SELECT '/mnt/far', 'remote', 'there')"


@query(
    """SELECT CASE WHEN r.root_id IS NULL THEN 3 + row_number() OVER (PARTITION BY r.root_id IS NULL ORDER BY n.path) ELSE r.root_id END AS root_id, coalesce(n.path, r.path) AS path,
  coalesce(n.kind, r.kind) AS kind, coalesce(n.label, r.label) AS label, n.path IS NOT NULL AS active FROM r FULL JOIN n ON n.path = r.path""",
    _LISTED,
)
def root_upsert(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    listed = docs.groupBy(F.concat(F.lit("/volume1/"), "lang").alias("path"), F.lit("local").alias("kind")).agg(F.max("source").alias("label"))
    return L.upsert_roots(S.roots(spark), listed.union(spark.sql("SELECT '/mnt/far', 'remote', 'there'")))


# Presence

@query(f"SELECT id, state AS prev_state FROM c WHERE root_id = 1 AND state NOT IN ('missing', 'gone') AND updated_at < {NOW - 5 * 86_400_000} AND id % 4 <> 0")
def presence_missing(spark, d):
    f = _files(spark, d)
    return C.presence(f, f.where("id % 4 = 0").select("sub_id", "ino"), 1, NOW - 5 * 86_400_000)


@query("SELECT id, CASE WHEN prev_state IN ('hashed', 'deduped', 'sized') THEN prev_state ELSE 'settling' END AS state FROM c WHERE state = 'missing' AND id % 2 = 0")
def presence_restore(spark, d):
    f = _files(spark, d)
    return f.where("state = 'missing'").join(f.where("id % 2 = 0").select("sub_id", "ino").distinct(), ["sub_id", "ino"], "left_semi").select("id", X.restore_target(F.col("prev_state")).alias("state"))


@query(f"SELECT id, 'gone' AS state FROM c WHERE state = 'missing' AND updated_at < {NOW - 100 * 86_400_000}")
def presence_expire(spark, d):
    return C.expire(_files(spark, d), NOW - 100 * 86_400_000)


@query("SELECT r.root_id, known, seen, seen > 0 AND seen * 100 >= known * CASE kind WHEN 'remote' THEN 75 ELSE 90 END AS conclusive FROM r JOIN (SELECT root_id, count_if(state <> 'gone') AS known, count_if(id % 5 <> 0) AS seen FROM c GROUP BY 1) USING (root_id)")
def presence_guard(spark, d):
    f = _files(spark, d)
    return C.presence_guard(f, f.where("id % 5 <> 0").select("root_id", "sub_id", "ino"), S.roots(spark))


@query(f"SELECT id FROM c WHERE ctime_ns // 1000000 >= greatest({1_704_067_200_000 + 400 * 60_000} - 3600000, 0)")
def delta_reconcile(spark, d):
    since = X.reconcile_since(1_704_067_200_000 + 400 * 60_000)
    return _files(spark, d).where(F.col("ctime_ns") >= since * 1_000_000).select("id")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 'new' ELSE 'changed' END AS what FROM c WHERE root_id = 3 AND (id % 6 = 0 OR id % 4 = 0)")
def remote_rescan(spark, d):
    f = _files(spark, d).where("root_id = 3")
    known = f.where("id % 6 <> 0").select("root_id", "rel_path", F.expr("size + if(id % 4 = 0, 1, 0)").alias("old_size"), F.col("mtime_ns").alias("old_mtime"))
    j = f.join(known, ["root_id", "rel_path"], "left")
    return j.where("old_size is null or old_size <> size or old_mtime <> mtime_ns").select("id", F.when(F.col("old_size").isNull(), "new").otherwise("changed").alias("what"))


@query("SELECT id FROM c WHERE starts_with(rel_path, 'en/src1/') OR starts_with(rel_path, 'a/fr/')")
def branch_filter(spark, d):
    return _files(spark, d).where(X.in_branches(F.col("rel_path"), ["en/src1", "a/fr"])).select("id")


# Schedule, policies, events

_RULES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES)


@query(f"SELECT c.id, c.prev_state, c.state, u.reason, u.reason IS NOT NULL AS legal FROM c LEFT JOIN (SELECT a, b, min(reason) AS reason FROM (VALUES {_RULES}) u(a, b, reason) GROUP BY 1, 2) u ON u.a = c.prev_state AND u.b = c.state WHERE prev_state IS NOT NULL")
def transition_audit(spark, d):
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES} AS u(prev_state, state, reason)").groupBy("prev_state", "state").agg(F.min("reason").alias("reason"))
    f = _files(spark, d).where("prev_state is not null").select("id", "prev_state", "state")
    return f.join(F.broadcast(rules), ["prev_state", "state"], "left").select("id", "prev_state", "state", "reason", F.col("reason").isNotNull().alias("legal"))


_POLICIES = ", ".join(f"({n}, '{p}')" for n, p in ERRNO_POLICY)


@query(f"SELECT id, CAST(id % 120 AS INT) AS errno, coalesce(p.policy, 'backoff') AS policy FROM c LEFT JOIN (VALUES {_POLICIES}) p(errno, policy) ON p.errno = id % 120")
def errno_policy(spark, d):
    """What follows from an error number; each file's is taken from its id."""
    table = spark.sql(f"SELECT * FROM VALUES {_POLICIES} AS t(errno, policy)")
    errors = _files(spark, d).select("id", (F.col("id") % 120).cast("int").alias("errno"))
    return errors.join(F.broadcast(table), "errno", "left").select("id", "errno", F.coalesce("policy", F.lit("backoff")).alias("policy"))


@query("SELECT id, (m >= 1320 OR m < 300) AS heavy, CASE WHEN m >= 1320 OR m < 300 THEN 0 ELSE 1320 - m END AS wait_min FROM (SELECT id, id * 37 % 1440 AS m FROM c)")
def heavy_window(spark, d):
    inside, wait = X.in_window(F.col("id") * 37 % 1440, *parse_window("22:00-05:00"))
    return _files(spark, d).select("id", inside.alias("heavy"), wait.alias("wait_min"))


@query(f"SELECT id, task, last IS NULL OR {NOW} - last >= period AS due FROM (SELECT id, task, period, CASE WHEN (id + k) % 3 <> 0 THEN {NOW} - id * 60000 END AS last FROM c, (VALUES (0, 'checkpoint', 3600000), (1, 'reconcile', 21600000), (2, 'presence', 86400000)) t(k, task, period))")
def due_tasks(spark, d):
    tasks = F.broadcast(spark.sql("SELECT * FROM VALUES (0, 'checkpoint', 3600000L), (1, 'reconcile', 21600000L), (2, 'presence', 86400000L) AS t(k, task, period)"))
    f = _files(spark, d).select("id").crossJoin(tasks).withColumn("last", F.expr(f"if((id + k) % 3 <> 0, {NOW} - id * 60000, null)"))
    return f.select("id", "task", (F.col("last").isNull() | (F.lit(NOW) - F.col("last") >= F.col("period"))).alias("due"))


_EV = "e AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type FROM events)"


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id", "event_type")


_HALVES = "f AS (SELECT seq, ts_ms, seq // 2 AS cookie, CASE WHEN seq % 2 = 0 THEN 'from' ELSE 'to' END AS kind, 'p' || user_id AS path FROM e WHERE seq % 7 <> 0)"


@query("SELECT CASE WHEN a.seq IS NULL THEN 'moved_in' WHEN b.seq IS NULL THEN 'removed_unknown' ELSE 'renamed' END AS kind, coalesce(a.seq, b.seq) AS seq, a.path AS from_path, b.path FROM (SELECT * FROM f WHERE kind = 'from') a FULL JOIN (SELECT * FROM f WHERE kind = 'to') b ON a.cookie = b.cookie AND b.ts_ms BETWEEN a.ts_ms AND a.ts_ms + 7200000", f"{_EV}, {_HALVES}")
def rename_pairs(spark, d):
    e = _events(spark, d).where("seq % 7 <> 0")
    halves = e.select("seq", "ts_ms", F.expr("seq div 2").alias("cookie"), F.expr("if(seq % 2 = 0, 'from', 'to')").alias("kind"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"))
    return E.pair_renames(halves, 7_200_000)


_HOUR8 = 8 * 3_600_000


@query(
    f"SELECT path, kind, first_ms, max(seq) FILTER (k = last_k) AS seq, count(*) - 1 AS dropped FROM (SELECT *, max(k) OVER (PARTITION BY path, kind, first_ms) AS last_k FROM runs) GROUP BY path, kind, first_ms",
    f"{_EV}, o AS (SELECT 'p' || user_id AS path, event_type AS kind, ts_ms, seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts_ms, seq) AS k FROM e), runs AS (SELECT path, kind, k, seq, ts_ms AS first_ms FROM o WHERE k = 1 UNION ALL SELECT o.path, o.kind, o.k, o.seq, CASE WHEN o.ts_ms - runs.first_ms < {_HOUR8} THEN runs.first_ms ELSE o.ts_ms END FROM runs JOIN o ON o.path = runs.path AND o.kind = runs.kind AND o.k = runs.k + 1)",
)
def coalesce_events(spark, d):
    e = _events(spark, d).select("seq", "ts_ms", F.col("event_type").alias("kind"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"))
    return E.coalesce_bursts(e, _HOUR8)


@query("SELECT seq, user_id AS uid, row_number() OVER (PARTITION BY ts_ms // 86400000, user_id ORDER BY seq) > 2 AS rejected FROM e", _EV)
def backpressure(spark, d):
    return E.back_pressure(_events(spark, d).select("seq", F.col("user_id").alias("uid"), F.expr("ts_ms div 86400000").alias("day")), 2)


@query("SELECT user_id AS dev, ts_ms, CASE WHEN ts_ms > lag(ts_ms) OVER w THEN least(1.0, greatest(seq - lag(seq) OVER w, 0) / CAST(ts_ms - lag(ts_ms) OVER w AS DOUBLE)) END AS util, greatest(seq % 100 - lag(seq % 100) OVER w, 0) AS sectors FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms)", _EV)
def disk_load_delta(spark, d):
    return E.load_deltas(_events(spark, d).select(F.col("user_id").alias("dev"), "ts_ms", F.col("seq").alias("ticks"), (F.col("seq") % 100).alias("sectors"))).withColumn("util", F.col("util").cast("double"))


_LOAD = "l AS (SELECT user_id AS dev, ts_ms, (seq // 3) % 10 / 10.0 AS load, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms) AS k FROM e)"


@query(
    "SELECT dev, ts_ms, paused FROM st",
    f"{_EV}, {_LOAD}, st AS (SELECT dev, k, ts_ms, CASE WHEN load >= 0.5 THEN ts_ms END AS bs, CASE WHEN load <= 0.2 THEN ts_ms END AS ib, false AS paused FROM l WHERE k = 1 UNION ALL SELECT dev, k, ts_ms, bs, ib, CASE WHEN bs IS NOT NULL AND ts_ms - bs >= 36000000 THEN true WHEN ib IS NOT NULL AND ts_ms - ib >= 36000000 THEN false ELSE paused END FROM (SELECT l.dev, l.k, l.ts_ms, CASE WHEN load >= 0.5 THEN coalesce(st.bs, l.ts_ms) END AS bs, CASE WHEN load <= 0.2 THEN coalesce(st.ib, l.ts_ms) END AS ib, st.paused FROM st JOIN l ON l.dev = st.dev AND l.k = st.k + 1))",
)
def busy_hysteresis(spark, d):
    s = _events(spark, d).select(F.col("user_id").alias("dev"), "ts_ms", F.expr("(seq div 3) % 10 / 10.0").alias("load"))
    return E.hysteresis(s, 0.5, 36_000_000, 0.2, 36_000_000)


# Group operations and journal recovery

_OPS = "o AS (SELECT id AS seq, CASE id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'join' WHEN 2 THEN 'set_canonical' WHEN 3 THEN 'leave' ELSE 'verified' END AS kind, CASE WHEN id % 5 = 3 AND id % 2 = 1 THEN id - 1 ELSE id END AS file_id, id + 1 AS other_id, CASE WHEN id % 5 = 0 THEN 1000000 + id ELSE 1 + id % 45 END AS group_id, CASE WHEN id % 4 <> 0 THEN 'h' || CAST(id AS {text}) END AS hash FROM c)"
_START = f"k AS (SELECT group_id AS id, min(size) AS size, 's' AS sparse_hash, min(id) AS canonical_file_id, CASE WHEN group_id % 2 = 0 THEN {NOW} - 5 END AS verified_at, CASE WHEN group_id % 4 = 0 THEN 'f' END AS full_hash, {NOW} - 9 AS created_at FROM c WHERE group_id IS NOT NULL GROUP BY group_id)"
_VALID = f"{_OPS.replace('{text}', 'VARCHAR')}, {_START}, n AS (SELECT * FROM o WHERE kind = 'create' AND EXISTS (FROM c WHERE id = o.file_id) AND EXISTS (FROM c WHERE id = o.other_id)), v AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE kind <> 'create' AND group_id IN (SELECT id FROM k UNION SELECT group_id FROM n))"


def _group_ops(spark, d):
    f = _files(spark, d).select("id", "size", "group_id")
    ops = spark.sql(f"WITH {_OPS.replace('{text}', 'STRING')} SELECT * FROM o".replace("FROM c)", "FROM {c})"), c=f)
    groups = spark.sql(f"WITH {_START} SELECT * FROM k".replace("FROM c ", "FROM {c} "), c=f)
    return f, groups, G.accepted(f, groups, ops)


@query("SELECT c.id, CASE WHEN w.id IS NULL THEN c.group_id ELSE w.g END AS group_id FROM c LEFT JOIN w ON w.id = c.id AND w.place = 1", _VALID + ", w AS (SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS place FROM (SELECT file_id AS id, seq, CASE WHEN kind <> 'leave' THEN group_id END AS g FROM v WHERE kind <> 'verified' UNION ALL SELECT other_id, seq, group_id FROM v WHERE kind = 'create'))")
def group_ops_files(spark, d):
    f, _, ops = _group_ops(spark, d)
    return G.member_groups(f, ops).select("id", "group_id")


@query(
    f"SELECT q.id, q.size, q.sparse_hash, CASE WHEN NOT EXISTS (FROM v WHERE kind = 'leave' AND v.group_id = q.id AND v.file_id = q.canon AND v.seq > q.since) THEN q.canon END AS canonical_file_id, coalesce(q.verified_at, CASE WHEN EXISTS (FROM v WHERE kind = 'verified' AND v.group_id = q.id) THEN {NOW} END) AS verified_at, coalesce(q.full_hash, (SELECT arg_min(hash, seq) FROM v WHERE kind = 'verified' AND v.group_id = q.id AND hash IS NOT NULL)) AS full_hash, q.created_at FROM q",
    _VALID + f", b AS (SELECT * FROM k UNION ALL SELECT n.group_id, c.size, n.hash, n.other_id, NULL, NULL, {NOW} FROM n JOIN c ON c.id = n.file_id), q AS (SELECT b.*, coalesce(l.file_id, b.canonical_file_id) AS canon, coalesce(l.seq, -1) AS since FROM b LEFT JOIN (SELECT group_id, max(seq) AS seq, arg_max(file_id, seq) AS file_id FROM v WHERE kind = 'set_canonical' GROUP BY 1) l ON l.group_id = b.id)",
)
def group_ops_groups(spark, d):
    f, groups, ops = _group_ops(spark, d)
    return G.group_rows(f, groups, ops, NOW)


_BOOT = NOW * 1_000_000
_JOURNAL = "j AS (SELECT id, CASE id % 7 WHEN 0 THEN 'planned' WHEN 1 THEN 'compared' WHEN 2 THEN 'done' WHEN 3 THEN 'aborted' ELSE 'cloned' END AS state, root_id, rel_path, sub_id AS dst_sub_id, ino + CASE WHEN id % 13 = 0 THEN 5 ELSE 0 END AS dst_ino, size + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS dst_size, mtime_ns - id % 4 AS dst_mtime_ns, mtime_ns - 7 AS dst_atime_ns, 1704067200000 + id * 60000 + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS updated_at FROM c), t AS (SELECT root_id, rel_path, sub_id, ino, size, mtime_ns, CASE WHEN id % 3 = 0 THEN mtime_ns ELSE ctime_ns END AS ctime_ns FROM c WHERE state NOT IN ('missing', 'gone'))"
_FRESH = f"t.size = j.dst_size AND t.mtime_ns = t.ctime_ns AND t.mtime_ns >= j.updated_at * 1000000 AND t.mtime_ns <= {_BOOT}"


@query(
    "SELECT id, decision, decision = 'restore' OR (decision = 'abort' AND state = 'cloned') AS requeue, CASE decision WHEN 'abort' THEN 'aborted' WHEN 'done' THEN 'done' WHEN 'restore' THEN 'done' ELSE state END AS journal_state, CASE WHEN decision = 'restore' THEN dst_mtime_ns END AS restore_mtime_ns, CASE WHEN decision = 'restore' THEN dst_atime_ns END AS restore_atime_ns FROM x",
    f"{_JOURNAL}, x AS (SELECT j.*, CASE WHEN state IN ('planned', 'compared') THEN 'abort' WHEN state IN ('done', 'aborted') THEN 'closed' WHEN t.ino IS NULL OR t.ino <> j.dst_ino OR t.sub_id <> j.dst_sub_id THEN 'retry' WHEN t.mtime_ns = j.dst_mtime_ns THEN 'done' WHEN {_FRESH} THEN 'restore' ELSE 'abort' END AS decision FROM j LEFT JOIN t ON t.root_id = j.root_id AND t.rel_path = j.rel_path)",
)
def journal_recovery(spark, d):
    f, both = _files(spark, d), f"WITH {_JOURNAL}".replace("FROM c", "FROM {c}")
    return R.recover(spark.sql(f"{both} SELECT * FROM j", c=f), spark.sql(f"{both} SELECT * FROM t", c=f), _BOOT)


#: The flagship report, by its other name.
def dup_report(spark: SparkSession, d: str) -> DataFrame:
    return report_groups(spark, d)


assert set(IN_GROUP) <= set(STATES)

from . import changes, content, guarded, places, upkeep  # noqa: E402, F401  register their queries here
