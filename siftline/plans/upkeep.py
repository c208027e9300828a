"""Registered queries of steps, guards, upkeep, sources' functions and event handling, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import scalars as X
from ..functions import system as Y
from ..operators import catalog as C
from ..operators import events as E
from ..operators import filters as P
from ..operators import guards as V
from ..operators import ledger as L
from ..operators import steps as T
from ..schema import EXCLUDED, QUEUED
from ..sources import catalog as S
from .queries import _EV, _REASON, MIN_SIZE, NOW, _events, _files, _list, query

DAY = 86_400_000

# Functions


@query("SELECT id, lower(hex(encode('')) || array_to_string(list_transform(range(7, -1, -1), lambda i: substring(lpad(to_hex(ino), 16, '0'), CAST(i * 2 + 1 AS INT), 2)), '') || array_to_string(list_transform(range(7, -1, -1), lambda i: substring(lpad(to_hex(size), 16, '0'), CAST(i * 2 + 1 AS INT), 2)), '')) AS key FROM c")
def id_from_parts(spark, d):
    return _files(spark, d).select("id", Y.id_from_parts(F.col("ino"), F.col("size")).alias("key"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN CAST(18446744073709551616 - id - 1 AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS shown FROM c")
def unsigned_keys(spark, d):
    return _files(spark, d).select("id", Y.unsigned(F.expr("if(id % 2 = 0, -id - 1, id)")).cast("string").alias("shown"))


@query("SELECT id, replace(replace(replace(replace(p, '\\040', ' '), '\\011', chr(9)), '\\012', chr(10)), '\\134', '\\') AS point FROM (SELECT id, '/mnt/' || CASE id % 4 WHEN 0 THEN 'a\\040b' WHEN 1 THEN 'a\\011b' WHEN 2 THEN 'a\\134b' ELSE rel_path END AS p FROM c)")
def octal_unescape(spark, d):
    p = F.when(F.col("id") % 4 == 0, "a\\040b").when(F.col("id") % 4 == 1, "a\\011b").when(F.col("id") % 4 == 2, "a\\134b").otherwise(F.col("rel_path"))
    return _files(spark, d).select("id", Y.unescape_octal(F.concat(F.lit("/mnt/"), p)).alias("point"))


@query("SELECT id, strftime(epoch_ms(mtime_ns // 1000000), '%Y-%m-%d %H:%M:%S') || 'Z' AS at FROM c")
def utc_text(spark, d):
    return _files(spark, d).select("id", Y.utc_text(X.div(F.col("mtime_ns"), 1_000_000)).alias("at"))


@query("SELECT id, CASE WHEN e IS NULL THEN CASE WHEN (mode & 61440) = 16384 THEN 'not_file' ELSE 'file' END WHEN e = 2 THEN 'gone' WHEN e IN (1, 6, 13, 19, 36, 40, 75) THEN 'ignore' ELSE 'retry' END AS class, coalesce(e IN (2, 20), false) AS absent FROM (SELECT *, CASE id % 9 WHEN 0 THEN 2 WHEN 1 THEN 13 WHEN 2 THEN 5 WHEN 3 THEN 20 WHEN 4 THEN 40 END AS e FROM c)")
def error_class(spark, d):
    e = F.when(F.col("id") % 9 == 0, 2).when(F.col("id") % 9 == 1, 13).when(F.col("id") % 9 == 2, 5).when(F.col("id") % 9 == 3, 20).when(F.col("id") % 9 == 4, 40)
    f = _files(spark, d).withColumn("e", e)
    return f.select("id", Y.error_class(F.col("e"), X.is_directory(F.col("mode").cast("int"))).alias("class"), Y.proves_absence(F.col("e")).alias("absent"))


@query("SELECT c.id, (starts_with(rel_path, 'en/') OR starts_with(rel_path, 'a/fr/')) AND kind <> 'remote' AS allowed FROM c JOIN r USING (root_id)")
def allow_list(spark, d):
    f = _files(spark, d).join(F.broadcast(S.roots(spark).select("root_id", "kind")), "root_id")
    return f.select("id", Y.allowed("dedup", F.col("rel_path"), ["en", "a/fr"], F.col("kind")).alias("allowed"))


_ZONE = "Europe/Berlin"


@query(f"SELECT id, m >= 1320 OR m < 300 AS inside, CASE WHEN s0 > t THEN s0 ELSE s1 END AS next_start FROM (SELECT *, hour(l) * 60 + minute(l) AS m, epoch_ms(timezone('{_ZONE}', date_trunc('day', l) + INTERVAL 22 HOUR)) AS s0, epoch_ms(timezone('{_ZONE}', date_trunc('day', l) + INTERVAL 46 HOUR)) AS s1 FROM (SELECT id, t, timezone('{_ZONE}', make_timestamptz(t * 1000)) AS l FROM (SELECT id, 1774630000000 + id * 7000000 AS t FROM c)))")
def next_window(spark, d):
    f = _files(spark, d).select("id", (F.lit(1_774_630_000_000) + F.col("id") * 7_000_000).alias("t"))
    inside, start = Y.window_at(F.col("t"), 22 * 60, 5 * 60, _ZONE)
    return f.select("id", inside.alias("inside"), start.alias("next_start"))


@query("SELECT id, 'sd' || chr(CAST(97 + id % 26 AS INT)) AS device, id * 8 AS read_sectors, size AS written_sectors, id % 1000 AS busy_ms FROM c")
def disk_samples(spark, d):
    f = _files(spark, d)
    line = F.format_string("   8       0 sd%s 120 4 %d 30 7 2 %d 11 0 %d 55", F.char(97 + F.col("id") % 26), F.col("id") * 8, F.col("size"), F.col("id") % 1000)
    return f.select("id", *(c.alias(n) for n, c in Y.disk_fields(line).items()))


@query("SELECT id, CASE id % 5 WHEN 0 THEN 'ping' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume' WHEN 3 THEN 'status' END AS word FROM c")
def control_words(spark, d):
    line = F.element_at(F.array(*(F.lit(x) for x in ("ping", " PAUSE ", "resume\n", "Status", "stop now"))), (F.col("id") % 5 + 1).cast("int"))
    return _files(spark, d).select("id", Y.control_word(line).alias("word"))


@query(f"SELECT id, CASE WHEN id % 6 = 0 THEN 0 ELSE greatest(least({NOW} - id * 1000 + 200000 - {NOW}, 60000), 0) END AS sleep_ms FROM c")
def sleep_time(spark, d):
    last = F.when(F.col("id") % 6 != 0, F.lit(NOW) - F.col("id") * 1000)
    return _files(spark, d).select("id", Y.sleep_ms(last, F.lit(200_000), NOW).alias("sleep_ms"))


@query("SELECT id, substring(content, CAST(id % 7 + 1 AS INT), 5) AS part FROM c WHERE length(content) >= id % 7 + 5 AND NOT regexp_matches(substring(content, 1, 12), '[^\\x00-\\x7f]')")
def positional_read(spark, d):
    raw, at = F.encode("content", "UTF-8"), (F.col("id") % 7 + 1).cast("int")
    f = _files(spark, d).where(~F.substring("content", 1, 12).rlike(r"[^\x00-\x7f]") & (F.length("content") >= F.col("id") % 7 + 5))
    return f.select("id", F.decode(F.substring(raw, at, F.lit(5)), "UTF-8").alias("part"))


# Steps

_SEEN = "q AS (SELECT id, state, id % 31 = 0 AS gone, mtime_ns - CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS enq, mtime_ns, nlink, mode, CASE id % 13 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'unchecked' ELSE 'match' END AS magic, id % 17 = 0 AS hole FROM c)"
_AT = 1_704_067_200_000 + 500 * 60_000


@query(
    f"SELECT id, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'settling' WHEN 2 THEN 'settling' WHEN 6 THEN 'settling' WHEN 7 THEN 'sized' ELSE 'skipped' END AS state, CASE k WHEN 1 THEN {_AT} + 900000 WHEN 2 THEN mtime_ns // 1000000 + 900000 WHEN 6 THEN {_AT} + 86400000 WHEN 7 THEN {_AT} END AS ready_at, CASE k WHEN 3 THEN 'hardlink' WHEN 4 THEN 'special_mode' WHEN 5 THEN 'bad_magic' WHEN 6 THEN 'suspect_partial' END AS reason FROM (SELECT *, CASE WHEN gone THEN 0 WHEN enq <> mtime_ns THEN 1 WHEN mtime_ns // 1000000 > {_AT} - 900000 THEN 2 WHEN nlink > 1 THEN 3 WHEN (mode & 3072) <> 0 THEN 4 WHEN magic = 'mismatch' THEN 5 WHEN hole THEN 6 ELSE 7 END AS k FROM q)",
    _SEEN,
)
def settle_step(spark, d):
    f = _files(spark, d)
    magic = F.when(F.col("id") % 13 == 0, "mismatch").when(F.col("id") % 13 == 1, "unchecked").otherwise("match")
    f = f.withColumns({"gone": F.col("id") % 31 == 0, "enqueued_mtime_ns": F.expr("mtime_ns - if(id % 7 = 0, 1, 0)"), "magic": magic, "hole": F.col("id") % 17 == 0})
    return T.settle(f, _AT, 900_000)


@query(f"SELECT id, CASE WHEN id % 17 = 0 THEN {NOW + DAY} ELSE ready_at END AS ready_at, CASE WHEN id % 17 = 0 THEN 'suspect_partial' END AS reason FROM c WHERE state = 'settling'")
def hole_defer(spark, d):
    hole = F.col("id") % 17 == 0
    return _files(spark, d).where("state = 'settling'").select("id", F.when(hole, F.lit(NOW + DAY)).otherwise(F.col("ready_at")).alias("ready_at"), F.when(hole, "suspect_partial").alias("reason"))


@query("SELECT id, CASE state WHEN 'settling' THEN 'settle' WHEN 'sized' THEN 'hash' WHEN 'hashed' THEN 'verify' ELSE 'noop' END AS step FROM c")
def dispatch(spark, d):
    return _files(spark, d).select("id", T.dispatch(F.col("state")).alias("step"))


@query(f"SELECT id, CASE WHEN attempts >= 7 THEN 'failed' END AS state, CASE WHEN attempts < 7 THEN {NOW} + least(900000 * CAST(pow(2, attempts + 1) AS BIGINT), 86400000) END AS ready_at FROM c WHERE state IN ({_list(QUEUED)})")
def worker_errors(spark, d):
    state, ready = T.after_error(F.col("attempts"), NOW)
    return _files(spark, d).where(F.col("state").isin(*QUEUED)).select("id", state.alias("state"), ready.alias("ready_at"))


_GROUPED = "g AS (SELECT id AS group_id, domain_id, size, sha256(content) AS hash, CASE WHEN id % 3 = 0 THEN id + 1 WHEN id % 3 = 1 THEN id END AS canonical_id FROM c WHERE id % 4 <> 3), w AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN id - id % 3 END AS group_id), sha256(content) AS hash FROM c)"


def _grouped(spark, d):
    f = _files(spark, d).withColumn("hash", H.full_hash(F.col("content")))
    canonical = F.when(F.col("id") % 3 == 0, F.col("id") + 1).when(F.col("id") % 3 == 1, F.col("id"))
    groups = f.where("id % 4 <> 3").select(F.col("id").alias("group_id"), "domain_id", "size", "hash", canonical.alias("canonical_id"))
    return f.withColumn("group_id", F.expr("if(id % 2 = 0, id - id % 3, null)")), groups


@query("SELECT w.id, min(g.group_id) AS group_id FROM w LEFT JOIN g USING (domain_id, size, hash) GROUP BY w.id", _GROUPED)
def group_by_key(spark, d):
    f, groups = _grouped(spark, d)
    return T.group_by_key(f.drop("group_id"), groups)


@query(
    "SELECT f.id, f.gid AS group_id, CASE WHEN f.gid IS NULL THEN 'find_candidates' WHEN g.canonical_id = f.id THEN 'canonical' WHEN EXISTS (FROM w x WHERE x.id = g.canonical_id AND x.state NOT IN ('missing', 'gone') AND x.group_id = f.gid) THEN 'hashed' ELSE 'canonical' END AS state FROM (SELECT w.id, min(g.group_id) AS gid FROM w LEFT JOIN g USING (domain_id, size, hash) GROUP BY w.id) f LEFT JOIN g ON g.group_id = f.gid",
    _GROUPED,
)
def place_in_group(spark, d):
    f, groups = _grouped(spark, d)
    return T.place_in_group(f.drop("group_id"), groups, f)


@query("SELECT a.group_id, (SELECT min(b.group_id) FROM g b WHERE b.size = a.size AND b.hash = a.hash AND b.domain_id = a.domain_id AND b.group_id > a.group_id) AS next_group FROM g a", _GROUPED)
def next_group(spark, d):
    return T.next_groups(_grouped(spark, d)[1])


@query(
    f"SELECT a.id AS a, b.id AS b, CASE WHEN a.reason IS NOT NULL OR b.reason IS NOT NULL THEN 'filtered' WHEN a.domain_id <> b.domain_id THEN 'other_domain' WHEN a.size <> b.size THEN 'other_size' WHEN a.magic = 'mismatch' OR b.magic = 'mismatch' THEN 'bad_magic' WHEN a.hash <> b.hash THEN 'other_hash' WHEN a.content <> b.content THEN 'other_bytes' ELSE 'same' END AS verdict FROM x a JOIN x b ON (b.id = a.id + 1 OR b.size = a.size AND a.id < b.id)",
    f"x AS (SELECT id, CASE WHEN id % 2 = 0 THEN {_REASON} END AS reason, domain_id, size, CASE WHEN id % 13 = 0 THEN 'mismatch' ELSE 'match' END AS magic, substring(sha256(content), 1, 1) AS hash, content FROM c)",
)
def pair_explain(spark, d):
    f = _files(spark, d)
    reason = F.when(F.col("id") % 2 == 0, P.reject_reason(F.col("rel_path"), F.col("size"), EXCLUDED, MIN_SIZE))
    # One digit of the hash, so that pairs of equal hash and other bytes are among them.
    f = f.select("id", reason.alias("reason"), "domain_id", "size", F.when(F.col("id") % 13 == 0, "mismatch").otherwise("match").alias("magic"), F.substring(H.full_hash(F.col("content")), 1, 1).alias("hash"), "content")
    return T.explained(T.peers(f))


# Guards

_SCANS = "v AS (SELECT id AS scan, 1 + id % 3 AS root_id, CASE WHEN id % 3 = 2 THEN 'remote' ELSE 'local' END AS kind, id % 11 <> 0 AS unchanged, CASE WHEN id % 13 = 0 THEN 2 ELSE 0 END AS folder_errors, CASE WHEN id % 7 <> 0 THEN 100 + id END AS known, CASE WHEN id % 17 = 0 THEN 0 ELSE 60 + id * 31 % 80 END AS seen, id % 5 % 2 AS errors, CASE WHEN id % 4 = 0 THEN 70 WHEN id % 4 = 1 THEN 0 END AS seen_before, id % 6 AS vanished FROM c)"
_BLOCKED = "b AS (SELECT *, CASE WHEN NOT unchanged THEN 'root_changed' WHEN folder_errors > 0 THEN 'read_errors' WHEN known IS NULL THEN 'count_unreadable' WHEN seen = 0 THEN 'nothing_seen' WHEN seen * 100 >= known * CASE kind WHEN 'remote' THEN 75 ELSE 90 END THEN NULL WHEN seen_before > 0 AND seen >= seen_before THEN 'by_record' ELSE 'too_few' END AS why FROM v)"


@query("SELECT scan, nullif(why, 'by_record') AS blocked, coalesce(why = 'by_record', false) AS by_record, unchanged AND errors = 0 AND seen > 0 AND known IS NOT NULL AS trusted, coalesce(errors = 0 AND vanished * 100 <= known * 2, false) AS may_expire FROM b", f"{_SCANS}, {_BLOCKED}")
def presence_verdict(spark, d):
    scans = spark.sql(f"WITH {_SCANS} SELECT * FROM v".replace("FROM c)", "FROM {c})"), c=_files(spark, d))
    out = V.verdict(scans)
    return out.select("scan", "blocked", "by_record", "trusted", V.may_expire(F.col("errors"), F.col("vanished"), F.col("known")).alias("may_expire"))


@query("SELECT root_id, count(DISTINCT CASE WHEN id % 9 <> 0 THEN ino END) AS seen, count_if(id % 9 = 0) AS errors FROM c GROUP BY 1")
def presence_seen(spark, d):
    reads = _files(spark, d).select("root_id", "sub_id", "ino", F.when(F.col("id") % 9 == 0, 5).alias("errno"))
    return V.seen_files(reads)


@query(f"SELECT id, 'gone' AS state FROM c WHERE state = 'missing' AND updated_at < {NOW - 100 * DAY} AND root_id IN (SELECT root_id FROM c GROUP BY 1 HAVING count_if(id % (40 * root_id) = 7) * 100 <= count_if(state <> 'gone') * 2)")
def presence_expire_guarded(spark, d):
    f = _files(spark, d)
    scans = f.groupBy("root_id").agg(F.count_if(F.col("id") % (40 * F.col("root_id")) == 7).alias("vanished"), F.count_if(F.col("state") != "gone").alias("known"))
    ok = scans.where(V.may_expire(F.lit(0), F.col("vanished"), F.col("known"))).select("root_id")
    old = f.where((F.col("state") == "missing") & (F.col("updated_at") < NOW - 100 * DAY))
    return old.join(F.broadcast(ok), "root_id", "left_semi").select("id", F.lit("gone").alias("state"))


# Upkeep

_LEDGER = "l AS (SELECT id, updated_at AS ts, last_error AS note FROM c), e AS (SELECT id + 1000000 AS id, updated_at AS ts, last_error AS note, skip_reason AS extra FROM c WHERE id % 2 = 0)"


@query("SELECT * FROM l UNION ALL SELECT id, ts, CASE WHEN note IS NULL THEN extra WHEN extra IS NULL THEN note ELSE note || ' | ' || extra END FROM e", _LEDGER)
def ledger_append(spark, d):
    f = _files(spark, d)
    events = f.select("id", F.col("updated_at").alias("ts"), F.col("last_error").alias("note"))
    new = f.where("id % 2 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("updated_at").alias("ts"), F.col("last_error").alias("note"), F.col("skip_reason").alias("extra"))
    return L.append(events, new)


@query("SELECT owner_uid AS key, max(id) AS seq, arg_max(rel_path, id) AS value FROM c GROUP BY 1")
def setting_upsert(spark, d):
    return L.latest(_files(spark, d).select(F.col("owner_uid").alias("key"), F.col("id").alias("seq"), F.col("rel_path").alias("value")), ["key"], "seq")


_ENTRIES = "j AS (SELECT id, 'planned' AS state, id AS seq FROM c WHERE id % 3 <> 0), u AS (SELECT id, CASE id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'aborted' WHEN 2 THEN 'cloned' ELSE 'compared' END AS state, id + 100000 AS seq FROM c WHERE id % 2 = 0)"


@query("SELECT id, state, seq, id IN (SELECT id FROM j) AS known FROM (SELECT id, max(seq) AS seq, arg_max(state, seq) AS state FROM (FROM j UNION ALL FROM u) GROUP BY 1) WHERE id NOT IN (SELECT id FROM j) OR state NOT IN ('done', 'aborted')", _ENTRIES)
def journal_open(spark, d):
    both = f"WITH {_ENTRIES}".replace("FROM c ", "FROM {c} ")
    f = _files(spark, d)
    return L.open_journal(spark.sql(f"{both} SELECT * FROM j", c=f), spark.sql(f"{both} SELECT * FROM u", c=f)).select("id", "state", "seq", "known")


_OLD = NOW - 200 * DAY


@query(f"SELECT group_id, CASE WHEN EXISTS (FROM c x WHERE x.id = canon AND x.state = 'gone' AND x.updated_at < {_OLD}) THEN NULL ELSE canon END AS canonical_id FROM (SELECT group_id, min(id) + group_id % 5 AS canon FROM c WHERE group_id IS NOT NULL GROUP BY 1)")
def purge_pointers(spark, d):
    f = _files(spark, d)
    groups = f.where("group_id is not null").groupBy("group_id").agg((F.min("id") + F.col("group_id") % 5).alias("canonical_id"))
    events = f.select("id", F.col("updated_at").alias("ts"))
    return L.purge(f, groups, events, _OLD, _OLD)[1]


@query(f"SELECT id, updated_at AS ts FROM c WHERE updated_at >= {_OLD}")
def purge_ledger(spark, d):
    f = _files(spark, d)
    return L.purge(f, f.select("group_id", F.col("id").alias("canonical_id")), f.select("id", F.col("updated_at").alias("ts")), _OLD, _OLD)[2]


@query("SELECT 'files' AS what, count(*) AS n FROM c UNION ALL SELECT 'groups', count(DISTINCT group_id) FROM c UNION ALL SELECT 'notes', count(*) FROM c WHERE last_error IS NOT NULL UNION ALL SELECT 'progress', count(DISTINCT root_id) FROM c")
def rebuild_cache(spark, d):
    f = _files(spark, d)
    return L.rebuild(f, f.where("group_id is not null").select("group_id").distinct(), f.where("last_error is not null"), f.select("root_id").distinct())


@query("SELECT id AS group_id, size % 50 AS reclaimable FROM c WHERE size % 50 < 30 OR (size % 50 = 30 AND id < 500) ORDER BY reclaimable DESC, group_id DESC LIMIT 21")
def group_page(spark, d):
    return L.page(_files(spark, d).select(F.col("id").alias("group_id"), (F.col("size") % 50).alias("reclaimable")), (30, 500), 20)


@query(f"SELECT seq, CASE WHEN tried THEN 'given_up' WHEN place > 100 THEN 'rescan' WHEN failed_at + 1000 <= {NOW} THEN 'again' ELSE 'later' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY tried, failed_at, seq) AS place FROM (SELECT id AS seq, root_id, attempts >= 5 AS tried, {NOW} - id * 10 AS failed_at FROM c))")
def retry_queue(spark, d):
    f = _files(spark, d).select(F.col("id").alias("seq"), "root_id", "attempts", (F.lit(NOW) - F.col("id") * 10).alias("failed_at"))
    return L.retries(f, NOW, room=100)


@query("SELECT f.root_id, f.generation, f.generation > 0 AND coalesce(s.begun <> f.generation, true) AS pending FROM (SELECT id AS root_id, id % 4 AS generation FROM c) f LEFT JOIN (SELECT id AS root_id, max(id % 3) AS begun FROM c WHERE id % 5 <> 0 GROUP BY 1) s USING (root_id)")
def rescan_flags(spark, d):
    f = _files(spark, d)
    flags = f.select(F.col("id").alias("root_id"), (F.col("id") % 4).alias("generation"))
    return L.clear_rescan(flags, f.where("id % 5 <> 0").select(F.col("id").alias("root_id"), (F.col("id") % 3).alias("generation")))


_DIRS = "k AS (SELECT DISTINCT root_id, regexp_replace(rel_path, '[^/]*$', '') AS dir FROM c WHERE root_id < 3 OR id % 50 = 0)"


@query("SELECT root_id, n AS n_dirs, n > 60 AS whole, CASE WHEN n > 60 THEN '' ELSE dir END AS dir FROM (SELECT *, count(*) OVER (PARTITION BY root_id) AS n FROM k) GROUP BY ALL", _DIRS)
def walk_queue(spark, d):
    f = _files(spark, d).where("root_id < 3 or id % 50 = 0").select("root_id", F.regexp_replace("rel_path", r"[^/]*\z", "").alias("dir"))
    return L.walk_queue(f, 60)


@query("SELECT id, 'z/' || rel_path AS rel_path, root_id FROM c WHERE id % 9 = 0")
def rename_row(spark, d):
    f = _files(spark, d)
    return C.rename(f, f.where("id % 9 = 0").select("sub_id", "ino", "root_id", F.concat(F.lit("z/"), "rel_path").alias("rel_path")))


@query(f"SELECT id, 'missing' AS state, state AS prev_state, CAST({NOW} AS BIGINT) AS updated_at FROM c WHERE id % 8 = 0 AND state NOT IN ('missing', 'gone')")
def mark_missing_point(spark, d):
    f = _files(spark, d)
    return C.mark_missing_at(f, f.where("id % 8 = 0").select("root_id", "rel_path").distinct(), NOW)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN prev_state IN ('hashed', 'deduped', 'sized') THEN prev_state ELSE 'settling' END ELSE 'settling' END AS state FROM c WHERE state = 'missing' AND root_id <> 3")
def restore_or_reset(spark, d):
    f = _files(spark, d).where("root_id <> 3")
    seen = f.select("sub_id", "ino", "root_id", "rel_path", F.expr("size + id % 2").alias("size"), "mtime_ns", "ctime_ns")
    return C.restore_or_reset(f, seen, S.roots(spark), NOW).select("id", "state")


# Events


@query(
    "SELECT seq, CASE WHEN path = '' AND kind IN ('removed', 'removed_dir', 'removed_unknown') THEN 'error' WHEN kind = 'modified' THEN CASE WHEN settling THEN 'push_ready' ELSE 'ignore' END ELSE CASE kind WHEN 'closed' THEN 'upsert' WHEN 'moved_in' THEN 'upsert' WHEN 'renamed' THEN 'rename' WHEN 'removed' THEN 'mark_missing' WHEN 'removed_dir' THEN 'mark_missing_prefix' WHEN 'created_dir' THEN 'walk' WHEN 'needs_rescan' THEN 'rescan' WHEN 'removed_unknown' THEN 'check_then_mark' WHEN 'renamed_dir' THEN 'rename_prefix' ELSE 'ignore' END END AS action FROM (SELECT id AS seq, ['closed', 'moved_in', 'modified', 'renamed', 'renamed_dir', 'removed_unknown', 'removed', 'removed_dir', 'created_dir', 'needs_rescan', 'other'][id // 11 % 11 + 1] AS kind, CASE WHEN id % 23 = 0 THEN '' ELSE rel_path END AS path, state = 'settling' AND id % 23 <> 0 AS settling FROM c)"
)
def event_table(spark, d):
    f = _files(spark, d)
    kinds = F.array(*(F.lit(k) for k, _ in E.ACTIONS), F.lit("other"))
    kind = F.element_at(kinds, (F.expr("id div 11 % 11") + 1).cast("int"))
    return E.handle(f.select(F.col("id").alias("seq"), kind.alias("kind"), "root_id", F.when(F.col("id") % 23 == 0, "").otherwise(F.col("rel_path")).alias("path")), f)


@query(
    "SELECT seq, kind FROM (SELECT seq, CASE WHEN raw = 'overflow' THEN 'needs_rescan' WHEN NOT inside THEN NULL WHEN raw = 'create' THEN CASE WHEN folder THEN 'created_dir' ELSE 'closed' END WHEN raw = 'close_write' THEN CASE WHEN NOT folder THEN 'closed' END WHEN raw = 'modify' THEN CASE WHEN NOT folder THEN 'modified' END WHEN raw = 'delete' THEN CASE WHEN folder THEN 'removed_dir' ELSE 'removed' END ELSE raw END AS kind FROM w) WHERE kind IS NOT NULL",
    f"{_EV}, w AS (SELECT seq, ['create', 'close_write', 'modify', 'from', 'to', 'delete', 'overflow'][seq % 7 + 1] AS raw, seq % 5 = 0 AS folder, seq % 11 <> 0 AS inside FROM e)",
)
def raw_translation(spark, d):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("create", "close_write", "modify", "from", "to", "delete", "overflow"))), (F.col("seq") % 7 + 1).cast("int"))
    return E.translate(_events(spark, d).select("seq", raw.alias("raw"), (F.col("seq") % 5 == 0).alias("folder"), (F.col("seq") % 11 != 0).alias("inside")))


@query("SELECT seq, event_type AS kind FROM e WHERE seq % 2 = 0 UNION ALL SELECT seq, 'removed_unknown' FROM e WHERE seq % 6 = 3 AND 1706000000000 - ts_ms > 86400000", _EV)
def shutdown_flush(spark, d):
    e = _events(spark, d)
    halves = e.where("seq % 2 = 1").select("seq", "ts_ms", F.expr("if(seq % 3 = 0, 'from', 'to')").alias("kind"))
    return E.flush(e.where("seq % 2 = 0").select("seq", F.col("event_type").alias("kind")), halves, 1_706_000_000_000, 86_400_000)


@query(
    "SELECT dev, ts_ms, CAST(least(greatest(ceil((u - 5000) * 1000 / 0.002), 0), 1000) AS BIGINT) AS wait_ms FROM st",
    f"{_EV}, o AS (SELECT user_id AS dev, ts_ms, least(seq % 4000 + 1, 5000) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, seq % 4000 + 1) AS k FROM e), st AS (SELECT dev, k, ts_ms, CAST(n AS DOUBLE) AS u FROM o WHERE k = 1 UNION ALL SELECT o.dev, o.k, o.ts_ms, greatest(st.u - (o.ts_ms - st.ts_ms) * 0.002 / 1000, 0) + o.n FROM st JOIN o ON o.dev = st.dev AND o.k = st.k + 1)",
)
def token_bucket(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("dev"), "ts_ms", (F.col("seq") % 4000 + 1).alias("n"))
    return E.bucket_waits(e, 0.002, 5000)


@query("SELECT seq, coalesce(seq % 7 = 0, false) OR coalesce(CASE WHEN seq % 3 = 0 THEN seq % 2 = 0 END, false) AS paused FROM e", _EV)
def governor(spark, d):
    return _events(spark, d).select("seq", E.paused(F.col("seq") % 7 == 0, F.when(F.col("seq") % 3 == 0, F.col("seq") % 2 == 0), F.lit(None).cast("boolean")).alias("paused"))
