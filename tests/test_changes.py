"""Coalescing and pairing: cases of the rules, odd rows, and streams over several micro-batches that come out of order."""

import random

import pytest
from pyspark.sql import functions as F
from siftline.operators import coalesce as K
from siftline.operators import pairing as A
from siftline.operators import prefixes as X
from siftline.sources import catalog as S
from siftline.streaming import state

EVENTS = "root_id long, path string, ts_ms long, seq long, kind string, from_path string"
NOW = 1_700_000_000_000


def coalesced(spark, rows, window=1000):
    out = K.coalesce(spark.createDataFrame([(1, p, NOW + t, i, k, s) for i, (p, t, k, s) in enumerate(rows)], EVENTS).repartition(3), window)
    return [(r.kind, r.from_path, r.absorbed) for r in sorted(out.collect(), key=lambda r: (r.first_ms, r.path or "", r.place))]


def test_a_burst_becomes_one_event(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("root_id"), F.lit("a").alias("path"), (NOW + F.col("id") % 900).alias("ts_ms"), F.col("id").alias("seq"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("from_path"))
    got = K.coalesce(rows, 1000).collect()
    assert [(r.kind, r.absorbed, r.first_ms) for r in got] == [("modified", 49_999, NOW)]


@pytest.mark.parametrize(
    "rows,kept",
    [
        ([("closed", None), ("modified", None)], ["closed"]),
        ([("modified", None), ("closed", None)], ["closed"]),
        ([("closed", None), ("removed", None)], ["closed", "removed"]),
        ([("renamed", "x"), ("removed", None)], ["renamed", "removed"]),
        ([("renamed", "x"), ("renamed", "y")], ["renamed", "renamed"]),
        ([("removed_dir", None), ("created_dir", None)], ["removed_dir", "created_dir"]),
        ([("removed_dir", None), ("removed_dir", None)], ["removed_dir", "removed_dir"]),
        ([("closed", None), ("modified", None), ("closed", None)], ["closed"]),
        ([("closed", None), ("removed", None)] * 50, ["closed", "removed"] * 4),
        ([("renamed", str(i)) for i in range(12)], ["renamed"] * 8),
        ([("needs_rescan", None)], ["needs_rescan"]),
    ],
)
def test_rules(spark, rows, kept):
    lost = rows[0][0] == "needs_rescan"
    got = coalesced(spark, [(None if lost else "a", i, *r) for i, r in enumerate(rows)])
    assert [k for k, _, _ in got] == kept
    assert {n for _, _, n in got} == {len(rows) - len(kept)}
    if len(rows) == 12:
        assert [s for _, s, _ in got] == ["0", "1", "2", "3", "4", "5", "6", "11"]


def test_windows_run_from_the_first_event(spark):
    """An entry ends a window after its first event, also while a file is written without pause."""
    times = [0, 999, 1000, 1500, 2100, 3500, 9000]
    out = K.coalesce(spark.createDataFrame([(1, "a", t, i, "closed", None) for i, t in enumerate(times)], EVENTS), 1000)
    assert sorted((r.first_ms, r.seq, r.absorbed) for r in out.collect()) == [(0, 1, 1), (1000, 3, 1), (2100, 4, 0), (3500, 5, 0), (9000, 6, 0)]


def test_odd_events(spark):
    rows = [(1, "a", 5, 1, "closed", None), (1, "a", 5, 1, "closed", None), (None, "a", 5, 2, "closed", None), (1, None, 5, 3, "needs_rescan", None), (2, "a", -7, 4, "modified", None), (1, "", 0, 5, None, None)]
    got = sorted(((r.root_id, r.path, r.first_ms, r.kind, r.absorbed) for r in K.coalesce(spark.createDataFrame(rows, EVENTS), 1000).collect()), key=str)
    want = [(1, "a", 5, "closed", 1), (None, "a", 5, "closed", 0), (1, None, 5, "needs_rescan", 0), (2, "a", -7, "modified", 0)]
    assert [r for r in got if r[1] != ""] == sorted(want, key=str)
    assert K.coalesce(spark.createDataFrame([], EVENTS), 1000).collect() == []


HALVES = "tracker long, ts_ms long, seq long, mode string, root_id long, path string, to_root_id long, to_path string, folder boolean"


def half(t, at, mode, path=None, to=None, folder=False, tracker=1):
    return (tracker, NOW + at, t, mode, 1 if path is not None else None, path, 1 if to is not None else None, to, folder)


@pytest.mark.parametrize(
    "rows,now,want",
    [
        ([half(1, 0, "from", "x"), half(2, 10, "to", to="a")], None, [("renamed", "a", "x")]),
        ([half(1, 0, "to", to="a")], None, [("moved_in", "a", None)]),
        ([half(1, 0, "to", to="a", folder=True)], None, [("created_dir", "a", None)]),
        ([half(1, 0, "from", "x", tracker=1), half(2, 1, "from", "y", tracker=2), half(3, 2, "to", to="b", tracker=2), half(4, 3, "to", to="a", tracker=1)], None, [("renamed", "a", "x"), ("renamed", "b", "y")]),
        ([half(1, 0, "from", "x")], 2000, []),
        ([half(1, 0, "from", "x")], 2001, [("removed_unknown", "x", None)]),
        ([half(1, 0, "from", "x"), half(2, 2001, "to", to="a")], None, [("moved_in", "a", None), ("removed_unknown", "x", None)]),
        ([half(1, 0, "from", "x"), half(2, 2001, "both", "x", "a")], None, [("removed_unknown", "x", None), ("renamed", "a", "x")]),
        ([half(1, 0, "from", "x"), half(2, 1, "to", to="a"), half(3, 2, "both", "x", "a")], None, [("renamed", "a", "x")]),
        ([half(1, 0, "from", "x"), half(2, 1, "both", "x", "a")], None, [("renamed", "a", "x")]),
        ([half(1, 0, "from", "x"), half(2, 1, "to", to="a"), half(3, 2500, "both", "x", "a")], None, [("renamed", "a", "x"), ("renamed", "a", "x")]),
        ([half(1, 0, "from", "x"), half(2, 1, "to", to=None)], None, [("removed", "x", None)]),
        ([half(1, 0, "from", "x"), half(2, 1, "to", to=None, folder=True)], None, [("removed_dir", "x", None)]),
        ([half(1, 0, "from", None), half(2, 1, "to", to="a")], None, [("moved_in", "a", None)]),
        ([half(1, 0, "from", None), half(2, 1, "to", to=None)], None, []),
        ([half(1, 0, "both", "x", "a", folder=True)], None, [("renamed_dir", "a", "x")]),
        ([half(1, 0, "from", "x"), half(2, 5, "from", "y"), half(3, 9, "to", to="a")], None, [("renamed", "a", "y")]),
    ],
)
def test_pairs(spark, rows, now, want):
    df = spark.createDataFrame(rows, HALVES).repartition(2)
    got = A.pair_halves(df, 2000, None if now is None else NOW + now).collect()
    assert sorted((r.kind, r.path, r.from_path) for r in got) == sorted(want, key=str)


def test_raw_changes(spark):
    """Places in nested roots, a root that goes itself, reading, moves without a tracker."""
    roots = spark.createDataFrame([(1, "/v"), (2, "/v/b/")], "root_id long, path string")
    raw = [
        ("close_write", False, None, "/v/a", None), ("close_write", False, None, "/v/b/a", None), ("close_write", False, None, "/vv/a", None), ("open", False, None, "/v/a", None),
        ("delete", True, None, "/v", None), ("from", True, None, "/v/b", None), ("from", False, None, "/v/c", None), ("delete", None, None, "/v/d", None), ("delete", True, None, "/v/e", None),
        ("create", True, None, "/v/f", None), ("create", False, None, "/v/g", None), ("overflow", None, None, None, None), ("attributes", False, None, "/v/h", None), ("both", False, 7, "/v/i", "/v/b/j"),
    ]
    df = spark.createDataFrame([(i, NOW + i, *r) for i, r in enumerate(raw)], "seq long, ts_ms long, raw string, folder boolean, tracker long, path string, to_path string")
    got = [(r.seq, r.kind, r.root_id, r.path, r.from_root_id, r.from_path) for r in A.translate(df, roots).orderBy("seq").collect()]
    assert got == [
        (0, "closed", 1, "a", None, None), (1, "closed", 2, "a", None, None), (4, "needs_rescan", None, None, None, None), (5, "needs_rescan", None, None, None, None),
        (7, "removed_unknown", 1, "d", None, None), (8, "removed_dir", 1, "e", None, None), (9, "created_dir", 1, "f", None, None), (10, "closed", 1, "g", None, None),
        (11, "needs_rescan", None, None, None, None), (12, "modified", 1, "h", None, None), (13, "renamed", 2, "j", 1, "i"),
    ]
    assert A.translate(df.limit(0), roots).collect() == []


def test_places_among_very_many_folders(spark):
    folders = spark.range(100_000).select(F.col("id").alias("root_id"), F.concat(F.lit("/r"), (F.col("id") % 1000).cast("string"), F.lit("/d"), F.col("id").cast("string")).alias("path"))
    rows = spark.range(3000).select("id", F.concat(F.lit("/r"), (F.col("id") % 1000).cast("string"), F.lit("/d"), (F.col("id") * 40).cast("string"), F.lit("/x/y")).alias("p"))
    out = X.deepest(rows, "p", folders, "path")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
    got = {r.id: r.root_id for r in out.collect()}
    assert got == {i: i * 40 if i * 40 < 100_000 and i * 40 % 1000 == i % 1000 else None for i in range(3000)}


def test_places_with_odd_paths(spark):
    folders = spark.createDataFrame([("", 0), ("/", 9), ("a", 1), ("a/b", 2), ("a/b", 3)], "folder string, n long")
    rows = spark.createDataFrame([("a/b/c", 1), ("a/b", 1), ("a", 1), ("ab/c", 1), ("", 1), (None, 1), ("x", 1), ("x", 1), ("a//c", 1), ("a/b\n/c", 1)], "p string, n long")
    got = sorted(((r.p, r.n) for r in X.deepest(rows, "p", folders, "folder").collect()), key=str)
    want = [("a/b/c", 2), ("a/b", 2), ("a", 1), ("ab/c", 0), ("", 0), (None, None), ("x", 0), ("x", 0), ("a//c", 1), ("a/b\n/c", 1)]
    assert got == sorted(want, key=str)


# Streams


def run_stream(spark, tmp_path, build, schema, batches, restart_after=2):
    """What a stream gives for batches of rows, one file for each micro-batch; it is stopped and started again on the way."""
    source, sink, log = (f"{tmp_path}/{n}" for n in ("in", "out", "log"))

    def start():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return build(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", log).start(sink)

    (tmp_path / "in").mkdir()
    query = start()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
        if i == restart_after:
            query.stop()
            query = start()
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(sink)


def shuffled(rows, seed, parts, reach):
    """Rows dealt to batches, each at most ``reach`` places away from where it belongs."""
    rnd = random.Random(seed)
    rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rnd.random() * reach)]
    step = -(-len(rows) // parts)
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def test_coalesced_stream_out_of_order_with_restart(spark, tmp_path):
    from datetime import datetime, timezone

    rnd = random.Random(4)
    kinds = ["modified", "closed", "removed", "renamed", "modified"]
    at = lambda ms: datetime.fromtimestamp((NOW + ms) / 1000, timezone.utc)
    rows = [(at(t), 1, f"p{rnd.randrange(4)}", i, rnd.choice(kinds), "q") for i, t in enumerate(sorted(rnd.randrange(20_000) for _ in range(300)))]
    rows[100] = (rows[100][0], None, None, 100, "needs_rescan", None)
    end = [(at(10**7), 9, "end", 10**6, "closed", None)]
    schema = "ts timestamp, root_id long, path string, seq long, kind string, from_path string"
    batches = [*shuffled(rows, 1, 5, 40), end, [(at(10**7 + 1), 9, "end", 10**6 + 1, "closed", None)]]
    got = run_stream(spark, tmp_path, lambda s: state.coalesce_stream(s, 1000, "30 seconds"), schema, batches).where("seq < 1000000")
    want = K.coalesce(spark.createDataFrame(rows, schema).withColumn("ts_ms", F.unix_millis("ts")), 1000).select(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.where("absorbed > 0").count() > 10


def test_paired_stream_out_of_order_with_restart(spark, tmp_path):
    from datetime import datetime, timezone

    rnd = random.Random(5)
    rows = []
    for t in range(60):
        base = t * 300
        for mode, delay in (("from", 0), ("to", rnd.choice([5, 900, 2500])), ("both", rnd.choice([10, 1000, 5200]))):
            if rnd.random() < 0.75:
                rows.append((base + delay, t, mode))
    rows.sort()
    full = []
    for i, (ms, t, mode) in enumerate(rows):
        inside = rnd.random() < 0.85
        source = (1, f"a{t}") if mode != "to" and inside else (None, None)
        target = (1, f"b{t}") if mode != "from" and rnd.random() < 0.85 else (None, None)
        full.append((datetime.fromtimestamp((NOW + ms) / 1000, timezone.utc), t, i, mode, *source, *target, rnd.random() < 0.3))
    schema = "ts timestamp, tracker long, seq long, mode string, root_id long, path string, to_root_id long, to_path string, folder boolean"
    end = [(datetime.fromtimestamp((NOW + 10**7 + k) / 1000, timezone.utc), 10**6 + k, 10**6 + k, "from", 1, "end", None, None, False) for k in range(2)]
    got = run_stream(spark, tmp_path, lambda s: state.pair_stream(s, 2000, "30 seconds"), schema, [*shuffled(full, 2, 5, 20), end[:1], end[1:]]).where("seq < 1000000")
    want = A.pair_halves(spark.createDataFrame(full, schema).withColumn("ts_ms", F.unix_millis("ts")), 2000).select(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.kind for r in got.collect()} >= {"renamed", "removed_unknown", "moved_in", "removed"}
