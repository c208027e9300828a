"""A tree on disk: the walk dealt to tasks, presence scans that see too little, and changes as a stream."""

import os

import pytest
from pyspark.sql import functions as F
from siftline.operators import coalesce, pairing, presence
from siftline.sources import changes, walk


def put(root, *paths, data=b"x"):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(data)


def read(spark, root, **options):
    walk.register(spark)
    return spark.read.format("tree").options(path=str(root), **options).load()


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 64])
def test_every_file_once_whatever_the_tasks(spark, tmp_path, parts, monkeypatch):
    deep = "d/" * 12
    put(tmp_path, *(f"a/b{i % 3}/f{i}" for i in range(30)), *(f"flat{i}" for i in range(20)), f"{deep}x", "a/.nodedup")
    (tmp_path / "empty").mkdir()
    monkeypatch.setattr(walk, "FILES", 6)
    reader = walk.TreeReader({"path": str(tmp_path), "parts": str(parts)})
    units = reader.partitions()
    assert len(units) <= parts
    rows = [r for u in units for r in reader.read(u)]
    want = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*"))
    assert sorted(r[0] for r in rows) == want
    assert all(r[-2] == (r[0].startswith("a/") or r[0] == "a") for r in rows)
    if parts == 7:
        # A flat root and a folder with many files are dealt to several tasks.
        own = [sum(1 for r in reader.read(u) if r[0].startswith("flat")) for u in units]
        assert sum(x > 0 for x in own) > 1


def test_other_file_systems_are_passed_over(tmp_path):
    """Without a mount table by the device; with one, mount points below the root."""
    put(tmp_path, "a/x", "b/y")
    reader = walk.TreeReader({"path": str(tmp_path), "parts": "1"})
    assert reader._enters("a", os.stat(tmp_path).st_dev, os.stat(tmp_path).st_dev)
    assert not reader._enters("a", 1, 2)
    table = f"1 2 0:1 / {tmp_path}/a rw\n1 2 0:1 / /other rw"
    reader = walk.TreeReader({"path": str(tmp_path), "mounts": table})
    assert not reader._enters("a", 1, 2)
    assert reader._enters("b", 1, 2)  # not a mount point, whatever its device says
    rows = [r[0] for u in walk.TreeReader({"path": str(tmp_path)}).partitions() for r in walk.TreeReader({"path": str(tmp_path)}).read(u)]
    assert sorted(rows) == ["a", "a/x", "b", "b/y"]


def test_a_root_that_is_not_there_is_a_row(spark, tmp_path):
    rows = read(spark, tmp_path / "none", identity="true").collect()
    assert {r.errno for r in rows} == {2}
    assert {r.rel_path for r in rows} == {""}


# Presence

SCAN, OLD = 2000, 500


def catalog(spark, names, **states):
    rows = [(i, 1, n, "d", i + 100, states.get(n, "sized"), 1000) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id long, root_id long, rel_path string, sub_id string, ino long, state string, updated_at long")


def seen(spark, rows, root=(("d", 7), ("d", 7))):
    own = [(1, "", True, *r, None, True) for r in root]
    return spark.createDataFrame(own + [(1, p, folder, "d", ino, errno, counts) for p, folder, ino, errno, counts in rows], "root_id long, rel_path string, folder boolean, sub_id string, ino long, errno int, counts boolean")


def scan(spark, files, walked, before=None, kind="local", cutoff=OLD):
    roots = spark.createDataFrame([(1, kind, "d", 7)], "root_id long, kind string, sub_id string, ino long")
    records = spark.createDataFrame([] if before is None else [(1, before)], "root_id long, seen_before long")
    out = presence.conclude(walked, roots, files, records, SCAN, cutoff)
    after = {r.rel_path: r.state for r in presence.changed(files, out, 3000).collect()}
    v = out["verdicts"].first()
    return v.blocked, sorted(p for p, s in after.items() if s == "missing"), sorted(p for p, s in after.items() if s == "gone"), [r.seen_before for r in out["records"].collect()]


def plain(n, first=0):
    return [(f"f{i}", False, i + 100, None, True) for i in range(first, n)]


def test_scans_that_conclude_or_not(spark):
    ten = catalog(spark, [f"f{i}" for i in range(10)])
    assert scan(spark, ten, seen(spark, plain(10)))[:2] == (None, [])
    assert scan(spark, ten, seen(spark, plain(10, 1)))[:2] == (None, ["f0"])
    assert scan(spark, ten, seen(spark, plain(10, 2)))[:2] == ("too_few", [])
    assert scan(spark, ten, seen(spark, plain(10, 2)), kind="remote")[:2] == (None, ["f0", "f1"])
    assert scan(spark, ten, seen(spark, plain(1)))[:2] == ("too_few", [])
    assert scan(spark, ten, seen(spark, []))[:2] == ("nothing_seen", [])
    assert scan(spark, ten, seen(spark, []), before=0)[:2] == ("nothing_seen", [])
    assert scan(spark, ten, seen(spark, plain(10, 1), root=(("d", 7), ("d", 8))))[:2] == ("root_changed", [])
    assert scan(spark, ten, seen(spark, plain(10, 1), root=()))[:2] == ("root_changed", [])
    assert scan(spark, ten, seen(spark, [*plain(10, 1), ("sub", True, None, 13, True)]))[:2] == ("read_errors", [])


def test_hard_links_and_filtered_files_do_not_count(spark):
    ten = catalog(spark, [f"f{i}" for i in range(10)])
    links = [(f"l{i}", False, i + 100, None, True) for i in range(5, 10)]
    thumbs = [(f"@eaDir/{i}", False, 900 + i, None, False) for i in range(20)]
    assert scan(spark, ten, seen(spark, plain(10, 3) + links))[:2] == ("too_few", [])
    assert scan(spark, ten, seen(spark, plain(1) + thumbs))[:2] == ("too_few", [])


def test_unreadable_is_not_absent(spark):
    ten = catalog(spark, [f"f{i}" for i in range(20)])
    blocked, missing, gone, records = scan(spark, ten, seen(spark, [*plain(20, 2), ("f0", None, None, 5, True)]))
    assert (blocked, missing) == (None, ["f1"])
    assert records == []  # a scan with errors is no measure for the next


def test_files_expire_only_after_a_clean_scan(spark):
    files = catalog(spark, [f"f{i}" for i in range(100)] + ["old"], old="missing")
    assert scan(spark, files, seen(spark, plain(100)), cutoff=1500)[:3] == (None, [], ["old"])
    blocked, missing, gone, _ = scan(spark, files, seen(spark, plain(100, 5)), cutoff=1500)
    assert (blocked, len(missing), gone) == (None, 6, [])  # five new ones and the old one, which stays


def test_a_second_scan_that_sees_as_much_concludes(spark):
    files = catalog(spark, [f"f{i}" for i in range(100)], **{f"f{i}": "missing" for i in range(12)})
    walked = seen(spark, plain(100, 12))
    blocked, missing, gone, records = scan(spark, files, walked, cutoff=1500)
    assert (blocked, len(missing), gone, records) == ("too_few", 12, [], [88])
    blocked, missing, gone, records = scan(spark, files, walked, before=88, cutoff=1500)
    assert (blocked, missing, len(gone), records) == (None, [], 12, [88])


def test_a_walk_of_a_tree_concludes(spark, tmp_path):
    put(tmp_path, *(f"a/f{i}" for i in range(20)))
    walked = read(spark, tmp_path, identity="true", parts="3").select(F.lit(1).alias("root_id"), "rel_path", "folder", F.col("dev").cast("string").alias("sub_id"), "ino", "errno", F.lit(True).alias("counts"))
    s = os.stat(tmp_path)
    at = [(i, os.stat(tmp_path / f"a/f{i}")) for i in range(20)]
    files = spark.createDataFrame([(i, 1, f"a/f{i}", str(x.st_dev), x.st_ino, "sized", 1000) for i, x in at], "id long, root_id long, rel_path string, sub_id string, ino long, state string, updated_at long")
    os.unlink(tmp_path / "a/f3")
    roots = spark.createDataFrame([(1, "local", str(s.st_dev), s.st_ino)], "root_id long, kind string, sub_id string, ino long")
    out = presence.conclude(walked, roots, files, spark.createDataFrame([], "root_id long, seen_before long"), SCAN, OLD)
    assert [r.id for r in out["missing"].collect()] == [3]


# Changes


def test_changes_of_a_tree_with_restarts(spark, tmp_path):
    """Every start goes on where the last one stopped; a batch that is read again gives the same rows."""
    root, log, sink, checkpoint = (tmp_path / n for n in ("root", "log", "out", "checkpoint"))
    put(root, "a/one", "a/two", "b/c/d/three", "four")
    changes.register(spark)

    def run():
        rows = spark.readStream.format("tree_changes").options(path=str(root), log=str(log), parts="4", depth="1").load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(sink))
        assert query.awaitTermination(120)
        return sorted((r.raw, r.folder, os.path.relpath(r.path, root)) for r in spark.read.parquet(str(sink)).collect())

    assert run() == []
    os.rename(root / "a/one", root / "b/c/uno")
    (root / "four").write_bytes(b"longer")
    put(root, "e/five")
    os.unlink(root / "a/two")
    first = [("close_write", False, "four"), ("from", False, "a/one"), ("from", False, "a/two"), ("to", False, "b/c/uno"), ("to", False, "e/five"), ("to", True, "e")]
    assert run() == sorted(first)
    assert run() == sorted(first)
    put(root, "e/six")
    assert run() == sorted([*first, ("to", False, "e/six")])
    # The rows make events: a move is one, what went alone and what came alone are told apart.
    roots = spark.createDataFrame([(1, str(root))], "root_id long, path string")
    raw = spark.read.parquet(str(sink)).withColumn("ts_ms", F.unix_millis("ts"))
    events = pairing.translate(raw, roots)
    got = {(r.kind, r.path, r.from_path) for r in events.collect()}
    assert got == {("renamed", "b/c/uno", "a/one"), ("removed_unknown", "a/two", None), ("closed", "four", None), ("moved_in", "e/five", None), ("created_dir", "e", None), ("moved_in", "e/six", None)}
    assert coalesce.coalesce(events.withColumnRenamed("at_ms", "ts_ms")).count() == 6


def test_a_task_that_runs_again_gives_the_same(tmp_path, monkeypatch):
    root, log = tmp_path / "root", tmp_path / "log"
    put(root, "a/x", "b/y")
    reader = changes.ChangesReader({"path": str(root), "log": str(log), "parts": "2", "depth": "1"})
    start = reader.initialOffset()
    assert [r for p in reader.partitions(start, start) for r in reader.read(p)] == []
    for p in reader.partitions(start, {"generation": 0}):
        list(reader.read(p))
    os.unlink(root / "a/x")
    end = reader.latestOffset()
    once = [list(reader.read(p)) for p in reader.partitions(start, end)]
    put(root, "a/late")
    assert [list(reader.read(p)) for p in reader.partitions(start, end)] == once
    assert sorted(r[2] for rows in once for r in rows) == ["from"]
    # A folder that cannot be read keeps its files and asks for a rescan.
    reader.commit(end)
    after = reader.latestOffset()
    listed = os.listdir
    monkeypatch.setattr(os, "listdir", lambda p: (_ for _ in ()).throw(PermissionError(13, "no")) if str(p).endswith("/b") else listed(p))
    rows = [r for p in reader.partitions(end, after) for r in reader.read(p)]
    assert sorted((r[2], os.path.relpath(r[5], root)) for r in rows) == [("overflow", "b"), ("to", "a/late")]
    # Without its listing a generation cannot be told from the next.
    reader.commit({"generation": after["generation"] + 1})
    with pytest.raises(FileNotFoundError):
        list(reader.read(changes.Part(0, after["generation"], after["generation"] + 1)))
