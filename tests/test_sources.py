"""The directory source, snapshots and texts."""

import json
import os

import pytest
from siftline import config
from siftline.operators import guards
from siftline.sources import publish, walk


@pytest.fixture
def tree(tmp_path):
    for p in ("a/x.mp4", "a/b/y.mp4", "a-b/z.mp4", "c/.nodedup", "c/d/w.mp4", "top.mp4"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"0" * len(p))
    os.symlink(tmp_path / "a", tmp_path / "link")
    return str(tmp_path)


def read(spark, tree, **options):
    walk.register(spark)
    return spark.read.format("tree").options(path=tree, **options).load()


def test_walk(spark, tree):
    rows = {r.rel_path: r for r in read(spark, tree).collect()}
    assert sorted(p for p, r in rows.items() if not r.folder) == ["a-b/z.mp4", "a/b/y.mp4", "a/x.mp4", "c/.nodedup", "c/d/w.mp4", "top.mp4"]
    assert sorted(p for p, r in rows.items() if r.folder) == ["a", "a-b", "a/b", "c", "c/d"]
    assert rows["c/d/w.mp4"].marked and not rows["a/x.mp4"].marked
    assert rows["a/x.mp4"].size == 7 and rows["a/x.mp4"].ino == os.stat(f"{tree}/a/x.mp4").st_ino
    assert all(r.errno is None for r in rows.values())


def test_walk_in_branches_and_after_a_cursor(spark, tree):
    files = lambda **o: sorted(r.rel_path for r in read(spark, tree, **o).where("not folder").collect())
    assert files(branches=json.dumps(["a/b", "c/d"])) == ["a/b/y.mp4", "c/d/w.mp4"]
    assert files(cursor="a/b") == ["a-b/z.mp4", "a/b/y.mp4", "a/x.mp4", "c/.nodedup", "c/d/w.mp4", "top.mp4"]
    assert files(cursor="b") == ["c/.nodedup", "c/d/w.mp4", "top.mp4"]


def test_errors_are_rows(spark, tmp_path):
    assert walk.mount_points("1 2 0:1 / /mnt/a\\040b rw\nshort") == {"/mnt/a b"}
    reader = walk.TreeReader({"path": str(tmp_path)})
    row = next(reader.read(walk.Unit([("gone", False, -1, 1)])))
    assert row[0] == "gone" and row[-1] == 2 and len(row) == len(walk.SCHEMA.split(", "))


def test_positional_read(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    assert walk.read_exact(f"{tmp_path}/f", 3, 4) == b"3456"
    with pytest.raises(EOFError):
        walk.read_exact(f"{tmp_path}/f", 8, 4)


def test_publish(spark, tmp_path):
    at = f"file://{tmp_path}/snapshots"
    assert publish.publish({"files": spark.range(3), "groups": spark.range(1)}, at) == 1
    assert publish.publish({"files": spark.range(5), "groups": spark.range(0)}, at) == 2
    assert publish.current(spark, at, "files").count() == 5 and publish.current(spark, at, "groups").count() == 0
    publish.write_report(spark.range(2), f"{at}/report", "csv")
    assert spark.read.option("header", True).csv(f"{at}/report").count() == 2
    with pytest.raises(ValueError):
        publish.write_report(spark.range(2), f"{at}/other", "xml")


def test_texts(spark):
    groups = spark.createDataFrame([(7, 2048, 3, 4096), (9, 10, 2, 10)], "group_id long, size long, members int, reclaimable long")
    totals = spark.createDataFrame([(2, 4096, 0, 10, 1)], "groups int, shared long, verified long, suspected long, cross_groups int")
    members = spark.createDataFrame([(1, 7, "a/x"), (2, 7, "b/y")], "id long, group_id long, rel_path string")
    text = publish.report_text(totals, groups, members, 1)
    assert text.splitlines() == ["2 groups; shared 4.0 KiB, verified 0 B, suspected 10 B; 1 across machines", "#7: 3 x 2.0 KiB, 4.0 KiB reclaimable", "  a/x", "  b/y"]
    lines = spark.createDataFrame([("queue", "ready", "3"), ("files", "all", "9")], "section string, name string, value string")
    assert publish.status_text(lines) == "files:\n  all: 9\nqueue:\n  ready: 3"


def test_presence_session(spark):
    s = guards.Session()
    files = spark.createDataFrame([("1", 1, 1, "sized", 5), ("1", 2, 1, "sized", 5), ("1", 3, 1, "gone", 5)], "sub_id string, ino long, root_id int, state string, updated_at long").selectExpr("*", "ino AS id")
    free = spark.createDataFrame([(1, None), (2, None)], "root_id int, blocked string")
    with pytest.raises(ValueError):
        s.seen(files)
    s.begin(1)
    with pytest.raises(ValueError):
        s.begin(2)
    s.seen(files.where("ino = 1"))
    with pytest.raises(ValueError):
        s.finish(files, 2, 10, free)
    assert [r.id for r in s.finish(files, 1, 10, free).collect()] == [2]
    s.begin(2)
    s.abort()
    with pytest.raises(ValueError):
        s.finish(files, 2, 10, free)
    for blocked in (spark.createDataFrame([(1, "too_few")], "root_id int, blocked string"), free.where("root_id = 2"), free.limit(0)):
        s.begin(1)
        s.seen(files.where("false"))
        assert s.finish(files, 1, 10, blocked).collect() == []


def test_config():
    c = config.Config.from_toml('min_size = "1 MiB"\nroots = ["/a", "/b"]\nremote_roots = ["/r"]\nexclude_dirs = ["x", "@eaDir"]\nflavor = "synology"')
    assert c.min_size == 1 << 20 and c.roots == [(1, "/a", "local"), (2, "/b", "local"), (3, "/r", "remote")]
    dirs = config.excluded_dirs(c.flavor, c.exclude_dirs)
    assert len(dirs) == len(set(dirs)) and dirs[-1] == "x" and "@sharebin" in dirs
    for bad in ("chunks = 1", "what = 2", 'roots = ["/a"]\nremote_roots = ["/a"]', 'min_size = "x"'):
        with pytest.raises(config.ConfigError):
            config.Config.from_toml(bad)
    assert config.parse_window("22:00-05:30") == (1320, 330)
    for bad in ("22:00-22:00", "24:00-01:00", "x"):
        with pytest.raises(config.ConfigError):
            config.parse_window(bad)
