"""Upserts of places, notes, the status, disk shares and reasons of pairs on small tables, empty ones among them."""

from pyspark.sql import functions as F
from siftline.functions import system
from siftline.operators import events, places, status, steps

ROOT = "id long, path string, kind string, added_at long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_keeps_ids_and_grants_free_ones(spark):
    old = spark.createDataFrame([(1, "/a", "local", 10), (4, "/b", "remote", 20)], ROOT)
    listed = spark.createDataFrame(
        [
            (0, 9, "/a", "remote", 99),  # known: keeps its id and when it was added
            (1, 4, "/c", "local", 30),  # asks for an id that is taken
            (2, 7, "/d", "local", 31),  # gets the id it asks for
            (3, 7, "/e", "local", 32),  # asks after another
            (4, 0, "/f", "local", 33),
            (5, 8, "/f", "remote", 34),  # listed twice: the first names id and time, the last the kind
            (6, -3, "/g", None, None),
            (7, 0, None, "local", 35),  # no key
        ],
        "pos long, " + ROOT,
    )
    got = rows(places.upsert(old, listed, "path", once=("added_at",)))
    assert got == [(1, "/a", "remote", 10), (10, "/f", "remote", 33), (11, "/g", None, None), (4, "/b", "remote", 20), (7, "/d", "local", 31), (8, "/c", "local", 30), (9, "/e", "local", 32)]
    none = spark.createDataFrame([], "pos long, " + ROOT)
    assert rows(places.upsert(old, none, "path")) == rows(old)
    assert rows(places.upsert(old.limit(0), listed.where("pos in (4, 6)"), "path")) == [(1, "/f", "local", 33), (2, "/g", None, None)]
    assert rows(places.upsert(old.limit(0), none, "path")) == []


def test_upsert_may_clear_a_value(spark):
    """What is listed counts as a whole: a null replaces a value."""
    old = spark.createDataFrame([(1, "d1", "broken")], "id long, domain string, error string")
    probe = spark.createDataFrame([(0, 0, "d1", None)], "pos long, id long, domain string, error string")
    assert rows(places.upsert(old, probe, "domain")) == [(1, "d1", None)]


def test_notes_need_their_group(spark):
    note = "group_id long, handled_at long, note string, device string"
    old = spark.createDataFrame([(1, 5, "seen", "x"), (2, 6, "kept", None)], note)
    new = spark.createDataFrame([(1, 8, "again", "y", 0), (1, None, None, None, 1), (3, 9, "new", "z", 2), (7, 9, "nobody", "z", 3), (None, 1, "null", "z", 4)], note + ", pos long")
    groups = spark.createDataFrame([(1,), (1,), (3,), (None,)], "group_id long")
    kept, refused = places.set_notes(old, new, groups)
    assert rows(kept) == [(1, None, None, None), (2, 6, "kept", None), (3, 9, "new", "z")]
    assert [r[2] for r in rows(refused)] == ["nobody", "null"]
    kept, refused = places.set_notes(old, new, groups.limit(0))
    assert rows(kept) == rows(old) and refused.count() == 5


def test_status_of_small_and_empty_catalogs(spark):
    make = lambda data, ddl: spark.createDataFrame(data, ddl)
    files = make([("settling", 5), ("settling", None), ("deduped", None), ("hashed", 1), ("missing", 3)], "state string, ready_at long")
    lines = lambda f, j, p, v: [(r.section, r.name, r.value) for r in status.status_lines(f, make([(1,), (1,), (None,)], "group_id long"), f, j, make([(1, "/a", "local"), (2, "/b", "remote")], "root_id long, path string, kind string"), p, v).orderBy("section", "place").collect()]
    journal, progress = make([("done",), ("sent",)], "state string"), make([(1, "b", None)], "root_id long, phase string, last_dir string")
    volumes = make([(3, "/m", "clone", None), (1, "/n", "none", "refused")], "id long, mount string, backend string, error string")
    assert lines(files, journal, progress, volumes) == [
        (1, "files", "5"),
        (1, "ready", "2"),
        (1, "asleep", "1"),
        (2, "settling", "2"),
        (2, "hashed", "1"),
        (2, "deduped", "1"),
        (2, "missing", "1"),
        (3, "groups", "1"),
        (3, "events", "5"),
        (3, "open journal", "1"),
        (4, "/a", "local"),
        (4, "phase", "b"),
        (4, "/b", "remote, read only"),
        (4, "phase", "not scanned yet"),
        (5, "/n", "none"),
        (5, "error", "refused"),
        (5, "/m", "clone"),
    ]
    bare = lines(files.limit(0), journal.limit(0), progress.limit(0), volumes.limit(0))
    assert bare[:2] == [(1, "files", "0"), (1, "ready", "0")] and bare[-1] == (5, "volumes", "not probed yet")
    assert not {"asleep", "open journal"} & {name for _, name, _ in bare}


def test_share_of_others(spark):
    ddl = "dev string, ts_ms long, ticks long, sectors long, own_bytes long"
    data = [("a", 0, 0, 0, 0), ("a", 1000, 500, 100, 25_600), ("a", 2000, 5000, 100, 0), ("a", 2000, 5000, 100, 0), ("a", 3000, 10, 50, None), ("a", 4000, 510, 150, 999_999), ("b", 5, 1, 1, 1)]
    got = {(r.dev, r.ts_ms): (r.util, r.util_other) for r in events.load_of_others(spark.createDataFrame(data, ddl)).collect()}
    assert got[("a", 1000)] == (0.5, 0.25)  # half of the traffic is the work's own
    assert got[("a", 3000)] == (0.0, 0.0)  # counters fell: another disk, or wrapped
    assert got[("a", 4000)] == (0.5, 0.0)  # own bytes beyond the disk's: all its own
    assert got[("b", 5)] == (None, None)
    assert events.load_of_others(spark.createDataFrame([], ddl)).count() == 0


def test_own_bytes(spark):
    texts = ["rchar: 9\nread_bytes: 4096\nwrite_bytes: 8\ncancelled_write_bytes: 77\n", "read_bytes:12", "write_bytes: x\nwrite_bytes: 3", "", None, "nothing"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", system.own_bytes(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [4104, 12, 3, 0, 0, 0]


def test_all_reasons_of_a_pair(spark):
    files = [
        (1, None, 3, "match", "h", "abc"),
        (2, "temp_file", 3, "mismatch", "h", "abc"),
        (3, None, 3, "unchecked", "h", "abd"),
        (4, None, 3, "match", "k", "abc"),
        (5, "too_small", 4, "mismatch", "h", "abcd"),
        (6, None, 3, None, "h", "abc"),
        (7, None, None, None, None, None),
    ]
    f = spark.createDataFrame(files, "id long, reason string, size long, magic string, hash string, content string")
    pairs = spark.createDataFrame([(1, i) for i in range(2, 8)], "a long, b long")
    got = {r.b: r for r in steps.pair_reasons(pairs, f).collect()}
    assert (got[2].verdict, got[2].b_reason, got[2].b_magic, got[2].same_hash, got[2].first_diff) == ("ignored", "temp_file", "mismatch", True, None)
    assert (got[3].verdict, got[3].first_diff) == ("other_bytes", 2)
    assert (got[4].verdict, got[4].same_hash, got[4].first_diff) == ("other_hash", False, None)
    # Sizes end the checks, but what the filter says is shown.
    assert (got[5].verdict, got[5].b_reason, got[5].b_magic, got[5].same_hash) == ("other_size", "too_small", None, None)
    assert got[6].verdict == "same" and got[7].verdict == "other_size"


def test_pairs_carry_no_contents(spark, monkeypatch):
    monkeypatch.setattr(steps, "TOGETHER", 3)
    base = "x" * 6000
    texts = [base, base, base[:70] + "y" + base[71:], base[:5000] + "y" + base[5001:], "z" + base[1:], "é" + base[2:], "short", "shore", None, ""]
    rows = [(2 * i, None, "d", None if t is None else len(t.encode()), "match", "h", t) for i, t in enumerate(texts)]
    f = spark.createDataFrame([*rows, (1, None, "d", 7, "match", "h", "seventh")], "id long, reason string, domain_id string, size long, magic string, hash string, content string")
    assert "content" not in steps.peers(f).columns
    pairs = {(a.id, b.id) for a in f.collect() for b in f.collect() if b.id == a.id + 1 or (a.size == b.size and a.size is not None and a.id < b.id)}
    of = {r.id: r for r in f.collect()}
    got = {(r.a, r.b): r for r in steps.all_reasons(steps.peers(f), f).collect()}
    assert got.keys() == pairs and len(pairs) == 18
    for (a, b), r in got.items():
        x, y = of[a].content, of[b].content
        same = x is not None and y is not None and len(x.encode()) == len(y.encode())
        want = next((i for i, (p, q) in enumerate(zip(x.encode(), y.encode())) if p != q), None) if same else None
        assert (r.first_diff, r.verdict) == (want, "other_size" if not same else "same" if x == y else "other_bytes"), (a, b)
    verdicts = {(r.a, r.b): r.verdict for r in steps.explained(steps.peers(f)).collect()}
    assert verdicts[0, 2] == "same" and verdicts[0, 6] == "other_bytes" and verdicts[0, 1] == "other_size" and verdicts.keys() == pairs
