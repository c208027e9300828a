"""The queue, comparison by blocks, commits, admission, windows and effects of events, on small fixtures."""

import random
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from siftline.functions import windows
from siftline.operators import admission, coalesce, commit, effects, pairing, verify
from siftline.operators import queue as Q
from siftline.sources import publish

NOW = 10_000_000_000
FILES = "id long, domain_id string, size long, mtime_ns long, ctime_ns long, nlink int, mode int, ino long, first_seen_at long, state string, prev_state string, ready_at long, attempts int, skip_reason string, hash string, group_id long"
GROUPS = "group_id long, domain_id string, size long, hash string, canonical_id long"
OBSERVED = "id long, gone boolean, error boolean, size long, mtime_ns long, ctime_ns long, magic string, hole boolean"
SETTINGS = Q.Settings(NOW, settle_ms=1000, chunks=4, length=8, align=1, block=16)

# Comparison


@pytest.mark.parametrize("size,first", [(1, 1), (7, 2), (16, 4)])
def test_blocks_find_the_first_difference(spark, size, first):
    rnd = random.Random(size)
    texts = [b"", b"a", b"ab", bytes(rnd.randrange(256) for _ in range(100))]
    for at in (0, 6, 7, 15, 16, 98, 99):
        x = bytearray(texts[3])
        x[at] ^= 1
        texts.append(bytes(x))
    texts += [texts[3][:50], texts[3] + b"\0", texts[3]]
    files = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)] + [(99, None)], "id long, content binary")
    pairs = spark.createDataFrame([(a, b, "k") for a in range(len(texts)) for b in range(len(texts)) if a < b] + [(0, 99, "k"), (99, 500, "k")], "a long, b long, tag string")
    got = {(r.a, r.b): (r.same, r.at) for r in verify.compare(pairs, verify.blocks(files, size), size, first).collect()}

    def want(x, y):
        at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return (True, None) if x == y else (False, at)

    assert got.pop((0, 99)) == got.pop((99, 500)) == (None, None)
    assert got == {(a, b): want(texts[a], texts[b]) for a, b in got}
    assert verify.compare(pairs.limit(0), verify.blocks(files, size), size).collect() == []


# The queue


def file(id_, size=40, state="settling", **more):
    row = {"id": id_, "domain_id": "d", "size": size, "mtime_ns": 1000 + id_, "ctime_ns": 5, "nlink": 1, "mode": 0o100644, "ino": id_, "first_seen_at": 0, "state": state, "prev_state": None,
           "ready_at": NOW if state in ("settling", "sized", "hashed") else None, "attempts": 0, "skip_reason": None, "hash": None, "group_id": None}
    return tuple({**row, **more}.values())


def text(kind, size=40):
    return bytearray((kind * size)[:size].encode())


def looked(id_, size=40, gone=False, error=False, mtime=None, magic=None, hole=False):
    return (id_, gone, error, size, 1000 + id_ if mtime is None else mtime, 5, magic, hole)


def drained(spark, files, contents, observed=(), groups=()):
    c = spark.createDataFrame([(i, x) for i, x in contents.items()], "id long, content binary")
    out = Q.drain(spark.createDataFrame(files, FILES), spark.createDataFrame(list(groups), GROUPS), c, spark.createDataFrame(list(observed), OBSERVED), SETTINGS)
    return {r.id: r for r in out[0].collect()}, {r.group_id: r for r in out[1].collect()}, out[2].collect(), out[3]


def test_files_come_to_rest(spark):
    """Many cases side by side, each with sizes of its own."""
    collide = {20: text("a"), 21: text("a"), 22: text("a"), 23: text("a")}
    collide[21][9] = collide[22][9] = ord("#")  # where the sparse hash does not look
    sizes = {1: 41, 2: 42, 3: 42, 4: 43, 5: 43, 6: 43, 10: 50, 11: 51, 12: 52, 13: 53, 14: 54, 15: 55, 16: 56, 17: 57, 30: 60, 31: 60, 40: 61, 41: 61, 50: 62, 51: 62, 60: 63, 61: 63, 62: 63}
    files = [file(i, n) for i, n in sizes.items() if i not in (30, 40, 50, 60)] + [file(i) for i in collide]
    files += [file(30, 60, "distinct"), file(40, 61, "distinct"), file(50, 62, ready_at=NOW + 77), file(60, 63, "distinct", nlink=2), file(70, 70, "verified"), file(71, 71, "gone")]
    contents = {i: text("x", n) for i, n in sizes.items()} | collide | {70: text("x", 70)}
    contents[6] = text("y", 43)
    observed = [
        looked(10, 50, gone=True), looked(11, 51, mtime=5), looked(12, 52, magic="mismatch"), looked(13, 53, hole=True), looked(14, 54, error=True), looked(40, 61, gone=True), looked(15, 55, mtime=None),
    ]
    files = [f if f[0] != 16 else file(16, 56, mode=0o104755) for f in files]
    files = [f if f[0] != 17 else file(17, 57, nlink=2) for f in files]
    files = [f if f[0] != 14 else file(14, 54, attempts=7) for f in files]
    got, groups, events, rounds = drained(spark, files, contents, observed)
    state = {i: r.state for i, r in got.items()}
    assert state[1] == "distinct" and got[1].hash
    assert (state[2], state[3]) == ("canonical", "verified") and got[2].group_id == got[3].group_id
    assert [state[i] for i in (4, 5, 6)] == ["canonical", "verified", "distinct"]
    assert [(state[i], got[i].skip_reason) for i in (12, 13, 16, 17)] == [("skipped", "bad_magic"), ("settling", "suspect_partial"), ("skipped", "special_mode"), ("skipped", "hardlink")]
    assert (state[10], got[10].prev_state, state[11], got[11].ready_at, got[11].mtime_ns) == ("missing", "settling", "settling", NOW + 1000, 5)
    assert (state[14], got[14].attempts) == ("failed", 8)
    assert (state[30], state[31], got[31].group_id) == ("canonical", "verified", got[30].group_id)  # a candidate without a hash gets one
    assert (state[40], state[41]) == ("missing", "distinct")  # a candidate that is gone
    assert (state[50], state[51], got[51].ready_at) == ("settling", "sized", NOW + 77)  # a file of the size is not settled yet
    assert [state[i] for i in (60, 61, 62)] == ["skipped", "canonical", "verified"]
    assert (state[70], state[71]) == ("verified", "gone")
    # Equal sparse hashes, two contents: never taken for the same.
    assert {i: state[i] for i in collide} == {20: "canonical", 21: "canonical", 22: "verified", 23: "verified"}
    assert got[20].group_id == got[23].group_id != got[21].group_id == got[22].group_id
    assert got[21].group_id > got[20].group_id
    assert sorted((r.src, r.dst, r.same, r.at) for r in events if r.src in collide) == [(20, 21, False, 9), (20, 22, False, 9), (20, 23, True, None), (21, 22, True, None)]
    assert rounds < 10
    # At rest nothing moves again, and a file that comes later joins its group.
    later = [tuple(r) for r in got.values()] + [file(24)]
    again, _, events, rounds = drained(spark, later, contents | {24: text("a")}, observed, [tuple(g) for g in groups.values()])
    assert (again[24].state, again[24].group_id) == ("verified", got[20].group_id)
    assert {i: again[i].state for i in state} == state
    assert [(r.src, r.dst, r.same) for r in events] == [(20, 24, True)]


def test_a_group_that_has_lost_its_canonical_file(spark):
    files = [file(1, 40, "missing", group_id=9, hash=None), file(2), file(3)]
    h = drained(spark, [file(2)], {2: text("a")})[0][2].hash
    got, groups, _, _ = drained(spark, files, {2: text("a"), 3: text("a")}, groups=[(9, "d", 40, h, 1)])
    assert (got[2].state, got[3].state, got[2].group_id, got[3].group_id, groups[9].canonical_id) == ("canonical", "verified", 9, 9, 2)
    # One that is seen to be gone or changed when another is to be compared with it.
    for seen, after in ((looked(1, gone=True), "missing"), (looked(1, mtime=3), "settling")):
        files = [file(1, 40, "canonical", group_id=9, hash=h), file(2, 40, "hashed", group_id=9, hash=h)]
        got, groups, _, _ = drained(spark, files, {2: text("a")}, [seen], [(9, "d", 40, h, 1)])
        assert (got[1].state, got[2].state, groups[9].canonical_id) == (after, "canonical", 2)
    # A member whose group is not there looks for another.
    got, _, _, _ = drained(spark, [file(2, 40, "hashed", group_id=77, hash=h)], {2: text("a")})
    assert (got[2].state, got[2].group_id) == ("distinct", None)


def test_an_empty_queue(spark):
    got, groups, events, rounds = drained(spark, [], {})
    assert (got, groups, events, rounds) == ({}, {}, [], 0)
    got, *_ = drained(spark, [file(1), file(2)], {1: None})
    assert {r.state for r in got.values()} == {"sized"} and all(r.attempts == 1 and r.ready_at > NOW for r in got.values())  # no content: tried again later


# Commits

PATCH = "map<string,string>"
BATCH = f"seq long, id long, from string, to string, patch {PATCH}, others array<struct<id:long,from:string,to:string,patch:{PATCH}>>, op struct<kind:string,group_id:long,other_id:long,hash:string>, event struct<ts:long,file_id:long>, journal_id long, journal_state string"
CFILES = "id long, size long, state string, updated_at long, ready_at long, priority int, attempts int, last_error string, skip_reason string, sparse_hash string, group_id long, prev_state string, heavy_wait_since long"


def snapshot(spark, at):
    files = [(i, 10, s, 1, 5, 0, 0, None, None, None, None, None, 3) for i, s in enumerate(["sized", "sized", "hashed", "distinct", "hashed"])]
    groups = spark.createDataFrame([(7, 10, "h", 2, None, None, 1)], "id long, size long, sparse_hash string, canonical_file_id long, verified_at long, full_hash string, created_at long")
    journal = spark.createDataFrame([(1, "planned", 1)], "id long, state string, updated_at long")
    events = spark.createDataFrame([], "ts long, file_id long, note string")
    publish.publish({"files": spark.createDataFrame(files, CFILES), "groups": groups, "journal": journal, "events": events}, at)


def tables(spark, at):
    return {t: {r[0] if t != "events" else (r.ts, r.file_id): r for r in publish.current(spark, at, t).collect()} for t in commit.TABLES}


def test_a_commit_is_whole(spark, tmp_path):
    at = f"file://{tmp_path}/db"
    snapshot(spark, at)
    batch = [
        (1, 0, "sized", "hashed", {"ready_at": "9", "sparse_hash": "h"}, [(3, "distinct", "canonical", {"ready_at": None}), (1, "sized", "gone", {}), (4, "settling", "gone", {})], ("create", 20, 3, "h"), (100, 0), 1, "done"),
        (2, 1, "hashed", "verified", {}, [(2, "hashed", "gone", {})], ("verified", 7, None, "full"), (101, 1), None, None),
        (3, 4, "hashed", "verified", {"attempts": "2"}, [], ("verified", 7, None, "full"), (102, 4), None, None),
        (4, 4, "hashed", "failed", {}, [], None, (103, 4), None, None),
    ]
    commit.commit(at, spark.createDataFrame(batch, BATCH), 50)
    got = tables(spark, at)
    f = got["files"]
    assert (f[0].state, f[0].ready_at, f[0].sparse_hash, f[0].group_id, f[0].heavy_wait_since, f[0].updated_at) == ("hashed", 9, "h", 20, None, 50)
    assert (f[3].state, f[3].ready_at, f[3].group_id) == ("canonical", None, 20)
    assert (f[1].state, f[2].state) == ("sized", "hashed")  # one has a transition of its own, the other's main transition was raced
    assert (f[4].state, f[4].attempts) == ("verified", 2)
    assert (got["groups"][20].canonical_file_id, got["groups"][7].full_hash, got["groups"][7].verified_at) == (3, "full", 50)
    assert (got["journal"][1].state, got["journal"][1].updated_at) == ("done", 50)
    assert {k: r.note for k, r in got["events"].items()} == {(100, 0): None, (101, 1): "state_raced", (102, 4): None, (103, 4): "state_raced"}


@pytest.mark.parametrize("op,journal,what", [(("join", 8, None, None), None, "no group"), (("create", 30, 99, "h"), None, "no file"), (None, 5, "no journal")])
def test_a_batch_with_a_fault_changes_nothing(spark, tmp_path, op, journal, what):
    at = f"file://{tmp_path}/db"
    snapshot(spark, at)
    before = tables(spark, at)
    good = (1, 0, "sized", "distinct", {}, [], None, (100, 0), None, None)
    with pytest.raises(commit.Refused, match=what):
        commit.commit(at, spark.createDataFrame([good, (2, 1, "sized", "hashed", {}, [], op, None, journal, "done")], BATCH), 50)
    assert tables(spark, at) == before


# Admission


def replay(arrivals, pending, most, per_uid):
    total, own, out = sum(pending.values()), dict(pending), {}
    for seq, uid in sorted(arrivals):
        out[seq] = total < most and own.get(uid, 0) < per_uid
        total += out[seq]
        own[uid] = own.get(uid, 0) + out[seq]
    return out


@pytest.mark.parametrize("most", [0, 60, 10_000])
def test_admission_is_a_replay(spark, most):
    rnd = random.Random(most)
    arrivals = [(i, rnd.choice([None, 1, 1, 1, 1, 1, 2, 3, 4])) for i in range(200)]
    pending = {1: 3, 2: 12, None: 1, 9: 5}
    df = spark.createDataFrame(arrivals, "seq long, uid long").repartition(4)
    p = spark.createDataFrame(list(pending.items()), "uid long, n long")
    assert {r.seq: r.admitted for r in admission.admit(df, p, most, 10).collect()} == replay(arrivals, pending, most, 10)
    assert admission.admit(df.limit(0), p.limit(0)).collect() == []


def test_admission_of_micro_batches(spark, tmp_path):
    at, rnd = f"file://{tmp_path}/queue", random.Random(3)
    admission.begin(at, spark.createDataFrame([(-1, 1)], "seq long, uid long"))
    arrivals = [(i, rnd.choice([1, 1, 2, 3])) for i in range(60)]
    run = admission.taken_in(at, most=30, per_uid=12)
    for n in range(3):
        part = spark.createDataFrame(arrivals[n * 20 : n * 20 + 20], "seq long, uid long")
        run(part, n)
        run(part, n)  # a batch that comes again
    want = replay(arrivals, {1: 1}, 30, 12)
    assert {r.seq for r in publish.current(spark, at, "queue").collect()} - {-1} == {s for s, ok in want.items() if ok}
    assert publish.current(spark, at, "progress").first() == (2, True)
    admission.leave(at, publish.current(spark, at, "queue").where("uid = 1"))
    run(spark.createDataFrame([(100, 1)], "seq long, uid long"), 3)
    assert 100 in {r.seq for r in publish.current(spark, at, "queue").collect()}


# Windows


def test_window_lists(spark):
    zone = "Asia/Ho_Chi_Minh"
    at = lambda h, m=0, day=15, z=zone: int(datetime(2026, 3, day, h, m, tzinfo=ZoneInfo(z)).timestamp() * 1000)

    def look(ms, wins, z=zone):
        r = spark.createDataFrame([(ms,)], "t long").select(*(c.alias(n) for c, n in zip(windows.heavy_window(F.col("t"), wins, z), ("inside", "next"), strict=True))).first()
        return r.inside, r.next

    night, two = [(60, 360)], [(60, 360), (1350, 1425)]
    assert look(at(12), []) == look(at(12), night, "No/Where") == look(None, night) == look(2**62, night) == (True, None)
    assert look(at(3), night) == look(at(1), night) == (True, None)
    assert look(at(12), night) == (False, at(1, day=16))
    assert look(at(0, 30), night) == (False, at(1))
    assert look(at(6), night) == (False, at(1, day=16))
    assert look(at(12), two) == (False, at(22, 30))
    assert look(at(23), two) == (True, None)
    assert look(at(23, 50), two) == (False, at(1, day=16))
    assert look(at(23, 30), [(1380, 300)]) == look(at(2), [(1380, 300)]) == (True, None)
    assert look(at(12, day=28, z="Europe/Berlin"), night, "Europe/Berlin") == (False, at(1, day=29, z="Europe/Berlin"))
    # A start that the clock skips comes as much later, one that it repeats counts the first time.
    assert look(at(1, day=29, z="Europe/Berlin"), [(150, 240)], "Europe/Berlin") == (False, at(3, 30, day=29, z="Europe/Berlin"))
    autumn = int(datetime(2026, 10, 25, 1, 0, tzinfo=ZoneInfo("Europe/Berlin")).timestamp() * 1000)
    assert look(autumn, [(150, 240)], "Europe/Berlin") == (False, autumn + 90 * 60_000)


# Effects

STAT = "root_id long, path string, status string, sub_id string, ino long, size long, uid long"
CATALOG = "sub_id string, ino long, root_id long, rel_path string, size long, state string, prev_state string, ready_at long, updated_at long"
CHANGES = "seq long, step int, action string, root_id long, path string, from_root_id long, from_path string, sub_id string, ino long"
EVENT = "seq long, kind string, root_id long, path string, from_root_id long, from_path string"


class World:
    """Trees (root: path: inode, or None for a folder) and their catalog; each root stands for a case of its own."""

    def __init__(self, spark, trees, rows=()):
        self.spark, self.trees = spark, trees
        self.files = spark.createDataFrame([(f"d{r}", i, r, p, 9, s, prev, None, 0) for r, own in dict(rows).items() for p, i, s, prev in own], CATALOG)

    def stat(self, places):
        see = lambda r, p: ("file", f"d{r}", self.trees[r][p], 9, 1000) if self.trees[r].get(p) else ("folder" if p in self.trees[r] else "gone", None, None, None, None)
        return self.spark.createDataFrame([(r, p, *see(r, p)) for r, p in places], STAT)

    def tick(self, events, status=None, **more):
        """One batch for all roots: coalesced, resolved and applied. Returns each root's actions in order."""
        rows = [(i, k, r, p, r if f is not None else None, f) for i, (r, k, p, f) in enumerate((r, *e) for r, own in events.items() for e in own)]
        df = self.spark.createDataFrame(rows, EVENT).withColumn("ts_ms", F.lit(NOW))
        kept = coalesce.coalesce(df).select("seq", "kind", "root_id", "path", F.when(F.col("from_path").isNotNull(), F.col("root_id")).alias("from_root_id"), "from_path")
        stat = self.stat(sorted({(r[2], p) for r in rows for p in (r[3], r[5]) if p is not None}))
        if status:
            stat = stat.withColumn("status", F.lit(status))
        changes = self.spark.createDataFrame(effects.effects(kept, self.files, stat, ["#recycle", "@eaDir"], 0, **more).orderBy("seq", "step").collect(), CHANGES)
        root = {r[0]: r[2] for r in rows}
        self.files = self.spark.createDataFrame(effects.apply_changes(self.files, changes, stat, NOW, 500).collect(), CATALOG)
        out = {r: [] for r in events}
        for c in changes.collect():
            out[root[c.seq]].append(c.action)
        return out

    def rows(self):
        out = {r: [] for r in self.trees}
        for r in self.files.collect():
            out[r.root_id].append((r.rel_path, r.ino, r.state))
        return {r: sorted(x) for r, x in out.items()}


def renamed(spark, tracker, source, target, wait=10):
    half = "tracker long, ts_ms long, seq long, mode string, root_id long, path string, to_root_id long, to_path string, folder boolean"
    rows = [(tracker, 0, 0, "from", 1, source, None, None, False), (tracker, wait, 1, "to", None, None, 1, target, False)]
    got = pairing.pair_halves(spark.createDataFrame(rows, half), 2000).orderBy("at_ms", "seq").collect()
    return [(r.kind, r.path, r.from_path) for r in got]


def test_clients_that_write_beside_and_rename(spark):
    """However a client brings a file in, one living row stands for it, and none for its temporary name."""
    rsync, cloud, plain, name = "v/.a.mp4.aBc123", "v/a.mp4.ocTransferId1234.part", "v/tmp.mp4", "v/a.mp4"
    w = World(spark, {1: {rsync: 7}, 2: {cloud: 7}, 3: {plain: 7}, 4: {}, 5: {}})
    first = {r: [("closed", p, None), *[("modified", p, None)] * 3] for r, p in ((1, rsync), (2, cloud), (3, plain))}
    assert w.tick(first) == {1: [], 2: [], 3: ["upsert"]}
    assert w.rows() == {1: [], 2: [], 3: [(plain, 7, "settling")], 4: [], 5: []}
    w.trees = {r: {name: 7} for r in range(1, 6)}
    late = renamed(spark, 11, rsync, name, 4000)  # its second half comes after the window
    assert sorted(e[0] for e in late) == ["moved_in", "removed_unknown"]
    moved = {r: [("renamed", name, p)] for r, p in ((1, rsync), (2, cloud), (3, plain))}
    assert moved[1] == renamed(spark, 11, rsync, name)
    got = w.tick({**moved, 4: [("moved_in", name, None)], 5: late})
    assert got[3] == ["rename", "missing_at", "missing_under"]
    assert w.rows() == {r: [(name, 7, "settling")] for r in range(1, 6)}


A, B = ("a.mp4", 7, "sized", None), ("b.mp4", 8, "sized", None)


CASES = [
    # The branches of a rename.
    ({"#recycle/a.mp4": 7}, [A], [("renamed", "#recycle/a.mp4", "a.mp4")], ["missing_at", "missing_under"], [("a.mp4", 7, "missing")]),
    ({}, [A], [("renamed", "c.mp4", "a.mp4")], ["missing_at", "missing_under"], [("a.mp4", 7, "missing")]),
    ({"e": None}, [("d/a.mp4", 7, "sized", None)], [("renamed", "e", "d")], ["rename_prefix"], [("e/a.mp4", 7, "sized")]),
    ({"c.mp4": 7}, [A], [("renamed", "c.mp4", "a.mp4")], ["rename", "missing_at", "missing_under"], [("c.mp4", 7, "sized")]),
    ({"c.mp4": 7}, [("a.mp4", 7, "missing", "verified")], [("renamed", "c.mp4", "a.mp4")], ["rename", "restore", "missing_at", "missing_under"], [("c.mp4", 7, "verified")]),
    ({"c.mp4": 9}, [A], [("renamed", "c.mp4", "a.mp4")], ["missing_at", "missing_under", "upsert"], [("a.mp4", 7, "missing"), ("c.mp4", 9, "settling")]),
    ({"c.txt": 7}, [A], [("renamed", "c.txt", "a.mp4")], ["missing_at", "missing_under"], [("a.mp4", 7, "missing")]),
    # A new file has taken the old name, or the target's.
    ({"c.mp4": 7, "a.mp4": 5}, [A], [("renamed", "c.mp4", "a.mp4")], ["rename"], [("c.mp4", 7, "sized")]),
    ({"b.mp4": 7}, [A, B], [("renamed", "b.mp4", "a.mp4")], ["rename", "missing_at", "missing_under"], [("b.mp4", 7, "sized"), ("b.mp4", 8, "missing")]),
    ({"a.mp4": 5}, [A], [("removed_unknown", "a.mp4", None)], ["missing_at", "upsert"], [("a.mp4", 5, "settling"), ("a.mp4", 7, "missing")]),
    ({"a.mp4": 8}, [A, B], [("closed", "a.mp4", None)], ["rename", "upsert"], [("a.mp4", 7, "missing"), ("a.mp4", 8, "sized")]),
    # Folders.
    ({"e": None}, [], [("renamed_dir", "e", "d")], ["walk"], []),
    ({"#recycle/d": None}, [("d/a.mp4", 7, "sized", None)], [("renamed_dir", "#recycle/d", "d")], ["missing_at", "missing_under"], [("d/a.mp4", 7, "missing")]),
    ({"e": None}, [("d/x/a.mp4", 7, "sized", None), ("dd/b.mp4", 8, "sized", None)], [("renamed_dir", "e", "d")], ["rename_prefix"], [("dd/b.mp4", 8, "sized"), ("e/x/a.mp4", 7, "sized")]),
    ({"d": None}, [], [("created_dir", "d", None), ("created_dir", "#recycle/d", None), ("moved_in", "d2", None)], ["walk"], []),
    ({}, [("d/a.mp4", 7, "sized", None), ("d", 9, "sized", None), ("dx", 8, "gone", None)], [("removed_dir", "d", None)], ["missing_under"], [("d", 9, "missing"), ("d/a.mp4", 7, "missing"), ("dx", 8, "gone")]),
    ({"d": None}, [("d/a.mp4", 7, "sized", None)], [("removed_unknown", "d", None)], ["walk"], [("d/a.mp4", 7, "sized")]),
    # The root itself is never emptied.
    ({}, [A], [("removed_dir", "", None)], ["error"], [("a.mp4", 7, "sized")]),
    ({}, [A], [("removed_unknown", "", None)], ["error"], [("a.mp4", 7, "sized")]),
    ({"e": None}, [A], [("renamed_dir", "e", "")], ["error"], [("a.mp4", 7, "sized")]),
    # Writing to a file only moves its time, if it settles at that path.
    ({"a.mp4": 7}, [("a.mp4", 7, "settling", None)], [("modified", "a.mp4", None)], ["push_ready"], [("a.mp4", 7, "settling")]),
    ({"l.mp4": 7}, [("a.mp4", 7, "settling", None)], [("modified", "l.mp4", None)], [], [("a.mp4", 7, "settling")]),
    ({"a.mp4": 7}, [A], [("modified", "a.mp4", None)], [], [("a.mp4", 7, "sized")]),
    ({"a.mp4": 7}, [], [("modified", "a.mp4", None)], [], []),
    ({}, [A], [("removed", "a.mp4", None)], ["missing_at"], [("a.mp4", 7, "missing")]),
]


def test_effects(spark):
    """All cases in one batch, each in a root of its own."""
    n = range(len(CASES))
    w = World(spark, {k: CASES[k][0] for k in n}, {k: CASES[k][1] for k in n})
    got = w.tick({k: CASES[k][2] for k in n})
    rows = w.rows()
    for k, (tree, before, events, actions, after) in enumerate(CASES):
        assert (got[k], rows[k]) == (actions, sorted(after)), (k, tree, before, events)


def test_errors_that_pass_and_a_full_queue(spark):
    events = [("closed", "a.mp4", None), ("renamed", "c.mp4", "b.mp4"), ("removed_unknown", "d.mp4", None), ("modified", "e.mp4", None)]
    w = World(spark, {1: {}}, {1: [A, B]})
    assert w.tick({1: events}, status="retry") == {1: ["retry"] * 4}
    assert w.tick({1: events}, status="ignore") == {1: []}
    assert w.rows() == {1: [("a.mp4", 7, "sized"), ("b.mp4", 8, "sized")]}
    # No room: nothing at the place is touched for a file that is not taken in.
    w = World(spark, {1: {"a.mp4": 5, "n.mp4": 6}}, {1: [A]})
    pending, both = spark.createDataFrame([(1000, 3)], "uid long, n long"), {1: [("closed", "a.mp4", None), ("closed", "n.mp4", None)]}
    assert w.tick(both, pending=pending, per_uid=3) == {1: ["rescan", "rescan"]}
    assert w.rows() == {1: [("a.mp4", 7, "sized")]}
    assert w.tick(both, pending=pending, per_uid=4) == {1: ["missing_at", "upsert", "rescan"]}
    assert w.rows() == {1: [("a.mp4", 5, "settling"), ("a.mp4", 7, "missing")]}
