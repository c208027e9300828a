"""Events that are tried again: the rules of a step, and micro-batches with a restart."""

from siftline.operators import retry
from siftline.sources.publish import current

FAILED = "seq long, root_id long, path string, attempts int, failed_at long"


def test_a_step(spark):
    waiting = spark.createDataFrame([(1, 1, "a", 1, 900), (2, 1, "b", 5, 1000), (3, 1, "c", 2, 1001)], retry.WAITING)
    failed = spark.createDataFrame([(4, 1, "d", 5, 990), (5, 1, "e", 4, 995), (6, 2, "f", None, None), (7, 2, "g", 0, 999)], FAILED)
    got = {r.seq: (r.action, r.attempts, r.not_before) for r in retry.step(waiting, failed, 1000, room=3).collect()}
    assert got == {
        1: ("again", 1, 900),
        2: ("again", 5, 1000),
        3: ("waits", 2, 1001),
        4: ("given_up", 5, None),  # five times were enough
        5: ("waits", 5, 1995),
        6: ("waits", 1, 2000),
        7: ("rescan", 0, None),  # no room
    }
    assert retry.step(waiting.limit(0), failed.limit(0), 5).collect() == []
    assert {r.action for r in retry.step(waiting.where("seq = 3"), failed.where("seq > 4"), 1000, room=0).collect()} == {"waits", "rescan"}


def test_batches_with_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/retries"
    retry.begin(path, spark)
    run = retry.retried(path, room=3)
    state = lambda: ([r.seq for r in current(spark, path, "waiting").orderBy("seq").collect()], [r.seq for r in current(spark, path, "again").orderBy("seq").collect()], tuple(current(spark, path, "progress").first()))
    batch = lambda *rows: spark.createDataFrame(list(rows), FAILED)
    run(batch((1, 1, "a", 0, 100), (2, 1, "b", 0, 600)), 0)
    assert state() == ([1, 2], [], (0, 600, False))
    second = batch((3, 1, "c", 0, 1100), (4, 1, "d", 5, 1000))
    run(second, 1)
    assert state() == ([2, 3], [1], (1, 1100, False))
    retry.retried(path, room=3)(second, 1)  # after a crash the batch comes again
    assert state() == ([2, 3], [1], (1, 1100, False))
    run(batch((5, 1, "e", 1, 700), (6, 1, "f", 1, 700)), 2)  # out of order: the clock stays
    assert state() == ([2, 3, 5], [], (2, 1100, True))
    run(batch((7, 1, "g", 0, 9000)), 3)
    assert state() == ([7], [2, 3, 5], (3, 9000, True))
    run(batch(), 4)
    assert state() == ([7], [], (4, 9000, True))
