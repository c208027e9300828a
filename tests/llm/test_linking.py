import random

from pyspark.sql import functions as F
from siftline.llm.linking import KNOWN, _made, link, unlike


def linked(spark, at, buckets, most):
    """The components of points at places that differ by ``most`` at most, and how many pairs were compared."""
    rows = [(b, n, len(nodes), (at[n],)) for b, nodes in enumerate(buckets) for n in nodes]
    members = spark.createDataFrame(rows, "bucket long, node long, size long, at struct<p:long>")
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        places = members.select("node", F.col("at.p").alias("p")).distinct()
        both = pairs.join(places.toDF("a", "pa"), "a").join(places.toDF("b", "pb"), "b")
        return both.where(F.abs(F.col("pa") - F.col("pb")) <= most).select("a", "b")

    got = {r.node: r.component for r in link(members, lambda x, y: F.lit(True), verify).collect()}
    return got, sum(seen)


def alone(at, buckets, most):
    up = {n: n for n in at}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for nodes in buckets:
        for a in nodes:
            for b in nodes:
                if a < b and abs(at[a] - at[b]) <= most and root(a) != root(b):
                    up[max(root(a), root(b))] = min(root(a), root(b))
    size = {}
    for n in at:
        size[root(n)] = size.get(root(n), 0) + 1
    return {n: root(n) for n in at if size[root(n)] > 1}


def test_a_large_family_is_not_compared_pair_by_pair(spark):
    """600 in a row, of which the hub has links to a quarter: all pairs of the others were some 170,000."""
    at = {n: n for n in range(600)}
    got, pairs = linked(spark, at, [list(range(600))], 150)
    assert got == alone(at, [list(range(600))], 150) and set(got.values()) == {0}
    assert pairs < 20_000


def test_rare_links_are_found_after_the_rounds(spark):
    """Most have no link to any other, so that a few members drawn miss most links."""
    rnd = random.Random(3)
    at = {n: rnd.randrange(40_000) for n in range(400)}
    buckets = [list(range(250)), list(range(200, 400)), [5, 390], [399]]
    got, _ = linked(spark, at, buckets, 30)
    assert got == alone(at, buckets, 30) and len(got) > 50


def test_pairs_that_share_many_buckets_are_made_once(spark):
    """30 nodes in six buckets each of which has one node of its own, so that all others meet six times."""
    rows = [(b, n, 31, (n,), n) for b in range(6) for n in [*range(30), 100 + b]]
    assert len({r[0] for r in rows}) <= KNOWN
    members = spark.createDataFrame(rows, "bucket long, node long, size long, at struct<p:long>, component long")
    made = _made(members, members, lambda x, y: F.lit(True))
    want = {(a, b) for a in range(30) for b in range(a + 1, 30)} | {(n, 100 + b) for n in range(30) for b in range(6)}
    assert sorted((r.a, r.b) for r in made.collect()) == sorted(want)


def test_pairs_beyond_the_known_buckets_are_not_lost(spark):
    rnd = random.Random(7)
    buckets = [sorted(rnd.sample(range(40), rnd.randrange(2, 6))) for _ in range(20 * KNOWN)]
    members = spark.createDataFrame([(b, n, len(nodes), (n,), n) for b, nodes in enumerate(buckets) for n in nodes], "bucket long, node long, size long, at struct<p:long>, component long")
    want = {(a, b) for nodes in buckets for a in nodes for b in nodes if a < b}
    assert {(r.a, r.b) for r in _made(members, members, lambda x, y: F.lit(True)).collect()} == want


def test_one_bucket_of_those_with_the_same_nodes(spark):
    buckets = {1: [1, 2, 3], 2: [3, 2, 1], 3: [1, 2], 4: [1, 2, 4], 5: [7], 6: [2, 1]}
    rows = unlike(spark.createDataFrame([(b, n) for b, nodes in buckets.items() for n in nodes], "bucket long, node long")).collect()
    assert sorted((r.bucket, r.node, r.size) for r in rows) == [(1, 1, 3), (1, 2, 3), (1, 3, 3), (3, 1, 2), (3, 2, 2), (4, 1, 3), (4, 2, 3), (4, 4, 3)]


def test_pairs_are_the_same_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("siftline.llm.linking.SENT", 0)
    test_pairs_that_share_many_buckets_are_made_once(spark)
    test_pairs_beyond_the_known_buckets_are_not_lost(spark)
