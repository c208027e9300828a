"""Groups from candidate buckets: star-shaped candidate pairs, verification, connected components.

A bucket may hold a large part of all rows, so no step lists all pairs of a bucket and none brings a
bucket to one task:

1. each bucket's hub (its member that shares most buckets with others) is compared with all members;
2. components of the verified links are found;
3. only buckets that still hold more than one component are looked at again: in a few rounds some members of
   each, others in each round, are compared with all members of other components, which joins most of what one hub
   left apart with rows in proportion to the bucket;
4. in buckets that even then hold more than one component, all pairs from different components that can still be linked are
   verified.

A link that is skipped joins two nodes of one component, so the components are those of all links
between bucket partners."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small, stored

#: Rounds of step 3, and members of a bucket that are compared with the others in each.
ROUNDS, DRAWN = 2, 8
#: Buckets of a node, the least ones, that are known where its pairs are made; rows of members that may be broadcast.
KNOWN, SENT = 8, 100_000

Near = Callable[[str, str], Column]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a batch of edges: each node but the roots once, with its least known node."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int, up: dict[int, int] = up) -> int:
            while (above := up.setdefault(x, x)) != x:
                up[x] = up[above]
                x = up[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in list(up) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the least node that can be reached.

    Union-find contracts the edges batch by batch; alternating large and small stars then join what
    batches have found, each round written to the shared folder. Rounds grow with the logarithm of the
    longest path. A node with very many neighbours only meets one row in each join, so that adaptive
    execution can split it. No edges give no rows."""
    e = stored(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "u long, v long").distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v"))
        e = stored(star.where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            break
        state = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def shared(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, ...) of buckets with two or more nodes, with the bucket's ``size``."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "bucket")


def unlike(rows: DataFrame) -> DataFrame:
    """As ``shared``, with one bucket of those that hold the same nodes: they are the same pairs. The same nodes are told by
    their number and two exclusive ors of 64-bit hashes."""
    held = [F.count("*").alias("size"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"nodes{k}") for k in (1, 2))]
    kinds = rows.groupBy("bucket").agg(*held).where("size > 1")
    return rows.join(kinds.groupBy("size", "nodes1", "nodes2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "bucket")


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return stored(members.join(mixed, "bucket", "left_semi"), "open")


def _before(rows: DataFrame) -> DataFrame:
    """The rows with ``before``: those of the node's least KNOWN buckets in them that are less than the row's."""
    least = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("bucket")), 1, KNOWN).alias("least"))
    return rows.join(least, "node").withColumn("before", F.filter("least", lambda b: b < F.col("bucket"))).drop("least")


def _made(members: DataFrame, others: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b, ca, cb), a < b, of a member and another of its bucket that are in different components and near.

    Partners often share many buckets: a pair is made in the least of them, and again only in those beyond the
    first KNOWN of a node (in a round, also from both sides if both are drawn). Where few are left the others are sent to all members, however many of these a bucket holds."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = stored(_before(members).repartition(n, "node", "bucket"), "apart")
    y = x if others is members else _before(others)
    if others.limit(SENT + 1).count() <= SENT:
        y = F.broadcast(y)
    x, y = x.alias("x"), y.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
    if others is members:
        apart &= F.col("x.node") < F.col("y.node")
    apart &= near("x", "y") & ~F.arrays_overlap("x.before", "y.before")
    first = F.col("x.node") < F.col("y.node")
    side = lambda c, yes, no: F.when(first, F.col(f"{yes}.{c}")).otherwise(F.col(f"{no}.{c}"))
    return x.join(y, apart).select(side("node", "x", "y").alias("a"), side("node", "y", "x").alias("b"), side("component", "x", "y").alias("ca"), side("component", "y", "x").alias("cb"))


def link(
    members: DataFrame,
    near: Near,
    verify: Callable[[DataFrame], DataFrame],
    apart: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) of the nodes with a verified link.

    members: bucket, node, size (of the bucket) and a struct ``at`` with what ``near`` needs, one row
    for each node of a bucket. near("x", "y"): a necessary condition for a link between rows with these
    aliases. verify: keeps the linked ones of distinct pairs (a, b), a < b; pairs of steps 3 and 4 come with their components
    (ca, cb), of which links that join nothing new may be left out. apart: distinct pairs of different components
    that may be linked, from the members of open buckets with their component, their bucket's hub
    and the hub's component; without it all pairs of a bucket that ``near`` lets pass."""
    hubs = members.groupBy("node").agg(F.sum("size").alias("hub"))
    centre = members.join(hubs, "node").groupBy("bucket").agg(F.max(F.struct("hub", -F.col("node"), "node", "at")).alias("c"))
    centre = stored(centre.select("bucket", F.col("c.node").alias("node"), F.col("c.at").alias("at")), "hubs")
    x, y = members.alias("x"), centre.alias("y")
    ordered = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    stars = stored(x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") != F.col("y.node")) & near("x", "y")).select(*ordered).distinct(), "pairs")
    edges = stored(verify(stars), "links")
    of = components(edges)
    now = stored(members.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    rest = _open(now)
    if rest.isEmpty():
        return of
    if apart:
        named = centre.join(of, "node", "left").select("bucket", F.col("node").alias("hub"), F.coalesce("component", "node").alias("hub_component"))
        pairs = apart(rest.join(named, "bucket"))
    else:
        joined = []
        for turn in range(ROUNDS):
            pairs = _made(rest, rest.where(F.pmod(F.xxhash64(F.col("node"), F.lit(turn)), F.col("size")) < DRAWN), near).distinct()
            found = stored(verify(stored(pairs, "pairs")), "links")
            joined.append(found)
            known = rest.select("node", "component").distinct()
            of_both = found.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
            above = components(of_both.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            above = above.select(F.col("node").alias("component"), F.col("component").alias("above"))
            rest = _open(rest.join(small(above), "component", "left").withColumn("component", F.coalesce("above", "component")).drop("above"))
            if rest.isEmpty():
                break
        pairs = _made(rest, rest, near).distinct()
        edges = reduce(DataFrame.union, joined, edges)
    more = stored(verify(stored(pairs, "pairs")), "links")
    return of if apart and more.isEmpty() else components(edges.union(more))
