"""Near-duplicate documents by SuperMinHash.

SuperMinHash signatures of 128 correlated ranks per document, 32 bands of 4, hub and remainder
verification on full shingle sets (``linking``), union-find and stars for the groups. A pair at
similarity 0.75 shares no band with probability 5e-6."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .linking import link, shared
from .tables import prepare, small, stored
from .tokenization import release

COMPONENTS, ROWS = 128, 4
BANDS = COMPONENTS // ROWS
#: Of 128 two-bit ranks a pair at 0.75 is expected to differ in 24, with a deviation of 4.4 at most.
MOST_DIFFERENT = 44

#: Bytes of text that are signed at once; each costs some 25 times as much for the elements' permutations.
SIGNED_BYTES = 500_000

_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, p1 long, p2 long, q1 long, q2 long"


def _planes(sig: np.ndarray) -> list[np.ndarray]:
    """Two bits of each component, as four columns of 64 bits: lower bits, then upper bits."""
    low = K.mix(sig)
    return [np.packbits(((low >> K.U64(bit)) & K.U64(1)).astype(np.uint8), axis=1).view(K.U64)[:, half] for bit in (0, 1) for half in (0, 1)]


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    release()
    salt = K.mix(np.arange(1, BANDS + 1, dtype=K.U64))
    for batch in batches:
        for a, b, data, off in K.texts(batch.column(1), SIGNED_BYTES):
            elements, at = K.shingle_sets(data, off, k)
            n = np.diff(at)
            one = np.concatenate(([K.U64(0)], np.cumsum(K.mix(elements))))
            two = np.concatenate(([K.U64(0)], np.cumsum(K.mix(elements ^ K.U64(0x5851F42D4C957F2D)))))
            sig = K.superminhash(elements, at, COMPONENTS)
            key = np.zeros((b - a, BANDS), K.U64)
            for j in range(ROWS):
                key = K.mix(key + sig[:, j::ROWS] + K.U64(j + 1))
            key = K.mix(key ^ salt)
            full = n > 0
            p = _planes(sig)
            arrays = [batch.column(0).slice(a, b - a), pa.array(n), K.longs(one[at[1:]] - one[at[:-1]]), K.longs(two[at[1:]] - two[at[:-1]])]
            arrays += [K.lists(key[full].ravel(), np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))))]
            arrays += [K.longs(x) for x in (p[0], p[1], p[2], p[3])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "d1", "d2", "bands", "p1", "p2", "q1", "q2"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in K.texts(batch.column(1)):
            elements, at = K.shingle_sets(data, off, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), K.lists(elements, at)], ["node", "elements"])


def _similar(inter: Column, x: Column, y: Column, percent: int) -> Column:
    return F.lit(100) * inter >= F.lit(percent) * (x + y - inter)


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct k-word
    shingles. component_id is the least doc_id that links reach, kept says whether it is the
    document's own. Null and wordless texts have no shingles and link to nothing. Equal sets meet by
    digest, before any banding, so that copies of any number cost one row each. Rows that share a
    doc_id are one document; a row without doc_id is returned with component_id null and kept true and
    links to nothing. Other columns are ignored; an empty table gives no rows."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(docs.mapInArrow(partial(_sign, k=k), _SIGNED), "signed")
    sets = signed.where("doc_id is not null and n_shingles > 0")
    digest = ["n_shingles", "d1", "d2"]
    copies = stored(sets.groupBy(*digest).agg(F.min("doc_id").alias("node")), "copies")
    first = sets.join(copies.withColumnRenamed("node", "doc_id"), [*digest, "doc_id"], "left_semi").dropDuplicates(["doc_id", *digest])
    at = F.struct(F.col("n_shingles").alias("n"), "p1", "p2", "q1", "q2")
    banded = first.select(F.col("doc_id").alias("node"), at.alias("at"), F.explode("bands").alias("bucket"))
    members = stored(shared(banded), "banded")

    nodes = members.select("node").distinct()
    wanted = docs.join(small(stored(nodes.withColumnRenamed("node", "doc_id"), "nodes")), "doc_id", "left_semi")
    elements = stored(wanted.mapInArrow(partial(_sets, k=k), "node long, elements array<long>"), "sets")

    def near(x: str, y: str) -> Column:
        differ = F.bit_count(F.col(f"{x}.at.p1").bitwiseXOR(F.col(f"{y}.at.p1")).bitwiseOR(F.col(f"{x}.at.q1").bitwiseXOR(F.col(f"{y}.at.q1"))))
        differ += F.bit_count(F.col(f"{x}.at.p2").bitwiseXOR(F.col(f"{y}.at.p2")).bitwiseOR(F.col(f"{x}.at.q2").bitwiseXOR(F.col(f"{y}.at.q2"))))
        n, m = F.col(f"{x}.at.n"), F.col(f"{y}.at.n")
        return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (differ <= MOST_DIFFERENT)

    def verify(pairs: DataFrame) -> DataFrame:
        a = elements.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
        b = elements.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
        inter = F.size(F.array_intersect("ea", "eb"))
        return pairs.join(a, "a").join(b, "b").where(_similar(inter, F.size("ea"), F.size("eb"), percent)).select("a", "b").distinct()

    def apart(rest: DataFrame) -> DataFrame:
        """Pairs of nodes from different components that can still be linked, found through the elements in which
        they differ from a hub h that both were compared with. For D(x) = x ^ h, |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|,
        and a link asks for (100 + percent) |x ^ y| <= (100 - percent) (|x| + |y|). Had x and y a link without common
        elements of D(x) and D(y), both would have one with h and so one component. So they share an element
        among the rarest of each: all but the ``t`` - 1 most frequent, if they share ``t`` at least.
        A hub whose nodes all have another one in common, the largest of each, has no pairs of its own."""
        lo, hi = 100 - percent, 100 + percent
        each = rest.select("hub", "node", "component", "at", (F.col("component") == F.col("hub_component")).alias("inside")).dropDuplicates(["hub", "node"])
        each = stored(each, "hub-nodes")
        # Counts are stored before each join with them, so that a hub or element with very many rows can be split.
        sizes = stored(each.groupBy("hub").agg(F.count("*").alias("of")).where("of > 2"), "hub-sizes")
        each = each.join(small(sizes), "hub")
        largest = each.groupBy("node").agg(F.max(F.struct("of", "hub")).alias("top"))
        covered = each.join(largest, "node").groupBy("hub").agg(F.min("top.hub").alias("lo"), F.max("top.hub").alias("hi")).where("lo = hi and lo <> hub").select("hub")
        each = each.join(small(stored(covered, "covered")), "hub", "left_anti").drop("of")
        x, h = elements.select("node", F.col("elements").alias("ex")), elements.select(F.col("node").alias("hub"), F.col("elements").alias("eh"))
        each = each.join(x, "node").join(h, "hub")
        delta = F.concat(F.array_except("ex", "eh"), F.array_except("eh", "ex"))
        each = each.withColumn("nh", F.size("eh")).withColumn("delta", delta).drop("ex", "eh").withColumn("d", F.size("delta"))
        # The other one of a pair has at least -nh / hi * lo more than it may differ, outside the hub's component nh / hi * lo.
        spare = F.when(F.col("inside"), F.col("nh")).otherwise(-F.col("nh"))
        t = F.greatest(F.lit(1), F.ceil((hi * F.col("d") - lo * F.col("at.n") + lo * spare) / (2 * hi))).cast("int")
        each = stored(each.withColumn("t", t).where("t <= d"), "deltas")
        spread = each.select("hub", "node", F.explode("delta").alias("e"))
        common = stored(spread.groupBy("hub", "e").agg(F.count("*").alias("f")).where("f > 1"), "common")
        held = spread.join(small(common), ["hub", "e"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("held"))
        each = each.drop("delta").join(held, ["hub", "node"]).withColumn("most", F.size("held")).where("most >= t")
        prefix = F.slice("held", F.lit(1), F.col("most") - F.col("t") + 1)
        rare = stored(each.withColumn("e", F.explode(F.transform(prefix, lambda v: v["e"]))).drop("held"), "rare")
        x, y = rare.alias("x"), rare.alias("y")
        differ = hi * (F.col("x.d") + F.col("y.d") - 2 * F.least("x.most", "y.most")) <= lo * (F.col("x.at.n") + F.col("y.at.n"))
        met = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.node") < F.col("y.node"))
        return x.join(y, met & (F.col("x.component") != F.col("y.component")) & differ & near("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    groups = link(members, near, verify, apart)
    component = copies.join(groups, "node", "left").select(*digest, F.coalesce("component", "node").alias("component_id"))
    # Rows that share a doc_id, with different sets, take the least of their components.
    rows = signed.select("doc_id", *digest)
    out = rows.join(component, digest, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
