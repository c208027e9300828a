"""Hard negatives through a vector-approximation file.

Each dimension is cut into cells; a row's approximation is the cell of each of its components. For an anchor, a table
gives the least and the greatest contribution of each cell of each dimension, so that bounds of a row's score are sums of table
entries. Only rows whose bounds let them enter a window are scored exactly, so that the result is that of all scores.

Anchors are a stated part of the rows: they go against all rows in blocks of bounded size, and rows never move. A task keeps the best of its own
rows for each window; only those are shuffled."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import prepare, shared_dir, small, stored

#: Cells of a dimension: two open ones, and between them equal ones over SPREAD standard deviations to both sides of the mean.
CELLS, SPREAD = 64, 3.0
#: Components beyond it count as it, so that inner products of up to 8,192 dimensions fit into 64 bits.
LARGEST = 1 << 25
#: Anchors that go against all rows in one pass, and bytes of their vectors.
ANCHORS, ANCHOR_BYTES = 8_192, 32_000_000
#: Anchors whose bounds a task holds at once, for all rows of an Arrow batch.
AT_ONCE = 64
#: Pairs that are scored exactly at once.
PAIRS = 16_384

_NONE = np.iinfo(np.int64).min

_FILE = "vec_id long, label long, anchor boolean, vector array<int>, cells array<tinyint>"
OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def components(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows without null or non-finite components, their lengths, floor(scale * x) of their components one after the other)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    off = np.concatenate(([0], np.cumsum(size)))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[off[1:]] == wrong[off[:-1]])
    x = x[np.repeat(ok, size)]
    return ok, size[ok], np.floor(np.clip(x * float(scale), -LARGEST, LARGEST)).astype(np.int32)


def padded(size: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    """One row for each vector; short ones end in zeros."""
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int32)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), place] = flat
    return out


def _statistics(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows, sum, sum of squares, least and greatest of each dimension over a task's rows."""
    rows, total, square, low, high = 0, np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        ok, size, flat = components(batch.column(0), scale)
        n, width = len(size), max(len(total), int(size.max(initial=0)))
        more = width - len(total)
        total, square = np.append(total, np.zeros(more)), np.append(square, np.zeros(more))
        # A dimension that rows before this batch lack was 0 in them.
        low, high = np.append(low, np.full(more, 0 if rows else LARGEST)), np.append(high, np.full(more, 0 if rows else -LARGEST))
        m = padded(size, flat, width).astype(np.int64)
        if n:
            total += m.sum(axis=0)
            square += (m.astype(float) ** 2).sum(axis=0)
            low, high = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
        rows += n
    d = len(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.full(d + 1, rows)), *(pa.array(np.append(0.0, x)) for x in (total, square)), *(pa.array(np.append(0, x)) for x in (low, high))], ["d", "n", "s", "ss", "low", "high"])


@dataclass(frozen=True)
class Cells:
    """edges: where cells begin but for the first, by dimension; low and high: least and greatest component of each cell."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def width(self) -> int:
        return len(self.edges)

    def of(self, m: np.ndarray) -> np.ndarray:
        out = np.empty(m.shape, np.int8)
        for d in range(self.width):
            out[:, d] = np.searchsorted(self.edges[d], m[:, d], "right")
        return out


def fit_cells(rows: DataFrame, scale: int, cells: int = CELLS) -> Cells:
    """Cells from the statistics of all rows; one row for each dimension reaches the driver."""
    kind = "d long, n long, s double, ss double, low long, high long"
    each = rows.select("embedding").mapInArrow(partial(_statistics, scale=scale), kind).where("n > 0").groupBy("d")
    found = each.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().to_pandas().sort_values("d")
    n = int(found["n"].iloc[0]) if len(found) else 0
    own = found[found["d"] >= 0]
    # Tasks whose rows are all shorter have no row for a dimension: it is 0 there.
    short = own["n"].to_numpy() < n
    low, high = own["low"].to_numpy().astype(np.int64), own["high"].to_numpy().astype(np.int64)
    low, high = np.where(short, np.minimum(low, 0), low), np.where(short, np.maximum(high, 0), high)
    mean = own["s"].to_numpy() / max(n, 1)
    sd = np.sqrt(np.maximum(own["ss"].to_numpy() / max(n, 1) - mean**2, 0))
    edges = np.ceil(mean[:, None] + sd[:, None] * np.linspace(-SPREAD, SPREAD, cells - 1)).astype(np.int64)
    edges = np.clip(edges, low[:, None], high[:, None] + 1)
    return Cells(edges, np.hstack((low[:, None], edges)), np.hstack((edges - 1, high[:, None])))


def _approximate(batches: Iterator[pa.RecordBatch], cells: Cells, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, size, flat = components(batch.column(3), scale)
        m = padded(size, flat, cells.width)
        off = pa.array(np.arange(len(m) + 1, dtype=np.int32) * cells.width)
        vectors = pa.ListArray.from_arrays(off, pa.array(m.ravel(), pa.int32()))
        codes = pa.ListArray.from_arrays(off, pa.array(cells.of(m).ravel(), pa.int8()))
        kept = [batch.column(k).filter(pa.array(ok)) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, vectors, codes], ["vec_id", "label", "anchor", "vector", "cells"])


def bounds(anchors: np.ndarray, cells: Cells, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each row (codes: one row for each dimension) may have with each anchor."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) * max(1, int(np.abs(cells.low).max(initial=0)), int(np.abs(cells.high).max(initial=0)))
    kind = np.int32 if most < 1 << 31 else np.int64
    q = anchors.astype(np.int64)[:, :, None]
    one, two = q * cells.low[None], q * cells.high[None]
    low, high = np.minimum(one, two).astype(kind), np.maximum(one, two).astype(kind)
    lower, upper = np.zeros((len(anchors), codes.shape[1]), kind), np.zeros((len(anchors), codes.shape[1]), kind)
    for d in range(cells.width):
        lower += low[:, d].take(codes[d], axis=1)
        upper += high[:, d].take(codes[d], axis=1)
    return lower, upper


def scores(anchors: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs anchors[a], vectors[b]."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        s = slice(i, i + PAIRS)
        out[s] = np.einsum("ij,ij->i", anchors[a[s]].astype(np.int64), vectors[b[s]].astype(np.int64))
    return out


class Best:
    """The k best (score, then least id) of each window. least: the k-th best score, where there are k."""

    def __init__(self, windows: int, k: int) -> None:
        self.k, self.least = k, np.full(windows, _NONE)
        self.window, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(window):
            return
        w, s, i = np.append(self.window, window), np.append(self.score, score), np.append(self.id, id_)
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        last = rank == self.k - 1
        self.least[w[last]] = s[last]
        keep = rank < self.k
        self.window, self.score, self.id = w[keep], s[keep], i[keep]


def kth(values: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """The k-th largest of each row, at least ``floor``."""
    n = values.shape[1]
    return np.maximum(np.partition(values, n - k, axis=1)[:, n - k], floor) if n >= k else floor


@dataclass(frozen=True)
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def _batch(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, vectors and cells (one row for each dimension) of a batch of the file."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    vectors = batch.column(2).flatten().to_numpy().reshape(len(ids), width)
    codes = np.ascontiguousarray(batch.column(3).flatten().to_numpy().reshape(len(ids), width).T).astype(np.intp)
    return ids, labels, vectors, codes


def _positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, cells: Cells, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each anchor's label among the task's rows: those whose upper bound reaches the k-th greatest lower bound are scored."""
    best = Best(len(anchors.ids), k)
    for batch in batches:
        ids, labels, vectors, codes = _batch(batch, cells.width)
        for label in np.intersect1d(labels, anchors.labels):
            here, wanted = np.flatnonzero(labels == label), np.flatnonzero(anchors.labels == label)
            of_label = codes[:, here]
            for i in range(0, len(wanted), AT_ONCE):
                a = wanted[i : i + AT_ONCE]
                lower, upper = bounds(anchors.vectors[a], cells, of_label)
                other = ids[here][None, :] != anchors.ids[a][:, None]
                lower = np.where(other, lower, np.iinfo(lower.dtype).min)
                reach = kth(lower, k, best.least[a])
                x, y = np.nonzero(other & (upper >= reach[:, None]))
                best.add(a[x], scores(anchors.vectors, vectors, a[x], here[y]), ids[here[y]])
    yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[best.window]), pa.array(best.id), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score"])


@dataclass(frozen=True)
class Windows:
    """Windows of scores (low to high) around positive scores; slots: of each anchor its windows' numbers, -1 where it has fewer."""

    positive: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    slots: np.ndarray


def windows(anchor: np.ndarray, positive: np.ndarray, anchors: int, low: int, high: int) -> Windows:
    """From positive scores of anchors (by number): low * positive <= 100 * score <= high * positive. Those that no score can meet are left out."""
    least, most = -((-low * positive) // 100), (high * positive) // 100
    some = least <= most
    anchor, positive, least, most = anchor[some], positive[some], least[some], most[some]
    order = np.argsort(anchor, kind="stable")
    anchor, positive, least, most = anchor[order], positive[order], least[order], most[order]
    first = np.searchsorted(anchor, np.arange(anchors + 1))
    slots = np.full((anchors, int(np.diff(first).max(initial=0))), -1)
    slots[anchor, np.arange(len(anchor)) - first[anchor]] = np.arange(len(anchor))
    return Windows(positive, least, most, anchor, slots)


def _negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, wins: Windows, cells: Cells, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of other labels in each window among the task's rows: those whose bounds meet the window and reach the k-th
    greatest lower bound of rows that are surely inside are scored."""
    best = Best(len(wins.low), k)
    wanted = np.flatnonzero((wins.slots >= 0).any(axis=1)) if wins.slots.size else np.zeros(0, np.int64)
    for batch in batches:
        ids, labels, vectors, codes = _batch(batch, cells.width)
        for i in range(0, len(wanted), AT_ONCE):
            a = wanted[i : i + AT_ONCE]
            lower, upper = bounds(anchors.vectors[a], cells, codes)
            other = labels[None, :] != anchors.labels[a][:, None]
            enter = np.zeros(other.shape, bool)
            for slot in wins.slots[a].T:
                r = np.flatnonzero(slot >= 0)
                w = slot[r]
                low, high = wins.low[w][:, None], wins.high[w][:, None]
                lo, up, free = lower[r], upper[r], other[r]
                reach = np.maximum(best.least[w], wins.low[w])
                new = np.flatnonzero(best.least[w] == _NONE)
                if len(new):
                    sure = free[new] & (lo[new] >= low[new]) & (up[new] <= high[new])
                    reach[new] = kth(np.where(sure, lo[new], low[new]), k, reach[new])
                enter[r] |= free & (up >= reach[:, None]) & (lo <= high)
            x, y = np.nonzero(enter)
            exact = scores(anchors.vectors, vectors, a[x], y)
            for slot in wins.slots[a].T:
                w = slot[x]
                fits = (w >= 0) & (exact >= wins.low[w]) & (exact <= wins.high[w])
                best.add(w[fits], exact[fits], ids[y[fits]])
    w = best.window
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchors.ids[wins.anchor[w]]), pa.array(wins.positive[w]), pa.array(best.id), pa.array(best.score)],
        ["anchor_id", "positive_score", "negative_id", "negative_score"],
    )


def _first(rows: DataFrame, keys: list[str], score: str, id_: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank; Spark keeps k for each key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _once(rows: DataFrame) -> DataFrame:
    """Rows without a second one of the same vec_id; the least of (label, embedding) stands for rows that share one."""
    repeated = stored(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return rows
    ids = small(repeated)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    least = rows.where(sound).join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("r"))
    return rows.join(ids, "vec_id", "left_anti").unionByName(least.select("vec_id", "r.label", "r.anchor", "r.embedding"))


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``rows`` (vec_id, embedding, integer label).

    A component x becomes floor(scale * x); a score is the integer inner product. ``anchor`` tells anchors among the rows. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by the smaller vec_id.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that share a vec_id the least by
    (label, vector) does. Vectors of different lengths compare as if the shorter ended in zeros; scaled components
    beyond 2**25 count as 2**25. A null anchor condition is false. Other columns are ignored. No anchors, no positives or no rows in the window give
    no rows. All rows are indexed and the result is exact, not approximate."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding")
    rows = _once(rows.where("vec_id is not null and label is not null and embedding is not null"))
    cells = fit_cells(rows, scale)
    file = stored(rows.mapInArrow(partial(_approximate, cells=cells, scale=scale), _FILE), "approximations")
    marked = file.where("anchor")
    count = marked.count()
    blocks = max(1, math.ceil(count / max(1, min(ANCHORS, ANCHOR_BYTES // (4 * max(1, cells.width))))))
    marked = stored(marked.select("vec_id", "label", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")), "anchors")
    file = file.select("vec_id", "label", "vector", "cells")
    path = f"{shared_dir(spark)}/siftline/hard-negatives-{uuid.uuid4().hex}"
    done = 0
    for block in range(blocks if count else 0):
        t = marked.where(F.col("block") == block).orderBy("vec_id").toArrow()
        if not len(t):
            continue
        own = Anchors(t["vec_id"].to_numpy(), t["label"].to_numpy(), t["vector"].combine_chunks().flatten().to_numpy().reshape(len(t), cells.width))
        near = file.mapInArrow(partial(_positives, anchors=own, cells=cells, k=positives), "anchor_id long, positive_id long, positive_score long")
        near = stored(_first(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
        p = near.select("anchor_id", "positive_score").distinct().orderBy("anchor_id", "positive_score").toArrow()
        wins = windows(np.searchsorted(own.ids, p["anchor_id"].to_numpy()), p["positive_score"].to_numpy(), len(own.ids), low, high)
        far = file.mapInArrow(partial(_negatives, anchors=own, wins=wins, cells=cells, k=negatives), "anchor_id long, positive_score long, negative_id long, negative_score long")
        far = _first(far, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        near.join(far, ["anchor_id", "positive_score"]).select(names).write.parquet(f"{path}/block={block}")
        done += 1
    return spark.read.schema(OUTPUT).parquet(f"{path}/block=*") if done else spark.createDataFrame([], OUTPUT)
