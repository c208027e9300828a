"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text has a feature for each bucket of its words, one for the range of each structure statistic and one for the
range of each metadata column. A pair of features interacts by the inner product of their factors; the sum over all
pairs comes from the square of the sum less the sum of the squares, in time linear in the features.

The model is fitted on a bounded sample of labelled rows in one task; every row is scored where it lies, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .tables import prepare, small, stored
from .tokenization import release

#: Bits of a word's bucket; factors of a feature.
BITS, FACTORS = 13, 8
BUCKETS = 1 << BITS
#: Labelled rows of each class that a model is fitted on at most, and features of theirs in all: the first by a hash of their id.
SAMPLE, SAMPLE_FEATURES = 10_000, 10_000_000

#: Structure statistics and the bounds of their ranges; a value belongs to the range after the last bound it reaches.
STATISTICS = (
    ("words, as a power of two", tuple(range(1, 18))),
    ("code points a word", (1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 12, 20)),
    ("capitals among letters", (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    ("symbols a word", (0.002, 0.01, 0.03, 0.1, 0.3, 1)),
    ("marks a word", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1)),
    ("exclamation marks a word", (0.002, 0.01, 0.05, 0.2, 0.6)),
    ("digits a word", (0.01, 0.05, 0.2, 1, 3)),
    ("distinct buckets among words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    ("lines equal to an earlier one", (0.01, 0.05, 0.1, 0.2, 0.4, 0.7)),
    ("words a line, as a power of two", tuple(range(1, 14))),
    ("letters among code points of words", (0.2, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99)),
)
_SIZES = [len(b) + 1 for _, b in STATISTICS]
#: Ranges of a metadata column: none, at most 0, and powers of two.
META_RANGES = 34

_LETTER, _UPPER, _SYMBOL, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True
_SYMBOL[list(b"#*$%&|<>@^~_=+\\{}[]")] = True
_MARK[list(b".,;:!?")] = True
_DIGIT[48:58] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[off])


@dataclass(frozen=True)
class Rows:
    """Sparse rows: feature and value of each entry, and the first entry of each row (one more than rows). No row is empty."""

    feature: np.ndarray
    value: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def features(data: np.ndarray, off: np.ndarray, meta: list[np.ndarray]) -> Rows:
    """Features of a slice of texts. meta: of each metadata column its values, NaN for none."""
    docs = len(off) - 1
    start, end, first = K.words(data, off)
    n = np.diff(first)
    one = np.maximum(n, 1)
    doc = np.repeat(np.arange(docs), n)
    bucket = (K.span_hashes(K.LOWER[data], start, end) >> K.U64(64 - BITS)).astype(np.int64)
    key, times = np.unique(doc << BITS | bucket, return_counts=True)
    owner, word = key >> BITS, key & (BUCKETS - 1)
    value = 1 + np.log(times)
    value /= np.sqrt(np.bincount(owner, value**2, docs))[owner]

    solid = ~K._WS[data]
    chars = _sums(solid & ((data & 0xC0) != 0x80), off)
    letters = _sums(_LETTER[data], off)
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((off[:-1], breaks + 1)))
    line_doc = np.sort(np.concatenate((np.arange(docs), np.searchsorted(off, breaks, "right") - 1)))
    stop = np.append(begin[1:], len(data))
    stop[:-1] -= line_doc[1:] == line_doc[:-1]
    count = np.concatenate(([0], np.cumsum(solid)))
    worded = count[stop] > count[begin]
    hashes = K.span_hashes(data, begin[worded], stop[worded]) >> K.U64(12)
    lines = np.bincount(line_doc[worded], minlength=docs)
    distinct = np.bincount((np.unique((line_doc[worded].astype(K.U64) << K.U64(52)) | hashes) >> K.U64(52)).astype(np.int64), minlength=docs)
    values = (
        np.log2(1 + n), chars / one, _sums(_UPPER[data], off) / np.maximum(letters, 1), _sums(_SYMBOL[data], off) / one,
        _sums(_MARK[data], off) / one, _sums(data == 33, off) / one, _sums(_DIGIT[data], off) / one, np.bincount(owner, minlength=docs) / one,
        (lines - distinct) / np.maximum(lines, 1), np.log2(1 + n / np.maximum(lines, 1)), letters / np.maximum(chars, 1),
    )
    base, ranges = BUCKETS, []
    for (_, bounds), x in zip(STATISTICS, values, strict=True):
        ranges.append(base + np.searchsorted(bounds, x, "right"))
        base += len(bounds) + 1
    for x in meta:
        power = np.floor(np.log2(np.clip(np.nan_to_num(x, nan=1.0), 1, 2.0**31)))
        ranges.append(base + np.where(np.isnan(x), 0, np.where(x < 1, 1, 2 + power)).astype(np.int64))
        base += META_RANGES
    each = len(ranges)
    owner = np.concatenate((owner, np.tile(np.arange(docs), each)))
    feature = np.concatenate((word, *ranges))
    value = np.concatenate((value, np.full(docs * each, 1 / np.sqrt(each))))
    order = np.argsort(owner, kind="stable")
    return Rows(feature[order].astype(np.int32), value[order].astype(np.float32), np.searchsorted(owner[order], np.arange(docs + 1)))


@dataclass(frozen=True)
class Machine:
    """bias, weight of each feature, and its factors."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def sums(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: bias and weights, the sum of its features' factors, the sum of their squares."""
        at = rows.first[:-1]
        scaled = self.factor[rows.feature] * rows.value[:, None]
        linear = self.bias + np.add.reduceat(self.weight[rows.feature] * rows.value, at)
        return linear, np.add.reduceat(scaled, at), np.add.reduceat((scaled**2).sum(axis=1), at)

    def scores(self, rows: Rows) -> np.ndarray:
        if len(rows.first) < 2:
            return np.zeros(0)
        linear, total, squares = self.sums(rows)
        return 1 / (1 + np.exp(-np.clip(linear + ((total**2).sum(axis=1) - squares) / 2, -50, 50).astype(float)))


def size(metadata: int) -> int:
    return BUCKETS + sum(_SIZES) + META_RANGES * metadata


def fit(rows: Rows, good: np.ndarray, totals: tuple[float, float], features_: int, batch: int = 256, epochs: int = 10, least_steps: int = 500, rate: float = 0.02, decay: float = 1e-5, seed: int = 1) -> Machine:
    """Logistic loss by Adam over shuffled batches. totals: rows of class 0 and 1 that the sample stands for. A sample of
    one class, or none, gives the share of class 1 (with one row of each added) for every row."""
    n1 = int(good.sum())
    n0 = len(good) - n1
    rnd = np.random.default_rng(seed)
    weight, factor = np.zeros(features_, np.float32), rnd.normal(0, 0.02, (features_, FACTORS)).astype(np.float32)
    prior = float(np.log((totals[1] + 1) / (totals[0] + 1)))
    if not n0 or not n1:
        return Machine(prior, weight, np.zeros_like(factor))
    share = np.where(good, totals[1] / n1, totals[0] / n0)
    share = share / share.mean()
    size_ = np.diff(rows.first)
    theta = [np.array([prior], np.float32), weight, factor]
    mean, square = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    steps, per_epoch = 0, -(-len(good) // batch)
    for _ in range(max(epochs, -(-least_steps // per_epoch))):
        order = rnd.permutation(len(good))
        for i in range(0, len(order), batch):
            b = order[i : i + batch]
            first = np.concatenate(([0], np.cumsum(size_[b])))
            at = np.repeat(rows.first[b] - first[:-1], size_[b]) + np.arange(first[-1])
            part = Rows(rows.feature[at], rows.value[at], first)
            now = Machine(float(theta[0][0]), theta[1], theta[2])
            linear, total, squares = now.sums(part)
            p = 1 / (1 + np.exp(-np.clip(linear + ((total**2).sum(axis=1) - squares) / 2, -30, 30)))
            g = ((p - good[b]) * share[b] / len(b)).astype(np.float32)
            of = part.row
            x = g[of] * part.value
            slope = x[:, None] * (total[of] - theta[2][part.feature] * part.value[:, None])
            grad = [np.array([g.sum()]), np.bincount(part.feature, x, features_), np.stack([np.bincount(part.feature, s, features_) for s in slope.T], axis=1)]
            steps += 1
            for k, (t, d) in enumerate(zip(theta, grad, strict=True)):
                d = d.astype(np.float32) + decay * t * (k > 0)
                mean[k] = 0.9 * mean[k] + 0.1 * d
                square[k] = 0.999 * square[k] + 0.001 * d * d
                t -= rate * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.999**steps)) + 1e-8)
    return Machine(float(theta[0][0]), theta[1], theta[2])


_SPARSE = "feature array<int>, value array<float>"


def _meta(batch: pa.RecordBatch, at: list[int], a: int, b: int) -> list[np.ndarray]:
    return [batch.column(k).slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for k in at]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, good, text, metadata...) to (place, good, feature, value)."""
    release()
    for batch in batches:
        for a, b, data, off in K.texts(batch.column(2)):
            rows = features(data, off, _meta(batch, list(range(3, batch.num_columns)), a, b))
            at = pa.array(rows.first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (rows.feature, rows.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], ["place", "good", "feature", "value"])


def _fit(batches: Iterator[pa.RecordBatch], totals: tuple[float, float], features_: int) -> Iterator[pa.RecordBatch]:
    """One row with the model, from sparse rows in the order of their places, up to SAMPLE_FEATURES features."""
    good, feature, value, sizes, seen = [], [], [], [], 0
    for batch in batches:
        if seen < SAMPLE_FEATURES:
            good.append(batch.column(1).to_numpy(zero_copy_only=False))
            off = batch.column(2).offsets.to_numpy()
            sizes.append(np.diff(off))
            feature.append(batch.column(2).flatten().to_numpy())
            value.append(batch.column(3).flatten().to_numpy())
            seen += len(feature[-1])
    none = [np.zeros(0)]
    rows = Rows(np.concatenate(feature or none).astype(np.int32), np.concatenate(value or none).astype(np.float32), np.concatenate(([0], np.cumsum(np.concatenate(sizes or none)))).astype(np.int64))
    m = fit(rows, np.concatenate(good or none).astype(bool), totals, features_)
    yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.weight.tobytes()]), pa.array([m.factor.tobytes()])], ["bias", "weight", "factor"])


def _metadata(docs: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    """Metadata as doubles; a column that docs lacks, or with a value that is no number, has none."""
    return [(F.expr(f"try_cast(`{c}` as double)") if c in docs.columns else F.lit(None).cast("double")).alias(f"meta_{k}") for k, c in enumerate(columns)]


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",)) -> Machine:
    """A model of ``docs`` (doc_id, text) from ``labels`` (doc_id, quality 0 or 1).

    Of each class the SAMPLE rows with the least hash of their doc_id are taken, up to SAMPLE_FEATURES features in all; both classes
    weigh as much as all their labels. Labels with a null doc_id or another quality than 0 and 1 are left out, of repeated ones the
    least quality counts, of documents that share a doc_id the least text. Labels without a document are not replaced."""
    spark = docs.sparkSession
    prepare(spark)
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good in (0, 1)")
    labels = stored(labels.groupBy("doc_id").agg(F.min("good").alias("good")).withColumn("place", F.xxhash64("doc_id")), "labels")
    counts = {r.good: r.n for r in labels.groupBy("good").agg(F.count("*").alias("n")).collect()}
    totals = float(counts.get(0, 0)), float(counts.get(1, 0))
    part = lambda c: labels.where(F.col("good") == c).orderBy("place", "doc_id").limit(SAMPLE)
    sample = stored(part(0).union(part(1)), "sample")
    meta = _metadata(docs, metadata)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *meta).join(small(sample), "doc_id")
    one = texts.groupBy("doc_id", "place", "good").agg(F.min(F.struct("text", *(f"meta_{k}" for k in range(len(meta))))).alias("t"))
    rows = stored(one.select("place", "good", "t.*").mapInArrow(_sparse, f"place long, good int, {_SPARSE}"), "sparse")
    model = rows.coalesce(1).sortWithinPartitions("place").mapInArrow(partial(_fit, totals=totals, features_=size(len(metadata))), "bias double, weight binary, factor binary").first()
    weight = np.frombuffer(model.weight, np.float32)
    return Machine(model.bias, weight, np.frombuffer(model.factor, np.float32).reshape(len(weight), FACTORS))


def _score(batches: Iterator[pa.RecordBatch], model: Machine, keep: int, text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        parts = [model.scores(features(data, off, _meta(batch, list(range(keep, batch.num_columns)), a, b))) for a, b, data, off in K.texts(batch.column(text))]
        if parts:
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(np.concatenate(parts))], names)


def score(docs: DataFrame, model: Machine, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """Adds ``score`` to each row of ``docs`` (text): the probability of class 1. Null counts as the empty text, which has a score of its
    own. metadata: the columns that the model was trained with, null or missing ones count as none. A column ``score`` is replaced, others are
    kept; rows may repeat; an empty table gives no rows."""
    prepare(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c != "score"])
    rows = docs.select(*docs.columns, *_metadata(docs, metadata))
    schema = StructType([*docs.schema, *StructType.fromDDL("score double")])
    run = partial(_score, model=model, keep=len(docs.columns), text=docs.columns.index("text"), names=[*docs.columns, "score"])
    return rows.mapInArrow(run, schema)
