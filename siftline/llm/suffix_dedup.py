"""Repeated passages by sparse suffix arrays.

Of all suffixes (word positions) only those are retained that content selects: a position is kept if the
fingerprint of its next ``lead`` words is the least among ``span`` consecutive positions. Any passage of
``least`` = span + lead - 1 words holds the same retained positions wherever it stands. Suffixes whose
leads are equal are neighbours in suffix order; those of different documents are candidates, and their matches
are extended left and right by comparing the windows of ``least`` words around them.

Neighbours are found by hash and not in one sorted array, and pre-aggregated in each task: a passage that a
third of all documents hold costs one row for each task, where a sorted array would hold it in one range."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import prepare, stored

LEAST, SPAN = 50, 32


def _slide(x: np.ndarray, span: int, pick: np.ufunc, fill: int, back: bool) -> np.ndarray:
    """pick over x[i : i + span], or over x[i - span + 1 : i + 1] if back, by doubling; span is a power of two."""
    step = 1
    while step < span:
        y = np.full_like(x, K.U64(fill))
        if back:
            y[step:] = x[:-step]
        else:
            y[:-step] = x[step:]
        x = pick(x, y)
        step *= 2
    return x


def _leads(data: np.ndarray, off: np.ndarray, least: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprints, first word of each text, lead fingerprints, the least of them from each window's start
    on, and whether the window stays in its text."""
    start, end, first = K.words(data, off)
    h = K.span_hashes(data, start, end)
    lead, _ = K.windows(h, first, least - span + 1)
    inside = np.repeat(first[1:], np.diff(first)) - np.arange(len(h)) >= least
    low = _slide(lead, span, np.minimum, (1 << 64) - 1, False) if len(h) else lead
    return h, first, lead, low, inside


def retained(data: np.ndarray, off: np.ndarray, least: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lead fingerprint, word position in its text, offsets by text) of the retained suffixes."""
    h, first, lead, low, inside = _leads(data, off, least, span)
    if not len(h):
        return lead, np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    high = _slide(np.where(inside, low, K.U64(0)), span, np.maximum, 0, True)
    at = np.flatnonzero(high == lead)
    at = at[lead[at] > 0]
    return lead[at], at - np.repeat(first[:-1], np.diff(first))[at], np.searchsorted(at, first)


def passages(data: np.ndarray, off: np.ndarray, candidates: list[np.ndarray], least: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, fingerprint, offsets by text) of the windows of ``least`` words whose retained suffix is a candidate."""
    h, first, lead, low, inside = _leads(data, off, least, span)
    at = np.concatenate([first[i] + c for i, c in enumerate(candidates)]) if candidates else np.zeros(0, np.int64)
    wanted = np.unique(lead[at])
    if not len(wanted):
        return np.zeros(0, np.int64), wanted, np.zeros(len(off), np.int64)
    found = wanted[np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)] == low
    x = np.flatnonzero(found & inside)
    return x - np.repeat(first[:-1], np.diff(first))[x], K.windows(h, first, least)[0][x], np.searchsorted(x, first)


def _retain(batches: Iterator[pa.RecordBatch], least: int, span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in K.texts(batch.column(2)):
            lead, at, by = retained(data, off, least, span)
            _, _, first = K.words(data, off)
            own = [batch.column(i).slice(a, b - a) for i in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first).astype(np.int32)), K.lists(lead, by), K.lists(at.astype(np.int32), by)], ["doc_id", "t1", "t2", "n_words", "lead", "at"])


def _windows(batches: Iterator[pa.RecordBatch], least: int, span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in K.texts(batch.column(2)):
            at = batch.column(3).slice(a, b - a).to_pylist()
            start, fp, by = passages(data, off, [np.array(x, np.int64) for x in at], least, span)
            own = [batch.column(i).slice(a, b - a) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, K.lists(start.astype(np.int32), by), K.lists(fp, by)], ["doc_id", "t1", "start", "fp"])


def _spans(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Joins the windows that overlap or touch, of each document, into spans of words."""
    for batch in batches:
        spans = []
        for starts, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s = np.arange(n - least + 1) if starts is None else np.sort(np.array(starts, np.int64))
            cut = np.flatnonzero(np.diff(s) > least) + 1
            first, last = s[np.concatenate(([0], cut))], s[np.concatenate((cut - 1, [len(s) - 1]))] + least
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(first, last, strict=True)])
        covered = [sum(x["end"] - x["start"] for x in one) for one in spans]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([len(x) for x in spans], pa.int64()), pa.array(covered, pa.int64()), pa.array(spans, kind)], ["doc_id", "n_words", "n_spans", "n_repeated_words", "spans"])


def repeated_passages(docs: DataFrame, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text) that shares a passage of ``least`` words or more with
    another: doc_id, n_words, n_spans, n_repeated_words, spans (of words, end exclusive, in order).

    The spans are all words of all windows of ``least`` words that occur under another doc_id as well.
    Words are compared as they stand; white space between them does not count. span: a power of two below
    least. Copies of a whole text meet by digest before any suffix is taken, and are repeated as a
    whole. Null and empty texts, texts of fewer words and rows without doc_id share nothing. Repeats within
    one doc_id do not count; rows of one doc_id with different texts give a row each. Other columns are ignored; an
    empty table gives no rows."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t1"), F.col("text").cast("string"), F.xxhash64(F.lit("second"), "text").alias("t2"))
    docs = docs.where("doc_id is not null and text is not null")
    schema = "doc_id long, t1 long, t2 long, n_words int, lead array<long>, at array<int>"
    kept = stored(docs.mapInArrow(partial(_retain, least=least, span=span), schema), "suffixes").where(F.col("n_words") >= least)
    rows = kept.select("doc_id", "t1", "t2", "n_words")
    copies = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    whole = rows.join(copies.where("first < last"), ["t1", "t2"], "left_semi").distinct()
    one = kept.join(copies.select("t1", "t2", F.col("first").alias("doc_id")), ["t1", "t2", "doc_id"], "left_semi")
    each = one.select("doc_id", "t1", F.explode(F.arrays_zip("lead", "at")).alias("x")).select("doc_id", "t1", F.col("x.lead").alias("lead"), F.col("x.at").alias("at"))
    # Leads and windows are stored before the joins with them, so that one that very many texts hold can be split.
    runs = stored(each.groupBy("lead").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("lead"), "leads")
    candidates = each.join(runs, "lead", "left_semi").groupBy("doc_id", "t1").agg(F.collect_set("at").alias("at"))
    text = docs.join(candidates, ["doc_id", "t1"]).select("doc_id", "t1", "text", "at")
    windows = stored(text.mapInArrow(partial(_windows, least=least, span=span), "doc_id long, t1 long, start array<int>, fp array<long>"), "windows")
    each = windows.select("doc_id", "t1", F.explode(F.arrays_zip("start", "fp")).alias("x")).select("doc_id", "t1", F.col("x.start").alias("start"), F.col("x.fp").alias("fp"))
    repeated = stored(each.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("fp"), "repeated")
    starts = each.join(repeated, "fp", "left_semi").groupBy("doc_id", "t1").agg(F.collect_set("start").alias("starts"))
    # A copied text is repeated as a whole, its first copy's other matches included.
    parts = starts.join(whole.select("doc_id", "t1"), ["doc_id", "t1"], "left_anti").join(rows.dropDuplicates(["doc_id", "t1"]), ["doc_id", "t1"])
    found = parts.select("doc_id", "t1", "starts", "n_words").union(whole.select("doc_id", "t1", F.lit(None).cast("array<int>"), "n_words"))
    out = "doc_id long, n_words int, n_spans long, n_repeated_words long, spans array<struct<start:int,end:int>>"
    return found.mapInArrow(partial(_spans, least=least), out)
