"""Benchmark decontamination by canonical templates.

Words are canonicalised: numbers, names and units become typed placeholders, other words lose case and outer
punctuation. Windows of five such words are hash-joined with those of the benchmark's items; a document
that has three quarters of an item's windows is then compared word by word, and it is contaminated if the values
that stand in each slot change consistently (or not at all).

Capitals make a name, so a copy in other capitals has other templates, and items of numbers and names have hardly any.
Windows of the words themselves, without case, are therefore joined beside the templates; a document with three
quarters of those of an item holds it as it is."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import prepare, small, stored
from .tokenization import release

WINDOW, PERCENT = 5, 75
#: Words of a window that are not placeholders, at least.
LITERALS = 2
#: Window fingerprints of a benchmark that are sent to all executors as a filter: 16 MB. A larger benchmark
#: is joined without it.
FILTERED = 2_000_000

#: Names of units.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces pound pounds ml cl dl l litre litres liter liters "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj "
    "cal kcal pa kpa bar k c f degrees percent dollar dollars euro euros cent cents usd eur gbp kb mb gb tb bytes mph kmh"
).split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_KIND = K.mix(np.arange(101, 105, dtype=K.U64))
#: Keeps fingerprints of plain words apart from those of templates.
_PLAIN = K.U64(0x6A09E667F3BCC909)

_OUTER = np.zeros(256, bool)
_OUTER[list(b"!\"'()*,-./:;<=>?[\\]^_`{|}~")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    out = K.LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def _core(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without outer punctuation; words of nothing else stay as they are."""
    a, b = start.copy(), end.copy()
    while len(a) and (go := (a < b) & _OUTER[data[np.minimum(a, len(data) - 1)]]).any():
        a += go
    while len(b) and (go := (a < b) & _OUTER[data[b - 1]]).any():
        b -= go
    return np.where(a < b, a, start), np.where(a < b, b, end)


_UNIT_HASHES = np.sort(np.concatenate([K.span_hashes(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u)])) for u in dict.fromkeys(UNITS)]))


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Canonical word fingerprints, kinds, the first word of each text, and the words' (start, end) bytes.

    A number has a digit. A unit is a known one after a number. A name starts with a capital and does not
    start a text, a line or a sentence."""
    start, end, first = K.words(data, off)
    a, b = _core(data, start, end)
    low = _folded(data)
    h = K.span_hashes(low, a, b)
    count = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    digits, breaks = count(_DIGIT[data]), count(data == 10)
    number = digits[b] > digits[a]
    opens = np.ones(len(start), bool)
    opens[1:] = _STOP[data[end[:-1] - 1]] | (breaks[start[1:]] > breaks[end[:-1]])
    opens[first[:-1][first[:-1] < len(start)]] = True
    capital = (low[a] != data[a]) if len(a) else np.zeros(0, bool)
    two = (data[a] == 0xC3) & (low[np.minimum(a + 1, len(data) - 1)] != data[np.minimum(a + 1, len(data) - 1)]) if len(a) else capital
    kind = np.where(number, NUMBER, np.where((capital | two) & ~opens, NAME, LITERAL))
    unit = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)] == h
    unit[:1] = False
    unit[1:] &= number[:-1]
    unit[first[:-1][first[:-1] < len(start)]] = False
    kind = np.where(unit & ~number, UNIT, kind)
    return np.where(kind == LITERAL, h, _KIND[kind]), kind, first, (a, b)


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, number of its text, word position) of the windows with enough literals; a text of fewer words
    than a window has its whole sequence as one."""
    h, kind, first, _ = template(data, off)
    fp, whole = K.windows(h, first, WINDOW)
    literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    at = np.flatnonzero(whole)
    at = at[literal[at + WINDOW] - literal[at] >= LITERALS]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < WINDOW))
    short = short[literal[first[short + 1]] - literal[first[short]] >= np.minimum(LITERALS, n[short])]
    return np.concatenate((fp[at], K.sequences(h, first)[short])), np.concatenate((doc[at], short)), np.concatenate((at, first[short]))


def _plain_windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, number of its text) of the windows of words without case and outer punctuation, whatever they are;
    a text of fewer words than a window has its whole sequence as one."""
    low = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    for letter, same in (("ß", "ss"), ("ς", "σ")):  # letters whose capitals are those of others
        low = pc.replace_substring(low, letter, same)
    parts = []
    for a, b, data, off in K.texts(low):
        start, end, first = K.words(data, off)
        h = K.span_hashes(data, *_core(data, start, end))
        fp, whole = K.windows(h, first, WINDOW)
        at, n = np.flatnonzero(whole), np.diff(first)
        short = np.flatnonzero((n > 0) & (n < WINDOW))
        doc = np.concatenate((np.repeat(np.arange(b - a), n)[at], short))
        parts.append((K.mix(np.concatenate((fp[at], K.sequences(h, first)[short])) + _PLAIN), a + doc))
    if not parts:
        return np.zeros(0, K.U64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, _, data, off in K.texts(batch.column(1)):
            fp, item, _ = _windows(data, off)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + item)), K.longs(fp), pa.array(np.zeros(len(fp), bool))], ["item_id", "fp", "plain"])
        fp, item = _plain_windows(batch.column(1))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), K.longs(fp), pa.array(np.ones(len(fp), bool))], ["item_id", "fp", "plain"])


def _doc_windows(batches: Iterator[pa.RecordBatch], wanted: object) -> Iterator[pa.RecordBatch]:
    release()
    known = wanted.value if wanted is not None else None
    if known is not None:
        bits = np.zeros(1 << 22, bool)
        bits[(known >> K.U64(42)).astype(np.int64)] = True
    for batch in batches:
        for a, b, data, off in K.texts(batch.column(2)):
            fp, doc, _ = _windows(data, off)
            plain, of = _plain_windows(batch.column(2).slice(a, b - a))
            fp, doc = np.concatenate((fp, plain)), np.concatenate((doc, of))
            if known is not None:
                maybe = bits[(fp >> K.U64(42)).astype(np.int64)]
                fp, doc = fp[maybe], doc[maybe]
                at = np.searchsorted(known, fp)
                ok = known[np.minimum(at, len(known) - 1)] == fp if len(known) else np.zeros(len(fp), bool)
                fp, doc = fp[ok], doc[ok]
            order = np.lexsort((fp, doc))
            fp, doc = fp[order], doc[order]
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
            take = pa.array(a + doc[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), K.longs(fp[new])], ["doc_id", "t1", "fp"])


def _read(text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    raw = text.encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    h, kind, _, (a, b) = template(data, off)
    fp, _, at = _windows(data, off)
    values = [raw[x:y].decode(errors="replace").lower() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return h, kind, values, fp, at


def compare(text: str, item: str) -> dict | None:
    """How ``text`` holds ``item``: windows matched, slots and changed slots; None if it doesn't.

    Windows are aligned diagonal by diagonal, the longest match first, and each of the item's windows counts
    once. A slot's value in the item must always stand for the same value in the text; where it does not,
    the windows whose values are all unchanged must suffice by themselves."""
    _, kind, own, fps, places = _read(item)
    if not len(fps):
        return None
    _, _, theirs, found, where = _read(text)
    n = len(set(fps.tolist()))
    by = defaultdict(list)
    for fp, at in zip(found.tolist(), where.tolist(), strict=True):
        by[fp].append(at)
    matches = [(j - i, i, fp) for fp, i in zip(fps.tolist(), places.tolist(), strict=True) for j in by.get(fp, ())]
    weight = Counter(d for d, _, _ in matches)
    size = min(WINDOW, len(own))
    done, same, slots = set(), set(), defaultdict(set)
    for d, i, fp in sorted(matches, key=lambda m: (-weight[m[0]], m[0], m[1])):
        if fp in done:
            continue
        done.add(fp)
        pairs = [(int(kind[k]), own[k], theirs[k + d]) for k in range(i, i + size) if kind[k] != LITERAL]
        for what, mine, other in pairs:
            slots[what, mine].add(other)
        if all(mine == other for _, mine, other in pairs):
            same.add(fp)
    consistent = all(len(v) == 1 for v in slots.values())
    matched = len(done) if consistent else len(same)
    if 100 * matched < PERCENT * n:
        return None
    changed = sum(v != {mine} for (_, mine), v in slots.items()) if consistent else 0
    return {"n_windows": n, "n_matched": matched, "n_slots": len(slots), "n_changed": changed, "kind": "reparameterised" if changed else "verbatim"}


def same_words(text: str, item: str) -> dict | None:
    """How ``text`` holds the words of ``item`` themselves, in any case; None if it has less than 75 % of their windows."""
    own, found = (set(_plain_windows(pa.array([x]))[0].tolist()) for x in (item, text))
    matched = len(own & found)
    if not own or 100 * matched < PERCENT * len(own):
        return None
    return {"n_windows": len(own), "n_matched": matched, "n_slots": 0, "n_changed": 0, "kind": "verbatim"}


_FOUND = "n_windows int, n_matched int, n_slots int, n_changed int, kind string"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _FOUND.split(", ")]
    types = [pa.int32()] * 4 + [pa.string()]
    for batch in batches:
        got = [compare(t, i) or same_words(t, i) for t, i in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        keep = batch.select([0, 1, 2]).filter(pa.array([g is not None for g in got], pa.bool_()))
        got = [g for g in got if g]
        yield pa.RecordBatch.from_arrays([*keep.columns, *(pa.array([g[c] for g in got], t) for c, t in zip(names, types, strict=True))], ["doc_id", "t1", "item_id", *names])


def leaks(docs: DataFrame, benchmark: DataFrame, filtered: int = FILTERED) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds:
    doc_id, t1 (a fingerprint of the text), item_id, n_windows (distinct windows of the item), n_matched,
    n_slots, n_changed, kind (verbatim or reparameterised).

    A document holds an item if it has 75 % of the item's windows, with consistent slots, or 75 % of the windows of its
    words themselves in any case (n_windows and n_matched then count those, and no slot). Items of fewer than five
    words are one window; items without a word (null and empty ones) are never found. doc_id may be null and rows may repeat: equal rows are one document; rows that share an item_id
    are matched together, and each text of theirs is compared. Other columns are ignored; empty tables give no rows."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t1"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("item"))
    items = items.where("item_id is not null").distinct()
    windows = stored(items.mapInArrow(_item_windows, "item_id long, fp long, plain boolean").distinct(), "item-windows")
    sizes = windows.groupBy("item_id", "plain").agg(F.count("*").alias("n_windows"))
    wanted = windows.select("fp").distinct().limit(filtered + 1)
    known = None
    if wanted.count() <= filtered:
        values = np.sort(wanted.toArrow().column(0).to_numpy().astype(np.int64).view(K.U64))
        known = spark.sparkContext.broadcast(values)
    each = docs.mapInArrow(partial(_doc_windows, wanted=known), "doc_id long, t1 long, fp long")
    held = each.join(small(windows), "fp").groupBy("doc_id", "t1", "item_id", "plain").agg(F.count_distinct("fp").alias("n"))
    enough = held.join(small(sizes), ["item_id", "plain"]).where(F.lit(100) * F.col("n") >= PERCENT * F.col("n_windows"))
    pairs = stored(enough.select("doc_id", "t1", "item_id").distinct(), "leaks")
    p, d = small(pairs).alias("p"), docs.alias("d")
    both = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.t1") == F.col("p.t1"))).select("d.doc_id", "d.t1", "item_id", "text")
    both = both.join(small(items), "item_id").select("doc_id", "t1", "item_id", "text", "item")
    found = both.mapInArrow(_verify, f"doc_id long, t1 long, item_id long, {_FOUND}")
    return found.dropDuplicates(["doc_id", "t1", "item_id"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that hold no item of the benchmark."""
    bad = small(stored(leaks(docs, benchmark).select("doc_id", "t1").distinct(), "contaminated")).alias("b")
    d = docs.alias("d")
    return d.join(bad, F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.t1")), "left_anti")
