"""SentencePiece ids by one table of the corpus's distinct marked words.

Pieces cannot cross a whitespace marker, so a text's ids are those of its marked words one after the other. Tasks give the
distinct words of their texts, the words of all tasks are made distinct and segmented once each, and the table is joined to the
places of each word in each text: a row holds all places of one word in one text, so that a frequent word is one row a text. The
table's row of a word is one, so a word that most texts hold can be split by adaptive execution. Equal texts are put together
once, and the result goes back to all rows that hold them. Between joins a text is known by two fingerprints and its length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import prepare, stored
from .tokenization import load

Derive = Callable[[list[list[int]], list[str]], list[pa.Array]]

#: Words that a task remembers, so as to give them once; texts are taken by so many bytes at once.
REMEMBERED, SLICE_BYTES = 200_000, 1_000_000
#: Bytes of words and ids that are sent to all executors at most, and of an entry beside them.
SENT, ENTRY = 48_000_000, 64
KEY = ["t1", "t2", "size"]


def _key() -> list[Column]:
    text = F.col("text")
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(7)).alias("t2"), F.octet_length(text).alias("size")]


def _words(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of a task's texts; a text that is encoded whole is a chunk of its own."""
    codec, known = load(model), set()
    for batch in batches:
        for a, b, _, _ in K.texts(batch.column(0), SLICE_BYTES):
            new = set()
            for t in batch.column(0).slice(a, b - a).to_pylist():
                new.update(codec.cut(t) or [t] * bool(t))
            new -= known
            if len(known) > REMEMBERED:
                known.clear()
            known |= new
            yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["chunk"])


def _segmented(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    codec = load(model)
    for batch in batches:
        for a, b, _, _ in K.texts(batch.column(0), SLICE_BYTES):
            chunks = batch.column(0).slice(a, b - a)
            ids = codec.library.encode(chunks.to_pylist(), num_threads=1)
            ids = [np.array(x, "<u4").tobytes() if c else codec.lone() for x, c in zip(ids, chunks.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([chunks, pa.array(ids, pa.binary())], ["chunk", "ids"])


def _places(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """A row for each distinct chunk of each text: the text's key, the chunk and its places as packed 32-bit numbers."""
    codec = load(model)
    for batch in batches:
        text = batch.column(3)
        for a, b, _, _ in K.texts(text, SLICE_BYTES):
            owner, chunk, places = [], [], []
            for k, t in enumerate(text.slice(a, b - a).to_pylist(), a):
                at: dict[str, list[int]] = {}
                for i, c in enumerate(codec.cut(t) or [t] * bool(t)):
                    at.setdefault(c, []).append(i)
                owner += [k] * len(at)
                chunk += at
                places += (np.array(x, "<u4").tobytes() for x in at.values())
            own = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(3)), pa.array(chunk, pa.string()), pa.array(places, pa.binary())], [*KEY, "chunk", "places"])


def _joined(batches: Iterator[pa.RecordBatch], model: str, derive: Derive, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The ids of each text in the order of the places of its chunks, and what ``derive`` makes of them."""
    codec = load(model)
    for batch in batches:
        for row in range(len(batch)):
            held = batch.column(3)[row].as_py()
            ids: list[bytes] = [b""] * sum(len(h["places"]) // 4 for h in held)
            for h in held:
                for i in np.frombuffer(h["places"], "<u4").tolist():
                    ids[i] = h["ids"]
            whole = [np.frombuffer(b"".join(ids), "<u4").tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, 1) for i in range(3)), *derive(whole, codec.library.decode(whole))], names)


def chunk_table(texts: DataFrame, model: str) -> DataFrame:
    """chunk and ids (packed little-endian 32-bit integers) of each distinct chunk of ``texts`` (text), written to the shared folder."""
    prepare(texts.sparkSession)
    words = texts.select("text").mapInArrow(partial(_words, model=model), "chunk string").distinct()
    return stored(words.mapInArrow(partial(_segmented, model=model), "chunk string, ids binary"), "chunks")


def encode_by_table(docs: DataFrame, model: str, derive: Derive, schema: str, sent: int = SENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and the columns ``schema`` that ``derive`` makes of ids and decoded texts.

    Results are those of ``encode_decode``: null counts as the empty text, rows may repeat and doc_id may be null, other columns
    are ignored, an empty table gives no rows. The table is broadcast if its bytes are at most ``sent``."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = chunk_table(docs, model)
    size = table.agg(F.sum(F.octet_length("chunk") + F.octet_length("ids") + F.lit(ENTRY))).first()[0] or 0
    keyed = docs.select(*_key(), "text")
    each = keyed.mapInArrow(partial(_places, model=model), "t1 long, t2 long, size int, chunk string, places binary")
    each = each.join(F.broadcast(table) if size <= sent else table, "chunk")
    held = each.groupBy(*KEY).agg(F.collect_set(F.struct("places", "ids")).alias("held"))
    names = [*KEY, *(c.split()[0] for c in schema.split(", "))]
    made = held.mapInArrow(partial(_joined, model=model, derive=derive, names=names), f"t1 long, t2 long, size int, {schema}")
    made = stored(made, "encoded")
    codec_empty = docs.sparkSession.createDataFrame([("",)], "text string").select(*_key(), F.array().cast("array<struct<places:binary,ids:binary>>").alias("held"))
    empty = codec_empty.mapInArrow(partial(_joined, model=model, derive=derive, names=names), f"t1 long, t2 long, size int, {schema}")
    return docs.select("doc_id", *_key()).join(made.union(empty), KEY).select("doc_id", *names[3:])
