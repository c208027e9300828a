"""SentencePiece encoding and decoding over a table of distinct marked words.

The table lives in each Python worker and not in one table for the whole corpus: a corpus-wide one
would shuffle every word of every text twice, several times the input, to save work that a worker's
table saves already."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import prepare
from .tokenization import load

Derive = Callable[[list[list[int]], list[str]], list[pa.Array]]


def _as_lists(ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, off[-1])
    return [pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(decoded, pa.string())]


def digests(ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    """n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256."""
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array(sha), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _code(batches: Iterator[pa.RecordBatch], model: str, derive: Derive, names: list[str]) -> Iterator[pa.RecordBatch]:
    codec = load(model)
    for batch in batches:
        text = batch.column(1)
        for a, b, _, _ in K.texts(text):
            ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(text.slice(a, b - a).to_pylist())]
            decoded = codec.library.decode(ids) if ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *derive(ids, decoded)], names)


def encode_decode(docs: DataFrame, model: str, derive: Derive = _as_lists, schema: str = "ids array<int>, decoded string") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids and the text that these ids decode to.

    ids are those of the sentencepiece library for the whole text, without begin or end ids. Null counts as
    the empty text, with no ids. derive turns ids and decoded texts into other columns, named by
    ``schema``, where they are made, so that the ids need not travel. Rows may repeat and doc_id may be null; other columns
    are ignored; an empty table gives no rows."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]
    return docs.mapInArrow(partial(_code, model=model, derive=derive, names=names), f"doc_id long, {schema}")
