"""Token counts through a digest cache.

Counts are stored under the SHA-256 of the content and of the tokenizer's file. A run joins the digests
of its texts to the cache, encodes one text for each digest that is missing, and appends the new counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import prepare, shared_dir, stored
from .tokenization import file_digest, load

CACHE = "tokenizer string, content binary, n_tokens long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    encoder = load(tokenizer)
    for batch in batches:
        text = batch.column(1)
        for a, b, _, _ in K.texts(text):
            counts = [len(x) // 4 for x in encoder.encode(text.slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64())], ["content", "n_tokens"])


def cached_counts(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer version; several writers may have added a digest, with one count."""
    rows = spark.read.schema(CACHE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    cache: a folder that all executors share, kept between runs; None takes a new one. Null counts as the
    empty text (0 bytes, 0 tokens). Whole texts are encoded. Rows may repeat and doc_id may be null: texts
    meet by digest alone. Other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    cache = cache or f"{shared_dir(spark)}/siftline/token-cache-{uuid.uuid4().hex}"
    version = file_digest(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("content", F.unhex(F.sha2("text", 256)))
    narrow = stored(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "digests")
    misses = narrow.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(cached_counts(spark, cache, version), "content", "left_anti")
    misses = stored(misses, "misses").alias("m")
    d = docs.alias("d")
    # The text of one row for each missing digest: the join is on its id as well, so that copies do not meet.
    todo = d.join(misses, (F.col("d.content") == F.col("m.content")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left_semi")
    new = todo.select("content", "text").mapInArrow(partial(_count, tokenizer=tokenizer), "content binary, n_tokens long")
    new.dropDuplicates(["content"]).select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    # Counts are stored before the join, so that a content that very many rows have can be split.
    counts = stored(cached_counts(spark, cache, version), "counts")
    out = narrow.join(counts, "content", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
