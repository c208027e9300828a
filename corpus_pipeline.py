"""The corpus pipeline: quality rules, line and document de-duplication, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from siftline.llm import quality, sentencepiece_codec
from siftline.llm.decontaminate import decontaminate
from siftline.llm.line_dedup import dedup_lines
from siftline.llm.near_dedup import near_duplicates
from siftline.llm.tables import prepare, shared_dir, small, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are more probably bad than good, go."""
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand elsewhere go; a document goes when no word is left of those it had. n_chars follows."""
    out = dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    n = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(small(stored(gone, "gone")), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the texts that are left."""
    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), sentencepiece_codec.digests, sentencepiece_codec.DIGESTS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Expectation-maximisation, connected components and subword segmentation have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/siftline/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
