"""The registered queries of this subpackage: thin wrappers that apply one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factorisation, oracles, quality, sentencepiece_codec, token_store
from .decontaminate import leaks
from .fill_middle import rearrange, restore
from .hard_negatives import hard_negatives
from .html_extract import extract
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .sentencepiece_codec import encode_decode
from .pii import pseudonymise
from .suffix_dedup import repeated_passages
from .tables import shared_dir, table
from .token_counts import count_tokens

END_ID = 2
#: Stands in for the secret that a real run would pass.
KEY = "siftline"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold entities; the operator itself returns the others as they are, too."""
    return pseudonymise(table(spark, sf_dir, "documents"), KEY).where("n_entities > 0")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/siftline/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_store.read_digests(spark, path)


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t1")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return docs.select("doc_id", "n_lines", "n_removed", "removed", "emptied", kept)


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_decode(table(spark, sf_dir, "documents"), model, sentencepiece_codec.digests, sentencepiece_codec.DIGESTS)


def op9_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text: first-last,first-last."""
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return repeated_passages(table(spark, sf_dir, "documents")).withColumn("spans", spans)


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op11_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = factorisation.train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return factorisation.score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", predicted)


def op12_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can express."""
    base = [c.split()[0] for c in quality.FEATURES.split(", ")]
    return op7_weak_supervision(spark, sf_dir).select("doc_id", *base)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_token_store": op2_token_store,
    "op3_templates": op3_templates,
    "op4_html_extract": op4_html_extract,
    "op5_token_counts": op5_token_counts,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sparse_suffixes": op9_sparse_suffixes,
    "op10_superminhash": op10_superminhash,
    "op11_factorisation_machine": op11_factorisation_machine,
    "op12_vector_approximation": op12_vector_approximation,
    "op13_fill_middle": op13_fill_middle,
    "quality_base_counts": quality_base_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op9_sparse_suffixes": oracles.REPEATED_PASSAGES,
    "op10_superminhash": oracles.NEAR_DUPLICATES,
    "op12_vector_approximation": oracles.HARD_NEGATIVES,
    "op13_fill_middle": oracles.FILL_MIDDLE,
    "quality_base_counts": oracles.BASE_COUNTS,
}
