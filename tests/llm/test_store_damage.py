"""Stores whose files were lost, repeated or changed on disk."""

import glob
import os
import shutil

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from siftline.llm import token_store as S


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("store"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text number"), F.col("id").cast("string"), F.repeat(F.lit("word "), (F.col("id") % 9).cast("int"))).alias("text"))
    S.write_store(docs, f"file://{at}/s", public_tokenizers.path("byte_bpe_50k.json"), 2)
    return f"{at}/s"


def copied(store, tmp_path):
    shutil.copytree(store, f"{tmp_path}/s")
    return f"{tmp_path}/s"


def files(path, what):
    return sorted((f for f in glob.glob(f"{path}/{what}/**/part-*.parquet", recursive=True)), key=os.path.getsize)


def test_whole(spark, store):
    assert S.read_digests(spark, f"file://{store}").count() == 300
    assert len(S.verify_manifest(spark, f"file://{store}")) == 32


def test_lost_and_repeated_recipes(spark, store, tmp_path):
    path = copied(store, tmp_path)
    last = files(path, "recipes")[-1]
    shutil.copy(last, last.replace("part-", "part-9"))
    with pytest.raises(ValueError, match="manifest"):
        S.read_digests(spark, f"file://{path}")
    os.remove(last.replace("part-", "part-9"))
    os.remove(last)
    with pytest.raises(ValueError, match="manifest"):
        S.read_digests(spark, f"file://{path}")


def test_changed_recipes(spark, store, tmp_path):
    """Roots of two documents change places, in recipes that agree in their counts."""
    path = copied(store, tmp_path)
    rows = spark.read.parquet(f"file://{store}/recipes")
    turned = rows.withColumn("root", F.when(F.col("doc_id").isin(1, 2), F.sha2(F.col("root"), 256).cast("binary")).otherwise(F.col("root")))
    turned.write.mode("overwrite").parquet(f"file://{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        S.verify_manifest(spark, f"file://{path}")


def test_lost_chunks(spark, store, tmp_path):
    path = copied(store, tmp_path)
    for f in files(path, "objects/kind=chunk"):
        os.remove(f)
    with pytest.raises(Exception):
        S.read_digests(spark, f"file://{path}").collect()
