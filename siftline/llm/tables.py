"""Session helpers shared by the operators: reading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])

#: Rows of narrow keys (two or three longs) that may be broadcast: some 10 MB.
BROADCAST_ROWS = 200_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver was not started in the repository."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), _ROOT) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset and Spark is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, so that a lost
    executor costs a re-read and not the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftline/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count of at most ``limit`` + 1 rows shows that it is small;
    otherwise unchanged, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
