"""Streams against the batch operators on the same events."""

import pytest
from pyspark.sql import functions as F
from siftline.operators import events as E
from siftline.streaming import watch

END = 10**9


@pytest.fixture
def stream(spark, tmp_path):
    def start(rows, schema, name, build):
        rows.withColumn("n", F.expr("seq % 3")).write.partitionBy("n").parquet(f"{tmp_path}/{name}")
        # One more file, far behind all others, moves the watermark past them.
        last = rows.limit(1).withColumn("seq", F.lit(END).cast("long")).withColumn("ts", F.lit("2031-01-01").cast("timestamp")).withColumn("path", F.lit("end"))
        if "cookie" in rows.columns:
            last = last.withColumn("cookie", F.lit(END).cast("long"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/{name}/*")
        query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-checkpoint").start()
        query.processAllAvailable()
        last.write.parquet(f"{tmp_path}/{name}/n=9")
        query.processAllAvailable()
        query.processAllAvailable()
        query.stop()
        return [tuple(r) for r in spark.table(name).where(f"seq <> {END}").collect()]

    return start


def events(spark, n=400):
    return spark.range(n).select(F.col("id").alias("seq"), F.timestamp_millis(F.lit(1_700_000_000_000) + (F.col("id") * 7919 % 60_000)).alias("ts"), F.expr("if(id % 2 = 0, 'modified', 'closed')").alias("kind"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("path"))


def test_renames(spark, stream):
    rows = events(spark, 200).where("seq % 7 <> 0").select("seq", "ts", F.expr("if(seq % 2 = 0, 'from', 'to')").alias("kind"), F.expr("seq div 2").alias("cookie"), "path")
    got = stream(rows, "seq long, ts timestamp, kind string, cookie long, path string", "renames", lambda s: watch.pair_renames(s, "20 seconds", "2 minutes"))
    want = E.pair_renames(rows.withColumn("ts_ms", F.unix_millis("ts")), 20_000)
    assert sorted(got, key=str) == sorted((tuple(r) for r in want.collect()), key=str)


def test_batches_are_applied(spark, tmp_path):
    events(spark, 50).write.parquet(f"{tmp_path}/in")
    seen = []
    source = spark.readStream.schema("seq long, ts timestamp, kind string, path string").parquet(f"{tmp_path}/in")
    watch.apply_events(source, lambda df, n: seen.append((n, df.count())), f"{tmp_path}/checkpoint").awaitTermination()
    assert sum(n for _, n in seen) == 50
