"""A replayed stream gives the matches of the batch run."""

from pyspark.sql import functions as F

from evenstride.operators.match import match
from evenstride.plans.catalog import PATTERNS
from evenstride.streaming.processor import match_stream


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    p = PATTERNS["q_hadoop"]
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    last = ev.agg(F.max("ts")).first()[0]
    ev.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    flush = spark.createDataFrame([(-1, last, -1, "flush", 0.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    flush.withColumn("ts", F.expr("ts + interval 30 days")).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = match_stream(src, p).writeStream.format("memory").queryName("stream_matches").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {(r.key, r.ids) for r in spark.table("stream_matches").collect()}
    want = {(str(r.user_id), f"{r.a_id};{r.b_ids};{r.c_id}") for r in match(ev, p).collect()}
    assert got == want and len(want) > 10
