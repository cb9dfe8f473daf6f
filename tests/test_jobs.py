"""Jobs in a stream: its state read back, and jobs that fail for want of events."""

from datetime import datetime, timedelta

from leafline.streaming import jobs

SCHEMA = "job_id string, seq long, event string, step string, ts timestamp"
BEGIN = datetime(2024, 1, 1)


def test_state_and_timers_equal_the_batch_twin(spark, tmp_path):
    at = lambda s: BEGIN + timedelta(seconds=s)
    batches = [
        [("a", 0, "created", "", at(0)), ("a", 1, "running", "", at(10)), ("b", 0, "created", "", at(0)), ("b", 1, "step", "x", at(5))],
        [("b", 2, "step", "y", at(50)), ("b", 3, "succeeded", "", at(55)), ("c", 0, "created", "", at(50))],
        [("d", 0, "created", "", at(200)), ("d", 1, "step", "z", at(201))],
        [("d", 2, "step", "z", at(230))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    checkpoint = str(tmp_path / "cp")
    query = jobs.track_patiently(stream, 60).writeStream.outputMode("update").format("memory").queryName("patient").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    told = {}
    for r in spark.table("patient").collect():  # a job's last row: it only goes on
        told[r.job_id] = max(told.get(r.job_id, (-1, 0, "", 0)), (r.last_seq, r.status in jobs.TERMINAL, r.status, r.steps))
    events = spark.createDataFrame([r for rows in batches for r in rows], SCHEMA)
    want = {r.job_id: (r.status, r.last_seq, r.steps) for r in jobs.latest_patiently(events, 60).collect()}
    assert want == {"a": ("failed", 1, 0), "b": ("succeeded", 3, 2), "c": ("failed", 0, 0), "d": ("running", 2, 1)}
    assert {k: (status, last, steps) for k, (last, _, status, steps) in told.items()} == want
    assert {r.job_id: (r.status, r.last_seq) for r in jobs.running_jobs(spark, checkpoint).collect()} == {k: v[:2] for k, v in want.items()}
    assert {(r.job_id, r.step, r.first_seq) for r in jobs.job_steps(spark, checkpoint).collect()} == {("b", "x", 1), ("b", "y", 2), ("d", "z", 1)}
