from colloquy import schema
from colloquy.operators.cluster import sessionise
from colloquy.streaming.sessions import gap_sessions
from test_text_and_clusters import messages


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("a", "", 0, "x", None), ("b", "", 10, "x", None), ("a", "", 21, "x", None), ("a", "", 5, "y", None), ("c", "", 6, "x", "t")]
    batch = messages(spark, rows)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema.MESSAGES).parquet(str(tmp_path / "in"))
    q = gap_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.channel, r.start_ts, r.end_ts, r.message_count) for r in spark.sql("select * from sessions").collect()}
    want = {(r.channel, r.start_ts, r.end_ts, r.message_count) for r in sessionise(batch)[0].where("thread_id is null").collect()}
    assert got == want
