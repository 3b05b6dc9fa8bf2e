from intentlake.streaming import usage


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("rank", "m", None, 10.0, 1, 1, 5, None, 5), ("rank", "m", None, 30.0, 1, 1, None, 2, 2), ("embed", "m", None, None, 1, 1, 1, 1, 2)]
    df = spark.createDataFrame(rows, usage.USAGE)
    usage.append_usage(df.limit(1), path)
    usage.append_usage(df.subtract(df.limit(1)), path)
    batch = {(r.stage, r.model): tuple(r) for r in usage.summarize_usage(usage.read_usage(spark, path)).collect()}
    query = usage.summarize_usage(usage.read_usage(spark, path, stream=True)).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.stage, r.model): tuple(r) for r in spark.table("usage").collect()} == batch
    assert batch["rank", "m"][2:] == (2, 20.0, 5, 2)
