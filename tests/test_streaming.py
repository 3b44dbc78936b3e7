from genoflux.streaming import depth_stream as ds


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([("c", i % 5) for i in range(40)], "ref_name string, ref_pos long")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = ds.position_counts(s).writeStream.outputMode("complete").format("memory").queryName("depth").start()
    q.processAllAvailable()
    q.stop()
    assert {r.ref_pos: r.n for r in spark.sql("select * from depth").collect()} == {k: 8 for k in range(5)}
