from bitextkit import streaming as SS


def test_clean_stream_memory_sink(spark, tmp_path):
    src_dir = tmp_path / "in"
    src_dir.mkdir()
    df = spark.createDataFrame([(1, " अआ ", "कख"), (2, "", "x"), (3, "{अ}", "कख")],
                               "pair_id long, src string, tgt string")
    df.write.parquet(str(src_dir / "batch1"))
    stream = spark.readStream.schema(df.schema).parquet(str(src_dir / "batch1"))
    q = (SS.clean_stream(stream).writeStream.format("memory").queryName("clean_out")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM clean_out").collect()
    assert [(r.pair_id, r.src) for r in rows] == [(1, "अआ")]
    counts = (SS.funnel_counts_stream(stream).writeStream.format("memory").queryName("counts_out")
              .outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).start())
    counts.processAllAvailable()
    counts.stop()
    got = {r.step: r.rows for r in spark.sql("SELECT * FROM counts_out").collect()}
    assert got == {"kept": 1, "empty": 1, "artifact": 1}
