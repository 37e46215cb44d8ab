from quernstone.streaming import intake


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("code,name\nX,one\nY,two\n")
    seen = []
    for more in (None, "code,name\nZ,three\n"):
        if more:
            (tmp_path / "in" / "b.csv").write_text(more)
        q = intake.run_batches(intake.watch_uploads(spark, str(tmp_path / "in")), lambda df, i: seen.extend(r.record_id for r in df.collect()), str(tmp_path / "state"))
        q.awaitTermination(60)
    assert sorted(seen) == ["a.csv##1", "a.csv##2", "b.csv##1"]


def test_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:10:00"), ("k2", "2024-01-01 00:20:00")], "idempotency_key string, at string")
    rows.selectExpr("idempotency_key", "cast(at as timestamp) at").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("idempotency_key string, at timestamp").parquet(str(tmp_path / "log"))
    out = []
    intake.run_batches(intake.first_attempts(stream), lambda df, i: out.extend(r.idempotency_key for r in df.collect()), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(out) == ["k1", "k2"]
