from strandflow.streaming import runs


def test_runs_sessions_and_windows(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", k, float(m)) for m, k in zip([0, 1, 2, 50, 51], "aabba")] + [(2, "2024-01-01 00:00:30", "z", 1.0)]
    data = spark.createDataFrame(rows, "u long, t string, k string, value double").selectExpr("u", "cast(t as timestamp) ts", "k", "value")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(build, name):
        stream = build(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")))
        mode = "append" if name == "r" else "complete" if name == "w" else "append"
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = run(lambda s: runs.label_runs(s, "u", "k"), "r")
    assert sorted((r.u, r.k, r.n) for r in got)[:2] == [(1, "a", 2), (1, "b", 2)]
    assert sorted(r.n for r in run(lambda s: runs.windowed_counts(s, "u"), "w")) == [1, 5]
    batch = runs.sessions(data, "u").collect()
    assert sorted((r.u, r.n) for r in batch) == [(1, 2), (1, 3), (2, 1)]
