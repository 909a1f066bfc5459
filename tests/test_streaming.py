import datetime as dt

from graphloom.operators.skew import vertex_loads
from graphloom.streaming import ingest


def test_running_entries_and_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 5, 6, t, t), (2, 1, 5, 5, t, t), (3, 1, None, 5, t + dt.timedelta(days=1), t), (4, 1, 7, 5, None, t)]
    df = spark.createDataFrame(rows, ingest.EDGES)
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.edge_stream(spark, str(tmp_path / "in"))
    q = ingest.running_entries(stream).writeStream.outputMode("complete").format("memory").queryName("entries").start()
    w = ingest.edges_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        q.processAllAvailable()
        w.processAllAvailable()
        assert {tuple(r) for r in spark.table("entries").collect()} == {(r.v, r.entries) for r in vertex_loads(df).collect()}
        assert sorted(r.edges for r in spark.table("windows").collect()) == [1, 1, 2]  # the one without a time too
    finally:
        q.stop()
        w.stop()


def test_load_lines(spark, tmp_path):
    spark.createDataFrame([(1, "1\t2\ta\tb"), (2, "1\t2"), (3, None)], "line_id long, line string").write.parquet(str(tmp_path / "raw"))
    raw = spark.readStream.schema("line_id long, line string").parquet(str(tmp_path / "raw"))
    ingest.load_lines(raw, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.begin for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert [(r.line_id, r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [(2, "columns")]
