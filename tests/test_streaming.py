"""Structured Streaming forms, snapshots, debouncing and the single writer."""

import datetime as dt

from weftgraph.streaming import watch


def test_session_windows_match_batch_sessions(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(k, u, t(m)) for k, (u, m) in enumerate([(1, 0), (1, 10), (1, 60), (2, 5), (1, 61), (2, 500)])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = watch.session_counts(stream, "user_id", gap="30 minutes").writeStream.format("memory").queryName("sessions_seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.events) for r in spark.table("sessions_seen").collect())
    batch = sorted((r.user_id, r.events) for r in watch.sessions(spark.read.parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", 1800).collect())
    assert got == batch == [(1, 2), (1, 2), (2, 1), (2, 1)]


def test_window_counts_stream(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 2))], "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = watch.window_counts(stream, "user_id").writeStream.format("memory").queryName("windows_seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows_seen").count() == 5


def test_new_files_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cls").write_text("x")
    seen = []
    q = watch.stream_files(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r.path.rsplit("/", 1)[-1] for r in df.select("path").collect()), str(tmp_path / "cp"), "*.cls")
    q.awaitTermination(120)
    assert seen == ["a.cls"]


def test_snapshot_diff(spark):
    a, b = (spark.createDataFrame(r, "path string, mtime double") for r in ([("x", 1.0), ("y", 1.0), ("z", 1.0)], [("x", 1.0), ("y", 2.0), ("w", 1.0)]))
    assert {(r.path, r.change) for r in watch.snapshot_diff(a, b).collect()} == {("y", "changed"), ("z", "deleted"), ("w", "new")}


def test_debounce_and_lock(tmp_path):
    now = [0.0]
    d = watch.Debounce(3, lambda: now[0])
    assert not d.due()
    d.event()
    now[0] = 2.9
    d.event()
    now[0] = 5.0
    assert not d.due()
    now[0] = 6.0
    assert d.due() and not d.due()
    with watch.single_writer(str(tmp_path / "l")) as a, watch.single_writer(str(tmp_path / "l")) as b:
        assert a and not b


def test_watch_rebuilds_once_after_silence(spark, tmp_path):
    import threading
    import time

    calls = []
    threading.Timer(0.15, lambda: (tmp_path / "a.cls").write_text("x")).start()
    assert watch.watch(spark, str(tmp_path), calls.append, debounce=0.1, poll=0.1, rounds=8) == 1
    time.sleep(0.01)
    assert [p.rsplit("/", 1)[-1] for p in calls[0]] == ["a.cls"]
