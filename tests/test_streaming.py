import pytest

from tarnlight.streaming import capture


@pytest.mark.parametrize(("first", "elapsed", "turns", "growth", "want"), [
    (True, 0, 4, 800, True), (True, 10_000, 3, 5000, False), (True, 0, 9, 799, False), (False, 600, 0, 0, True), (False, 599, 4, 800, True), (False, 599, 3, 9000, False), (False, 10, 9, 10, False),
])
def test_gate(first, elapsed, turns, growth, want):
    assert capture.gate_opens(first, elapsed, turns, growth) is want


def test_gate_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "session string, ts double, turns long, chars long"
    rows = [("s", 0.0, 3, 900), ("s", 60.0, 5, 900), ("s", 120.0, 6, 950), ("s", 800.0, 7, 960)]
    for n, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = capture.session_gate(capture.read_messages(spark, str(tmp_path / "in"), schema, 1))
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = [r.opened for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()]
    assert got == [False, True, False, True]


def test_append_once(spark, tmp_path):
    for ids in ([1, 2], [2, 3], [3, 3]):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for n in range(2):  # the second run finds its rows already written
        stream = capture.read_messages(spark, str(tmp_path / "in"), "id long", 1)
        capture.append_once(stream, str(tmp_path / "out"), str(tmp_path / f"c{n}"), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_late_and_repeated_messages(spark, tmp_path):
    spark.sql("select id, role, timestamp'2026-01-01' + make_interval(0,0,0,0,0,id) created_at from values (1L,'user'),(1L,'user'),(2L,'tool') t(id, role)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = capture.read_messages(spark, str(tmp_path / "in"), "id long, role string, created_at timestamp")
    capture.new_messages(stream).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    capture.counts_by_window(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.role: r.n for r in spark.table("counts").collect()} == {"user": 2, "tool": 1}


def test_time_gate(spark, tmp_path):
    for ts in (0.0, 100.0, 600.0, 700.0, 1200.0):
        spark.createDataFrame([("s", ts)], "session string, ts double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = capture.time_gate(capture.read_messages(spark, str(tmp_path / "in"), "session string, ts double", 5), 600)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert [r.opened for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()] == [True, False, True, False, True]


def test_watched_folder_is_ingested(spark, tmp_path):
    from tarnlight.sources.files import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Chapter 1\nbody of the text")
    known = spark.createDataFrame([], "checksum string")
    found = []
    stream = capture.watch_files(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, _: found.extend(ingest(b, known).collect()))
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r.location for r in found] == ["Chapter 1"]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_gate_is_the_same_however_the_time_is_sliced(spark, tmp_path, most):
    rows = [("s", float(100 * n), n + 1, 300 * (n + 1)) for n in range(9)] + [("t", 50.0, 1, 5000)]
    events = spark.createDataFrame(rows, "session string, ts double, turns long, chars long")
    got = capture.run_in_order(events, capture.session_gate, str(tmp_path / "p"), most)
    assert [r.ts for r in got.where("opened").orderBy("ts").collect()] == [300.0, 700.0] and got.count() == len(rows)


def test_gate_without_events(spark, tmp_path):
    events = spark.createDataFrame([], "session string, ts double")
    assert capture.run_in_order(events, lambda s: capture.time_gate(s, 60), str(tmp_path / "p")).count() == 0
