"""Session logs in batch and as streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from sorrel.operators import sessions
from sorrel.plans import surface
from sorrel.sources import repo, session_logs
from sorrel.streaming import logs


def said(i, t):
    return json.dumps({"type": "message_appended", "message": {"id": str(i), "role": "User", "content": "c", "timestamp": t}})


def made(title, t):
    return json.dumps({"type": "session_created", "session_id": "other", "title": title, "ts_ms": t})


def test_replay(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([said(0, 1), made("x", 5), "", "{bad", said(1, 9), said(2, 7)]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join([made("x", 5), said(1, 9), made("y", 20)]) + "\n")
    (tmp_path / "c.txt").write_text(made("z", 1))
    got = {r.session_id: (r.title, r.updated_at, r.message_count) for r in sessions.replay(sessions.parse_session_log(repo.session_lines(spark, str(tmp_path)))).collect()}
    assert got == {"a": ("x", 9, 2), "b": ("y", 20, 0)}
    assert sorted(r[0] for r in repo.list_session_ids(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_appending(spark, tmp_path):
    m = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("t", 0, "c")], "session_id string, ordinal int, text string")
    assert [(r.session_id, r.text) for r in sessions.unsaved(m, m.where("ordinal = 0")).collect()] == [("s", "b")]
    sessions.append_trajectory(sessions.wrap_events(spark.createDataFrame([("s", "{}")], "session_id string, event string")), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first()["type"] == "event"


@pytest.mark.parametrize("kind", ["memory", "log"])
def test_stores_round_trip(spark, tmp_path, kind):
    at = iter(range(1000, 9000, 7))
    clock = lambda: next(at)
    store = surface.MemoryStore(clock) if kind == "memory" else surface.LogStore(spark, str(tmp_path / "log"), clock)
    assert store.list() == [] and store.get("none") is None
    a, b = store.create("first"), store.create(None)
    for i in range(3):
        a.push("User", f"line {i}\nnext", clock)
        store.save(a)
    got = store.get(a.id)
    assert (got.title, got.created_at, got.updated_at) == ("first", 1000, a.updated_at) and [m.content for m in got.messages] == [f"line {i}\nnext" for i in range(3)]
    store.save(got)
    assert [(s.id, s.title, s.message_count) for s in store.list()] == [(a.id, "first", 3), (b.id, None, 0)]
    foreign = surface.Session("local:x", "t", 1, 2, [surface.Message("m", "User", "c", 2)])
    store.save(foreign)
    assert [m.content for m in store.get("local:x").messages] == ["c"]
    if kind == "log":
        found = sessions.replay(sessions.parse_session_log(repo.session_lines(spark, str(tmp_path / "log"))))
        wanted = spark.createDataFrame([(1, "x"), (2, a.id), (3, "no")], "request_id int, wanted string")
        assert {r.request_id: r.session_id for r in sessions.switch_target(wanted, found).collect()} == {1: "local:x", 2: a.id, 3: None}
        assert {r.session_id for r in repo.list_session_ids(spark, str(tmp_path / "log")).collect()} == {a.id, b.id, "local:x"}


def test_long_logs_are_read_in_parts(spark, tmp_path):
    lines = [made("x", 5), *(said(i, 10 + i) for i in range(3000)), made("y", 5000), *(said(i, 6000 + i) for i in range(2000))]
    (tmp_path / "long.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        logs_ = repo.session_lines(spark, str(tmp_path))
        assert logs_.rdd.getNumPartitions() > 4
        assert [tuple(r) for r in sessions.replay(sessions.parse_session_log(logs_)).select("title", "message_count", "updated_at").collect()] == [("y", 2000, 7999)]
        assert [r.id for r in sessions.live_messages(sessions.parse_session_log(logs_)).orderBy("line_no").collect()] == [str(i) for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def values(spark, folder, session=None):
    rows = repo.session_lines(spark, str(folder))
    rows = rows if session is None else rows.where(F.col("session_id") == session)
    return [r.value for r in rows.orderBy("session_id", "line_no").collect()]


def test_lines_of_odd_logs(spark, tmp_path):
    (tmp_path / "local:a%3Ab.jsonl").write_bytes("é\r\n\n😀".encode() + b"\xff")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.jsonl").write_text("")
    (tmp_path / "deep" / "c.jsonl").write_text("\n".join(["x" * n for n in range(300)]))
    (tmp_path / "_staged").mkdir()
    (tmp_path / "_staged" / "left.jsonl").write_text("never")
    assert values(spark, tmp_path, "local:a%3Ab") == ["é", "", "😀\ufffd"]
    whole = values(spark, tmp_path, "c")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    assert values(spark, tmp_path, "c") == whole and len(whole) == 300
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for most in (1, 7, 100):  # ranges that begin and end anywhere in a line
        reader = session_logs.LogReader({"path": str(tmp_path), "splitbytes": str(most)})
        got = [row for p in reader.partitions() for row in session_logs._lines_of(str(tmp_path), p.ranges) if row[0] == "c"]
        assert [r[4] for r in sorted(got, key=lambda r: r[3])] == whole
    assert values(spark, tmp_path / "none") == []
    assert sorted(r[0] for r in repo.list_session_ids(spark, str(tmp_path)).collect()) == ["b", "c", "local:a%3Ab"]


def test_a_filter_on_the_session_opens_no_other_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("1\n")
    for s in ("b", "c"):
        (tmp_path / f"session_id={s}").mkdir()
        (tmp_path / f"session_id={s}" / "000000001.0..0.jsonl").write_text(f"{s}\n")
    reader = session_logs.LogReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([EqualTo(("session_id",), "b"), EqualTo(("value",), "x")]))
    assert [f.attribute for f in rest] == [("value",)]
    assert [r[2] for p in reader.partitions() for r in p.ranges] == ["session_id=b/000000001.0..0.jsonl"]
    mine = repo.session_lines(spark, str(tmp_path)).where("session_id = 'b'")
    for other in (tmp_path / "a.jsonl", tmp_path / "session_id=c" / "000000001.0..0.jsonl"):
        other.unlink()
        other.symlink_to("/nowhere")  # opening or asking for its size would fail
    assert [r.value for r in mine.collect()] == ["b"]


def test_appends_happen_once(spark, tmp_path):
    lines = spark.createDataFrame([("local:x", i, f"{i}") for i in range(5)] + [("y/../z", 0, "y")], "session_id string, place int, value string")
    for _ in range(2):
        sessions.append_sessions(lines, str(tmp_path))
        assert values(spark, tmp_path, "local:x") == list("01234") and values(spark, tmp_path, "y/../z") == ["y"]
    with pytest.raises(Exception, match="already has lines"):
        sessions.append_sessions(lines.where("place > 2").unionByName(lines.where("place = 0").withColumn("session_id", F.lit("new"))), str(tmp_path))
    assert values(spark, tmp_path, "new") == []
    for batch in ("1", "1", "2"):
        sessions.append_sessions(lines.where("place = 4"), str(tmp_path), batch)
    assert values(spark, tmp_path, "local:x") == [*"01234", "4", "4"]
    assert list((tmp_path / "_staged").iterdir()) == []


def test_a_repeated_task_writes_once(tmp_path):
    """Two attempts of one task have staged their lines; the driver hears of one, and its commit is run twice."""
    writer = session_logs.LogWriter({"path": str(tmp_path)})
    rows = [{"session_id": "s", "place": i, "value": f"{i}"} for i in range(3)]
    writer.write(iter(rows))
    second = writer.write(iter(rows))
    writer.commit([second, None])
    assert [x.session for x in session_logs.list_logs(str(tmp_path))] == ["s"]
    again = writer.write(iter(rows))
    writer.commit([again])
    (log,) = session_logs.list_logs(str(tmp_path))
    assert (tmp_path / log.path).read_text() == "0\n1\n2\n"
    writer.abort([writer.write(iter([{"session_id": "t", "place": 0, "value": "x"}]))])
    assert len(session_logs.list_logs(str(tmp_path))) == 1


def test_unfinished_lines_wait(tmp_path):
    path = tmp_path / "a.jsonl"
    for text, whole in (('{"a": 1}\n{"b"', 9), ('{"a": 1}\n{"b": "\n', 17), ('{"a": 1}\n{"b": 2}', 17), ("", 0), ("12", 0), ("x" * 200_000 + "\ny", 200_001)):
        path.write_text(text)
        assert session_logs.whole_lines(str(path), len(text)) == whole, text[:20]


def test_restarted_streams_lose_and_repeat_nothing(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    want = []

    def run():
        q = logs.session_log_stream(spark, str(folder)).select("session_id", "message.id", "line_no").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.session_id, r.id) for r in spark.read.parquet(out).collect())

    for turn in range(3):
        for s in ("local:a", "b"):
            with open(folder / f"{s}.jsonl", "a") as f:
                for i in range(turn * 10, turn * 10 + 10):
                    f.write(said(i, i) + "\n")
                    want.append((s, str(i)))
                f.write(said(1000 + turn, 1)[:20])  # half a line, which the next turn makes whole
            want.append((s, str(1000 + turn)))
        got = run()
        assert got == sorted(w for w in want if w[1] != str(1000 + turn))
        for s in ("local:a", "b"):
            with open(folder / f"{s}.jsonl", "a") as f:
                f.write(said(1000 + turn, 1)[20:] + "\n")
        if turn == 1:  # a batch that ended without its commit being noted is run again over the same bytes
            commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            commits[-1].unlink()
            (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == sorted(want)
    (folder / "b.jsonl").write_text("")
    with pytest.raises(Exception, match="shorter"):
        run()


def test_streams_append_once(spark, tmp_path):
    folder, ck = tmp_path / "in", str(tmp_path / "ck")
    folder.mkdir()
    (folder / "a.jsonl").write_text("1\n2\n")
    lines = lambda: repo.session_line_stream(spark, str(folder)).select("session_id", F.col("line_no.start").alias("place"), "value")
    for more in ("", "3\n"):
        with open(folder / "a.jsonl", "a") as f:
            f.write(more)
        q = sessions.append_stream(lines(), str(tmp_path / "out"), ck, "copy")
        q.processAllAvailable()
        q.stop()
    assert values(spark, tmp_path / "out", "a") == ["1", "2", "3"]
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink()
    q = sessions.append_stream(lines(), str(tmp_path / "out"), ck, "copy")
    q.processAllAvailable()
    q.stop()
    assert values(spark, tmp_path / "out", "a") == ["1", "2", "3"]


def test_guard_window(spark):
    edit = [("s", i, "EditFile", "p") for i in (0, 40)] + [("s", i, "Command", str(i)) for i in range(1, 33)] + [("s", 41, "EditFile", "p"), ("s", 42, "Terminal", '{"cmd":"sudo x"}')]
    got = {r.seq: r.decision for r in sessions.guard(spark.createDataFrame(edit, "session_id string, seq int, kind string, payload string"), 32).collect()}
    assert got[0] == "Allow" and got[40] == "Allow" and got[41] == "Warn" and got[42] == "Deny"


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (folder / "s1.jsonl").write_text("\n".join([said(0, 1), made("x", 5), said(1, 9), "junk", said(2, 11)]))
    found = {}
    note = lambda df, _: found.update({r.session_id: tuple(r)[1:] for r in df.collect()})
    q = logs.session_totals(logs.session_log_stream(spark, str(folder))).writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    assert found == {"s1": ("x", 5, 11, 2)}
    more = folder / "session_id=s1"
    more.mkdir()
    (more / "part-0").write_text("\n".join([said(3, 12), made("y", 20), said(4, 30)]))
    (folder / "s2.jsonl").write_text(said(1, 1))
    q.processAllAvailable()
    q.stop()
    assert found == {"s1": ("y", 20, 30, 1)}


def test_guard_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "EditFile", "p"), ("s", 2, "EditFile", "p"), ("s", 3, "Terminal", '{"cmd":"wget x"}')], "session_id string, seq bigint, kind string, payload string")
    rows.coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "a"))
    q = logs.guard_stream(stream).writeStream.outputMode("append").format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.seq: r.decision for r in spark.sql("select * from guarded").collect()} == {1: "Allow", 2: "Warn", 3: "Deny"}


def test_event_windows(spark):
    e = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 07:00:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert logs.windowed_counts(e, "6 hours").count() == 2
