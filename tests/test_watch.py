"""Streams: bursts, each finding once, and a watch that tells only what is new."""

import datetime as dt

from quern.plans import analysis as A
from quern.sources.project import ProjectInfo
from quern.streaming import watch as W
from quern.streaming.sessions import bursts

T0 = dt.datetime(2024, 1, 1)
INFO = ProjectInfo(name="w", languages=("typescript",), has_typescript=True)


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _run(query):
    query.processAllAvailable()
    query.stop()


def test_bursts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(u, _at(s)) for u, times in {1: (0, 10, 2000, 2010), 2: (5, 1700, 4000)}.items() for s in times]
    table = spark.createDataFrame(rows, "user_id long, ts timestamp")
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute")
    _run(bursts(stream).writeStream.format("memory").queryName("got_bursts").outputMode("complete").start())
    want = sorted(tuple(r) for r in bursts(table).collect())
    assert sorted(tuple(r) for r in spark.table("got_bursts").collect()) == want and len(want) == 4


def test_each_finding_once(spark, tmp_path):
    rows = [("a", _at(1), "x"), ("b", _at(2), "y"), ("a", _at(3), "x")]
    df = spark.createDataFrame(rows, "fingerprint string, ts timestamp, title string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = W.first_seen(stream).writeStream.format("memory").queryName("got_first").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    _run(query)
    assert sorted((r.fingerprint, r.ts) for r in spark.table("got_first").collect()) == [("a", _at(1)), ("b", _at(2))]


def test_watch_tells_what_is_new(spark, tmp_path):
    files = {"a.ts": "import './b';\n", "b.ts": "export const b = 1;\n"}
    session = W.Session.start(A.from_texts(spark, spark.createDataFrame(list(files.items()), "path string, text string"), INFO))
    files["b.ts"] = "import './a';\nexport const b = 1;\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("b.ts\nnode_modules/x.ts\nnotes.md\nb.ts\n")
    errors = []
    texts = lambda paths: spark.createDataFrame([(p, files.get(p)) for p in paths], "path string, text string")
    query = W.watch(W.changes(spark, f"{tmp_path}/in"), session, texts, f"{tmp_path}/cp", on_error=errors.append, once=True)
    query.awaitTermination(200)
    assert not errors and len(session.reports) == 1
    told = session.reports[0]
    assert told["touched"] == ["b.ts"] and [(n["id"], n["file"], n["place"]) for n in told["new"] if n["severity"] == "error"] == [("architecture/circular-dependency", "a.ts", "inAffected")]
    assert told["dropped"]["architecture"] < 0


def test_findings_are_told_again_after_a_quiet_time(spark, tmp_path):
    # two files, read one after the other; what comes late but inside the watermark counts
    from quern.streaming import told as T

    first = [("a", _at(s)) for s in (0, 30, 61, 100, 122)] + [("b", _at(5)), (None, _at(1)), ("c", None)]
    second = [("a", _at(200)), ("b", _at(50)), ("b", _at(400)), ("d", _at(401)), ("d", _at(401))]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "fingerprint string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("fingerprint string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    T.run_to_end(T.told(stream, 60, "300 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = sorted((r.fingerprint, (r.ts - T0).total_seconds()) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0), ("a", 61), ("a", 122), ("a", 200), ("b", 5), ("b", 400), ("d", 401)]
