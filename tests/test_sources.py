import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from hilite.sources import live, readers, sinks, web
from hilite.streaming import windows

LINE = "0.338\t1\t25\t16777215\t1479210896\t0\tabc\t2718055\thello"


def test_comment_files(spark, tmp_path):
    (tmp_path / "9.txt").write_text(f"{LINE}\n{LINE}\ttail\nshort\tline\n{LINE[:-5]}\n", encoding="utf-8")
    rows = readers.read_comments(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.cid, r.row_id, r.content) for r in rows] == [("9", "2718055", "hello")] * 2


def test_xml(spark, tmp_path):
    (tmp_path / "5.xml").write_text('<i><d p="1.5,1,25,0,99,0,s,r1">a\nb</d><d p="2,4,25,0,99,0,s,r2">&lt;c</d></i>', encoding="utf-8")
    assert [(r.cid, r.position, r.row_id, r.content) for r in readers.read_xml(spark, str(tmp_path)).collect()] == [("5", 0, "r1", "a\nb"), ("5", 1, "r2", "&lt;c")]


def test_dated_logs(spark, tmp_path):
    (tmp_path / "2017-03-04.txt").write_text("2017-03-04 11:59:59\tx\tearly\n2017-03-04 12:00:05\ty\thi\nbad\n2017-03-05 00:00:00\tx\tlate\nnope\tx\ty\n", encoding="utf-8")
    assert [(r.offset, r.sender_name, r.content) for r in readers.read_dated_logs(spark, str(tmp_path)).orderBy("time").collect()] == [(5.0, "y", "hi"), (43200.0, "x", "late")]


def test_labels_and_dictionaries(spark, tmp_path):
    (tmp_path / "7_train_data.txt").write_text("75:00\t76:10\tb\n00:10\t00:20\ta\nx\ty\nx\ty\tz\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "7_train_data.txt")).collect()] == [("7", 10, 20, "a"), ("7", 4500, 4570, "b")]
    (tmp_path / "words").write_text("a\nb\na\n\n", encoding="utf-8")
    assert {r.word for r in readers.read_words(spark, str(tmp_path / "words"), always=(" ", "\t")).collect()} == {"a", "b", " ", "\t"}
    (tmp_path / "rules").write_text("88\tA\tn\n886\tB\tn\tnote\nshort\n", encoding="utf-8")
    assert [(r.pattern, r.word) for r in readers.read_rules(spark, str(tmp_path / "rules"))] == [("88", "A"), ("886", "B")]
    (tmp_path / "scores").write_text("very\t2\nvery\t3\nbit\t0.5\n", encoding="utf-8")
    first = {r.word: r.score for r in readers.read_table(spark, str(tmp_path / "scores"), ["word", "score"], keep="first").collect()}
    last = {r.word: r.score for r in readers.read_table(spark, str(tmp_path / "scores"), ["word", "score"], keep="last").collect()}
    assert first == {"very": "2", "bit": "0.5"} and last == {"very": "3", "bit": "0.5"}


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", "1.5", "x\"y"), ("a", "70", "z"), ("b", "2", "w")], "cid string, play_timestamp string, content string")
    sinks.append_comments(df, out)
    sinks.append_comments(df, out)
    assert spark.read.option("sep", "\t").option("quote", "").csv(out).count() == 6
    sinks.append_comments(df, str(tmp_path / "corpus"), corpus=True)
    sinks.write_sorted(df, str(tmp_path / "sorted"), "play_timestamp")
    assert [r.time for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "sorted")).collect()] == ["0 minutes 1 seconds", "0 minutes 2 seconds", "1 minutes 10 seconds"]
    parents = spark.createDataFrame([("v1",)], "aid string")
    new = lambda *rows: spark.createDataFrame(rows, "row_id string, video_aid string")
    insert = lambda df: sinks.insert(df, parents, str(tmp_path / "t"), "video_aid", "aid", "row_id")
    assert insert(new(("1", "v1"), ("2", "v1")))
    assert not insert(new(("3", "v1"), ("1", "v1")))
    assert not insert(new(("4", "v2")))
    assert not insert(new(("5", "v1"), ("5", "v1")))
    assert insert(new(("6", "v1"))) and spark.read.parquet(str(tmp_path / "t")).count() == 3
    sinks.write_table(df.withColumn("a", F.array("content")), str(tmp_path / "table"))
    sinks.write_clips(spark.createDataFrame([("v", 70, 75, "x")], "cid string, start int, end int, label string"), str(tmp_path / "clips"))
    assert spark.read.text(str(tmp_path / "clips")).collect()[0].value == "v\t1:10\t1:15\tx"


def test_corpus_and_segments(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "id int, pos int, word string")
    sinks.write_corpus(t, str(tmp_path / "corpus"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "corpus")).collect()) == ["a\tb", "c"]
    (tmp_path / "9.json").write_text('[{"play_timestamp":1.5,"row_id":"r","sender_id":"s","index":0,"sentence_seg_list":[{"word":"a","flag":"n","start_position":0,"end_position":0}]}]', encoding="utf-8")
    got = readers.read_segments(spark, str(tmp_path / "9.json")).collect()
    assert [(r.cid, r.row_id, r.sentence_seg_list[0].word) for r in got] == [("9", "r", "a")]


def test_web(spark):
    html = '<h1 title="t">Name</h1><meta name="keywords" content="a,b"><span property=\'v:title\'>x</span>"cid":"77"$ROOM = {"room_id": "5", "room_name": "n"}; "server_config":"%5B%7B%22ip%22%3A%22h%22%2C%22port%22%3A%221%22%7D%5D"'
    df = spark.createDataFrame([(html, "http://x/av12/"), ("", "http://x/"), (None, None)], "html string, url string")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in web.html_fields(F.col("html"), F.col("url")).items())).collect()]
    assert got[0] == ("Name", "a\tb", "x", "77", "12") and got[1][3:] == ("-1", None)
    rooms = df.select(web.room_json(F.col("html")).room_id.alias("r"), web.server_list(F.col("html")).alias("s")).collect()
    assert rooms[0].r == "5" and [tuple(s) for s in rooms[0].s] == [("h", "1")] and rooms[1].r is None
    calls = []

    def get(url):
        calls.append(url)
        if url == "bad":
            raise OSError
        import gzip

        return gzip.compress(b"ok\xff")

    assert [r.content for r in web.fetch(spark.createDataFrame([("u",), ("bad",), (None,)], "u string").coalesce(1), "u", get).collect()] == ["ok", "", ""]
    seasons = spark.createDataFrame([('{"code":0,"message":"success","result":{"tags":[{"tag_name":"a"},{"tag_name":"b"}],"episodes":[{"av_id":"1"}]}}',), ('{"code":1}',), ("x",)], "j string")
    assert [r.t for r in seasons.select(web.season_tags(F.col("j")).alias("t")).collect()] == ["a\tb", None, None]
    assert [r.av_id for r in web.season_episodes(seasons, "j").collect()] == ["1"]
    assert spark.range(1).select(web.page_count(F.lit(61))).collect()[0][0] == 3


def test_messages(spark):
    assert live.unframed(live.framed("a/") + live.framed("b" * 500) + b"\x10") == (["a/", "b" * 500], b"\x10")
    raw = ["type@=chatmsg/rid@=1/uid@=2/nn@=n@AS/txt@=hi@S/cid@=3/level@=4/", "type@=keeplive/", "type@=chatmsg/rid@=1/", None]
    df = spark.createDataFrame([(r, 1.0) for r in raw], "raw string, t double")
    assert [tuple(r) for r in live.parsed(df, "raw", "t").collect()] == [(1.0, "1", "2", "n@S".replace("@S", "/"), "hi/", "3", "4")]


def test_spooled_messages(tmp_path):
    """More than any buffer holds, read again after a restart, gone once committed."""
    reader = live._Reader({"spool": str(tmp_path / "s")})
    reader._receive = lambda: [(0.0, str(i)) for i in range(150_000)]
    assert reader.latestOffset() == {"n": 150_000} and reader.latestOffset() == {"n": 300_000}
    again = live._Reader({"spool": str(tmp_path / "s")})
    again._receive = lambda: []
    assert again.latestOffset() == {"n": 300_000}
    rows = [r for p in again.partitions({"n": 10}, {"n": 300_000}) for r in again.read(p)]
    assert len(rows) == 299_990 and rows[0] == (0.0, "10") and rows[149_990] == (0.0, "0")
    again.commit({"n": 150_000})
    assert [r[1] for p in again.partitions({"n": 150_000}, {"n": 150_002}) for r in again.read(p)] == ["0", "1"]
    again.commit({"n": 300_000})
    assert live._Reader({"spool": str(tmp_path / "s")}).partitions({"n": 300_000}, {"n": 300_000}) == []
    with pytest.raises(ValueError, match="no longer"):
        again.partitions({"n": 9}, {"n": 12})
    with pytest.raises(ValueError, match="spool"):
        live._Reader({})


def message(i):
    return live.framed(f"type@=chatmsg/rid@=1/uid@=2/nn@=n/txt@=m{i}/cid@={i}/level@=4/")


def test_busy_and_closing_connections(tmp_path):
    """A chat that never pauses ends no batch late, and one that closes in the middle of a message is joined again."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        for i in range(300):
            c.sendall(message(i))
        c.sendall(message(300)[:20])
        c.recv(65536)  # else the end is a reset, which drops what is on its way
        time.sleep(0.1)
        c.close()
        c, _ = server.accept()
        i = 300
        try:
            while True:
                c.sendall(message(i))
                i += 1
                time.sleep(0.001)
        except OSError:
            pass

    threading.Thread(target=serve, daemon=True).start()
    reader = live._Reader({"spool": str(tmp_path / "s"), "port": str(server.getsockname()[1]), "wait": "0.3"})
    began, ends = time.time(), [reader.latestOffset()["n"] for _ in range(8)]
    assert time.time() - began < 8 and ends == sorted(ends) and ends[-1] > 400
    rows = [r[1] for p in reader.partitions({"n": 0}, {"n": ends[-1]}) for r in reader.read(p)]
    assert [r.split("txt@=m")[1].split("/")[0] for r in rows] == [str(i) for i in range(ends[-1])]
    reader.socket.close()
    server.close()


def test_live_stream(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for part in (range(3), range(3, 6)):
            c, _ = server.accept()
            for i in part:
                c.sendall(message(i))
            time.sleep(0.2)
            c.recv(65536)  # else the end is a reset, which drops what is on its way
            c.close()

    threading.Thread(target=serve, daemon=True).start()
    spark.dataSource.register(live.LiveChat)
    out = str(tmp_path / "out")

    def started():
        stream = spark.readStream.format("livechat").option("port", server.getsockname()[1]).option("hello", "type@=loginreq/").option("spool", str(tmp_path / "spool")).load()
        return windows.chat(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    got = lambda: spark.read.schema("txt string").parquet(out).count() if (tmp_path / "out" / "_spark_metadata").exists() else 0
    q = started()
    try:
        for want in (3, 6):
            for _ in range(60):
                if got() >= want:
                    break
                time.sleep(0.5)
            q.stop()
            if want == 3:
                q = started()
        assert sorted(r.txt for r in spark.read.parquet(out).collect()) == [f"m{i}" for i in range(6)]
    finally:
        q.stop()
        server.close()


def split_files(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    e.repartition(4).write.parquet(path)
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_windows_are_batch_windows(spark, tmp_path):
    e, stream = split_files(spark, tmp_path)
    for name, make in (("t", lambda d: windows.tumbling(d, "ts", "1 hour", ["event_type"])), ("s", lambda d: windows.sliding(d, "ts", "2 hours", "1 hour", ["event_type"]))):
        q = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.sql(f"SELECT * FROM {name}").collect())) == sorted(map(tuple, make(e).collect()))


def test_stream_deliveries(spark, tmp_path):
    e, _ = split_files(spark, tmp_path)
    path, out = str(tmp_path / "twice"), str(tmp_path / "once")
    e.union(e).repartition(3).write.parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.writeStream.foreachBatch(windows.new_only(out, "event_id", ["ts"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == e.count() == spark.read.parquet(out).select("event_id").distinct().count()
    q = windows.first_deliveries(stream, "event_id").writeStream.format("memory").queryName("first").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM first").count() == e.count()
    q = windows.once(stream, "event_id", "ts", "60 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM once").count() == e.count()


def test_stream_highlights(spark, tmp_path):
    _, stream = split_files(spark, tmp_path)
    counts = windows.tumbling(stream, "ts", "6 hours", ["event_type"]).select(F.lit("v").alias("cid"), "start", "event_type", "comments")
    q = counts.writeStream.outputMode("complete").foreachBatch(windows.rated(str(tmp_path / "best"), "cid", "event_type", 5, 0.7, 0.3)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "best")).count() > 0
