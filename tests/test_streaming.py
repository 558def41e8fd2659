"""Each stream gets its input in several micro-batches, out of order, with a restart, and must give the batch answer."""

import datetime as dt
import random

from pyspark.sql import functions as F

from versoline.sources import mapstore, versions
from versoline.streaming import anchors as SA
from versoline.streaming import positions as S
from versoline.streaming import watch as W

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def feed(spark, path, schema, *files):
    """One parquet file per micro-batch."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert q.exception() is None


def to_table(df, out, checkpoint, mode="append"):
    def write(batch, _):
        batch.write.mode("append").parquet(out)

    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)


EVENTS = "book_id bigint, ts timestamp, audio_ms bigint, text_offset int, speed double"


def test_position_upsert_survives_disorder_and_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(1, 5), at(i), rng.choice([None, i * 10]), rng.choice([None, i]), rng.choice([None, 1.0, 1.5])) for i in range(90)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ck")
    feed(spark, src, EVENTS, shuffled[:30], shuffled[30:60])
    run(S.stream_upsert(stream(spark, src, EVENTS), out, ck))
    feed(spark, src, EVENTS, shuffled[60:])
    run(S.stream_upsert(stream(spark, src, EVENTS), out, ck))
    cols = ["book_id", "audio_ms", "text_offset", "speed", "updated"]
    got = S.state(spark, out).select(*cols)
    want = S.latest(spark.createDataFrame(rows, EVENTS)).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_exact_throttle(spark, tmp_path):
    schema = "book_id bigint, medium string, ts timestamp, value double, now boolean"
    rows = [(1, "audio", at(s), float(s), now) for s, now in [(0, False), (5, False), (12, False), (31, False), (33, True), (50, False), (200, False)]]
    src = str(tmp_path / "in")
    flush = [(9, "audio", at(4000), 0.0, False)]
    feed(spark, src, schema, rows[:3], rows[3:], flush, [(9, "audio", at(4001), 0.0, False)])
    out = str(tmp_path / "out")
    run(to_table(S.stream_throttle(stream(spark, src, schema), watermark="300 seconds"), out, str(tmp_path / "ck")))
    got = sorted((r.at_ms // 1000 - 1704067200, r.value) for r in spark.read.parquet(out).filter("book_id = 1").collect())
    # 0 at once; 12 pending, sent when its wait ends; 31 pending, overtaken by the urgent 33; 50 when due; 200 at once.
    assert got == [(0, 0.0), (30, 12.0), (33, 33.0), (63, 50.0), (200, 200.0)]


def test_tumbling_throttle_and_sessions_agree_with_batch(spark, tmp_path):
    schema = "book_id bigint, medium string, ts timestamp, value double"
    rng = random.Random(2)
    rows = [(rng.randint(1, 3), rng.choice(["audio", "text"]), at(i * 7 + rng.randint(0, 6)), float(i)) for i in range(80)]
    late_but_ok = [rows[i ^ 1] for i in range(80)]
    src = str(tmp_path / "in")
    end = [(99, "audio", at(9000), 0.0)]
    feed(spark, src, schema, late_but_ok[:40], late_but_ok[40:], end, end)
    for name, fn in [("t", S.throttled), ("s", S.coverage_sessions)]:
        df = stream(spark, src, schema).withWatermark("ts", "30 seconds")
        out = str(tmp_path / name)
        run(to_table(fn(df), out, str(tmp_path / ("ck" + name))))
        want = fn(spark.createDataFrame(rows, schema))
        got = spark.read.parquet(out).filter("book_id < 99")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_chapter_resume_stream_equals_batch(spark, tmp_path):
    schema = "book_id bigint, chapter_idx int, seq bigint, kind string, position bigint, from bigint, to bigint"
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), rng.randint(0, 2), i, rng.choice(["enter", "leave", "leave"]), rng.randint(0, 130000), 10000, 120000) for i in range(120)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ck = str(tmp_path / "ck")
    feed(spark, src, schema, rows[:50])
    run(to_table(S.stream_resume(stream(spark, src, schema)), out, ck))
    feed(spark, src, schema, rows[50:])
    run(to_table(S.stream_resume(stream(spark, src, schema)), out, ck))
    want = S.chapter_resume(spark.createDataFrame(rows, schema))
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.filter("resume_at is not null").count() > 3


def test_newer_elsewhere(spark):
    remote = spark.createDataFrame([(1, "audio", 100.0, None, 50_000), (2, "audio", 40.0, None, 50_000), (3, "text", None, .5, 50_000), (4, "audio", 100.0, None, 9_000)],
                                   "book_id bigint, medium string, at_s double, fraction double, when_ms bigint")
    local = spark.createDataFrame([(b, 0, 0, 10_000, 10_000, 0) for b in (1, 2, 3, 4)],
                                  "book_id bigint, audio_ms bigint, text_offset int, text_length int, active_ms bigint, seen_ms bigint")
    got = {(r.book_id, r.audio_at, r.text_at) for r in S.newer_elsewhere(remote, local).collect()}
    assert got == {(1, 100_000, None), (3, None, 5_000)}


def test_anchor_insert_stream(spark, tmp_path):
    schema = "book_id bigint, chapter_idx int, seq bigint, window_id bigint, audio_ms bigint, char_offset int, confidence double"
    rng = random.Random(6)
    rows = [(rng.randint(1, 2), 0, i, i, t, t // 60 + rng.randint(-60, 60), .9) for i, t in enumerate(rng.sample(range(0, 60000, 100), 120))]
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    feed(spark, src, schema, rows[:70])
    run(to_table(SA.stream_insert(stream(spark, src, schema)), out, ck))
    feed(spark, src, schema, rows[70:])
    run(to_table(SA.stream_insert(stream(spark, src, schema)), out, ck))
    want = SA.insert_in_order(spark.createDataFrame(rows, schema))
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    kept = sorted((r.audio_ms, r.char_offset) for r in want.filter("accepted and book_id = 1").collect())
    assert all(a[1] < b[1] for a, b in zip(kept, kept[1:]))


def test_a_refused_window_rebuilds_its_chapter():
    c = SA.Chapter([(0, 9000, .5), (60000, 9900, .5)])
    refused = [(10000, 150, .9), (20000, 300, .9), (30000, 450, .9)]
    assert not any(c.insert(*a) for a in refused)
    c.rebuild(refused)
    assert [a[1] for a in c.anchors] == [150, 300, 450, 9900]


def test_library_watch_resumes(spark, tmp_path):
    src, listing, state, ck = (str(tmp_path / x) for x in ("in", "listing", "state", "ck"))
    feed(spark, src, W.FILES, [("/lib/a/Book.epub", 10, 1), ("/lib/a/1.mp3", 5, 1)], [("/lib/b/Other.epub", 10, 1)])
    run(W.stream_watch(stream(spark, src, W.FILES), listing, state, "better", ck))
    first = {r.key: (r.status, r.fingerprint) for r in W.state(spark, state).collect()}
    assert set(first) == {"/lib/a/Book.epub"} and first["/lib/a/Book.epub"][0] == "Waiting"
    feed(spark, src, W.FILES, [("/lib/b/x.mp3", 7, 2), ("/lib/a/1.mp3", 6, 2)])
    run(W.stream_watch(stream(spark, src, W.FILES), listing, state, "better", ck))
    second = {r.key: (r.status, r.fingerprint) for r in W.state(spark, state).collect()}
    assert set(second) == {"/lib/a/Book.epub", "/lib/b/Other.epub"}
    assert second["/lib/a/Book.epub"][1] != first["/lib/a/Book.epub"][1]


def test_map_store_and_packages(spark, tmp_path):
    maps = spark.createDataFrame([(b, 0, t * 1000, t * 15, .9) for b in (1, 2, 3) for t in range(50)], mapstore.ANCHORS)
    path = str(tmp_path / "maps")
    assert mapstore.load(spark, path) is None
    mapstore.save(maps, path)
    mapstore.save(maps.filter("book_id = 2 and audio_ms < 5000"), path)
    got = {r.book_id: r["count"] for r in mapstore.load(spark, path).groupBy("book_id").count().collect()}
    assert got == {1: 50, 2: 5, 3: 50}
    chapters = spark.createDataFrame([(b, 0, 0, 900) for b in (1, 2, 3)], "book_id bigint, chapter_idx int, text_start int, text_end int")
    books = spark.createDataFrame([(b, f"B{b}", f"a{b}", f"e{b}") for b in (1, 2, 3)], "book_id bigint, title string, audio_hash string, ebook_hash string")
    out = str(tmp_path / "packages")
    mapstore.export(maps, chapters, books, out)
    spark.createDataFrame([("not json",), ('{"version": 1}',)], "value string").write.mode("append").text(out)
    back = mapstore.import_packages(spark, out)
    assert back.count() == 150 and back.select(F.sum("audio_ms")).first()[0] == maps.select(F.sum("audio_ms")).first()[0]


def test_versions_count_when_committed(spark, tmp_path):
    path = str(tmp_path / "maps")
    row = lambda b, t, c: (b, 0, t, t, c)
    frame = lambda *rows: spark.createDataFrame(list(rows), mapstore.ANCHORS)
    key = lambda df: sorted(map(tuple, df.collect()))
    mapstore.save(frame(row(1, 1, 0.0), row(1, 2, 0.9), row(2, 1, 0.5)), path)
    # the writer dies after its files and before its commit
    versions.write(frame(row(1, 7, 0.7)), path, 2)
    assert key(mapstore.stored(spark, path)) == [row(1, 1, 0.0), row(1, 2, 0.9), row(2, 1, 0.5)]
    mapstore.save(frame(row(2, 3, 0.3)), path)
    assert key(mapstore.stored(spark, path)) == [row(1, 1, 0.0), row(1, 2, 0.9), row(2, 3, 0.3)]
    for k in range(versions.KEPT + 3):
        mapstore.save(frame(row(3, k, 0.1)), path)
    assert key(mapstore.stored(spark, path)) == [row(1, 1, 0.0), row(1, 2, 0.9), row(2, 3, 0.3), row(3, versions.KEPT + 2, 0.1)]
    assert len(versions._commits(spark, path)) < versions.KEPT
