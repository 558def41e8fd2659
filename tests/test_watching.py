"""A listing's books: what the order of their audio decides, and what a pass over them plans."""

import hashlib

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from versoline.streaming import watch as W


def tables(spark, path, lines, orders):
    """Tables of rows (l_partkey, l_orderkey, l_suppkey, l_linenumber) and (o_custkey, o_orderkey)."""
    spark.createDataFrame([(*x, 10.5) for x in lines], "l_partkey bigint, l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(*x, 20.5) for x in orders], "o_custkey bigint, o_orderkey bigint, o_totalprice double").write.parquet(f"{path}/orders.parquet")


def test_audio_of_a_book_is_in_natural_order(spark, tmp_path):
    tables(spark, tmp_path, [(3, 7, 8, 2), (3, 7, 10, 2), (3, 7, 1, 11), (4, 7, 9, 12), (4, 7, 18, 2)], [(3, 7), (4, 7)])
    got = {r.key: (r.audio_files, r.first_path, r.last_path) for r in entry.queries()["join_folder_pairing"](spark, str(tmp_path)).collect()}
    assert got == {"/lib/3/7/Novel 3.epub": (3, "/lib/3/7/Track 2 - 8.mp3", "/lib/3/7/Track 11 - 1.mp3"),
                   "/lib/4/7/Novel 4.epub": (2, "/lib/4/7/cd1/Track 2 - 18.mp3", "/lib/4/7/cd1/Track 12 - 9.mp3")}
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["join_folder_pairing"]).fetchall()
    assert {r[0]: r[4:] for r in want} == got


def listed(spark, *rows):
    return spark.createDataFrame(list(rows), W.FILES)


def test_a_pass_reads_a_listing_for_its_folders_only(spark, tmp_path):
    rows = [("/lib/a/A.epub", 1, 1), ("/lib/a/10.mp3", 2, 2), ("/lib/a/9.mp3", 3, 3), ("/lib/b/One.epub", 4, 4), ("/lib/b/Two.epub", 5, 5), ("/lib/b/one.mp3", 6, 6), ("/lib/b/x.mp3", 7, 7)]
    listed(spark, *rows).write.parquet(str(tmp_path / "files"))
    planned = W.pass_over(spark.read.parquet(str(tmp_path / "files")), None, "better")
    assert not [f for f in planned.inputFiles() if str(tmp_path) in f]
    sha = lambda *lines: hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()[:16].upper()
    assert {r.key: r.fingerprint for r in planned.collect()} == {
        "/lib/a/A.epub": sha("A.epub|1|1", "9.mp3|3|3", "10.mp3|2|2"), "/lib/b/One.epub": sha("One.epub|4|4", "one.mp3|6|6")}


def test_a_pass_minds_settings_output_and_what_it_knew(spark):
    book = lambda n, *more: [(f"/lib/{n}/B.epub", 1, 1), (f"/lib/{n}/1.mp3", 2, 2), *more]
    two = [("/lib/two/X.epub", 1, 1), ("/lib/two/Y.epub", 1, 1), ("/lib/two/1.mp3", 1, 1)]
    rows = [*book("plain"), *book("own"), *book("left"), *book("made"), *book("told"), *two, ("/out/made/B.epub", 9, 9), ("/out/made/1.mp3", 9, 9)]
    settings = spark.createDataFrame([("/lib/own", "best", None), ("/lib/left", None, True), ("/lib/two", None, None)], "folder string, recipe string, skip boolean")
    how = {"recipe": "better", "settings": settings, "narrated": spark.createDataFrame([("/lib/told/B.epub",)], "path string"), "library": "/lib", "output": "/out"}
    first = W.pass_over(listed(spark, *rows), None, **how).cache()
    assert {r.key: (r.action, r.status, r.recipe) for r in first.collect()} == {
        "/lib/plain/B.epub": ("work", "Waiting", "better"), "/lib/own/B.epub": ("work", "Waiting", "best"), "/lib/left/B.epub": ("skip", None, None),
        "/lib/made/B.epub": ("already made", "Done", "better"), "/lib/two/two.epub": ("problem", "Failed", "better")}
    # All are done since; another default, a new disc where there was no audio, a changed file, one folder's books gone, one left alone no more.
    done = first.withColumn("status", F.when(F.col("action") == "work", "Done").otherwise(F.col("status")))
    more = [("/lib/new/B.epub", 1, 1), ("/lib/new/cd1/1.mp3", 1, 1), ("/lib/plain/2.mp3", 1, 1)]
    now = [*[r for r in rows if r[0] != "/lib/own/B.epub"], *more]
    changed = spark.createDataFrame([("/lib/new/cd1/1.mp3",), ("/lib/plain/2.mp3",), ("/lib/own/B.epub",)], "path string")
    how |= {"recipe": "light", "settings": settings.filter("folder <> '/lib/left'")}
    second = W.pass_over(listed(spark, *now), done, changed=changed, **how)
    want = W.pass_over(listed(spark, *now), done, **how)
    assert sorted(map(str, second.collect())) == sorted(map(str, want.collect()))
    assert {r.key: r.action for r in second.collect()} == {
        "/lib/plain/B.epub": "work", "/lib/own/B.epub": "gone", "/lib/left/B.epub": "work", "/lib/made/B.epub": "nothing", "/lib/two/two.epub": "problem", "/lib/new/B.epub": "work"}


def test_the_watch_goes_on_from_its_first_pass(spark, tmp_path):
    lines = [(p, o, s, n) for p in (3, 4) for o in range(40) for s in (1, 9) for n in (1, 2)]
    tables(spark, tmp_path, lines, [(p, o) for p in (3, 4) for o in range(40)])
    spark.createDataFrame([(p, p % 50) for p in range(1, 2000)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    actions = {r.action for r in entry.queries()["str_library_watch"](spark, str(tmp_path)).collect()}
    assert {"work", "nothing"} <= actions  # a first pass knows of no book to do nothing about


def test_a_change_in_a_folder_leaves_its_neighbours_unread(spark):
    rows = listed(spark, ("/lib/x/A.epub", 1, 1), ("/lib/x/1.mp3", 1, 1), ("/lib/y/B.epub", 1, 1), ("/lib/y/cd1/1.mp3", 1, 1), ("/lib/z/C.epub", 1, 1))
    read = lambda *folders: {r.path for r in W.near(rows, W.contents(rows), spark.createDataFrame([(f,) for f in folders], "folder string")).collect()}
    assert read("/lib/x") == {"/lib/x/A.epub", "/lib/x/1.mp3"}
    assert read("/lib/y") == {"/lib/y/B.epub", "/lib/y/cd1/1.mp3"}
    assert {r.folder for r in W.touched(rows.filter("path = '/lib/y/cd1/1.mp3'")).collect()} == {"/lib/y/cd1", "/lib/y"}
