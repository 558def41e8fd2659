"""Maps and books of the same two files: every map times every book, with the rows of one pair in several tasks."""

import random
from collections import Counter

from pyspark.sql import functions as F

from versoline.operators import library as L
from versoline.semantics import MAP_VERSION

MAPS = "map_id long, version int, audio_hash string, ebook_hash string"
BOOKS = "book_id long, audio_hash string, ebook_hash string"


def test_every_map_with_every_book(spark):
    rng = random.Random(3)
    names = ["hot"] * 6 + ["b", "c", "d", "", None]
    maps = [(rng.choice([None, *range(40)]), rng.choice([MAP_VERSION, MAP_VERSION, 1]), rng.choice(names), rng.choice(["x", "x", "y", "", None])) for _ in range(300)]
    books = [(rng.choice([None, *range(50)]), rng.choice(names), rng.choice(["x", "x", "y", "", None])) for _ in range(300)]
    maps += [(i, MAP_VERSION, "maps only", "x") for i in range(40)]
    books += [(i, "books only", "x") for i in range(40)]
    want = Counter((a, e, m, v, b) for m, v, a, e in maps for b, x, y in books if v == MAP_VERSION and a and e and (a, e) == (x, y))
    m, b = spark.createDataFrame(maps, MAPS), spark.createDataFrame(books, BOOKS)
    for block in (3, 7, 4096):
        got = L.by_pair_hash(m, b, block)
        assert got.columns == ["audio_hash", "ebook_hash", "map_id", "version", "book_id"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert L.by_pair_hash(m.filter("map_id > 99"), b.filter("book_id > 99")).count() == 0


def test_rows_of_one_pair_in_several_tasks(spark):
    one = [F.expr("if(id < 0, '', 'a')").alias("audio_hash"), F.expr("if(id < 0, '', 'e')").alias("ebook_hash")]
    maps = spark.range(5_000).select(F.col("id").alias("map_id"), F.lit(MAP_VERSION).alias("version"), *one)
    books = spark.range(5_000).select(F.col("id").alias("book_id"), *one)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        rows = [r["count"] for r in L.by_pair_hash(maps, books).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(rows) == 25_000_000
    assert max(rows) < 20_000_000
