"""What a review found on larger tables: how steps are planned, beside their results."""

import numpy as np
from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.llm import maxent as M
from versoline.operators import incremental as I
from versoline.operators import locate as Q
from versoline.operators import primitives as P
from versoline.operators import texts as T
from versoline.operators import tokens as K


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairing_reads_the_listing_once(spark, tmp_path):
    rows = [(f"/lib/a/{n}", 1, 1) for n in ("One.epub", "Two.epub", "one.mp3", "two.mp3", "three.mp3")] + [("/lib/b/B.epub", 2, 2), ("/lib/b/x.mp3", 3, 3), ("/lib/b/y.mp3", 4, 4)]
    spark.createDataFrame(rows, "path string, size bigint, mtime bigint").write.parquet(str(tmp_path / "files"))
    books, parts = I.folder_pairing(spark.read.parquet(str(tmp_path / "files")))
    assert {(r.key, r.path) for r in parts.collect()} == {
        ("/lib/a/One.epub", "/lib/a/one.mp3"), ("/lib/a/Two.epub", "/lib/a/two.mp3"), ("/lib/b/B.epub", "/lib/b/x.mp3"), ("/lib/b/B.epub", "/lib/b/y.mp3")}
    assert not [f for df in (books, parts) for f in df.inputFiles() if str(tmp_path) in f]


def test_frequent_words_count_in_all_slices(spark):
    # "both" is third in each slice and first in all of them; word 0 of a slice is the end.
    rows = [(bytearray(M.pack(np.array([9, a, b, 7], np.uint64))), bytearray(M.pack(np.array([1, 5, 5, 4], np.uint32)))) for a, b in ((1, 2), (3, 4), (5, 6))]
    cut = spark.createDataFrame(rows, "hashes binary, counts binary")
    assert M.frequent_words(cut, 1).tolist() == [7]


def test_natural_keys_are_strings_that_sort_by_code_points(spark):
    names = ["", "a", "a\u0000", "a\u0001", "a07", "a7b", "a10", "a99999999", "a100000000", "a0000000000100000001", "as", "ast", "aß", "aßa", "b"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int").withColumn("k", X.natural_key(F.col("n")))
    assert df.schema["k"].dataType.simpleString() == "string"
    assert [r.n for r in df.orderBy(F.desc("i")).orderBy("k").collect()] == ["", "a", "a\u0000", "a\u0001", "a07", "a7b", "a10", "a99999999", "a100000000", "a0000000000100000001", "as", "ast", "aß", "aßa", "b"]


def test_sentence_ends_are_only_tried_at_marks(spark):
    df = T.sentences(spark.createDataFrame([(1, "One. Two.")], "doc_id int, text string"))
    assert f"(?=[{T.TERMINATORS}])(?<!" in plan(df)


def test_texts_are_cut_once_for_places(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "")], "doc_id int, text string")
    asked = docs.select("doc_id", F.lit(4).alias("at_char"))
    got = K.index_at_char(asked, K.tokens(docs))
    assert {r.doc_id: r.tok_idx for r in got.collect()} == {1: 1, 2: 1, 3: 0}
    assert "regexp_extract_all" not in plan(got)


def test_token_places_are_staged_as_cells(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d " * 200), (2, "x"), (3, ""), (4, "one two"), (4, "three four five"), (None, "n")], "doc_id int, text string")
    asked = [(1, -1), (1, 0), (1, 63), (1, 64), (1, 65), (1, 1598), (1, 1599), (1, None), (2, 1), (3, 0), (4, 4), (4, 11), (5, 0), (None, 0)]
    got = K.index_at_char(spark.createDataFrame(asked, "doc_id int, at_char int"), K.tokens(docs))
    want = [0, 0, 32, 32, 33, 799, 800, 800, 1, 0, 1, 2, 0, 0]
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={d}, at_char={a}, tok_idx={w})" for (d, a), w in zip(asked, want))
    staged, stage = [], P.stage
    monkeypatch.setattr(P, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    K.index_at_char(spark.createDataFrame([(1, 5)], "doc_id int, at_char int"), K.tokens(docs.filter("doc_id = 1")))
    assert [df.count() for df in staged] == [25, 1, 1]  # 800 tokens


def test_small_groups_fold_in_one_batch(spark):
    df = spark.createDataFrame([(None, 1), (1, 1), (1, 2), (2, 1), (None, 2)], "k bigint, p bigint")

    class Count:
        def __init__(self):
            self.n = 0

        def __call__(self, pdf):
            self.n += len(pdf)
            return pdf[["p"]].assign(n=self.n)

    folded = P.fold_in_order(df.coalesce(1), ["k"], ["p"], Count, "p bigint, n bigint")
    assert sorted((r.p, r.n) for r in folded.collect()) == [(1, 1), (1, 2), (1, 2), (2, 2), (2, 2)]
    assert "FlatMapGroups" not in plan(folded)


def test_passage_search_bounds_its_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id bigint, text string")
    Q.match(docs.select(F.col("doc_id").alias("query_id"), "text"), docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
