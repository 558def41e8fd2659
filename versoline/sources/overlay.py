"""Narration overlays: par rows to anchors, and clips back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import primitives as P


def resolved(folder: Column, relative: Column) -> Column:
    """A relative href against a folder, with ``.`` and ``..`` taken out."""
    decoded = F.coalesce(F.try_url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))), relative)
    joined = F.translate(F.when(folder != "", F.concat(folder, F.lit("/"), decoded)).otherwise(decoded), "\\", "/")
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, p: F.when(
        (p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(kept, "/")


def read_pars(spark: SparkSession, path: str) -> DataFrame:
    """``<par>`` elements of overlay files, with the file each came from."""
    schema = "_id string, text struct<_src: string>, audio struct<_src: string, _clipBegin: string, _clipEnd: string>"
    p = spark.read.format("xml").option("rowTag", "par").schema(schema).load(path)
    return p.select(
        F.col("_metadata.file_path").alias("smil"), F.col("_id").alias("id"), F.col("text._src").alias("text_src"), F.col("audio._src").alias("audio_src"),
        F.col("audio._clipBegin").alias("clip_begin"), F.col("audio._clipEnd").alias("clip_end"))


def anchors(pars: DataFrame, spine_ids: DataFrame) -> DataFrame:
    """Pars to anchors: ``pars(book_id, smil, text_src, audio_src, clip_begin)`` joined to element offsets.

    ``spine_ids(book_id, entry, fragment, char_offset)``, where a null fragment is the document's start
    and offsets already stand on a visible character.  An unreadable clock drops the row.
    """
    folder = F.regexp_extract("smil", "^(.*)/[^/]*$", 1)
    p = pars.select(
        "book_id", resolved(folder, F.split_part("text_src", F.lit("#"), F.lit(1))).alias("entry"),
        F.when(F.contains("text_src", F.lit("#")), F.regexp_extract("text_src", "#(.*)$", 1)).alias("fragment"),
        resolved(folder, F.col("audio_src")).alias("audio"), X.clock_ms(F.coalesce("clip_begin", F.lit("0"))).alias("audio_ms"))
    ids = spine_ids.select("book_id", "entry", F.coalesce("fragment", F.lit("")).alias("__f"), "char_offset")
    return p.filter("audio_ms is not null").withColumn("__f", F.coalesce("fragment", F.lit(""))).join(ids, ["book_id", "entry", "__f"]).select(
        "book_id", "audio", "audio_ms", "char_offset", F.lit(1.0).alias("confidence"))


def on_visible(offsets: DataFrame, texts: DataFrame) -> DataFrame:
    """Offsets moved past white space: ``offsets(book_id, char_offset)``, ``texts(book_id, text)``."""
    rest = F.expr("substring(text, char_offset + 1)")
    skipped = F.length(F.regexp_extract(rest, "^\\s*", 0))
    return offsets.join(texts, "book_id").withColumn("char_offset", (F.col("char_offset") + skipped).cast("int")).drop("text")


def media(pars: DataFrame) -> DataFrame:
    """Audio files per book in order of first use: ``pars(book_id, ord, audio)``."""
    first = pars.filter("audio is not null").groupBy("book_id", "audio").agg(F.min("ord").alias("first_ord"))
    return P.scan(first, ["book_id"], ["first_ord"], P.slice_of("first_ord", 65_536), {"place": P.row_index()})


def overlay_rows(clips: DataFrame, sentences: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips to (pars, durations per document, navigation).

    ``clips(book_id, idx, begin_ms, end_ms)``; navigation points each chapter at the first sentence of its
    document that ends after the chapter's start.
    """
    c = clips.join(sentences.select("book_id", "idx", "spine_idx"), ["book_id", "idx"])
    pars = c.select("book_id", "spine_idx", "idx", F.concat(F.lit("s"), "idx").alias("fragment"),
                    X.clock_text(F.col("begin_ms")).alias("clip_begin"), X.clock_text(F.col("end_ms")).alias("clip_end"))
    durations = c.groupBy("book_id", "spine_idx").agg(F.sum(F.col("end_ms") - F.col("begin_ms")).alias("duration_ms"))
    ends = sentences.select("book_id", F.col("end").alias("__end"), "idx", "spine_idx")
    nav = P.bracket(chapters.select("book_id", "chapter_idx", "title", "text_start"), ends, ["book_id"], "text_start", "__end", ["idx", "spine_idx"], 1_000)
    return pars, durations, nav.filter("hi is not null").select(
        "book_id", "chapter_idx", "title", F.col("hi.spine_idx").alias("spine_idx"), F.col("hi.idx").alias("sentence_idx"))
