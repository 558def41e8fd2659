"""Storing maps, and carrying them elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoline.operators import anchors as A
from versoline.operators import primitives as P
from versoline.sources import versions

ANCHORS = "book_id bigint, chapter_idx int, audio_ms bigint, char_offset int, confidence double"


def save(anchors: DataFrame, path: str) -> None:
    """Replace the stored maps of these books; those of other books stay."""
    versions.append(anchors, path, ANCHORS, lambda rows: versions.latest(rows, "book_id"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The anchors as they were saved, whatever their confidence; None when there is no store."""
    rows = versions.stored(spark, path, ANCHORS)
    return None if rows is None else versions.latest(rows, "book_id")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored maps, made consistent again; None when there is no store."""
    rows = stored(spark, path)
    return None if rows is None else A.consistent_run(rows)


PACKAGE = (
    "title string, audio_hash string, ebook_hash string, version int, chapter_idx int, text_start int, text_end int, "
    "anchors array<struct<audio_ms: bigint, char_offset: int, confidence: double>>")


def packages(anchors: DataFrame, chapters: DataFrame, books: DataFrame, slice_ms: int = 600_000) -> DataFrame:
    """Portable packages as JSON lines, each a bounded slice of one chapter's map.

    A book is many lines, not one document: no row holds more than ``slice_ms`` of a map.
    """
    sliced = anchors.groupBy("book_id", "chapter_idx", P.slice_of("audio_ms", slice_ms).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("audio_ms", "char_offset", "confidence"))).alias("anchors"))
    j = sliced.join(chapters.select("book_id", "chapter_idx", "text_start", "text_end"), ["book_id", "chapter_idx"], "left").join(
        books.select("book_id", "title", "audio_hash", "ebook_hash"), "book_id")
    fields = ["title", "audio_hash", "ebook_hash", F.lit(2).alias("version"), "chapter_idx", "text_start", "text_end", "anchors"]
    return j.select("book_id", F.to_json(F.struct(*fields)).alias("value"))


def export(anchors: DataFrame, chapters: DataFrame, books: DataFrame, path: str) -> None:
    packages(anchors, chapters, books).select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def unpacked(lines: DataFrame) -> DataFrame:
    """Anchors out of package lines; a line that is not a package of this version gives nothing."""
    p = lines.select(F.from_json("value", PACKAGE).alias("p")).filter("p.version = 2 and p.audio_hash is not null and p.ebook_hash is not null")
    return p.select("p.title", "p.audio_hash", "p.ebook_hash", "p.chapter_idx", "p.text_start", "p.text_end", F.explode("p.anchors").alias("a")).select(
        "title", "audio_hash", "ebook_hash", "chapter_idx", "text_start", "text_end", "a.*")


def import_packages(spark: SparkSession, path: str) -> DataFrame:
    return unpacked(spark.read.text(path))
