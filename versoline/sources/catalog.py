"""Server catalogues: nested wire JSON to a flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.operators.texts import series_split

WIRE = (
    "id string, addedAt bigint, media struct<"
    "metadata: struct<title: string, authorName: string, authors: array<struct<name: string>>, seriesName: string>, "
    "numAudioFiles: int, audioFiles: array<struct<ino: string, duration: double>>, duration: double, "
    "ebookFormat: string, ebookFileFormat: string, ebookFile: struct<ino: string, metadata: struct<ext: string>>>")


def catalog(raw: DataFrame, json_col: str, untitled: str = "Untitled") -> DataFrame:
    """Items with an id; a column missing on the wire is null, never an error."""
    j = raw.select(F.from_json(json_col, WIRE).alias("i")).filter("i.id is not null")
    m, d = F.col("i.media"), F.col("i.media.metadata")
    names = F.array_join(F.filter(F.transform(d["authors"], lambda a: a["name"]), lambda n: n.isNotNull()), ", ")
    flat = j.select(
        F.col("i.id").alias("item_id"), F.coalesce(d["title"], F.lit(untitled)).alias("title"),
        F.coalesce(d["authorName"], F.nullif(names, F.lit(""))).alias("author"),
        F.coalesce(m["numAudioFiles"], F.size(m["audioFiles"]), F.lit(0)).alias("audio_files"),
        F.coalesce(m["ebookFormat"], m["ebookFileFormat"], F.ltrim(m["ebookFile"]["metadata"]["ext"], F.lit("."))).alias("ebook_format"),
        F.coalesce(m["duration"], F.lit(0.0)).alias("duration_s"), d["seriesName"].alias("series_name"),
        F.when(F.col("i.addedAt") > 0, F.timestamp_millis("i.addedAt")).alias("added_at"))
    return series_split(flat, "series_name").drop("series_name")


def catalog_files(raw: DataFrame, json_col: str) -> DataFrame:
    """Audio files of the items; a file without a handle cannot be fetched and is left out."""
    j = raw.select(F.from_json(json_col, WIRE).alias("i")).filter("i.id is not null")
    f = j.select(F.col("i.id").alias("item_id"), F.posexplode("i.media.audioFiles").alias("ord", "f"))
    return f.filter("f.ino is not null").select("item_id", "ord", "f.ino", F.coalesce("f.duration", F.lit(0.0)).alias("duration_s"))
