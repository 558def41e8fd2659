"""Files as tables: decoding, sniffing and identity.  Input is ``binaryFile`` rows (path, length, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoline.functions import text as X

# Extensions the library keeps.
AUDIO_EXTENSIONS = "mp3 m4a m4b aac ogg opus flac wav wma".split()
EBOOK_EXTENSIONS = "epub pdf txt".split()
SAMPLE = 1 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def encoding_of(content: Column) -> Column:
    """A byte-order mark decides, else strict UTF-8, else Windows-1250 (which decodes every byte)."""
    head = F.hex(F.substring(content, 1, 3))
    return (F.when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE")
            .when(head == "EFBBBF", "UTF-8-BOM").when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("WINDOWS-1250"))


_UPPER = range(0x80, 0x100)
_CP1250 = "".join(bytes([b]).decode("cp1250", "ignore") or chr(b) for b in _UPPER)


def text_decode(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to (path, text, encoding), one line per paragraph.

    Windows-1250 is read as Latin-1 and its upper half translated; the five bytes it leaves open stay control characters.
    """
    legacy = F.translate(F.decode("content", "ISO-8859-1"), "".join(map(chr, _UPPER)), _CP1250)
    rest2, rest3 = F.expr("substring(content, 3)"), F.expr("substring(content, 4)")
    text = (F.when(F.col("encoding") == "UTF-16LE", F.decode(rest2, "UTF-16LE")).when(F.col("encoding") == "UTF-16BE", F.decode(rest2, "UTF-16BE"))
            .when(F.col("encoding") == "UTF-8-BOM", F.decode(rest3, "UTF-8")).when(F.col("encoding") == "UTF-8", F.col("content").cast("string"))
            .otherwise(legacy))
    return files.withColumn("encoding", encoding_of(F.col("content"))).select("path", X.collapse_blocks(text).alias("text"), "encoding")


def sniffed(content: Column, path: Column) -> Column:
    """Kind of a file by its first bytes; its name's extension only when they say nothing."""
    h = F.hex(F.substring(content, 1, 12))
    second = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    audio = (F.when(F.substring(h, 9, 8) == "66747970", "m4b").when(h.startswith("494433"), "mp3")
             .when(h.startswith("FF") & (second >= 0xE0), "mp3").when(h.startswith("4F676753"), "ogg").when(h.startswith("664C6143"), "flac")
             .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav").when(h.startswith("3026B275"), "wma"))
    book = F.when(h.startswith("504B0304"), "epub").when(h.startswith("25504446"), "pdf")
    extension = F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1))
    return F.coalesce(F.when(F.length(content) >= 12, audio), book, extension)


def format_sniff(files: DataFrame) -> DataFrame:
    """``files(path, length, content)`` with their kind; only kinds the library keeps."""
    f = files.withColumn("kind", sniffed(F.col("content"), F.col("path")))
    return f.filter(F.col("kind").isin(*AUDIO_EXTENSIONS, *EBOOK_EXTENSIONS))


def content_hash(files: DataFrame) -> DataFrame:
    """``digest``: SHA-256 of the whole file, its identity.  ``hash``: the key other stores use, SHA-256 over the length
    (int64, little-endian) and the whole file, or three 1 MiB samples of a large one; never to tell files apart by."""
    n = F.octet_length("content").cast("bigint")
    big_endian = F.lpad(F.hex(n), 16, "0")
    little = F.unhex(F.array_join(F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda i: F.substring(big_endian, i * 2 - 1, F.lit(2))), ""))
    middle = F.expr(f"substring(content, cast((octet_length(content) - {SAMPLE}) div 2 + 1 as int), {SAMPLE})")
    tail = F.expr(f"substring(content, octet_length(content) - {SAMPLE} + 1, {SAMPLE})")
    body = F.when(n <= 3 * SAMPLE, F.col("content")).otherwise(F.concat(F.expr(f"substring(content, 1, {SAMPLE})"), middle, tail))
    return files.withColumn("hash", F.sha2(F.concat(little, body), 256)).withColumn("digest", F.sha2("content", 256))
