"""Registered queries over sources and sinks (survey 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versoline.operators import maps as M
from versoline.plans.registry import query
from versoline.plans.views import Tables, register_sql
from versoline.sources import catalog as C
from versoline.sources import files as S
from versoline.sources import mapstore as Z
from versoline.sources import overlay as O


# Documents as files, in the encodings a folder holds: with blank lines and runs of white space.
def text_files(t: Tables):
    loose = F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n\r\n")), F.lit(", "), F.lit(",  \t"))
    content = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(loose, "UTF-8")))
               .when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(loose, "UTF-16LE")))
               .when(F.col("doc_id") % 8 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(loose, "UTF-16BE")))
               .when(F.col("doc_id") % 8 == 3, F.concat(F.unhex(F.lit("8AE89A20")), F.encode(F.regexp_replace(loose, "[^\\x00-\\x7F]", "?"), "UTF-8")))
               .otherwise(F.encode(loose, "UTF-8")))
    return t.table("documents").select(F.col("doc_id"), F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")).alias("path"), content.alias("content"))


@query("src_text_decode", """SELECT '/in/' || doc_id || '.txt' AS path, CASE doc_id % 4 WHEN 0 THEN 'UTF-8-BOM' WHEN 1 THEN 'UTF-16LE' ELSE CASE doc_id % 8 WHEN 2 THEN 'UTF-16BE' WHEN 3 THEN 'WINDOWS-1250' ELSE 'UTF-8' END END AS encoding,
    array_to_string(list_filter(list_transform(string_split(CASE WHEN doc_id % 8 = 3 THEN 'Ščš ' || regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') ELSE text END, chr(10)), lambda b: trim(regexp_replace(b, '[\\s\\x{85}\\x{A0}\\x{2028}\\x{2029}]+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text FROM documents""")
def _(t: Tables):
    return S.text_decode(text_files(t).drop("doc_id")).select("path", "encoding", "text")


HEADS = ["0000002066747970 4D344220", "494433040000000000000000", "FFFB90000000000000000000", "4F6767530002000000000000", "664C61430000002200000000",
         "524946460000000057415645", "3026B2758E66CF11A6D900AA", "504B03040A00000000000000", "255044462D312E370A000000", "FFF100", "7465787420697320746578742121"]


@query("src_format_sniff", """SELECT l_orderkey * 10 + l_linenumber AS file_id, CASE k WHEN 0 THEN 'm4b' WHEN 1 THEN 'mp3' WHEN 2 THEN 'mp3' WHEN 3 THEN 'ogg' WHEN 4 THEN 'flac' WHEN 5 THEN 'wav' WHEN 6 THEN 'wma' WHEN 7 THEN 'epub' WHEN 8 THEN 'pdf' ELSE e END AS kind
    FROM (SELECT *, l_orderkey * 7 % 11 AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'txt' WHEN l_linenumber % 3 = 1 THEN 'mp3' ELSE 'jpg' END AS e FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE k < 9 OR e <> 'jpg'""")
def _(t: Tables):
    heads = F.array(*[F.unhex(F.lit(h.replace(" ", ""))) for h in HEADS])
    f = t.table("lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("file_id"), F.element_at(heads, F.expr("cast(l_orderkey * 7 % 11 + 1 as int)")).alias("content"),
        F.expr("concat('/in/', l_orderkey, '/', l_linenumber, '.', case when l_linenumber % 3 = 0 then 'TXT' when l_linenumber % 3 = 1 then 'mp3' else 'jpg' end)").alias("path"))
    return S.format_sniff(f).select("file_id", "kind")


@query("src_content_hash", """SELECT sha256(text) AS digest, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY text""")
def _(t: Tables):
    f = t.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.content_hash(f).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))


_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("src_catalog_json", f"""SELECT 'i' || event_id AS item_id, CASE WHEN k % 5 = 0 THEN 'Untitled' ELSE 'T' || k END AS title, CASE WHEN k % 3 = 0 THEN 'A' || k WHEN k % 3 = 1 THEN 'B, C' END AS author,
      CAST(CASE WHEN k % 2 = 0 THEN k ELSE 2 END AS INT) AS audio_files, CASE k % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' END AS ebook_format, value AS duration_s,
      CASE WHEN k % 6 = 0 THEN NULL ELSE 'S ' || (k % 9) END AS series, CASE WHEN k % 6 = 0 THEN NULL ELSE (k / 2.0)::VARCHAR END AS sequence, CASE WHEN k % 6 = 0 THEN NULL ELSE k / 2.0::DOUBLE END AS seq_no,
      CASE WHEN k % 7 <> 0 THEN make_timestamp(event_id * 1000000) END AS added_at FROM (SELECT *, {_K} AS k FROM events) WHERE k % 10 <> 9""")
def _(t: Tables):
    e = t.table("events").select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    raw = e.select(F.expr("""to_json(named_struct('id', case when k % 10 <> 9 then concat('i', event_id) end, 'addedAt', case when k % 7 <> 0 then event_id * 1000 else -1 end,
        'media', named_struct('metadata', named_struct('title', case when k % 5 <> 0 then concat('T', k) end, 'authorName', case when k % 3 = 0 then concat('A', k) end,
          'authors', case when k % 3 = 1 then array(named_struct('name', 'B'), named_struct('name', 'C')) end, 'seriesName', case when k % 6 <> 0 then concat('S ', k % 9, ' #', cast(k / 2.0D as string), ', Other #3') end),
          'numAudioFiles', case when k % 2 = 0 then k end, 'audioFiles', array(named_struct('ino', 'a', 'duration', 1.5D), named_struct('ino', null, 'duration', 2.5D)), 'duration', value,
          'ebookFormat', case when k % 4 = 0 then 'epub' end, 'ebookFileFormat', case when k % 4 = 1 then 'pdf' end, 'ebookFile', case when k % 4 = 2 then named_struct('ino', 'e', 'metadata', named_struct('ext', '.txt')) end)))""").alias("raw"))
    c = C.catalog(raw, "raw")
    return c.withColumn("added_at", F.col("added_at").cast("timestamp_ntz"))


# Overlay rows written from the timeline: one par per event, clocks in all the forms they come in.
CLOCK = """CASE event_id % 6 WHEN 0 THEN {cat}(s, 'ms') WHEN 1 THEN {cat}({dec}, 's') WHEN 2 THEN {cat}({h}, ':', {mm}, ':', {ss}, '.5') WHEN 3 THEN {cat}({m}, ':', {ss}, '.25') WHEN 4 THEN {cat}({m}, 'min') ELSE {cat}(' ', {sec}, ' ') END"""
_SPARK_CLOCK = CLOCK.format(cat="concat", dec="cast(s / 1000.0D as decimal(12, 3))", h="s div 3600000", mm="lpad(s div 60000 % 60, 2, '0')", ss="lpad(s div 1000 % 60, 2, '0')", m="s div 60000", sec="s div 1000")


@query("src_overlay_xml", """SELECT book_id, 'OEBPS/audio/a' || (book_id % 3) || '.mp3' AS audio, CAST(CASE event_id % 6 WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s // 1000 * 1000 + 500 WHEN 3 THEN s // 1000 * 1000 + 250 WHEN 4 THEN s // 60000 * 60000 ELSE s // 1000 * 1000 END AS BIGINT) AS audio_ms,
    CAST(s * 15 // 1000 AS INT) AS char_offset, 1.0::DOUBLE AS confidence FROM ev WHERE event_id % 11 <> 0""", ["ev"])
def _(t: Tables):
    pars = t.ev.select(
        "book_id", F.lit("OEBPS/smil/c1.smil").alias("smil"), F.concat(F.lit("../text/./ch%20"), F.col("book_id") % 4, F.lit(".xhtml#e"), "event_id").alias("text_src"),
        F.concat(F.lit("../audio/a"), F.col("book_id") % 3, F.lit(".mp3")).alias("audio_src"),
        F.expr(f"case when event_id % 11 = 0 then 'soon' else {_SPARK_CLOCK} end").alias("clip_begin"))
    ids = t.ev.select("book_id", F.concat(F.lit("OEBPS/text/ch "), F.col("book_id") % 4, F.lit(".xhtml")).alias("entry"), F.concat(F.lit("e"), "event_id").alias("fragment"),
                      F.expr("cast(s * 15 div 1000 as int)").alias("char_offset"))
    return O.anchors(pars, ids)


@query("src_media_columns", """SELECT book_id, audio, first_ord, row_number() OVER (PARTITION BY book_id ORDER BY first_ord) - 1 AS place FROM (
    SELECT book_id, 'a' || (event_id * 7 % 13) || '.mp3' AS audio, min(event_id) AS first_ord FROM ev GROUP BY 1, 2)""", ["ev"])
def _(t: Tables):
    return O.media(t.ev.select("book_id", F.col("event_id").alias("ord"), F.expr("concat('a', event_id * 7 % 13, '.mp3')").alias("audio")))


@query("sink_overlay_rows", """SELECT c.book_id, s.spine_idx, c.idx, 's' || c.idx AS fragment,
    (begin_ms // 3600000) || ':' || lpad((begin_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((begin_ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((begin_ms % 1000)::VARCHAR, 3, '0') AS clip_begin,
    (end_ms // 3600000) || ':' || lpad((end_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((end_ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((end_ms % 1000)::VARCHAR, 3, '0') AS clip_end,
    CAST(sum(end_ms - begin_ms) OVER (PARTITION BY c.book_id, s.spine_idx) AS BIGINT) AS duration_ms FROM sent_times c JOIN sentences s ON s.book_id = c.book_id AND s.idx = c.idx""", ["sent_times", "sentences"])
def _(t: Tables):
    from versoline.operators import primitives as P

    clips = P.stage(M.sentence_times(t.sentences, t.maps))
    pars, durations, _ = O.overlay_rows(clips, t.sentences, t.chapters)
    return pars.join(durations, ["book_id", "spine_idx"])


@query("sink_overlay_nav", """SELECT c.book_id, c.chapter_idx, c.title, s.spine_idx, s.idx AS sentence_idx FROM chapters c ASOF JOIN sentences s ON s.book_id = c.book_id AND c.text_start < s."end" """, ["chapters", "sentences"])
def _(t: Tables):
    return O.overlay_rows(t.sentences.select("book_id", "idx", F.lit(0).alias("begin_ms"), F.lit(1).alias("end_ms")), t.sentences, t.chapters)[2]


def _titled(t: Tables):
    return t.timeline_books.select("book_id", F.concat(F.lit("Book "), "book_id").alias("title"), F.sha2(F.concat(F.lit("a"), "book_id"), 256).alias("audio_hash"),
                                   F.sha2(F.concat(F.lit("e"), "book_id"), 256).alias("ebook_hash"))


@query("sink_alignment_export", """SELECT 'Book ' || m.book_id AS title, sha256('a' || m.book_id) AS audio_hash, sha256('e' || m.book_id) AS ebook_hash, m.chapter_idx, c.text_start, c.text_end, m.audio_ms, m.char_offset, m.confidence
    FROM maps m JOIN chapters c USING (book_id, chapter_idx)""", ["maps", "chapters"])
def _(t: Tables):
    return Z.unpacked(Z.packages(t.maps, t.chapters, _titled(t)))


@query("sink_map_store", "SELECT book_id, chapter_idx, audio_ms, char_offset, confidence FROM maps", ["maps"])
def _(t: Tables):
    from versoline.session import ensure_checkpoint_dir
    import uuid

    path = f"{ensure_checkpoint_dir(t.spark)}/maps-{uuid.uuid4().hex}"
    Z.save(t.maps.drop("event_id"), path)
    Z.save(t.maps.drop("event_id").filter("book_id % 3 = 0"), path)  # a third of the books again
    return Z.stored(t.spark, path)
