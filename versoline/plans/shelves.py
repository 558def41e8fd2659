"""Registered queries over the library's tables (survey 2.2, 2.8 and 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import incremental as I
from versoline.operators import library as L
from versoline.operators import maps as M
from versoline.operators import texts as T
from versoline.operators import tokens as K
from versoline.plans.registry import query
from versoline.plans.texts import SQL_WORDS
from versoline.plans.views import Tables, register_sql

register_sql("flags", ["books"], """SELECT *, coalesce(audio_path <> '', false) AS has_audio, coalesce(ebook_path <> '', false) AS has_text,
    coalesce(audio_path <> '', false) AND coalesce(ebook_path <> '', false) AS is_paired FROM books""")


@query("flt_media_flags", """SELECT book_id, has_audio, has_text, is_paired, is_paired AND sync_state IN ('Partial', 'Complete') AS has_usable_sync FROM flags""", ["flags"])
def _(t: Tables):
    return L.media_flags(t.books).select("book_id", "has_audio", "has_text", "is_paired", "has_usable_sync")


@query("flt_speech", f"""SELECT book_id, seg_id, start_ms, end_ms, no_speech FROM segments
    WHERE end_ms >= start_ms AND no_speech < 0.6 AND len({SQL_WORDS.format('text')}) > 0""", ["segments"])
def _(t: Tables):
    return L.speech(t.segments).select("book_id", "seg_id", "start_ms", "end_ms", "no_speech")


@query("flt_word_times_valid", """SELECT book_id, seg_id, word_idx, value, least(greatest(t_at, start_ms), end_ms) AS at_ms FROM (
    SELECT w.*, s.start_ms, s.end_ms, bool_or(t_at < s.start_ms - 1000 OR t_at > s.end_ms + 1000) OVER (PARTITION BY book_id, seg_id) AS bad
    FROM (SELECT *, at_ms + (word_idx * 97 + book_id * 31 + seg_id * 7) % 41 * 60 - 400 AS t_at FROM spread) w JOIN segments s USING (book_id, seg_id)) WHERE NOT bad""", ["spread", "segments"])
def _(t: Tables):
    jitter = F.expr("at_ms + (word_idx * 97 + book_id * 31 + seg_id * 7) % 41 * 60 - 400")
    w = K.spread_even(t.segments, ["book_id", "seg_id"]).withColumn("at_ms", jitter)
    return L.word_times_valid(t.segments, w, ["book_id", "seg_id"]).select("book_id", "seg_id", "word_idx", "value", "at_ms")


@query("flt_time_of_day", """SELECT event_id, ts, CAST(CASE WHEN 21600 - d > 0 THEN 21600 - d ELSE 21600 - d + 86400 END AS INT) AS remaining_s
    FROM (SELECT event_id, ts, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS d FROM events) WHERE d >= 81000 OR d < 21600""")
def _(t: Tables):
    return L.time_of_day(t.table("events").select("event_id", "ts"), "ts", 81_000, 21_600)


@query("flt_page_number", """SELECT doc_id, line, text FROM short WHERE NOT regexp_matches(
    regexp_replace(regexp_replace(text, '^[-–— .|\\s]+', ''), '[-–— .|\\s]+$', ''), '^([0-9]{1,8}|[ivxlcdmIVXLCDM]{1,8})$')""", ["short"])
def _(t: Tables):
    return short(t).filter(~T.is_page_number(F.col("text")))


# Words of the lines that could be taken for page numbers, between dashes.
register_sql("short", ["lines"], """SELECT doc_id, line, '- ' || CASE WHEN line % 3 = 0 THEN CAST(doc_id * 31 + line AS VARCHAR) ELSE split_part(text, ' ', 1) END || ' .' AS text FROM lines""")


def short(t: Tables):
    return t.lines.select("doc_id", "line", F.expr("concat('- ', case when line % 3 = 0 then cast(doc_id * 31 + line as string) else split_part(text, ' ', 1) end, ' .')").alias("text"))


register_sql("states", ["books"], "SELECT book_id, duration_ms * (book_id % 21) // 19 AS audio_ms FROM books WHERE book_id % 4 <> 3")


@query("prj_progress", """SELECT book_id, p AS progress, p > 0.001 AS shown, p >= 0.99 AS finished FROM (
    SELECT book_id, CASE WHEN duration_ms > 0 THEN least(greatest(CAST(coalesce(audio_ms, 0) AS DOUBLE) / duration_ms, 0.0), 1.0) ELSE 0.0 END::DOUBLE AS p
    FROM books LEFT JOIN states USING (book_id))""", ["books", "states"])
def _(t: Tables):
    return L.progress(t.books, t.books.filter("book_id % 4 <> 3").select("book_id", F.expr("duration_ms * (book_id % 21) div 19").alias("audio_ms")))


@query("prj_cost_estimate", """SELECT book_id, preset, round(duration_ms * (10000.0::DOUBLE / 60000) / rtf / duty, 3) AS ms FROM books,
    (VALUES ('eco', 0.25::DOUBLE, 2.0::DOUBLE), ('balanced', 0.5, 4.0), ('turbo', 1.0, 8.0)) p(preset, duty, rtf)""", ["books"])
def _(t: Tables):
    return L.cost_estimate(t.books).withColumn("ms", F.round("ms", 3))


SETTINGS = """CASE book_id % 5 WHEN 0 THEN 'light' WHEN 1 THEN 'best' WHEN 2 THEN 'loud' END AS quality,
    CASE book_id % 7 WHEN 0 THEN 'dense' WHEN 1 THEN '45s' WHEN 2 THEN '3' WHEN 3 THEN ' Sparse ' END AS anchors,
    CASE WHEN book_id % 11 = 0 THEN 'small' END AS model"""


@query("prj_recipe", f"""SELECT book_id, CASE WHEN q = 'best' THEN 'best' ELSE q || ', ' || m || ', ' || (iv // 1000) || ' s' END AS recipe, least(pr, iv) AS probe_ms, iv AS interval_ms FROM (
    SELECT book_id, q, coalesce(model, CASE WHEN q = 'light' THEN 'tiny' ELSE 'base' END) AS m, CAST(CASE WHEN q = 'light' THEN 10000 ELSE 15000 END AS INT) AS pr,
      CAST(coalesce(CASE lower(trim(anchors)) WHEN 'sparse' THEN 60 WHEN 'medium' THEN 30 WHEN 'dense' THEN 15
        ELSE CASE WHEN try_cast(rtrim(lower(trim(anchors)), 's') AS INT) BETWEEN 5 AND 600 THEN try_cast(rtrim(lower(trim(anchors)), 's') AS INT) END END * 1000,
        CASE WHEN q = 'light' THEN 60000 ELSE 30000 END) AS INT) AS iv
    FROM (SELECT *, CASE WHEN quality IN ('light', 'better', 'best') THEN quality ELSE 'better' END AS q FROM (SELECT book_id, {SETTINGS} FROM books)))""", ["books"])
def _(t: Tables):
    return L.recipe(t.books.selectExpr("book_id", *[s.strip() for s in SETTINGS.split(",\n")]))


@query("prj_excerpt", """SELECT doc_id, at_char, trim(replace(substr(text, least(greatest(at_char, 0), greatest(length(text) - 1, 0)) + 1, 90), chr(10), ' ')) AS excerpt
    FROM (SELECT doc_id, text, CAST(doc_id * 7919 % 900 - 20 AS INT) AS at_char FROM documents)""")
def _(t: Tables):
    at = F.expr("cast(doc_id * 7919 % 900 - 20 as int)")
    return t.table("documents").select("doc_id", at.alias("at_char"), X.excerpt(F.col("text"), at, 90).alias("excerpt"))


_KEY = "lower(trim(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')))"
_STEM = "regexp_replace(regexp_replace(regexp_extract({0}, '([^/:]*)$', 1), '\\.[^.]*$', ''), ' \\([0-9]+\\)$', '')"
register_sql("names", ["books"], f"""SELECT DISTINCT book_id, k AS name_key FROM (
    SELECT book_id, {_KEY.format("regexp_replace(source_name, '\\.[^.]*$', '')")} AS k FROM books
    UNION ALL SELECT book_id, {_KEY.format(_STEM.format('audio_path'))} FROM books
    UNION ALL SELECT book_id, {_KEY.format(_STEM.format("replace(replace(original_audio_path, '%3A', ':'), '%20', ' ')"))} FROM books
    UNION ALL SELECT book_id, {_KEY.format(_STEM.format('ebook_path'))} FROM books) WHERE k IS NOT NULL""")


@query("set_names_union", "SELECT * FROM names", ["names"])
def _(t: Tables):
    return L.names_union(t.books)


register_sql("new_files", [], """SELECT l_orderkey * 10 + l_linenumber AS file_id, 'book_' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '.m4b' ELSE '.epub' END AS file_name, l_linenumber % 2 = 0 AS is_audio
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")


def new_files(t: Tables):
    return t.table("lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("file_id"),
        F.expr("concat('book_', l_orderkey, case when l_linenumber % 2 = 0 then '.m4b' else '.epub' end)").alias("file_name"),
        F.expr("l_linenumber % 2 = 0").alias("is_audio"))


@query("join_find_partner", f"""SELECT file_id, file_name, is_audio, min(book_id) AS book_id FROM new_files f
    JOIN (SELECT n.book_id, n.name_key, b.has_audio FROM names n JOIN flags b USING (book_id) WHERE b.has_audio <> b.has_text) c
      ON c.name_key = {_KEY.format("regexp_replace(file_name, '\\.[^.]*$', '')")} AND c.has_audio <> f.is_audio
    GROUP BY 1, 2, 3 HAVING count(DISTINCT book_id) = 1""", ["new_files", "names", "flags"])
def _(t: Tables):
    return L.find_partner(new_files(t), t.books)


register_sql("map_versions", ["books"], """SELECT book_id + 1000000 AS map_id, CAST(CASE WHEN book_id % 6 = 0 THEN 1 ELSE 2 END AS INT) AS version, audio_hash, ebook_hash FROM books WHERE book_id % 3 <> 2""")


def map_versions(t: Tables):
    return t.books.filter("book_id % 3 <> 2").select((F.col("book_id") + 1_000_000).alias("map_id"), F.expr("case when book_id % 6 = 0 then 1 else 2 end").alias("version"), "audio_hash", "ebook_hash")


@query("join_by_pair_hash", """SELECT m.audio_hash, m.ebook_hash, m.map_id, m.version, b.book_id FROM map_versions m JOIN books b
    ON b.audio_hash = m.audio_hash AND b.ebook_hash = m.ebook_hash WHERE m.version = 2""", ["map_versions", "books"])
def _(t: Tables):
    return L.by_pair_hash(map_versions(t), t.books)


# Chapters of library books and the ranges another device offers for them.
register_sql("lib_chapters", [], """SELECT l_orderkey AS book_id, CAST(l_linenumber - 1 AS INT) AS chapter_idx, min('Part ' || l_partkey) AS title,
    CAST(l_linenumber - 1 AS BIGINT) * 600000 AS start_ms, CAST(l_linenumber AS BIGINT) * 600000 AS end_ms,
    CASE WHEN min(l_partkey) % 3 = 0 THEN CAST((l_linenumber - 1) * 9000 AS INT) END AS text_start, CASE WHEN min(l_partkey) % 3 = 0 THEN CAST(l_linenumber * 9000 AS INT) END AS text_end
    FROM lineitem GROUP BY l_orderkey, l_linenumber""")
register_sql("offered", ["lib_chapters"], """SELECT book_id, chapter_idx, CASE WHEN (book_id + chapter_idx) % 4 <> 0 THEN chapter_idx * 8000 + 1 END AS text_start,
    CASE WHEN (book_id + chapter_idx) % 5 <> 0 THEN chapter_idx * 8000 + 8001 END AS text_end FROM lib_chapters WHERE NOT (book_id % 3 = 0 AND chapter_idx = 2)""")


def lib_chapters(t: Tables):
    g = t.table("lineitem").groupBy(F.col("l_orderkey").alias("book_id"), "l_linenumber").agg(
        F.min(F.concat(F.lit("Part "), "l_partkey")).alias("title"), F.min("l_partkey").alias("p"))
    tagged = F.col("p") % 3 == 0
    return g.select(
        "book_id", (F.col("l_linenumber") - 1).cast("int").alias("chapter_idx"), "title",
        ((F.col("l_linenumber") - 1).cast("bigint") * 600_000).alias("start_ms"), (F.col("l_linenumber").cast("bigint") * 600_000).alias("end_ms"),
        F.when(tagged, ((F.col("l_linenumber") - 1) * 9000).cast("int")).alias("text_start"), F.when(tagged, (F.col("l_linenumber") * 9000).cast("int")).alias("text_end"))


def offered(t: Tables):
    return lib_chapters(t).filter("not (book_id % 3 = 0 and chapter_idx = 2)").selectExpr(
        "book_id", "chapter_idx", "case when (book_id + chapter_idx) % 4 <> 0 then chapter_idx * 8000 + 1 end as text_start",
        "case when (book_id + chapter_idx) % 5 <> 0 then chapter_idx * 8000 + 8001 end as text_end")


@query("join_adopt_ranges", """SELECT c.* EXCLUDE (text_start, text_end), CASE WHEN o.text_start IS NOT NULL AND o.text_end IS NOT NULL THEN o.text_start ELSE c.text_start END AS text_start,
    CASE WHEN o.text_start IS NOT NULL AND o.text_end IS NOT NULL THEN o.text_end ELSE c.text_end END AS text_end FROM lib_chapters c
    LEFT JOIN (SELECT * FROM offered WHERE book_id IN (SELECT book_id FROM (SELECT book_id, count(*) AS n FROM offered GROUP BY 1) JOIN (SELECT book_id, count(*) AS n FROM lib_chapters GROUP BY 1) USING (book_id, n))) o
    ON o.book_id = c.book_id AND o.chapter_idx = c.chapter_idx""", ["lib_chapters", "offered"])
def _(t: Tables):
    return L.adopt_ranges(offered(t), lib_chapters(t))


@query("join_carry_ranges", """SELECT o.book_id, o.chapter_idx, coalesce(o.text_start, c.text_start) AS text_start, coalesce(o.text_end, c.text_end) AS text_end
    FROM offered o LEFT JOIN lib_chapters c USING (book_id, chapter_idx)""", ["offered", "lib_chapters"])
def _(t: Tables):
    return L.carry_ranges(offered(t), lib_chapters(t)).select("book_id", "chapter_idx", "text_start", "text_end")


register_sql("paths", [], """SELECT DISTINCT '/store/audio/Book_' || l_orderkey || ' (' || (l_suppkey % 4) || ').m4b' AS path FROM lineitem""")


@query("join_media_path", """SELECT path, min(book_id) AS book_id FROM paths p LEFT JOIN books b ON p.path = b.audio_path OR p.path = b.original_audio_path OR p.path = b.ebook_path GROUP BY 1""".replace("p LEFT JOIN books b ON p.path = b.audio_path OR p.path = b.original_audio_path OR p.path = b.ebook_path", "LEFT JOIN (SELECT book_id, unnest([audio_path, original_audio_path, ebook_path]) AS path FROM books) USING (path)"), ["paths", "books"])
def _(t: Tables):
    paths = t.table("lineitem").select(F.expr("concat('/store/audio/Book_', l_orderkey, ' (', l_suppkey % 4, ').m4b')").alias("path")).distinct()
    return L.media_path(paths, t.books)


register_sql("catalogue", [], """SELECT l_orderkey * 10 + l_linenumber AS row_id, 'it' || l_orderkey AS item_id, 'srv' || (l_suppkey % 3) AS server_id FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)""")


@query("join_server_item", """SELECT c.item_id, c.server_id, c.row_id, b.book_id FROM catalogue c LEFT JOIN books b ON b.server_item_id = c.item_id AND coalesce(b.server_id, 'srv1') = c.server_id""", ["catalogue", "books"])
def _(t: Tables):
    c = t.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s")).select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("row_id"), F.expr("concat('it', l_orderkey)").alias("item_id"), F.expr("concat('srv', s % 3)").alias("server_id"))
    return L.server_item(c, t.books, "srv1")


register_sql("stored", [], """SELECT '/store/audio/Book_' || l_orderkey || ' (' || (l_linenumber % 4) || ').m4b' AS path, CAST(sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS size, max(l_partkey) AS mtime FROM lineitem GROUP BY 1""")


@query("join_orphan_files", """SELECT path, size, mtime FROM stored WHERE 2000 - mtime >= 500 AND path NOT IN (SELECT audio_path FROM books WHERE audio_path IS NOT NULL)""", ["stored", "books"])
def _(t: Tables):
    files = t.table("lineitem").groupBy(F.expr("concat('/store/audio/Book_', l_orderkey, ' (', l_linenumber % 4, ').m4b')").alias("path")).agg(
        F.sum(F.expr("cast(l_extendedprice as bigint)")).alias("size"), F.max("l_partkey").alias("mtime"))
    return L.orphan_files(files, t.books, F.lit(2000), 500)


@query("join_cascade_delete", """SELECT 'chapters' AS child, count(*) AS left_over FROM lib_chapters WHERE book_id NOT IN (SELECT book_id FROM books WHERE author LIKE '%7')
    UNION ALL SELECT 'states', count(*) FROM states WHERE book_id NOT IN (SELECT book_id FROM books WHERE author LIKE '%7')""", ["lib_chapters", "states", "books"])
def _(t: Tables):
    deleted = t.books.filter("author like '%7'")
    chapters, states = L.cascade_delete(deleted, lib_chapters(t), t.books.filter("book_id % 4 <> 3").select("book_id"))
    return chapters.groupBy(F.lit("chapters").alias("child")).agg(F.count("*").alias("left_over")).unionByName(
        states.groupBy(F.lit("states").alias("child")).agg(F.count("*").alias("left_over")))


register_sql("ebooks_in", ["files"], """SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM files WHERE path LIKE '%.epub'""")
register_sql("audio_in", ["files"], """SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM files WHERE path LIKE '%.mp3'""")
register_sql("sound", ["ebooks_in", "audio_in"], f"""SELECT folder, '' AS disc, path, name, {_KEY.format("regexp_replace(name, '\\.[^.]*$', '')")} AS k FROM audio_in WHERE folder IN (SELECT folder FROM ebooks_in)
    UNION ALL SELECT parent, folder, path, name, {_KEY.format("regexp_replace(name, '\\.[^.]*$', '')")} FROM (SELECT *, regexp_extract(folder, '^(.*)/[^/]*$', 1) AS parent FROM audio_in)
    WHERE parent IN (SELECT folder FROM ebooks_in) AND parent NOT IN (SELECT folder FROM audio_in) AND folder NOT IN (SELECT folder FROM ebooks_in)""")
register_sql("found", ["ebooks_in", "sound"], f"""
    SELECT folder, min(path) AS ebook, NULL::VARCHAR AS own, NULL::VARCHAR AS problem FROM ebooks_in WHERE folder IN (SELECT folder FROM sound) GROUP BY folder HAVING count(*) = 1
    UNION ALL SELECT e.folder, e.path, s.p, NULL FROM ebooks_in e JOIN (SELECT folder, k, min(path) AS p FROM sound GROUP BY 1, 2 HAVING count(*) = 1) s
      ON s.folder = e.folder AND s.k = {_KEY.format("regexp_replace(e.name, '\\.[^.]*$', '')")} WHERE e.folder IN (SELECT folder FROM ebooks_in GROUP BY 1 HAVING count(*) > 1)""")
register_sql("all_found", ["found"], """SELECT * FROM found UNION ALL
    SELECT folder, NULL, NULL, count(*) || ' ebooks in one folder and none is named like the audio' FROM ebooks_in
    WHERE folder IN (SELECT folder FROM sound) AND folder NOT IN (SELECT folder FROM found) GROUP BY folder HAVING count(*) > 1""")
register_sql("keyed", ["all_found"], """SELECT *, coalesce(ebook, folder || '/' || regexp_extract(folder, '([^/]*)$', 1) || '.epub') AS key FROM all_found""")


_NK = """list_transform(regexp_extract_all({0}, '[0-9]+|[^0-9]'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN {{'c': '0', 'n': length(ltrim(p, '0')), 'd': ltrim(p, '0')}} ELSE {{'c': upper(p), 'n': 0, 'd': ''}} END)"""


@query("join_folder_pairing", f"""SELECT k.key, k.folder, k.ebook, k.problem, count(*) AS audio_files, first(s.path ORDER BY {_NK.format('s.disc')}, {_NK.format('s.name')}, s.path) AS first_path,
    last(s.path ORDER BY {_NK.format('s.disc')}, {_NK.format('s.name')}, s.path) AS last_path
    FROM keyed k JOIN sound s ON s.folder = k.folder AND (k.own IS NULL OR k.own = s.path) GROUP BY 1, 2, 3, 4""", ["keyed", "sound"])
def _(t: Tables):
    books, parts = I.folder_pairing(t.files)
    return books.select("key", "folder", "ebook", "problem").join(parts.groupBy("key").agg(F.count("*").alias("audio_files"), F.min("place")["p"].alias("first_path"), F.max("place")["p"].alias("last_path")), "key")


@query("inc_fingerprint", f"""SELECT key, left(upper(sha256(string_agg(line, '' ORDER BY side, dk, nk, path))), 16) AS fingerprint FROM (
    SELECT k.key, 0 AS side, NULL AS dk, NULL AS nk, f.path, regexp_extract(f.path, '([^/]*)$', 1) || '|' || f.size || '|' || f.mtime || chr(10) AS line FROM keyed k JOIN files f ON f.path = k.ebook
    UNION ALL SELECT k.key, 1, {_NK.format('s.disc')}, {_NK.format('s.name')}, s.path, s.name || '|' || f.size || '|' || f.mtime || chr(10)
    FROM keyed k JOIN sound s ON s.folder = k.folder AND (k.own IS NULL OR k.own = s.path) JOIN files f ON f.path = s.path) GROUP BY 1""", ["keyed", "sound", "files"])
def _(t: Tables):
    books, parts = I.folder_pairing(t.files)
    return I.fingerprint(books, parts)


FOUND = """CAST(book_id AS {s}) AS key, {md5}(CAST(book_id % 1000 AS {s})) AS fingerprint, CASE WHEN book_id % 2 = 0 THEN 'light, tiny, 60 s' ELSE 'best' END AS recipe, book_id % 13 = 0 AS own_recipe,
    book_id % 17 = 0 AS skip, CASE WHEN book_id % 19 = 0 THEN 'two ebooks' END AS problem, book_id % 3 = 0 AS output_exists"""
STATE = """CAST(book_id AS {s}) AS key, CASE book_id % 4 WHEN 0 THEN 'Done' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Working' ELSE 'Waiting' END AS status,
    {md5}(CAST(book_id % (1000 + book_id % 2) AS {s})) AS fingerprint, CASE WHEN book_id % 5 = 0 THEN 'best' ELSE 'light, tiny, 60 s' END AS recipe"""
register_sql("planned", ["books"], f"""SELECT key, action, CASE WHEN action IN ('gone', 'skip', 'nothing') THEN ss WHEN action = 'problem' THEN 'Failed' WHEN action = 'already made' THEN 'Done' WHEN changed THEN 'Waiting' ELSE ss END AS status,
      CASE WHEN rw THEN fingerprint ELSE sf END AS fingerprint, CASE WHEN rw THEN recipe ELSE sr END AS recipe, CASE WHEN action = 'problem' THEN problem END AS error FROM (
    SELECT *, action IN ('problem', 'already made') OR (action = 'work' AND changed) AS rw FROM (
      SELECT *, CASE WHEN skip IS NULL THEN 'gone' WHEN skip THEN 'skip' WHEN problem IS NOT NULL THEN 'problem' WHEN ss IS NULL AND output_exists THEN 'already made'
        WHEN NOT changed AND ss IN ('Done', 'Failed') THEN 'nothing' ELSE 'work' END AS action FROM (
        SELECT *, ss IS NULL OR sf <> fingerprint OR (sr <> recipe AND (ss <> 'Done' OR own_recipe)) AS changed FROM
          (SELECT {FOUND.format(s='VARCHAR', md5='md5')} FROM books WHERE book_id % 9 <> 0) f
          FULL JOIN (SELECT key, status AS ss, fingerprint AS sf, recipe AS sr FROM (SELECT {STATE.format(s='VARCHAR', md5='md5')} FROM books WHERE book_id % 10 <> 0)) s USING (key))))""")


def planned(t: Tables):
    t.books.createOrReplaceTempView("versoline_books")
    found = t.spark.sql(f"SELECT {FOUND.format(s='STRING', md5='md5')} FROM versoline_books WHERE book_id % 9 <> 0")
    state = t.spark.sql(f"SELECT {STATE.format(s='STRING', md5='md5')} FROM versoline_books WHERE book_id % 10 <> 0")
    return I.plan(found, state)


@query("inc_plan", "SELECT * FROM planned", ["planned"])
def _(t: Tables):
    return planned(t)


@query("inc_queue_order", "SELECT * FROM planned WHERE action = 'work' ORDER BY status <> 'Working', key", ["planned"])
def _(t: Tables):
    return I.queue_order(planned(t))


@query("inc_dedup_content", """SELECT doc_id, content, keep_id, copies FROM (SELECT doc_id, sha256(text) AS content, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies FROM documents)""")
def _(t: Tables):
    return I.dedup_content(t.table("documents").select("doc_id", F.sha2("text", 256).alias("content")), ["content"], "doc_id")


register_sql("chapter_maps", ["books"], """SELECT book_id, CAST(i AS INT) AS chapter_idx, CAST(CASE WHEN book_id % 23 = 0 THEN 1 ELSE 2 END AS INT) AS version, CASE WHEN book_id % 29 = 0 THEN 'old' ELSE audio_hash END AS audio_hash, ebook_hash FROM (SELECT *, unnest(generate_series(0, book_id % 6)) AS i FROM books) WHERE (book_id + i) % 5 <> 0""")


@query("lib_sync_state", """WITH own AS (SELECT DISTINCT b.book_id, m.chapter_idx FROM chapter_maps m JOIN books b USING (book_id, audio_hash, ebook_hash) WHERE version = 2),
    reach AS (SELECT book_id, max(CASE WHEN place = chapter_idx THEN chapter_idx END) AS r FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) - 1 AS place FROM own) GROUP BY 1)
    SELECT f.book_id, CASE WHEN NOT is_paired THEN 'NotPaired' WHEN coalesce(r, -1) < 0 THEN 'Pending' WHEN r >= coalesce(n, 0) - 1 THEN 'Complete' ELSE 'Partial' END AS sync_state,
      CAST(CASE WHEN is_paired THEN coalesce(r, -1) ELSE -1 END AS INT) AS aligned_through
    FROM flags f LEFT JOIN reach USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS n FROM lib_chapters GROUP BY 1) c USING (book_id)""".replace("WITH own", "SELECT * FROM (WITH own") + ")", ["flags", "chapter_maps", "lib_chapters"])
def _(t: Tables):
    maps = t.books.select("book_id", "audio_hash", "ebook_hash", F.explode(F.expr("sequence(0, book_id % 6)")).alias("i")).filter("(book_id + i) % 5 <> 0").select(
        "book_id", F.col("i").cast("int").alias("chapter_idx"), F.expr("case when book_id % 23 = 0 then 1 else 2 end").alias("version"),
        F.expr("case when book_id % 29 = 0 then 'old' else audio_hash end").alias("audio_hash"), "ebook_hash")
    return L.sync_state(t.books, lib_chapters(t), maps).select("book_id", "sync_state", "aligned_through")


@query("lib_attach_detach", """WITH ch AS (SELECT book_id, CASE WHEN book_id % 2 = 0 THEN 'audio' ELSE 'text' END AS medium FROM books WHERE book_id % 5 = 1),
    ok AS (SELECT c.* FROM ch c JOIN flags f USING (book_id) WHERE (medium = 'audio' AND has_text) OR (medium = 'text' AND has_audio)),
    kept AS (SELECT c.*, medium FROM lib_chapters c LEFT JOIN ok USING (book_id) WHERE medium IS NULL OR medium = 'text' OR text_start IS NOT NULL)
    SELECT book_id, CASE WHEN medium IS NULL THEN chapter_idx ELSE CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) - 1 AS INT) END AS chapter_idx, title,
      CASE WHEN medium = 'audio' THEN NULL ELSE start_ms END AS start_ms, CASE WHEN medium = 'audio' THEN NULL ELSE end_ms END AS end_ms,
      CASE WHEN medium = 'text' THEN NULL ELSE text_start END AS text_start, CASE WHEN medium = 'text' THEN NULL ELSE text_end END AS text_end FROM kept""".replace("WITH ch AS", "SELECT * FROM (WITH ch AS") + ")", ["flags", "lib_chapters"])
def _(t: Tables):
    changes = t.books.filter("book_id % 5 = 1").select("book_id", F.expr("case when book_id % 2 = 0 then 'audio' else 'text' end").alias("medium"))
    return L.detach(t.books, lib_chapters(t), changes)[1]


@query("lib_reset_alignment", """SELECT book_id, CASE WHEN book_id % 3 = 1 THEN CASE WHEN is_paired THEN 'Pending' ELSE 'NotPaired' END ELSE sync_state END AS sync_state,
    CASE WHEN book_id % 3 = 1 THEN -1 ELSE aligned_through END AS aligned_through FROM flags""", ["flags"])
def _(t: Tables):
    return L.reset_alignment(t.books, lib_chapters(t), t.anchors, t.books.filter("book_id % 3 = 1"))[0].select("book_id", "sync_state", "aligned_through")


register_sql("book_lengths", ["books"], "SELECT book_id, CAST(book_id % 7 + 1 AS BIGINT) * 1200000 AS duration_ms, title FROM books")


def book_lengths(t: Tables):
    return t.books.select("book_id", ((F.col("book_id") % 7 + 1) * 1_200_000).alias("duration_ms"), "title")


@query("chp_repair_timeline", """SELECT book_id, chapter_idx, CASE WHEN trim(title) = '' THEN 'Chapter ' || (chapter_idx + 1) ELSE trim(title) END AS title, start_ms,
      CASE WHEN end_ms > start_ms AND end_ms <= nx THEN end_ms ELSE nx END AS end_ms FROM (
    SELECT m.*, CAST(row_number() OVER w - 1 AS INT) AS chapter_idx, coalesce(lead(start_ms) OVER w, duration_ms) AS nx FROM (SELECT m.book_id, m.start_ms, m.end_ms, m.title, m.l_partkey, m.l_linenumber, m."offset", b.duration_ms FROM marks m JOIN book_lengths b USING (book_id)) m
    WHERE start_ms < duration_ms WINDOW w AS (PARTITION BY book_id ORDER BY start_ms, l_partkey, l_linenumber, end_ms, "offset"))
    UNION ALL SELECT book_id, 0, trim(title), 0, duration_ms FROM book_lengths b WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.book_id = b.book_id AND m.start_ms < b.duration_ms)""", ["marks", "book_lengths"])
def _(t: Tables):
    return L.repair_timeline(t.marks, book_lengths(t), ["start_ms", "l_partkey", "l_linenumber", "end_ms", "offset"])


register_sql("tracks", [], """SELECT DISTINCT l_partkey AS book_id, 'Disc ' || l_linenumber || ' - ' || l_orderkey || '.mp3' AS file_name, CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE 'T ' || l_orderkey END AS title,
    l_linenumber * 60000.5 + (l_orderkey % 7) / 4.0 AS length_ms, CASE WHEN l_linenumber % 3 = 0 THEN 'Album ' || l_orderkey END AS album, CASE WHEN l_linenumber % 4 = 0 THEN 'Artist ' || l_orderkey ELSE '' END AS artist FROM lineitem""")


def tracks(t: Tables):
    return t.table("lineitem").select(
        F.col("l_partkey").alias("book_id"), F.expr("concat('Disc ', l_linenumber, ' - ', l_orderkey, '.mp3')").alias("file_name"),
        F.expr("case when l_linenumber % 2 = 0 then ' ' else concat('T ', l_orderkey) end").alias("title"),
        F.expr("l_linenumber * 60000.5D + (l_orderkey % 7) / 4.0D").alias("length_ms"),
        F.expr("case when l_linenumber % 3 = 0 then concat('Album ', l_orderkey) end").alias("album"),
        F.expr("case when l_linenumber % 4 = 0 then concat('Artist ', l_orderkey) else '' end").alias("artist")).distinct()


@query("chp_concat_files", f"""SELECT book_id, CAST(row_number() OVER w - 1 AS INT) AS chapter_idx, CASE WHEN trim(title) = '' THEN regexp_replace(file_name, '\\.[^.]*$', '') ELSE title END AS title,
    CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM (SELECT *, CAST(round_even(CAST(length_ms AS DOUBLE), 0) AS BIGINT) AS ms, {_NK.format('file_name')} AS k FROM tracks)
    WINDOW w AS (PARTITION BY book_id ORDER BY k, file_name ROWS UNBOUNDED PRECEDING)""", ["tracks"])
def _(t: Tables):
    return L.concat_files(tracks(t))[0]


# Every book, and one of the same make that no mark or anchor speaks of.
register_sql("twins", ["books"], "SELECT book_id FROM books UNION ALL SELECT book_id + 1000000000 FROM books")
register_sql("timeline_twins", ["timeline_books"], "SELECT * FROM timeline_books UNION ALL SELECT * REPLACE (book_id + 1000000000 AS book_id) FROM timeline_books")


def twins(t: Tables):
    own = t.books.select("book_id")
    return own.unionByName(own.select((F.col("book_id") + 1_000_000_000).alias("book_id")))


def timeline_twins(t: Tables):
    return t.timeline_books.unionByName(t.timeline_books.withColumn("book_id", F.col("book_id") + 1_000_000_000))


@query("chp_from_marks", """WITH m AS (SELECT book_id, "offset", min_by(title, l_partkey * 10 + l_linenumber) AS title, 0 AS d FROM marks GROUP BY 1, 2
      UNION ALL SELECT book_id, i * 5000, 'Section ' || (i + 1), i FROM (SELECT book_id, unnest(generate_series(0, book_id % 3)) AS i FROM twins WHERE book_id NOT IN (SELECT book_id FROM marks)))
    SELECT book_id, CAST(row_number() OVER w - 1 AS INT) AS chapter_idx, CASE WHEN trim(title) = '' THEN 'Chapter ' || (row_number() OVER w) ELSE trim(title) END AS title,
      CAST(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE "offset" END AS INT) AS text_start, CAST(coalesce(lead("offset") OVER w, 200000) AS INT) AS text_end FROM m JOIN twins USING (book_id)
    WINDOW w AS (PARTITION BY book_id ORDER BY "offset", d)""".replace("WITH m AS", "SELECT * FROM (WITH m AS").replace("SELECT book_id, CAST(row_number() OVER w - 1", "SELECT m.book_id, CAST(row_number() OVER w - 1").replace("CASE WHEN trim(title)", "CASE WHEN trim(m.title)").replace("ELSE trim(title) END AS title,\n      CAST(CASE WHEN row", "ELSE trim(m.title) END AS title,\n      CAST(CASE WHEN row").replace("PARTITION BY book_id ORDER BY \"offset\", d", "PARTITION BY m.book_id ORDER BY \"offset\", d") + ")", ["marks", "twins"])
def _(t: Tables):
    marks = t.marks.select("book_id", F.expr("l_partkey * 10 + l_linenumber").alias("ord"), "title", "offset")
    spine = twins(t).select("book_id", F.explode(F.expr("sequence(0, cast(book_id % 3 as int))")).alias("spine_idx")).withColumn("text_start", F.col("spine_idx") * 5000)
    return L.chapters_from_marks(marks, twins(t).select("book_id", F.lit(200_000).alias("text_length")), spine)


register_sql("outline", [], """SELECT l_orderkey AS book_id, l_partkey * 10 + l_linenumber AS ord, CAST(l_suppkey % 3 AS INT) AS level, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'Part ' || l_partkey END AS title, CAST(l_partkey % 90 + 1 AS INT) AS page
    FROM (SELECT l_orderkey, l_partkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3)""")
register_sql("page_counts", ["twins"], "SELECT book_id, CAST(book_id % 80 + 20 AS INT) AS page_count FROM twins")


@query("chp_outline_level", """WITH o AS (SELECT o.* FROM outline o JOIN page_counts p USING (book_id) WHERE page <= page_count),
    lv AS (SELECT DISTINCT book_id, level FROM o),
    up AS (SELECT l.book_id, l.level, count(DISTINCT o.page) AS n FROM lv l JOIN o ON o.book_id = l.book_id AND o.level <= l.level GROUP BY 1, 2),
    pick AS (SELECT book_id, coalesce(min(CASE WHEN n >= 3 THEN level END), max(level)) AS lvl FROM up GROUP BY 1),
    one AS (SELECT o.book_id, o.page, min_by(o.title, o.ord) AS title FROM o JOIN pick USING (book_id) WHERE o.level <= lvl GROUP BY 1, 2)
    SELECT book_id, CASE WHEN trim(title) = '' THEN 'Chapter ' || row_number() OVER w ELSE trim(title) END AS title, CAST(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE page - 1 END AS INT) AS page FROM one WINDOW w AS (PARTITION BY book_id ORDER BY page)
    UNION ALL SELECT book_id, 'Section ' || (i + 1), CAST(i * 20 AS INT) FROM (SELECT book_id, unnest(generate_series(0, (page_count - 1) // 20)) AS i FROM page_counts WHERE book_id NOT IN (SELECT book_id FROM o))""".replace("WITH o AS", "SELECT * FROM (WITH o AS") + ")", ["outline", "page_counts"])
def _(t: Tables):
    o = t.table("lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("s")).select(
        F.col("l_orderkey").alias("book_id"), F.expr("l_partkey * 10 + l_linenumber").alias("ord"), F.expr("cast(s % 3 as int)").alias("level"),
        F.expr("case when l_linenumber % 3 = 0 then ' ' else concat('Part ', l_partkey) end").alias("title"), F.expr("cast(l_partkey % 90 + 1 as int)").alias("page"))
    return L.outline_level(o, twins(t).select("book_id", F.expr("cast(book_id % 80 + 20 as int)").alias("page_count")))


@query("chp_from_anchors", """WITH f AS (SELECT c.book_id, c.text_start, min_by(a.audio_ms, CAST(a.char_offset AS BIGINT) * 10000000 + a.audio_ms) AS t_at, min(c.title) AS title FROM chapters c
      JOIN anchors a ON a.book_id = c.book_id AND a.char_offset >= c.text_start AND a.char_offset < c.text_end GROUP BY 1, 2),
    k AS (SELECT * FROM (SELECT *, max(t_at) OVER (PARTITION BY book_id ORDER BY text_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f) WHERE m IS NULL OR t_at > m)
    SELECT k.book_id, CAST(row_number() OVER w - 1 AS INT) AS chapter_idx, title, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE t_at END AS start_ms,
      coalesce(lead(t_at) OVER w, greatest(duration_ms, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE t_at END + 1)) AS end_ms FROM k JOIN timeline_twins b USING (book_id) WINDOW w AS (PARTITION BY k.book_id ORDER BY text_start)
    UNION ALL SELECT book_id, 0, 'Chapter 1', 0, greatest(duration_ms, 1) FROM timeline_twins WHERE book_id NOT IN (SELECT book_id FROM f)""".replace("WITH f AS", "SELECT * FROM (WITH f AS") + ")", ["chapters", "anchors", "timeline_twins"])
def _(t: Tables):
    return L.chapters_from_anchors(t.chapters, t.anchors, timeline_twins(t))


@query("chp_server_marks", """WITH m AS (SELECT l_orderkey AS book_id, l_linenumber AS chapter_idx, 'C' || l_linenumber AS title, CAST(round_even(a * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(z * 1000, 0) AS BIGINT) AS end_ms FROM (
      SELECT DISTINCT l_orderkey, l_linenumber, l_partkey / 8.0::DOUBLE AS a, l_partkey / 8.0::DOUBLE + (l_suppkey - 40) / 16.0::DOUBLE AS z FROM lineitem))
    SELECT * FROM m WHERE end_ms > start_ms UNION ALL SELECT book_id, 0, title, 0, duration_ms FROM book_lengths WHERE book_id NOT IN (SELECT book_id FROM m WHERE end_ms > start_ms)""".replace("WITH m AS", "SELECT * FROM (WITH m AS") + ")", ["book_lengths"])
def _(t: Tables):
    m = t.table("lineitem").select(
        F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("chapter_idx"), F.expr("concat('C', l_linenumber)").alias("title"),
        F.expr("l_partkey / 8.0D").alias("start_s"), F.expr("l_partkey / 8.0D + (l_suppkey - 40) / 16.0D").alias("end_s")).distinct()
    return L.server_marks(m, book_lengths(t))


register_sql("bookmarks", ["ev"], """SELECT book_id, event_id AS bookmark_id, CASE WHEN event_id % 3 <> 0 THEN s END AS position_ms, CASE WHEN event_id % 3 = 0 THEN CAST(s * 15 // 1000 AS INT) END AS text_offset, ts AS created FROM ev""")


@query("bmk_list", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created, bookmark_id) AS n FROM bookmarks),
    c AS (SELECT k.*, CASE WHEN position_ms IS NULL THEN 0 ELSE (SELECT max(chapter_idx) FROM chapters x WHERE x.book_id = k.book_id AND x.start_ms <= k.position_ms) END AS ci FROM k)
    SELECT c.book_id, bookmark_id, CAST(coalesce(ci, 0) AS INT) AS chapter_idx, coalesce(x.title, 'Chapter ' || (coalesce(ci, 0) + 1)) AS chapter, coalesce(position_ms, text_offset, 0) AS place,
      CAST(row_number() OVER (PARTITION BY c.book_id ORDER BY coalesce(position_ms, text_offset, 0), created, bookmark_id) - 1 AS INT) AS row, n > 50 AS over_limit
    FROM c LEFT JOIN chapters x ON x.book_id = c.book_id AND x.chapter_idx = coalesce(ci, 0)""".replace("WITH k AS", "SELECT * FROM (WITH k AS") + ")", ["bookmarks", "chapters"])
def _(t: Tables):
    b = t.ev.select("book_id", F.col("event_id").alias("bookmark_id"), F.expr("case when event_id % 3 <> 0 then s end").alias("position_ms"),
                    F.expr("case when event_id % 3 = 0 then cast(s * 15 div 1000 as int) end").alias("text_offset"), F.col("ts").alias("created"))
    return L.bookmark_list(b, t.chapters)


SCAN_STATE = """CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Waiting' ELSE 'Failed' END AS status, CAST(o_custkey AS INT) AS sentences, CAST(o_custkey * (o_orderkey % 10) {div} 10 AS INT) AS timed,
    (o_orderkey % 9) / 4.0 AS hours, CASE WHEN o_orderstatus = 'P' THEN 'broken' END AS error"""


@query("agg_status_report", f"""SELECT status, count(*) AS books, CAST(sum(hours) AS DOUBLE) AS hours, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(timed) AS BIGINT) AS timed,
    min(CASE WHEN sentences > 0 THEN timed * 100 // sentences END) AS worst_pct, max(CASE WHEN sentences > 0 THEN timed * 100 // sentences END) AS best_pct, count(error) AS errors
    FROM (SELECT {SCAN_STATE.format(div='//')} FROM orders) GROUP BY 1""".replace("min(CASE WHEN sentences > 0 THEN timed * 100 // sentences END)", "CAST(min(CASE WHEN sentences > 0 THEN timed * 100 // sentences END) AS BIGINT)").replace("max(CASE WHEN sentences > 0 THEN timed * 100 // sentences END)", "CAST(max(CASE WHEN sentences > 0 THEN timed * 100 // sentences END) AS BIGINT)"))
def _(t: Tables):
    t.table("orders").createOrReplaceTempView("versoline_orders")
    s = t.spark.sql(f"SELECT {SCAN_STATE.format(div='DIV')} FROM versoline_orders").withColumn("hours", F.col("hours").cast("double"))
    return L.status_report(s)


@query("agg_write_report", """SELECT book_id, CAST(sum(s) AS BIGINT) AS sentences, CAST(sum(t) AS BIGINT) AS timed, count(*) AS documents, count(*) FILTER (t > 0) AS with_overlay FROM (
    SELECT q.book_id, q.spine_idx, count(*) AS s, count(x.idx) AS t FROM sentences q LEFT JOIN sent_times x ON x.book_id = q.book_id AND x.idx = q.idx GROUP BY 1, 2) GROUP BY 1""", ["sentences", "sent_times"])
def _(t: Tables):
    return L.write_report(t.sentences, M.sentence_times(t.sentences, t.maps))


@query("agg_corpus_profile", """SELECT source, CAST(sum(n) AS BIGINT) AS documents, CAST(sum(chars) AS BIGINT) AS characters, CAST(sum(ls) AS BIGINT) AS lines, max_by(lang, n * 100 + ascii(lang)) FILTER (lang IS NOT NULL) AS language FROM (
    SELECT source, lang, count(*) AS n, sum(length(text)) AS chars, sum(len(string_split(text, chr(10)))) AS ls FROM documents GROUP BY 1, 2) GROUP BY 1""".replace("n * 100 + ascii(lang)", "lpad(CAST(n AS VARCHAR), 9, '0') || lang"))
def _(t: Tables):
    d = t.table("documents")
    return L.corpus_profile(d, d.select("doc_id", F.col("lang").alias("language")))


register_sql("shelf_books", ["books"], """SELECT book_id, title, added, last_opened, CASE WHEN book_id % 3 <> 0 THEN 'Series ' || (series_no % 200) END AS series,
    CASE WHEN book_id % 3 <> 0 AND book_id % 4 <> 0 THEN (book_id % 30) / 2.0::DOUBLE END AS seq_no FROM books""")


def shelf_books(t: Tables):
    return t.books.select("book_id", "title", "added", "last_opened", F.expr("case when book_id % 3 <> 0 then concat('Series ', series_no % 200) end").alias("series"),
                          F.expr("case when book_id % 3 <> 0 and book_id % 4 <> 0 then (book_id % 30) / 2.0D end").alias("seq_no"))


@query("win_shelf_recent", "SELECT book_id, title, added FROM shelf_books ORDER BY added DESC, book_id LIMIT 12", ["shelf_books"])
def _(t: Tables):
    return L.shelf_recent(shelf_books(t)).select("book_id", "title", "added")


@query("win_shelf_series", """SELECT book_id, coalesce(series, '') AS shelf, row_number() OVER (PARTITION BY coalesce(series, '')
    ORDER BY CASE WHEN series IS NULL THEN 0 ELSE coalesce(seq_no, 1e300) END, CASE WHEN series IS NULL THEN lower(title) ELSE title END, book_id) - 1 AS position FROM shelf_books""", ["shelf_books"])
def _(t: Tables):
    return L.shelf_series(shelf_books(t)).select("book_id", "shelf", "position")


@query("srt_shelf_order", """SELECT book_id, used_at, row_number() OVER (ORDER BY used_at DESC, book_id) - 1 AS place FROM (SELECT book_id, coalesce(last_opened, added) AS used_at FROM books) WHERE used_at IS NOT NULL""", ["books"])
def _(t: Tables):
    return L.shelf_order(t.books).select("book_id", "used_at", "place")
