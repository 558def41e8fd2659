"""Registered queries over anchors and maps (survey 2.6 and 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versoline.operators import anchors as A
from versoline.operators import maps as M
from versoline.plans.registry import query
from versoline.plans.views import Tables, register_sql

# Points with their chapter, on both sides.
register_sql("last_chapter", ["chapters"], "SELECT book_id, max(chapter_idx) AS last_idx FROM chapters GROUP BY 1")
register_sql("pt", ["points", "chapters", "last_chapter"], """
    SELECT p.*, coalesce(c.chapter_idx, l.last_idx) AS chapter_idx, coalesce(t.chapter_idx, l.last_idx) AS text_chapter
    FROM points p JOIN last_chapter l USING (book_id)
    LEFT JOIN chapters c ON c.book_id = p.book_id AND p.at_ms >= c.start_ms AND p.at_ms < c.end_ms
    LEFT JOIN chapters t ON t.book_id = p.book_id AND p.at_char >= t.text_start AND p.at_char < t.text_end""")
register_sql("bounds", ["maps"], """
    SELECT book_id, chapter_idx, count(*) AS n, min(audio_ms) AS first_ms, max(audio_ms) AS last_ms,
           min(char_offset) AS first_char, max(char_offset) AS last_char, bool_or(confidence > 0.2) AS heard_any
    FROM maps GROUP BY 1, 2""")
register_sql("seg_ms", ["maps"], """
    SELECT book_id, chapter_idx, audio_ms AS a, char_offset AS x, lead(audio_ms) OVER w AS b, lead(char_offset) OVER w AS y
    FROM maps WINDOW w AS (PARTITION BY book_id, chapter_idx ORDER BY audio_ms)""")

MS_TO_CHAR = """CASE WHEN {t} <= b.first_ms THEN b.first_char WHEN {t} >= b.last_ms THEN b.last_char
    ELSE s.x + CAST(round_even(CAST({t} - s.a AS DOUBLE) / (s.b - s.a) * (s.y - s.x), 0) AS BIGINT) END"""
CHAR_TO_MS = """CASE WHEN {c} <= b.first_char THEN b.first_ms WHEN {c} >= b.last_char THEN b.last_ms
    ELSE s.a + CAST(round_even(CAST({c} - s.x AS DOUBLE) / (s.y - s.x) * (s.b - s.a), 0) AS BIGINT) END"""
J_MS = "LEFT JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.chapter_idx LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.chapter_idx AND p.at_ms >= s.a AND p.at_ms < s.b"


def points(t: Tables):
    return M.chapter_at(t.points, t.chapters)


@query("anc_monotone", "SELECT book_id, chapter_idx, audio_ms, char_offset, confidence, event_id FROM maps", ["maps"])
def _(t: Tables):
    return A.monotone(t.anchors, distinct_times=True)


@query("map_chapter_at", "SELECT event_id, book_id, at_ms, at_char, chapter_idx, text_chapter FROM pt", ["pt"])
def _(t: Tables):
    by_time = M.chapter_at(t.points, t.chapters).withColumnRenamed("chapter_idx", "c")
    return M.chapter_at(by_time, t.chapters, "at_char", "char").withColumnRenamed("chapter_idx", "text_chapter").withColumnRenamed("c", "chapter_idx")


@query("map_ms_to_char", f"""SELECT p.event_id, p.book_id, p.chapter_idx, p.at_ms, CAST({MS_TO_CHAR.format(t='p.at_ms')} AS INT) AS char_offset
    FROM pt p {J_MS}""", ["pt", "bounds", "seg_ms"])
def _(t: Tables):
    return M.ms_to_char(points(t), t.maps).select("event_id", "book_id", "chapter_idx", "at_ms", "char_offset")


@query("map_char_to_ms", f"""SELECT p.event_id, p.book_id, p.text_chapter AS chapter_idx, p.at_char, CAST({CHAR_TO_MS.format(c='p.at_char')} AS BIGINT) AS audio_ms
    FROM pt p LEFT JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.text_chapter
    LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.text_chapter AND p.at_char >= s.x AND p.at_char < s.y""",
       ["pt", "bounds", "seg_ms"])
def _(t: Tables):
    p = M.chapter_at(t.points, t.chapters, "at_char", "char")
    return M.char_to_ms(p, t.maps).select("event_id", "book_id", "chapter_idx", "at_char", "audio_ms")


@query("map_covers", """SELECT p.event_id, p.book_id, p.chapter_idx, p.at_ms,
    coalesce(b.n > 1 AND p.at_ms BETWEEN b.first_ms AND b.last_ms, false) AS covered,
    coalesce(b.n > 1 AND p.at_char BETWEEN b.first_char AND b.last_char, false) AS covered_char
    FROM pt p LEFT JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.chapter_idx""", ["pt", "bounds"])
def _(t: Tables):
    by_time = M.covers(points(t), t.maps).withColumnRenamed("covered", "c")
    both = M.covers(by_time, t.maps, "at_char", "char")
    return both.select("event_id", "book_id", "chapter_idx", "at_ms", F.col("c").alias("covered"), F.col("covered").alias("covered_char"))


EXTRAPOLATED = """CASE WHEN b.n > 1 AND p.at_ms > b.last_ms AND p.at_ms - b.last_ms <= 120000 AND b.last_ms - b.first_ms >= 5000
    AND CAST(b.last_char - b.first_char AS DOUBLE) / nullif(b.last_ms - b.first_ms, 0) BETWEEN 0.005 AND 0.05
    THEN b.last_char + CAST(trunc(CAST(b.last_char - b.first_char AS DOUBLE) / nullif(b.last_ms - b.first_ms, 0) * (p.at_ms - b.last_ms)) AS INT) END"""


@query("map_extrapolate", f"""SELECT p.event_id, p.book_id, p.chapter_idx, p.at_ms, CAST({EXTRAPOLATED} AS INT) AS char_offset
    FROM pt p LEFT JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.chapter_idx""", ["pt", "bounds"])
def _(t: Tables):
    return M.extrapolate(points(t), t.maps, 120_000).select("event_id", "book_id", "chapter_idx", "at_ms", "char_offset")


@query("map_is_measured_at", f"""SELECT event_id, book_id, chapter_idx, at_ms, measured, CASE WHEN measured THEN c END AS char_offset FROM (
    SELECT p.event_id, p.book_id, p.chapter_idx, p.at_ms, CAST({MS_TO_CHAR.format(t='p.at_ms')} AS INT) AS c,
      EXISTS (SELECT 1 FROM maps m WHERE m.book_id = p.book_id AND m.chapter_idx = p.chapter_idx AND m.confidence > 0.2 AND m.audio_ms BETWEEN p.at_ms - 15000 AND p.at_ms)
      AND EXISTS (SELECT 1 FROM maps m WHERE m.book_id = p.book_id AND m.chapter_idx = p.chapter_idx AND m.confidence > 0.2 AND m.audio_ms BETWEEN p.at_ms AND p.at_ms + 15000) AS measured
    FROM pt p {J_MS})""", ["pt", "bounds", "seg_ms"])
def _(t: Tables):
    return M.is_measured_at(points(t), t.maps, 15_000).select("event_id", "book_id", "chapter_idx", "at_ms", "measured", "char_offset")


POSITION = f"""CASE WHEN b.n > 1 AND p.at_ms BETWEEN b.first_ms AND b.last_ms THEN {MS_TO_CHAR.format(t='p.at_ms')}
    ELSE coalesce({EXTRAPOLATED.replace('120000', '5000')}, CASE WHEN b.n > 1 AND p.at_ms > b.last_ms AND p.at_ms - b.last_ms < 30000 AND b.heard_any THEN b.last_char END) END"""


@query("map_position", f"SELECT p.event_id, p.book_id, p.chapter_idx, p.at_ms, CAST({POSITION} AS INT) AS char_offset FROM pt p {J_MS}",
       ["pt", "bounds", "seg_ms"])
def _(t: Tables):
    return M.position(t.points, t.maps, t.chapters, ahead_ms=5_000).select("event_id", "book_id", "chapter_idx", "at_ms", "char_offset")


register_sql("sent_ms", ["sentences", "chapters", "last_chapter", "bounds", "seg_ms"], f"""
    SELECT p.book_id, p.start, {CHAR_TO_MS.format(c='p.start')} AS at FROM (
      SELECT q.book_id, q.start, coalesce(t.chapter_idx, l.last_idx) AS chapter_idx FROM sentences q JOIN last_chapter l USING (book_id)
      LEFT JOIN chapters t ON t.book_id = q.book_id AND q.start >= t.text_start AND q.start < t.text_end) p
    JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.chapter_idx AND b.n > 1 AND p.start BETWEEN b.first_char AND b.last_char
    LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.chapter_idx AND p.start >= s.x AND p.start < s.y""")


@query("map_audio_at_or_after", f"""SELECT p.event_id, p.book_id, p.at_char,
    CAST(coalesce(CASE WHEN b.n > 1 AND p.at_char BETWEEN b.first_char AND b.last_char THEN {CHAR_TO_MS.format(c='p.at_char')} END,
      (SELECT min_by(m.at, m.start) FROM sent_ms m WHERE m.book_id = p.book_id AND m.start > p.at_char AND m.start - p.at_char <= 400)) AS BIGINT) AS audio_ms
    FROM pt p LEFT JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.text_chapter
    LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.text_chapter AND p.at_char >= s.x AND p.at_char < s.y""",
       ["pt", "bounds", "seg_ms", "sent_ms"])
def _(t: Tables):
    return M.audio_at_or_after(t.points, t.maps, t.chapters, t.sentences, 400).select("event_id", "book_id", "at_char", "audio_ms")


# Chapter maps may overlap in text: the first chapter whose map covers both ends of a sentence times it.
register_sql("sent_times", ["sentences", "bounds", "seg_ms"], f"""
    SELECT book_id, idx, start, CAST(begin_ms AS BIGINT) AS begin_ms, CAST(end_ms AS BIGINT) AS end_ms FROM (
      SELECT p.book_id, p.idx, p.start, {CHAR_TO_MS.format(c='p.start')} AS begin_ms,
             {CHAR_TO_MS.format(c='p.upto').replace('s.', 'e.')} AS end_ms
      FROM (SELECT q.*, b.chapter_idx, CASE WHEN nxt <= b.last_char THEN nxt ELSE "end" END AS upto FROM (
              SELECT *, lead(start) OVER (PARTITION BY book_id ORDER BY start) AS nxt FROM sentences) q
            JOIN bounds b ON b.book_id = q.book_id AND b.n > 1 AND q.start BETWEEN b.first_char AND b.last_char
              AND greatest(q.start, q."end" - 1) <= b.last_char QUALIFY row_number() OVER (PARTITION BY q.book_id, q.idx ORDER BY b.chapter_idx) = 1) p
      JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.chapter_idx
      LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.chapter_idx AND p.start >= s.x AND p.start < s.y
      LEFT JOIN seg_ms e ON e.book_id = p.book_id AND e.chapter_idx = p.chapter_idx AND p.upto >= e.x AND p.upto < e.y)
    WHERE end_ms > begin_ms""")


@query("map_sentence_times", "SELECT * FROM sent_times", ["sent_times"])
def _(t: Tables):
    return M.sentence_times(t.sentences, t.maps)


register_sql("spans", ["ev"], """SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY s, event_id) - 1 AS BIGINT) AS idx,
    s AS begin_ms, s + CAST(value * 100 AS BIGINT) - CASE WHEN event_id % 11 = 0 THEN 5000 ELSE 0 END AS end_ms FROM ev""")


def spans(t: Tables):
    from versoline.operators import primitives as P

    s = P.scan(t.ev, ["book_id"], ["s", "event_id"], P.slice_of("s", 600_000), {"idx": P.row_index()})
    return s.select("book_id", "idx", F.col("s").alias("begin_ms"), F.expr("s + cast(round(value * 100) as bigint) - case when event_id % 11 = 0 then 5000 else 0 end").alias("end_ms"))


@query("map_spans_close_gaps", """SELECT book_id, idx, begin_ms, e AS end_ms FROM (
    SELECT *, CASE WHEN n - end_ms >= 0 AND n - end_ms < 1500 THEN n ELSE end_ms + 250 END AS e FROM (
      SELECT *, lead(begin_ms) OVER (PARTITION BY book_id ORDER BY idx) AS n FROM spans)) WHERE e > begin_ms""", ["spans"])
def _(t: Tables):
    return M.spans_close_gaps(spans(t))


@query("map_no_overlap_clips", """SELECT book_id, idx, b AS begin_ms, e AS end_ms FROM (
    SELECT *, least(greatest(begin_ms, coalesce(max(CASE WHEN e > greatest(begin_ms, 0) THEN e END) OVER (PARTITION BY book_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), duration_ms) AS b FROM (
      SELECT s.*, duration_ms, least(greatest(end_ms, 0), duration_ms) AS e FROM spans s JOIN timeline_books USING (book_id))) WHERE e > b""",
       ["spans", "timeline_books"])
def _(t: Tables):
    return M.no_overlap_clips(spans(t), t.timeline_books, ["book_id"])


@query("map_sentence_at", """SELECT p.event_id, p.book_id, p.at_char, coalesce(s.idx, 0) AS sentence_idx
    FROM points p ASOF LEFT JOIN sentences s ON s.book_id = p.book_id AND p.at_char >= s.start""", ["points", "sentences"])
def _(t: Tables):
    return M.sentence_at(t.points, t.sentences).select("event_id", "book_id", "at_char", "sentence_idx")


@query("map_spine_at", """SELECT p.event_id, p.book_id, p.at_char, coalesce(s.spine_idx, (SELECT max(spine_idx) FROM spine x WHERE x.book_id = p.book_id)) AS spine_idx
    FROM points p ASOF LEFT JOIN spine s ON s.book_id = p.book_id AND p.at_char < s.text_end""", ["points", "spine"])
def _(t: Tables):
    return M.spine_at(t.points, t.spine).select("event_id", "book_id", "at_char", "spine_idx")


@query("map_nearest_mark", """SELECT event_id, book_id, at_char, CAST(CASE WHEN abs(m - a) <= 200000 THEN m ELSE a END AS BIGINT) AS audio_ms FROM (
    SELECT p.event_id, p.book_id, p.at_char, p.a, (SELECT min_by(start_ms, abs(start_ms - p.a) * 2 + (CASE WHEN start_ms > p.a THEN 1 ELSE 0 END)) FROM chapters c WHERE c.book_id = p.book_id) AS m FROM (
      SELECT *, CAST(trunc(duration_ms * (CAST(at_char AS DOUBLE) / text_length)) AS BIGINT) AS a FROM points JOIN timeline_books USING (book_id)) p)""",
       ["points", "chapters", "timeline_books"])
def _(t: Tables):
    return M.nearest_mark(t.points, t.chapters, t.timeline_books, 200_000).select("event_id", "book_id", "at_char", "audio_ms")


register_sql("spans_heard", ["maps"], """SELECT book_id, chapter_idx, min(audio_ms) AS span_start, max(audio_ms) AS span_end FROM (
    SELECT *, sum(CASE WHEN p IS NULL OR audio_ms - p > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, chapter_idx ORDER BY audio_ms) AS g FROM (
      SELECT *, lag(audio_ms) OVER (PARTITION BY book_id, chapter_idx ORDER BY audio_ms) AS p FROM maps WHERE confidence > 0.2)) GROUP BY book_id, chapter_idx, g""")


@query("cov_measured_ms", "SELECT book_id, chapter_idx, CAST(sum(span_end - span_start) AS BIGINT) AS measured_ms FROM spans_heard GROUP BY 1, 2", ["spans_heard"])
def _(t: Tables):
    return M.measured_ms(t.maps, 30_000)


@query("cov_contains", """SELECT event_id, book_id, chapter_idx, from_ms, to_ms,
    EXISTS (SELECT 1 FROM spans_heard h WHERE h.book_id = p.book_id AND h.chapter_idx = p.chapter_idx AND p.from_ms >= h.span_start - 30000 AND p.to_ms <= h.span_end) AS covered
    FROM (SELECT event_id, book_id, chapter_idx, at_ms AS from_ms, at_ms + 15000 AS to_ms FROM pt) p""", ["pt", "spans_heard"])
def _(t: Tables):
    p = points(t).select("event_id", "book_id", "chapter_idx", F.col("at_ms").alias("from_ms"), (F.col("at_ms") + 15_000).alias("to_ms"))
    return M.contains(p, t.maps, 30_000)


register_sql("all_chapters", ["chapters"], """SELECT book_id, CAST(unnest(generate_series(0, max(chapter_idx))) AS INT) AS chapter_idx FROM chapters GROUP BY book_id""")


def all_chapters(t: Tables):
    """Chapters without holes: 0 .. the last one."""
    return t.chapters.groupBy("book_id").agg(F.max("chapter_idx").alias("m")).select(
        "book_id", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("chapter_idx"))


@query("cov_chapters", """SELECT book_id, count(*) FILTER (heard) AS measured,
    coalesce(min(CASE WHEN NOT coalesce(heard, false) THEN chapter_idx END), max(chapter_idx) + 1) AS first_todo,
    coalesce(min(CASE WHEN heard IS NULL THEN chapter_idx END), max(chapter_idx) + 1) - 1 AS through,
    min(CASE WHEN heard = false AND chapter_idx <= claimed THEN chapter_idx END) AS heal_from
    FROM (SELECT c.book_id, c.chapter_idx, h.heard, c.book_id % 5 AS claimed FROM all_chapters c
      LEFT JOIN (SELECT book_id, chapter_idx, bool_or(confidence > 0.2) AS heard FROM anchors GROUP BY 1, 2) h USING (book_id, chapter_idx))
    GROUP BY 1""", ["all_chapters", "anchors"])
def _(t: Tables):
    claimed = t.timeline_books.select("book_id", (F.col("book_id") % 5).alias("claimed_through"))
    return M.chapter_progress(t.anchors, all_chapters(t), claimed)


@query("qa_error_report", f"""SELECT book_id, count(*) AS n, round(avg(d), 6) AS bias,
    list_sort(list(abs(d)))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1] AS p50,
    list_sort(list(abs(d)))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95,
    max(abs(d)) AS worst, count(*) FILTER (confidence > 0.5) AS strong
    FROM (SELECT p.book_id, CAST({MS_TO_CHAR.format(t='p.at_ms')} AS INT) - CAST(p.at_ms * 15 // 1000 AS INT) AS d, (p.event_id * 37 % 100) / 100.0 AS confidence
      FROM pt p JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.chapter_idx LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.chapter_idx AND p.at_ms >= s.a AND p.at_ms < s.b) GROUP BY 1""",
       ["pt", "bounds", "seg_ms"])
def _(t: Tables):
    p = M.ms_to_char(points(t), t.maps).filter("char_offset is not null").select(
        "event_id", "book_id", "char_offset", (F.col("event_id") * 37 % 100 / 100).alias("confidence"))
    truth = t.points.select("event_id", F.expr("cast(at_ms * 15 div 1000 as int)").alias("true_char"))
    return M.error_report(p, truth, ["event_id"]).withColumn("bias", F.round("bias", 6))
