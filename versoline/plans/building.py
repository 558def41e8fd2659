"""Registered queries that build and repair maps (survey 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versoline.operators import anchors as A
from versoline.operators import tokens as K
from versoline.plans.registry import query
from versoline.plans.timeline import MS_TO_CHAR, all_chapters, points
from versoline.plans.views import Tables, register_sql

# Chapters of uneven length, some shorter than a probe.
register_sql("uneven", ["chapters"], """SELECT book_id, chapter_idx, start_ms, CASE WHEN (book_id + chapter_idx) % 9 = 0 THEN start_ms + 7000 ELSE end_ms - (book_id % 7) * 83000 END AS end_ms, text_start, text_end FROM chapters""")


def uneven(t: Tables):
    return t.chapters.withColumn("end_ms", F.expr("case when (book_id + chapter_idx) % 9 = 0 then start_ms + 7000 else end_ms - (book_id % 7) * 83000 end"))


register_sql("probes", ["uneven"], """
    SELECT book_id, chapter_idx, start_ms, CAST(duration_ms AS BIGINT) AS duration_ms, run_in FROM (
      WITH c AS (SELECT book_id, chapter_idx, start_ms AS a, end_ms AS z, least(10000, end_ms - start_ms) AS d FROM uneven WHERE end_ms > start_ms),
      r AS (SELECT c.*, i FROM c, range(12) g(i) WHERE i = 0 OR a + i * d + d <= z),
      m AS (SELECT book_id, chapter_idx, a, z, d, max(a + i * d) AS last FROM r GROUP BY 1, 2, 3, 4, 5),
      g AS (SELECT m.*, a + j * greatest(60000, d) AS at_ms FROM m, range(1, 200) q(j) WHERE a + j * greatest(60000, d) + d < z AND a + j * greatest(60000, d) > last)
      SELECT book_id, chapter_idx, a + i * d AS start_ms, d AS duration_ms, true AS run_in FROM r
      UNION ALL SELECT book_id, chapter_idx, at_ms, d, false FROM g
      UNION ALL SELECT m.book_id, m.chapter_idx, z - d, d, false FROM m LEFT JOIN (SELECT book_id, chapter_idx, max(at_ms) AS gl FROM g GROUP BY 1, 2) x USING (book_id, chapter_idx) WHERE z - d > greatest(last, coalesce(gl, last)))""")


@query("anc_plan_probes", "SELECT * FROM probes", ["probes"])
def _(t: Tables):
    return A.plan_probes(uneven(t))


@query("anc_skip_measured", """SELECT p.* FROM probes p WHERE NOT (
      EXISTS (SELECT 1 FROM anchors a WHERE a.book_id = p.book_id AND a.chapter_idx = p.chapter_idx AND a.confidence > 0.45 AND a.audio_ms BETWEEN p.start_ms - 60000 AND p.start_ms)
      AND EXISTS (SELECT 1 FROM anchors a WHERE a.book_id = p.book_id AND a.chapter_idx = p.chapter_idx AND a.confidence > 0.45 AND a.audio_ms BETWEEN p.start_ms AND p.start_ms + 60000))
    AND NOT (run_in AND EXISTS (SELECT 1 FROM anchors a WHERE a.book_id = p.book_id AND a.chapter_idx = p.chapter_idx AND a.confidence > 0.45))""", ["probes", "anchors"])
def _(t: Tables):
    return A.skip_measured(A.plan_probes(uneven(t)), t.anchors)


register_sql("phrase_matches", ["segments"], """SELECT book_id * 1000 + seg_id AS query_id, book_id, CAST(0 AS INT) AS chapter_idx, CAST(seg_id % 3 AS INT) AS first_word, CAST(seg_id % 3 + book_id % 4 AS INT) AS last_word,
    CAST(seg_id * 150 AS INT) AS char_offset, CAST(seg_id * 150 + (book_id % 4) * 6 AS INT) AS end_offset, no_speech AS confidence FROM segments""")


@query("anc_from_matches", """WITH j AS (SELECT m.*, a.at_ms AS o, z.at_ms AS c FROM phrase_matches m JOIN (SELECT book_id * 1000 + seg_id AS q, word_idx, at_ms FROM spread) a ON a.q = query_id AND a.word_idx = first_word
      JOIN (SELECT book_id * 1000 + seg_id AS q, word_idx, at_ms FROM spread) z ON z.q = query_id AND z.word_idx = last_word)
    SELECT query_id, book_id, chapter_idx, o AS audio_ms, char_offset, confidence FROM j UNION ALL SELECT query_id, book_id, chapter_idx, c, end_offset, confidence FROM j WHERE c > o AND end_offset > char_offset""".replace("WITH j AS", "SELECT * FROM (WITH j AS") + ")", ["phrase_matches", "spread"])
def _(t: Tables):
    words = K.spread_even(t.segments, ["book_id", "seg_id"]).withColumn("query_id", F.expr("book_id * 1000 + seg_id"))
    m = t.segments.selectExpr("book_id * 1000 + seg_id as query_id", "book_id", "0 as chapter_idx", "cast(seg_id % 3 as int) as first_word", "cast(seg_id % 3 + book_id % 4 as int) as last_word",
                              "cast(seg_id * 150 as int) as char_offset", "cast(seg_id * 150 + (book_id % 4) * 6 as int) as end_offset", "no_speech as confidence")
    return A.from_matches(m, words)


@query("anc_boundaries", """SELECT book_id, chapter_idx, start_ms AS audio_ms, text_start AS char_offset, 0.2::DOUBLE AS confidence FROM chapters UNION ALL SELECT book_id, chapter_idx, end_ms, text_end, 0.2 FROM chapters""", ["chapters"])
def _(t: Tables):
    return A.boundaries(t.chapters)


register_sql("guessed", ["anchors", "chapters"], """SELECT book_id, chapter_idx, audio_ms, char_offset, confidence FROM anchors
    UNION ALL SELECT book_id, chapter_idx, start_ms, text_start, 0.2 FROM chapters UNION ALL SELECT book_id, chapter_idx, end_ms, text_end, 0.2 FROM chapters""")


def guessed(t: Tables):
    return t.anchors.drop("event_id").unionByName(A.boundaries(t.chapters))


@query("anc_opening_restart", """WITH f AS (SELECT book_id, chapter_idx, min(audio_ms) AS t, min_by(char_offset, audio_ms) AS c FROM guessed WHERE confidence > 0.2 GROUP BY 1, 2),
    m AS (SELECT f.book_id, f.chapter_idx, start_ms, CAST(least(greatest(c - greatest(1, round_even(0.015::DOUBLE * (t - start_ms), 0)), 0), c) AS INT) AS target, c, t FROM f JOIN chapters USING (book_id, chapter_idx)),
    k AS (SELECT * FROM m WHERE target < c AND t > start_ms)
    SELECT g.* FROM guessed g LEFT JOIN k USING (book_id, chapter_idx) WHERE NOT coalesce(g.audio_ms = k.start_ms AND NOT g.confidence > 0.2, false)
    UNION ALL SELECT book_id, chapter_idx, start_ms, target, 0.2 FROM k""".replace("WITH f AS", "SELECT * FROM (WITH f AS").replace("SELECT g.* FROM guessed", "SELECT g.book_id, g.chapter_idx, g.audio_ms, g.char_offset, g.confidence FROM guessed") + ")", ["guessed", "chapters"])
def _(t: Tables):
    return A.opening_restart(guessed(t), t.chapters)


@query("anc_rate_ema", """WITH o AS (SELECT a.book_id, a.chapter_idx, a.audio_ms, CAST(9000 AS DOUBLE) / 600000 AS init,
      CAST(char_offset - lag(char_offset) OVER w AS DOUBLE) / nullif(audio_ms - lag(audio_ms) OVER w, 0) AS v FROM maps a WINDOW w AS (PARTITION BY book_id, chapter_idx ORDER BY audio_ms)),
    x AS (SELECT *, least(greatest(v, init / 5), init * 5) AS cv, row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY audio_ms DESC) - 1 AS i FROM o WHERE v > 0),
    s AS (SELECT book_id, chapter_idx, sum(cv * 0.5 * power(0.5::DOUBLE, i)) AS s, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT c.book_id, c.chapter_idx, coalesce(n, 0) AS steps, round(coalesce(s, 0) + 0.015::DOUBLE * power(0.5::DOUBLE, coalesce(n, 0)), 9) AS rate FROM chapters c LEFT JOIN s USING (book_id, chapter_idx)""".replace("WITH o AS", "SELECT * FROM (WITH o AS") + ")", ["maps", "chapters"])
def _(t: Tables):
    return A.rate_ema(t.maps.drop("event_id"), t.chapters).withColumn("rate", F.round("rate", 9))


@query("anc_predict", f"""SELECT p.event_id, p.book_id, p.chapter_idx, p.at_ms, CAST(CASE WHEN b.n > 1 AND p.at_ms BETWEEN b.first_ms AND b.last_ms THEN {MS_TO_CHAR.format(t='p.at_ms')}
      WHEN b.n > 1 AND abs(p.at_ms - b.last_ms) <= 120000 THEN trunc(b.last_char + 0.015::DOUBLE * (p.at_ms - b.last_ms))
      WHEN c.text_start IS NOT NULL THEN trunc(c.text_start + 0.015::DOUBLE * (p.at_ms - c.start_ms)) ELSE trunc(k.text_length * (CAST(p.at_ms AS DOUBLE) / k.duration_ms)) END AS INT) AS char_offset
    FROM pt p JOIN timeline_books k ON k.book_id = p.book_id LEFT JOIN chapters c ON c.book_id = p.book_id AND c.chapter_idx = p.chapter_idx
    LEFT JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.chapter_idx LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.chapter_idx AND p.at_ms >= s.a AND p.at_ms < s.b""",
       ["pt", "bounds", "seg_ms", "chapters", "timeline_books"])
def _(t: Tables):
    return A.predict(points(t), t.maps, t.chapters, t.timeline_books).select("event_id", "book_id", "chapter_idx", "at_ms", "char_offset")


def heaviest_sql(source: str, keys: str, x: str, y: str, weight: str, on_equal: str) -> str:
    """The heaviest rising chain per group, row by row with everything before it looked at; ``on_equal`` says when a later one of equal sum wins."""
    better = f"lambda p, q: CASE WHEN p = 0 OR bs[q] > bs[p] OR (bs[q] = bs[p] AND {on_equal}) THEN q ELSE p END"
    order = f"ORDER BY {x}, {y}, {weight}"
    return f"""SELECT * FROM (WITH RECURSIVE
      l AS (SELECT {keys}, list({x} {order}) AS xs, list({y} {order}) AS ys, list({weight} {order}) AS ws FROM ({source}) GROUP BY ALL),
      s AS (SELECT {keys}, xs, ys, ws, 0 AS n, []::DOUBLE[] AS bs, []::INT[] AS cs FROM l
        UNION ALL SELECT {keys}, xs, ys, ws, n + 1, list_append(bs, ws[n + 1] + CASE WHEN c > 0 THEN bs[c] ELSE 0 END), list_append(cs, c) FROM (
          SELECT *, list_reduce(list_prepend(0, list_filter(range(1, n + 1), lambda i: xs[i] < xs[n + 1] AND ys[i] < ys[n + 1])), {better})::INT AS c FROM s WHERE n < len(xs))),
      f AS (SELECT {keys}, xs, ys, ws, cs, list_reduce(range(1, n + 1), {better})::INT AS k FROM s WHERE n = len(xs)),
      g AS (SELECT * FROM f UNION ALL SELECT {keys}, xs, ys, ws, cs, cs[k] FROM g WHERE cs[k] > 0)
      SELECT {keys}, xs[k] AS {x}, ys[k] AS {y}, ws[k] AS {weight} FROM g)"""


def consistent_sql(source: str) -> str:
    run = heaviest_sql(f"SELECT * FROM ({source}) WHERE confidence > 0", "book_id, chapter_idx", "audio_ms", "char_offset", "confidence", "false")
    return f"""{run} UNION ALL SELECT book_id, chapter_idx, m.audio_ms, m.char_offset, m.confidence FROM (
      SELECT book_id, chapter_idx, arg_min({{'audio_ms': audio_ms, 'char_offset': char_offset, 'confidence': confidence}}, (audio_ms, char_offset)) AS m FROM ({source}) GROUP BY 1, 2 HAVING max(confidence) <= 0)"""


@query("anc_consistent_run", consistent_sql("SELECT book_id, chapter_idx, audio_ms, char_offset, confidence FROM anchors"), ["anchors"])
def _(t: Tables):
    return A.consistent_run(t.anchors.drop("event_id"))


# Every anchor is the window's: what the map took is accepted, the rest refused.
register_sql("outvoted", ["anchors", "maps"], """SELECT book_id, chapter_idx FROM (SELECT book_id, chapter_idx, count(m.event_id) AS a, count(*) - count(m.event_id) AS r
    FROM anchors x LEFT JOIN (SELECT event_id FROM maps) m USING (event_id) GROUP BY 1, 2) WHERE r > a AND r > 1""")


@query("anc_merge_disagreement", f"""SELECT book_id, chapter_idx, audio_ms, char_offset, confidence FROM maps ANTI JOIN outvoted USING (book_id, chapter_idx)
    UNION ALL {consistent_sql("SELECT book_id, chapter_idx, audio_ms, char_offset, confidence FROM anchors SEMI JOIN outvoted USING (book_id, chapter_idx)")}""", ["anchors", "maps", "outvoted"])
def _(t: Tables):
    a = t.anchors.drop("event_id")
    refused = t.anchors.join(t.maps.select("event_id"), "event_id", "left_anti").drop("event_id")
    return A.merge_disagreement(t.maps.drop("event_id"), t.maps.drop("event_id"), refused.select(*a.columns))


register_sql("some_lengths", ["all_chapters"], "SELECT book_id, chapter_idx, CAST(chapter_idx * 600000 AS BIGINT) AS start_ms, CAST(chapter_idx * 600000 + (book_id * 7 + chapter_idx * 13) % 11 * 50000 AS BIGINT) AS end_ms FROM all_chapters")


@query("anc_est_chapter_end", """WITH RECURSIVE c AS (SELECT *, end_ms - start_ms AS ms, sum(end_ms - start_ms) OVER (PARTITION BY book_id ORDER BY chapter_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM some_lengths),
    f AS (SELECT c.book_id, chapter_idx, 0 AS text_start, CASE WHEN rest <= 0 OR ms <= 0 THEN text_length ELSE CAST(round_even(text_length * least(CAST(ms AS DOUBLE) / rest, 1.0), 0) AS INT) END AS text_end, text_length
        FROM c JOIN timeline_books b ON b.book_id = c.book_id WHERE chapter_idx = 0
      UNION ALL SELECT c.book_id, c.chapter_idx, f.text_end, CASE WHEN c.rest <= 0 OR c.ms <= 0 THEN f.text_length ELSE f.text_end + CAST(round_even((f.text_length - f.text_end) * least(CAST(c.ms AS DOUBLE) / c.rest, 1.0), 0) AS INT) END, f.text_length
        FROM f JOIN c ON c.book_id = f.book_id AND c.chapter_idx = f.chapter_idx + 1)
    SELECT book_id, chapter_idx, text_start, text_end FROM f""".replace("WITH RECURSIVE c", "SELECT * FROM (WITH RECURSIVE c") + ")", ["some_lengths", "timeline_books"])
def _(t: Tables):
    c = all_chapters(t).withColumn("start_ms", F.expr("cast(chapter_idx * 600000 as bigint)")).withColumn(
        "end_ms", F.expr("cast(chapter_idx * 600000 + (book_id * 7 + chapter_idx * 13) % 11 * 50000 as bigint)"))
    return A.est_chapter_end(c, t.timeline_books)


@query("anc_fit_chapter_end", """SELECT c.book_id, c.chapter_idx, coalesce(c0, text_start) AS text_start, CASE WHEN n IS NULL THEN text_end WHEN n > 1 AND t1 > t0 AND c1 > c0
      THEN c1 + CAST(round_even(CAST(c1 - c0 AS DOUBLE) / (t1 - t0) * (end_ms - t1), 0) AS INT) ELSE greatest(c1, text_end) END AS text_end, n IS NOT NULL AS measured
    FROM chapters c LEFT JOIN (SELECT book_id, chapter_idx, count(*) AS n, min(audio_ms) AS t0, max(audio_ms) AS t1, min(char_offset) AS c0, max(char_offset) AS c1 FROM maps WHERE confidence > 0.2 GROUP BY 1, 2) USING (book_id, chapter_idx)""", ["chapters", "maps"])
def _(t: Tables):
    return A.fit_chapter_end(t.maps, t.chapters)


# A book map whose openings are squeezed: times of the first characters of every part are pulled back.
register_sql("squeezed", ["sentences"], """SELECT book_id, CAST(audio_ms AS BIGINT) AS audio_ms, char_offset, 1.0::DOUBLE AS confidence FROM (
    SELECT book_id, start AS char_offset, CASE WHEN start % 9000 < 900 AND start >= 9000 THEN (start // 9000) * 600000 - 25000 + (start % 9000) * 5 ELSE start * 1000 // 15 END AS audio_ms FROM sentences)""")
register_sql("repaired", ["squeezed"], """SELECT * FROM (WITH
    a AS (SELECT *, lead(char_offset) OVER w AS nc, lead(audio_ms) OVER w AS nt, lag(audio_ms) OVER w AS pt FROM squeezed WINDOW w AS (PARTITION BY book_id ORDER BY char_offset)),
    st AS (SELECT DISTINCT book_id, char_offset // 9000 * 9000 AS start FROM squeezed WHERE char_offset >= 9000),
    fi AS (SELECT s.book_id, s.start, min(a.char_offset) AS fc, min_by(a.audio_ms, a.char_offset) AS ft, min_by(a.pt, a.char_offset) AS before FROM st s JOIN a ON a.book_id = s.book_id AND a.char_offset >= s.start GROUP BY 1, 2),
    br AS (SELECT f.book_id, f.start, min(a.char_offset) AS lc, min_by(a.audio_ms, a.char_offset) AS lt, min_by(a.nc, a.char_offset) AS ac, min_by(a.nt, a.char_offset) AS at_ms FROM fi f JOIN a ON a.book_id = f.book_id AND a.char_offset >= f.fc AND a.nc - f.start <= 3000 AND a.nt - a.audio_ms > 15000 GROUP BY 1, 2),
    q AS (SELECT *, coalesce(before, 0) AS b0, at_ms - CAST(trunc((ac - start) / 15.0::DOUBLE * 1000) AS BIGINT) AS est FROM br JOIN fi USING (book_id, start) WHERE lc - start >= 100 AND (lc - start) / greatest((lt - ft) / 1000.0::DOUBLE, 0.001) >= 40),
    mk AS (SELECT q.book_id, q.start, min_by(m, abs(m - est) * 10000000000 + m) AS mark FROM q, (SELECT i * 600000 AS m FROM range(1, 6) r(i)) WHERE m > b0 AND m < at_ms AND abs(m - est) < 30000 GROUP BY 1, 2),
    n AS (SELECT q.*, least(greatest(coalesce(mark, est), b0 + 1), at_ms - 1) AS new_ms FROM q LEFT JOIN mk USING (book_id, start))
    SELECT s.book_id, s.audio_ms, s.char_offset, s.confidence FROM squeezed s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.book_id = s.book_id AND s.char_offset BETWEEN n.fc AND n.lc)
    UNION ALL SELECT book_id, new_ms, CAST(start AS INT), 1.0 FROM n)""")


def squeezed(t: Tables):
    return t.sentences.select(
        "book_id", F.expr("cast(case when start % 9000 < 900 and start >= 9000 then (start div 9000) * 600000 - 25000 + (start % 9000) * 5 else start * 1000 div 15 end as bigint)").alias("audio_ms"),
        F.col("start").alias("char_offset"), F.lit(1.0).alias("confidence"))


def repaired(t: Tables):
    s = squeezed(t)
    starts = s.filter("char_offset >= 9000").select("book_id", F.expr("cast(char_offset div 9000 * 9000 as int)").alias("start")).distinct()
    marks = starts.select("book_id").distinct().select("book_id", F.explode(F.expr("transform(sequence(1, 5), i -> cast(i * 600000 as bigint))")).alias("mark_ms"))
    return A.repair_openings(s, starts, marks)


@query("anc_repair_openings", "SELECT * FROM repaired", ["repaired"])
def _(t: Tables):
    return repaired(t)


register_sql("clips", ["squeezed", "sentences"], """SELECT s.book_id, s.idx, s.start, q.audio_ms AS begin_ms, q.audio_ms + 3000 AS end_ms FROM sentences s JOIN squeezed q ON q.book_id = s.book_id AND q.char_offset = s.start""")


@query("anc_retimed_clips", """WITH r AS (SELECT book_id, char_offset AS x, audio_ms AS a, lead(char_offset) OVER w AS y, lead(audio_ms) OVER w AS b FROM repaired WINDOW w AS (PARTITION BY book_id ORDER BY char_offset)),
    g AS (SELECT book_id, min(char_offset) AS x0, min_by(audio_ms, char_offset) AS a0 FROM repaired GROUP BY 1),
    c AS (SELECT c.*, CASE WHEN c.start < g.x0 THEN g.a0 WHEN r.x = c.start OR r.y IS NULL THEN r.a ELSE r.a + CAST(trunc((r.b - r.a) * CAST(c.start - r.x AS DOUBLE) / (r.y - r.x)) AS BIGINT) END AS nb
      FROM clips c JOIN g ON g.book_id = c.book_id LEFT JOIN r ON r.book_id = c.book_id AND c.start >= r.x AND (r.y IS NULL OR c.start < r.y)),
    e AS (SELECT *, nb <> begin_ms AS moved, lead(nb) OVER w AS nn, lead(begin_ms) OVER w AS old_next FROM c WINDOW w AS (PARTITION BY book_id ORDER BY start))
    SELECT book_id, idx, start, nb AS begin_ms, z AS end_ms, moved FROM (SELECT *, CASE WHEN nn IS NULL THEN end_ms WHEN moved OR end_ms >= old_next THEN nn ELSE least(end_ms, nn) END AS z FROM e) WHERE z > nb""".replace("WITH r AS", "SELECT * FROM (WITH r AS") + ")", ["repaired", "clips"])
def _(t: Tables):
    from versoline.operators import primitives as P

    clips = t.sentences.join(squeezed(t).select("book_id", F.col("char_offset").alias("start"), F.col("audio_ms").alias("begin_ms")), ["book_id", "start"]).select(
        "book_id", "idx", "start", "begin_ms", (F.col("begin_ms") + 3000).alias("end_ms"))
    return A.retimed_clips(clips, P.stage(repaired(t)))


register_sql("split_kept", ["anchors"], """SELECT book_id, chapter_idx, audio_ms, char_offset, confidence FROM (SELECT *, max(char_offset) OVER (PARTITION BY book_id, chapter_idx ORDER BY audio_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM anchors) WHERE m IS NULL OR char_offset > m""")


@query("anc_split_by_chapter", """WITH s AS (SELECT c.book_id, c.chapter_idx, k.s FROM all_chapters c LEFT JOIN (SELECT book_id, chapter_idx, min(char_offset) AS s FROM split_kept GROUP BY 1, 2) k USING (book_id, chapter_idx)),
    w AS (SELECT *, max(s) OVER (PARTITION BY book_id ORDER BY chapter_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, first_value(s IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY chapter_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s)
    SELECT book_id, chapter_idx, CASE WHEN s IS NOT NULL THEN CASE WHEN seen IS NULL THEN 0 ELSE s END END AS text_start, CASE WHEN s IS NOT NULL THEN coalesce(nxt, text_length) END AS text_end FROM w JOIN timeline_books USING (book_id)""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")", ["all_chapters", "split_kept", "timeline_books"])
def _(t: Tables):
    c = all_chapters(t).select("book_id", "chapter_idx", F.expr("cast(chapter_idx * 600000 as bigint)").alias("start_ms"), F.expr("cast(chapter_idx * 600000 + 600000 as bigint)").alias("end_ms"))
    return A.split_by_chapter(t.anchors.drop("event_id", "chapter_idx"), c, t.timeline_books)[1]
