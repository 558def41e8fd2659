"""Registered queries that locate passages and letters (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from versoline.operators import locate as Q
from versoline.plans.building import heaviest_sql
from versoline.plans.registry import query
from versoline.plans.timeline import CHAR_TO_MS
from versoline.plans.views import Tables, register_sql


def passages(t: Tables):
    return t.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


register_sql("voted", ["tokens", "qwords"], """SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, doc_id, band) AS r FROM (
      SELECT query_id, doc_id, CAST(floor((tok_idx - q_idx) / 8.0) AS BIGINT) AS band, count(*) AS votes, min(tok_idx) AS lo, max(tok_idx) AS hi
      FROM (SELECT * FROM (SELECT query_id, q_idx, value || ' ' || lead(value) OVER w || ' ' || lead(value, 2) OVER w AS g FROM qwords WINDOW w AS (PARTITION BY query_id ORDER BY q_idx)) WHERE g IS NOT NULL) q
      JOIN (SELECT doc_id, tok_idx, value || ' ' || lead(value) OVER w || ' ' || lead(value, 2) OVER w AS g FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)) d USING (g) GROUP BY 1, 2, 3)) WHERE r = 1""")


def voted(t: Tables):
    return Q.seed_vote(passages(t), t.table("documents"))


@query("loc_seed_vote", "SELECT * FROM voted", ["voted"])
def _(t: Tables):
    return voted(t)


# Where a passage may lie: the most that a stretch of a document can win, 2 per word of the passage and -1 per other word.
register_sql("q_sizes", ["qwords"], "SELECT query_id, count(*) AS n FROM qwords GROUP BY 1")
register_sql("most", ["tokens", "qwords"], """SELECT query_id, doc_id, max(v - low) + 2 AS most FROM (
    SELECT query_id, doc_id, v, min(v) OVER (PARTITION BY query_id, doc_id ORDER BY k) AS low FROM (
      SELECT query_id, doc_id, row_number() OVER w AS k, 3 * row_number() OVER w - tok_idx AS v
      FROM tokens JOIN (SELECT DISTINCT query_id, value FROM qwords) USING (value) WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY tok_idx))) GROUP BY 1, 2""")


def aligned_sql(windows: str, enough: str) -> str:
    """Best local alignment per row of ``windows(query_id, doc_id, lo, hi)``, a row of cells per word of the passage; ``enough`` of score and n.

    A cell's score and place, and where its alignment starts, are digits of one number, 24 bits each, so that a running maximum carries them on.
    """
    return f"""SELECT query_id, doc_id, score, CAST(n AS INT) AS n, CAST(lo + wf AS INT) AS tok, CAST(lo + i - 1 AS INT) AS last_tok, CAST(qf AS INT) AS q_start, CAST(j AS INT) AS q_end FROM (
      SELECT query_id, doc_id, n, unnest(arg_max({{'score': score, 'lo': lo, 'i': i, 'wf': wf, 'qf': qf, 'j': j}}, (score, -j, -i))) FROM (WITH RECURSIVE
        qw AS MATERIALIZED (SELECT query_id, q_idx, value FROM qwords), win AS MATERIALIZED (SELECT w.query_id, w.doc_id, w.lo, t.tok_idx - w.lo + 1 AS i, t.value FROM ({windows}) w JOIN tokens t ON t.doc_id = w.doc_id AND t.tok_idx >= w.lo AND t.tok_idx < w.hi),
        dp AS (SELECT query_id, doc_id, lo, i, value, -1 AS j, 0 AS score, 0 AS wf, 0 AS qf FROM win UNION ALL SELECT DISTINCT query_id, doc_id, lo, 0, NULL, -1, 0, 0, 0 FROM win
          UNION ALL SELECT query_id, doc_id, lo, i, value, j, CAST(top // 4722366482869645213696 - i AS INT), CAST(top // 16777216 % 16777216 AS INT), CAST(top % 16777216 AS INT) FROM (
            SELECT *, max(((greatest(CASE WHEN up THEN score - 1 ELSE d END, 0) + i)::HUGEINT * 16777216 + i) * 281474976710656 + CASE WHEN up THEN wf WHEN ps > 0 THEN pw ELSE greatest(i - 1, 0) END * 16777216::HUGEINT
              + CASE WHEN up THEN qf WHEN ps > 0 THEN pq ELSE j END) OVER (PARTITION BY query_id, doc_id, lo ORDER BY i) AS top FROM (
              SELECT *, score > 0 AND score - 1 > d AS up FROM (
                SELECT dp.query_id, doc_id, lo, i, dp.value, j + 1 AS j, score, wf, qf, lag(score) OVER w AS ps, lag(wf) OVER w AS pw, lag(qf) OVER w AS pq,
                  coalesce(lag(score) OVER w + CASE WHEN dp.value = q.value THEN 2 ELSE -1 END, 0) AS d
                FROM dp JOIN qw q ON q.query_id = dp.query_id AND q.q_idx = dp.j + 1 WINDOW w AS (PARTITION BY dp.query_id, doc_id, lo ORDER BY i)))))
        SELECT dp.*, n FROM dp JOIN q_sizes USING (query_id) WHERE j >= 0 AND score >= {enough}) GROUP BY 1, 2, 3)"""


def confident_sql(found: str, least: float) -> str:
    return f"SELECT *, CAST(score / (n * 2) AS FLOAT) AS confidence FROM ({found}) WHERE CAST(score / (n * 2) AS FLOAT) >= CAST({least} AS FLOAT)"


def placed_sql(found: str) -> str:
    """Word places as places in the text, by the lengths of words and of what lies between them."""
    return f"SELECT f.*, CAST(starts[tok + 1] AS INT) AS char_offset, CAST(ends[last_tok + 1] AS INT) AS end_offset FROM ({found}) f JOIN word_places USING (doc_id)"


register_sql("word_places", [], r"""SELECT doc_id, list(s ORDER BY i) AS starts, list(s + len ORDER BY i) AS ends FROM (
    SELECT doc_id, i, v, length(v) AS len, sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) AS s FROM (
      SELECT doc_id, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Nd}''’]+|[^\p{L}\p{Nd}''’]+') AS p FROM documents)))
    WHERE regexp_matches(v, '[\p{L}\p{Nd}]') GROUP BY 1""")

_ANYWHERE = "SELECT m.query_id, m.doc_id, 0 AS lo, 1000000000 AS hi FROM most m JOIN q_sizes USING (query_id) WHERE most >= {0}"
register_sql("matched", ["most", "q_sizes", "qwords", "tokens"], confident_sql(aligned_sql(_ANYWHERE.format("ceil(n * 2 * (0.45 - 1e-6))"), "n * 2 * (0.45 - 1e-6)"), 0.45))
_MATCHED = ["matched", "word_places"]


@query("loc_match", placed_sql("SELECT * FROM matched"), _MATCHED)
def _(t: Tables):
    return Q.match(passages(t), t.table("documents"))


@query("loc_match_near", placed_sql(confident_sql(aligned_sql("SELECT query_id, doc_id, greatest(lo + 25 - 120, 0) AS lo, lo + 25 + 120 + n AS hi FROM voted JOIN q_sizes USING (query_id)", "1"), 0.45)),
       ["voted", "qwords", "q_sizes", "tokens", "word_places"])
def _(t: Tables):
    expected = voted(t).select("query_id", "doc_id", (F.col("lo") + 25).alias("tok_idx"))
    return Q.match_near(expected, passages(t), t.table("documents"), 120)


register_sql("sure_matches", ["matched"], "SELECT * FROM matched WHERE n >= 10 AND confidence >= CAST(0.6 AS FLOAT)")
register_sql("rivals", ["sure_matches", "qwords", "q_sizes", "tokens"], confident_sql(aligned_sql(
    """SELECT query_id, doc_id, 0 AS lo, greatest(tok - 2 * n, 0) AS hi FROM sure_matches UNION ALL SELECT query_id, doc_id, tok + 3 * n, 1000000000 FROM sure_matches""", "n * 2 * (0.6 - 1e-6)"), 0.6))


@query("loc_unambiguous", placed_sql("""SELECT m.*, coalesce(r.confidence, CAST(0 AS FLOAT)) AS rival FROM sure_matches m LEFT JOIN rivals r USING (query_id, doc_id)
    WHERE NOT coalesce(r.confidence, CAST(0 AS FLOAT)) >= m.confidence - CAST(0.1 AS FLOAT)"""), ["sure_matches", "rivals", "word_places"])
def _(t: Tables):
    return Q.unambiguous(passages(t), t.table("documents"))


@query("loc_page", f"""SELECT query_id, doc_id, char_offset, end_offset, confidence FROM (SELECT *, CAST(least(CAST(CAST(score / (n * 2) AS FLOAT) * n AS DOUBLE) / (q_end - q_start + 1), 1.0) AS FLOAT) AS confidence
    FROM ({placed_sql(aligned_sql(_ANYWHERE.format("22 AND n >= 12"), "22"))})) WHERE q_end - q_start + 1 >= 20 AND confidence >= CAST(0.55 AS FLOAT)""", ["most", "q_sizes", "qwords", "tokens", "word_places"])
def _(t: Tables):
    return Q.page(passages(t), t.table("documents"))


# A passage and the document it was voted into, as two letter strings.
_LETTERS = """regexp_replace(replace(replace(replace(replace(translate(strip_accents(lower(translate({0}, '’‘ʼ', ''''''''))), 'đøł', 'dol'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), '[^aienoutsrmkldghybpwcvjzf''qx]', '', 'g')"""
register_sql("pair_letters", ["voted"], f"""SELECT query_id AS pair_id, {_LETTERS.format('d.text')} AS l, {_LETTERS.format('b.text')} AS r
    FROM voted v JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = v.query_id""")


def _grams(side: str) -> str:
    return f"""SELECT pair_id, substr({side}, i + 1, 10) AS run, min(i) AS pos FROM (SELECT pair_id, {side}, unnest(generate_series(0, length({side}) - 10)) AS i FROM pair_letters WHERE length({side}) >= 10) GROUP BY 1, 2 HAVING count(*) = 1"""


register_sql("unique_pairs", ["pair_letters"], f"""SELECT l.pair_id, run, CAST(l.pos AS INT) AS l_pos, CAST(r.pos AS INT) AS r_pos FROM ({_grams('l')}) l JOIN ({_grams('r')}) r USING (pair_id, run)""")


def unique_pairs(t: Tables):
    from versoline.operators import primitives as P

    v = P.stage(voted(t).select("query_id", "doc_id"))
    left = v.join(t.table("documents"), "doc_id").select(F.col("query_id").alias("pair_id"), Q.letter_string(F.col("text")).alias("letters"))
    right = passages(t).join(v, "query_id", "left_semi").select(F.col("query_id").alias("pair_id"), Q.letter_string(F.col("text")).alias("letters"))
    return Q.unique_runs(left, right)


@query("loc_unique_runs", "SELECT * FROM unique_pairs", ["unique_pairs"])
def _(t: Tables):
    return unique_pairs(t)


# Among chains of equal length the lower place on the left wins, as in the operator.
@query("loc_chain", f"""SELECT c.pair_id, u.run, c.l_pos, c.r_pos FROM ({heaviest_sql("SELECT pair_id, r_pos, l_pos, 1::DOUBLE AS one FROM unique_pairs", "pair_id", "r_pos", "l_pos", "one", "ys[q] < ys[p]")}) c
    JOIN unique_pairs u USING (pair_id, r_pos, l_pos)""", ["unique_pairs"])
def _(t: Tables):
    return Q.chain(unique_pairs(t))


# Map anchors as pairs of a letter and a frame.
_PASS = """SELECT book_id, chapter_idx, letter, frame FROM (SELECT *, (frame - lag(frame) OVER w) * 20 / 1000.0::DOUBLE AS s0, (letter - lag(letter) OVER w) AS d0, (lead(frame) OVER w - frame) * 20 / 1000.0::DOUBLE AS s1, (lead(letter) OVER w - letter) AS d1
    FROM {0} WINDOW w AS (PARTITION BY book_id, chapter_idx ORDER BY frame)) WHERE NOT (coalesce(s0 >= 2 AND NOT (d0 / s0 BETWEEN 4 AND 30), false) AND coalesce(s1 >= 2 AND NOT (d1 / s1 BETWEEN 4 AND 30), false))"""
register_sql("letter_frames", ["maps"], "SELECT book_id, chapter_idx, min(char_offset) AS letter, audio_ms // 20 AS frame FROM maps GROUP BY book_id, chapter_idx, audio_ms // 20")
register_sql("pass1", ["letter_frames"], _PASS.format("letter_frames"))
register_sql("pass2", ["pass1"], _PASS.format("pass1"))
register_sql("pass3", ["pass2"], _PASS.format("pass2"))


def letter_frames(t: Tables):
    return t.maps.groupBy("book_id", "chapter_idx", F.expr("audio_ms div 20").alias("frame")).agg(F.min("char_offset").alias("letter"))


@query("loc_drop_implausible", "SELECT * FROM pass3", ["pass3"])
def _(t: Tables):
    return Q.drop_implausible(letter_frames(t), ["book_id", "chapter_idx"]).select("book_id", "chapter_idx", "letter", "frame")




@query("loc_segments", """WITH RECURSIVE pick AS (
      SELECT book_id, chapter_idx, min(frame) AS frame FROM letter_frames GROUP BY 1, 2
      UNION ALL SELECT p.book_id, p.chapter_idx, (SELECT min(f.frame) FROM letter_frames f WHERE f.book_id = p.book_id AND f.chapter_idx = p.chapter_idx AND f.frame >= p.frame + 1000) FROM pick p WHERE p.frame IS NOT NULL),
    c AS (SELECT f.* FROM letter_frames f JOIN pick USING (book_id, chapter_idx, frame)),
    w AS (SELECT *, lag(letter) OVER o AS pl, lead(letter) OVER o AS nl, lead(frame) OVER o AS nf FROM c WINDOW o AS (PARTITION BY book_id, chapter_idx ORDER BY frame)),
    parts AS (SELECT book_id, chapter_idx, 'inner' AS kind, letter AS a, nl AS z, greatest(frame - 1, 0) AS f0, greatest(greatest(frame - 1, 0) + 1, nf - 1) AS f1 FROM w WHERE nl IS NOT NULL
      UNION ALL SELECT book_id, chapter_idx, 'head', 0, letter, 0, frame FROM w WHERE pl IS NULL AND letter > 0
      UNION ALL SELECT book_id, chapter_idx, 'tail', letter, 60000, frame, 150000 FROM w WHERE nl IS NULL AND letter < 60000)
    SELECT book_id, chapter_idx, kind, CAST(a AS BIGINT) AS from_letter, CAST(z AS BIGINT) AS to_letter, CAST(f0 AS BIGINT) AS from_frame, CAST(f1 AS BIGINT) AS to_frame,
      CASE WHEN r > 30 THEN 'too fast' WHEN kind = 'inner' AND r < 4 THEN 'too slow' WHEN kind = 'inner' AND f1 - f0 > 30000 THEN 'too long' ELSE 'align' END AS verdict
    FROM (SELECT *, (z - a) / greatest((f1 - f0) * 20 / 1000.0::DOUBLE, 0.001) AS r FROM parts)""".replace("WITH RECURSIVE pick", "SELECT * FROM (WITH RECURSIVE pick") + ")", ["letter_frames"])
def _(t: Tables):
    f = letter_frames(t)
    ends = f.select("book_id", "chapter_idx").distinct().withColumn("letters", F.lit(60_000)).withColumn("frames", F.lit(150_000))
    return Q.segments(f, ends, ["book_id", "chapter_idx"]).drop("rate")


# Evidence windows: sure anchors heard for four seconds.
register_sql("evidence", ["ev"], """SELECT book_id, CAST(s * 15 // 1000 AS INT) AS open_char, min(s) AS open_ms, CAST(s * 15 // 1000 AS INT) + CAST(min(event_id) % 3 * 30 AS INT) AS close_char, min(s) + 4000 AS close_ms FROM ev GROUP BY 1, 2""".replace("GROUP BY 1, 2", "GROUP BY book_id, s * 15 // 1000"))


@query("loc_from_offset", f"""SELECT event_id, book_id, at_char, CAST(CASE WHEN inside THEN lo_ms + CAST(round_even(CAST(at_char - lo_c AS DOUBLE) / (lo_z - lo_c) * (lo_e - lo_ms), 0) AS BIGINT)
      WHEN near THEN landing WHEN m IS NOT NULL THEN m WHEN e_c IS NOT NULL THEN landing ELSE CAST(trunc(duration_ms * (CAST(at_char AS DOUBLE) / text_length)) AS BIGINT) END AS BIGINT) AS audio_ms,
      CASE WHEN inside THEN 'inside' WHEN near THEN 'near' WHEN m IS NOT NULL THEN 'map' WHEN e_c IS NOT NULL THEN 'far' ELSE 'share' END AS method FROM (
    SELECT *, coalesce(lo_z >= at_char AND lo_z > lo_c, false) AS inside, coalesce(abs(at_char - e_c) <= 200, false) AS near,
      e_ms + CAST(trunc((at_char - e_c) / greatest(CASE WHEN e_e > e_ms AND e_z > e_c THEN CAST(e_z - e_c AS DOUBLE) / (e_e - e_ms) ELSE CAST(text_length AS DOUBLE) / duration_ms END, 0.001)) AS BIGINT) AS landing FROM (
      SELECT *, CASE WHEN u THEN lo_c ELSE hi_c END AS e_c, CASE WHEN u THEN lo_ms ELSE hi_ms END AS e_ms, CASE WHEN u THEN lo_z ELSE hi_z END AS e_z, CASE WHEN u THEN lo_e ELSE hi_e END AS e_e FROM (
        SELECT p.event_id, p.book_id, p.at_char, k.duration_ms, k.text_length, CASE WHEN b.n > 1 AND p.at_char BETWEEN b.first_char AND b.last_char THEN {CHAR_TO_MS.format(c='p.at_char')} END AS m,
          x.open_char AS lo_c, x.open_ms AS lo_ms, x.close_char AS lo_z, x.close_ms AS lo_e, y.open_char AS hi_c, y.open_ms AS hi_ms, y.close_char AS hi_z, y.close_ms AS hi_e,
          x.open_char IS NOT NULL AND (y.open_char IS NULL OR p.at_char - x.open_char <= y.open_char - p.at_char) AS u
        FROM pt p JOIN timeline_books k ON k.book_id = p.book_id LEFT JOIN bounds b ON b.book_id = p.book_id AND b.chapter_idx = p.text_chapter
        LEFT JOIN seg_ms s ON s.book_id = p.book_id AND s.chapter_idx = p.text_chapter AND p.at_char >= s.x AND p.at_char < s.y
        ASOF LEFT JOIN evidence x ON x.book_id = p.book_id AND p.at_char >= x.open_char ASOF LEFT JOIN evidence y ON y.book_id = p.book_id AND p.at_char < y.open_char)))""",
       ["pt", "bounds", "seg_ms", "evidence", "timeline_books"])
def _(t: Tables):
    e = t.ev.groupBy("book_id", F.expr("cast(s * 15 div 1000 as int)").alias("open_char")).agg(
        F.min("s").alias("open_ms"), F.min("event_id").alias("i")).select(
        "book_id", "open_char", "open_ms", F.expr("open_char + cast(i % 3 * 30 as int)").alias("close_char"), (F.col("open_ms") + 4000).alias("close_ms"))
    return Q.from_offset(t.points, e, t.maps, t.chapters, t.timeline_books).select("event_id", "book_id", "at_char", "audio_ms", "method")
