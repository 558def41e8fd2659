"""Registered queries over text and tokens (survey 2.3 and 2.4)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import primitives as P
from versoline.operators import texts as T
from versoline.operators import tokens as K
from versoline.plans.registry import query
from versoline.plans.views import Tables, register_sql


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _html_sql() -> str:
    e = "html"
    for pattern, to in T.HTML_STEPS:
        e = f"regexp_replace({e}, {sql_text(pattern)}, {sql_text(to)}, 'g')"
    names = ", ".join(f"'{n}': {v}" for n, v in {**name2codepoint, "apos": 39}.items())
    code = f"""CASE WHEN regexp_matches(x, '^&#[xX]') THEN CAST('0x' || regexp_extract(x, '[xX]([0-9a-fA-F]+);$', 1) AS INT)
        WHEN regexp_matches(x, '^&#') THEN CAST(regexp_extract(x, '([0-9]+);$', 1) AS INT) ELSE MAP {{{names}}}[x[2:-2]] END"""
    e = (f"array_to_string(list_transform(regexp_extract_all({e}, '&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&'), "
         f"lambda x: CASE WHEN regexp_matches(x, '^&.*;$') THEN coalesce(chr({code}), x) ELSE x END), '')")
    for pattern, to in T.HTML_TIDY:
        e = f"regexp_replace({e}, {sql_text(pattern)}, {sql_text(to)}, 'g')"
    return e


register_sql("page_text", [], f"SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS book, {_html_sql()} AS text FROM pages")


def page_text(t: Tables):
    return t.table("pages").select(
        "page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("book"), T.html_to_text(F.col("html")).alias("text"))


@query("txt_html_to_text", "SELECT page_id, text FROM page_text", ["page_text"])
def _(t: Tables):
    return page_text(t).select("page_id", "text")


@query("txt_concat_stream", """SELECT book, page_id, CAST(e - n AS BIGINT) AS text_start, CAST(e AS BIGINT) AS text_end FROM (
    SELECT book, page_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY book ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS e FROM page_text)""",
       ["page_text"])
def _(t: Tables):
    return T.concat_ranges(page_text(t).select("book", "page_id", F.length("text").alias("n")), "book", "page_id", F.col("n").cast("bigint")).select(
        "book", "page_id", "text_start", "text_end")


@query("txt_sentences")
def _(t: Tables):
    return T.sentences(t.table("documents"))


@query("txt_sentence_pieces", """SELECT book_id, range_id, start, "end", sentence_idx FROM (
    SELECT c.book_id, c.range_id, c.e AS start, coalesce(lead(c.e) OVER (PARTITION BY c.book_id, c.range_id ORDER BY c.e), c.z) AS "end",
      (SELECT max(s.idx) FROM sentences s WHERE s.book_id = c.book_id AND s.start <= c.e AND s."end" > c.e) AS sentence_idx
    FROM (SELECT DISTINCT book_id, range_id, e, z FROM (
      SELECT book_id, spine_idx AS range_id, text_start AS e, text_end AS z FROM spine
      UNION ALL SELECT r.book_id, r.spine_idx, b.e, r.text_end FROM spine r JOIN (
        SELECT book_id, start AS e FROM sentences UNION SELECT book_id, "end" FROM sentences) b
        ON b.book_id = r.book_id AND b.e > r.text_start AND b.e < r.text_end)) c)""", ["spine", "sentences"])
def _(t: Tables):
    ranges = t.spine.select("book_id", F.col("spine_idx").alias("range_id"), F.col("text_start").alias("start"), F.col("text_end").alias("end"))
    return T.sentence_pieces(ranges, t.sentences.select("book_id", "idx", "start", "end"), "book_id")


# Lines of documents laid out as a page of print, by formulas over their text and place.
register_sql("layout", ["lines"], """
    SELECT doc_id AS page_id, line, CAST(CASE WHEN length(text) % 7 = 0 THEN 90 ELSE 72 END AS DOUBLE) AS "left",
      CAST(200 + length(text) % 300 AS DOUBLE) AS "right", CAST(100000 - line * 14 - (line // 5) * 9 AS DOUBLE) AS bottom,
      CAST(10 AS DOUBLE) AS height, text FROM lines""")


def layout(t: Tables):
    return t.lines.select(
        F.col("doc_id").alias("page_id"), "line",
        F.expr("cast(case when length(text) % 7 = 0 then 90 else 72 end as double)").alias("left"),
        F.expr("cast(200 + length(text) % 300 as double)").alias("right"),
        F.expr("cast(100000 - line * 14 - (line div 5) * 9 as double)").alias("bottom"),
        F.lit(10.0).alias("height"), "text")


SQL_END = """regexp_matches({0}, '[.!?:…"”’»«]\\s*$')"""
SQL_COLLAPSE = "trim(regexp_replace({0}, '[\\s\\p{{Cc}}]+', ' ', 'g'))"


@query("txt_pdf_paragraphs", f"""SELECT page_id, CAST(para AS BIGINT) AS para,
    replace(regexp_replace(string_agg({SQL_COLLAPSE.format('text')}, chr(10) ORDER BY line), '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g'), chr(10), ' ') AS text FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY line) AS para FROM (
      SELECT l.*, CASE WHEN pb IS NULL OR (usual > 0 AND pb - bottom > usual * 1.4) OR "left" > margin + height * 0.8
          OR (pr < edge - height * 3 AND {SQL_END.format('pt')}) THEN 1 ELSE 0 END AS fresh
      FROM (SELECT *, lag(bottom) OVER w AS pb, lag("right") OVER w AS pr, lag(text) OVER w AS pt FROM layout WINDOW w AS (PARTITION BY page_id ORDER BY line)) l
      JOIN (SELECT page_id, min("left") AS margin, max("right") AS edge FROM layout GROUP BY 1) b USING (page_id)
      LEFT JOIN (SELECT page_id, list_sort(list(g))[count(*) // 2 + 1] AS usual FROM (
        SELECT page_id, lag(bottom) OVER (PARTITION BY page_id ORDER BY line) - bottom AS g FROM layout) WHERE g > 0 GROUP BY 1) u USING (page_id)))
    GROUP BY page_id, para""", ["layout"])
def _(t: Tables):
    return T.pdf_paragraphs(layout(t))


@query("txt_repeated_margins", """WITH sized AS (SELECT source, doc_id, count(*) AS n, min(line) AS head, max(line) AS foot FROM lines GROUP BY 1, 2),
    edges AS (SELECT l.source, l.doc_id, l.line, trim(lower(regexp_replace(l.text, '\\p{Nd}', '', 'g'))) AS key FROM lines l JOIN sized s USING (source, doc_id)
      WHERE s.n >= 2 AND l.line IN (s.head, s.foot) AND length(l.text) <= 80),
    rep AS (SELECT e.source, e.key FROM (SELECT source, key, count(DISTINCT doc_id) AS c FROM edges WHERE key <> '' GROUP BY 1, 2) e
      JOIN (SELECT source, count(*) AS p FROM sized GROUP BY 1) q USING (source) WHERE p >= 6 AND c >= p * 0.02)
    SELECT l.source AS book, l.doc_id AS page, l.line AS para, l.text FROM lines l WHERE NOT EXISTS (
      SELECT 1 FROM edges e JOIN rep r USING (source, key) WHERE e.source = l.source AND e.doc_id = l.doc_id AND e.line = l.line)""".replace("WITH sized", "SELECT * FROM (WITH sized") + ")", ["lines"])
def _(t: Tables):
    p = t.lines.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("line").alias("para"), "text")
    return T.repeated_margins(p, share=0.02)


@query("txt_page_join", f"""SELECT source AS book, doc_id AS page, line AS para, CAST(sum(fresh) OVER (PARTITION BY source ORDER BY doc_id, line) AS BIGINT) AS block FROM (
    SELECT *, CASE WHEN pp <> doc_id AND doc_id % 5 <> 0 AND pt <> '' AND text <> '' AND NOT {SQL_END.format('pt')} AND NOT regexp_matches(text, '^\\p{{Lu}}') THEN 0 ELSE 1 END AS fresh
    FROM (SELECT *, lag(text) OVER w AS pt, lag(doc_id) OVER w AS pp FROM lines WINDOW w AS (PARTITION BY source ORDER BY doc_id, line)))""", ["lines"])
def _(t: Tables):
    p = t.lines.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("line").alias("para"), "text")
    chapters = t.table("documents").filter("doc_id % 5 = 0").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    return T.page_join(p, chapters).select("book", "page", "para", "block")


_hits = ", ".join(f"len(list_filter(s, lambda x: x IN ({', '.join(sql_text(w) for w in ws)})))" for ws in T.SIGNATURES.values())
_codes = ", ".join(sql_text(k) for k in T.SIGNATURES)


@query("txt_language", f"""SELECT doc_id, CASE WHEN words >= 50 AND hits >= words // 50 AND hits >= runner * 3 // 2 THEN [{_codes}][best] END AS language,
    CAST(hits AS INT) AS hits, CAST(words AS INT) AS words FROM (
    SELECT *, list_max(list_filter(c, lambda v, i: i <> best)) AS runner FROM (
      SELECT *, list_max(c) AS hits, list_position(c, list_max(c)) AS best FROM (
        SELECT doc_id, len(w) AS words, [{_hits}] AS c FROM (
          SELECT doc_id, w, w AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents)))))""")
def _(t: Tables):
    return T.language(t.table("documents"))


@query("txt_names_normalize", """SELECT path, lower(trim(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) AS name_key FROM files""", ["files"])
def _(t: Tables):
    return t.files.select("path", X.name_key(X.file_name(F.col("path"))).alias("name_key"))


@query("txt_series_split", """SELECT o_orderkey, series, sequence, try_cast(sequence AS DOUBLE) AS seq_no FROM (
    SELECT o_orderkey, CASE WHEN f LIKE '%#%' THEN trim(regexp_extract(f, '^(.*)#[^#]*$', 1)) ELSE f END AS series,
      CASE WHEN f LIKE '%#%' THEN trim(regexp_extract(f, '#([^#]*)$', 1)) END AS sequence FROM (
      SELECT o_orderkey, trim(split_part(o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN ' #x' ELSE ' # ' || (o_custkey % 40) / 2.0 END || ', Other #1', ',', 1)) AS f FROM orders))""")
def _(t: Tables):
    o = t.table("orders").select("o_orderkey", F.expr("concat(o_orderpriority, case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then ' #x' else concat(' # ', cast((o_custkey % 40) / 2.0D as string)) end, ', Other #1')").alias("name"))
    return T.series_split(o, "name").drop("name")


@query("txt_natural_order", """SELECT folder, path, CAST(row_number() OVER (PARTITION BY folder ORDER BY k, path) - 1 AS BIGINT) AS place FROM (
    SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path,
      list_transform(regexp_extract_all(regexp_extract(path, '([^/]*)$', 1), '[0-9]+|[^0-9]'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]')
        THEN {'c': '0', 'n': length(ltrim(p, '0')), 'd': ltrim(p, '0')} ELSE {'c': upper(p), 'n': 0, 'd': ''} END) AS k FROM files)""", ["files"])
def _(t: Tables):
    f = t.files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path", X.file_name(F.col("path")).alias("name"))
    return T.natural_order(f, ["folder"], "name", "path").select("folder", "path", "place")


SQL_WORDS = """list_filter(list_transform(regexp_extract_all(strip_accents({0}), '[\\p{{L}}\\p{{Nd}}''’]+'), lambda w: lower(replace(replace(w, '''', ''), '’', ''))), lambda w: w <> '')"""
register_sql("tokens", [], f"""SELECT doc_id, CAST(u.i - 1 AS INT) AS tok_idx, u.v AS value FROM (
    SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents), LATERAL (SELECT unnest(w) AS v, generate_subscripts(w, 1) AS i) u""")
register_sql("qwords", [], f"""SELECT item_id AS query_id, CAST(u.i - 1 AS INT) AS q_idx, u.v AS value FROM (
    SELECT item_id, {SQL_WORDS.format('text')} AS w FROM benchmark), LATERAL (SELECT unnest(w) AS v, generate_subscripts(w, 1) AS i) u""")
register_sql("spread", ["segments"], f"""SELECT book_id, seg_id, CAST(u.i - 1 AS INT) AS word_idx, u.v AS value,
    start_ms + (end_ms - start_ms) * (u.i - 1) // len(w) AS at_ms FROM (
    SELECT *, {SQL_WORDS.format('text')} AS w FROM segments), LATERAL (SELECT unnest(w) AS v, generate_subscripts(w, 1) AS i) u""")


@query("tok_tokens", "SELECT doc_id, tok_idx, value FROM tokens", ["tokens"])
def _(t: Tables):
    return K.tokens(t.table("documents")).select("doc_id", "tok_idx", "value")


@query("tok_query_words", "SELECT * FROM qwords", ["qwords"])
def _(t: Tables):
    return K.query_words(t.table("benchmark").withColumnRenamed("item_id", "query_id"))


# Token offsets in SQL: pieces of words and gaps, and a running length.
register_sql("token_starts", [], """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS tok_idx, CAST(e - length(p) AS INT) AS char_start FROM (
    SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, u.i, u.p FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{Nd}''’]+|[^\\p{L}\\p{Nd}''’]+') AS ps FROM documents),
        LATERAL (SELECT unnest(ps) AS p, generate_subscripts(ps, 1) AS i) u)) WHERE regexp_matches(p, '^[\\p{L}\\p{Nd}''’]*[\\p{L}\\p{Nd}]')""")


@query("tok_index_at_char", """SELECT o.doc_id, o.at_char, coalesce(t.tok_idx, n.n, 0) AS tok_idx FROM (
    SELECT doc_id, CAST(doc_id * 7919 % 600 AS INT) AS at_char FROM documents) o
    ASOF LEFT JOIN token_starts t ON t.doc_id = o.doc_id AND o.at_char <= t.char_start
    LEFT JOIN (SELECT doc_id, CAST(count(*) AS INT) AS n FROM token_starts GROUP BY 1) n ON n.doc_id = o.doc_id""", ["token_starts"])
def _(t: Tables):
    asked = t.table("documents").select("doc_id", F.expr("cast(doc_id * 7919 % 600 as int)").alias("at_char"))
    return K.index_at_char(asked, K.tokens(t.table("documents")))


# Words of conversation turns cut into sub-word pieces of at most four characters.
register_sql("pieces", ["segments"], """SELECT book_id * 1000 + seg_id AS segment_id, CAST(u.i - 1 AS BIGINT) AS ord, u.p AS text, start_ms + (u.i - 1) * 20 AS at_ms FROM (
    SELECT *, regexp_extract_all('[_BEG_]' || text || '<|endoftext|>', '\\[_BEG_\\]|<\\|endoftext\\|>|\\s?[^\\s<\\[]{1,4}') AS ps FROM segments),
    LATERAL (SELECT unnest(ps) AS p, generate_subscripts(ps, 1) AS i) u""")


def pieces(t: Tables):
    p = X.matches(F.concat(F.lit("[_BEG_]"), "text", F.lit("<|endoftext|>")), "\\[_BEG_\\]|<\\|endoftext\\|>|\\s?[^\\s<\\[]{1,4}")
    return t.segments.select((F.col("book_id") * 1000 + F.col("seg_id")).alias("segment_id"), "start_ms", F.posexplode(p).alias("i", "text")).select(
        "segment_id", F.col("i").cast("bigint").alias("ord"), "text", (F.col("start_ms") + F.col("i") * 20).alias("at_ms"))


@query("tok_merge_subwords", """SELECT segment_id, CAST(word AS BIGINT) AS word, v AS value, at_ms FROM (
    SELECT segment_id, word, lower(regexp_replace(strip_accents(string_agg(trim(text, ' ' || chr(10) || chr(13) || chr(9)), '' ORDER BY ord)), '[^\\p{L}\\p{Nd}]', '', 'g')) AS v, min_by(at_ms, ord) AS at_ms FROM (
      SELECT *, sum(CASE WHEN regexp_matches(text, '^\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY ord) AS word
      FROM pieces WHERE text NOT LIKE '[\\_%]' ESCAPE '\\' AND text NOT LIKE '<|%|>' AND trim(text) <> '') GROUP BY 1, 2) WHERE v <> ''""", ["pieces"])
def _(t: Tables):
    return K.merge_subwords(pieces(t))


@query("tok_spread_even", "SELECT * FROM spread", ["spread"])
def _(t: Tables):
    return K.spread_even(t.segments, ["book_id", "seg_id"])


register_sql("heard_letters", ["frames"], """SELECT book_id, frame, CAST(id AS INT) AS id FROM (
    SELECT *, lag(id) OVER (PARTITION BY book_id ORDER BY frame) AS p FROM (
      SELECT book_id, frame, list_position(probs, list_max(probs)) - 1 AS id FROM frames)) WHERE id >= 4 AND id <> coalesce(p, 0)""")


@query("tok_greedy_collapse", "SELECT * FROM heard_letters", ["heard_letters"])
def _(t: Tables):
    return K.greedy_collapse(t.frames)


register_sql("letters", [], """SELECT doc_id, CAST(u.i - 1 AS INT) AS pos, CAST(CASE WHEN u.c = '0' THEN 31 ELSE instr('aienoutsrmkldghybpwcvjzf''qx', u.c) + 3 END AS INT) AS id FROM (
    SELECT doc_id, string_split(k, '') AS cs FROM (
      SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(translate(strip_accents(lower(translate(text, '’‘ʼ', ''''''''))), 'đøł', 'dol'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'),
        '\\p{Nd}+', '0', 'g'), '[^aienoutsrmkldghybpwcvjzf''qx0]', '', 'g') AS k FROM documents) WHERE k <> ''),
    LATERAL (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS i) u""")


@query("tok_romanize", "SELECT doc_id, id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM letters GROUP BY 1, 2", ["letters"])
def _(t: Tables):
    return K.letters(t.table("documents")).groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))
