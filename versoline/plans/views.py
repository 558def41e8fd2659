"""Derived inputs: the driver tables read as books, chapters, anchors, sentences and files.

Every view is stated twice, as a DataFrame and as SQL, so that a query and its oracle start from the
same rows.  The formulas only use columns of the tables, so the views grow with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoline.operators import anchors as anc
from versoline.operators import primitives as P

CHAPTER_MS = 600_000
CHAPTER_CHARS = 9_000
SPINE_CHARS = 2_000


class Tables:
    """The driver tables of one scale factor and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        """Events on a timeline: a second of wall clock since 2024 counts as one millisecond of audio."""
        return self.table("events").select(
            "event_id", F.col("user_id").alias("book_id"), "event_type", "value", "ts", "props",
            F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) div 1000000").alias("s"),
        )

    @cached_property
    def anchors(self) -> DataFrame:
        """Noisy anchors with distinct times per book."""
        first = self.ev.groupBy("book_id", F.col("s").alias("audio_ms")).agg(F.min("event_id").alias("event_id"))
        return first.select(
            "book_id",
            F.expr(f"cast(audio_ms div {CHAPTER_MS} as int)").alias("chapter_idx"),
            "audio_ms",
            F.expr("cast(audio_ms * 15 div 1000 + event_id * 7919 % 700 as int)").alias("char_offset"),
            F.expr("cast(event_id * 37 % 100 as double) / 100").alias("confidence"),
            "event_id",
        )

    @cached_property
    def maps(self) -> DataFrame:
        """Consistent anchors: strictly increasing in time and offset per chapter."""
        return P.stage(anc.monotone(self.anchors, distinct_times=True))

    @cached_property
    def chapters(self) -> DataFrame:
        idx = self.ev.select("book_id", F.expr(f"cast(s div {CHAPTER_MS} as int)").alias("chapter_idx")).distinct()
        return idx.select(
            "book_id", "chapter_idx", F.expr("concat('Chapter ', chapter_idx + 1)").alias("title"),
            (F.col("chapter_idx").cast("bigint") * CHAPTER_MS).alias("start_ms"),
            ((F.col("chapter_idx").cast("bigint") + 1) * CHAPTER_MS).alias("end_ms"),
            (F.col("chapter_idx") * CHAPTER_CHARS).alias("text_start"),
            ((F.col("chapter_idx") + 1) * CHAPTER_CHARS).alias("text_end"),
        )

    @cached_property
    def points(self) -> DataFrame:
        """Lookups, in time and in text: every event is one."""
        return self.ev.select(
            "event_id", "book_id",
            F.expr("s + 4321").alias("at_ms"),
            F.expr("cast((s + 4321) * 15 div 1000 + 50 as int)").alias("at_char"),
        )

    @cached_property
    def sentences(self) -> DataFrame:
        starts = self.ev.select("book_id", F.expr("cast(s * 15 div 1000 as int)").alias("start")).distinct()
        s = P.scan(starts, ["book_id"], ["start"], P.slice_of("start", 4096),
                   {"idx": P.row_index(), "__n": P.following(F.col("start"))})
        return P.stage(s.select(
            "book_id", F.col("idx").cast("int").alias("idx"), "start",
            F.least(F.coalesce("__n", F.col("start") + 90), F.col("start") + 90).alias("end"),
            F.expr(f"start div {SPINE_CHARS}").cast("int").alias("spine_idx"),
        ))

    @cached_property
    def spine(self) -> DataFrame:
        return self.ev.select("book_id", F.expr(f"cast(s * 15 div 1000 div {SPINE_CHARS} as int)").alias("spine_idx")).distinct().select(
            "book_id", "spine_idx", (F.col("spine_idx") * SPINE_CHARS).alias("text_start"),
            ((F.col("spine_idx") + 1) * SPINE_CHARS).alias("text_end"),
        )

    @cached_property
    def timeline_books(self) -> DataFrame:
        return self.ev.groupBy("book_id").agg(
            (F.max("s") + 5000).alias("duration_ms"),
            F.expr("cast(max(s) * 15 div 1000 + 1200 as int)").alias("text_length"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        """Conversation turns as transcript segments of ten seconds."""
        return self.table("conversations").select(
            F.col("conv_id").alias("book_id"), F.col("turn").alias("seg_id"),
            (F.col("turn") * 10_000).alias("start_ms"), (F.col("turn") * 10_000 + 10_000).alias("end_ms"),
            "text", F.expr("cast((conv_id * 31 + turn * 17) % 100 as double) / 100").alias("no_speech"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("label").alias("book_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("probs"))

    @cached_property
    def books(self) -> DataFrame:
        """Library books: orders with their customer as author."""
        o = self.table("orders").join(
            self.table("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
        return o.select(
            F.col("o_orderkey").alias("book_id"),
            F.expr("concat('Book ', o_orderkey % 977)").alias("title"),
            F.col("c_name").alias("author"),
            F.expr("case when o_orderkey % 3 <> 0 then concat('/store/audio/Book_', o_orderkey, ' (', o_orderkey % 4, ').m4b') end").alias("audio_path"),
            F.expr("case when o_orderkey % 6 = 1 then concat('content://media/doc%3ABook%20', o_orderkey, '.mp3') end").alias("original_audio_path"),
            F.expr("case when o_orderkey % 4 <> 0 then concat('/store/books/Book-', o_orderkey, '.epub') end").alias("ebook_path"),
            F.expr("case when o_orderkey % 5 = 2 then concat('Book ', o_orderkey, '.zip') end").alias("source_name"),
            F.expr("case when o_orderkey % 3 <> 0 then sha2(concat('a', o_orderkey % 9001), 256) end").alias("audio_hash"),
            F.expr("case when o_orderkey % 4 <> 0 then sha2(concat('e', o_orderkey % 9001), 256) end").alias("ebook_hash"),
            F.expr("case when o_orderkey % 3 <> 0 then cast(round(o_totalprice * 100) as bigint) else 0 end").alias("duration_ms"),
            F.expr("case when o_orderkey % 4 <> 0 then cast(o_totalprice as int) else 0 end").alias("text_length"),
            F.expr("case when o_orderstatus = 'F' then 'Complete' when o_orderstatus = 'P' then 'Partial' else 'Pending' end").alias("sync_state"),
            F.expr("cast(o_orderkey % 5 - 1 as int)").alias("aligned_through"),
            F.expr("case when o_orderkey % 7 <> 0 then concat('it', o_orderkey) end").alias("server_item_id"),
            F.expr("case when o_orderkey % 2 = 0 then concat('srv', o_orderkey % 3) end").alias("server_id"),
            F.col("o_custkey").alias("series_no"),
            F.col("o_orderdate").alias("added"),
            F.expr("case when o_orderstatus <> 'O' then o_orderdate + make_dt_interval(cast(o_orderkey % 100 as int)) end").alias("last_opened"),
        )

    @cached_property
    def marks(self) -> DataFrame:
        """Raw chapter marks of the library books, unordered and unreliable as in the wild."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("book_id"),
            F.expr("(l_partkey * 97 + l_suppkey * 13 + l_linenumber * 1009) % 7200 * 1000").alias("start_ms"),
            F.expr("(l_partkey * 97 + l_suppkey * 13 + l_linenumber * 1009) % 7200 * 1000 + (cast(l_quantity as bigint) - 5) * 60000").alias("end_ms"),
            F.expr("case when l_linenumber % 3 = 0 then ' ' else concat('Part ', l_partkey, ' ') end").alias("title"),
            F.expr("cast(l_extendedprice as int)").alias("offset"),
            "l_partkey", "l_linenumber",
        ).distinct()

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of the documents; a document is a page of the book named by its source."""
        return self.table("documents").select(
            "source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))

    @cached_property
    def files(self) -> DataFrame:
        """A file listing: parts as folders, line items as audio files, some ebooks beside them."""
        audio = self.table("lineitem").select(
            F.expr("concat('/lib/', l_partkey % 50, '/', l_orderkey % 2000, case when l_suppkey % 9 = 0 then '/cd1' else '' end, '/Track ', l_linenumber, ' - ', l_suppkey, case when l_linenumber % 5 = 0 then '.txt' else '.mp3' end)").alias("path"),
            F.expr("cast(l_extendedprice as bigint)").alias("size"), F.expr("l_partkey * 100000 + l_linenumber").alias("mtime"))
        ebooks = self.table("orders").select(
            F.expr("concat('/lib/', o_custkey % 50, '/', o_orderkey % 2000, '/', case when o_orderkey % 11 = 0 then concat('Track ', o_orderkey % 6, ' - ', o_orderkey % 40) else concat('Novel ', o_custkey) end, '.epub')").alias("path"),
            F.expr("cast(o_totalprice as bigint)").alias("size"), F.expr("o_custkey * 1000").alias("mtime"))
        return P.stage(audio.unionByName(ebooks).groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime")))


_SQL: dict[str, tuple[list[str], str]] = {
    "ev": ([], """
        SELECT event_id, user_id AS book_id, event_type, value, ts, props,
               (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS s FROM events"""),
    "anchors": (["ev"], f"""
        SELECT book_id, CAST(audio_ms // {CHAPTER_MS} AS INT) AS chapter_idx, audio_ms,
               CAST(audio_ms * 15 // 1000 + event_id * 7919 % 700 AS INT) AS char_offset,
               CAST(event_id * 37 % 100 AS DOUBLE) / 100 AS confidence, event_id
        FROM (SELECT book_id, s AS audio_ms, min(event_id) AS event_id FROM ev GROUP BY 1, 2)"""),
    "maps": (["anchors"], """
        SELECT book_id, chapter_idx, audio_ms, char_offset, confidence, event_id FROM (
          SELECT *, max(char_offset) OVER (PARTITION BY book_id, chapter_idx ORDER BY audio_ms
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM anchors)
        WHERE m IS NULL OR char_offset > m"""),
    "chapters": (["ev"], f"""
        SELECT book_id, chapter_idx, 'Chapter ' || (chapter_idx + 1) AS title,
               CAST(chapter_idx AS BIGINT) * {CHAPTER_MS} AS start_ms, (CAST(chapter_idx AS BIGINT) + 1) * {CHAPTER_MS} AS end_ms,
               chapter_idx * {CHAPTER_CHARS} AS text_start, (chapter_idx + 1) * {CHAPTER_CHARS} AS text_end
        FROM (SELECT DISTINCT book_id, CAST(s // {CHAPTER_MS} AS INT) AS chapter_idx FROM ev)"""),
    "points": (["ev"], """
        SELECT event_id, book_id, s + 4321 AS at_ms, CAST((s + 4321) * 15 // 1000 + 50 AS INT) AS at_char
        FROM ev"""),
    "sentences": (["ev"], f"""
        SELECT book_id, CAST(row_number() OVER w - 1 AS INT) AS idx, start,
               least(coalesce(lead(start) OVER w, start + 90), start + 90) AS "end",
               CAST(start // {SPINE_CHARS} AS INT) AS spine_idx
        FROM (SELECT DISTINCT book_id, CAST(s * 15 // 1000 AS INT) AS start FROM ev)
        WINDOW w AS (PARTITION BY book_id ORDER BY start)"""),
    "spine": (["ev"], f"""
        SELECT book_id, spine_idx, spine_idx * {SPINE_CHARS} AS text_start, (spine_idx + 1) * {SPINE_CHARS} AS text_end
        FROM (SELECT DISTINCT book_id, CAST(s * 15 // 1000 // {SPINE_CHARS} AS INT) AS spine_idx FROM ev)"""),
    "timeline_books": (["ev"], """
        SELECT book_id, max(s) + 5000 AS duration_ms, CAST(max(s) * 15 // 1000 + 1200 AS INT) AS text_length
        FROM ev GROUP BY 1"""),
    "segments": ([], """
        SELECT conv_id AS book_id, turn AS seg_id, turn * 10000 AS start_ms, turn * 10000 + 10000 AS end_ms, text,
               CAST((conv_id * 31 + turn * 17) % 100 AS DOUBLE) / 100 AS no_speech FROM conversations"""),
    "frames": ([], "SELECT label AS book_id, vec_id AS frame, embedding AS probs FROM embeddings"),
    "books": ([], """
        SELECT o_orderkey AS book_id, 'Book ' || (o_orderkey % 977) AS title, c_name AS author,
          CASE WHEN o_orderkey % 3 <> 0 THEN '/store/audio/Book_' || o_orderkey || ' (' || (o_orderkey % 4) || ').m4b' END AS audio_path,
          CASE WHEN o_orderkey % 6 = 1 THEN 'content://media/doc%3ABook%20' || o_orderkey || '.mp3' END AS original_audio_path,
          CASE WHEN o_orderkey % 4 <> 0 THEN '/store/books/Book-' || o_orderkey || '.epub' END AS ebook_path,
          CASE WHEN o_orderkey % 5 = 2 THEN 'Book ' || o_orderkey || '.zip' END AS source_name,
          CASE WHEN o_orderkey % 3 <> 0 THEN sha256('a' || (o_orderkey % 9001)) END AS audio_hash,
          CASE WHEN o_orderkey % 4 <> 0 THEN sha256('e' || (o_orderkey % 9001)) END AS ebook_hash,
          CASE WHEN o_orderkey % 3 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END AS duration_ms,
          CASE WHEN o_orderkey % 4 <> 0 THEN CAST(trunc(o_totalprice) AS INT) ELSE 0 END AS text_length,
          CASE WHEN o_orderstatus = 'F' THEN 'Complete' WHEN o_orderstatus = 'P' THEN 'Partial' ELSE 'Pending' END AS sync_state,
          CAST(o_orderkey % 5 - 1 AS INT) AS aligned_through,
          CASE WHEN o_orderkey % 7 <> 0 THEN 'it' || o_orderkey END AS server_item_id,
          CASE WHEN o_orderkey % 2 = 0 THEN 'srv' || (o_orderkey % 3) END AS server_id,
          o_custkey AS series_no, o_orderdate AS added,
          CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_days(CAST(o_orderkey % 100 AS INT)) END AS last_opened
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""),
    "marks": ([], """
        SELECT DISTINCT l_orderkey AS book_id,
          (l_partkey * 97 + l_suppkey * 13 + l_linenumber * 1009) % 7200 * 1000 AS start_ms,
          (l_partkey * 97 + l_suppkey * 13 + l_linenumber * 1009) % 7200 * 1000 + (CAST(l_quantity AS BIGINT) - 5) * 60000 AS end_ms,
          CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'Part ' || l_partkey || ' ' END AS title,
          CAST(trunc(l_extendedprice) AS INT) AS "offset", l_partkey, l_linenumber FROM lineitem"""),
    "lines": ([], """
        SELECT source, doc_id, CAST(u.i - 1 AS INT) AS line, u.t AS text FROM (
          SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
          LATERAL (SELECT unnest(parts) AS t, generate_subscripts(parts, 1) AS i) u"""),
    "files": ([], """
        SELECT path, max(size) AS size, max(mtime) AS mtime FROM (
          SELECT '/lib/' || (l_partkey % 50) || '/' || (l_orderkey % 2000) || CASE WHEN l_suppkey % 9 = 0 THEN '/cd1' ELSE '' END
                 || '/Track ' || l_linenumber || ' - ' || l_suppkey || CASE WHEN l_linenumber % 5 = 0 THEN '.txt' ELSE '.mp3' END AS path,
                 CAST(trunc(l_extendedprice) AS BIGINT) AS size, l_partkey * 100000 + l_linenumber AS mtime FROM lineitem
          UNION ALL
          SELECT '/lib/' || (o_custkey % 50) || '/' || (o_orderkey % 2000) || '/' || CASE WHEN o_orderkey % 11 = 0
                   THEN 'Track ' || (o_orderkey % 6) || ' - ' || (o_orderkey % 40) ELSE 'Novel ' || o_custkey END || '.epub',
                 CAST(trunc(o_totalprice) AS BIGINT), o_custkey * 1000 FROM orders) GROUP BY 1"""),
}


def register_sql(name: str, needs: list[str], body: str) -> None:
    _SQL[name] = (needs, body)


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for need in _SQL[name][0]:
            add(need)
        ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_SQL[n][1]})" for n in ordered) + "\n" + body
