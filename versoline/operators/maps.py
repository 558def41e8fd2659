"""Looking a consistent map up in both directions, and what it covers.

``anchors`` are the anchors of a consistent map (strictly increasing per chapter in both dimensions).
Every lookup is one as-of join (``primitives.bracket``) plus a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoline.operators import primitives as P
from versoline.operators.anchors import CHAPTER, SLICE_CHARS, STEP_CHARS, STEP_MS, ms_slice
from versoline.semantics import (
    CHAPTER_TAIL_MS, FASTEST_PACE, SHORTEST_PACE_MS, SLOWEST_PACE, STRONG_CONFIDENCE, heard)


def bounds(anchors: DataFrame) -> DataFrame:
    """Outermost anchors per chapter; partial aggregation keeps a hot chapter cheap."""
    return anchors.groupBy(*CHAPTER).agg(
        F.count("*").alias("n"), F.min("audio_ms").alias("first_ms"), F.max("audio_ms").alias("last_ms"),
        F.min("char_offset").alias("first_char"), F.max("char_offset").alias("last_char"),
        F.max(heard("confidence")).alias("heard_any"))


def interpolated(at: str, x: str, y: str, lo: str = "lo", hi: str = "hi") -> Column:
    """Linear between the bracketing anchors, half-even; clamped outside."""
    low, high = F.col(lo), F.col(hi)
    share = (F.col(at) - low[x]).cast("double") / (high[x] - low[x])
    inner = low[y] + F.rint(share * (high[y] - low[y])).cast("bigint")
    return F.when(low.isNull(), high[y]).when(high.isNull(), low[y]).otherwise(inner)


def char_to_ms(offsets: DataFrame, anchors: DataFrame, at: str = "at_char", out: str = "audio_ms") -> DataFrame:
    b = P.bracket(offsets, anchors, CHAPTER, at, "char_offset", ["audio_ms"], STEP_CHARS, "__lo", "__hi")
    return b.withColumn(out, interpolated(at, "char_offset", "audio_ms", "__lo", "__hi").cast("bigint")).drop("__lo", "__hi")


def ms_to_char(times: DataFrame, anchors: DataFrame, at: str = "at_ms", out: str = "char_offset") -> DataFrame:
    b = P.bracket(times, anchors, CHAPTER, at, "audio_ms", ["char_offset"], STEP_MS, "__lo", "__hi")
    return b.withColumn(out, interpolated(at, "audio_ms", "char_offset", "__lo", "__hi").cast("int")).drop("__lo", "__hi")


def covers(points: DataFrame, anchors: DataFrame, at: str = "at_ms", by: str = "ms") -> DataFrame:
    """At least two anchors, and inside the outermost (``by`` = ``ms`` or ``char``)."""
    inside = (F.col("n") > 1) & F.col(at).between(F.col(f"first_{by}"), F.col(f"last_{by}"))
    return points.join(bounds(anchors), CHAPTER, "left").select(
        *points.columns, F.coalesce(inside, F.lit(False)).alias("covered"))


def _extrapolated(at: str, within_ms: int) -> Column:
    ahead, span = F.col(at) - F.col("last_ms"), F.col("last_ms") - F.col("first_ms")
    rate = (F.col("last_char") - F.col("first_char")).cast("double") / F.nullif(span, F.lit(0))
    ok = (F.col("n") > 1) & (ahead > 0) & (ahead <= within_ms) & (span >= SHORTEST_PACE_MS) & rate.between(
        SLOWEST_PACE, FASTEST_PACE)
    return F.when(ok, F.col("last_char") + (rate * ahead).cast("int"))


def extrapolate(times: DataFrame, anchors: DataFrame, within_ms: int, at: str = "at_ms") -> DataFrame:
    """Offset a little past the last anchor, at the chapter's own pace; null where that is not believable."""
    return times.join(bounds(anchors), CHAPTER, "left").select(
        *times.columns, _extrapolated(at, within_ms).alias("char_offset"))


def is_measured_at(times: DataFrame, anchors: DataFrame, window_ms: int, at: str = "at_ms") -> DataFrame:
    """A heard anchor within the window on both sides; the offset only where that holds."""
    sure = anchors.filter(heard("confidence")).select(*CHAPTER, "audio_ms")
    b = P.bracket(times, sure, CHAPTER, at, "audio_ms", [], STEP_MS, "__lo", "__hi")
    after = P.at_or_after("audio_ms", at, "__lo", "__hi")
    measured = F.coalesce((F.col(at) - F.col("__lo.audio_ms") <= window_ms) & (after["audio_ms"] - F.col(at) <= window_ms), F.lit(False))
    t = b.withColumn("measured", measured).drop("__lo", "__hi")
    looked_up = ms_to_char(t, anchors, at)
    return looked_up.withColumn("char_offset", F.when(F.col("measured"), F.col("char_offset")))


def chapter_at(points: DataFrame, chapters: DataFrame, at: str = "at_ms", by: str = "ms") -> DataFrame:
    """Half-open chapter holding a point, else the last chapter that has such a range."""
    start, end = ("start_ms", "end_ms") if by == "ms" else ("text_start", "text_end")
    c = chapters.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        "book_id", "chapter_idx", F.col(start).alias("__s"), F.col(end).alias("__e"))
    final = c.groupBy("book_id").agg(F.max("chapter_idx").alias("__last"))
    b = P.bracket(points, c, ["book_id"], at, "__s", ["__e", "chapter_idx"], STEP_MS * 60 if by == "ms" else STEP_CHARS * 60)
    inside = F.when(F.col(at) < F.col("lo.__e"), F.col("lo.chapter_idx"))
    return b.join(final, "book_id", "left").select(
        *points.columns, F.when(F.col(at).isNotNull(), F.coalesce(inside, F.col("__last"))).alias("chapter_idx"))


def position(times: DataFrame, anchors: DataFrame, chapters: DataFrame, ahead_ms: int = 0, at: str = "at_ms") -> DataFrame:
    """The narrator's offset: covered -> interpolate; else extrapolate; else the tail of a heard chapter; else null."""
    t = chapter_at(times, chapters, at).join(bounds(anchors), CHAPTER, "left")
    t = P.bracket(t, anchors, CHAPTER, at, "audio_ms", ["char_offset"], STEP_MS)
    past = F.col(at) - F.col("last_ms")
    out = F.when((F.col("n") > 1) & F.col(at).between(F.col("first_ms"), F.col("last_ms")),
                 interpolated(at, "audio_ms", "char_offset"))
    tail = F.when((F.col("n") > 1) & (past > 0) & (past < CHAPTER_TAIL_MS) & F.col("heard_any"), F.col("last_char"))
    ahead = _extrapolated(at, ahead_ms) if ahead_ms > 0 else F.lit(None)
    return t.select(*times.columns, "chapter_idx", F.coalesce(out, ahead, tail).cast("int").alias("char_offset"))


def audio_at_char(offsets: DataFrame, anchors: DataFrame, chapters: DataFrame, at: str, out: str) -> DataFrame:
    """Offset -> ms where the chapter's map covers it, else null."""
    t = chapter_at(offsets, chapters, at, "char").withColumnRenamed("chapter_idx", "__ch")
    keyed = t.withColumn("chapter_idx", F.col("__ch")).join(bounds(anchors), CHAPTER, "left")
    b = P.bracket(keyed, anchors, CHAPTER, at, "char_offset", ["audio_ms"], STEP_CHARS, "__lo", "__hi")
    inside = (F.col("n") > 1) & F.col(at).between(F.col("first_char"), F.col("last_char"))
    return b.select(*offsets.columns, F.when(inside, interpolated(at, "char_offset", "audio_ms", "__lo", "__hi")).alias(out))


def audio_at_or_after(offsets: DataFrame, anchors: DataFrame, chapters: DataFrame, sentences: DataFrame,
                      within: int, at: str = "at_char") -> DataFrame:
    """Offset -> ms, or the time of the first covered sentence starting within so many characters."""
    here = audio_at_char(offsets, anchors, chapters, at, "__here")
    timed = audio_at_char(sentences.select("book_id", "start"), anchors, chapters, "start", "__at").filter("__at is not null")
    b = P.bracket(here, timed, ["book_id"], at, "start", ["__at"], STEP_CHARS)
    nxt = F.when(F.col("hi.start") - F.col(at) <= within, F.col("hi.__at"))
    return b.select(*offsets.columns, F.coalesce("__here", nxt).alias("audio_ms"))


def sentence_times(sentences: DataFrame, anchors: DataFrame) -> DataFrame:
    """Begin and end per sentence from the first chapter whose map covers both its ends.

    Maps of a book may overlap in text, so each is listed under all buckets of text it touches and a sentence
    looks into the bucket it starts in; of the maps that cover it the lowest chapter wins.
    """
    s = P.scan(sentences.select("book_id", "idx", "start", "end"), ["book_id"], ["start"],
               P.slice_of("start", SLICE_CHARS), {"__next": P.following(F.col("start"))})
    spans = bounds(anchors).filter("n > 1").select("book_id", "chapter_idx", "first_char", "last_char")
    listed = spans.withColumn("__b", F.explode(F.sequence(P.slice_of("first_char", SLICE_CHARS), P.slice_of("last_char", SLICE_CHARS))))
    last = F.greatest(F.col("start"), F.col("end") - 1)
    covering = s.withColumn("__b", P.slice_of("start", SLICE_CHARS)).join(listed, ["book_id", "__b"]).filter(
        (F.col("start") >= F.col("first_char")) & (last <= F.col("last_char")))
    own = covering.groupBy("book_id", "idx", "start", "end", "__next").agg(F.min(F.struct("chapter_idx", "last_char")).alias("__m"))
    owned = own.select(
        "book_id", "idx", "start", F.col("__m.chapter_idx").alias("chapter_idx"),
        F.when(F.col("__next") <= F.col("__m.last_char"), F.col("__next")).otherwise(F.col("end")).alias("__to"))
    timed = char_to_ms(char_to_ms(owned, anchors, "start", "begin_ms"), anchors, "__to", "end_ms")
    return timed.filter("end_ms > begin_ms").select("book_id", "idx", "start", "begin_ms", "end_ms")


def spans_close_gaps(spans: DataFrame, gap: int = 1_500, tail: int = 250) -> DataFrame:
    """A sentence runs to the next one when the silence is short, else a little past its own end."""
    s = P.scan(spans, ["book_id"], ["idx"], P.slice_of("idx", 65_536), {"__n": P.following(F.col("begin_ms"))})
    silence = F.col("__n") - F.col("end_ms")
    end = F.when((silence >= 0) & (silence < gap), F.col("__n")).otherwise(F.col("end_ms") + tail)
    return s.withColumn("end_ms", end).drop("__n").filter("end_ms > begin_ms")


def no_overlap_clips(times: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """Begin no earlier than the clips before end, clamp to the recording, drop what is left empty.

    The end of the last kept clip is a running maximum over the clips that end after their own begin: of these a
    dropped one ends no later than it, and inverted ones are dropped whatever came before.
    """
    t = times.join(durations.select("book_id", "duration_ms"), "book_id")
    t = t.withColumn("end_ms", F.least(F.greatest(F.col("end_ms"), F.lit(0)), F.col("duration_ms")))
    t = P.scan(t, keys, ["idx"], P.slice_of("idx", 65_536), {
        "__pe": P.max_before(F.when(F.col("end_ms") > F.greatest(F.col("begin_ms"), F.lit(0)), F.col("end_ms")))})
    begin = F.least(F.greatest(F.col("begin_ms"), F.coalesce("__pe", F.lit(0)), F.lit(0)), F.col("duration_ms"))
    return t.withColumn("begin_ms", begin).filter("end_ms > begin_ms").drop("__pe", "duration_ms")


def sentence_at(offsets: DataFrame, sentences: DataFrame, at: str = "at_char") -> DataFrame:
    """Last sentence starting at or before the offset, else the first."""
    b = P.bracket(offsets, sentences, ["book_id"], at, "start", ["idx"], STEP_CHARS)
    return b.select(*offsets.columns, F.coalesce("lo.idx", "hi.idx").alias("sentence_idx"))


def spine_at(offsets: DataFrame, spine: DataFrame, at: str = "at_char") -> DataFrame:
    """First document ending after the offset, else the last."""
    b = P.bracket(offsets, spine, ["book_id"], at, "text_end", ["spine_idx"], STEP_CHARS * 60)
    return b.select(*offsets.columns, F.coalesce("hi.spine_idx", "lo.spine_idx").alias("spine_idx"))


def nearest_mark(offsets: DataFrame, chapters: DataFrame, books: DataFrame, snap_ms: int = 300_000, at: str = "at_char") -> DataFrame:
    """Proportional time, put on the nearest chapter start when one is close enough."""
    t = offsets.join(books.select("book_id", "duration_ms", "text_length"), "book_id").withColumn(
        "__p", F.when((F.col("text_length") > 0) & (F.col("duration_ms") > 0),
                      (F.col("duration_ms") * (F.col(at).cast("double") / F.col("text_length"))).cast("bigint")).otherwise(F.lit(0)))
    t = t.withColumnRenamed("__p", "__at")
    starts = chapters.filter("start_ms is not null").select("book_id", "start_ms").distinct()
    b = P.bracket(t, starts, ["book_id"], "__at", "start_ms", [], STEP_MS * 60)
    mark = P.nearest("start_ms", "__at")["start_ms"]
    return b.select(*offsets.columns, F.when(F.abs(mark - F.col("__at")) <= snap_ms, mark).otherwise(F.col("__at")).alias("audio_ms"))


# --- coverage ---------------------------------------------------------------------------------

def measured_ms(anchors: DataFrame, window_ms: int) -> DataFrame:
    """Heard audio: the gaps between heard anchors that are no longer than the window, added up."""
    sure = anchors.filter(heard("confidence")).select(*CHAPTER, "audio_ms")
    s = P.scan(sure, CHAPTER, ["audio_ms"], ms_slice(), {"__p": P.previous(F.col("audio_ms"))})
    gap = F.col("audio_ms") - F.col("__p")
    return s.groupBy(*CHAPTER).agg(F.sum(F.when(gap <= window_ms, gap).otherwise(F.lit(0))).alias("measured_ms"))


def heard_spans(anchors: DataFrame, window_ms: int) -> DataFrame:
    """Islands of heard anchors no further apart than the window."""
    sure = anchors.filter(heard("confidence")).select(*CHAPTER, "audio_ms")
    s = P.scan(sure, CHAPTER, ["audio_ms"], ms_slice(), {"__p": P.previous(F.col("audio_ms"))})
    fresh = F.when(F.col("__p").isNull() | (F.col("audio_ms") - F.col("__p") > window_ms), F.col("audio_ms"))
    s = P.scan(s.withColumn("__f", fresh), CHAPTER, ["audio_ms"], ms_slice(), {"span_start": P.last_known(F.col("__f"))})
    return s.groupBy(*CHAPTER, "span_start").agg(F.max("audio_ms").alias("span_end"))


def contains(intervals: DataFrame, anchors: DataFrame, window_ms: int) -> DataFrame:
    """Is [from_ms, to_ms] inside a heard span extended one window back?

    Spans are more than a window apart, so the span to ask is the last one starting at or before
    ``from_ms + window``.
    """
    spans = heard_spans(anchors, window_ms)
    asked = intervals.withColumn("__q", F.col("from_ms") + window_ms)
    b = P.bracket(asked, spans, CHAPTER, "__q", "span_start", ["span_end"], STEP_MS)
    return b.select(*intervals.columns, F.coalesce(F.col("to_ms") <= F.col("lo.span_end"), F.lit(False)).alias("covered"))


def chapter_progress(anchors: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Per book: measured chapters, first needing work, contiguous reach, and where healing starts.

    ``chapters`` are numbered 0.. without holes; ``books(book_id, claimed_through)`` is how far the book
    is said to be aligned.
    """
    state = anchors.groupBy(*CHAPTER).agg(F.max(heard("confidence")).alias("__heard"))
    c = chapters.select(*CHAPTER).join(state, CHAPTER, "left").join(books.select("book_id", "claimed_through"), "book_id", "left")
    healing = (~F.col("__heard")) & (F.col("chapter_idx") <= F.col("claimed_through"))
    return c.groupBy("book_id").agg(
        F.count_if(F.coalesce("__heard", F.lit(False))).alias("measured"),
        F.coalesce(F.min(F.when(~F.coalesce("__heard", F.lit(False)), F.col("chapter_idx"))), F.max("chapter_idx") + 1).alias("first_todo"),
        (F.coalesce(F.min(F.when(F.col("__heard").isNull(), F.col("chapter_idx"))), F.max("chapter_idx") + 1) - 1).alias("through"),
        F.min(F.when(healing, F.col("chapter_idx"))).alias("heal_from"))


def error_report(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Signed mean bias, nearest-rank percentiles and worst error of a map against the truth.

    Percentiles come from a histogram of the errors: one row per distinct error, not per lookup.
    """
    e = predicted.join(truth, keys).select("book_id", (F.col("char_offset") - F.col("true_char")).alias("d"), "confidence")
    hist = e.groupBy("book_id", F.abs("d").alias("err")).agg(F.count("*").alias("k"))
    ranked = P.scan(hist, ["book_id"], ["err"], P.slice_of("err", 4096), {"upto": P.running_sum(F.col("k"))})
    totals = e.groupBy("book_id").agg(
        F.count("*").alias("n"), F.avg("d").alias("bias"), F.max(F.abs("d")).alias("worst"),
        F.count_if(F.col("confidence") > STRONG_CONFIDENCE).alias("strong"))
    r = ranked.join(totals, "book_id")

    def pick(p: float) -> Column:
        place = F.least((F.col("n") * p).cast("bigint"), F.col("n") - 1)
        return F.min(F.when(F.col("upto") > place, F.col("err")))

    return r.groupBy("book_id").agg(
        F.first("n").alias("n"), F.first("bias").alias("bias"), pick(0.5).alias("p50"), pick(0.95).alias("p95"),
        F.first("worst").alias("worst"), F.first("strong").alias("strong"))
