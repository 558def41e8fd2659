"""Reading and listening positions from several devices.

Every rule is a function of DataFrames that serves batch and stream alike where the rule allows it;
``stream_*`` functions add watermark, state and sink.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from versoline.operators import anchors as A
from versoline.operators import maps as M
from versoline.operators import primitives as P
from versoline.sources import versions

FIELDS = ["audio_ms", "text_offset", "speed"]
STATE = "book_id bigint, audio_ms bigint, text_offset int, speed double, audio_ms_at timestamp, text_offset_at timestamp, speed_at timestamp, updated timestamp"


def latest(events: DataFrame) -> DataFrame:
    """Newest non-null value of each field on its own: ``events(book_id, ts, audio_ms, text_offset, speed)``."""
    return events.groupBy("book_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("ts", f))).alias(f) for f in FIELDS],
        *[F.max(F.when(F.col(f).isNotNull(), F.col("ts"))).alias(f"{f}_at") for f in FIELDS],
        F.max("ts").alias("updated"))


def merged(states: DataFrame) -> DataFrame:
    """Partial states into one per book; the later event wins, so a replayed batch changes nothing."""
    return states.groupBy("book_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(f"{f}_at", f))).alias(f) for f in FIELDS],
        *[F.max(f"{f}_at").alias(f"{f}_at") for f in FIELDS], F.max("updated").alias("updated"))


def stream_upsert(events: DataFrame, path: str, checkpoint: str):
    """Keep the state table at ``path`` up to date from a stream of position events.

    A batch writes the books it speaks of and nothing else; readers merge the versions.
    """
    def write(batch: DataFrame, _: int) -> None:
        versions.append(latest(batch), path, STATE, merged)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state that ``stream_upsert`` keeps; None before its first batch."""
    rows = versions.stored(spark, path, STATE)
    return None if rows is None else merged(rows)


def throttled(events: DataFrame, every: str = "30 seconds") -> DataFrame:
    """One update per window, book and medium: the latest value in it.  Batch, or stream after a watermark."""
    return events.groupBy("book_id", "medium", F.window("ts", every).alias("w")).agg(
        F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts")).select(
        "book_id", "medium", F.col("w.start").alias("window_start"), "value", "ts")


def throttled_exactly(events: DataFrame, every_ms: int = 30_000) -> DataFrame:
    """The updates ``stream_throttle`` sends, for a finished table: ``events(book_id, medium, seq, at_ms, value, now)``, ordered by (at_ms, seq).

    An event is sent at once only if it is the group's first, urgent, or comes a wait or more after the event before it; of the last
    kind, whether it is depends on the phase of the send before, unless it comes two waits after.  So each of these events jumps to the
    next one that its own send lets through: mostly the very next, else found in rounds of eight candidates.  Sure events are sent
    however the send before lies, so jumps are doubled only between one sure event and the next.  All others are sent, the last of a
    wait each, when it is over.
    """
    keys, e = ["book_id", "medium"], F.lit(every_ms)
    part = P.slice_of("at_ms", 16 * 86_400_000)
    rows = P.stage(P.scan(events.select(*keys, "seq", "at_ms", "value", "now"), keys, ["at_ms", "seq"], part, {"n": P.row_index(), "before": P.previous(F.col("at_ms"))}))
    gap = F.col("at_ms") - F.col("before")
    sure = F.col("before").isNull() | F.col("now") | (gap >= 2 * e)
    some = rows.filter(sure | (gap >= e)).withColumn("sure", F.coalesce(sure, F.lit(False)))
    nodes = P.stage(P.scan(some, keys, ["n"], part, {"i": P.row_index(), "run": P.running_sum(F.col("sure").cast("bigint")),
                                                     "after": P.following(F.struct("n", "at_ms", "before", "now", "sure"))}))
    phase = lambda t: F.floor((t - F.col("from_ms")) / e)
    lets_through = lambda c: c("sure") | F.when(c("n") == F.col("from_n") + 1, True).otherwise(phase(c("at_ms")) - phase(c("before")) >= 2)
    from_ = nodes.select(*keys, F.col("i").alias("from_i"), F.col("n").alias("from_n"), F.col("at_ms").alias("from_ms"), "after").filter("after is not null")
    near = lets_through(lambda c: F.col(f"after.{c}"))
    to = F.struct((F.col("from_i") + 1).alias("i"), F.col("after.at_ms").alias("at_ms"), F.col("after.now").alias("now"), F.col("after.sure").alias("sure"))
    jumps = from_.filter(near).select(*keys, F.col("from_i").alias("i"), to.alias("to"))
    open_ = P.stage(from_.filter(~near).drop("after").withColumn("next_i", F.col("from_i") + 2))
    while not open_.isEmpty():
        tried = P.stage(open_.withColumn("i", F.explode(F.sequence(F.col("next_i"), F.col("next_i") + 7))).join(nodes, [*keys, "i"]).groupBy(*keys, "from_i", "from_n", "from_ms").agg(
            F.min(F.when(lets_through(F.col), F.struct("i", "at_ms", "now", "sure"))).alias("to"), (F.max("i") + 1).alias("next_i")))
        jumps = jumps.unionByName(tried.filter("to is not null").select(*keys, F.col("from_i").alias("i"), "to"))
        open_ = tried.filter("to is null").drop("to")
    joined = P.stage(nodes.join(jumps, [*keys, "i"], "left"))
    doubtful = joined.withColumn("to_i", F.when(~F.col("to.sure"), F.col("to.i"))).filter(~F.col("sure") | ~F.col("after.sure"))
    met = joined.filter(~F.col("sure")).join(P.on_path(doubtful, [*keys, "run"], "i", "to_i"), [*keys, "run", "i"], "left_semi")
    own = F.struct("at_ms", "to").alias("own")
    sent = P.stage(joined.filter("sure").unionByName(met).select(*keys, "n", own))
    follow = P.scan(rows.join(sent, [*keys, "n"], "left"), keys, ["n"], part, {"send": P.last_known(F.col("own"))})
    ending = F.col("send.at_ms") + (F.floor((F.col("at_ms") - F.col("send.at_ms")) / e) + 1) * e
    late = follow.filter("own is null").groupBy(*keys, ending.alias("sent_ms"), "send").agg(F.max_by("value", "n").alias("value")).filter(
        F.col("send.to").isNull() | (F.col("sent_ms") <= F.col("send.to.at_ms")))
    return follow.filter("own is not null").select(*keys, "at_ms", "value").unionByName(late.select(*keys, F.col("sent_ms").alias("at_ms"), "value"))


class Throttle(StatefulProcessor):
    """The exact rule: at once when due or urgent, otherwise the latest value when the wait is over."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "at bigint")
        self.pending = handle.getValueState("pending", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        incoming = pd.concat(list(rows)).sort_values("at_ms")
        last = self.sent.get()[0] if self.sent.exists() else None
        waiting = self.pending.get()[0] if self.pending.exists() else None
        out = []
        for at, value, now in zip(incoming["at_ms"], incoming["value"], incoming["now"]):
            at = int(at)
            if waiting is not None and at >= last + self.every_ms:
                # The wait ended before this event: the timer would have sent the pending value then.
                out.append((key[0], key[1], last + self.every_ms, waiting))
                last, waiting = last + self.every_ms, None
            if now or last is None or at >= last + self.every_ms:
                out.append((key[0], key[1], at, float(value)))
                last, waiting = at, None
            else:
                waiting = float(value)
        if last is not None:
            self.sent.update((last,))
        if waiting is None:
            self.pending.clear()
        else:
            self.pending.update((waiting,))
            self.handle.registerTimer(last + self.every_ms)
        yield pd.DataFrame(out, columns=["book_id", "medium", "at_ms", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.pending.exists() and self.sent.exists() and self.sent.get()[0] + self.every_ms == due:
            out.append((key[0], key[1], due, self.pending.get()[0]))
            self.sent.update((due,))
            self.pending.clear()
        yield pd.DataFrame(out, columns=["book_id", "medium", "at_ms", "value"])

    def close(self) -> None:
        pass


def stream_throttle(events: DataFrame, watermark: str = "10 seconds", every_ms: int = 30_000) -> DataFrame:
    """``events(book_id, medium, ts, value, now)`` to the updates actually sent; nothing pending is lost."""
    e = events.withWatermark("ts", watermark).withColumn("at_ms", F.unix_millis("ts"))
    return e.groupBy("book_id", "medium").transformWithStateInPandas(
        Throttle(every_ms), outputStructType="book_id bigint, medium string, at_ms bigint, value double", outputMode="Append", timeMode="EventTime")


SAME_AUDIO_MS = 45_000
SAME_TEXT_CHARS = 1_500


def newer_elsewhere(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Offer another device's place when it is news and far enough from our own; works stream-static too.

    ``remote(book_id, medium, at_s, fraction, when_ms)``; ``local(book_id, audio_ms, text_offset,
    text_length, active_ms, seen_ms)``.
    """
    j = remote.join(local, "book_id")
    news = (F.col("when_ms") > F.coalesce("seen_ms", F.lit(0))) & (F.col("when_ms") > F.coalesce("active_ms", F.lit(0)) + 10_000)
    audio = F.rint(F.col("at_s") * 1000).cast("bigint")
    text = F.rint(F.col("fraction") * F.col("text_length")).cast("int")
    far_audio = (audio > 0) & (F.abs(audio - F.coalesce("audio_ms", F.lit(0))) >= SAME_AUDIO_MS)
    far_text = (F.col("text_length") > 0) & (F.abs(text - F.coalesce("text_offset", F.lit(0))) >= SAME_TEXT_CHARS)
    is_audio = F.col("medium") == "audio"
    return j.filter(news & F.when(is_audio, far_audio).otherwise(far_text)).select(
        "book_id", "medium", "when_ms", F.when(is_audio, audio).alias("audio_at"), F.when(~is_audio, text).alias("text_at"))


def _worth_keeping(within: int) -> Column:
    p = F.col("position")
    return (p >= F.col("from")) & (p <= F.col("to")) & (F.col("to") - p > within)


def chapter_resume(events: DataFrame, within: int = 20_000) -> DataFrame:
    """Where to go on in a chapter entered again: the place it was last left at, once.

    ``events(book_id, chapter_idx, seq, kind, position, from, to)``.  Only the event just before an enter
    can still be stored: an enter consumes it, a leave near the end or out of range removes it.
    """
    keyed = events.withColumn("__kept", F.when((F.col("kind") == "leave") & _worth_keeping(within), F.col("position")))
    s = P.scan_ranges(keyed, ["book_id", "chapter_idx"], ["seq"], {"resume_at": P.previous(F.col("__kept"))})
    return s.filter("kind = 'enter'").select("book_id", "chapter_idx", "seq", "resume_at")


class Resume(StatefulProcessor):
    """One stored position per chapter of a book."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "chapter int", "position bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            chapter = (int(e.chapter_idx),)
            if e.kind == "enter":
                stored = self.places.getValue(chapter)[0] if self.places.containsKey(chapter) else None
                out.append((key[0], chapter[0], int(e.seq), stored))
            if self.places.containsKey(chapter):
                self.places.removeKey(chapter)
            if e.kind == "leave" and e.start <= e.position <= e.to and e.to - e.position > self.within:
                self.places.updateValue(chapter, (int(e.position),))
        yield pd.DataFrame(out, columns=["book_id", "chapter_idx", "seq", "resume_at"]).astype({"resume_at": "Int64"})

    def close(self) -> None:
        pass


def stream_resume(events: DataFrame, within: int = 20_000) -> DataFrame:
    return events.withColumnRenamed("from", "start").groupBy("book_id").transformWithStateInPandas(
        Resume(within), outputStructType="book_id bigint, chapter_idx int, seq bigint, resume_at bigint", outputMode="Append", timeMode="None")


def coverage_sessions(events: DataFrame, gap: str = "15 seconds") -> DataFrame:
    """Listened spans: events no further apart than the gap.  The measure is last minus first, not the window."""
    return events.groupBy("book_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("events")).select(
        "book_id", "from_ts", "to_ts", "events")


def lead_windows(heads: DataFrame, chapters: DataFrame, anchors: DataFrame, window_ms: int = 15_000, lead_ms: int = 120_000,
                 shortest_ms: int = 2_000) -> DataFrame:
    """Windows to hear next, from each head up to the lead: cut at chapter ends, short tails and covered ones skipped.

    ``heads(head_id, book_id, head_ms)``.  Work goes on into the next chapter only where it follows
    without a hole, so chapters carry the start of their gapless run.
    """
    c = chapters.select("book_id", "chapter_idx", "start_ms", "end_ms")
    c = P.scan(c, ["book_id"], ["start_ms"], A.ms_slice("start_ms"), {"__pe": P.previous(F.col("end_ms"))})
    c = c.withColumn("__fresh", F.when(F.col("__pe").isNull() | (F.col("__pe") != F.col("start_ms")), F.col("start_ms")))
    c = P.stage(P.scan(c, ["book_id"], ["start_ms"], A.ms_slice("start_ms"), {"run": P.last_known(F.col("__fresh"))}).select(
        "book_id", "chapter_idx", "start_ms", "end_ms", "run"))
    own = P.bracket(heads, c, ["book_id"], "head_ms", "start_ms", ["end_ms", "run"], 600_000)
    own = own.filter("head_ms < lo.end_ms").select("head_id", "book_id", "head_ms", F.col("lo.run").alias("run"))
    step = lead_ms
    asked = own.withColumn("__b", F.explode(F.sequence(P.slice_of("head_ms", step), P.slice_of(F.col("head_ms") + lead_ms, step))))
    held = c.withColumn("__b", F.explode(F.sequence(P.slice_of("start_ms", step), P.slice_of(F.col("end_ms") - 1, step))))
    j = asked.join(held, ["book_id", "run", "__b"]).filter("end_ms > head_ms and start_ms <= head_ms + %d" % lead_ms)
    j = j.select("head_id", "book_id", "head_ms", "chapter_idx", "start_ms", "end_ms").distinct()
    begin = F.greatest("start_ms", "head_ms")
    w = j.select("head_id", "book_id", "chapter_idx", "end_ms", F.explode(F.sequence(
        begin, F.least(F.col("end_ms") - 1, F.col("head_ms") + lead_ms), F.lit(window_ms))).alias("from_ms"))
    w = w.withColumn("to_ms", F.least(F.col("from_ms") + window_ms, F.col("end_ms"))).filter(F.col("to_ms") - F.col("from_ms") >= shortest_ms)
    return M.contains(w.drop("end_ms"), anchors, window_ms).filter("not covered").drop("covered")
