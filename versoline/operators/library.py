"""The library's tables: filters, pairing, attaching, chapters, shelves and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import primitives as P
from versoline.semantics import MAP_VERSION, AlignSettings, blank

# --- projections and filters ------------------------------------------------------------------


def present(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def media_flags(books: DataFrame) -> DataFrame:
    paired = present("audio_path") & present("ebook_path")
    return books.withColumns({
        "has_audio": present("audio_path"), "has_text": present("ebook_path"), "is_paired": paired,
        "has_usable_sync": paired & F.col("sync_state").isin("Partial", "Complete")})


def speech(segments: DataFrame, max_no_speech: float = 0.6) -> DataFrame:
    """Segments that hold speech: in order, likely enough, and with at least one word."""
    return segments.filter("end_ms >= start_ms").filter(F.col("no_speech") < max_no_speech).filter(F.size(X.words(F.col("text"))) > 0)


def word_times_valid(segments: DataFrame, words: DataFrame, keys: list[str], tol_ms: int = 1_000) -> DataFrame:
    """One word too far outside its segment discards all the segment's times; the rest are clamped into it.

    Returns words of trusted segments; segments without any go to an even spread.
    """
    j = words.join(segments.select(*keys, "start_ms", "end_ms"), keys)
    off = (F.col("at_ms") < F.col("start_ms") - tol_ms) | (F.col("at_ms") > F.col("end_ms") + tol_ms)
    bad = j.filter(off).select(*keys).distinct()
    return j.join(bad, keys, "left_anti").withColumn(
        "at_ms", F.least(F.greatest("at_ms", "start_ms"), "end_ms")).drop("start_ms", "end_ms")


def in_time_window(ts: Column, from_s: int, to_s: int) -> Column:
    """Time of day inside [from, to), which may wrap midnight."""
    day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    inside = [day >= from_s, day < to_s]
    return inside[0] & inside[1] if from_s < to_s else inside[0] | inside[1]


def time_of_day(df: DataFrame, ts: str, from_s: int, to_s: int) -> DataFrame:
    """Rows inside the window, with seconds left until it closes."""
    day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    left = F.lit(to_s) - day
    return df.filter(in_time_window(F.col(ts), from_s, to_s)).withColumn(
        "remaining_s", F.when(left > 0, left).otherwise(left + 86_400))


def progress(books: DataFrame, state: DataFrame) -> DataFrame:
    """Share of the audio heard, whether to show it, and whether the book counts as finished."""
    j = books.select("book_id", "duration_ms").join(state.select("book_id", "audio_ms"), "book_id", "left")
    share = F.when(F.col("duration_ms") > 0, F.least(F.greatest(
        F.coalesce("audio_ms", F.lit(0)).cast("double") / F.col("duration_ms"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return j.select("book_id", share.alias("progress"), (share > 0.001).alias("shown"), (share >= 0.99).alias("finished"))


# Working presets (name, duty cycle, realtime factor).
PRESETS = [("eco", 0.25, 2.0), ("balanced", 0.5, 4.0), ("turbo", 1.0, 8.0)]


def cost_estimate(books: DataFrame, s: AlignSettings = AlignSettings()) -> DataFrame:
    """Estimated alignment time per book and preset; the presets are a constant, exploded in place."""
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(d).alias("duty"), F.lit(r).alias("rtf")) for n, d, r in PRESETS])
    share = min(max(s.probe_ms / s.interval_ms, 0.0), 1.0)
    b = books.select("book_id", "duration_ms", F.explode(presets).alias("p"))
    ms = F.col("duration_ms") * F.lit(share) / F.greatest(F.col("p.rtf"), F.lit(0.1)) / F.least(
        F.greatest(F.col("p.duty"), F.lit(0.05)), F.lit(1.0))
    return b.select("book_id", "p.preset", ms.alias("ms"))


# Quality -> probe ms, interval ms, model; words for the distance between anchors.
QUALITIES = {"light": (10_000, 60_000, "tiny"), "better": (15_000, 30_000, "base"), "best": (15_000, 30_000, "base")}
ANCHOR_WORDS = {"sparse": 60, "rijetko": 60, "medium": 30, "srednje": 30, "dense": 15, "gusto": 15}


def anchor_seconds(c: Column) -> Column:
    """A word, or 5..600 seconds with or without an ``s``; null otherwise."""
    t = F.lower(F.trim(c))
    words = F.create_map(*[F.lit(x) for kv in ANCHOR_WORDS.items() for x in kv])
    number = F.regexp_replace(t, "s+$", "").try_cast("int")
    return F.coalesce(F.try_element_at(words, t), F.when(number.between(5, 600), number))


def recipe(books: DataFrame, default_quality: str = "better", default_anchor_s: int | None = None) -> DataFrame:
    """Quality, probe and interval per book; its own settings win over the defaults.

    ``books(book_id, quality, anchors, model)`` with null where a book has no setting.
    """
    q = F.coalesce(F.when(F.col("quality").isin(*QUALITIES), F.col("quality")), F.lit(default_quality))
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in QUALITIES.items() for x in (k, v[i])])[q]
    seconds = F.coalesce(anchor_seconds(F.col("anchors")), F.lit(default_anchor_s).cast("int"))
    b = books.select("book_id", q.alias("quality"), F.coalesce("model", pick(2)).alias("model"), pick(0).alias("__p"),
                     F.coalesce(seconds * 1000, pick(1)).alias("interval_ms"))
    name = F.when(F.col("quality") == "best", F.lit("best")).otherwise(
        F.concat_ws(", ", "quality", "model", F.concat(F.expr("interval_ms div 1000"), F.lit(" s"))))
    return b.select("book_id", name.alias("recipe"), F.least("__p", "interval_ms").alias("probe_ms"), "interval_ms")


# --- joins ------------------------------------------------------------------------------------

def names_union(books: DataFrame) -> DataFrame:
    """The distinct set of a book's comparable names: its source and its stored locations."""
    names = F.array(
        F.when(~blank(F.col("source_name")), X.name_key(F.col("source_name"))),
        *[F.when(~blank(F.col(c)), X.copy_free_key(F.col(c))) for c in ("audio_path", "original_audio_path", "ebook_path")])
    return books.select("book_id", F.explode(F.array_distinct(F.array_compact(names))).alias("name_key"))


def find_partner(files: DataFrame, books: DataFrame) -> DataFrame:
    """A new file joins the one book that lacks its half and shares a name; none or several: no answer.

    ``files(file_id, file_name, is_audio)``.  Names are aggregated to at most two candidates before the
    join, so a name shared by a third of the library costs one row.
    """
    f = media_flags(books)
    lacking = f.filter("has_audio <> has_text").select("book_id", "has_audio")
    by_name = names_union(books).join(lacking, "book_id").groupBy("name_key", "has_audio").agg(
        F.min("book_id").alias("lo"), F.max("book_id").alias("hi"))
    only = by_name.filter("lo = hi").select("name_key", (~F.col("has_audio")).alias("is_audio"), F.col("lo").alias("book_id"))
    named = files.withColumn("name_key", X.name_key(F.col("file_name"))).filter("name_key <> ''")
    return named.join(only, ["name_key", "is_audio"]).select("file_id", "file_name", "is_audio", "book_id")


def by_pair_hash(maps: DataFrame, books: DataFrame, block: int = 4096) -> DataFrame:
    """Maps of the current version to the books made of the same two files.

    A pair of files gives every map times every book, so its rows may be many where its bytes are few.  A pair with more than
    ``block`` maps or books is cut into a grid of about ``block`` by ``block``, and the number of tasks follows the rows returned.
    """
    pair = ["audio_hash", "ebook_hash"]
    whole = "audio_hash <> '' and ebook_hash <> ''"
    current = maps.filter(F.col("version") == MAP_VERSION).filter(whole)
    hashed = books.filter(whole).select("book_id", *pair)
    sides = current.select(*pair, F.lit(1).alias("m"), F.lit(0).alias("b")).unionByName(
        hashed.select(*pair, F.lit(0).alias("m"), F.lit(1).alias("b")))
    sizes = P.stage(sides.groupBy(*pair).agg(F.sum("m").alias("m"), F.sum("b").alias("b")))
    cuts = P.stage(sizes.filter(F.greatest("m", "b") > block).select(
        *pair, F.ceil(F.col("m") / block).alias("__across"), F.ceil(F.col("b") / block).alias("__down")))
    work = sizes.agg(F.sum(F.expr("m * b + m + b"))).first()[0] or 0
    usual = int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = 1 + min(work // 2**20, max(usual, work // block**2))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in one part of its own side, once per part of the other side (none: no row); pairs not cut are one part."""
        parts = df.join(cuts, pair, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__across", "__down")})
        copies = F.when(F.col(other) > 0, F.sequence(F.lit(1).cast("bigint"), other))
        return parts.select(*df.columns, (F.pmod(F.xxhash64(key), own) + 1).alias(f"{own}_at"), F.explode(copies).alias(f"{other}_at")).repartition(
            tasks, *pair, "__across_at", "__down_at")

    m = dealt(current, "map_id", "__across", "__down")
    b = dealt(hashed, "book_id", "__down", "__across")
    return m.join(b, [*pair, "__across_at", "__down_at"]).drop("__across_at", "__down_at")


def adopt_ranges(ranges: DataFrame, chapters: DataFrame) -> DataFrame:
    """Take text ranges over where the chapter counts agree and both ends are known."""
    r_n = ranges.groupBy("book_id").agg(F.count("*").alias("__r"))
    c_n = chapters.groupBy("book_id").agg(F.count("*").alias("__c"))
    agreed = r_n.join(c_n, "book_id").filter("__r = __c").select("book_id")
    known = ranges.filter("text_start is not null and text_end is not null").join(agreed, "book_id", "left_semi").select(
        "book_id", "chapter_idx", F.col("text_start").alias("__s"), F.col("text_end").alias("__e"))
    j = chapters.join(known, ["book_id", "chapter_idx"], "left")
    return j.withColumns({"text_start": F.coalesce("__s", "text_start"), "text_end": F.coalesce("__e", "text_end")}).drop("__s", "__e")


def media_path(paths: DataFrame, books: DataFrame) -> DataFrame:
    """Book by any of its three locations (the lowest id where several share one)."""
    owned = books.select("book_id", F.explode(F.array_compact(F.array("audio_path", "original_audio_path", "ebook_path"))).alias("path"))
    owner = owned.groupBy("path").agg(F.min("book_id").alias("book_id"))
    return paths.join(owner, "path", "left").select("path", "book_id")


def server_item(catalogue: DataFrame, books: DataFrame, default_server: str) -> DataFrame:
    """Which catalogue items are in the library already."""
    here = books.filter("server_item_id is not null").select(
        F.col("server_item_id").alias("item_id"), F.coalesce("server_id", F.lit(default_server)).alias("server_id"), "book_id")
    here = here.groupBy("item_id", "server_id").agg(F.min("book_id").alias("book_id"))
    return catalogue.join(here, ["item_id", "server_id"], "left")


def orphan_files(files: DataFrame, books: DataFrame, now_ms: Column, rest_ms: int = 120_000,
                 columns: tuple[str, ...] = ("audio_path", "original_audio_path", "ebook_path", "cover_path")) -> DataFrame:
    """Files no book uses, untouched long enough."""
    used = books.select(F.explode(F.array_compact(F.array(*[F.col(c) for c in columns if c in books.columns]))).alias("path")).distinct()
    return files.filter(now_ms - F.col("mtime") >= rest_ms).join(used, "path", "left_anti")


def cascade_delete(deleted: DataFrame, *children: DataFrame) -> list[DataFrame]:
    return [c.join(deleted.select("book_id").distinct(), "book_id", "left_anti") for c in children]


def carry_ranges(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """New chapters take the old text range of their index where they have none."""
    old = existing.select("book_id", "chapter_idx", F.col("text_start").alias("__s"), F.col("text_end").alias("__e"))
    j = incoming.join(old, ["book_id", "chapter_idx"], "left")
    return j.withColumns({"text_start": F.coalesce("text_start", "__s"), "text_end": F.coalesce("text_end", "__e")}).drop("__s", "__e")


# --- state changes ----------------------------------------------------------------------------

def sync_state(books: DataFrame, chapters: DataFrame, maps: DataFrame) -> DataFrame:
    """State from pairing, a matching map and how far it reaches without a hole.

    ``maps(book_id, chapter_idx, version, audio_hash, ebook_hash)``: non-empty chapter maps.  They reach
    through chapter k when the k + 1 lowest are exactly 0 .. k: the first index that differs from its
    place is the first hole.
    """
    mine = maps.filter(F.col("version") == MAP_VERSION).join(
        books.select("book_id", "audio_hash", "ebook_hash"), ["book_id", "audio_hash", "ebook_hash"]).select("book_id", "chapter_idx").distinct()
    placed = P.scan(mine, ["book_id"], ["chapter_idx"], P.slice_of("chapter_idx", 4096), {"place": P.row_index()})
    reach = placed.groupBy("book_id").agg(
        F.coalesce(F.max(F.when(F.col("place") == F.col("chapter_idx"), F.col("chapter_idx"))), F.lit(-1)).alias("__reach"))
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("__n"))
    b = media_flags(books).join(reach, "book_id", "left").join(counts, "book_id", "left")
    reached = F.when(F.col("is_paired"), F.coalesce("__reach", F.lit(-1))).otherwise(F.lit(-1))
    state = F.when(~F.col("is_paired"), "NotPaired").when(reached < 0, "Pending").when(
        reached >= F.coalesce("__n", F.lit(0)) - 1, "Complete").otherwise("Partial")
    return b.select(*[c for c in books.columns if c not in ("sync_state", "aligned_through")],
                    state.alias("sync_state"), reached.cast("int").alias("aligned_through"))


def detach(books: DataFrame, chapters: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove one medium per changed book; removing the only one is refused.

    ``changes(book_id, medium)`` with ``audio`` or ``text``.  Chapters keep only those with the other
    range, lose the removed one and are renumbered.  Returns books, chapters, refusals.
    """
    f = media_flags(books).join(changes, "book_id", "left")
    refused = (F.col("medium") == "audio") & ~F.col("has_text") | (F.col("medium") == "text") & ~F.col("has_audio")
    refusals = f.filter(refused).select("book_id", "medium", F.lit("would leave the book with nothing").alias("error"))
    accepted = f.filter(F.col("medium").isNotNull() & ~refused).select("book_id", "medium")
    b = books.join(accepted, "book_id", "left")
    gone = lambda m: F.coalesce(F.col("medium") == m, F.lit(False))
    cleared = {}
    for c, m, to in [("audio_path", "audio", None), ("audio_hash", "audio", None), ("duration_ms", "audio", 0),
                     ("ebook_path", "text", None), ("ebook_hash", "text", None), ("text_length", "text", 0)]:
        cleared[c] = F.when(gone(m), F.lit(to)).otherwise(F.col(c)).cast(books.schema[c].dataType)
    new_books = b.withColumns(cleared).drop("medium")
    c = chapters.join(accepted, "book_id", "left")
    has_text = F.col("text_start").isNotNull() & F.col("text_end").isNotNull()
    has_audio = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    untouched = c.filter("medium is null").drop("medium")
    kept = c.filter((F.col("medium") == "audio") & has_text | (F.col("medium") == "text") & has_audio)
    kept = P.scan(kept, ["book_id"], ["chapter_idx"], P.slice_of("chapter_idx", 4096), {"__i": P.row_index()})
    stripped = kept.withColumns({
        "chapter_idx": F.col("__i").cast("int"),
        **{x: F.when(~gone("audio"), F.col(x)) for x in ("start_ms", "end_ms")},
        **{x: F.when(~gone("text"), F.col(x)) for x in ("text_start", "text_end")}}).select(*chapters.columns)
    return new_books, untouched.select(*chapters.columns).unionByName(stripped), refusals


def attach_audio(books: DataFrame, chapters: DataFrame, audio: DataFrame, audio_chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audio side owns the chapters, which keep the text ranges already known; titles only fill blanks.

    ``audio(book_id, path, hash, duration_ms, title, author)``.
    """
    a = audio.select("book_id", *[F.col(c).alias(f"__{c}") for c in ("path", "hash", "duration_ms", "title", "author")])
    b = books.join(a, "book_id", "left")
    new = F.col("__path").isNotNull()
    updated = b.withColumns({
        "audio_path": F.when(new, F.col("__path")).otherwise(F.col("audio_path")),
        "audio_hash": F.when(new, F.col("__hash")).otherwise(F.col("audio_hash")),
        "duration_ms": F.when(new, F.col("__duration_ms")).otherwise(F.col("duration_ms")),
        "title": F.when(blank(F.col("title")), F.coalesce("__title", "title")).otherwise(F.col("title")),
        "author": F.coalesce("author", "__author")}).select(*books.columns)
    others = chapters.join(audio.select("book_id"), "book_id", "left_anti")
    mine = carry_ranges(audio_chapters, chapters.join(audio.select("book_id"), "book_id", "left_semi"))
    return updated, others.unionByName(mine.select(*chapters.columns))


def attach_text(books: DataFrame, chapters: DataFrame, texts: DataFrame, text_chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A text brings its chapters only to books without audio; titles only fill blanks.

    ``texts(book_id, path, hash, text_length, title, author)``.
    """
    a = texts.select("book_id", *[F.col(c).alias(f"__{c}") for c in ("path", "hash", "text_length", "title", "author")])
    b = media_flags(books).join(a, "book_id", "left")
    new = F.col("__path").isNotNull()
    silent = b.filter(new & ~F.col("has_audio")).select("book_id")
    updated = b.withColumns({
        "ebook_path": F.when(new, F.col("__path")).otherwise(F.col("ebook_path")),
        "ebook_hash": F.when(new, F.col("__hash")).otherwise(F.col("ebook_hash")),
        "text_length": F.when(new, F.col("__text_length")).otherwise(F.col("text_length")),
        "title": F.when(blank(F.col("title")), F.coalesce("__title", "title")).otherwise(F.col("title")),
        "author": F.coalesce("author", "__author")}).select(*books.columns)
    others = chapters.join(silent, "book_id", "left_anti")
    return updated, others.unionByName(text_chapters.join(silent, "book_id", "left_semi").select(*chapters.columns))


def reset_alignment(books: DataFrame, chapters: DataFrame, anchors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forget a book's map, its chapters' text ranges when it has audio, and its state."""
    marked = ids.select("book_id").distinct().withColumn("__reset", F.lit(True))
    f = media_flags(books).join(marked, "book_id", "left")
    hit = F.coalesce("__reset", F.lit(False))
    state = F.when(hit, F.when(F.col("is_paired"), "Pending").otherwise("NotPaired")).otherwise(F.col("sync_state"))
    through = F.when(hit, F.lit(-1)).otherwise(F.col("aligned_through"))
    new_books = f.withColumns({"sync_state": state, "aligned_through": through}).select(*books.columns)
    voiced = f.filter(hit & F.col("has_audio")).select("book_id").withColumn("__clear", F.lit(True))
    c = chapters.join(voiced, "book_id", "left")
    both = F.col("text_start").isNotNull() & F.col("text_end").isNotNull() & F.coalesce("__clear", F.lit(False))
    new_chapters = c.withColumns({x: F.when(~both, F.col(x)) for x in ("text_start", "text_end")}).select(*chapters.columns)
    return new_books, new_chapters, anchors.join(marked, "book_id", "left_anti")


# --- chapters ---------------------------------------------------------------------------------

def numbered(title: Column, idx: Column, word: str = "Chapter") -> Column:
    return F.when(blank(title), F.concat(F.lit(f"{word} "), idx + 1)).otherwise(F.trim(title))


def repair_timeline(marks: DataFrame, durations: DataFrame, order: list[str] = ["start_ms"]) -> DataFrame:
    """Raw marks to ordered, gapless chapters; a book without usable marks is one chapter.

    ``order`` breaks ties between equal starts; ``durations(book_id, duration_ms, title)``.
    """
    m = marks.join(durations.select("book_id", "duration_ms"), "book_id").filter("start_ms < duration_ms")
    s = P.scan(m, ["book_id"], order, P.slice_of("start_ms", 3_600_000), {
        "__i": P.row_index(), "__n": P.following(F.col("start_ms"))})
    nxt = F.coalesce("__n", "duration_ms")
    end = F.when((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") <= nxt), F.col("end_ms")).otherwise(nxt)
    got = s.select("book_id", F.col("__i").cast("int").alias("chapter_idx"), numbered(F.col("title"), F.col("__i")).alias("title"),
                   "start_ms", end.alias("end_ms"))
    bare = durations.join(m.select("book_id").distinct(), "book_id", "left_anti").select(
        "book_id", F.lit(0).alias("chapter_idx"), numbered(F.col("title"), F.lit(0)).alias("title"),
        F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return got.unionByName(bare)


def concat_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One chapter per file in natural order, cumulative times; the first non-blank album and artist.

    ``files(book_id, file_name, title, length_ms DOUBLE, album, artist)``.
    """
    key = X.natural_key(F.col("file_name"))
    f = files.withColumn("__ms", F.rint("length_ms").cast("bigint")).withColumn("__k", key)
    s = P.scan_ranges(f, ["book_id"], ["__k", "file_name"], {
        "__i": P.row_index(), "__end": P.running_sum(F.col("__ms"))})
    chapters = s.select(
        "book_id", F.col("__i").cast("int").alias("chapter_idx"),
        F.when(blank(F.col("title")), F.regexp_replace("file_name", "\\.[^.]*$", "")).otherwise(F.trim("title")).alias("title"),
        (F.col("__end") - F.col("__ms")).alias("start_ms"), F.col("__end").alias("end_ms"))
    first = lambda c: F.min_by(F.trim(c), F.when(~blank(F.col(c)), F.struct("__k", "file_name")))
    books = f.groupBy("book_id").agg(first("album").alias("title"), first("artist").alias("author"),
                                     F.sum("__ms").alias("duration_ms"), F.count("*").alias("files"))
    return chapters, books


def chapters_from_marks(marks: DataFrame, texts: DataFrame, spine: DataFrame) -> DataFrame:
    """Table-of-contents marks to chapters that tile the text; a book without marks has one per document.

    ``marks(book_id, ord, title, offset)``; ``texts(book_id, text_length)``; ``spine(book_id, spine_idx,
    text_start)``.
    """
    named = marks.groupBy("book_id", "offset").agg(F.min_by("title", "ord").alias("title"))
    per_doc = spine.join(marks.select("book_id").distinct(), "book_id", "left_anti").groupBy(
        "book_id", F.col("text_start").alias("offset"), "spine_idx").agg(F.first(F.concat(F.lit("Section "), F.col("spine_idx") + 1)).alias("title"))
    m = named.withColumn("spine_idx", F.lit(0)).unionByName(per_doc)
    s = P.scan_ranges(m, ["book_id"], ["offset", "spine_idx"], {
        "__i": P.row_index(), "__n": P.following(F.col("offset"))})
    return s.join(texts.select("book_id", "text_length"), "book_id").select(
        "book_id", F.col("__i").cast("int").alias("chapter_idx"), numbered(F.col("title"), F.col("__i")).alias("title"),
        F.when(F.col("__i") == 0, F.lit(0)).otherwise(F.col("offset")).alias("text_start"),
        F.coalesce("__n", "text_length").alias("text_end"))


def outline_level(outline: DataFrame, pages: DataFrame, enough: int = 3, per_section: int = 20) -> DataFrame:
    """Chapter pages from an outline: the shallowest level that, with those above, names enough pages.

    ``outline(book_id, ord, level, title, page)`` 1-based pages, ``pages(book_id, page_count)``.  A page
    belongs to the shallowest level naming it, so the distinct pages down to a level are a running sum
    over the few levels.  Returns marks(book_id, title, page) with 0-based pages.
    """
    o = outline.join(pages, "book_id").filter("page >= 1 and page <= page_count")
    first_seen = o.groupBy("book_id", "page").agg(F.min("level").alias("level"))
    per_level = o.select("book_id", "level").distinct().join(
        first_seen.groupBy("book_id", "level").agg(F.count("*").alias("k")), ["book_id", "level"], "left")
    upto = P.scan(per_level, ["book_id"], ["level"], P.slice_of("level", 64), {"upto": P.running_sum(F.coalesce("k", F.lit(0)))})
    chosen = upto.groupBy("book_id").agg(
        F.coalesce(F.min(F.when(F.col("upto") >= enough, F.col("level"))), F.max("level")).alias("__level"))
    one = o.join(chosen, "book_id").filter("level <= __level").groupBy("book_id", "page").agg(
        F.min_by("title", "ord").alias("title"))
    s = P.scan(one, ["book_id"], ["page"], P.slice_of("page", 4096), {"__i": P.row_index()})
    named = s.select("book_id", numbered(F.col("title"), F.col("__i")).alias("title"),
                     F.when(F.col("__i") == 0, F.lit(0)).otherwise(F.col("page") - 1).cast("int").alias("page"))
    plain = pages.join(o.select("book_id").distinct(), "book_id", "left_anti").filter("page_count > 0").select(
        "book_id", F.explode(F.sequence(F.lit(0), F.expr(f"cast((page_count - 1) div {per_section} as int)"))).alias("__i"))
    return named.unionByName(plain.select(
        "book_id", F.concat(F.lit("Section "), F.col("__i") + 1).alias("title"), (F.col("__i") * per_section).alias("page")))


def chapters_from_anchors(text_chapters: DataFrame, anchors: DataFrame, durations: DataFrame) -> DataFrame:
    """Chapter times from the first anchor in each chapter's text; starts strictly increase, the first is 0.

    Text chapters are disjoint, so an anchor's chapter is an as-of join.
    """
    c = text_chapters.filter("text_start is not null").select(
        "book_id", F.col("text_start").cast("bigint").alias("__s"), F.coalesce("text_end", F.lit(2**31 - 1)).alias("__e"), "title")
    b = P.bracket(anchors, c, ["book_id"], "char_offset", "__s", ["__e", "title"], 60_000)
    starts = b.filter("char_offset < lo.__e").groupBy("book_id", F.col("lo.__s").alias("from")).agg(
        F.min_by("audio_ms", F.struct("char_offset", "audio_ms")).alias("at"), F.first("lo.title").alias("title"))
    s = P.scan_ranges(starts, ["book_id"], ["from"], {"__m": P.max_before(F.col("at"))})
    s = s.filter("__m is null or at > __m").drop("__m")
    s = P.scan_ranges(s, ["book_id"], ["from"], {"__i": P.row_index(), "__n": P.following(F.col("at"))})
    start = F.when(F.col("__i") == 0, F.lit(0)).otherwise(F.col("at"))
    got = s.join(durations.select("book_id", "duration_ms"), "book_id").select(
        "book_id", F.col("__i").cast("int").alias("chapter_idx"), "title", start.alias("start_ms"),
        F.coalesce(F.col("__n"), F.greatest(F.col("duration_ms"), start + 1)).alias("end_ms"))
    bare = durations.join(starts.select("book_id").distinct(), "book_id", "left_anti").select(
        "book_id", F.lit(0).alias("chapter_idx"), F.lit("Chapter 1").alias("title"), F.lit(0).cast("bigint").alias("start_ms"),
        F.greatest("duration_ms", F.lit(1)).alias("end_ms"))
    return got.unionByName(bare)


def server_marks(marks: DataFrame, books: DataFrame) -> DataFrame:
    """Server chapter marks in seconds to milliseconds (half-even); a book without any is one chapter.

    ``marks(book_id, chapter_idx, title, start_s DOUBLE, end_s DOUBLE)``.
    """
    m = marks.select("book_id", "chapter_idx", "title", F.rint(F.col("start_s") * 1000).cast("bigint").alias("start_ms"),
                     F.rint(F.col("end_s") * 1000).cast("bigint").alias("end_ms")).filter("end_ms > start_ms")
    bare = books.join(m.select("book_id").distinct(), "book_id", "left_anti").select(
        "book_id", F.lit(0).alias("chapter_idx"), "title", F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return m.unionByName(bare)


def bookmark_list(bookmarks: DataFrame, chapters: DataFrame, limit: int = 50) -> DataFrame:
    """Bookmarks with their chapter, in place order; ``over_limit`` marks those a book of ``limit`` would not have taken.

    ``bookmarks(book_id, bookmark_id, position_ms, text_offset, created)``; the chapter of a position is
    the last one starting at or before it, of a text bookmark the first.  Being over the limit is decided
    by a running count along the creation time.
    """
    s = P.scan(bookmarks, ["book_id"], ["created", "bookmark_id"], F.date_trunc("day", "created"), {"__n": P.row_index()})
    kept = s.withColumn("over_limit", F.col("__n") >= limit).drop("__n")
    starts = chapters.filter("start_ms is not null and end_ms is not null").select("book_id", "chapter_idx", "start_ms")
    b = P.bracket(kept, starts, ["book_id"], "position_ms", "start_ms", ["chapter_idx"], 600_000)
    b = b.withColumn("chapter_idx", F.when(F.col("position_ms").isNull(), F.lit(0)).otherwise(F.coalesce("lo.chapter_idx", F.lit(0)))).drop("lo", "hi")
    b = b.join(chapters.select("book_id", "chapter_idx", "title"), ["book_id", "chapter_idx"], "left")
    b = b.withColumn("place", F.coalesce("position_ms", "text_offset", F.lit(0)))
    ordered = P.scan(b, ["book_id"], ["place", "created", "bookmark_id"], P.slice_of("place", 3_600_000), {"row": P.row_index()})
    return ordered.select("book_id", "bookmark_id", "chapter_idx", numbered(F.col("title"), F.col("chapter_idx")).alias("chapter"),
                          "place", F.col("row").cast("int").alias("row"), "over_limit")


# --- reports and shelves ----------------------------------------------------------------------

def status_report(state: DataFrame) -> DataFrame:
    timed = F.when(F.col("sentences") > 0, F.expr("timed * 100 div sentences"))
    return state.groupBy("status").agg(
        F.count("*").alias("books"), F.sum("hours").alias("hours"), F.sum("sentences").alias("sentences"),
        F.sum("timed").alias("timed"), F.min(timed).alias("worst_pct"), F.max(timed).alias("best_pct"),
        F.count("error").alias("errors"))


def write_report(sentences: DataFrame, times: DataFrame) -> DataFrame:
    """Per book: sentences, timed ones, documents, documents with any timed sentence."""
    j = sentences.join(times.select("book_id", "idx", F.lit(True).alias("__t")), ["book_id", "idx"], "left")
    per_doc = j.groupBy("book_id", "spine_idx").agg(F.count("*").alias("s"), F.count("__t").alias("t"))
    return per_doc.groupBy("book_id").agg(
        F.sum("s").alias("sentences"), F.sum("t").alias("timed"), F.count("*").alias("documents"), F.count_if(F.col("t") > 0).alias("with_overlay"))


def corpus_profile(docs: DataFrame, languages: DataFrame) -> DataFrame:
    """Per source: documents, characters, lines and the most frequent language."""
    j = docs.join(languages.select("doc_id", "language"), "doc_id", "left")
    per = j.groupBy("source", "language").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))
    top = F.max_by("language", F.when(F.col("language").isNotNull(), F.struct("n", "language")))
    return per.groupBy("source").agg(F.sum("n").alias("documents"), F.sum("chars").alias("characters"),
                                     F.sum("lines").alias("lines"), top.alias("language"))


def shelf_recent(books: DataFrame, n: int = 12) -> DataFrame:
    return books.filter("added is not null").orderBy(F.col("added").desc(), F.col("book_id")).limit(n)


def shelf_series(books: DataFrame) -> DataFrame:
    """Shelves by series; inside by number, unnumbered last, then title; loose books on a shelf of their own.

    The shelf of loose books may be most of the library, so it is ranked in slices of its order too.
    """
    b = books.withColumn("shelf", F.coalesce("series", F.lit("")))
    number = F.when(F.col("series").isNull(), F.lit(0.0)).otherwise(F.coalesce("seq_no", F.lit(float("inf"))))
    b = b.withColumn("__n", number).withColumn("__t", F.when(F.col("series").isNull(), F.lower("title")).otherwise(F.col("title")))
    s = P.scan_ranges(b, ["shelf"], ["__n", "__t", "book_id"], {"position": P.row_index()})
    return s.drop("__n", "__t")


def shelf_order(books: DataFrame) -> DataFrame:
    """Books newest use first; the place is a running count over days, so no global window is needed."""
    at = F.coalesce("last_opened", "added")
    b = books.withColumn("used_at", at).filter("used_at is not null").withColumn("__day", -F.datediff(F.col("used_at").cast("date"), F.lit("1970-01-01").cast("date")))
    b = b.withColumn("__rev", -F.unix_micros(F.col("used_at").cast("timestamp"))).withColumn("__all", F.lit(0))
    s = P.scan(b, ["__all"], ["__day", "__rev", "book_id"], F.col("__day"), {"place": P.row_index()})
    return s.drop("__day", "__rev", "__all")
