"""Corpus text jobs.  Documents are processed in their own rows wherever the result is per document."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import primitives as P

# Elements that break lines, and elements that carry no text.
BLOCK_ELEMENTS = (
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr "
    "li main nav ol p pre section table tbody td tfoot th thead tr ul").split()
SKIPPED_ELEMENTS = "script style noscript head svg template".split()
# Regular expressions in order; every one is understood alike by Java and by RE2.
HTML_STEPS = [
    ("(?s)<!--.*?-->", ""),
    ("(?is)^.*?<body[^>]*>", ""),
    ("(?is)</body>.*$", ""),
    *[(f"(?is)<{e}\\b[^>]*>.*?</{e}\\s*>", "") for e in SKIPPED_ELEMENTS],
    ("(?s)[\\s ]+", " "),
    (f"(?i)</?({'|'.join(BLOCK_ELEMENTS)})\\b[^>]*>", "\n"),
    ("(?s)<[a-zA-Z/!][^>]*>", ""),
]
HTML_TIDY = [("[  ]+", " "), (" *\n[ \n]*", "\n"), ("^[ \n]+", ""), ("[ ]+$", "")]


def decode_entities(c: Column) -> Column:
    """Numeric and HTML 4 named entities (and ``&apos;``) in one pass, so that ``&amp;lt;`` becomes ``&lt;``.

    What names no character stays as written.
    """
    names = {**name2codepoint, "apos": 0x27}
    known = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(chr(v)) for v in names.values())))

    def character(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decoded(t: Column) -> Column:
        body = F.substring(t, 2, F.length(t) - 2)
        number = (F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, F.length(body)), 16, 10))
                  .when(body.startswith("#"), F.substring(body, 2, F.length(body))))
        meant = F.when(number.isNotNull(), character(number.try_cast("bigint"))).otherwise(F.try_element_at(known, body))
        return F.when(t.startswith("&") & t.endswith(";"), F.coalesce(meant, t)).otherwise(t)

    parts = X.matches(c, "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&")
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Visible text of a page: one line per block, white space runs as one space across inline tags.

    Malformed nesting is read as written (tags are not balanced first).
    """
    for pattern, to in HTML_STEPS:
        c = F.regexp_replace(c, pattern, to)
    c = decode_entities(c)
    for pattern, to in HTML_TIDY:
        c = F.regexp_replace(c, pattern, to)
    return c


def concat_ranges(docs: DataFrame, book: str, order: str, length: Column, width: int = 4096) -> DataFrame:
    """Each document's [text_start, text_end) in its book's running text (the book is not put together)."""
    s = P.scan(docs.withColumn("__len", length), [book], [order], P.slice_of(order, width),
               {"text_end": P.running_sum(F.col("__len"))})
    return s.withColumn("text_start", F.col("text_end") - F.col("__len")).drop("__len")


# --- sentences --------------------------------------------------------------------------------

# Abbreviations a period does not end.
ABBREVIATIONS = (
    "mr mrs ms messrs dr prof st sr jr capt col gen lt sgt rev hon gđa gđica mag "
    "vs etc inc ltd co no vol ch chap pp fig cf al approx est ed eds trans op cit ibid "
    "ave blvd rd mt ft npr itd tzv str god sv ul br odn usp tj dipl").split()
TERMINATORS = ".!?…"
CLOSERS = "\"'»”’)\\]}"
OPENERS = "\"'«“‘(\\[—–"


# Unicode white space other than the line feed.
SPACE = " \\t\\x0B\\f\\r\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def _sentence_mask(c: Column, abbreviations: list[str]) -> Column:
    """Same text, same length, with U+0002 where white space separates two sentences.

    A terminator run ends a sentence when white space and then a sentence opening follow, unless its
    first mark is the period of an abbreviation or of a single letter.  A U+0002 of the text itself counts as U+0003.
    """
    c = F.translate(c, "\u0002", "\u0003")
    run_char = f"[{TERMINATORS}{CLOSERS}]"
    known = "|".join(sorted(abbreviations, key=len, reverse=True))
    period = f"(?<!(?:^|[^\\p{{L}}])(?iu:{known}|\\p{{L}}))\\."
    # The first look ahead changes no match: it spares all other characters the two looks behind.
    ends = (f"(?=[{TERMINATORS}])(?<![{TERMINATORS}]{run_char}{{0,40}})((?:{period}|[!?…]){run_char}*+)"
            f"[{SPACE}](?=[{SPACE}]*[\\p{{Lu}}\\p{{Nd}}{OPENERS}])")
    marked = F.regexp_replace(c, ends, "$1\u0002")
    # White space next to a separator belongs to no sentence.
    trailing = F.regexp_replace(marked, f"[{SPACE}](?=[{SPACE}]*(?:[\\n\u0002]|$))", "\u0002")
    return F.regexp_replace(trailing, f"(?:^|(?<=[\\n\u0002])|\\G)[{SPACE}]", "\u0002")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", abbreviations: list[str] | None = None) -> DataFrame:
    """Sentences with offsets, trimmed, in reading order; a newline always ends one."""
    m = docs.select(key, _sentence_mask(F.col(text), abbreviations or ABBREVIATIONS).alias("m"))
    z = F.arrays_zip(X.matches(F.col("m"), "[^\\n\u0002]+").alias("t"), X.run_starts(F.col("m"), "[^\\n\u0002]").alias("s"))
    rows = m.select(key, F.posexplode(z).alias("idx", "e"))
    return rows.select(key, "idx", F.col("e.s").cast("int").alias("start"),
                       (F.col("e.s") + F.length("e.t")).cast("int").alias("end"))


def sentence_pieces(ranges: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cut ranges by sentences into pieces inside one sentence or in none.

    Boundaries inside a range come from an equi-join on text buckets; each piece is then the stretch
    between two neighbouring boundaries, labelled by the sentence that holds it.
    ``ranges(key, range_id, start, end)`` with disjoint sentences(key, idx, start, end).
    """
    step = 1_000
    r = ranges.filter("end > start")
    reach = r.withColumn("__b", F.explode(F.sequence(P.slice_of("start", step), P.slice_of(F.col("end") - 1, step))))
    edges = sents.select(key, F.explode(F.array("start", "end")).alias("__e")).distinct().withColumn("__b", P.slice_of("__e", step))
    inner = reach.join(edges, [key, "__b"]).filter("__e > start and __e < end").select(
        key, "range_id", "start", "end", "__e")
    cuts = r.select(key, "range_id", "start", "end", F.col("start").alias("__e")).unionByName(inner)
    s = P.scan(cuts, [key, "range_id"], ["__e"], P.slice_of("__e", 16_384), {"__n": P.following(F.col("__e"))})
    pieces = s.select(key, "range_id", F.col("__e").alias("start"), F.coalesce("__n", "end").alias("end"))
    b = P.bracket(pieces, sents.withColumnRenamed("end", "s_end"), [key], "start", "start", ["s_end", "idx"], step)
    return b.select(key, "range_id", "start", "end",
                    F.when(F.col("start") < F.col("lo.s_end"), F.col("lo.idx")).alias("sentence_idx"))


# --- pages of lines ---------------------------------------------------------------------------

SENTENCE_END = "[.!?:…\"”’»«]\\s*$"


def pdf_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of a page to paragraphs.

    ``lines(page_id, line, left, right, bottom, height, text)``, top to bottom.  A paragraph starts at a
    gap clearly wider than usual, at an indented line, or after a line that ended short with a sentence.
    The usual gap is the upper median of the page's positive gaps, taken from a histogram.
    """
    key = ["page_id"]
    s = P.scan(lines, key, ["line"], P.slice_of("line", 8192), {
        "__pb": P.previous(F.col("bottom")), "__pr": P.previous(F.col("right")), "__pt": P.previous(F.col("text"))})
    s = s.withColumn("gap", F.col("__pb") - F.col("bottom"))
    hist = s.filter("gap > 0").groupBy("page_id", "gap").agg(F.count("*").alias("k"))
    upto = P.scan(hist, key, ["gap"], F.floor(F.col("gap") / 64), {"upto": P.running_sum(F.col("k"))})
    total = hist.groupBy("page_id").agg(F.sum("k").alias("gaps"))
    usual = upto.join(total, "page_id").groupBy("page_id").agg(
        F.min(F.when(F.col("upto") > F.expr("gaps div 2"), F.col("gap"))).alias("usual"))
    box = lines.groupBy("page_id").agg(F.min("left").alias("margin"), F.max("right").alias("edge"))
    j = s.join(box, "page_id").join(usual, "page_id", "left")
    fresh = (
        F.col("__pb").isNull()
        | ((F.col("usual") > 0) & (F.col("gap") > F.col("usual") * 1.4))
        | (F.col("left") > F.col("margin") + F.col("height") * 0.8)
        | ((F.col("__pr") < F.col("edge") - F.col("height") * 3) & F.col("__pt").rlike(SENTENCE_END)))
    j = j.withColumn("__new", F.coalesce(fresh, F.lit(False)).cast("int")).select("page_id", "line", "text", "__new")
    j = P.scan(j, key, ["line"], P.slice_of("line", 8192), {"para": P.running_sum(F.col("__new"))})
    return join_lines(j, [*key, "para"], "line")


def join_lines(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines of one paragraph as one text; a hyphen before a lower-case continuation is undone."""
    g = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, collapse(F.col("text")).alias("t")))).alias("l"))
    whole = F.array_join(F.col("l.t"), "\n")
    whole = F.regexp_replace(whole, "(\\p{L})-\\n(?=\\p{Ll})", "$1")
    return g.select(*keys, F.replace(whole, F.lit("\n"), F.lit(" ")).alias("text"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s\\p{Cc}]+", " "))


def is_page_number(c: Column) -> Column:
    """Only digits or roman letters after trimming dashes, dots and bars, one to eight of them."""
    core = F.regexp_replace(F.regexp_replace(c, "^[-–— .|\\s]+", ""), "[-–— .|\\s]+$", "")
    return core.rlike("^([0-9]{1,8}|[ivxlcdmIVXLCDM]{1,8})$")


def margin_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "\\p{Nd}", "")))


def repeated_margins(paragraphs: DataFrame, min_pages: int = 6, share: float = 0.3) -> DataFrame:
    """Drop running headers and footers.

    ``paragraphs(book, page, para, text)``.  The first and last paragraph of a page are compared without
    digits; a text on enough of all pages of the book is dropped there, first the head, then the foot.
    """
    page = ["book", "page"]
    sized = paragraphs.groupBy(*page).agg(
        F.count("*").alias("n"), F.min("para").alias("head"), F.max("para").alias("foot"))
    edges = paragraphs.join(sized.filter("n >= 2"), page).filter("para = head or para = foot").withColumn(
        "key", F.when(F.length("text") <= 80, margin_key(F.col("text")))).filter("key <> ''")
    seen = edges.groupBy("book", "key", "page").agg(F.lit(1).alias("one")).groupBy("book", "key").agg(F.count("*").alias("on_pages"))
    pages = sized.groupBy("book").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    repeated = seen.join(pages, "book").filter(F.col("on_pages") >= F.col("pages") * share).select("book", "key")
    drop = edges.join(repeated, ["book", "key"], "left_semi").select(*page, "para")
    return paragraphs.join(drop, [*page, "para"], "left_anti")


def page_join(paragraphs: DataFrame, chapter_pages: DataFrame) -> DataFrame:
    """The first paragraph of a page continues the last one when that is unfinished and this starts low.

    ``paragraphs(book, page, para, text)``; ``chapter_pages(book, page)`` start chapters.
    """
    marked = paragraphs.join(chapter_pages.withColumn("__chapter", F.lit(True)), ["book", "page"], "left")
    s = P.scan(marked, ["book"], ["page", "para"], P.slice_of("page", 512), {
        "__pt": P.previous(F.col("text")), "__pp": P.previous(F.col("page"))})
    goes_on = (
        (F.col("__pp") != F.col("page")) & F.col("__chapter").isNull() & (F.col("__pt") != "") & (F.col("text") != "")
        & ~F.col("__pt").rlike(SENTENCE_END) & ~F.col("text").rlike("^\\p{Lu}"))
    s = s.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    s = P.scan(s.drop("__pt", "__pp", "__chapter"), ["book"], ["page", "para"], P.slice_of("page", 512),
               {"block": P.running_sum(F.col("__new"))})
    return s.drop("__new")


# --- language ---------------------------------------------------------------------------------

# Function words per language, in the order that breaks ties.
SIGNATURES = {
    "en": "the and of to was that with his her which".split(),
    "hr": "je se na da su za koji bio kao ali".split(),
    "de": "der die und den nicht sich war mit auf ein".split(),
    "fr": "les des que pas pour dans une est qui avec".split(),
    "es": "que los las por con una para del como pero".split(),
    "it": "che non per con una sono come alla nel sua".split(),
}


def language(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language by function words of the whole text; null rather than a guess.  One pass in the document's own row."""
    w = docs.select(key, X.matches(F.lower(F.col(text)), "\\p{L}+").alias("w"))

    def hits(signature: list[str]) -> Column:
        return F.size(F.filter("w", lambda x: x.isin(signature)))

    counts = F.array(*[hits(s) for s in SIGNATURES.values()])
    c = w.select(key, F.size("w").alias("words"), counts.alias("counts"))
    c = c.withColumn("hits", F.array_max("counts")).withColumn("best", F.array_position("counts", F.col("hits")).cast("int"))
    others = F.filter("counts", lambda v, i: i != F.col("best") - 1)
    c = c.withColumn("runner_up", F.array_max(others))
    sure = (F.col("words") >= 50) & (F.col("hits") >= F.expr("words div 50")) & (F.col("hits") >= F.expr("runner_up * 3 div 2"))
    codes = F.array(*[F.lit(k) for k in SIGNATURES])
    return c.select(key, F.when(sure, F.element_at(codes, F.col("best"))).alias("language"), "hits", "words")


# --- names ------------------------------------------------------------------------------------

def series_split(df: DataFrame, col: str) -> DataFrame:
    """``Name #2.5, Other #1`` -> first series, its sequence, and the sequence as a number."""
    first = F.trim(F.split_part(F.col(col), F.lit(","), F.lit(1)))
    numbered = F.contains(first, F.lit("#"))
    d = df.withColumn("series", F.when(F.trim(col) != "", F.when(
        numbered, F.trim(F.regexp_extract(first, "^(.*)#[^#]*$", 1))).otherwise(first)))
    d = d.withColumn("sequence", F.when((F.trim(col) != "") & numbered, F.trim(F.regexp_extract(first, "#([^#]*)$", 1))))
    return d.withColumn("seq_no", F.col("sequence").try_cast("double"))


def natural_order(files: DataFrame, keys: list[str], name: str, path: str) -> DataFrame:
    """Place of every file among its ``keys`` in natural order of ``name``, ``path`` deciding; a folder of any size lies in many ranges."""
    named = files.withColumn("__k", X.natural_key(F.col(name)))
    return P.scan_ranges(named, keys, ["__k", path], {"place": P.row_index()}).drop("__k")
