"""Words and letters out of text, transcripts and emission frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import primitives as P

# The alphabet of the emissions, in the order of its ids; ids before it are not letters.
LETTERS = "aienoutsrmkldghybpwcvjzf'qx"
FIRST_LETTER = 4
WILDCARD = FIRST_LETTER + len(LETTERS)
#: Characters of a cell of token starts: the bits of a long.
CELL = 64


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words with offsets, in each document's own row (no shuffle)."""
    folded = X.fold(F.col(text))
    z = F.arrays_zip(X.matches(folded, X.WORD_CHAR + "+").alias("w"), X.run_starts(folded, X.WORD_CHAR).alias("s"))
    rows = docs.select(key, z.alias("z")).select(
        key, F.transform("z", lambda e: F.struct(
            X.normal_word(e["w"]).alias("value"), e["s"].cast("int").alias("char_start"),
            (e["s"] + F.length(e["w"])).cast("int").alias("char_end"))).alias("z"))
    return rows.select(key, F.posexplode(F.filter("z", lambda e: e["value"] != "")).alias("tok_idx", "t")).select(
        key, "tok_idx", "t.value", "t.char_start", "t.char_end")


def query_words(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(key, F.posexplode(X.words(F.col(text))).alias("q_idx", "value"))


def index_at_char(offsets: DataFrame, toks: DataFrame, key: str = "doc_id", at: str = "at_char") -> DataFrame:
    """First token starting at or after the offset; the token count when there is none.

    Token starts leave a text as cells: a bit per character of ``CELL``, counted up before the shuffle, so that a token costs no row.
    That numbers the tokens of a key that has each number once, in order of place, which a text's tokens do; tokens of other keys
    (texts of one id) are looked up one by one.
    """
    place, number = F.col("char_start").cast("bigint"), F.col("tok_idx").cast("bigint")
    within = toks.filter(F.col(key).isNotNull()).groupBy(key, P.slice_of(place, CELL).alias("__cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(CELL)).cast("int"))).alias("__bits"),
        F.min(number).alias("__first"), F.max(number).alias("__last"), F.count("*").alias("__rows"))
    cells = P.stage(within)
    size = F.sum("__rows")
    even = F.min(F.coalesce((F.col("__last") - F.col("__first") + 1 == F.col("__rows")) & (F.bit_count("__bits") == F.col("__rows")), F.lit(False)))
    keys = P.stage(cells.groupBy(key).agg(size.alias("__n"), (even & (F.min("__first") == 0) & (F.max("__last") + 1 == size)).alias("__even"),
                                         F.min("__cell").alias("__low"), F.max("__cell").alias("__high")))
    asked = offsets.join(keys, key, "left").withColumn("__at", P.slice_of(F.col(at), CELL))
    hit = asked.filter(F.coalesce("__even", F.lit(True))).join(cells.select(key, F.col("__cell").alias("__at"), "__bits", "__first"), [key, "__at"], "left")
    before = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.pmod(F.col(at), F.lit(CELL)).cast("int")))
    outside = F.when(F.col("__at") < F.col("__low"), F.lit(0)).when(F.col("__at").between(F.col("__low"), F.col("__high")), F.lit(None)).otherwise(F.coalesce("__n", F.lit(0)))
    found = F.when(F.col("__bits").isNotNull(), F.col("__first") + F.bit_count(F.col("__bits").bitwiseAND(before))).otherwise(outside)
    looked = P.stage(hit.select(*offsets.columns, "__at", found.cast("int").alias("tok_idx")))
    out = looked.filter("tok_idx is not null").drop("__at")
    gaps = looked.filter("tok_idx is null").drop("tok_idx")
    if not gaps.isEmpty():  # between two cells: all tokens of the cells before
        b = P.bracket(gaps, cells.join(gaps.select(key), key, "left_semi"), [key], "__at", "__cell", ["__first", "__rows"], 256)
        out = out.unionByName(b.select(*offsets.columns, (F.col("lo.__first") + F.col("lo.__rows")).cast("int").alias("tok_idx")))
    odd = keys.filter("not __even")
    if odd.isEmpty():
        return out
    single = P.bracket(asked.filter("not __even"), toks.join(odd.select(key), key, "left_semi"), [key], at, "char_start", ["tok_idx"], 256)
    return out.unionByName(single.select(*offsets.columns, F.coalesce(P.at_or_after("char_start", at)["tok_idx"], F.col("__n")).cast("int").alias("tok_idx")))


def merge_subwords(pieces: DataFrame, key: str = "segment_id") -> DataFrame:
    """Sub-word pieces to timed words: white space starts a word, anything else continues it.

    ``pieces(segment_id, ord, text, at_ms)``.  Word starts are counted with a scan over ``ord``, so a long
    segment is not gathered on one task.
    """
    spoken = pieces.filter(
        ~F.coalesce(F.col("text").rlike("^\\s*$") | F.col("text").rlike("(?s)^\\[_.*\\]$") | F.col("text").rlike("(?s)^<\\|.*\\|>$"), F.lit(True)))
    parts = spoken.select(
        key, "ord", "at_ms", F.col("text").rlike("^\\s").alias("__lead"),
        F.posexplode(X.matches(F.col("text"), "\\S+")).alias("__i", "part"))
    starts = F.when((F.col("__i") > 0) | F.col("__lead"), F.lit(1)).otherwise(F.lit(0))
    numbered = P.scan(parts, [key], ["ord", "__i"], P.slice_of("ord", 8192), {"word": P.running_sum(starts)})
    joined = numbered.groupBy(key, "word").agg(
        F.array_sort(F.collect_list(F.struct("ord", "__i", "part"))).alias("p"),
        F.min_by("at_ms", F.struct("ord", "__i")).alias("at_ms"), F.min("ord").alias("ord"))
    value = F.lower(F.regexp_replace(X.fold(F.array_join(F.col("p.part"), "")), "[^\\p{L}\\p{Nd}]", ""))
    return joined.select(key, "word", value.alias("value"), "at_ms").filter("value <> ''")


def spread_even(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Words of an untimed segment spread evenly over it (integer division)."""
    w = segments.select(*keys, "start_ms", "end_ms", X.words(F.col("text")).alias("w"))
    return w.select(*keys, "start_ms", "end_ms", F.size("w").alias("n"), F.posexplode("w").alias("word_idx", "value")).select(
        *keys, "word_idx", "value", F.expr("start_ms + (end_ms - start_ms) * word_idx div n").alias("at_ms"))


def greedy_collapse(frames: DataFrame, first_id: int = FIRST_LETTER) -> DataFrame:
    """Best symbol per frame (first wins), kept where it changes and is a letter."""
    best = frames.select("book_id", "frame", (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("id"))
    s = P.scan(best, ["book_id"], ["frame"], P.slice_of("frame", 65_536), {"__p": P.previous(F.col("id"))})
    return s.filter((F.col("id") >= first_id) & (F.col("id") != F.coalesce("__p", F.lit(0)))).drop("__p")


# Letters without a canonical decomposition, spelt out for matching.
SPELT_OUT = {"đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "þ": "th"}


def romanized(c: Column) -> Column:
    """Letters as the emissions know them: marks stripped, spelt-out letters, straight apostrophes."""
    t = X.fold(F.lower(F.translate(c, "’‘ʼĐÆŒØŁÞ", "'''đæœøłþ")))
    t = F.translate(t, "đøł", "dol")
    for letter, spelling in SPELT_OUT.items():
        if len(spelling) > 1:
            t = F.replace(t, F.lit(letter), F.lit(spelling))
    return t


def letters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Letter ids in order; a run of digits is one wildcard."""
    kept = F.regexp_replace(F.regexp_replace(romanized(F.col(text)), "\\p{Nd}+", "0"), f"[^{LETTERS}0]", "")
    e = docs.select(key, F.posexplode(F.filter(F.split(kept, ""), lambda c: c != "")).alias("pos", "c"))
    at = F.instr(F.lit(LETTERS), F.col("c"))
    return e.select(key, "pos", F.when(F.col("c") == "0", F.lit(WILDCARD)).otherwise(at + FIRST_LETTER - 1).cast("int").alias("id"))
