"""Column functions over text.  All of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHAR = "[\\p{L}\\p{Nd}'’]"


def _fold_table() -> tuple[str, str]:
    """Letters with a canonical decomposition to one base letter plus marks, up to the Greek extensions."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and unicodedata.category(c) != "Mn":
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(c: Column) -> Column:
    """Accented letters to their base letter, one for one, so offsets do not move."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def matches(c: Column, pattern: str) -> Column:
    """All non-overlapping matches of a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def run_starts(c: Column, char_class: str) -> Column:
    """0-based offsets where a run of ``char_class`` begins, in order.

    The first character of every run is replaced one for one and picked out by position, so a document costs one linear pass in its own row: no explode, no shuffle, no running sum.
    """
    first = F.regexp_replace(F.translate(c, "\u0001", " "), f"(?<!{char_class}){char_class}", "\u0001")
    places = F.transform(F.split(first, ""), lambda v, i: F.when(v == "\u0001", i))
    return F.filter(places, lambda p: p.isNotNull())


def words(c: Column) -> Column:
    """Normalised words: accents folded, apostrophes dropped, lower case; empty ones left out."""
    raw = matches(fold(c), WORD_CHAR + "+")
    return F.filter(F.transform(raw, normal_word), lambda w: w != "")


def normal_word(w: Column) -> Column:
    return F.lower(F.translate(w, "'’", ""))


def _compositions() -> dict[str, tuple[str, str]]:
    """Per combining mark: the letters it joins, and what they become."""
    out: dict[str, tuple[str, str]] = {}
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(code)))
        pair = unicodedata.decomposition(chr(code)).split()
        if parts == chr(code) and len(pair) == 2 and not pair[0].startswith("<"):
            base, mark = (chr(int(x, 16)) for x in pair)
            if unicodedata.combining(mark):
                a, b = out.get(mark, ("", ""))
                out[mark] = (a + base, b + chr(code))
    return out


COMPOSITIONS = _compositions()


def compose(c: Column) -> Column:
    """Letters followed by combining marks as single letters, where there is one (a decomposed file name)."""

    def joined(acc: Column, mark: Column) -> Column:
        last = F.right(acc, F.lit(1))
        new = F.lit(None).cast("string")
        for m, (source, target) in COMPOSITIONS.items():
            new = F.when(mark == m, F.when(F.contains(F.lit(source), last), F.translate(last, source, target))).otherwise(new)
        return F.coalesce(F.concat(F.left(acc, F.length(acc) - 1), new), F.concat(acc, mark))

    whole = F.transform(matches(c, "(?s:\\P{M}?\\p{M}+|\\P{M}+?(?=\\P{M}\\p{M}|$)|\\P{M})"), lambda t: F.when(
        t.rlike("\\p{M}"), F.aggregate(F.split(F.substring(t, 2, F.length(t)), ""), F.left(t, F.lit(1)), joined)).otherwise(t))
    return F.when(c.rlike("\\p{M}"), F.array_join(whole, "")).otherwise(c)


def name_key(c: Column) -> Column:
    """File name -> comparable name: extension off, runs of letters and digits, lower case, one space."""
    return name_key_of_stem(F.regexp_replace(F.trim(c), "\\.[^.]*$", ""))


def location(c: Column) -> Column:
    """A path or a URI, percent-decoded where it is encoded."""
    plus_safe = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.when(F.instr(c, "%") > 0, F.coalesce(F.try_url_decode(plus_safe), c)).otherwise(c)


def file_name(c: Column) -> Column:
    """Last segment of a path, a URI or a percent-encoded document location."""
    return F.regexp_extract(F.substring_index(location(c), "/", -1), "([^/\\\\:]*)$", 1)


def copy_free_key(location: Column) -> Column:
    """Name key of a stored location, with a copy suffix such as `` (2)`` taken off."""
    stem = F.regexp_replace(file_name(location), "\\.[^.]*$", "")
    return name_key_of_stem(F.regexp_replace(stem, " \\([0-9]+\\)$", ""))


def name_key_of_stem(stem: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(compose(stem), "[^\\p{L}\\p{Nd}]+", " ")))


def natural_key(c: Column) -> Column:
    """Sort key in natural order: a digit run sorts by its value, any other character upper-cased by code.

    One string that sorts by code points, as sorting by arrays costs a comparison per character of a name: every upper-cased character
    ends with U+0000 (some become two); a number is ``0``, U+0000 and, of up to eight digits, ``0`` and eight of them, else ``1``, their
    count and the digits.  U+0000 and U+0001 of the name are written as pairs that begin with U+0001 and sort alike.
    """
    safe = F.replace(F.replace(c, F.lit("\u0001"), F.lit("\u0001\u0002")), F.lit("\u0000"), F.lit("\u0001\u0001"))

    def letters(p: Column) -> Column:
        return F.upper(F.regexp_replace(p, "(?s)(\u0001.|[^0-9])", "$1\u0000"))

    def part(p: Column) -> Column:
        digits = F.ltrim(p, F.lit("0"))
        number = F.when(F.length(digits) <= 8, F.concat(F.lit("0"), F.lpad(digits, 8, "0"))).otherwise(
            F.concat(F.lit("1"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits))
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("0\u0000"), number)).otherwise(letters(p))

    # Short numbers, the rule, need no array: zeros in front, then the last eight digits.
    padded = F.regexp_replace(letters(safe), "([0-9]+)", "0\u000000000000$1")
    return F.when(c.rlike("[0-9]{9}"), F.array_join(F.transform(matches(safe, "[0-9]+|[^0-9]+"), part), "")).otherwise(
        F.regexp_replace(padded, "[0-9]*([0-9]{8})", "0$1"))


def clock_ms(c: Column) -> Column:
    """Clock text in its six forms to milliseconds (half-even); null when unreadable."""
    t = F.trim(c)
    parts = F.split(t, ":")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    sexagesimal = F.when(
        F.size(parts).between(2, 3) & ~F.exists(numbers, lambda n: n.isNull()),
        F.aggregate(numbers, F.lit(0.0), lambda acc, n: acc * 60 + n) * 1000)
    amount = F.regexp_extract(t, "^(.*?)(ms|min|h|s)?$", 1).try_cast("double")
    unit = F.regexp_extract(t, "(ms|min|h|s)$", 1)
    scale = F.when(unit == "ms", 1.0).when(unit == "min", 60_000.0).when(unit == "h", 3_600_000.0).otherwise(1000.0)
    return F.rint(F.when(F.contains(t, F.lit(":")), sexagesimal).when(t != "", amount * scale)).try_cast("bigint")


def clock_text(ms: Column) -> Column:
    """Milliseconds as ``h:mm:ss.fff``."""
    m = F.greatest(ms, F.lit(0))
    return F.format_string(
        "%d:%02d:%02d.%03d", F.expr("1").cast("bigint") * F.floor(m / 3_600_000), F.floor(m / 60_000) % 60,
        F.floor(m / 1000) % 60, m % 1000)


def excerpt(text: Column, offset: Column, length: int) -> Column:
    """Text around an offset, clamped, on one line."""
    start = F.least(F.greatest(offset, F.lit(0)), F.greatest(F.length(text) - 1, F.lit(0)))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(
        F.trim(F.translate(F.substring(text, start + 1, F.lit(length)), "\n", " ")))


def collapse_blocks(c: Column) -> Column:
    """One line per paragraph: blank lines separate paragraphs, inner white space becomes one space."""
    unix = F.regexp_replace(c, "\r\n|\r", "\n")
    blocks = F.transform(F.split(unix, "\n\n"), lambda b: F.trim(F.regexp_replace(b, "[\\s\\u0085\\u00A0\\u2028\\u2029]+", " ")))
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n")
