"""N-gram perplexity by modified Kneser-Ney, with a lower and an upper band per language.

*Model.*  Units are the characters of a document's words (runs without ASCII white space), one blank between two words, with a
start and an end mark, so n-grams cross the ends of words; n-grams of orders 1 to ``order`` are counted over every document, per
language.  Lower orders hold continuation counts, n-grams at the start of a document plain ones.  The three discounts of a
language and order come from its counts of counts.  Every n-gram is kept, as a row of a table partitioned by its hash; nothing
is pruned, collected or broadcast.  The probability of an n-gram is its discounted share plus its context's weight times the
probability of its suffix, joined order by order.

*Score.*  The perplexity of a document is that of its characters, blanks and end mark.  Documents are dealt into slices of some
megabytes and written in buckets of slices; the distinct n-grams of a slice are joined to their probabilities and shuffled to
the bucket of the slice, so texts are written once and never shuffled.

*Bands.*  Per language, over the documents that pass the base rules: the shortest stretch of log perplexity that holds half of
them, which junk on one side hardly moves while it is less than half, says which documents are near the bulk (three standard
deviations; a normal law has half its weight in 1.349).  The bands lie ``width`` times the quartile range of those from their
median (0.1 at least).  Above the upper band a text is unlike the language; below the lower one it repeats
what everyone has.  A document also fails if it has fewer than ten words or more than a fifth of them lie in five-word windows
found twice.

Null texts have no words, null languages are one language of their own; equal ids are scored row by row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import U64, hash_words, mix, slices, stage, stage_buckets, texts_of, word_table

START, END = 1, 2
START_SIGN, END_SIGN = "\t", "\n"  # the marks in n-grams as strings: white space, which no unit of a text but the blank is
SLICE = 2_000_000  # bytes of text a worker has in hand
ASKED = 32_000_000  # bytes of text whose distinct n-grams are asked for together
SYMBOLS = frozenset(b"#*$%&|<>")


def characters(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings, each with ``order - 1`` start marks before and an end mark after; the string of each scored
    place; and those places."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    full = lengths + order
    base = np.cumsum(full) - full
    out = np.full(int(full.sum()), START, U64)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    places = base[owner] + order - 1 + inside
    is_end = inside == lengths[owner]
    out[places[~is_end]] = text + U64(3)
    out[places[is_end]] = END
    return out, owner, places


def keys(symbols: np.ndarray, places: np.ndarray, language: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each place, for orders 0 to ``order``; and of the one that ends before it."""
    here, before = [mix(language)], [mix(language)]
    h, b = language.copy(), language.copy()
    for o in range(1, order + 1):
        factor = U64(pow(0x9E3779B97F4A7C15, o, 1 << 64))
        h = h + (symbols[places - o + 1] + U64(7)) * factor
        b = b + (symbols[places - o] + U64(7)) * factor if o < order else b
        here.append(mix(h))
        before.append(mix(b))
    return here, before


def whole_keys(symbols: np.ndarray, places: np.ndarray, language: np.ndarray, order: int) -> np.ndarray:
    """``keys`` of the highest order alone."""
    h = language.copy()
    for o in range(1, order + 1):
        h += (symbols[places - o + 1] + U64(7)) * U64(pow(0x9E3779B97F4A7C15, o, 1 << 64))
    return mix(h)


def language_texts(batch, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The documents with words: their rows, their words with one blank between, and their language hashes."""
    plain = [b" ".join(t.split()).decode("utf-8", "replace") for t in texts]
    rows = np.flatnonzero(np.fromiter(map(len, plain), np.int64, len(plain)))
    names = [x if x is not None else "\x00" for x in batch.column("lang").to_pylist()]
    lang, distinct = pd.factorize(np.array(names, object))
    return rows, [plain[r] for r in rows.tolist()], hash_words(list(distinct))[lang[rows]]


def gram_keys(lang: np.ndarray, grams: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, as in ``keys``, of n-grams of one order, of their contexts (all but the last unit) and of their suffixes (all but the first)."""
    order = len(grams[0])
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, order).astype(U64)
    points = np.where(points == ord(START_SIGN), U64(START), np.where(points == ord(END_SIGN), U64(END), points + U64(3))) + U64(7)
    key, context, suffix = lang.copy(), lang.copy(), lang.copy()
    for o in range(1, order + 1):
        factor = U64(pow(0x9E3779B97F4A7C15, o, 1 << 64))
        key = key + points[:, order - o] * factor
        if o < order:
            context, suffix = context + points[:, order - 1 - o] * factor, suffix + points[:, order - o] * factor
    return mix(key), mix(context), mix(suffix)


def count(documents: DataFrame, order: int) -> DataFrame:
    """lang hash, o, key, context, suffix, a: n-grams counted over all documents; ``a`` is the continuation count of a lower order's,
    the plain one at the start of a document and in the highest order.  Only n-grams of the highest order leave the texts, as
    strings: those of lower orders are their ends."""
    names = ["lang", "gram", "n"]

    def merge(parts):
        lang, key, points, n = (np.concatenate(c) for c in zip(*parts))
        key, first, index = np.unique(key, return_index=True, return_inverse=True)
        return lang[first], key, points[first], np.bincount(index, n).astype(np.int64)

    def rows(held):
        lang, _, points, n = merge(held)
        points = np.where(points == START, ord(START_SIGN), np.where(points == END, ord(END_SIGN), points - 3)).astype(np.uint32)
        for at in range(0, len(n), 500_000):
            text = points[at : at + 500_000].tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array(lang[at : at + 500_000].view(np.int64)), pa.array([text[k : k + order] for k in range(0, len(text), order)], pa.string()),
                                              pa.array(n[at : at + 500_000])], names)

    def run(batches):
        held: list = []
        for batch in slices(batches, "text", SLICE):
            _, words, lang = language_texts(batch, texts_of(batch))
            if not words:
                continue
            symbols, owner, places = characters(words, order)
            codes, distinct = pd.factorize(whole_keys(symbols, places, lang[owner], order))
            one = np.empty(len(distinct), np.int64)  # a place of each distinct n-gram
            one[codes] = np.arange(len(codes))
            points = symbols[places[one][:, None] + np.arange(1 - order, 1)].astype(np.int32)
            held.append((lang[owner[one]], distinct, points, np.bincount(codes)))
            if len(held) > 1 and sum(len(p[1]) for p in held) > 3 * max(len(held[0][1]), 200_000):
                held = [merge(held)]
            if sum(len(p[1]) for p in held) > 6_000_000:
                yield from rows(held)
                held = []
        if held:
            yield from rows(held)

    def hashed(batches):
        for batch in batches:
            if batch.num_rows:
                found = gram_keys(batch.column("lang").to_numpy().view(U64), batch.column("gram").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("lang"), *(pa.array(x.view(np.int64)) for x in found), batch.column("a")], ["lang", "key", "context", "suffix", "a"])

    own = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    grams = stage(own.mapInArrow(run, "lang bigint, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    out = None
    for o in range(order, 0, -1):
        if o < order:
            grams = stage(grams.groupBy("lang", F.substring("gram", 2, o).alias("gram")).agg(F.sum("n").alias("n"), F.count("*").alias("before")))
        a = F.when(F.startswith("gram", F.lit(START_SIGN)) & F.lit(o > 1), F.col("n")).otherwise(F.col("before")) if o < order else F.col("n")
        level = grams.select("lang", "gram", a.alias("a")).mapInArrow(hashed, "lang bigint, key bigint, context bigint, suffix bigint, a bigint").withColumn("o", F.lit(o))
        out = level if out is None else out.unionByName(level)
    return out


@dataclass
class Model:
    order: int
    terms: DataFrame  # o, key, context, suffix, share, weight, floor: every n-gram
    whole: DataFrame  # key, p: probability of each n-gram of the highest order

    def probabilities(self, texts: list[str], lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every character and end mark of a few ``texts``, seen in training or not; and the text of each."""
        symbols, owner, places = characters(texts, self.order)
        here, before = keys(symbols, places, lang[owner], self.order)
        spark = self.terms.sparkSession
        p = np.full(len(places), 1e-7)
        for o in range(1, self.order + 1):
            level = self.terms.where(F.col("o") == o)
            ask = lambda name, of: spark.createDataFrame(pd.DataFrame({name: np.unique(of).view(np.int64)}), f"{name} bigint")  # noqa: B023, E731
            grams = {r["key"]: r["share"] for r in level.join(ask("key", here[o]), "key").select("key", "share").collect()}
            contexts = {r["context"]: r for r in level.join(ask("context", before[o - 1]), "context").select("context", "weight", "floor").distinct().collect()}
            at = [contexts.get(k) for k in before[o - 1].view(np.int64).tolist()]
            if o == 1:
                p = np.array([r["floor"] if r else q for r, q in zip(at, p)])
            share = np.array([grams.get(k, 0.0) for k in here[o].view(np.int64).tolist()])
            p = share + np.array([r["weight"] if r else 1.0 for r in at]) * p  # a context never seen leaves all to the lower order
        return p, owner

    def log_probability(self, texts: list[str], lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities per text, and its number of characters with the end mark."""
        p, owner = self.probabilities(texts, lang)
        return np.bincount(owner, np.log(p), len(texts)), np.bincount(owner, minlength=len(texts))


def train(documents: DataFrame, order: int = 4) -> Model:
    """Modified Kneser-Ney from counts over all documents."""
    grams = stage(count(documents, order))
    spectrum = grams.groupBy("lang", "o").agg(*(F.sum((F.col("a") == i).cast("bigint")).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count("*").alias("size"))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
    ratio = lambda i: F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1)), F.lit(0.1)), F.lit(i - 0.1))
    discounts = spectrum.select("lang", "o", "size", *(ratio(i).alias(f"d{i}") for i in (1, 2, 3)))
    valued = grams.join(discounts, ["lang", "o"]).withColumn("d", F.expr("case when a = 1 then d1 when a = 2 then d2 else d3 end"))
    contexts = valued.groupBy("o", "context").agg(F.sum("a").alias("total"), F.sum("d").alias("freed"))
    terms = stage(valued.join(contexts, ["o", "context"]).select(
        "o", "key", "context", "suffix", ((F.col("a") - F.col("d")) / F.col("total")).alias("share"), (F.col("freed") / F.col("total")).alias("weight"),
        F.when(F.col("o") == 1, 1 / (F.col("size") + 1)).alias("floor")))
    whole = terms.where("o = 1").select("key", F.expr("share + weight * floor").alias("p"))
    for o in range(2, order + 1):
        below = whole.select(F.col("key").alias("suffix"), F.col("p").alias("below"))
        whole = terms.where(F.col("o") == o).join(below, "suffix").select("key", F.expr("share + weight * below").alias("p"))
    return Model(order, terms, stage(whole))


def base_counts(texts: list[bytes], codes: np.ndarray, docs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    words = np.bincount(docs, minlength=n)
    points, symbols, dup = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        points[i] = len(t.decode("utf-8", "replace")) - sum(t.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
        symbols[i] = sum(t.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
        lines = [x for x in t.split(b"\n") if x.split(None, 1)]
        dup[i] = len(lines) - len(set(lines))
    repeat = np.zeros(n, np.int64)
    if len(codes) >= 5:
        inside = docs[4:] == docs[:-4]
        window = np.zeros(len(codes) - 4, U64)
        for k in range(5):
            window = mix(window * U64(3) + codes[k : len(codes) - 4 + k].astype(U64) + U64(k + 1))
        at = np.flatnonzero(inside)
        order = np.lexsort((window[at], docs[at]))
        a, h = docs[at][order], window[at][order]
        same = (a[1:] == a[:-1]) & (h[1:] == h[:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        starts = at[order[twice]]
        covered = np.zeros(len(codes) + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + 5, -1)
        repeat = np.bincount(docs, np.cumsum(covered[:-1]) > 0, n).astype(np.int64)
    return {"n_words": words, "word_chars": points, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def sliced(documents: DataFrame) -> DataFrame:
    """slice, doc_id, text, lang, written out in buckets: documents dealt into slices of about ``ASKED`` bytes in the order they are read."""

    def run(batches):
        name, size = 0, ASKED
        for batch in slices(batches, "text", SLICE):
            if size >= ASKED:
                name, size = uuid.uuid4().int >> 65, 0
            size += batch.column("text").nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, name, np.int64)), *batch.columns], ["slice", *batch.schema.names])

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return stage_buckets(own.mapInArrow(run, "slice bigint, doc_id bigint, text string, lang string"), "slice")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, the five counts, base_failed, log_perplexity (per character; null without words).  ``documents`` are
    ``sliced`` and those that ``model`` counted."""
    order = model.order
    names = ["doc_id", "lang", *FACTS, "log_perplexity"]
    kinds = "doc_id bigint, lang string, " + ", ".join(f"{f} bigint" for f in FACTS) + ", log_perplexity double"

    def ask(batches):
        held: dict[int, np.ndarray] = {}

        def rows():
            for part, key in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), part)), pa.array(key)], ["slice", "key"])
            held.clear()

        for batch in slices(batches, "text", SLICE):
            for part in batch.column("slice").unique().to_pylist():
                own = batch.filter(pa.compute.equal(batch.column("slice"), part))
                _, words, lang = language_texts(own, texts_of(own))
                if words:
                    symbols, owner, places = characters(words, order)
                    key = pd.unique(whole_keys(symbols, places, lang[owner], order)).view(np.int64)
                    held[part] = pd.unique(np.concatenate([held[part], key])) if part in held else key
            if sum(map(len, held.values())) > 6_000_000:  # an n-gram asked for twice gets two equal answers
                yield from rows()
        yield from rows()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, p = right["key"].to_numpy(), right["p"].to_numpy()
        rank = np.argsort(known)
        known, logs = known[rank], np.log(p[rank])
        out = []
        for batch in slices(left.to_batches(), "text", SLICE):
            texts = texts_of(batch)
            codes, docs, _ = word_table(texts)
            facts = base_counts(texts, codes, docs)
            total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            rows, words, lang = language_texts(batch, texts)
            if words:
                symbols, owner, places = characters(words, order)
                index, distinct = pd.factorize(whole_keys(symbols, places, lang[owner], order).view(np.int64))
                at = np.searchsorted(known, distinct)
                assert (known[at] == distinct).all()
                total[rows] = np.bincount(owner, logs[at][index], len(words))
                size[rows] = np.bincount(owner, minlength=len(words))
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(facts[f].astype(np.int64)) for f in FACTS),
                                                   pa.array(-total / np.maximum(size, 1), pa.float64(), mask=size == 0)], names))
        return pa.Table.from_batches(out)

    asked = documents.mapInArrow(ask, "slice bigint, key bigint").join(model.whole, "key")
    out = documents.groupBy("slice").cogroup(asked.select("slice", "key", "p").groupBy("slice")).applyInArrow(run, kinds)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def judge(scored: DataFrame, width: float = 3.0) -> DataFrame:
    """``scored`` with the bands of its language and ``kept``."""
    sound = scored.where("not base_failed").select("lang", "log_perplexity")
    cuts = F.percentile_approx("log_perplexity", F.array(*(F.lit(k / 100) for k in range(101))), 10_000)
    half = "array_min(transform(sequence(0, 50), k -> struct(at[k + 50] - at[k] as length, (at[k + 50] + at[k]) / 2 as middle)))"
    bulk = sound.groupBy("lang").agg(cuts.alias("at")).select(F.col("lang").alias("of"), F.expr(half).alias("half"))
    near = F.abs(F.col("log_perplexity") - F.col("half.middle")) <= F.greatest(3 / 1.349 * F.col("half.length"), F.lit(0.1))
    quartiles = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000)
    points = sound.join(bulk, F.col("lang").eqNullSafe(F.col("of"))).where(near).groupBy("of").agg(quartiles.alias("at"))
    bands = points.select("of", F.expr(f"at[1] - greatest({width} * (at[2] - at[0]), 0.1)").alias("lower_band"),
                          F.expr(f"at[1] + greatest({width} * (at[2] - at[0]), 0.1)").alias("upper_band"))
    out = scored.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def perplexity(documents: DataFrame, order: int = 4, width: float = 3.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, lower_band, upper_band."""
    own = sliced(documents)
    scored = stage(score(own, train(own, order)))
    return judge(scored, width).select("doc_id", *FACTS, "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"),
                                       F.exp("lower_band").alias("lower_band"), F.exp("upper_band").alias("upper_band"))
