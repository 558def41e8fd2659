"""Finding noisy passages in a large corpus, and refusing ambiguous answers.

A passage is matched by local alignment (match +2, mismatch -1, gap -1).  Passages are a stated query set, looked for in blocks of
bounded size; the corpus is read once per block and never shuffled.  Aligning every passage with every document would be far too
much; instead two bounds that lose nothing pick the stretches of a document worth aligning:

* an alignment spends at least 1 on every word of its stretch that is no word of the passage and wins at most 2 on any other, so its
  score is at most the stretch's sum of these; only positions of passage words are looked at to find all stretches that reach a sum;
* a score of s needs s / 2 words of the passage, so one of its rarest n - s / 2 + 1 words; where these are few, only their
  surroundings are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import anchors as A
from versoline.operators import primitives as P
from versoline.operators import tokens as K
from versoline.semantics import FRAME_MS

MATCH, MISMATCH, GAP = 2, -1, -1


# --- seeds ------------------------------------------------------------------------------------

def shingles(words: Column, k: int) -> Column:
    """k consecutive words at every position, out of the row's own word array."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, k), " ")))


def seed_vote(queries: DataFrame, docs: DataFrame, k: int = 3, band: int = 8) -> DataFrame:
    """Best document and place per passage by diagonal voting of shared k-word shingles.

    ``queries(query_id, text)``, ``docs(doc_id, text)``.  Shingles are made inside each row; the one
    shuffle of the corpus is the equi-join, and votes are partially aggregated before theirs.
    """
    q = queries.select("query_id", X.words(F.col("text")).alias("w")).select("query_id", F.posexplode(shingles(F.col("w"), k)).alias("q_idx", "shingle"))
    d = docs.select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", F.posexplode(shingles(F.col("w"), k)).alias("tok_idx", "shingle"))
    lane = F.floor((F.col("tok_idx") - F.col("q_idx")) / band)
    votes = d.join(q, "shingle").groupBy("query_id", "doc_id", lane.alias("band")).agg(
        F.count("*").alias("votes"), F.min("tok_idx").alias("lo"), F.max("tok_idx").alias("hi"))
    best = votes.groupBy("query_id").agg(F.min_by(
        F.struct("doc_id", "band", "votes", "lo", "hi"), F.struct(-F.col("votes"), "doc_id", "band")).alias("b"))
    return best.select("query_id", "b.doc_id", "b.band", "b.votes", "b.lo", "b.hi")


def _documents(docs: DataFrame) -> DataFrame:
    """One row per document with its words and their offsets as one array."""
    folded = X.fold(F.col("text"))
    z = F.arrays_zip(X.matches(folded, X.WORD_CHAR + "+").alias("w"), X.run_starts(folded, X.WORD_CHAR).alias("s"))
    words = F.transform("z", lambda e: F.struct(
        X.normal_word(e["w"]).alias("v"), e["s"].cast("int").alias("s"), (e["s"] + F.length(e["w"])).cast("int").alias("e")))
    return docs.select("doc_id", z.alias("z")).select("doc_id", F.filter(words, lambda e: e["v"] != "").alias("words"))


# --- alignment of one window ------------------------------------------------------------------

def _align(query: list[int], windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best local alignment of one passage in each window (row): score, from, last, query from, query last.

    The first strictly best cell wins, scanning query words outside and window words inside; a diagonal
    step is preferred to a skipped query word, that to a skipped window word.  A row of cells is one
    vector: runs of skipped window words are a prefix maximum of (score + place), the later place first.
    """
    count, width = windows.shape
    places = np.arange(width + 1, dtype=np.int64)
    score = np.zeros((count, width + 1), dtype=np.int64)
    w_from = np.zeros_like(score)
    q_from = np.zeros_like(score)
    rows = np.arange(count)
    best = np.zeros((5, count), dtype=np.int64)
    for j, word in enumerate(query):
        alive = score > 0
        base, bw, bq = np.zeros_like(score), np.zeros_like(score), np.full_like(score, j)
        base[:, 1:] = score[:, :-1] + np.where(windows == word, MATCH, MISMATCH)
        bw[:, 1:] = np.where(alive[:, :-1], w_from[:, :-1], places[:-1])
        bq[:, 1:] = np.where(alive[:, :-1], q_from[:, :-1], j)
        over = alive & (score + GAP > base)
        base = np.maximum(np.where(over, score + GAP, base), 0)
        bw, bq = np.where(over, w_from, bw), np.where(over, q_from, bq)
        top = np.maximum.accumulate((base + places) * (width + 1) + places, axis=1)
        source = top % (width + 1)
        score = top // (width + 1) - places
        w_from, q_from = np.take_along_axis(bw, source, 1), np.take_along_axis(bq, source, 1)
        at = score.argmax(axis=1)
        found = np.stack([score[rows, at], w_from[rows, at], at - 1, q_from[rows, at], np.full(count, j)])
        best = np.where(found[0] > best[0], found, best)
    return tuple(best)


FOUND_SCHEMA = "query_id bigint, doc_id bigint, score int, n int, tok int, last_tok int, q_start int, q_end int"
#: Words of one block of passages; a single longer passage is a block of its own.
BLOCK_WORDS = 200_000


def _stretches(places: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Stretches (first, last place) that hold every run of words whose sum, 2 per place given and -1 per other, is ``enough``."""
    if 2 * len(places) < enough:
        return []
    rise = 3 * np.arange(len(places)) - places
    ending = rise - np.minimum.accumulate(rise) + 2
    starting = np.maximum.accumulate(rise[::-1])[::-1] - rise + 2
    held = ending + starting - 2 >= enough
    if not held.any():
        return []
    joined = held[:-1] & held[1:] & (ending[:-1] + starting[1:] - (np.diff(places) - 1) >= enough)
    firsts = np.flatnonzero(held & ~np.r_[False, joined])
    lasts = np.flatnonzero(held & ~np.r_[joined, False])
    return list(zip(places[firsts].tolist(), places[lasts].tolist()))


class _Passage:
    """A passage's words as places in its block's vocabulary, and what counts as found."""

    def __init__(self, query_id: int, words: list[int], enough: int):
        self.query_id, self.words, self.enough = query_id, words, max(enough, 1)
        # One more word than this matched or skipped costs more than the passage can win.
        self.reach = max(3 * len(words) - self.enough, 1)

    def search(self, places: Callable[[list[int]], np.ndarray], rarity: Callable[[int], int]) -> list[tuple[int, int]]:
        """Stretches of a batch worth aligning."""
        distinct = sorted(set(self.words), key=rarity)
        need = -(-self.enough // 2)
        if need > len(self.words):
            return []
        repeated, spare = sorted(self.words, key=rarity), len(self.words) - need + 1
        rare = sorted(set(repeated[:spare]), key=rarity)
        near = places(rare)
        if 4 * len(near) > sum(map(rarity, distinct)):
            return _stretches(places(distinct), self.enough)
        if not len(near):
            return []
        common = places([w for w in distinct if w not in set(rare)])
        after = np.searchsorted(near, common)
        close = (common - near[np.maximum(after - 1, 0)] <= self.reach) & (after > 0) | (near[np.minimum(after, len(near) - 1)] - common <= self.reach) & (after < len(near))
        return _stretches(np.sort(np.concatenate([near, common[close]])), self.enough)


def _common(query: list[int], grid: np.ndarray) -> np.ndarray:
    """At least as many as the words each window (row) has in common with the passage in order: longest common subsequences by bits."""
    total = np.zeros(len(grid), np.int64)
    for start in range(0, len(query), 64):
        part = query[start:start + 64]
        masks = np.zeros(max(query) + 2, np.uint64)  # the last one is that of all other words
        for bit, word in enumerate(part):
            masks[word] |= np.uint64(1 << bit)
        full = np.uint64((1 << len(part)) - 1)
        open_ = np.full(len(grid), full)
        for column in grid.T:
            taken = open_ & masks[column]
            open_ = ((open_ + taken) | (open_ - taken)) & full
        total += len(part) - np.bitwise_count(open_).astype(np.int64)
    return total


def _windows(passage: _Passage, codes: np.ndarray, stretches: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, the passage's own word numbers or -1) of each stretch, long ones in overlapping windows, where enough words are in order."""
    step = 4 * passage.reach
    cuts = [(k, min(k + step + passage.reach, z + 1)) for a, z in stretches for k in range(a, max(a + 1, z + 1 - passage.reach), step)]
    cuts.sort(key=lambda w: w[1] - w[0])
    own = {w: k for k, w in enumerate(dict.fromkeys(passage.words))}
    distinct = np.array(sorted(own), np.int64)
    number = np.array([own[w] for w in distinct.tolist()], np.int64)
    query = [own[w] for w in passage.words]
    for start in range(0, len(cuts), 1024):
        part = cuts[start:start + 1024]
        grid = np.full((len(part), part[-1][1] - part[-1][0]), -1, dtype=np.int64)
        for g, (a, z) in enumerate(part):
            grid[g, : z - a] = codes[a:z]
        at = np.minimum(np.searchsorted(distinct, grid), len(distinct) - 1)
        grid = np.where(distinct[at] == grid, number[at], -1)
        for g in np.flatnonzero(MATCH * _common(query, grid) >= passage.enough):
            yield part[g][0], grid[g, : part[g][1] - part[g][0]]


def _candidates(batch: pa.RecordBatch, vocabulary: pa.Array, passages: list[_Passage]) -> Iterator[tuple]:
    """What is worth aligning in a batch of documents: (query_id, doc_id, first word, the passage's words, the window's, enough)."""
    lists = batch.column("words")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).dictionary_encode()
    of_word = pc.fill_null(pc.index_in(flat.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    # Between two documents lies more space than any sum can bridge.
    far = 4 * (len(flat) + 1)
    first = np.cumsum(sizes) - sizes
    codes = of_word[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    hits = np.flatnonzero(codes >= 0)
    order = hits[np.argsort(codes[hits], kind="stable")]
    ends = np.searchsorted(codes[order], np.arange(len(vocabulary) + 1))
    spaced = order + doc[order] * far
    ids = batch.column("doc_id").to_pylist()

    def places(words: list[int]) -> np.ndarray:
        parts = [spaced[ends[w]:ends[w + 1]] for w in words]
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    for passage in passages:
        found = passage.search(places, lambda w: int(ends[w + 1] - ends[w]))
        if not found:
            continue
        # Back to places in the batch: every document before added ``far``.
        at = np.array(found)
        which = np.searchsorted(first + np.arange(len(sizes)) * far, at[:, 0], "right") - 1
        while (empty := sizes[which] == 0).any():
            which[empty] -= 1
        plain = at - (which * far)[:, None]
        own = {w: k for k, w in enumerate(dict.fromkeys(passage.words))}
        query = [own[w] for w in passage.words]
        for start, window in _windows(passage, codes, [tuple(x) for x in plain.tolist()]):
            k = int(doc[start])
            yield passage.query_id, ids[k], start - int(first[k]), query, window.tolist(), passage.enough


_ASKED_SCHEMA = "query_id bigint, doc_id bigint, from_tok int, q array<int>, w array<int>, enough int"
_ASKED = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("from_tok", pa.int32()), ("q", pa.list_(pa.int32())), ("w", pa.list_(pa.int32())), ("enough", pa.int32())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _aligned(candidates: DataFrame) -> DataFrame:
    """The best alignment of every (query_id, doc_id) among its candidates: FOUND_SCHEMA.

    Windows that overlap agree on their alignments: the first best cell of the whole document wins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                by_query: dict[int, list[dict]] = {}
                for row in batch.to_pylist():
                    by_query.setdefault(row["query_id"], []).append(row)
                for query_id, own in by_query.items():
                    own.sort(key=lambda r: len(r["w"]))
                    for start in range(0, len(own), 256):
                        part = own[start:start + 256]
                        grid = np.full((len(part), len(part[-1]["w"])), -1, dtype=np.int64)
                        for g, r in enumerate(part):
                            grid[g, : len(r["w"])] = r["w"]
                        for r, score, w0, w1, q0, q1 in zip(part, *_align(part[0]["q"], grid)):
                            if score >= r["enough"]:
                                yield query_id, r["doc_id"], int(score), len(r["q"]), r["from_tok"] + int(w0), r["from_tok"] + int(w1), int(q0), int(q1)

        yield from _batches(rows(), _FOUND)

    cells = P.spread(candidates, ["query_id", "doc_id", "from_tok"]).mapInArrow(run, FOUND_SCHEMA)
    rest = _FOUND.names[2:]
    return cells.groupBy("query_id", "doc_id").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), "q_end", "last_tok")).alias("m")).select("query_id", "doc_id", "m.*")


_FOUND = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.int32()) for c in FOUND_SCHEMA.split(", ")])


def _bounded(spark: SparkSession) -> SparkSession:
    """Let Spark hand Arrow batches of at most 4 MB (one row, if that is longer) to Python: ten thousand long documents would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def _search(queries: DataFrame, words: DataFrame, enough: Column) -> DataFrame:
    """Best place of every passage in every document where its score reaches ``enough`` (of ``n``, its words): ``words(doc_id, words)``."""
    spark = _bounded(queries.sparkSession)
    q = P.stage(queries.select("query_id", X.words(F.col("text")).alias("q")).filter(F.size("q") > 0).withColumn("n", F.size("q")).withColumn("enough", enough.cast("int")))
    total = q.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    words = words if blocks == 1 else P.stage(words)
    found = None
    for block in range(blocks):
        vocabulary: dict[str, int] = {}
        passages = [_Passage(r["query_id"], [vocabulary.setdefault(w, len(vocabulary)) for w in r["q"]], r["enough"])
                    for r in q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toLocalIterator()]
        shared = spark.sparkContext.broadcast((list(vocabulary), passages))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, passages = shared.value
            for batch in batches:
                yield from _batches(_candidates(batch, pa.array(vocabulary, pa.string()), passages), _ASKED)

        part = words.select("doc_id", "words").mapInArrow(run, _ASKED_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return _aligned(found)


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.words(F.col("text")).alias("words"))


def _with_offsets(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Places in words as places in the text; only documents with a find are cut into words with offsets."""
    own = P.stage(found)
    documents = _documents(docs.join(own.select("doc_id").distinct(), "doc_id", "left_semi"))
    return own.join(documents, "doc_id").select(
        "query_id", "doc_id", "score", "n", "tok", "last_tok", F.element_at("words", F.col("tok") + 1)["s"].alias("char_offset"),
        F.element_at("words", F.col("last_tok") + 1)["e"].alias("end_offset"), "q_start", "q_end", *[c for c in own.columns if c not in _FOUND.names])


def _confident(matches: DataFrame, min_conf: float) -> DataFrame:
    c = (F.col("score") / (F.col("n") * 2)).cast("float")
    return matches.withColumn("confidence", c).filter(F.col("confidence") >= F.lit(min_conf).cast("float"))


def _at_least(min_conf: float) -> Column:
    # A hair below the bound, so that float rounding can only add candidates.
    return F.ceil(F.col("n") * 2 * (min_conf - 1e-6))


def match(queries: DataFrame, docs: DataFrame, min_conf: float = 0.45) -> DataFrame:
    """Every document holding a passage, with the best place in it.  Exact: nothing is capped."""
    return _with_offsets(_confident(_search(queries, _words(docs), _at_least(min_conf)), min_conf), docs)


def _inside(windows: DataFrame) -> DataFrame:
    """The best alignment per query_id and doc_id in its (q, from_tok, words, enough) rows: FOUND_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    vocabulary: dict[str, int] = {}
                    words = [vocabulary.setdefault(w, len(vocabulary)) for w in batch.column("q")[i].as_py()]
                    passage = _Passage(batch.column("query_id")[i].as_py(), words, batch.column("enough")[i].as_py())
                    start = batch.column("from_tok")[i].as_py()
                    for row in _candidates(batch.select(["doc_id", "words"]).slice(i, 1), pa.array(list(vocabulary), pa.string()), [passage]):
                        yield (*row[:2], row[2] + start, *row[3:])

        yield from _batches(rows(), _ASKED)

    _bounded(windows.sparkSession)
    asked = windows.select("query_id", "doc_id", "q", F.col("from_tok").cast("int").alias("from_tok"), "words", F.col("enough").cast("int").alias("enough"))
    return _aligned(asked.mapInArrow(run, _ASKED_SCHEMA))


def _slice(words: Column, from_tok: Column, to_tok: Column) -> Column:
    return F.slice(words, (from_tok + 1).cast("int"), F.greatest(to_tok - from_tok, F.lit(0)).cast("int"))


def match_near(expected: DataFrame, queries: DataFrame, docs: DataFrame, radius: int, min_conf: float = 0.45) -> DataFrame:
    """Alignment in a window around an expected word: ``expected(query_id, doc_id, tok_idx)``.  Only expected documents are cut into words."""
    expected = P.stage(expected)
    near = P.stage(_documents(docs.join(expected.select("doc_id").distinct(), "doc_id", "left_semi")))
    q = queries.select("query_id", X.words(F.col("text")).alias("q")).filter(F.size("q") > 0)
    first = F.greatest(F.col("tok_idx") - radius, F.lit(0))
    w = expected.join(q, "query_id").join(near, "doc_id").select(
        "query_id", "doc_id", "q", first.alias("from_tok"), _slice(F.col("words.v"), first, F.col("tok_idx") + radius + F.size("q")).alias("words"), F.lit(1).alias("enough"))
    return _with_offsets(_confident(_inside(w), min_conf), docs)


def unambiguous(queries: DataFrame, docs: DataFrame, min_words: int = 10, min_conf: float = 0.6, margin: float = 0.1) -> DataFrame:
    """Matches without a rival elsewhere in the document; ``rival`` is its confidence, 0 when there is none.

    A rival is the best alignment inside the text before, or inside the text after, the place found with
    twice the passage's length to spare; it counts from ``min_conf`` up.
    """
    long_enough = queries.filter(F.size(X.words(F.col("text"))) >= min_words)
    found = P.stage(_confident(_search(long_enough, _words(docs), _at_least(min_conf)), min_conf))
    q = long_enough.select("query_id", X.words(F.col("text")).alias("q"))
    around = found.select("query_id", "doc_id", "tok", "n").join(q, "query_id").join(
        _words(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")), "doc_id").withColumn("enough", _at_least(min_conf))
    before, after = F.greatest(F.col("tok") - 2 * F.col("n"), F.lit(0)), F.col("tok") + 3 * F.col("n")
    cols = ["query_id", "doc_id", "q", "enough"]
    sides = around.select(*cols, F.lit(0).alias("from_tok"), _slice(F.col("words"), F.lit(0), before).alias("words")).unionByName(
        around.select(*cols, after.alias("from_tok"), _slice(F.col("words"), after, F.size("words")).alias("words"))).filter(F.size("words") > 0)
    rivals = _confident(_inside(sides), min_conf).select("query_id", "doc_id", F.col("confidence").alias("rival"))
    j = found.join(rivals, ["query_id", "doc_id"], "left").withColumn("rival", F.coalesce("rival", F.lit(0.0).cast("float")))
    return _with_offsets(j.filter(~(F.col("rival") >= F.col("confidence") - F.lit(margin).cast("float"))), docs)


def first_found(found: DataFrame, attempts: DataFrame) -> DataFrame:
    """The whole transcript first, then its phrases in order: ``attempts(query_id, heard_id, ord)``."""
    j = found.join(attempts, "query_id")
    return j.groupBy("heard_id", "doc_id").agg(F.min_by(F.struct(*found.drop("doc_id").columns), "ord").alias("m")).select("heard_id", "doc_id", "m.*")


PAGE_MIN_WORDS = 12
PAGE_MIN_MATCHED = 20


def page(queries: DataFrame, docs: DataFrame, min_conf: float = 0.55) -> DataFrame:
    """A recognised page in the corpus; junk around the matched run is not held against it.

    The matched run has at least twenty words of the page at ``min_conf``, so its score is at least
    2 * min_conf * 20 and it matches half as many words: that bounds the seeds.
    """
    least = math.ceil(2 * (min_conf - 1e-6) * PAGE_MIN_MATCHED)
    long_enough = queries.filter(F.size(X.words(F.col("text"))) >= PAGE_MIN_WORDS)
    m = _search(long_enough, _words(docs), F.lit(least)).withColumn("matched", F.col("q_end") - F.col("q_start") + 1)
    c = F.least((F.col("score") / (F.col("n") * 2)).cast("float") * F.col("n") / F.col("matched"), F.lit(1.0)).cast("float")
    sure = m.filter(F.col("matched") >= PAGE_MIN_MATCHED).withColumn("confidence", c).filter(F.col("confidence") >= F.lit(min_conf).cast("float"))
    return _with_offsets(sure, docs).select("query_id", "doc_id", "char_offset", "end_offset", "confidence")


# --- letters ----------------------------------------------------------------------------------

def letter_string(text: Column) -> Column:
    return F.regexp_replace(K.romanized(text), f"[^{K.LETTERS}]", "")


def _runs(side: DataFrame, key: str, k: int, pos: str) -> DataFrame:
    """Runs of k letters that occur once: cut in chunks first, so that a long text costs linear work."""
    chunk = 1_000
    parts = side.filter(F.length("letters") >= k).select(
        key, "letters", F.explode(F.sequence(F.lit(0), F.length("letters") - k, F.lit(chunk))).alias("c")).select(
        key, "c", F.substring("letters", F.col("c") + 1, F.lit(chunk + k - 1)).alias("part"))
    grams = parts.select(key, F.explode(F.transform(
        F.sequence(F.lit(0), F.length("part") - k), lambda i: F.struct((F.col("c") + i).alias("p"), F.substring(F.col("part"), i + 1, F.lit(k)).alias("g")))).alias("x"))
    return grams.groupBy(key, F.col("x.g").alias("run")).agg(F.count("*").alias("n"), F.min("x.p").alias(pos)).filter("n = 1").drop("n")


def unique_runs(left: DataFrame, right: DataFrame, key: str = "pair_id", k: int = 10) -> DataFrame:
    """Pairs of places of runs that occur exactly once on either side: ``(key, letters)`` on both."""
    return _runs(left, key, k, "l_pos").join(_runs(right, key, k, "r_pos"), [key, "run"])


def chain(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Longest chain of pairs in the same order on both sides."""
    return A.longest_chain(pairs, [key], "r_pos", "l_pos")


def drop_implausible(chain_: DataFrame, keys: list[str], lo: float = 4, hi: float = 30, passes: int = 3) -> DataFrame:
    """Drop a pair when both neighbours imply an impossible rate; pairs under two seconds apart are not judged.

    ``chain_(keys, letter, frame)``.
    """
    cols = chain_.columns
    for _ in range(passes):
        s = P.scan(chain_, keys, ["frame"], P.slice_of("frame", 50_000), {
            "__pl": P.previous(F.col("letter")), "__pf": P.previous(F.col("frame")),
            "__nl": P.following(F.col("letter")), "__nf": P.following(F.col("frame"))})

        def bad(l0: str, f0: str, l1: str, f1: str) -> Column:
            seconds = (F.col(f1) - F.col(f0)) * FRAME_MS / 1000.0
            rate = (F.col(l1) - F.col(l0)) / seconds
            return F.coalesce((seconds >= 2) & ~rate.between(lo, hi), F.lit(False))

        both = bad("__pl", "__pf", "letter", "frame") & bad("letter", "frame", "__nl", "__nf")
        chain_ = P.stage(s.filter(~both).select(*cols))
    return chain_


def segments(chain_: DataFrame, ends: DataFrame, keys: list[str], min_frames: int = 1_000, max_frames: int = 30_000,
             lo: float = 4, hi: float = 30) -> DataFrame:
    """Cut a chain into segments of at least ``min_frames`` and judge each by its length and rate.

    ``ends(keys, letters, frames)`` are the lengths of the two sides.  A cut jumps to the first frame far enough on;
    which frames are met is found by doubling the jumps.  Head and tail are refused only when too fast.
    """
    own = P.stage(chain_.select(*keys, "letter", "frame"))
    places = P.stage(own.select(*keys, "frame").distinct().withColumn("__need", F.col("frame") + min_frames))
    nodes = P.bracket(places, places.select(*keys, "frame"), keys, "__need", "frame", [], min_frames)
    kept = P.on_path(nodes.withColumn("__next", P.at_or_after("frame", "__need")["frame"]), keys, "frame", "__next")
    cut = P.stage(own.join(kept, [*keys, "frame"], "left_semi").groupBy(*keys, "frame").agg(F.min("letter").alias("letter")))
    s = P.scan(cut, keys, ["frame"], P.slice_of("frame", 50_000 * 20), {
        "__pl": P.previous(F.col("letter")), "nl": P.following(F.col("letter")), "nf": P.following(F.col("frame"))})
    s = s.join(ends, keys)
    zero = F.lit(0).cast("bigint")

    def part(kind: str, l0: Column, l1: Column, f0: Column, f1: Column, ok: Column) -> Column:
        return F.when(ok, F.struct(F.lit(kind).alias("kind"), l0.cast("bigint").alias("from_letter"), l1.cast("bigint").alias("to_letter"),
                                   f0.cast("bigint").alias("from_frame"), f1.cast("bigint").alias("to_frame")))

    inner_from = F.greatest(F.col("frame") - 1, zero)
    first, last = F.col("__pl").isNull(), F.col("nl").isNull()
    parts = F.array_compact(F.array(
        part("inner", F.col("letter"), F.col("nl"), inner_from, F.greatest(inner_from + 1, F.col("nf") - 1), ~last),
        part("head", zero, F.col("letter"), zero, F.col("frame"), first & (F.col("letter") > 0)),
        part("tail", F.col("letter"), F.col("letters"), F.col("frame"), F.col("frames"), last & (F.col("letter") < F.col("letters")))))
    p = s.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    frames = F.col("to_frame") - F.col("from_frame")
    rate = (F.col("to_letter") - F.col("from_letter")) / F.greatest(frames * FRAME_MS / 1000.0, F.lit(0.001))
    verdict = (F.when(rate > hi, "too fast").when((F.col("kind") == "inner") & (rate < lo), "too slow")
               .when((F.col("kind") == "inner") & (frames > max_frames), "too long").otherwise("align"))
    return p.withColumn("rate", rate).withColumn("verdict", verdict)


# --- offset without a map ---------------------------------------------------------------------

def from_offset(targets: DataFrame, evidence: DataFrame, anchors: DataFrame, chapters: DataFrame, books: DataFrame,
                near_chars: int = 200, at: str = "at_char") -> DataFrame:
    """Text offset to time from whatever is known: transcript evidence, a covering map, or the share of the book.

    ``evidence(book_id, open_char, open_ms, close_char, close_ms)``, unique per open_char.  Inside a window
    the time is interpolated; near one it is carried on at the window's own rate.
    """
    from versoline.operators import maps as M

    mapped = M.audio_at_char(targets, anchors, chapters, at, "__map")
    t = mapped.join(books.select("book_id", "duration_ms", "text_length"), "book_id")
    b = P.bracket(t, evidence, ["book_id"], at, "open_char", ["open_ms", "close_char", "close_ms"], 1_000)
    x = F.col(at)
    use_lo = F.col("hi").isNull() | (x - F.col("lo.open_char") <= F.col("hi.open_char") - x)
    b = b.withColumn("e", F.when(F.col("lo").isNotNull() & use_lo, F.col("lo")).otherwise(F.col("hi")))

    def pace(e: str) -> Column:
        moving = (F.col(f"{e}.close_ms") > F.col(f"{e}.open_ms")) & (F.col(f"{e}.close_char") > F.col(f"{e}.open_char"))
        return F.when(moving, (F.col(f"{e}.close_char") - F.col(f"{e}.open_char")).cast("double") / (F.col(f"{e}.close_ms") - F.col(f"{e}.open_ms"))).otherwise(
            F.col("text_length").cast("double") / F.col("duration_ms"))

    inside = (F.col("lo.close_char") >= x) & (F.col("lo.close_char") > F.col("lo.open_char"))
    exact = F.col("lo.open_ms") + F.rint(
        (x - F.col("lo.open_char")).cast("double") / (F.col("lo.close_char") - F.col("lo.open_char")) * (F.col("lo.close_ms") - F.col("lo.open_ms"))).cast("bigint")
    distance = x - F.col("e.open_char")
    landing = F.col("e.open_ms") + (distance / F.greatest(pace("e"), F.lit(0.001))).cast("bigint")
    near = F.abs(distance) <= near_chars
    share = (F.col("duration_ms") * (x.cast("double") / F.col("text_length"))).cast("bigint")
    method = F.when(inside, "inside").when(near, "near").when(F.col("__map").isNotNull(), "map").when(F.col("e").isNotNull(), "far").otherwise("share")
    ms = F.when(inside, exact).when(near, landing).when(F.col("__map").isNotNull(), F.col("__map")).when(F.col("e").isNotNull(), landing).otherwise(share)
    return b.select(*targets.columns, ms.alias("audio_ms"), method.alias("method"))
