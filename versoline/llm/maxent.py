"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

``P(w | h) = P(class of w | h) * P(w | its class, h)``.  The first factor is a softmax over all classes, its weights indexed by hashed
features of the history: the class before, the two classes before (n-gram), the second, third and fourth class back alone (skips),
the frequent word before and the one before that.  Classes of frequent words (``PER_CLASS`` words each) have a softmax of their own
over hashed features of class and history; in classes of rarer words a word has the share of its count less a half.  A word that
training has not seen is one outcome, a class of its own that training learns from words seen once.  Probabilities sum to one.

Texts are cut once into slices of about ``SLICE`` bytes: word numbers per token and 64-bit hashes of the distinct words.

1. the most frequent words are grouped by what stands beside them in the whole corpus;
2. every slice asks for its distinct words, packed per hash range; a task per range adds up counts and neighbouring groups of each
   word and answers all slices (one shuffle there, one back; counts of all documents, nothing is pruned);
3. ``ROUNDS`` distributed gradient updates, each over its own part of every slice's training documents, so that each is used once:
   tasks add observed less expected features, Spark adds up their sums in blocks, the driver steps the weights (a bounded table);
4. one pass scores all tokens in sparse numpy batches.

* null text: empty, an end alone; null id: a training document; repeated ids and rows: each for itself; empty table: no rows;
* very long text: a slice of its own; other columns are not read, so their names can't clash;
* no training documents: every token is unknown, the only outcome, and has probability one;
* two words of one 64-bit hash would count as one (about 3 pairs expected among 1e10 distinct words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import hash_words, slices, stage, texts_of

SLICE = 4_000_000
FREQUENT, GROUPS, PER_CLASS, BANDS = 480, 8, 15, 3
ROUNDS, STEP, DAMPING = 4, 0.25, 1.0
WINDOW = 4
CLASS_ROWS, WORD_ROWS = 1 << 12, 1 << 13
BLOCK = 1 << 14
CHUNK = 1 << 14
#: The end of a text; no word holds a line end.
END = "\n"
HIST = 4 * 64
#: Numbers that a hash range reports: distinct words, tokens, ends, counts of the frequent words, words and counts by group and level.
SUMS = 3 + FREQUENT + 2 * GROUPS * HIST
U64 = np.uint64


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


# ---------------------------------------------------------------- slices

CUT = "slice bigint, doc_ids array<bigint>, train binary, lengths binary, codes binary, hashes binary, counts binary"


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("train", "lengths", "codes", "hashes", "counts"))])
    end = hash_words([END])
    number = TaskContext.get().partitionId() << 32
    ids, train, texts, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        words = [t.lower().split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat = np.empty(int(lengths.sum()) - len(words), object)
        flat[:] = [w for own in words for w in own]
        words.clear()
        found, distinct = pd.factorize(flat)
        del flat
        codes = np.zeros(int(lengths.sum()), np.uint32)  # the end is code 0
        inner = np.ones(len(codes), bool)
        inner[np.cumsum(lengths) - 1] = False
        codes[inner] = found + 1
        hashes = np.concatenate([end, hash_words(distinct)])
        counts = np.bincount(codes[np.repeat(np.array(train, bool), lengths)], minlength=len(hashes)).astype(np.uint32)
        row = [number, list(ids), pack(np.array(train, bool)), pack(lengths), pack(codes), pack(hashes), pack(counts)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

    for batch in slices(batches, "text", limit // 4):
        ids += batch.column("doc_id").to_pylist()
        train += batch.column("train").to_pylist()
        own = texts_of(batch)
        texts += own
        size += sum(map(len, own)) + 16 * len(own)
        if size >= limit:
            yield out()
            number += 1
            ids.clear(), train.clear(), texts.clear()
            size = 0
    if ids:
        yield out()


def sliced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE) -> DataFrame:
    """Staged slices of all documents; a document trains unless the checksum of its id leaves 1 on division by 5."""
    own = F.col(id_col).cast("bigint").alias("doc_id")
    train = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 1, F.lit(True)).alias("train")
    return stage(docs.select(own, F.col(text_col).alias("text"), train).mapInArrow(lambda batches: _cut(batches, size), CUT))


# ---------------------------------------------------------------- sums over tasks

def add_up(parts: DataFrame) -> DataFrame:
    """Sum of the float64 vectors ``v`` of each ``block``: per salt first, streamed, so that no task reads a row of every other one."""

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for blob in batch.column("v").to_pylist():
                x = unpack(blob, np.float64)
                whole = x if whole is None else whole + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([pack(whole)], pa.binary())], names=["block", "v"])

    once = parts.groupBy("block", "salt").applyInArrow(total, "block bigint, v binary")
    return once.groupBy("block").applyInArrow(total, "block bigint, v binary")


def blocks_of(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's vector in blocks; blocks of zeros only are left out."""
    salt = TaskContext.get().partitionId() // 64
    for k in range(0, len(x), BLOCK):
        own = x[k:k + BLOCK]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int64()), pa.array([salt], pa.int64()), pa.array([pack(own.astype(np.float64))], pa.binary())], names=["block", "salt", "v"])


PARTS = "block bigint, salt bigint, v binary"


def gather(parts: DataFrame, size: int) -> np.ndarray:
    """The summed vector (of bounded ``size``) on the driver."""
    out = np.zeros(-(-size // BLOCK) * BLOCK)
    for block, v in add_up(parts).select("block", "v").collect():
        x = unpack(v, np.float64)
        out[block * BLOCK: block * BLOCK + len(x)] = x
    return out[:size]


# ---------------------------------------------------------------- frequent words and their groups

def _places(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per hash its place among the wanted ones, -1 for others."""
    order = np.argsort(wanted)
    if not len(wanted):
        return np.full(len(hashes), -1, np.int32)
    at = np.minimum(np.searchsorted(wanted[order], hashes), len(wanted) - 1)
    return np.where(wanted[order][at] == hashes, order[at], -1).astype(np.int32)


def frequent_words(cut: DataFrame, n: int = FREQUENT) -> np.ndarray:
    """Hashes of the words most frequent in the whole training text, of those found more than once; count, then hash, decides."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, counts in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
                h, c = unpack(blob, U64)[1:], unpack(counts, np.uint32)[1:]
                yield pa.RecordBatch.from_arrays([pa.array(h[c > 0].view(np.int64)), pa.array(c[c > 0].astype(np.int64))], names=["h", "c"])

    words = cut.select("hashes", "counts").mapInArrow(counted, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    rows = words.filter("c > 1").orderBy(F.desc("c"), "h").limit(n).collect()
    return np.array([r["h"] for r in rows], np.int64).view(U64)


def _beside(codes: np.ndarray, owner: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of tokens and of the tokens ``far`` places on in the same document."""
    left = np.flatnonzero(owner[:-far] == owner[far:]) if len(owner) > far else np.zeros(0, np.int64)
    return left, left + far


def word_groups(cut: DataFrame, words: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group per frequent word: k-means of the leading singular vectors of how often they stand within two places, over all training documents."""
    n = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n)
        for batch in batches:
            for lengths, train, codes, hashes in zip(*(batch.column(c).to_pylist() for c in ("lengths", "train", "codes", "hashes"))):
                place = _places(unpack(hashes, U64), words)[unpack(codes, np.uint32)]
                lengths = unpack(lengths, np.int64)
                place = np.where(np.repeat(unpack(train, bool), lengths), place, -1)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                for far in (1, 2):
                    a, b = _beside(place, owner, far)
                    a, b = place[a], place[b]
                    both = (a >= 0) & (b >= 0)
                    total += np.bincount(a[both].astype(np.int64) * n + b[both], minlength=n * n)
        yield from blocks_of(total)

    if not n:
        return np.zeros(0, np.int64)
    x = gather(cut.select("lengths", "train", "codes", "hashes").mapInArrow(count, PARTS), n * n).reshape(n, n)
    x = x + x.T
    share = np.maximum(x.sum(1), 1)
    x = np.log1p(x * share.sum() / share / share[:, None])
    u, s, _ = np.linalg.svd(x)
    x = u[:, :groups] * s[:groups]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[0]]
    while len(centres) < min(groups, n):  # the farthest from all so far
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(20):
        own = np.argmax(x @ centres.T, axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = x[own == k].mean(0)
                centres[k] /= max(np.linalg.norm(centres[k]), 1e-9)
    return own


# ---------------------------------------------------------------- counts of all words

def _requests(words: np.ndarray, groups: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "slice", "hashes", "counts", "votes", "sums"]
        for batch in batches:
            for number, lengths, train, codes, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "lengths", "train", "codes", "hashes", "counts"))):
                hashes, counts, lengths, codes = unpack(hashes, U64), unpack(counts, np.uint32), unpack(lengths, np.int64), unpack(codes, np.uint32)
                trains = np.repeat(unpack(train, bool), lengths)
                place = _places(hashes, words)[codes]
                side = np.where(place >= 0, groups[place] if len(groups) else 0, -1)
                owner = np.where(trains, np.repeat(np.arange(len(lengths)), lengths), -1 - np.arange(len(codes)))  # tokens that do not train have no neighbours
                votes = np.zeros(len(hashes) * GROUPS, np.uint32)
                for far in (1, 2):
                    a, b = _beside(codes, owner, far)
                    for at, by in ((a, b), (b, a)):
                        at, by = at[side[by] >= 0], by[side[by] >= 0]
                        votes += np.bincount(codes[at].astype(np.int64) * GROUPS + side[by], minlength=len(votes)).astype(np.uint32)
                order = np.argsort(hashes)
                hashes, counts, votes = hashes[order], counts[order], votes.reshape(-1, GROUPS)[order]
                of = (hashes >> U64(44)) * U64(buckets) >> U64(20)
                ends = np.searchsorted(of, np.arange(buckets + 1).astype(U64))
                rows = []
                for k in range(buckets):
                    i, j = ends[k], ends[k + 1]
                    if i < j:
                        flat = votes[i:j].ravel()
                        at = np.flatnonzero(flat)
                        rows.append((k, number, pack(hashes[i:j]), pack(counts[i:j]), pack(at.astype(np.uint32)), pack(flat[at])))
                types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


ANSWERS = "slice bigint, bucket bigint, counts binary, groups binary, sums binary"


def _answer(words: np.ndarray):
    """A hash range: counts and group of every word there, sent to all slices that asked; a row without a slice has the range's sums."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asked = [unpack(x, U64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in asked])
        starts = np.cumsum(sizes) - sizes
        distinct, own = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(own, np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()]), len(distinct)).astype(np.int64)
        votes = np.zeros(len(distinct) * GROUPS)
        for start, at, sums in zip(starts, table.column("votes").to_pylist(), table.column("sums").to_pylist()):
            at = unpack(at, np.uint32).astype(np.int64)
            np.add.at(votes, own[start + at // GROUPS] * GROUPS + at % GROUPS, unpack(sums, np.uint32))
        votes = votes.reshape(-1, GROUPS)
        group = np.where(votes.any(1), votes.argmax(1), (distinct % U64(GROUPS)).astype(np.int64)).astype(np.uint8)
        place, end = _places(distinct, words), hash_words([END])[0]
        bare = (counts > 0) & (place < 0) & (distinct != end)
        sums = np.zeros((2, GROUPS, HIST))  # words, and their counts
        for k, w in enumerate((np.ones(len(counts)), counts)):
            sums[k] = np.bincount(group[bare].astype(np.int64) * HIST + level(counts[bare]), w[bare], GROUPS * HIST).reshape(GROUPS, HIST)
        total = np.concatenate([[np.count_nonzero(counts), counts.sum(), counts[distinct == end].sum()], np.zeros(FREQUENT), sums.ravel()])
        total[3 + place[place >= 0]] = counts[place >= 0]
        number, bucket = table.column("slice").to_pylist(), key[0].as_py()
        rows = [(n, bucket, pack(counts[own[s:s + z]]), pack(group[own[s:s + z]]), None) for n, s, z in zip(number, starts, sizes)]
        rows.append((None, bucket, None, None, pack(total)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.binary()] * 3])], names=["slice", "bucket", "counts", "groups", "sums"])

    return run


def level(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of a quarter of a doubling."""
    return np.minimum((4 * np.log2(np.maximum(counts, 1))).astype(np.int64), HIST - 1)


def answers(cut: DataFrame, words: np.ndarray, groups: np.ndarray) -> DataFrame:
    size = cut.select(F.sum(F.length("hashes"))).first()[0] or 0
    buckets = int(min(1 << 19, max(12, size // 4_000_000)))
    asked = cut.select("slice", "lengths", "train", "codes", "hashes", "counts").mapInArrow(_requests(words, groups, buckets), "bucket bigint, slice bigint, hashes binary, counts binary, votes binary, sums binary")
    return stage(asked.groupBy("bucket").applyInArrow(_answer(words), ANSWERS))


# ---------------------------------------------------------------- classes

@dataclass
class Classes:
    """What a word's class follows from: bounded tables."""

    words: np.ndarray  # hashes of frequent words
    of_word: np.ndarray  # their class
    member: np.ndarray  # their place in it
    edges: np.ndarray  # per group the levels at which rarer words change band
    mass: np.ndarray  # per class of rarer words the sum of counts less a half
    prior: np.ndarray  # per class its share of the training tokens; words seen once count as unknown
    n_head: int
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return self.n_head + GROUPS * BANDS + 2

    @property
    def end(self) -> int:
        return self.size - 2

    @property
    def unknown(self) -> int:
        return self.size - 1

    def of(self, counts: np.ndarray, groups: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Class per distinct word of a slice; code 0 is the end."""
        steps = level(counts)
        band = sum((steps >= self.edges[groups, k]).astype(np.int64) for k in range(BANDS - 1))
        out = self.n_head + groups.astype(np.int64) * BANDS + band
        if len(self.words):
            out = np.where(place >= 0, self.of_word[place], out)
        out[0] = self.end
        return np.where(counts == 0, self.unknown, out)


def classes(words: np.ndarray, groups: np.ndarray, sums: np.ndarray) -> Classes:
    distinct, tokens, ends = (int(round(x)) for x in sums[:3])
    n, c = sums[3 + FREQUENT:].reshape(2, GROUPS, HIST)
    of_word, member, used = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
    for g in range(GROUPS):
        own = np.flatnonzero(groups == g)  # already by falling count
        of_word[own] = used + np.arange(len(own)) // PER_CLASS
        member[own] = np.arange(len(own)) % PER_CLASS
        used += -(-len(own) // PER_CLASS)
    edges, mass = np.zeros((GROUPS, BANDS - 1), np.int64), np.zeros(used + GROUPS * BANDS + 2)
    prior = np.zeros_like(mass)
    for g in range(GROUPS):
        rising = np.cumsum(c[g])
        edges[g] = [np.searchsorted(rising, rising[-1] * (k + 1) / BANDS) + 1 for k in range(BANDS - 1)]
        for k, (a, b) in enumerate(zip([0, *edges[g]], [*edges[g], HIST])):
            mass[used + g * BANDS + k] = (c[g] - n[g] / 2)[a:b].sum()
            prior[used + g * BANDS + k] = max(c[g, max(a, 1):b].sum(), min(mass[used + g * BANDS + k], 0.5))
    prior[:used] = np.bincount(of_word, sums[3:3 + len(words)], used)
    prior[-2:] = ends, max(c[:, 0].sum(), 0.5)
    return Classes(words, of_word, member, edges, mass, prior / prior.sum(), used, tokens, distinct)


# ---------------------------------------------------------------- the model

def rows_of(kind: int, a: np.ndarray, b: np.ndarray | int, rows: int) -> np.ndarray:
    """The hashed row of a feature."""
    x = a.astype(U64) * U64(0x9E3779B97F4A7C15) + np.asarray(b).astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(kind * 0x165667B19E3779F9 % (1 << 64))
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    return (x >> U64(64 - rows.bit_length() + 1)).astype(np.int64)


@dataclass
class Tokens:
    """A slice's tokens as the model sees them, before each document WINDOW places of the class ``none``."""

    cls: np.ndarray  # class of each
    member: np.ndarray  # place in a class of frequent words, else -1
    seen: np.ndarray  # class as history: words seen once are unknown there
    word: np.ndarray  # frequent word, else FREQUENT
    real: np.ndarray  # where the tokens stand among these


class Model:
    """The hashed weights of both softmaxes; ``alive`` and ``members`` say which outcomes exist."""

    def __init__(self, size: int, prior: np.ndarray, members: np.ndarray):
        self.size, self.heads = size, int(np.count_nonzero(members))
        self.first = np.zeros((CLASS_ROWS, size), np.float32)
        self.second = np.zeros((WORD_ROWS, PER_CLASS), np.float32)
        self.prior = np.where(prior > 0, np.log(np.maximum(prior, 1e-30)), -1e9).astype(np.float32)
        self.shut = np.where(np.arange(PER_CLASS) < members[:self.heads, None], 0, -1e9).astype(np.float32)

    def rows(self) -> tuple[list, list]:
        """Per table of histories its features' rows, and the shape of that table: (the two classes before), (the two before those),
        (the frequent word before), (the one before that); then by (class, class before), (class, word before), (class, second word)."""
        c = np.arange(self.size + 1)
        a, b = (x.ravel() for x in np.meshgrid(c, c, indexing="ij"))
        w = np.arange(FREQUENT)
        own = np.arange(self.heads)
        oc, ob = (x.ravel() for x in np.meshgrid(own, c, indexing="ij"))
        oo, ow = (x.ravel() for x in np.meshgrid(own, w, indexing="ij"))
        first = [[rows_of(1, a, 0, CLASS_ROWS), rows_of(2, a, b, CLASS_ROWS), rows_of(3, b, 0, CLASS_ROWS)], [rows_of(4, a, 0, CLASS_ROWS), rows_of(5, b, 0, CLASS_ROWS)],
                 [rows_of(6, w, 0, CLASS_ROWS)], [rows_of(7, w, 0, CLASS_ROWS)]]
        second = [[rows_of(8, oc, 0, WORD_ROWS), rows_of(9, oc, ob, WORD_ROWS)], [rows_of(10, oo, ow, WORD_ROWS)], [rows_of(11, oo, ow, WORD_ROWS)]]
        return first, second

    def tables(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The summed weights per history; the last line of a table is that of no frequent word."""
        first, second = self.rows()
        one = [sum(self.first[r] for r in rows) for rows in first]
        one[0] += self.prior
        two = [sum(self.second[r] for r in rows) for rows in second]
        two[0] += np.repeat(self.shut, self.size + 1, 0)
        padded = lambda x: np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return [*one[:2], *map(padded, one[2:])], [two[0], *map(padded, two[1:])]


def histories(model: Model, t: Tokens, at: np.ndarray) -> list[np.ndarray]:
    """The lines of the four tables for the tokens at ``at``."""
    n = model.size + 1
    return [t.seen[at - 1] * n + t.seen[at - 2], t.seen[at - 3] * n + t.seen[at - 4], t.word[at - 1], t.word[at - 2]]


def own_histories(model: Model, t: Tokens, at: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
    """The lines of the three tables of a class of frequent words."""
    out = [cls * (model.size + 1) + t.seen[at - 1]]
    for far in (1, 2):
        w = t.word[at - far]
        out.append(np.where(w < FREQUENT, cls * FREQUENT + w, model.heads * FREQUENT))
    return out


def _logits(tables: list[np.ndarray], lines: list[np.ndarray]) -> np.ndarray:
    z = tables[0].take(lines[0], 0)
    for table, line in zip(tables[1:], lines[1:]):
        z += table.take(line, 0)
    z -= z.max(1, keepdims=True)
    return z


def _add(into: list[np.ndarray], lines: list[np.ndarray], x: np.ndarray) -> None:
    """Add the lines of ``x`` to the lines of every table."""
    for table, line in zip(into, lines):
        order = np.argsort(line.astype(np.uint16) if len(table) <= 1 << 16 else line, kind="stable")
        own = line[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        table[own[starts]] += np.add.reduceat(x.take(order, 0), starts, axis=0)


class Sums:
    """Observed and expected features of a task, per line of a history table while it runs."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = model.tables()
        self.observed, self.expected = ([[np.zeros(x.shape, np.float32) for x in tables] for tables in self.weights] for _ in range(2))

    def add(self, t: Tokens, wanted: np.ndarray) -> None:
        """The wanted tokens; words seen once stand for the unknown."""
        places = t.real[wanted]
        for start in range(0, len(places), CHUNK):
            at = places[start:start + CHUNK]
            target = t.seen[at]
            self._one(0, histories(self.model, t, at), target)
            at = at[(t.member[at] >= 0) & (target == t.cls[at])]
            if len(at):
                self._one(1, own_histories(self.model, t, at, t.cls[at]), t.member[at])

    def _one(self, k: int, lines: list[np.ndarray], target: np.ndarray) -> None:
        p = _logits(self.weights[k], lines)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        _add(self.expected[k], lines, p)
        for table, line in zip(self.observed[k], lines):
            table += np.bincount(line * table.shape[1] + target, minlength=table.size).reshape(table.shape).astype(np.float32) if len(line) * 8 > table.size else 0
            if len(line) * 8 <= table.size:
                np.add.at(table, (line, target), 1)

    def vector(self) -> np.ndarray:
        """Observed and expected per weight, both tables."""
        out = []
        for sums in (self.observed, self.expected):
            for rows, tables, shape in zip(self.model.rows(), sums, (self.model.first.shape, self.model.second.shape)):
                total = np.zeros(shape, np.float32)
                for own, table in zip(rows, tables):
                    for r in own:
                        np.add.at(total, r, table[:len(r)])
                out.append(total.ravel())
        return np.concatenate(out)


def log_probabilities(model: Model, tables: tuple, t: Tokens, share: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's probability; ``share`` is that of a rarer word in its class."""
    out = np.empty(len(t.real))

    def of(k: int, lines: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        z = _logits(tables[k], lines)
        own = z[np.arange(len(target)), target]
        return own - np.log(np.exp(z, out=z).sum(1))

    for start in range(0, len(out), CHUNK):
        at = t.real[start:start + CHUNK]
        cls = t.cls[at]
        logs = of(0, histories(model, t, at), cls).astype(np.float64) + share[start:start + CHUNK]
        inner = np.flatnonzero(t.member[at] >= 0)
        if len(inner):
            logs[inner] += of(1, own_histories(model, t, at[inner], cls[inner]), t.member[at[inner]])
        out[start:start + CHUNK] = logs
    return out


# ---------------------------------------------------------------- the Spark job

READY = "slice bigint, doc_ids array<bigint>, train binary, lengths binary, codes binary, places binary, counts binary, groups binary"


def with_counts(cut: DataFrame, answered: DataFrame, words: np.ndarray) -> DataFrame:
    """Staged slices whose distinct words have their count, group and place among the frequent words instead of their hash."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, places = [], []
            for blob in batch.column("hashes").to_pylist():
                h = unpack(blob, U64)
                order.append(pack(np.argsort(h).astype(np.uint32)))
                places.append(pack(_places(h, words).astype(np.int16)))
            keep = [c for c in batch.schema.names if c != "hashes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(order, pa.binary()), pa.array(places, pa.binary())], names=[*keep, "order", "places"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        order = unpack(left.column("order")[0].as_py(), np.uint32)
        found = {}
        for name, kind in (("counts", np.int64), ("groups", np.uint8)):
            x = np.concatenate([unpack(b, kind) for b in right.column(name).to_pylist()])
            found[name] = np.empty_like(x)
            found[name][order] = x
        cols = {c: left.column(c) for c in ("slice", "doc_ids", "train", "lengths", "codes", "places")}
        return pa.table(cols | {k: pa.array([pack(v)], pa.binary()) for k, v in found.items()})

    slim = cut.select("slice", "doc_ids", "train", "lengths", "codes", "hashes").mapInArrow(prepare, "slice bigint, doc_ids array<bigint>, train binary, lengths binary, codes binary, order binary, places binary")
    back = answered.filter("slice is not null").select("slice", "bucket", "counts", "groups")
    return stage(slim.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(join, READY))


def _read(row: dict, own: Classes) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their document, its length, counts of the distinct words and codes."""
    codes, places, counts, groups = (unpack(row[c], k) for c, k in (("codes", np.uint32), ("places", np.int16), ("counts", np.int64), ("groups", np.uint8)))
    lengths = unpack(row["lengths"], np.int64)
    cls = own.of(counts, groups, places)
    member = np.where((places >= 0) & (cls < own.n_head), own.member[places] if len(own.member) else -1, -1)
    seen = np.where(counts <= 1, own.unknown, cls)
    seen[0] = cls[0]
    word = np.where((places >= 0) & (cls < own.n_head), places, FREQUENT)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    real = np.arange(len(codes)) + WINDOW * (owner + 1)

    def spread(x: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(codes) + WINDOW * len(lengths), none, np.int64)
        out[real] = x[codes]
        return out

    return Tokens(spread(cls, 0), spread(member, -1), spread(seen, own.size), spread(word, FREQUENT), real), owner, lengths, counts, codes


def train(ready: DataFrame, own: Classes, rounds: int = ROUNDS) -> Model:
    """The weights after ``rounds`` updates; a document of a slice trains in the round of its place there.

    A weight's gradient is its observed less its expected count; the step is STEP times the gradient over the logarithmic mean of the two,
    which is STEP * log(observed / expected).
    """
    spark = ready.sparkSession
    model = Model(own.size, own.prior, np.bincount(own.of_word, minlength=own.size))
    if not own.tokens:
        return model
    sizes = [model.first.size, model.second.size]
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((model, own))

        def step(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            model, own = shared.value
            sums, used = None, False
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    tokens, owner, lengths, _, _ = _read(row, own)
                    sums = sums or Sums(model)
                    sums.add(tokens, (unpack(row["train"], bool) & (np.arange(len(lengths)) % rounds == k))[owner])
            if sums:
                yield from blocks_of(sums.vector())

        total = gather(ready.select("train", "lengths", "codes", "places", "counts", "groups").mapInArrow(step, PARTS), 2 * sum(sizes))
        shared.unpersist()
        for weights, seen, due in zip((model.first, model.second), np.split(total, np.cumsum([*sizes, *sizes])[:-1])[:2], np.split(total, np.cumsum([*sizes, *sizes])[:-1])[2:]):
            weights += (STEP * np.log((seen + DAMPING) / (due + DAMPING))).reshape(weights.shape).astype(np.float32)
    return model


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(ready: DataFrame, own: Classes, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = ready.sparkSession.sparkContext.broadcast((model, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = shared.value
        tables = model.tables()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                tokens, owner, lengths, counts, codes = _read(row, own)
                n = len(lengths)
                base = np.log10((counts + 0.5) / (own.tokens + 0.5 * (own.distinct + 1)))
                cls = tokens.cls[tokens.real]
                mass = own.mass[cls]
                tail = (cls >= own.n_head) & (cls < own.end)
                share = np.where(tail, np.log(np.maximum(counts[codes] - 0.5, 0.5) / np.where(tail, mass, 1)), 0.0)
                logs = log_probabilities(model, tables, tokens, share) / np.log(10)
                known = np.bincount(owner, counts[codes] > 0, n).astype(np.int64)
                cols = [row["doc_ids"], ~unpack(row["train"], bool), lengths, known, np.full(n, own.tokens), np.bincount(owner, base[codes], n), np.bincount(owner, logs, n)]
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SCORES.split(", ")])

    return ready.mapInArrow(run, SCORES)


def fit(docs: DataFrame, size: int = SLICE) -> tuple[DataFrame, Classes, Model]:
    """Staged slices with counts, the classes and the trained model."""
    cut = sliced(docs, size=size)
    words = frequent_words(cut)
    groups = word_groups(cut, words)
    answered = answers(cut, words, groups)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SUMS)
        for batch in batches:
            for blob in batch.column("sums").to_pylist():
                total += unpack(blob, np.float64)
        yield from blocks_of(total)

    own = classes(words, groups, gather(answered.filter("slice is null").select("sums").mapInArrow(sums, PARTS), SUMS))
    ready = with_counts(cut, answered, words)
    return ready, own, train(ready, own)


def scores(docs: DataFrame) -> DataFrame:
    """Every document's scores; the language model learns from the documents that are not held out."""
    return score(*fit(docs))
