"""Quality grades by ordinal cumulative-link regression.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
``P(grade > k) = sigmoid(w . x - t_k)`` with ``t_0 <= t_1 <= ...``.  The grades are the distinct ratings in the table, two or
more.  A document gets the expected grade and the tail probability of the selection grade or better; selection keeps tails of
one half or more.

Features of a whole text, hashed into a fixed number of places: its words, their shapes (runs of capitals, small letters,
digits and other signs), pairs of neighbouring shapes, each weighted by the square root of its share of the words; and marks
for the share of repeated words, of words equal to the one before, and of five-word windows seen twice.

Bounded: the fit uses at most ``max_rows`` rated rows (least hash of the id).  Scoring is one narrow pass over all documents.
Null and empty texts have only the marks.  Fewer than two grades: every document gets the only grade (0 without ratings) and
tail probability 1.  Repeated ids are scored row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import Sparse, hash_words, mix, released, sigmoid, slices, texts_of, word_table

PLACES = 1 << 16
RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\W\d_]+")
MARKS = np.arange(33, dtype=np.int64)  # three marks of eleven levels, kept apart from the hashed places


def shape(word: str) -> str:
    """Capitals, small letters, digits and other letters as one sign per run; other signs as they are, three at most."""
    kind = RUNS.sub(lambda m: "A" if m[0][0].isupper() else "9" if m[0][0].isdigit() else "a", word)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", kind)[:12]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value), sorted by text and place."""
    codes, docs, words = word_table(texts)
    n, count = len(texts), np.bincount(docs, minlength=len(texts))
    plain = [w.decode("utf-8", "replace") for w in words]
    word_h, shape_h = hash_words([w.lower() for w in plain]), hash_words(["\x01" + shape(w) for w in plain])
    same_doc = docs[1:] == docs[:-1]
    rows, ids = [docs, docs, docs[1:][same_doc]], [word_h[codes], shape_h[codes]]
    ids.append(mix(shape_h[codes[:-1]][same_doc] * np.uint64(31) + shape_h[codes[1:]][same_doc]))
    rows, ids = np.concatenate(rows), (np.concatenate(ids) % np.uint64(PLACES)).astype(np.int64) + len(MARKS)
    key, times = np.unique(rows * (PLACES + len(MARKS)) + ids, return_counts=True)
    rows, ids = np.divmod(key, PLACES + len(MARKS))
    values = np.sqrt(times / np.maximum(count[rows], 1))
    safe = np.maximum(count, 1)
    distinct = np.bincount(np.unique(docs * max(1, len(words)) + codes) // max(1, len(words)), minlength=n)
    echo = np.bincount(docs[1:][same_doc & (codes[1:] == codes[:-1])], minlength=n)
    twice = np.zeros(n)
    if len(codes) >= 5:
        whole = docs[4:] == docs[:-4]
        window = np.zeros(len(codes) - 4, np.uint64)
        for k in range(5):
            window = mix(window + codes[k : len(codes) - 4 + k].astype(np.uint64) + np.uint64(k + 1))
        at = docs[4:][whole]
        order = np.lexsort((window[whole], at))
        a, h = at[order], window[whole][order]
        again = (a[1:] == a[:-1]) & (h[1:] == h[:-1])
        twice = np.bincount(a[1:][again], minlength=n)
    levels = [np.minimum(10, (10 * share / safe)).astype(np.int64) for share in (count - distinct, echo, twice)]
    rows = np.concatenate([rows, *[np.arange(n)] * 3])
    ids = np.concatenate([ids, *[level + 11 * k for k, level in enumerate(levels)]])
    values = np.concatenate([values, np.ones(3 * n)])
    order = np.lexsort((ids, rows))
    return rows[order], ids[order], values[order]


@dataclass
class Ordinal:
    grades: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades, ascending

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k), one column per threshold."""
        rows, ids, values = features(texts)
        z = np.bincount(rows, values * self.weights[ids], len(texts))
        return sigmoid(z[:, None] - self.thresholds[None, :])


def fit_ordinal(x: Sparse, grade: np.ndarray, n_thresholds: int, l2: float = 0.02, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative logits, by accelerated gradient; thresholds stay ordered by sorting their steps."""
    n = len(grade)
    share = np.clip([(grade > k).mean() for k in range(n_thresholds)], 1e-3, 1 - 1e-3)
    w, t = np.zeros(x.shape[1]), np.maximum.accumulate(-np.log(share / (1 - share)))
    curve_w, curve_t = 0.25 * x.squares() * 6 + l2 * n / 100 + 1e-3, 0.25 * n * 2
    at, momentum = (w, t), 0.0
    hit = np.arange(n_thresholds)
    for step in range(steps):
        look_w, look_t = at[0] + momentum * (at[0] - w), np.maximum.accumulate(at[1] + momentum * (at[1] - t))
        above = sigmoid(x.dot(look_w)[:, None] - look_t[None, :])
        edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        mass = np.maximum(edges[np.arange(n), grade] - edges[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)
        # the mass of grade g is above[g - 1] - above[g]
        part = slope * ((hit[None, :] == grade[:, None] - 1).astype(float) - (hit[None, :] == grade[:, None])) / mass[:, None]
        w, t = at
        at = (look_w - (-x.back(part.sum(1)) + l2 * n / 100 * look_w) / curve_w, np.maximum.accumulate(look_t - part.sum(0) / curve_t))
        momentum = (step + 1) / (step + 4)
    return at


def fit(documents: DataFrame, ratings: DataFrame, rating: str = "quality", max_rows: int = 8_000) -> Ordinal:
    """Weights and thresholds from at most ``max_rows`` rated rows; an id rated twice counts once, with its least rating."""
    rated = ratings.where(F.col(rating).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(rating).alias("__y"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @released
    def emit(batches):
        for batch in slices(batches, "text"):
            rows, ids, values = features(texts_of(batch))
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            cut = list(zip(ends[:-1], ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__y").cast(pa.int64()), pa.array([ids[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()),
                 pa.array([values[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary())], ["y", "ids", "vals"])

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    got = texts.select("text", "__y").mapInArrow(emit, "y bigint, ids binary, vals binary").toPandas()
    grades = np.unique(got["y"].to_numpy()) if len(got) else np.zeros(1, np.int64)
    if len(grades) < 2:
        return Ordinal(grades, np.zeros(PLACES + len(MARKS)), np.zeros(0))
    ids = [np.frombuffer(b, np.int32) for b in got["ids"]]
    rows = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    x = Sparse(rows, np.concatenate(ids), np.frombuffer(b"".join(got["vals"]), np.float32), len(ids), PLACES + len(MARKS))
    return Ordinal(grades, *fit_ordinal(x, np.searchsorted(grades, got["y"].to_numpy()), len(grades) - 1))


def score(documents: DataFrame, model: Ordinal, least: int | None = None) -> DataFrame:
    """``documents`` with ``expected_grade`` and ``tail_probability`` of grade ``least`` or better (the middle grade upwards)."""
    kept = documents.drop("expected_grade", "tail_probability")
    schema = kept.select("*", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability")).schema
    place = len(model.grades) // 2 if least is None else int(np.searchsorted(model.grades, least))
    spread = documents.sparkSession.sparkContext.broadcast(model)  # 65,569 weights

    @released
    def run(batches):
        for batch in slices(batches, "text"):
            m = spread.value
            tails = m.tails(texts_of(batch))
            expected = m.grades[0] + tails @ np.diff(m.grades) if len(m.grades) > 1 else np.full(len(tails), float(m.grades[0]))
            tail = np.ones(len(tails)) if place == 0 else tails[:, place - 1] if place <= tails.shape[1] else np.zeros(len(tails))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected.astype(float)), pa.array(tail)], [*batch.schema.names, "expected_grade", "tail_probability"])

    return kept.mapInArrow(run, schema)


def quality(documents: DataFrame, ratings: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability, kept."""
    out = score(documents.select("doc_id", F.col("text").cast("string").alias("text")), fit(documents, ratings, **settings))
    return out.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def keep_good(documents: DataFrame, ratings: DataFrame, **settings) -> DataFrame:
    """The selected documents, with their own columns."""
    names = ("expected_grade", "tail_probability")
    model = fit(documents, ratings, **settings)
    own = [c for c in documents.columns if c in names]
    for c in own:
        documents = documents.withColumnRenamed(c, f"__{c}")
    out = score(documents, model).where(F.col("tail_probability") >= 0.5).drop(*names)
    for c in own:
        out = out.withColumnRenamed(f"__{c}", c)
    return out
