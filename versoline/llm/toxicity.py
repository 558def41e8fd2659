"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters see the text only.  A *lexicon* voter fires on a word of a public list of insults; a *pattern* voter fires on a word
stem (first four to six letters) or word that the labelled training rows show to go with toxic texts.  The label model is a
latent class model: voter ``j`` fires with one probability in toxic and another in clean texts; expectation maximisation
finds them from the votes, with the precision of a voter kept near what the labelled training rows show.  Voters that still agree beyond what the class explains are correlated: they are
joined into one before the model is fitted again, so that a family of stems counts once.  A logistic classifier over hashed
words and stems is then fitted to the posterior labels, and scores every whole text.

Bounded: the fit uses at most ``max_rows`` labelled rows (least hash of the id, held-out fifth left out).  Scoring covers all
documents in one narrow pass; nothing is shuffled but the sample.  Null and empty texts have no word and get the score of the
intercept.  Without labelled rows the score is the prior, below one half.  Repeated ids are scored row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import Sparse, hash_words, held_out, released, sigmoid, slices, stage, texts_of, word_table

#: Fixed word list: common public insults.
LEXICON = [
    "arschloch", "basura", "bastard", "bitch", "clown", "connard", "crap", "cretin", "damn", "disgusting", "dumb", "dummkopf", "estupido", "filth",
    "fool", "freak", "garbage", "hate", "idiot", "idiota", "imbecile", "imbécile", "jerk", "loser", "lunatic", "moron", "nasty", "pathetic",
    "pig", "rubbish", "salaud", "scum", "shut", "sick", "stupid", "stupide", "sucker", "terrible", "trash", "ugly", "vermin", "worthless",
]
STEMS = (4, 5, 6)
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(texts: list[bytes], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hashed feature) pairs; with ``chosen`` (sorted) only of those, by their place in it."""
    codes, docs, words = word_table(texts)
    plain = [w.decode("utf-8", "replace").strip(TRIM).lower() for w in words]
    rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    pairs = np.unique(docs * max(1, len(plain)) + codes)
    docs, codes = np.divmod(pairs, max(1, len(plain)))
    for size in (None, *STEMS):
        names = plain if size is None else [f"{size}:{w[:size]}" if len(w) >= size else "" for w in plain]
        h = (hash_words(names) >> np.uint64(1)).astype(np.int64)
        ok = np.fromiter(map(bool, names), bool, len(names))
        if chosen is not None:
            at = np.searchsorted(chosen, h)
            at[at == len(chosen)] = 0
            ok &= (chosen[at] == h) if len(chosen) else False
            h = at.astype(np.int64)
        keep = ok[codes]
        rows.append(docs[keep])
        ids.append(h[codes[keep]])
    rows, ids = np.concatenate(rows), np.concatenate(ids)
    order = np.lexsort((ids, rows))
    rows, ids = rows[order], ids[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    return rows[first], ids[first]


def choose_voters(x: Sparse, y: np.ndarray, lexicon: np.ndarray, most: int) -> np.ndarray:
    """Lexicon features that occur, then patterns: precise ones, greedily by the toxic rows that no chosen one covers yet."""
    n, d = x.shape
    pos, df = np.bincount(x.features, y[x.rows], d), np.bincount(x.features, minlength=d)
    chosen = [int(f) for f in lexicon if df[f] >= 2]
    precise = (pos >= 3) & (pos >= 0.95 * df)
    part = precise[x.features] & (y[x.rows] > 0)
    rows, feats = x.rows[part], x.features[part]
    covered = np.zeros(n)
    covered += np.bincount(x.rows[np.isin(x.features, chosen)], minlength=n)
    while len(chosen) < most and len(feats):
        gain = np.bincount(feats, 0.25 ** np.minimum(covered[rows], 8), d)
        gain[chosen] = 0
        best = int(gain.argmax())
        if gain[best] < 0.05:
            break
        chosen.append(best)
        covered += np.bincount(rows[feats == best], minlength=n)
    return np.array(chosen, np.int64)


@dataclass
class LabelModel:
    prior: float
    fires_toxic: np.ndarray
    fires_clean: np.ndarray
    silent_toxic: float
    silent_clean: float
    groups: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A voter that does not fire abstains; only the silence of all of them speaks."""
        v = grouped(votes, self.groups)
        z = np.log(self.prior / (1 - self.prior)) + v @ np.log(self.fires_toxic / self.fires_clean)
        return sigmoid(z + (v.sum(1) == 0) * np.log(self.silent_toxic / self.silent_clean))


def grouped(votes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    out = np.zeros((len(votes), groups.max() + 1 if len(groups) else 0))
    for j, g in enumerate(groups):
        np.maximum(out[:, g], votes[:, j], out=out[:, g])
    return out


def fit_label_model(votes: np.ndarray, rated: np.ndarray | None = None, rounds: int = 50, tie: float = 0.5) -> LabelModel:
    """Accuracies by expectation maximisation; voters whose residuals correlate by ``tie`` or more are joined, then again.

    The precision of a voter is bounded from below, by what it has on ``rated`` rows or one half.  Without a bound a family of
    voters that never fires together with the others (another language) can settle in the clean class.  With rated rows it is
    also bounded from above, 0.1 higher: a voter that fires alone can't talk itself into being right.
    """
    groups = np.arange(votes.shape[1])
    for attempt in range(2):
        v = grouped(votes, groups)
        least = np.full(v.shape[1], 0.5) if rated is None else np.clip((rated @ v + 1) / (v.sum(0) + 2), 0.05, 0.95)
        most = np.clip(least + 0.1, 0, 0.999)
        p = np.where(v.sum(1) >= 1, 0.9, 0.02)
        for _ in range(rounds):
            prior = np.clip(p.mean(), 1e-4, 0.5)
            a = np.clip((p @ v + 0.5) / (p.sum() + 1), 1e-3, 0.99)
            b = np.clip(((1 - p) @ v + 0.05) / ((1 - p).sum() + 1), 1e-5, 0.99)
            odds = a * prior / (1 - prior)
            b = np.maximum(np.minimum(b, odds * (1 - least) / least), odds * (1 - most) / most if rated is not None else 1e-6)
            silent = v.sum(1) == 0
            quiet = [float((q @ silent + s) / (q.sum() + 1)) for q, s in ((p, 0.05), (1 - p, 0.95))]
            model = LabelModel(float(prior), a, b, *quiet, groups)
            p = model.posterior(votes)
        if attempt or v.shape[1] < 2:
            break
        residual = v - (np.outer(p, a) + np.outer(1 - p, b))
        scale = np.sqrt((residual**2).sum(0)) + 1e-9
        ties = (residual.T @ residual) / np.outer(scale, scale) >= tie
        label = np.arange(len(ties))
        for _ in range(len(ties)):  # connected voters share the least number
            lower = np.where(ties, label[None, :], len(ties)).min(1)
            if (lower == label).all():
                break
            label = lower
        if (label == np.arange(len(label))).all():
            break
        groups = np.unique(label, return_inverse=True)[1]
    return model


@dataclass
class Classifier:
    chosen: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    intercept: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows, ids = features(texts, self.chosen)
        return sigmoid(self.intercept + np.bincount(rows, self.weights[ids], len(texts)))


def fit_classifier(x: Sparse, names: np.ndarray, p: np.ndarray, keep: int = 4096, l2: float = 0.5, steps: int = 200) -> Classifier:
    """Logistic regression on soft labels over the ``keep`` features that speak most for the toxic class (G statistic).

    Weights are not negative: clean words do not excuse an insult, however long the text.
    """
    n, d = x.shape
    df, pos = np.bincount(x.features, minlength=d), np.bincount(x.features, p[x.rows], d)
    base = np.clip(p.mean(), 1e-6, 1 - 1e-6)
    rate = np.clip(pos / np.maximum(df, 1), 1e-9, 1 - 1e-9)
    g = df * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
    g[(df < 2) | (rate < np.minimum(3 * base, 0.5))] = 0
    best = np.sort(np.argsort(-g, kind="stable")[:keep])
    best = best[g[best] > 3]
    place = np.full(d, -1)
    place[best] = np.arange(len(best))
    part = place[x.features] >= 0
    s = Sparse(x.rows[part], place[x.features[part]], np.ones(part.sum()), n, len(best))
    w, b = np.zeros(len(best)), float(np.log(base / (1 - base)))
    curve, at, momentum = 0.25 * s.squares() * 8 + l2, (w, b), 0.0
    for k in range(steps):
        look_w, look_b = at[0] + momentum * (at[0] - w), at[1] + momentum * (at[1] - b)
        r = sigmoid(s.dot(look_w) + look_b) - p
        w, b = at
        at = (np.maximum(look_w - (s.back(r) + l2 * look_w) / curve, 0), look_b - r.sum() / (0.25 * n * 2))
        momentum = (k + 1) / (k + 4)
    return Classifier(names[best], at[0], at[1])


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 16_000, voters: int = 96, max_features: int = 30_000) -> Classifier:
    """Label model and classifier from at most ``max_rows`` labelled rows outside the held-out fifth.  Spark counts the features
    of these rows; the ``max_features`` that go with toxic ones most are kept."""
    rated = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    texts = stage(texts.select("text", (F.col("__y") > 0).alias("toxic")))
    words = (hash_words(LEXICON) >> np.uint64(1)).astype(np.int64)

    @released
    def tally(batches):  # how many texts, and toxic ones, have a feature
        for batch in slices(batches, "text"):
            rows, ids = features(texts_of(batch))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(float)
            names, index = np.unique(ids, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(index, minlength=len(names))), pa.array(np.bincount(index, toxic[rows], len(names)).astype(np.int64))], ["id", "df", "pos"])

    size, toxic = texts.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    if not toxic:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(0.5 / (size + 1.5))))
    tallied = texts.mapInArrow(tally, "id bigint, df bigint, pos bigint").groupBy("id").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    rate = F.col("pos") / F.col("df")
    telling = tallied.where(F.col("id").isin(words.tolist()) | ((F.col("df") >= 2) & (rate >= min(0.5, 2 * toxic / size)))).orderBy(F.desc(F.col("pos") * rate), "id").limit(max_features)
    names = np.unique([r["id"] for r in telling.select("id").collect()]).astype(np.int64)
    spread = documents.sparkSession.sparkContext.broadcast(names)  # at most max_features

    @released
    def emit(batches):
        for batch in slices(batches, "text"):
            rows, ids = features(texts_of(batch), spread.value)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["toxic", "ids"])

    got = texts.mapInArrow(emit, "toxic boolean, ids binary").toPandas()
    y = got["toxic"].to_numpy().astype(float)
    ids = [np.frombuffer(x, np.int64) for x in got["ids"]]
    rows, index = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids)
    x = Sparse(rows, index, np.ones(len(rows)), len(y), len(names))
    chosen = choose_voters(x, y, np.flatnonzero(np.isin(names, words)), voters)
    if not len(chosen):
        return fit_classifier(x, names, y)
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    part = place[index] >= 0
    votes = np.zeros((len(y), len(chosen)))
    votes[rows[part], place[index[part]]] = 1
    return fit_classifier(x, names, fit_label_model(votes, y).posterior(votes))


def score(documents: DataFrame, model: Classifier) -> DataFrame:
    """``documents`` with ``score`` (0 to 1); other columns stay, a column of that name is replaced."""
    kept = documents.drop("score")
    schema = kept.select("*", F.lit(0.0).alias("score")).schema
    spread = documents.sparkSession.sparkContext.broadcast(model)  # at most 4,096 weights

    @released
    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spread.value.score(texts_of(batch)))], [*batch.schema.names, "score"])

    return kept.mapInArrow(run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(documents, labels, **settings)
    return score(documents.select("doc_id", F.col("text").cast("string").alias("text")), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents scored below one half, with their own columns."""
    model = fit(documents, labels, **settings)
    scored = score(documents.withColumnRenamed("score", "__score") if "score" in documents.columns else documents, model)
    out = scored.where(F.col("score") < 0.5).drop("score")
    return out.withColumnRenamed("__score", "score") if "__score" in out.columns else out
