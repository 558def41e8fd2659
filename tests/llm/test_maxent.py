"""The maximum-entropy model: counts by brute force, probabilities that sum to one, gradients by differences, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import make
from pyspark.sql import functions as F

from versoline.llm import maxent as m
from versoline.llm.shared import bound_batches


def plain_version(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    counts = Counter(w for (i, _), own in zip(rows, tokens) if not held(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, _), own in zip(rows, tokens):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), n, base))
    return out


def languages(n, seed=2):
    rng = random.Random(seed)
    kinds = [[f"{p}{k}" for k in range(300)] for p in ("ka", "Lo", "mé")]
    texts = []
    for k in range(n):
        words = kinds[k % 3]
        texts.append(" ".join(words[min(int(rng.expovariate(0.03)), 299)] if rng.random() < 0.95 else f"new{rng.random()}" for _ in range(rng.randint(5, 80))) + "\n\t")
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def fitted(spark):
    rows = languages(400)
    ready, own, model = m.fit(make(bound_batches(spark), rows).repartition(3), size=4_000)
    return rows, ready, own, model


def check(got, rows):
    key = lambda r: tuple((x is None, x or 0) for x in r[:5])
    got, want = sorted(map(tuple, got), key=key), sorted(plain_version(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert sorted(round(g[5], 6) for g in got) == sorted(round(w[5], 6) for w in want)
    assert all(math.isfinite(g[6]) and g[6] <= 1e-9 for g in got)


def test_counts_and_held_out_gain(fitted):
    rows, ready, own, model = fitted
    assert ready.count() > 5
    got = m.score(ready, own, model).collect()
    check(got, rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)


def test_probabilities_sum_to_one(fitted):
    _, ready, own, model = fitted
    tables = model.tables()
    row = ready.first().asDict()
    t = m._read(row, own)[0]
    for at in t.real[[0, 1, 5, 40]]:
        at = np.array([at])
        z = m._logits(tables[0], m.histories(model, t, at))[0]
        p = np.exp(z - np.log(np.exp(z).sum()))
        total = p[own.n_head:].sum()  # classes of rarer words, the end and the unknown: their words share all of it
        for c in range(own.n_head):
            inner = m._logits(tables[1], m.own_histories(model, t, at, np.array([c])))[0]
            inner = np.exp(inner - np.log(np.exp(inner).sum()))[np.bincount(own.of_word, minlength=own.n_head)[c] - 1 :: -1]
            assert abs(inner.sum() - 1) < 1e-5
            total += p[c] * inner.sum()
        assert abs(total - 1) < 1e-5


def test_shares_of_a_class_sum_to_one(spark):
    rows = languages(60)
    ready, own, _ = m.fit(make(spark, rows).coalesce(1))
    assert ready.count() == 1  # one slice holds every word once
    r = ready.first().asDict()
    counts, groups, places = (m.unpack(r[c], k) for c, k in (("counts", np.int64), ("groups", np.uint8), ("places", np.int16)))
    cls = own.of(counts, groups, places)
    for c in range(own.n_head, own.end):
        if (cls == c).any():
            assert abs((counts[cls == c] - 0.5).sum() / own.mass[c] - 1) < 1e-9
    assert own.distinct == np.count_nonzero(counts) and own.tokens == counts.sum()
    # classes of frequent words: no two words in one place
    heads = places[(places >= 0) & (counts > 0)]
    assert len({(own.of_word[p], own.member[p]) for p in heads}) == len(heads)


def test_gradient_is_the_slope(fitted):
    _, ready, own, model = fitted
    t = m._read(ready.first().asDict(), own)[0]
    wanted = np.ones(len(t.real), bool)
    t.cls = np.where(t.seen == own.unknown, own.unknown, t.cls)
    t.member = np.where(t.cls < own.n_head, t.member, -1)
    sums = m.Sums(model)
    sums.add(t, wanted)
    first, second, due, due_second = np.split(sums.vector(), np.cumsum([model.first.size, model.second.size] * 2)[:-1])
    slope = (first - due).reshape(model.first.shape)
    inner = (second - due_second).reshape(model.second.shape)
    value = lambda: m.log_probabilities(model, model.tables(), t, np.zeros(len(t.real))).sum()
    for weights, grads in ((model.first, slope), (model.second, inner)):
        for at in np.argsort(-np.abs(grads).ravel())[[0, 3, 40]]:
            at = np.unravel_index(at, weights.shape)
            old = weights[at]
            weights[at] = old + 0.02
            up = value()
            weights[at] = old - 0.02
            down = value()
            weights[at] = old
            assert abs((up - down) / 0.04 - grads[at]) < 0.02 * max(5, abs(grads[at]))


def test_updates_raise_the_likelihood(fitted):
    _, ready, own, model = fitted
    total = lambda model: sum(r["score"] for r in m.score(ready, own, model).collect() if not r["held_out"])
    start = m.train(ready, own, rounds=0)
    assert total(start) < total(m.train(ready, own, rounds=1)) < total(model)


def test_edge_rows(spark, edge_rows):
    rows = [*edge_rows, (50, "x " * 200_000), (51, "ÀÉ ÀÉ àé"), (52, "A\x0bB\x0cC\x1cD\x85E"), (53, "Zz zZ")]
    df = make(spark, rows).withColumn("train", F.lit(3))
    check(m.scores(df).collect(), rows)


def test_nothing_to_learn_from(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:3]
    got = m.scores(make(spark, [(k, "one two") for k in held])).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 3
    assert all(abs(r["score"]) < 1e-6 for r in got)
    assert m.scores(make(spark, [])).count() == 0
    check(m.scores(make(spark, [(0, None), (1, "")])).collect(), [(0, None), (1, "")])
