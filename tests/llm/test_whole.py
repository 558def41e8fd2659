"""Cases in which the operators once did less than the whole job."""

import collections
import inspect
import math
import re
import textwrap

import numpy as np

from conftest import make
from versoline.llm import licences, near_dups, perplexity


def test_junk_of_a_third_leaves_the_band(spark, prose):
    rng = np.random.default_rng(1)
    noise = lambda: " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 9)) for _ in range(40))
    rows = [*((k, prose(60)) for k in range(100)), *((500 + k, noise()) for k in range(50)), *((900 + k, "too short") for k in range(80))]
    got = {r["doc_id"]: r["kept"] for r in perplexity.perplexity(make(spark, rows)).collect()}
    assert all(got[k] for k in range(100)) and not any(got[500 + k] for k in range(50))


def test_order_of_words_counts(spark):
    usual = ["ab", "cd", "ef", "gh"] * 10
    rows = [*((k, " ".join(usual)) for k in range(30)), (100, " ".join(sorted(usual, reverse=True)))]
    got = {r["doc_id"]: r["perplexity"] for r in perplexity.perplexity(make(spark, rows)).collect()}
    assert got[100] > 1.1 * got[0]


def test_every_ngram_is_kept(spark, prose):
    texts = [prose(50) for _ in range(20)]
    own = perplexity.sliced(make(spark, list(enumerate(texts))))
    model = perplexity.train(own)
    grams = collections.Counter()
    for t in texts:
        marked = "\x01" * 3 + t + "\x02"
        grams.update({(o, marked[k - o + 1 : k + 1]): 1 for o in range(1, 5) for k in range(3, len(marked))})
    assert {r["o"]: r["count"] for r in model.terms.groupBy("o").count().collect()} == collections.Counter(o for o, _ in grams)
    assert "max_entries" not in inspect.signature(perplexity.train).parameters
    # what may follow any three characters sums to one, the unknown character included
    lang = perplexity.hash_words(["en"])
    alphabet = sorted(set("".join(texts))) + ["￾"]
    for context in (texts[0][:3], texts[0][4:9], "���"):
        p, owner = model.probabilities([context + c for c in alphabet], np.repeat(lang, len(alphabet)))
        end, _ = model.probabilities([context], lang)
        assert abs(sum(p[owner == k][len(context)] for k in range(len(alphabet))) + end[-1] - 1) < 1e-9
    # scores by the join are those of the lookup
    logs, size = model.log_probability(texts, np.repeat(lang, len(texts)))
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.score(own, model).collect()}
    assert all(abs(got[k] + logs[k] / size[k]) < 1e-9 for k in range(len(texts)))


def test_sweep_loses_few_links(spark):
    cut = near_dups.sweep_cut(0.8, 192)
    least = next(m for m in range(193) if (m / 192 - 1 / 256) * 256 / 255 >= cut)
    same = 0.8 + 0.2 / 256  # two coordinates that differ may have equal bytes
    lost = sum(math.comb(192, m) * same**m * (1 - same) ** (192 - m) for m in range(least))
    assert lost < 2e-4
    # a pair that agrees in so many coordinates, one band among them, is compared
    a, b = np.zeros(192, np.uint8), np.zeros(192, np.uint8)
    b[least:] = 1
    shared = spark.createDataFrame([(7, 0, b"a"), (7, 0, b"b")], "bucket bigint, band int, node binary")
    labels = spark.createDataFrame([], "node binary, component binary")
    signs = spark.createDataFrame([(b"a", a.tobytes()), (b"b", b.tobytes())], "node binary, sign binary")
    assert least < 138 and near_dups.loose_pairs(shared, labels, signs, cut, 32, 6, None).count() == 1


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def test_wrapped_licences(spark):
    comment = lambda text, mark: "\n".join(f"{mark} {line}" for line in text.split("\n"))
    rows, wanted = [], {}
    for text, licence in ((MIT, "MIT"), (GPL, "GPL-3.0-or-later"), (" ".join(GPL.split()), "GPL-3.0-or-later"), (GPL.replace(": you", "; you"), "GPL-3.0-or-later")):
        for version in (text, comment(text, "#"), comment(text, " *"), text.replace("\n", "\r\n")):
            rows.append((len(rows), version))
            wanted[len(rows) - 1] = licence
    for licence, parts in licences.RULES:
        whole = [licences.SENTENCES[p][0] for p in parts]
        for width in (24, 70):
            rows.append((len(rows), "\n".join(textwrap.fill(f"{k}. {s}.", width) for k, s in enumerate(whole, 1))))
            wanted[len(rows) - 1] = licence
    rows.append((len(rows), "licensed under\n\nthe mit license version"))
    wanted[len(rows) - 1] = ""
    got = {r["doc_id"]: (r["licences"], r["matched"]) for r in licences.scan(make(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == wanted and all(got[k][1] == wanted[k] for k in wanted)


def test_texts_meet_their_ngrams_without_a_shuffle(spark, prose, capsys):
    rows = [(k, prose(40)) for k in range(60)] + [(100, "\x01a\x02 \x01\x02 b"), (101, None), (102, "\U0001f600 x")]
    own = perplexity.sliced(make(spark, rows))
    model = perplexity.train(own)
    scored = perplexity.score(own, model)
    scored.explain()
    assert len(re.findall(r"Exchange hashpartitioning\(slice#", capsys.readouterr().out)) == 1  # of the answers, not of the texts
    got = {r["doc_id"]: r["log_perplexity"] for r in scored.collect()}
    texts = [t for _, t in rows if t]
    logs, size = model.log_probability(texts, np.repeat(perplexity.hash_words(["en"]), len(texts)))
    assert got.pop(101) is None and np.allclose([got[k] for k, t in rows if t], -logs / size, rtol=0, atol=1e-9)


def test_ngrams_of_lower_orders_are_counted_from_the_highest(spark):
    texts = ["\x01a\x02b ab", "ab ab", "a", "\U0001f600b ab"]
    plain, before = collections.Counter(), collections.defaultdict(set)
    for t in texts:
        marked = "\t" * 3 + t + "\n"
        for k in range(3, len(marked)):
            for o in range(1, 5):
                plain[marked[k - o + 1 : k + 1]] += 1
                before[marked[k - o + 1 : k + 1]].add(marked[k - o : k - o + 1])
    wanted = collections.Counter((len(g), n if len(g) == 4 or len(g) > 1 and g[0] == "\t" else len(before[g])) for g, n in plain.items())
    counted = perplexity.count(make(spark, list(enumerate(texts))), 4).collect()
    assert collections.Counter((r["o"], r["a"]) for r in counted) == wanted and len({(r["o"], r["key"]) for r in counted}) == len(plain)
