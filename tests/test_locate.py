import random

import pytest

from versoline.functions import text as X
from versoline.operators import locate as Q


def align_whole(query, words):
    """The whole matrix, cell by cell: (score, from, last, query from, query last)."""
    best = None
    above = [(0, 0, 0)] * (len(words) + 1)
    for j, q in enumerate(query):
        row = [(0, 0, 0)]
        for i, w in enumerate(words):
            def step(cell, delta, fresh):
                return (cell[0] + delta, cell[1], cell[2]) if cell[0] > 0 else (delta, *fresh)

            cell = step(above[i], 2 if w == q else -1, (i, j))
            for other in (step(above[i + 1], -1, (i + 1, j)), step(row[i], -1, (i, j))):
                if other[0] > cell[0]:
                    cell = other
            if cell[0] <= 0:
                cell = (0, i, j)
            row.append(cell)
            if cell[0] > 0 and (best is None or cell[0] > best[0]):
                best = (cell[0], cell[1], i, cell[2], j)
        above = row
    return best


def corpus(seed, docs=12, vocabulary=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    texts = [rng.choices(words, weights, k=rng.randint(30, 260)) for _ in range(docs)]
    queries = []
    for _ in range(8):
        source = rng.choice(texts)
        a = rng.randint(0, max(len(source) - 30, 0))
        passage = source[a:a + rng.randint(8, 30)]
        noisy = []
        for w in passage:
            r = rng.random()
            if r < .12:
                continue
            noisy.append(rng.choice(words) if r < .25 else w)
            if rng.random() < .1:
                noisy.append(rng.choice(words))
        queries.append(noisy or ["w1"])
    return texts, queries


def frames(spark, texts, queries):
    return (spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(queries)], "query_id bigint, text string"),
            spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_match_equals_the_whole_matrix(spark, seed):
    texts, queries = corpus(seed)
    want = {}
    for i, q in enumerate(queries):
        for d, t in enumerate(texts):
            m = align_whole(q, t)
            if m and m[0] / (2 * len(q)) >= .45:
                want[i, d] = m
    q, d = frames(spark, texts, queries)
    got = {(r.query_id, r.doc_id): (r.score, r.tok, r.last_tok, r.q_start, r.q_end) for r in Q.match(q, d).collect()}
    assert got == want and want


def test_unambiguous_refuses_rivals(spark):
    texts, queries = corpus(7, vocabulary=400)
    queries = [q for q in queries if len(q) >= 10] + [texts[0][5:25]]
    texts[1] = texts[1] + texts[0][5:25] + ["x%d" % i for i in range(90)] + texts[0][5:25]
    want = {}
    for i, q in enumerate(queries):
        for d, t in enumerate(texts):
            m = align_whole(q, t)
            n = len(q)
            if n < 10 or not m or m[0] / (2 * n) < .6:
                continue
            sides = [align_whole(q, t[:max(m[1] - 2 * n, 0)]), align_whole(q, t[m[1] + 3 * n:])]
            rival = max([s[0] / (2 * n) for s in sides if s and s[0] / (2 * n) >= .6], default=0)
            if rival < m[0] / (2 * n) - .1:
                want[i, d] = m[1]
    q, d = frames(spark, texts, queries)
    got = {(r.query_id, r.doc_id): r.tok for r in Q.unambiguous(q, d).collect()}
    assert got == want
    assert (len(queries) - 1, 0) in got and (len(queries) - 1, 1) not in got


def test_page_ignores_junk_around_the_run(spark):
    texts, _ = corpus(11, vocabulary=500)
    run = texts[3][4:30]
    junk = ["junk%d" % i for i in range(15)]
    queries = [junk + run + junk, junk * 2, run[:8]]
    q, d = frames(spark, texts, queries)
    got = Q.page(q, d).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(0, 3)]
    text = " ".join(texts[3])
    assert text[got[0].char_offset:got[0].end_offset] == " ".join(run) and got[0].confidence == 1


def test_near_only_looks_around(spark):
    texts, _ = corpus(13, vocabulary=500)
    q, d = frames(spark, texts, [texts[0][20:32]])
    at = lambda tok: spark.createDataFrame([(0, 0, tok)], "query_id bigint, doc_id bigint, tok_idx int")
    assert Q.match_near(at(18), q, d, 5).first().tok == 20
    if len(texts[0]) > 80:
        assert Q.match_near(at(len(texts[0]) - 1), q, d, 5).count() == 0


def test_segments_cut_and_judge(spark):
    chain = [(1, f // 5 if f < 9000 else f // 5 + 4000, f) for f in range(100, 16000, 333)]
    c = spark.createDataFrame(chain, "book_id bigint, letter bigint, frame bigint")
    ends = spark.createDataFrame([(1, 9000, 17000)], "book_id bigint, letters bigint, frames bigint")
    got = Q.segments(c, ends, ["book_id"]).orderBy("from_frame").collect()
    kept = []
    for _, letter, f in chain:
        if not kept or f - kept[-1][1] >= 1000:
            kept.append((letter, f))
    assert [r.from_letter for r in got if r.kind == "inner"] == [k[0] for k in kept[:-1]]
    assert {r.verdict for r in got} == {"align", "too fast"}


def test_implausible_pairs_need_two_bad_neighbours(spark):
    chain = [(1, int(f * .3), f) for f in range(0, 3000, 200)]
    chain[7] = (1, chain[7][1] + 5000, chain[7][2])
    c = spark.createDataFrame(chain, "book_id bigint, letter bigint, frame bigint")
    got = Q.drop_implausible(c, ["book_id"]).collect()
    assert sorted(r.frame for r in got) == [f for _, _, f in chain if f != 1400]


def test_fold_table_agrees_with_unicode(spark):
    import unicodedata
    for a, b in zip(X.FOLD_FROM, X.FOLD_TO):
        assert "".join(c for c in unicodedata.normalize("NFD", a) if unicodedata.category(c) != "Mn") == b
    assert "đ" not in X.FOLD_FROM and "é" in X.FOLD_FROM
