"""Chains of large groups, solved block by block, against one pass over the whole group."""

import random

import numpy as np
import pytest

from versoline.operators import anchors as A
from versoline.operators import chains

SCHEMA = "book_id int, chapter_idx int, audio_ms bigint, char_offset int, confidence double"


def one_pass(points):
    points = sorted(points)
    x, y, w = (np.array(c) for c in zip(*points))
    return sorted(p for p, keep in zip(points, A._heaviest(x, y, w)) if keep)


def shapes(rng):
    """Disagreement everywhere, two competing lines, one far outlier over a chapter, many ties in both."""
    n = 240
    yield [(rng.randrange(10**6), rng.randrange(10**5), rng.randint(1, 9) / 10) for _ in range(n)]
    yield [(k * 1000 + (k % 2), k * 90 + 7_000 * (k % 2), 0.5 + 0.3 * (k % 2)) for k in range(n)]
    yield [(5, 10**6, 0.9), *((k * 1000 + 10, k * 90 + rng.randrange(400), rng.randint(1, 9) / 10) for k in range(n))]
    yield [(rng.randrange(40) * 100, rng.randrange(40), rng.choice([0.1, 0.2, 0.3])) for _ in range(n)]


@pytest.mark.parametrize("block", [30])
def test_blocks_equal_one_pass(spark, block):
    groups = {k: points for k, points in enumerate(shapes(random.Random(5)))}
    df = spark.createDataFrame([(k, 0, *p) for k, points in groups.items() for p in points], SCHEMA)
    got = {}
    for r in A.consistent_run(df, block=block).collect():
        got.setdefault(r[0], []).append(tuple(r)[2:])
    for k, points in groups.items():
        assert sorted(got[k]) == one_pass(points), k


def test_longest_chain_in_blocks(spark):
    rng = random.Random(8)
    ys = list(range(200))
    rng.shuffle(ys)
    rows = [(1, k, y) for k, y in enumerate(ys)] + [(2, k, (k * 7) % 211) for k in range(200)]
    df = spark.createDataFrame(rows, "pair_id int, r_pos int, l_pos int")
    whole = {tuple(r) for r in A.longest_chain(df, ["pair_id"], "r_pos", "l_pos").collect()}
    blocks = {tuple(r) for r in A.longest_chain(df, ["pair_id"], "r_pos", "l_pos", block=40).collect()}
    assert whole == blocks


def test_a_block_needs_staircases_only():
    rng = random.Random(2)
    points = sorted((rng.randrange(50), rng.randrange(50), float(rng.randint(1, 5)), k, k) for k in range(300))
    points = [(x, y, w, n, n) for n, (x, y, w, _, _) in enumerate(points)]
    whole, _ = chains.solve_block(points, [], [], chains.NOTHING, 0, 0)
    best = {p[4]: end[0] for p, end in zip(points, whole)}
    cut = 25
    quarters = {(i, j): [p for p in points if (p[0] >= cut) == i and (p[1] >= cut) == j] for i in (0, 1) for j in (0, 1)}
    ends = {}
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        slab = [(p[0], e) for p, e in ends.get((i, 0), [])] if j else []
        band = [(p[1], e) for p, e in ends.get((0, j), [])] if i else []
        corner = max((e for _, e in ends.get((0, 0), [])), key=lambda e: (e[0], -e[1]), default=chains.NOTHING) if i and j else chains.NOTHING
        solved, _ = chains.solve_block(quarters[i, j], slab, band, corner, i, j)
        ends[i, j] = list(zip(quarters[i, j], solved))
        assert all(e[0] == best[p[4]] for p, e in ends[i, j])
