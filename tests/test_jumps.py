"""Ways through a group found by doubled jumps, and what is built on them, against walking row by row."""

import random

from versoline.operators import anchors as A
from versoline.operators import primitives as P
from versoline.streaming import positions as S


def test_way_of_doubled_jumps(spark):
    rng = random.Random(1)
    nodes = {(k, i): i + rng.randint(1, 5) for k in range(3) for i in range(60 + k)}
    nodes = {n: to if (n[0], to) in nodes else None for n, to in nodes.items()}
    df = spark.createDataFrame([(k, i, to) for (k, i), to in nodes.items()], "k int, i int, to int")
    want = set()
    for k in range(3):
        at = 0
        while at is not None:
            want.add((k, at))
            at = nodes[k, at]
    assert {tuple(r) for r in P.on_path(df, ["k"], "i", "to").collect()} == want
    assert P.on_path(df.filter("k > 9"), ["k"], "i", "to").count() == 0


def sent(events, every):
    out, last, waiting = [], None, None
    for at, _, value, now in sorted(events):
        if waiting is not None and at >= last + every:
            out.append((last + every, waiting))
            last, waiting = last + every, None
        if now or last is None or at >= last + every:
            out.append((at, value))
            last, waiting = at, None
        else:
            waiting = value
    if waiting is not None:
        out.append((last + every, waiting))
    return sorted(out)


def test_exact_throttle_of_a_table(spark):
    rng = random.Random(3)
    groups = {}
    for k in range(24):
        at, rows = 0, []
        for seq in range(120):
            at += rng.choice([0, 1, 5, 9, 10, 11, 15, 19, 20, 25]) if k % 3 else rng.choice([12, 15, 18])  # every third: no sure event for long
            rows.append((at, seq, float(seq), k % 3 == 1 and rng.random() < 0.1))
        groups[k] = rows
    df = spark.createDataFrame([(k, "audio", seq, at, value, now) for k, rows in groups.items() for at, seq, value, now in rows],
                               "book_id bigint, medium string, seq bigint, at_ms bigint, value double, now boolean")
    got = {}
    for r in S.throttled_exactly(df, 10).collect():
        got.setdefault(r["book_id"], []).append((r["at_ms"], r["value"]))
    assert all(sorted(got[k]) == sent(rows, 10) for k, rows in groups.items())


def test_greedy_run_with_ties_everywhere(spark):
    rng = random.Random(7)
    groups = {k: [(rng.randint(0, 30 if k % 2 else 300) * 60_000, rng.randint(0, 200) + (400 if rng.random() < 0.01 else 0)) for _ in range(150)] for k in range(6)}
    df = spark.createDataFrame([(k, 0, *p, 1.0) for k, points in groups.items() for p in points], "book_id int, chapter_idx int, audio_ms bigint, char_offset int, confidence double")
    got = {}
    for r in A.monotone(df).collect():
        got.setdefault(r["book_id"], []).append((r["audio_ms"], r["char_offset"]))
    for k, points in groups.items():
        kept = []
        for p in sorted(points):
            if not kept or (p[0] > kept[-1][0] and p[1] > kept[-1][1]):
                kept.append(p)
        assert sorted(got[k]) == kept


def test_jumps_are_doubled_between_sure_events_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(P, "on_path", lambda nodes, keys, at, to, own=P.on_path: asked.append(nodes.count()) or own(nodes, keys, at, to))
    groups = {1: [(25 * k, k, float(k), False) for k in range(200)],  # all sure
              2: [(25 * k + (4 if k % 9 == 8 else 0) - (11 if k % 9 == 5 else 0), k, float(k), None if k % 7 else True) for k in range(60)]}
    df = spark.createDataFrame([(b, "audio", seq, at, value, now) for b, rows in groups.items() for at, seq, value, now in rows],
                               "book_id bigint, medium string, seq bigint, at_ms bigint, value double, now boolean")
    got = {}
    for r in S.throttled_exactly(df, 10).collect():
        got.setdefault(r["book_id"], []).append((r["at_ms"], r["value"]))
    assert all(sorted(got[k]) == sent(rows, 10) for k, rows in groups.items())
    assert sum(asked) < 30  # the first group has none in doubt, the second few
