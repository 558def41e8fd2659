import random

import pytest
from pyspark.sql import functions as F

from versoline.operators import anchors as A
from versoline.operators import maps as M

ANCHORS = "book_id bigint, chapter_idx int, audio_ms bigint, char_offset int, confidence double"


def chapter(spark, points, book=1, idx=0):
    return spark.createDataFrame([(book, idx, t, c, float(w)) for t, c, w in points], ANCHORS)


def lookups(spark, values, col, kind="int"):
    return spark.createDataFrame([(1, 0, v) for v in values], f"book_id bigint, chapter_idx int, {col} {kind}")


def heaviest_by_squares(points):
    """Every predecessor tried for every anchor."""
    rows = sorted(points)
    best, came = [r[2] for r in rows], [-1] * len(rows)
    end = 0
    for i, (t, c, w) in enumerate(rows):
        for j in range(i):
            if rows[j][0] < t and rows[j][1] < c and best[j] + w > best[i]:
                best[i], came[i] = best[j] + w, j
        if best[i] > best[end]:
            end = i
    out = []
    while end >= 0:
        out.append(rows[end])
        end = came[end]
    return sorted(out)


@pytest.mark.parametrize("points, offset, ms", [
    ([(0, 0, 1), (5000, 500, 1), (10000, 1000, 1)], 250, 2500),
    ([(0, 0, 1), (5000, 500, 1), (10000, 1000, 1)], 750, 7500),
    ([(0, 0, 1), (10000, 500, 1), (20000, 2000, 1)], 1250, 15000),
    ([(1000, 100, 1), (2000, 200, 1)], -50, 1000),
    ([(1000, 100, 1), (2000, 200, 1)], 99999, 2000),
    ([(1000, 100, 1)], 500, 1000),
])
def test_offset_to_time(spark, points, offset, ms):
    got = M.char_to_ms(lookups(spark, [offset], "at_char"), chapter(spark, points)).collect()
    assert [r.audio_ms for r in got] == [ms]


def test_round_trip_within_one(spark):
    m = chapter(spark, [(0, 0, 1), (30000, 2800, 1), (65000, 6100, 1), (120000, 11500, 1)])
    there = M.char_to_ms(lookups(spark, list(range(0, 11500, 371)), "at_char"), m)
    back = M.ms_to_char(there, m, "audio_ms", "back").collect()
    assert all(abs(r.back - r.at_char) <= 1 for r in back)


def test_outlier_is_dropped_and_confidence_wins(spark):
    out = A.consistent_run(chapter(spark, [(1000, 100, .9), (2000, 200, .9), (3000, 50, .9), (4000, 400, .9)])).collect()
    assert sorted(r.char_offset for r in out) == [100, 200, 400]
    out = A.consistent_run(chapter(spark, [(0, 5000, .2), (9000, 6000, .2), (3000, 100, .95), (6000, 400, .95)])).collect()
    assert {100, 400} <= {r.char_offset for r in out} and 5000 not in {r.char_offset for r in out}


@pytest.mark.parametrize("seed", range(4))
def test_consistent_run_equals_trying_everything(spark, seed):
    rng = random.Random(seed)
    books, want = [], {}
    for book in range(12):
        n = rng.randint(1, 60)
        points = list({(rng.randint(0, 80) * 1000, rng.randint(0, 60) * 10): rng.choice([0.0, .25, .5, .75, 1.0]) for _ in range(n)}.items())
        points = [(t, c, w) for (t, c), w in points] if seed else [(t, t // 100 + rng.randint(-90, 90), w) for (t, _), w in points]
        points = list({(t, c): (t, c, w) for t, c, w in points}.values())
        want[book] = heaviest_by_squares(points)
        books += [(book, 0, t, c, w) for t, c, w in points]
    got = {}
    for r in A.consistent_run(spark.createDataFrame(books, ANCHORS)).collect():
        got.setdefault(r.book_id, []).append((r.audio_ms, r.char_offset, r.confidence))
    assert {b: sorted(v) for b, v in got.items()} == want


def test_longest_chain_is_longest_and_rising(spark):
    rng = random.Random(3)
    rows = []
    for pair in range(8):
        ys = list(range(40))
        rng.shuffle(ys) if pair % 2 else ys.sort(key=lambda v: v + rng.random() * 6)
        rows += [(pair, x, y) for x, y in enumerate(ys)]
    got = A.longest_chain(spark.createDataFrame(rows, "pair int, x int, y int"), ["pair"], "x", "y", 16).collect()
    for pair in range(8):
        ys = [y for p, x, y in rows if p == pair]
        length = [1] * len(ys)
        for i in range(len(ys)):
            length[i] += max((length[j] for j in range(i) if ys[j] < ys[i]), default=0)
        kept = sorted((r.x, r.y) for r in got if r.pair == pair)
        assert len(kept) == max(length)
        assert all(a[1] < b[1] for a, b in zip(kept, kept[1:]))


def test_monotone_with_tied_times(spark):
    points = [(0, 5, 1), (0, 3, 1), (10, 4, 1), (10, 9, 1), (20, 8, 1), (20, 12, 1), (30, 10, 1)]
    got = A.monotone(chapter(spark, points)).collect()
    assert sorted((r.audio_ms, r.char_offset) for r in got) == [(0, 3), (10, 4), (20, 8), (30, 10)]


def test_heard_time(spark):
    close = [(t, t // 10, .9) for t in (0, 10000, 20000)]
    far = [(t, t // 10, .9) for t in (0, 60000, 120000)]
    guesses = [(0, 0, .2), (10000, 900, .2)]
    assert [r.measured_ms for r in M.measured_ms(chapter(spark, close), 15000).collect()] == [20000]
    assert [r.measured_ms for r in M.measured_ms(chapter(spark, far), 15000).collect()] == [0]
    assert M.measured_ms(chapter(spark, guesses), 15000).count() == 0


def opening(spark, marks, pace=15):
    """1200 characters read normally to 50 s, the next opening squeezed into two seconds, then a pause."""
    points = [(i * 5000, i * 120, 1.0) for i in range(10)]
    points += [(48000 + i * 400, 1200 + i * 100, 1.0) for i in range(5)] if pace > 40 else [(50000 + i * 6000, 1200 + i * 100, 1.0) for i in range(5)]
    points += [(85000 + i * 7000, 1700 + i * 100, 1.0) for i in range(5)]
    a = spark.createDataFrame([(1, t, c, w) for t, c, w in points], "book_id bigint, audio_ms bigint, char_offset int, confidence double")
    starts = spark.createDataFrame([(1, 1200)], "book_id bigint, start int")
    m = spark.createDataFrame([(1, x) for x in marks], "book_id bigint, mark_ms bigint")
    return a, A.repair_openings(a, starts, m)


def test_squeezed_opening_is_put_back(spark):
    a, fixed = opening(spark, [55000], pace=50)
    got = {r.char_offset: r.audio_ms for r in fixed.collect()}
    assert got[1200] == 55000 and 1300 not in got and got[1700] == 85000
    _, fixed = opening(spark, [], pace=50)
    got = {r.char_offset: r.audio_ms for r in fixed.collect()}
    assert got[1200] == 85000 - 33333
    a, fixed = opening(spark, [55000], pace=15)
    assert sorted(fixed.select("audio_ms", "char_offset").collect()) == sorted(a.select("audio_ms", "char_offset").collect())


def test_close_starts_are_solved_in_order(spark):
    rng = random.Random(1)
    points = sorted({rng.randint(0, 12000) for _ in range(150)})
    t, rows = 0, []
    for c in points:
        t += rng.choice([5, 40, 400, 9000, 16000])
        rows.append((1, t, c, 1.0))
    starts = [300, 1500, 2600, 4000, 9000, 9400]
    a = spark.createDataFrame(rows, "book_id bigint, audio_ms bigint, char_offset int, confidence double")
    marks = [100000, 400000, 700000]
    got = A.repair_openings(a, spark.createDataFrame([(1, s) for s in starts], "book_id bigint, start int"),
                            spark.createDataFrame([(1, m) for m in marks], "book_id bigint, mark_ms bigint")).collect()
    places = {c: t for _, t, c, _ in rows}
    for s in starts:
        tail = sorted(c for c in places if c >= s)
        ends = [(a, b) for a, b in zip(tail, tail[1:]) if b <= s + 3000 and places[b] > places[a] + 15000]
        if not ends or ends[0][0] < s + 100 or (ends[0][0] - s) * 1000 < 40 * max(places[ends[0][0]] - places[tail[0]], 1):
            continue
        low = places[max(c for c in places if c < s)] if any(c < s for c in places) else 0
        high = places[ends[0][1]]
        begin = high - int((ends[0][1] - s) / 15 * 1000)
        own = sorted((abs(m - begin), m) for m in marks if low < m < high and abs(m - begin) < 30000)
        places = {c: t for c, t in places.items() if not s <= c <= ends[0][0]} | {s: max(min(own[0][1] if own else begin, high - 1), low + 1)}
    assert sorted((r.char_offset, r.audio_ms) for r in got) == sorted(places.items())
    assert len(places) < len(rows)


def test_outvoted_chapter_is_rebuilt(spark):
    stored = chapter(spark, [(0, 9000, .5), (60000, 9900, .5)])
    refused = chapter(spark, [(10000, 150, .9), (20000, 300, .9), (30000, 450, .9)])
    none = stored.limit(0)
    got = A.merge_disagreement(stored, none, refused).collect()
    assert sorted(r.char_offset for r in got) == [150, 300, 450, 9900]
    assert A.merge_disagreement(stored, none, refused.limit(1)).count() == 2


def test_reading_rate_is_smoothed_in_order(spark):
    points = [(0, 0, 1), (1000, 20, 1), (3000, 30, 1), (4000, 500, 1), (5000, 480, 1), (9000, 600, 1)]
    chapters = spark.createDataFrame([(1, 0, 0, 10000, 0, 200)], "book_id bigint, chapter_idx int, start_ms bigint, end_ms bigint, text_start int, text_end int")
    rate, last = 0.02, points[0]
    for p in points[1:]:
        seen = (p[1] - last[1]) / (p[0] - last[0])
        if seen > 0:
            rate = rate * .5 + min(max(seen, .02 / 5), .02 * 5) * .5
        last = p
    assert A.rate_ema(chapter(spark, points), chapters).first().rate == pytest.approx(rate)


def test_chapter_ends_round_at_every_step(spark):
    c = spark.createDataFrame([(1, i, i * 1000, i * 1000 + ms) for i, ms in enumerate([700, 0, 333, 1000])], "book_id bigint, chapter_idx int, start_ms bigint, end_ms bigint")
    b = spark.createDataFrame([(1, 1001)], "book_id bigint, text_length int")
    got = [(r.text_start, r.text_end) for r in A.est_chapter_end(c, b).orderBy("chapter_idx").collect()]
    first = round(1001 * 700 / 2033)
    assert got[0] == (0, first) and got[1] == (first, 1001) and got[3][1] == 1001
