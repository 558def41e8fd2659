import random

import pytest
from pyspark.sql import functions as F

from versoline.operators import primitives as P


def rows(seed, keys=(1, 2), span=200, n=60):
    rng = random.Random(seed)
    return [(k, p, rng.choice([None, rng.randint(0, 50)])) for k in keys for p in rng.sample(range(span), n)]


def known(values):
    return [v for v in values if v is not None]


@pytest.mark.parametrize("width", [1, 17, 1000])
def test_scan_equals_a_plain_walk(spark, width):
    df = spark.createDataFrame(rows(width), "k int, p int, v int")
    got = P.scan(df, ["k"], ["p"], P.slice_of("p", width), {
        "s": P.running_sum(F.coalesce("v", F.lit(0))), "i": P.row_index(), "mb": P.max_before(F.col("v")), "mt": P.max_to(F.col("v")),
        "ma": P.min_after(F.col("v")), "pv": P.previous(F.col("v")), "nx": P.following(F.col("v")),
        "lk": P.last_known(F.col("v")), "fa": P.next_known(F.col("v"))}).orderBy("k", "p").collect()
    for k in (1, 2):
        g = [r for r in got if r.k == k]
        vs = [r.v for r in g]
        for i, r in enumerate(g):
            assert r.s == sum(known(vs[: i + 1])) and r.i == i
            assert r.mb == max(known(vs[:i]), default=None) and r.mt == max(known(vs[: i + 1]), default=None)
            assert r.ma == min(known(vs[i + 1:]), default=None)
            assert r.pv == (vs[i - 1] if i else None) and r.nx == (vs[i + 1] if i + 1 < len(vs) else None)
            assert r.lk == (known(vs[: i + 1]) or [None])[-1] and r.fa == (known(vs[i + 1:]) or [None])[0]


@pytest.mark.parametrize("width", [3, 50])
def test_bracket_finds_both_neighbours(spark, width):
    right = spark.createDataFrame(rows(5, keys=(1,)), "k int, p int, v int")
    asked = [(1, x) for x in range(-5, 210, 3)] * 2 + [(9, 4), (1, None)]
    left = spark.createDataFrame(asked, "k int, at int")
    places = sorted(r[1] for r in rows(5, keys=(1,)))
    got = P.bracket(left, right, ["k"], "at", "p", ["v"], width).collect()
    assert len(got) == len(asked)
    for r in got:
        if r.k == 9 or r["at"] is None:
            assert r.lo is None and r.hi is None
            continue
        lo, hi = [p for p in places if p <= r["at"]], [p for p in places if p > r["at"]]
        assert (r.lo.p if r.lo else None) == (lo[-1] if lo else None)
        assert (r.hi.p if r.hi else None) == (hi[0] if hi else None)


def test_nearest_prefers_the_earlier_on_a_tie(spark):
    right = spark.createDataFrame([(1, 10), (1, 20)], "k int, p int")
    left = spark.createDataFrame([(1, x) for x in (0, 14, 15, 16, 30)], "k int, at int")
    b = P.bracket(left, right, ["k"], "at", "p", [], 4)
    got = {r["at"]: r.n.p for r in b.select("at", P.nearest("p", "at").alias("n")).collect()}
    assert got == {0: 10, 14: 10, 15: 10, 16: 20, 30: 20}


def test_fold_and_groups_survive_batch_borders(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows(3), "k int, p int, v int")

        class Count:
            def __init__(self):
                self.n = 0

            def __call__(self, pdf):
                out = pdf.assign(c=range(self.n, self.n + len(pdf)))[["k", "p", "c"]]
                self.n += len(pdf)
                return out

        folded = P.fold_in_order(df, ["k"], ["p"], Count, "k int, p int, c int").orderBy("k", "c").collect()
        assert [r.p for r in folded if r.k == 1] == sorted(r[1] for r in rows(3) if r[0] == 1)
        kept = P.keep_in_groups(df, ["k"], ["p"], lambda g: g["p"] == g["p"].max()).collect()
        assert {(r.k, r.p) for r in kept} == {(k, max(r[1] for r in rows(3) if r[0] == k)) for k in (1, 2)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_ranges_of_one_prefix_are_even(spark):
    from versoline.operators import texts as T

    n = 100_000
    names = spark.range(n).select(F.lit("one folder").alias("folder"), F.concat(F.lit("A very long beginning that all names share, Part "), F.col("id")).alias("name"))
    placed = T.natural_order(names.repartition(7), ["folder"], "name", "name")
    wrong = placed.filter(F.regexp_extract("name", "([0-9]+)$", 1).cast("bigint") != F.col("place")).count()
    assert wrong == 0 and placed.count() == n
    sizes = [r["count"] for r in P.sliced_by_rank(names, ["folder"], ["name"]).groupBy("__range").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * n / len(sizes)
