"""Classifiers on held-out rows, search against brute force, and the pipeline."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA, make
from versoline.llm import quality, topk, toxicity
from versoline.llm.queries import QUERIES, ORACLES

DATA = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.97 and out["score"].between(0, 1).all()


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(float)
    fire = lambda hit, miss: (rng.random(4000) < np.where(y > 0, hit, miss)).astype(float)
    good = [fire(0.6, 0.01) for _ in range(4)]
    votes = np.stack([*good, good[0], fire(0.3, 0.3)], 1)  # one voter twice, one that knows nothing
    model = toxicity.fit_label_model(votes, y)
    assert model.groups[0] == model.groups[4] and len(set(model.groups)) == 5
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.95


def test_toxicity_edges(spark, edge_rows):
    docs = make(spark, edge_rows).withColumnRenamed("source", "score")
    none = spark.createDataFrame([(None, 1, 1), (4, 1, None)], "doc_id bigint, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    kept = toxicity.keep_clean(docs, none)
    assert kept.count() == len(edge_rows) and set(kept.columns) == set(docs.columns)


def test_ordered_thresholds(spark, prose):
    rows = [(k, prose(12) + " fine" * (k % 4)) for k in range(400)]
    ratings = spark.createDataFrame([(k, k % 4, 0) for k in range(300)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.score(make(spark, rows), quality.fit(make(spark, rows), ratings)).collect()}
    mean = [np.mean([out[k]["expected_grade"] for k in range(300, 400) if k % 4 == g]) for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 1.5
    assert all((out[k]["tail_probability"] >= 0.5) == (k % 4 >= 2) for k in range(300, 400) if k % 4 in (0, 3))


def test_quality_edges(spark, edge_rows):
    docs = make(spark, edge_rows).withColumnRenamed("source", "tail_probability")
    one = spark.createDataFrame([(6, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    kept = quality.keep_good(docs, one)
    assert kept.count() == len(edge_rows) and set(kept.columns) == set(docs.columns)


@pytest.mark.parametrize("operator", [toxicity.toxicity, toxicity.keep_clean, quality.quality, quality.keep_good])
def test_empty_tables(spark, operator):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert operator(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(10)] + [(None, rows[1][1]), (400, None), (401, [None] * 8), (402, [math.nan] * 8), (403, [math.inf] + [0.0] * 7),
             (450, []), (500, [1.0, 2.0]), (501, [3.0, -1.0]), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.search(table, block=64, group=2).collect()
    whole = {(i, tuple(v)) for i, v in [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]}
    want = set()
    for q, qv in whole:
        if q % 50 == 0:
            near = sorted({(-sum(a * b for a, b in zip(qv, cv)), c) for c, cv in whole if c != q and len(cv) == len(qv)})[:5]
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(near)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.search(table.limit(0)).count() == 0


def test_top_k_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = QUERIES["op6_exact_top_k"](spark, DATA).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["op6_exact_top_k"]).fetchall())


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, held, DATA).cache()
        assert sorted(out.columns) == sorted(docs.columns), name
        assert out.join(held, "doc_id", "left_anti").count() == 0 and out.count() <= held.count()
        held = out
    rated = held.join(labels, "doc_id")
    assert rated.where("quality = 0").count() == 0 and rated.where("toxic = 1").count() <= 0.3 * labels.where("toxic = 1").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, held, DATA)
    assert packed.select(F.countDistinct("doc_id")).first()[0] == held.count()
