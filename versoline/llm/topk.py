"""Exact top-k inner products by pivot-table elimination.

Components become ``floor(256 x)``.  Distances of every vector to ``pivots`` pivots (spread out by farthest-first choice on a
bounded sample) are computed once and stored with its block.  By the triangle inequality ``|d(q, p) - d(c, p)|`` is a lower
bound of the distance of query and candidate for every pivot ``p``; the greatest gives an upper bound of the score, as
``2 q.c = |q|^2 + |c|^2 - d(q, c)^2``.  Within a block, candidates are evaluated in the order of that bound until the k-th score
is above all bounds that are left; what is eliminated can't be an answer, so the result is exact, ties included.

Queries meet all vectors block by block: blocks of at most ``block`` vectors, groups of at most ``group`` queries; a candidate
block is copied once per group of queries.  The best ``k`` per query and block are merged at the end.

Vectors null or with null or non-finite components, and rows without id, take no part.  Vectors of different length are not
compared.  Equal rows count once; a candidate of the query's own id is never returned.  Scores beyond 64 bits wrap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versoline.llm.shared import stage


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, v, dim of the rows that take part."""
    whole = embeddings.where("vec_id is not null and embedding is not null").where(
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))")
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return whole.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of a sample."""
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(v - p, axis=1) for p in pivots], 1)


def best(q_ids, q, q_far, c_ids, c, c_far, k: int) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of the ``k`` best candidates of each query in a block."""
    out = []
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, c.shape[1]) < 2**53
    cf = c.astype(float)
    c_norm = (cf**2).sum(1)
    for qid, qv, far in zip(q_ids, q, q_far):
        low = np.abs(c_far - far).max(1)
        high = ((qv.astype(float) ** 2).sum() + c_norm - low**2) / 2
        high += np.abs(high) * 1e-9 + 1
        high[c_ids == qid] = -np.inf
        order = np.argsort(-high, kind="stable")
        order = order[np.isfinite(high[order])]
        scores, ids, at, floor, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, -np.inf, 64
        while at < len(order) and high[order[at]] >= floor:
            part = order[at : at + size]
            got = (cf[part] @ qv.astype(float)).astype(np.int64) if exact else (c[part] * qv).sum(1)
            scores, ids = np.concatenate([scores, got]), np.concatenate([ids, c_ids[part]])
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
            floor = scores[-1] if len(scores) == k else -np.inf
            at, size = at + size, size * 2
        out += [(int(qid), int(i), int(s)) for i, s in zip(ids, scores)]
    return out


def search(embeddings: DataFrame, every: int = 50, k: int = 5, pivots: int = 32, sample: int = 2048, block: int = 4096, group: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score.  Queries are the rows whose id is divisible by ``every``."""
    vectors = stage(integers(embeddings))
    # pivots of each length that occurs among the sampled rows; other lengths have one pivot at the origin
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "v").collect()
    of_length: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in drawn}:
        of_this = [r["v"] for r in drawn if r["dim"] == dim]
        of_length[dim] = spread_out(np.array(of_this, float).reshape(len(of_this), dim), pivots)
    table = vectors.sparkSession.sparkContext.broadcast(of_length)  # at most ``sample`` vectors

    def pack(size):
        def run(batches):
            number, kinds = 0, [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            for batch in batches:
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    for at in range(0, len(rows), size):
                        part = batch.take(pa.array(rows[at : at + size]))
                        ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                        v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                        far = to_pivots(v.astype(float), table.value.get(dim, np.zeros((1, dim))))
                        number += 1
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((dim, ids.tobytes(), v.tobytes(), far.tobytes()), kinds)], ["dim", "ids", "v", "far"])

        return run

    packed = "dim int, ids binary, v binary, far binary"
    asked = vectors.where(F.col("vec_id") % every == 0)
    n_groups = max(1, -(-asked.count() // group))
    queries = asked.repartition(n_groups).mapInArrow(pack(group), packed)
    queries = stage(queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("ids", "v", "far")), F.monotonically_increasing_id().alias("g")))
    groups = queries.groupBy("dim").agg(F.collect_list("g").alias("gs"))  # one number per group of queries
    blocks = vectors.mapInArrow(pack(block), packed).join(groups, "dim").select("dim", "ids", "v", "far", F.explode("gs").alias("g"))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                def vectors_of(p):
                    ids = np.frombuffer(r[p + "ids"], np.int64)
                    return ids, np.frombuffer(r[p + "v"], np.int64).reshape(len(ids), r["dim"]), np.frombuffer(r[p + "far"], float).reshape(len(ids), -1)

                rows += best(*vectors_of("q_"), *vectors_of(""), k)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    spread = blocks.withColumn("salt", F.xxhash64("ids")).repartition("g", "salt")
    found = spread.join(queries.drop("dim"), "g").drop("salt").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
