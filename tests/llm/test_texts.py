"""Encoding, ordering, packing, licences, rules: against the libraries and brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SCHEMA, make
from versoline.llm import bpe, licences, ordering, packing, perplexity
from versoline.llm.tokens import read_ranks


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.mark.parametrize("settings", [{}, {"chunk": 50, "overlap": 20}, {"chunk": 7, "overlap": 2}])
def test_encoding_equals_the_library(spark, library, edge_rows, settings):
    rows = [*edge_rows, (20, "a" * 300), (21, " " * 200 + "b"), (22, "it's  \n\n x\t y 123 " * 20), (23, " lead"), (24, "trail "), (25, "x\x1c y　 z" * 9)]
    out = bpe.round_trip(make(spark, rows), **settings).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, out)) == want


def test_permutation_and_resume(spark, library, edge_rows):
    for total in (1, 2, 3, 17, 1000):
        assert sorted(ordering.slots(np.arange(total), total, 7).tolist()) == list(range(total))
    assert ordering.slots(np.arange(1000), 1000, 7).tolist() != ordering.slots(np.arange(1000), 1000, 8).tolist()
    made = ordering.shards(make(spark, edge_rows), length=16, per_shard=64)
    shards = {r["shard"]: r for r in made.collect()}
    heads = []
    for s in sorted(shards):
        assert shards[s]["first_slot"] == 64 * s and len(shards[s]["payload"]) == shards[s]["n_records"] * ordering.stride(16, "<u2")
        heads += [(h, i) for h, i in zip(*ordering.records(shards[s]["payload"], 16, "<u2"))]
    got = collections.defaultdict(dict)
    for h, ids in heads:
        got[int(h["doc_id"])].setdefault(int(h["seq"]), []).append(ids[: h["n"]].tolist())
    assert [x for k in sorted(got[9]) for x in got[9][k][0]] == library.encode_ordinary(dict(edge_rows)[9])
    listed = ordering.listing(made, length=16).toPandas()
    assert sorted(listed["slot"]) == list(range(len(heads))) and listed["doc_id"].isna().any()


def test_shard_files(spark, edge_rows, tmp_path):
    made = ordering.shards(make(spark, edge_rows), length=16, per_shard=64).cache()
    for _ in range(2):  # writing again leaves the same files
        paths = {r["shard"]: r["path"] for r in ordering.write_shards(made, f"file://{tmp_path}/shards").collect()}
    assert all(open(paths[r["shard"]], "rb").read() == bytes(r["payload"]) for r in made.collect())


def test_packing(spark, edge_rows, prose):
    rows = [*edge_rows, *((100 + k, prose(20 + 7 * k % 90)) for k in range(120))]
    out = packing.pack(make(spark, rows), capacity=256).toPandas()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        many, start = -(-len(ids) // 256), 0
        for k in range(many):
            stop = len(ids) - (many - 1 - k) * 256
            want[(i, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
            start = stop
    assert collections.Counter((None if d != d else int(d), *map(int, r)) for d, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 256
    assert out["sequence_id"].nunique() <= 1.03 * -(-out["length"].sum() // 256) + 1


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = collections.Counter(np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048).tolist())
    ranges, n = packing.plan(counts, 2048)
    assert n <= 1.002 * -(-sum(k * v for k, v in counts.items()) // 2048) + 1
    for length, number in counts.items():
        spans = sorted((a, b) for k, a, b, _, _ in ranges if k == length)
        assert spans[0][0] == 0 and spans[-1][1] >= number and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_licences(spark):
    rows = [(1, None), (2, ""), (3, "Intro. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
            (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
            (5, "You may not use this file except in compliance with the License."), (6, "not licensed under cc by 4 0 as such")]
    docs = make(spark, rows)
    got = {r[0]: tuple(r) for r in licences.scan(docs).collect()}
    assert got[3] == (3, 2, "Apache-2.0", "Apache-2.0") and got[4] == (4, 3, "CC-BY-NC-4.0,MIT", "MIT CC-BY-NC-4.0 MIT")
    assert got[5] == (5, 1, "", "<apache-comply>") and got[1] == (1, 0, "", "") and got[6][1] == 0
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(licences.oracle()).fetchall()) == sorted(got.values())


def test_rules_and_bands(spark, edge_rows, prose):
    rng = np.random.default_rng(0)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 9)) for _ in range(40))
    rows = [*edge_rows, *((100 + k, prose(60)) for k in range(150)), (500, noise), (501, "again and again we go " * 9), (502, "a b\na b\n\n# <x> c")]
    out = perplexity.perplexity(make(spark, rows))
    got = collections.Counter(tuple(r)[:8] for r in out.select("doc_id", *perplexity.FACTS, "base_failed", "kept").collect())
    for (i, *facts, failed, kept) in got:
        texts = [t for j, t in rows if j == i]
        wanted = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            inside = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
            lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            wanted.append(([len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)], len(w) < 10 or 100 * len(inside) > 20 * len(w)))
        assert (facts, failed) in wanted
    verdict = {r["doc_id"]: r for r in out.collect()}
    assert not verdict[500]["base_failed"] and not verdict[500]["kept"] and verdict[501]["base_failed"] and all(verdict[100 + k]["kept"] for k in range(150))


def test_kneser_ney_sums_to_one(spark, edge_rows):
    model = perplexity.train(make(spark, edge_rows).withColumn("text", F.lower("text")), order=3)
    lang = np.repeat(perplexity.hash_words(["en"]), 1)
    alphabet = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    start = model.log_probability(["a"], lang)[0]
    assert np.isfinite(start).all() and start[0] < 0 and len(alphabet) == 26


@pytest.mark.parametrize("operator", [bpe.round_trip, packing.pack, perplexity.perplexity, licences.scan, lambda d: ordering.listing(ordering.shards(d))])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
