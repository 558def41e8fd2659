"""Near-duplicates and repeated passages against brute force."""

import collections
import hashlib

import numpy as np
import pytest

from conftest import SCHEMA, make
from versoline.llm import near_dups, suffixes


def weighted(t):
    w = (t or "").split()
    return collections.Counter(zip(*(w[k:] for k in range(min(5, len(w)))))) if w else collections.Counter()


def classes(rows, threshold=0.8):
    sets = [weighted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both, all_ = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if all_ and both / all_ >= threshold and sets[a] and sets[b]:
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    out = collections.Counter()
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[(rows[k][0], min(ids) if ids else None)] += 1
    return out


@pytest.fixture(scope="module")
def family(prose):
    """A large group of near copies, most but not all close to its middle, among other texts."""
    rng = np.random.default_rng(2)
    base = prose(120).split()
    rows = []
    for k in range(150):
        w = list(base)
        for p in rng.choice(len(w), rng.integers(0, 7), replace=False):
            w[p] = f"x{rng.integers(1000)}"
        rows.append((1000 + k, " ".join(w)))
    return rows


def test_classes(spark, edge_rows, family, prose):
    rows = [*edge_rows, *family, *((3000 + k, prose(40)) for k in range(50))]
    got = near_dups.near_duplicates(make(spark, rows))
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got.collect()) == classes(rows)


def test_one_stays(spark, edge_rows, family):
    kept = near_dups.keep_one(make(spark, [*edge_rows, *family]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert [ids[k] for k in (1, 2, 3, 4, 5, 8)] == [1, 1, 1, 1, 0, 0] and ids[6] == 1 and ids[7] == 1


def test_columns_of_any_name(spark, family):
    docs = make(spark, family[:20])
    for name in ("__node", "node", "mark_0", "LEAST_0", "digest_0"):
        docs = docs.withColumn(name, docs["lang"])
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("mark_0 = 'en'").count() == kept.count() > 0


def test_elements_give_the_similarity_of_counts(prose):
    a = prose(60)
    texts = [t.encode() for t in (a, a + " " + a, prose(20) + " " + a, "one two", "one two one two one two one two one two", "", "é " * 30)]
    sets = near_dups.elements(texts)
    for x, s in zip(texts, sets):
        for y, t in zip(texts, sets):
            both = len(np.intersect1d(s, t))
            assert abs(both / max(1, len(s) + len(t) - both) - near_dups.similarity(x, y)) < 1e-12


@pytest.mark.parametrize("block_bytes", [2_000, 8_000_000])
def test_links_inside_blocks_join_what_all_pairs_join(spark, prose, block_bytes):
    """One bucket, no links yet: the forest's components are those of all pairs."""
    rng = np.random.default_rng(6)
    base = prose(80).split()
    texts = {}
    for k in range(60):
        w = list(base)
        for p in rng.choice(len(w), rng.integers(0, 9), replace=False):
            w[p] = f"y{rng.integers(1000)}"
        texts[b"%03d" % k] = " ".join(w).encode()
    signs = spark.createDataFrame([(n, bytes(192), len(t)) for n, t in texts.items()], "node binary, sign binary, size bigint")
    shared = spark.createDataFrame([(7, 0, n) for n in texts], "bucket bigint, band int, node binary")
    table = spark.createDataFrame(list(texts.items()), "node binary, text binary")
    labels = spark.createDataFrame([], "node binary, component binary")
    links = near_dups.loose_links(shared, labels, signs, table, 0.8, 0.6, 32, 6, block_bytes)
    rows = links.collect()
    assert all(near_dups.similarity(texts[bytes(r["a"])], texts[bytes(r["b"])]) >= 0.8 for r in rows)
    assert len(rows) < len(texts) or block_bytes < 8_000_000
    got = {bytes(r["node"]): bytes(r["component"]) for r in near_dups.components(links).collect()}
    want = classes([(int(n), t.decode()) for n, t in texts.items()])
    assert collections.Counter((int(n), int(got.get(n, n))) for n in texts) == want


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.uniform(0.1, 3, 300), rng.uniform(0.1, 3, 300)
    docs = np.repeat([0, 1], 300)
    sign = near_dups.signatures(docs, np.concatenate([elements, elements]), np.concatenate([a, b]), 2, 2000)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def removed(rows, length=50):
    out = []
    for i, t in rows:
        data = (t or "").encode()
        earlier = {u[k : k + length] for j, s in rows if i is not None and j is not None and j < i for u in [(s or "").encode()] for k in range(len(u) - length + 1)}
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            if data[k : k + length] in earlier:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("block_mb", [0.002, 4])
def test_repeats(spark, prose, block_mb):
    shared, other = prose(12), prose(15)
    rows = [(1, None), (2, ""), (3, shared), (4, prose(8) + shared + prose(9)), (4, shared), (5, shared[5:]), (6, shared[:60] + "!" + shared[3:]),
            (7, other + other), (8, "ab" * 200), (9, "b" + "ab" * 90), (10, other[7:70] + "é" + shared[9:]), (None, shared), (11, shared[:49]), (12, shared[:50])]
    rows += [(100 + k, prose(5) + shared + prose(5)) for k in range(60)]
    got = suffixes.repeats(make(spark, rows).withColumnRenamed("lang", "spans"), block_mb=block_mb)
    assert collections.Counter(map(tuple, got.collect())) == removed(rows)


def test_cut_texts_keep_their_columns(spark, prose):
    shared = "é" * 40 + prose(20)
    rows = [(1, shared), (2, "x" + shared[3:] + "tail"), (3, None)]
    docs = make(spark, rows).withColumnRenamed("source", "spans")
    out = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    assert out[2]["text"] == "xtail" and out[1]["text"] == shared and out[3]["text"] is None and out[2]["spans"] == "s"


def test_family_merges_equal_levels():
    family = suffixes.Family(suffixes.merge_least)
    for k in range(8):
        found = family.add(np.array([k, k + 1, 100], np.uint64), (np.full(3, k),))
        assert found.tolist() == [k > 0, False, k > 0]
    assert len(family.levels) == 1 and family.levels[0][0] == 3 and family.whole()[1][0].tolist() == [0, 0, 1, 2, 3, 4, 5, 6, 7, 0]


@pytest.mark.parametrize("operator", [near_dups.near_duplicates, near_dups.keep_one, suffixes.repeats, suffixes.remove_repeats])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
