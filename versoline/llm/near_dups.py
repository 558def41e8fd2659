"""Near-duplicates by DartMinHash signatures of weighted word shingles, banded joining and exact checking.

*Signatures.*  A document is a weighted set: its five-word shingles with their counts (a text of fewer words is one shingle of
all its words).  The weight axis of a shingle is cut into unit cells, the rank axis into dyadic cells; each (shingle, weight
cell, rank cell) holds a number of darts drawn from a Poisson law by hashing, so that every document that reaches a cell sees
the same darts.  A document of total weight ``W`` takes ranks up to ``t / W``: about ``t = k ln k + 2 k`` darts whatever its
length, and few cells per shingle when it is long.  Each dart belongs to one of ``k`` coordinates; the signature keeps the
earliest dart per coordinate.  Documents with an empty coordinate throw on up to twice the rank.  Two signatures agree in a
coordinate with probability equal to the weighted Jaccard similarity.

*Joining.*  Equal word sequences form one class first; only classes go on.  ``bands`` bands of ``rows`` coordinates each give
bucket keys.  In each bucket every class is compared with its most central one (that with the largest buckets), never all with
all; a compare is exact, on the texts.  Links of ``threshold`` or more join classes into components.  In buckets that still
hold several components, the classes outside the largest one are held against the rest by signature, in blocks of bounded
size: first each against its few most promising partners, then, for what is still loose, against all whose signature does not
rule out a link (3.8 standard deviations).  These last compares are made inside the blocks, on shingles, and only a spanning
forest of the links leaves a block.  So components come out as if all pairs had been compared, up to a chance of about
1e-4 per link of exactly 0.8 (3e-5 at 0.81) that no other link stands in for; 32 bands of 6 find a pair of similarity 0.8 with
probability 0.9999.

Null and empty texts have no shingle: each is a class of its own.  Equal ids with different texts are different documents;
equal ids with equal texts are copies.  Null ids stay null and never name a class, unless all ids of a class are null.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import U64, hash_words, mix, released, shuffle_partitions, slices, stage, texts_of, word_table

SHINGLE = 5
FIRST = -4  # the first rank cell is [0, 2 ** FIRST)
NO_WORDS = b""


def shingles(codes: np.ndarray, docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted.  Short documents have one shingle of all their words."""
    count = np.bincount(docs, minlength=n)
    ends = np.cumsum(count)
    h = hashes[codes]
    window = np.zeros(len(h), U64)
    length = np.minimum(SHINGLE, count)[docs] if len(docs) else docs
    place = np.arange(len(h))
    starts_ok = place <= ends[docs] - length if len(docs) else np.zeros(0, bool)
    for k in range(SHINGLE):
        use = starts_ok & (k < length)
        at = np.flatnonzero(use)
        window[at] = mix(window[at] * U64(3) + h[at + k] + U64(k + 1))
    keep = starts_ok & (place < ends[docs] - length + 1) if len(docs) else starts_ok
    d, s = docs[keep], window[keep]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(first)
    return d[at], s[at], np.diff(np.append(at, len(d)))


@lru_cache(maxsize=128)
def poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts."""
    most = int(mean + 12 * np.sqrt(mean) + 20)
    logs = np.arange(1, most + 1)
    terms = -mean + np.concatenate([[0.0], np.cumsum(np.log(mean) - np.log(logs))])
    return np.cumsum(np.exp(terms))


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def throw(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, limit: np.ndarray, n: int, k: int) -> np.ndarray:
    """Earliest rank per document and coordinate (inf: none).  ``limit`` is each document's greatest rank."""
    best = np.full(n * k, np.inf)
    cells = np.ceil(weights).astype(np.int64)
    if not len(cells):
        return best.reshape(n, k)
    which = np.repeat(np.arange(len(cells)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    share = np.minimum(weights[which] - cell, 1.0)  # how much of the unit cell the weight covers
    owner = docs[which]
    seed = mix(elements[which] + U64(0x9E3779B97F4A7C15) * (cell.astype(U64) + U64(1)))
    low, level = 0.0, FIRST
    while len(owner):
        high = 2.0**level
        s = mix(seed ^ U64((level - FIRST + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        darts = np.searchsorted(poisson_steps(high - low), unit(s), "right")
        at = np.repeat(np.arange(len(owner)), darts)
        if len(at):
            q = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(s[at] + (q.astype(U64) + U64(1)) * U64(0xE7037ED1A0B428DB))
            rank = low + unit(dart) * (high - low)
            keep = rank < limit[owner[at]]
            partial = share[at] < 1.0
            if partial.any():
                keep &= ~partial | (unit(mix(dart + U64(1))) < share[at])
            coordinate = ((mix(dart + U64(2)) >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
            np.minimum.at(best, owner[at][keep] * k + coordinate[keep], rank[keep])
        more = limit[owner] > high
        owner, seed, share = owner[more], seed[more], share[more]
        low, level = high, level + 1
    return best.reshape(n, k)


def signatures(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """DartMinHash of each document; rows without elements stay inf."""
    total = np.bincount(docs, weights, n)
    darts = k * np.log(k) + 2 * k
    out = np.full((n, k), np.inf)
    todo, factor = np.flatnonzero(total > 0), 1.0
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        part = place[docs] >= 0
        got = throw(place[docs[part]], elements[part], weights[part], factor * darts / total[todo], len(todo), k)
        full = np.isfinite(got).all(1)
        out[todo[full]] = got[full]
        todo, factor = todo[~full], factor * 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band, ``signature`` being documents x (bands * rows)."""
    bits = signature.reshape(len(signature), bands, rows).view(U64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (len(signature), bands)).copy()
    for r in range(rows):
        key = mix(key * U64(5) + bits[:, :, r])
    return key.view(np.int64)


def word_digest(text: bytes) -> bytes:
    """128 bits of the word sequence; nothing for a text without words."""
    words = text.split()
    return hashlib.blake2b(b"\x00".join(words), digest_size=16).digest() if words else NO_WORDS


def sketch(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, node (digest of the words), bands, sign (a byte per coordinate), size (bytes of the text).  Narrow."""

    @released
    def run(batches):
        for batch in slices(batches, "text", 2_000_000):
            texts = texts_of(batch)
            codes, docs, words = word_table(texts)
            d, s, c = shingles(codes, docs, hash_words([w.decode("utf-8", "replace") for w in words]), len(texts))
            signed = signatures(d, s, c.astype(np.float64), len(texts), bands * rows)
            keys = band_keys(signed, bands, rows)
            keys = [k if t else [] for k, t in zip(keys, np.bincount(d, minlength=len(texts)))]
            sign = mix(signed.view(U64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([word_digest(t) for t in texts], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array([x.tobytes() for x in sign], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "node", "bands", "sign", "size"])

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, node binary, bands array<bigint>, sign binary, size bigint")


def similarity(a: bytes, b: bytes, size: int = SHINGLE) -> float:
    """Exact weighted Jaccard similarity of the shingle counts of two texts."""
    ids: dict[bytes, int] = {}
    counts = []
    for words in (a.split(), b.split()):
        n = min(size, len(words))
        grams: dict[tuple, int] = {}
        code = [ids.setdefault(w, len(ids)) for w in words]
        for g in zip(*(code[k:] for k in range(n))):
            grams[g] = grams.get(g, 0) + 1
        counts.append(grams)
    x, y = counts
    both = sum(min(c, y[g]) for g, c in x.items() if g in y)
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 0.0


def unnamed_texts(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of wanted digests that only rows without id have."""

    @released
    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_digest(t) for t in texts_of(batch)], pa.binary()), batch.column("text")], ["node", "text"])

    loose = own.where("doc_id is null").select("text").mapInArrow(digest, "node binary, text binary")
    return loose.join(wanted.where("least is null").select("node"), "node", "left_semi")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their exact similarity.  The text of a much-used ``a`` is copied once per thousand partners,
    so that no task gets all of them."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    uses = pairs.groupBy("a").agg(F.count("*").alias("uses")).withColumn("parts", F.ceil(F.col("uses") / 1000).cast("int"))
    with_a = (texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(uses, "a")
              .select("a", "text_a", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    salted = with_b.join(uses.select("a", "parts"), "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))

    @released
    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([similarity(x, y) for x, y in zip(a, b)], pa.float64())], ["a", "b", "similarity"])

    joined = salted.join(with_a.select("a", "part", "text_a"), ["a", "part"])
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """node, component (least node) of every linked node: least label of the neighbours, then of the label itself, until
    nothing changes.  Links are between classes, so they are few; each round is written out."""
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("after"))
        moved = stage(step.join(jump, "next").select("node", F.least("next", "after").alias("component"), (F.col("after") != F.col("component")).alias("changed")))
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels


def deal(shared: DataFrame, labels: DataFrame, signs: DataFrame) -> DataFrame:
    """Rows (bucket, band, i, j, side, node, component, sign) of buckets that still hold several components.  One side is always
    outside the bucket's largest component.  Both sides are dealt into blocks of about a thousand, so a bucket of any size is
    spread over many tasks."""
    part = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = part.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"),
                                       F.max("n").alias("most"), F.sum("n").alias("n")).where("parts > 1")
    spread = part.join(main.select("bucket", "main", F.expr("cast(ceil((n - most) / 1000) as int)").alias("cl"), F.expr("cast(ceil(n / 1000) as int)").alias("cr")), "bucket")
    spread = spread.join(signs.select("node", "sign"), "node").select("bucket", "band", "node", "component", "sign", "main", "cl", "cr")
    return two_sides(spread.where("component != main"), spread, "i", "j").select("bucket", "band", "i", "j", "side", "node", "component", "sign")


def two_sides(left: DataFrame, right: DataFrame, i: str, j: str) -> DataFrame:
    """Both sides of a grid of ``cl`` by ``cr`` blocks: a row lies in one line of blocks (left) or one column (right)."""
    left = left.withColumn(i, F.pmod(F.xxhash64("node"), "cl").cast("int")).withColumn(j, F.explode(F.expr("sequence(0, cr - 1)"))).withColumn("side", F.lit(0))
    right = right.withColumn(j, F.pmod(F.xxhash64("node"), "cr").cast("int")).withColumn(i, F.explode(F.expr("sequence(0, cl - 1)"))).withColumn("side", F.lit(1))
    return left.unionByName(right)


def block_by_block(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` (a block's rows to a list of rows) for every block of equal ``keys``; a task holds one block at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    @released
    def run(frames):
        held, last, out = [], None, []
        for pdf in frames:
            values = pdf[keys].to_numpy(np.int64)
            starts = np.flatnonzero(np.append(True, (values[1:] != values[:-1]).any(1))) if len(pdf) else []
            for start, stop in zip(starts, [*starts[1:], len(pdf)]):
                key = tuple(values[start])
                if held and key != last:
                    out += work(pd.concat(held))
                    held = []
                    if len(out) > 10_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                held.append(pdf.iloc[start:stop])
                last = key
        if held:
            out += work(pd.concat(held))
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def alike(block: pd.DataFrame, cut: float, bands: int, rows: int, best: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (left, right) in ``block`` and equal share of all pairs across its sides, of different components, whose
    signatures agree in a share of ``cut`` or more and whose first common band is this one; with ``best`` only so many per row."""
    band, side = int(block["band"].iloc[0]), block["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(left) and len(right):
        signs = np.frombuffer(b"".join(block["sign"]), np.uint8).reshape(len(block), -1)
        signs_r, parts = signs[right], pd.factorize(block["component"])[0]
        for l in left:
            same = signs_r == signs[l]
            share = (same.mean(1) - 1 / 256) * 256 / 255
            at = np.flatnonzero((share >= cut) & (parts[right] != parts[l]))
            if best is not None and len(at) > best:
                at = at[np.argsort(-share[at], kind="stable")[:best]]
            if len(at):  # each pair in its first common bucket only
                at = at[same[at].reshape(len(at), bands, rows).all(2).argmax(1) == band]
            found.append((np.full(len(at), l), right[at], share[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def loose_pairs(shared: DataFrame, labels: DataFrame, signs: DataFrame, cut: float, bands: int, rows: int, best: int | None) -> DataFrame:
    """Pairs (a, b) of one bucket and different components whose signatures agree in a share of ``cut`` or more; with ``best``
    only so many per class and block."""

    def pairs(block):
        l, r, _ = alike(block, cut, bands, rows, best)
        nodes = block["node"].to_numpy()
        return list(dict.fromkeys((min(x, y), max(x, y)) for x, y in zip(nodes[l], nodes[r])))

    return block_by_block(deal(shared, labels, signs), ["bucket", "i", "j"], pairs, "a binary, b binary").distinct()


def elements(texts: list[bytes]) -> list[np.ndarray]:
    """Each text as a sorted set of numbers, one for every occurrence of a shingle, so that the Jaccard similarity of two sets
    is the weighted one of the counts (64-bit hashes: two shingles of a pair of texts meet with a chance of about 1e-13)."""
    codes, docs, words = word_table(texts)
    d, s, c = shingles(codes, docs, hash_words([w.decode("utf-8", "replace") for w in words]), len(texts))
    which = np.repeat(np.arange(len(s)), c)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
    e = mix(s[which] + U64(0x9E3779B97F4A7C15) * turn.astype(U64))
    ends = np.cumsum(np.bincount(d[which], minlength=len(texts)))[:-1] if len(texts) else []
    return [np.sort(x) for x in np.split(e, ends)]


def loose_links(shared: DataFrame, labels: DataFrame, signs: DataFrame, texts: DataFrame, threshold: float, cut: float, bands: int, rows: int,
                block_bytes: int = 8_000_000) -> DataFrame:
    """Links (a, b) that join the components of every bucket as if all its pairs of ``cut`` or more had been compared.  The
    pairs never become rows: a first pass names the classes of each block that have a promising partner there, a second one
    compares them in the block by their shingles and gives a spanning forest, at most a row per class and block.  Blocks of
    long texts are cut again, to about ``block_bytes`` a side."""
    grid = ["bucket", "i", "j"]

    def name(block):
        l, r, _ = alike(block, cut, bands, rows)
        at = np.unique(np.concatenate([l, r]))
        return list(block.iloc[at][["bucket", "band", "i", "j", "side", "node", "component"]].itertuples(index=False, name=None))

    met = stage(block_by_block(deal(shared, labels, signs), grid, name, "bucket bigint, band int, i int, j int, side int, node binary, component binary"))
    known = met.join(signs, "node")
    many = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, F.col("size")).otherwise(0)) / block_bytes).cast("int")
    loads = known.groupBy(*grid).agg(F.greatest(many(0), F.lit(1)).alias("cl"), F.greatest(many(1), F.lit(1)).alias("cr"))
    known = known.join(loads, grid)
    cells = two_sides(known.where("side = 0").drop("side"), known.where("side = 1").drop("side"), "u", "v")
    ready = cells.join(texts, "node").select(*grid, "u", "v", "band", "side", "node", "component", "sign", "text")

    def forest(block):
        l, r, share = alike(block, cut, bands, rows)
        order = np.argsort(-share, kind="stable")
        nodes, parts = block["node"].to_numpy(), pd.factorize(block["component"])[0].tolist()
        above = list(range(len(block)))
        sets: dict[int, np.ndarray] = {}
        held = block["text"].to_numpy()
        use, size = [], 0
        for k in np.unique(np.concatenate([l, r])).tolist():  # shingles of about a megabyte of text at a time
            use.append(k)
            size += len(held[k])
            if size > 1_000_000:
                sets.update(zip(use, elements([held[x] for x in use])))
                use, size = [], 0
        sets.update(zip(use, elements([held[x] for x in use])))

        def root(k):
            while above[k] != k:
                above[k] = above[above[k]]
                k = above[k]
            return k

        out = []
        for x, y in zip(l[order].tolist(), r[order].tolist()):
            p, q = root(parts[x]), root(parts[y])
            if p == q:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                above[p] = q
                out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return out

    return block_by_block(ready, [*grid, "u", "v"], forest, "a binary, b binary").distinct()


def sweep_cut(threshold: float, coordinates: int) -> float:
    """The share of equal coordinates under which a link is ruled out: 3.8 standard deviations below ``threshold``."""
    return threshold - 3.8 * (threshold * (1 - threshold) / coordinates) ** 0.5


def near_duplicates(documents: DataFrame, threshold: float = 0.8, bands: int = 32, rows: int = 6) -> DataFrame:
    """One row per document: doc_id, node, class_id (least id of its class), n_links (links of its text to other texts that
    were found on the way to the classes; copies of a text count once)."""
    sketched = stage(sketch(documents, bands, rows))
    classes = sketched.where(F.length("node") > 0).groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    members = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowded = stage(members.join(full, "bucket"))
    weight = crowded.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = crowded.join(weight, "node")
    heads = weighed.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("head"))
    shared = stage(crowded.join(heads, "bucket").select("bucket", "band", "node", "head"))
    star = shared.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    wanted = shared.select("node").distinct().join(sketched.groupBy("node").agg(F.min("doc_id").alias("least")), "node")
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    @released
    def same(batches):  # an id may be used twice; the digest decides which text is meant
        for batch in batches:
            keep = pa.array([word_digest(t) == n for t, n in zip(texts_of(batch), batch.column("node").to_pylist())], pa.bool_())
            yield batch.filter(keep).select(["node", "text"])

    # a text without any id can't be fetched by it: its digest is looked up among the rows without id
    by_id = wanted.where("least is not null").join(own, F.col("least") == F.col("doc_id")).select("node", "text")
    texts = stage(by_id.mapInArrow(same, "node binary, text binary").unionByName(unnamed_texts(own, wanted)).dropDuplicates(["node"]))
    signs = sketched.where(F.length("node") > 0).groupBy("node").agg(F.first("sign").alias("sign"), F.max("size").alias("size"))
    links = stage(compare(star, texts).where(F.col("similarity") >= threshold).select("a", "b"))
    labels = components(links)
    cut = sweep_cut(threshold, bands * rows)
    near = compare(loose_pairs(shared, labels, signs, cut, bands, rows, 3), texts).where(F.col("similarity") >= threshold).select("a", "b")
    for find in (lambda: near, lambda: loose_links(shared, labels, signs, texts, threshold, cut, bands, rows)):
        late = stage(find())
        if not late.isEmpty():
            links = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(late).distinct())
            labels = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = labels.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("class_id"))
    linked = labels.join(named, "component").select("node", "class_id").join(degree, "node")
    alone = sketched.where(F.length("node") > 0).groupBy("node").agg(F.min("doc_id").alias("least"))
    facts = alone.join(linked, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    worded = sketched.where(F.length("node") > 0).select("doc_id", "node").join(facts, "node")
    wordless = sketched.where(F.length("node") == 0).select("node", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return worded.select("doc_id", "node", "class_id", "n_links").unionByName(wordless)


def keep_one(documents: DataFrame, **settings) -> DataFrame:
    """One document of each class, that of the least id, with its own columns, whatever their names; documents without words
    all stay."""
    found = near_duplicates(documents, **settings)
    taken = {c.lower() for c in documents.columns}
    mark, least, digest_of = (next(n for k in range(len(taken) + 1) if (n := f"{base}_{k}") not in taken) for base in ("mark", "least", "digest"))
    gone = stage(found.where((F.length("node") > 0) & ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(least), F.col("node").alias(digest_of)).distinct())
    schema = documents.select("*", F.lit(b"").alias(mark)).schema

    @released
    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([word_digest(t) for t in texts_of(batch)], pa.binary())], [*batch.schema.names, mark])

    marked = documents.mapInArrow(digest, schema)
    worded = marked.where(F.length(mark) > 0)
    kept = worded.join(gone, (F.col(mark) == F.col(digest_of)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(least)), "left_anti")
    return kept.dropDuplicates([mark, "doc_id"]).unionByName(marked.where(F.length(mark) == 0)).drop(mark)
