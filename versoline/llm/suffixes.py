"""Repeated passages by a logarithmic family of sparse suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts in a document of a smaller id.  Every such string holds
``length - GRAM + 1`` grams of ``GRAM`` bytes; the least gram hash among them is its *key*, so equal strings have equal keys.
Suffixes are sampled where the key changes: a *run* is a maximal stretch of neighbouring windows with one key, about one per
dozen bytes.

1. Documents are staged in blocks, and each block is one batch.  Its suffix array is the sorted array of its run keys, dealt by
   key range into shards.  Within a shard the batches come one by one: the new array is merge-scanned against the existing
   levels for keys they share, becomes a level itself, and equal-sized levels merge geometrically (``Family``).  What comes
   back to a block is two bits per key: some other document has it; it occurs with different runs.
2. Only windows with shared keys can repeat.  They are sent again as whole strings, by hash with the least document that has
   it: as one string for the run where all its occurrences are equal, window by window where they differ (at the two ends of
   a repeated passage).  A second family finds the strings that a document of a smaller id outside the block has, one bit each.
3. The block cuts what is covered.

Arrays hold 64-bit hashes of the bytes (two independent ones decide, key and string).  Orders are those of the hashes, not of
the letters.  Shards follow ``spark.sql.shuffle.partitions``, blocks have ``block_mb`` MB at most (a longer text is a block of
its own), so every task holds a bounded part; a string that half the documents share is one entry per block.

Null texts are empty; texts shorter than ``length`` stay whole.  Rows of equal id do not count against each other; rows
without id neither lose bytes nor cause others to.  Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import U64, mix, release, released, shared_folder, shuffle_partitions, slices, texts_of

GRAM = 26
PIECE = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15
_ONES = (1 << 64) - 1


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Tables:
    """Powers for prefix hashes of pieces up to a given size, made once per worker."""

    up = down = np.ones(1, U64)
    letters = mix(np.arange(1, 257, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up = _powers(n, _FACTOR)
            cls.down = _powers(n, pow(_FACTOR, -1, 1 << 64))


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def piece_runs(data: np.ndarray, valid: np.ndarray, length: int, gram: int = GRAM):
    """Of a stretch of bytes: start and end window of each run, its key, its hash, and a function for window hashes."""
    n = len(data)
    Tables.grow(n + 1)
    h = np.zeros(n + 1, U64)
    np.cumsum(Tables.letters[data] * Tables.up[:n], out=h[1:])
    grams = mix((h[gram:] - h[:-gram]) * Tables.down[: n - gram + 1])
    key = least_of(grams, length - gram + 1)
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (key[1:] != key[:-1])
    first = np.flatnonzero(start)
    end = valid.copy()
    end[:-1] &= ~valid[1:] | start[1:]
    last = np.flatnonzero(end)
    run = mix((h[last + length] - h[first]) * Tables.down[first] + (last - first).astype(U64))

    def windows(at: np.ndarray) -> np.ndarray:
        return mix((h[at + length] - h[at]) * Tables.down[at] + U64(_ONES))

    return first, last, mix(key[first]), run, windows


def block_runs(texts: list[bytes], ids: list, length: int):
    """For each piece of a block: text number per run, offset of its first window in the text, and what ``piece_runs`` gives."""
    piece, owners, starts, size = [], [], [], 0
    for number, (text, doc) in enumerate(zip(texts, ids)):
        if doc is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, PIECE):
            part = text[at : at + PIECE + length - 1]
            if size and size + len(part) > PIECE:
                yield _runs(piece, owners, starts, length)
                piece, owners, starts, size = [], [], [], 0
            piece.append(part)
            owners.append(number)
            starts.append(at)
            size += len(part)
    if piece:
        yield _runs(piece, owners, starts, length)


def _runs(piece: list[bytes], owners: list[int], starts: list[int], length: int):
    sizes = np.array([len(p) for p in piece])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(piece), np.uint8)
    valid = np.ones(len(data) - length + 1, bool)
    for edge in base[1:]:
        valid[max(0, edge - length + 1) : edge] = False
    first, last, key, run, windows = piece_runs(data, valid, length)
    place = np.searchsorted(base, first, "right") - 1
    return np.array(owners)[place], np.array(starts)[place] + first - base[place], first, last, key, run, windows


def _join_sorted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.concatenate(keys)
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    return both[first], order, np.flatnonzero(first)


class Family:
    """Sorted arrays in levels of growing size.  ``add`` scans a new batch against every level, then merges equal-sized levels."""

    def __init__(self, merge):
        self.levels: list[tuple[int, np.ndarray, tuple]] = []
        self.merge = merge

    def add(self, keys: np.ndarray, facts: tuple) -> np.ndarray:
        """Which keys the family had before."""
        found = np.zeros(len(keys), bool)
        for _, old, _ in self.levels:
            if len(old) and len(keys):
                at = np.minimum(np.searchsorted(old, keys), len(old) - 1)
                found |= old[at] == keys
        self.levels.append((0, keys, facts))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge_last()
        return found

    def _merge_last(self) -> None:
        (rank, a, fa), (_, b, fb) = self.levels[-2:]
        keys, order, first = _join_sorted([a, b])
        self.levels[-2:] = [(rank + 1, keys, self.merge(fa, fb, order, first))]

    def whole(self) -> tuple[np.ndarray, tuple]:
        while len(self.levels) > 1:
            self._merge_last()
        return self.levels[0][1], self.levels[0][2]


def merge_keys(fa, fb, order, first):
    """Facts (run, flags); bit 0: several documents, bit 1: several runs."""
    run, flags = (np.concatenate([x, y])[order] for x, y in zip(fa, fb))
    low, high = np.minimum.reduceat(run, first), np.maximum.reduceat(run, first)
    count = np.diff(np.append(first, len(run)))
    return low, (np.bitwise_or.reduceat(flags, first) | (count > 1) | ((low != high).astype(np.uint8) << 1)).astype(np.uint8)


def merge_least(fa, fb, order, first):
    return (np.minimum.reduceat(np.concatenate([fa[0], fb[0]])[order], first),)


def _pack(keys: np.ndarray, *facts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, compressed."""
    gaps = np.diff(keys, prepend=U64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (gaps, *facts)]
    return len(keys).to_bytes(8, "little") + zstandard.compress(b"".join(planes), 1)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n, raw = int.from_bytes(blob[:8], "little"), zstandard.decompress(blob[8:])
    out, at = [], 0
    for kind in (U64, *kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=U64)
    return out


def _by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Edges of the shards in a sorted key array."""
    return np.searchsorted(keys, np.array([(s << 64) // shards for s in range(shards)], U64)).tolist() + [len(keys)]


def _open(payload: bytes) -> tuple[pa.Table, list[bytes], list]:
    table = pa.ipc.open_stream(pa.py_buffer(zstandard.decompress(payload))).read_all()
    texts = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
    return table, texts, table.column("doc_id").cast(pa.int64()).to_pylist()


def stage_blocks(documents: DataFrame, block_mb: float) -> DataFrame:
    """block, payload: rows of about ``block_mb`` MB of text, written once as a bucketed table, so that joins on the block
    do not move the text."""
    spark = documents.sparkSession

    @released
    def run(batches):
        task, number, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema) as out:
                for b in waiting:
                    out.write_batch(b)
            raw = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), pa.array([zstandard.compress(raw, 3)], pa.binary())], ["block", "payload"])

        for batch in slices(batches, "text", 1_000_000):
            if waiting and size + batch.nbytes > block_mb * 1e6:
                yield row()
                number, waiting, size = number + 1, [], 0
            waiting.append(batch)
            size += batch.nbytes
        if waiting:
            yield row()

    name = "llm_blocks_" + shared_folder(spark).rsplit("-", 1)[1]
    blocks = documents.mapInArrow(run, "block bigint, payload binary")
    (blocks.write.bucketBy(shuffle_partitions(spark), "block").option("path", f"{shared_folder(spark)}")
     .option("compression", "uncompressed").format("parquet").saveAsTable(name))
    return spark.table(name)


def _settle(requests: DataFrame, reduce) -> DataFrame:
    """block, replies (shard, blob): what ``reduce`` answers to the blobs of each shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        out = pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "blob": reduce(list(pdf["blob"]))})
        release()
        return out

    answers = requests.groupBy("shard").applyInPandas(run, "block bigint, shard int, blob binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("shard", "blob")).alias("replies"))


def _shared_keys(blobs: list[bytes]) -> list[bytes]:
    family, all_keys = Family(merge_keys), []
    for blob in blobs:
        keys, run, flags = _unpack(blob, np.uint32, np.uint8)
        family.add(keys, (run, flags))
        all_keys.append(keys)
    keys, (_, flags) = family.whole()
    return [zstandard.compress(flags[np.searchsorted(keys, k)].tobytes(), 1) for k in all_keys]


def _earlier_strings(blobs: list[bytes]) -> list[bytes]:
    family, own = Family(merge_least), []
    for blob in blobs:
        keys, least = _unpack(blob, np.int64)
        family.add(keys, (least,))
        own.append((keys, least))
    keys, (least,) = family.whole()
    return [zstandard.compress(np.packbits(least[np.searchsorted(keys, k)] < mine).tobytes(), 1) for k, mine in own]


def _group(keys: np.ndarray):
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return ordered[first], order, np.flatnonzero(first)


def _key_array(parts, ids: np.ndarray):
    """Distinct keys of a block with a 32-bit mark of the run and the two flags."""
    keys = np.concatenate([p[4] for p in parts]) if parts else np.zeros(0, U64)
    if not len(keys):
        return keys, np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    run = (np.concatenate([p[5] for p in parts]) >> U64(32)).astype(np.uint32)
    doc = np.concatenate([ids[p[0]] for p in parts])
    keys, order, first = _group(keys)
    run, doc = run[order], doc[order]
    low, high = np.minimum.reduceat(run, first), np.maximum.reduceat(run, first)
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    return keys, low, (several | ((low != high).astype(np.uint8) << 1)).astype(np.uint8)


def _strings(parts, ids: np.ndarray, keys: np.ndarray, flags: np.ndarray):
    """Of the windows with shared keys: string hash, document number, first and last window offset in the text."""
    out = []
    for owner, offset, first, last, key, run, windows in parts:
        flag = flags[np.searchsorted(keys, key)]
        whole = np.flatnonzero(flag == 1)
        split = np.flatnonzero(flag == 3)
        count = last[split] - first[split] + 1
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(first[split], count) + step
        begin = np.repeat(offset[split], count) + step
        out.append((np.concatenate([run[whole], windows(at)]), np.concatenate([owner[whole], np.repeat(owner[split], count)]),
                    np.concatenate([offset[whole], begin]), np.concatenate([offset[whole] + last[whole] - first[whole], begin])))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, U64)] + [np.zeros(0, np.int64)] * 3


def _least_of_strings(hashes: np.ndarray, doc: np.ndarray):
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    keys, order, first = _group(hashes)
    return keys, np.minimum.reduceat(doc[order], first)


def _ids(ids: list) -> np.ndarray:
    return np.array([0 if i is None else i for i in ids], np.int64)


def with_spans(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])


def find_repeats(documents: DataFrame, length: int = 50, block_mb: float = 4.0, finish=None, out_schema=None) -> DataFrame:
    """``documents`` with ``spans``: the removed stretches of each text as [start, end) pairs of bytes, maximal and in order.
    With ``finish``, a function of a batch and its spans that gives a batch of ``out_schema``, that is returned instead."""
    spark = documents.sparkSession
    if finish is None:
        documents, finish = documents.drop("spans"), with_spans
        out_schema = documents.withColumn("spans", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end")))).schema
    blocks = stage_blocks(documents, block_mb)
    shards = shuffle_partitions(spark)
    request = "block bigint, shard int, blob binary"

    def packed(block, keys, *facts):
        edges = _by_shard(keys, shards)
        cuts = [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(cuts), pa.int64()), pa.array([c[0] for c in cuts], pa.int32()),
             pa.array([_pack(keys[a:b], *(f[a:b] for f in facts)) for _, a, b in cuts], pa.binary())], ["block", "shard", "blob"])

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                table, texts, ids = _open(row.pop("payload"))
                yield row, table, texts, _ids(ids), block_runs(texts, ids, length)
                del row, table, texts, ids
                pa.default_memory_pool().release_unused()

    @released
    def ask_keys(batches):
        for row, _, _, ids, parts in rows(batches):
            yield packed(row["block"], *_key_array([(p[0], None, None, None, p[4], p[5]) for p in parts], ids))

    def replies(of) -> bytes:
        return [zstandard.decompress(r["blob"]) for r in sorted(of or [], key=lambda r: r["shard"])]

    def known_strings(row, ids, parts):
        parts = list(parts)
        keys, _, _ = _key_array(parts, ids)
        flags = np.frombuffer(b"".join(replies(row["keys"])), np.uint8)
        return _strings(parts, ids, keys, flags)

    @released
    def ask_strings(batches):
        for row, _, _, ids, parts in rows(batches):
            hashes, owner, _, _ = known_strings(row, ids, parts)
            yield packed(row["block"], *_least_of_strings(hashes, ids[owner]))

    @released
    def cut(batches):
        for row, table, texts, ids, parts in rows(batches):
            hashes, owner, begin, end = known_strings(row, ids, parts)
            keys, least = _least_of_strings(hashes, ids[owner])
            edges = _by_shard(keys, shards)
            sizes = [b - a for a, b in zip(edges[:-1], edges[1:]) if b > a]
            bits = [np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(replies(row["strings"]), sizes)]
            earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
            at = np.searchsorted(keys, hashes)
            gone = np.flatnonzero((earlier[at] | (least[at] < ids[owner])) if len(keys) else np.zeros(0, bool))
            gone = gone[np.lexsort((begin[gone], owner[gone]))]
            spans: list[list] = [[] for _ in texts]
            for d, a, b in zip(owner[gone].tolist(), begin[gone].tolist(), (end[gone] + length).tolist()):
                if spans[d] and a <= spans[d][-1]["end"]:
                    spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
                else:
                    spans[d].append({"start": a, "end": b})
            first = 0
            for batch in table.combine_chunks().to_batches():
                yield finish(batch, spans[first : first + batch.num_rows])
                first += batch.num_rows

    reply = "array<struct<shard:int,blob:binary>>"
    keyed = _settle(blocks.mapInArrow(ask_keys, request), _shared_keys).withColumnRenamed("replies", "keys")
    with_keys = blocks.join(keyed, "block", "left").withColumn("keys", F.col("keys").cast(reply))
    stringed = _settle(with_keys.mapInArrow(ask_strings, request), _earlier_strings).withColumnRenamed("replies", "strings")
    return with_keys.join(stringed, "block", "left").mapInArrow(cut, out_schema)


def keep(text: bytes, spans) -> bytes:
    at, parts = 0, []
    for s in spans:
        parts.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, text[at:]])


def repeats(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def digest(batch, spans):
        texts = texts_of(batch)
        kept = [keep(t, s) for t, s in zip(texts, spans)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
             pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return find_repeats(own, finish=digest, out_schema="doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", **settings)


def remove_repeats(documents: DataFrame, **settings) -> DataFrame:
    """``documents`` with the repeated bytes cut from their texts; a code point that is cut through goes whole.  All columns
    stay, whatever their names."""
    schema = documents.schema

    def trim(batch, spans):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        kept = [None if t is None else keep(t, s).decode("utf-8", "ignore") for t, s in zip(texts, spans)]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(schema.names)], schema.names)

    return find_repeats(documents, finish=trim, out_schema=schema, **settings)
