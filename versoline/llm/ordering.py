"""Training-order materialisation: every sequence of token ids gets a global slot by a keyed permutation.

Texts are encoded and cut into sequences of ``length`` ids (the last of a text is shorter and padded).  Sequences are numbered
from 0 without gaps: number in its task plus what the tasks before hold.  A Feistel network keyed by ``key`` permutes the least
even-bit domain that holds all numbers; a value outside the range walks on along its cycle until it falls inside, so slots are
a permutation of the numbers, computed for each row alone.  Contiguous ranges of ``per_shard`` slots are written as shards of
fixed-stride records: record ``r`` of shard ``s`` is slot ``s * per_shard + r`` at byte ``r * stride``.  A reader that stopped at
a slot resumes there by arithmetic; the same key, table order and vocabulary give the same files.

Record: doc_id (8 bytes, signed), sequence number in the text (4), ids used (4), then ``length`` ids of 2 bytes (4 if the
vocabulary is larger), little-endian, padded with 0.  Null ids of documents are stored as the least 8-byte integer and come
back as null.  Null and empty texts have no sequence.  An empty table has no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versoline.llm.shared import U64, mix, slices, stage
from versoline.llm.tokens import rank_encoder

NO_ID = -(1 << 63)
HEAD = np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("n", "<u4")])
SHARDS = "shard bigint, first_slot bigint, n_records int, payload binary"


def feistel(x: np.ndarray, half: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of the integers below ``2 ** (2 * half)``."""
    mask = U64((1 << half) - 1)
    left, right = x.astype(U64) >> U64(half), x.astype(U64) & mask
    for r in range(rounds):
        left, right = right, left ^ (mix(right + U64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9 + 1) & 0xFFFFFFFFFFFFFFFF)) & mask)
    return (left << U64(half)) | right


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot of each number below ``total``."""
    half = max(1, -(-max(1, total - 1).bit_length() // 2))
    out = feistel(numbers, half, key)
    while True:
        outside = np.flatnonzero(out >= U64(total))
        if not len(outside):
            return out.astype(np.int64)
        out[outside] = feistel(out[outside], half, key)


def sequences(documents: DataFrame, length: int, path: str) -> DataFrame:
    """task, place (number in the task), doc_id, seq, n, ids."""
    rule = public_tokenizers.PATTERN
    names, kinds = ["task", "place", "doc_id", "seq", "n", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        task, place = TaskContext.get().partitionId(), 0
        encoder = rank_encoder(path, rule)
        kind = id_kind(path)
        for batch in slices(batches, "text", 2_000_000):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(encoder.ids(text or ""), "<u4").astype(kind)
                for seq, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append((task, place, doc, seq, len(part), part.tobytes()))
                    place += 1
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "task int, place bigint, doc_id bigint, seq int, n int, ids binary")


def id_kind(path: str) -> str:
    return "<u2" if max(rank_encoder(path, public_tokenizers.PATTERN).ranks.values()) < 1 << 16 else "<u4"


def stride(length: int, kind: str) -> int:
    return HEAD.itemsize + length * np.dtype(kind).itemsize


def shards(documents: DataFrame, key: int = 20_240_229, length: int = 256, per_shard: int = 8192, path: str | None = None) -> DataFrame:
    """The shards: shard, first_slot, n_records, payload (n_records fixed-stride records)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = id_kind(path)
    found = stage(sequences(documents, length, path))
    per_task = found.groupBy("task").agg(F.count("*").alias("n"))
    total = per_task.agg(F.sum("n")).first()[0] or 0
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the writing job
    base = per_task.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = found.join(F.broadcast(base), "task")  # two numbers per task of the writing job, 16 bytes for each split of the input

    def assign(batches):
        for batch in batches:
            number = batch.column("place").to_numpy(zero_copy_only=False) + batch.column("base").to_numpy(zero_copy_only=False)
            slot = slots(number, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), *(batch.column(c) for c in ("doc_id", "seq", "n", "ids"))], ["shard", "slot", "doc_id", "seq", "n", "ids"])

    def write(key_, table):
        order = np.argsort(table.column("slot").to_numpy())
        table = table.take(pa.array(order))
        n, width = table.num_rows, np.dtype(kind).itemsize
        record = np.zeros(n, np.dtype([("head", HEAD), ("ids", "u1", length * width)]))
        record["head"]["doc_id"] = table.column("doc_id").fill_null(NO_ID).to_numpy()
        record["head"]["seq"], record["head"]["n"] = table.column("seq").to_numpy(), table.column("n").to_numpy()
        for r, ids in enumerate(table.column("ids").to_pylist()):
            record["ids"][r, : len(ids)] = np.frombuffer(ids, np.uint8)
        first = int(key_[0].as_py()) * per_shard
        return pa.table([pa.array([first // per_shard]), pa.array([first]), pa.array([n], pa.int32()), pa.array([record.tobytes()], pa.binary())],
                        names=["shard", "first_slot", "n_records", "payload"])

    dealt = numbered.mapInArrow(assign, "shard bigint, slot bigint, doc_id bigint, seq int, n int, ids binary")
    return dealt.groupBy("shard").applyInArrow(write, SHARDS)


def write_shards(made: DataFrame, folder: str) -> DataFrame:
    """Each shard as one raw file below ``folder`` (a URI that executors share): written aside, then moved, so a task that is
    run again leaves the same file.  Returns shard, first_slot, n_records, path."""

    def run(batches):
        for batch in batches:
            fs, root = pafs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            paths = []
            for row in batch.to_pylist():
                path = f"{root}/shard-{row['shard']:08d}.bin"
                aside = f"{path}.{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(aside) as out:
                    out.write(row["payload"])
                fs.move(aside, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "first_slot", "n_records")), pa.array(paths, pa.string())], ["shard", "first_slot", "n_records", "path"])

    return made.mapInArrow(run, "shard bigint, first_slot bigint, n_records int, path string")


def records(payload: bytes, length: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Heads and ids (one row per record) of a shard or of any whole number of its records."""
    got = np.frombuffer(payload, np.dtype([("head", HEAD), ("ids", kind, length)]))
    return got["head"], got["ids"]


def listing(made: DataFrame, length: int = 256, path: str | None = None) -> DataFrame:
    """One row per record: slot, shard, byte_offset, doc_id, seq, n_tokens, ids_crc32."""
    kind = id_kind(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                head, ids = records(row["payload"], length, kind)
                n = len(head)
                crc = [zlib.crc32(i[:k].tobytes()) for i, k in zip(ids, head["n"])]
                doc = pa.array(head["doc_id"].astype(np.int64), mask=head["doc_id"] == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["first_slot"] + np.arange(n)), pa.array(np.full(n, row["shard"])), pa.array(np.arange(n) * stride(length, kind)), doc,
                     pa.array(head["seq"].astype(np.int64)), pa.array(head["n"].astype(np.int64)), pa.array(crc, pa.int64())],
                    ["slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "ids_crc32"])

    return made.mapInArrow(run, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, seq bigint, n_tokens bigint, ids_crc32 bigint")
