"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries meet, and encoded.

A text is cut into chunks of ``chunk`` code points; each chunk also carries the next ``overlap``.  The pre-token pattern is run
over the chunk from its own start, and over the overlap from the next chunk's start.  Neither knows the true boundaries, but
once two runs share a boundary they agree from there on, since the pattern never looks back.  The first boundary that both have
is where the next chunk takes over: the pieces between two such places are encoded by the ranks.  A boundary counts only if
enough text follows it that the end of the overlap can't have moved it.  If the overlap has none (one unbroken run of letters
or blanks), the whole text is encoded as one piece.  Chunks of long texts are dealt out; a text of one chunk stays in its row.

Ids are little-endian unsigned 32-bit integers.  Decoding concatenates the bytes of the ids, which may cut code points; only
the whole is text again.  Null and empty texts have no ids.  Repeated and null ids of documents: row by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import shuffle_partitions, slices, stage
from versoline.llm.tokens import rank_encoder


def boundaries(text: str, pattern) -> np.ndarray:
    """Where pre-tokens end."""
    return np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)


def meeting(part: str, chunk: int, last: bool, pattern) -> int | None:
    """Offset behind ``chunk`` of the first boundary that the runs from both starts have; none if they don't meet."""
    if last:
        return len(part) - chunk
    here, there = boundaries(part, pattern), boundaries(part[chunk:], pattern) + chunk
    both = np.intersect1d(here, there)
    both = both[both < len(part) - 1]  # the pattern looks one code point ahead, and the last token may go on
    return int(both[0]) - chunk if len(both) else None


def encode(documents: DataFrame, path: str | None = None, chunk: int = 1 << 16, overlap: int = 1 << 12, then=None, schema: str | None = None) -> DataFrame:
    """``documents`` (doc_id, text) with ``ids`` instead of the text; ``then``, a function of doc_id and ids per batch giving a
    record batch of ``schema``, is applied in the same pass."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark, rule = documents.sparkSession, public_tokenizers.PATTERN
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = schema or "doc_id bigint, ids binary"
    then = then or (lambda doc, ids: pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary())], ["doc_id", "ids"]))

    def whole(batches):
        encoder = rank_encoder(path, rule)
        for batch in slices(batches, "text"):
            yield then(batch.column("doc_id"), [encoder.ids(t) for t in batch.column("text").to_pylist()])

    def cut(batches):
        task, texts = TaskContext.get().partitionId(), 0  # a task that is run again gives its texts the same numbers
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row, n = (task << 64 | texts).to_bytes(16, "big"), -(-len(text) // chunk)
                texts += 1
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row, doc, k, n, text[k * chunk : (k + 1) * chunk + overlap]), kinds)], names)

    names, kinds = ["row", "doc_id", "k", "n", "part"], [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def meet(batches):
        pattern = regex.compile(rule)
        for batch in batches:
            met = [meeting(p, chunk, k + 1 == n, pattern) for p, k, n in zip(*(batch.column(c).to_pylist() for c in ("part", "k", "n")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(met, pa.int64())], ["row", "k", "met"])

    def pieces(batches):
        encoder = rank_encoder(path, rule)
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("part", "before", "met")}
            ids = [encoder.ids(p[b : chunk + m]) for p, b, m in zip(cols["part"], cols["before"], cols["met"])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), pa.array(ids, pa.binary())], ["row", "doc_id", "k", "ids"])

    def join(batches):
        encoder = rank_encoder(path, rule)
        for batch in batches:
            ids = []
            for row in batch.to_pylist():
                if row["stuck"]:
                    ids.append(encoder.ids("".join(p["part"][:chunk] for p in sorted(row["parts"], key=lambda p: p["k"]))))
                else:
                    ids.append(b"".join(p["ids"] for p in sorted(row["parts"], key=lambda p: p["k"])))
            yield then(batch.column("doc_id"), ids)

    short = own.where(F.length("text") <= chunk).mapInArrow(whole, schema)
    parts = own.where(F.length("text") > chunk).mapInArrow(cut, "row binary, doc_id bigint, k int, n int, part string")
    parts = stage(parts.repartition(shuffle_partitions(spark), "row", "k"))
    met = stage(parts.mapInArrow(meet, "row binary, k int, met bigint"))
    stuck = met.groupBy("row").agg(F.max(F.col("met").isNull()).alias("stuck"))
    before = met.select("row", (F.col("k") + 1).alias("k"), F.col("met").alias("before"))
    ready = parts.join(stuck, "row").join(met, ["row", "k"]).join(before, ["row", "k"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    good = ready.where(~F.col("stuck")).mapInArrow(pieces, "row binary, doc_id bigint, k int, ids binary")
    rows = good.select("row", "doc_id", "k", "ids", F.lit(None).cast("string").alias("part"), F.lit(False).alias("stuck")).unionByName(
        ready.where("stuck").select("row", "doc_id", "k", F.lit(None).cast("binary").alias("ids"), "part", "stuck"))
    long = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("stuck").alias("stuck"), F.collect_list(F.struct("k", "ids", "part")).alias("parts"))
    return short.unionByName(long.mapInArrow(join, schema))


def decode(ids: bytes, path: str) -> bytes:
    """The bytes of all ids, one after the other."""
    tokens = _tokens(path)
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_TOKENS: dict[str, list[bytes]] = {}


def _tokens(path: str) -> list[bytes]:
    if path not in _TOKENS:
        ranks = rank_encoder(path, public_tokenizers.PATTERN).ranks
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _TOKENS[path] = table
    return _TOKENS[path]


def round_trip(documents: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def digest(doc, ids):
        return pa.RecordBatch.from_arrays(
            [doc, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
             pa.array([hashlib.sha256(decode(i, path)).hexdigest() for i in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(documents, path, then=digest, schema="doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", **settings)
