"""Best-fit packing of token sequences by linear grouping.

1. Texts become pieces of at most ``capacity`` tokens (ids, then the end id).  The lengths, at most ``capacity`` different
   ones, are counted; only this histogram, whose size the data can't change, comes to the driver.
2. Large lengths (over an eighth) are sorted and cut into groups of equal cardinality; each is rounded up to the largest of its
   group.  For these few sizes the best configurations are found by column generation on the cutting-stock program.
3. The documents themselves take the places of their group, largest first.  They are a little shorter than planned; a sequence
   with such a gap gives its two shortest members back, so that the gap can be filled exactly.
4. What was given back or left over, and all small pieces, go best-fit decreasing into the fullest sequence with room.

Steps 2 to 4 work on runs of equal lengths and classes of equal sequences, so their size does not follow the data either: the
plan is a table of ranges (length, ranks, first sequence, offset).  Pieces get their rank among those of equal length from a
count per task and join the plan.

Null and empty texts are one piece of the end id.  Repeated and null ids are packed row by row.  An empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versoline.llm.shared import released, slices, stage
from versoline.llm.tokens import json_encoder

END = 0


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of sizes, each as often as it fits, within ``capacity``, and how often each."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for room in range(int(s[0]), capacity + 1):
        k = fits[room]
        got = best[room - s[:k]] + v[:k]
        i = int(got.argmax())
        if got[i] > best[room - 1] + 1e-12:
            best[room], take[room] = got[i], i
        else:
            best[room], take[room] = best[room - 1], -1
    count, room = np.zeros(len(sizes), np.int64), capacity
    while room >= s[0]:
        if take[room] < 0:
            room -= 1
            continue
        count[order[take[room]]] += 1
        room -= int(s[take[room]])
    return float(best[capacity]), count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 800) -> list[tuple[np.ndarray, int]]:
    """Configurations (how often each size) and how many sequences of each, rounded down, of the fractional optimum."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    level = demand / np.diag(columns)
    for _ in range(rounds):
        price = inverse.sum(0)
        value, column = knapsack(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-5:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        level -= step * direction
        level[out] = step
        columns[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    return [(columns[:, j].astype(np.int64), int(np.floor(level[j] + 1e-6))) for j in range(m) if level[j] >= 1 - 1e-6]


def plan(counts: dict[int, int], capacity: int, groups: int = 64, release: int = 2) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, first rank, rank after the last, first sequence, offset) and the number of sequences."""
    ranges: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)  # ranks given out per length
    room_of: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room left: (first sequence, how many)
    sequences = 0

    def place(length: int, number: int, first: int, offset: int) -> None:
        ranges.append((length, used[length], used[length] + number, first, offset))
        used[length] += number

    large = sorted((n for n in counts if capacity // 8 < n < capacity), reverse=True)
    total = sum(counts[n] for n in large)
    if total:
        size = -(-total // groups)
        group_of: dict[int, list[list[int]]] = {}  # rounded size: runs of [length, how many], longest first
        left, rounded = 0, 0
        for n in large:
            rest = counts[n]
            while rest:
                if not left:
                    left, rounded = size, n
                take = min(left, rest)
                group_of.setdefault(rounded, []).append([n, take])
                left, rest = left - take, rest - take
        sizes = np.array(sorted(group_of, reverse=True))
        demand = np.array([sum(k for _, k in group_of[int(s)]) for s in sizes], float)
        for column, number in configurations(sizes, demand, capacity):
            slots = []
            for i in np.flatnonzero(column):
                queue = group_of[int(sizes[i])]
                for _ in range(int(column[i])):
                    need, runs = number, []
                    while need and queue:
                        take = min(need, queue[0][1])
                        runs.append((queue[0][0], take))
                        queue[0][1] -= take
                        need -= take
                        if not queue[0][1]:
                            queue.pop(0)
                    slots.append(runs)
            edges = sorted({0, number, *(int(e) for runs in slots for e in np.cumsum([k for _, k in runs]))})
            at = [(0, 0)] * len(slots)  # run and place in it
            for a, b in zip(edges[:-1], edges[1:]):
                offset, held = 0, []
                for s, runs in enumerate(slots):
                    r, done = at[s]
                    if r == len(runs):
                        continue
                    held.append(runs[r][0])
                    at[s] = (r + 1, 0) if done + b - a == runs[r][1] else (r, done + b - a)
                if sum(held) < capacity:  # the rounding left a gap: its shortest members are placed with the small ones
                    held = sorted(held, reverse=True)[: max(1, len(held) - release)]
                for length in held:
                    place(length, b - a, sequences + a, offset)
                    offset += length
                room_of[capacity - offset].append((sequences + a, b - a))
            sequences += number
    for length in sorted(counts, reverse=True):
        rest = counts[length] - used[length]
        room = length
        while rest:
            while room <= capacity and not room_of[room]:
                room += 1
            if room > capacity:
                number = -(-rest // (capacity // length))
                place(length, number, sequences, 0)
                room_of[capacity - length].append((sequences, number))
                sequences, rest, room = sequences + number, rest - number, length
                continue
            first, number = room_of[room].pop()
            if room == capacity:  # an empty sequence of a configuration
                pass
            take = min(rest, number)
            place(length, take, first, capacity - room)
            rest -= take
            if take < number:
                room_of[room].append((first + take, number - take))
            room_of[room - length].append((first, take))
            room = length
    return ranges, sequences


def pieces(documents: DataFrame, json_path: str, rank_path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task and the rank among the task's pieces of that length."""
    pattern = public_tokenizers.PATTERN

    @released
    def run(batches):
        task, seen = TaskContext.get().partitionId(), {}
        encoder = json_encoder(json_path, rank_path, pattern)
        end = END.to_bytes(4, "little")
        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                many = -(-n // capacity)
                start = 0
                for k in range(many):
                    stop = n - (many - 1 - k) * capacity
                    length = stop - start
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * stop]), task, rank))
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)
        encoder.forget()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint")


def pack(documents: DataFrame, capacity: int = 2048, json_path: str | None = None, rank_path: str | None = None, groups: int = 64) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    found = stage(pieces(documents, json_path or public_tokenizers.path("byte_bpe_50k.json"), rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity))
    per_task = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ranges, _ = plan(counts, capacity, groups)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = spark.createDataFrame(ranges, "length bigint, low bigint, high bigint, first bigint, offset bigint")
    ranked = found.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    near = ranked.alias("p").join(F.broadcast(table.alias("r")), F.expr("p.length = r.length and p.rank >= r.low and p.rank < r.high"))
    return near.select("doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
                       (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
