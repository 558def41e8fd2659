"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation's rows are repaired with the cheapest edits (Keep 0, Rerole 2, Delete 3, Insert 2, and 1 for a truncated row that
stays) so that its roles read ``(s?(ua)+)?``.  The edits are arcs of a lattice: node (i, x) stands for i rows done and x the last
role (none, s, u, a).  ``auction`` keeps a price per node and one path from the origin: where the price of the path's last node is
below the cheapest arc's cost plus the price at its head it is raised to that and the path contracts, else the path extends by that
arc.  At the end the prices are an optimal dual solution: every shortest path runs on tight arcs only, and the least audit string
is traced along them.

Spark orders all rows by range partitions over (conversation, turn, row), so a conversation of a third of all rows lies in many
tasks.  A conversation inside one partition is solved there.  One that crosses a border is cut into lattices of ``SEGMENT`` rows,
each solved for every first and last role where its rows lie; only these summaries and the kept texts meet, streamed in order
(the digest of a conversation's text can't be had otherwise).

* null role or text: one space; null turn: before all others, one space in the damage key; null conversation: one of its own;
* equal turns: by role, then by the digest of role and text; repeated rows are duplicates of the first; blank rows count too;
* no rows: zeros, empty audit, digest of the empty string; empty table: no rows; very long texts: whole;
* other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.llm.shared import shuffle_partitions, stage
from versoline.operators.primitives import row_index, scan

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Rows of one lattice.
SEGMENT = 64
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Role initial to the state after it, by the state before.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state that an inserted or reroled row leads to, and its role.
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
INFINITE = float("inf")


# ---------------------------------------------------------------- the lattice and the auction

def lattice(rows: list[tuple], exits: tuple[int, ...]) -> list[list[tuple[int, int, str]]]:
    """Arcs (head, cost, edit) by node 4 * i + state; the last node is the goal, reached from ``exits`` after the last row.

    A row is (role, text, must go, truncated).
    """
    arcs = []
    m, goal = len(rows), 4 * len(rows) + 4
    for i in range(m + 1):
        for x in range(4):
            own = [(4 * i + FORCED[x], INSERT, "I")]
            if i < m:
                role, _, gone, cut = rows[i]
                own.append((4 * i + 4 + x, DELETE, "D"))
                if not gone:
                    own.append((4 * i + 4 + FORCED[x], REROLE + cut, "R"))
                    y = FOLLOWS[x].get(role[:1])
                    if y:
                        own.append((4 * i + 4 + y, KEEP + cut, "K"))
            elif x in exits:
                own.append((goal, 0, ""))
            arcs.append(own)
    arcs.append([])
    return arcs


def auction(arcs: list[list[tuple[int, int, str]]], origin: int) -> list[float]:
    """Converged prices; the goal (last node, which the origin must reach) keeps 0 and the origin's price is its distance.

    Throughout, a price is at most an arc's cost plus the price at its head, and equal on the path's arcs.
    """
    goal = len(arcs) - 1
    prices = [0] * len(arcs)
    path = [origin]
    while path[-1] != goal:
        node = path[-1]
        least, head = INFINITE, -1
        for j, cost, _ in arcs[node]:
            if cost + prices[j] < least:
                least, head = cost + prices[j], j
        if prices[node] < least:  # raise and contract
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)
    return prices


def trace(arcs: list[list[tuple[int, int, str]]], prices: list[float], origin: int) -> str:
    """The ASCII-least edit string of a shortest path: the least edit among tight arcs that lead to the goal, step by step."""
    goal = len(arcs) - 1
    tight, back, open_ = {}, {}, [origin]
    while open_:
        i = open_.pop()
        if i not in tight:
            tight[i] = [(edit, j) for j, cost, edit in arcs[i] if prices[i] == cost + prices[j]]
            for _, j in tight[i]:
                back.setdefault(j, []).append(i)
                open_.append(j)
    leads, open_ = {goal}, [goal]
    while open_:
        for i in back.get(open_.pop(), ()):
            if i not in leads:
                leads.add(i)
                open_.append(i)
    out, now = [], {origin}
    while True:
        steps = [(edit, j) for i in now for edit, j in tight[i] if j in leads]
        edit = min(steps)[0]
        if not edit:
            return "".join(out)
        out.append(edit)
        now = {j for e, j in steps if e == edit}


def repair_rows(rows: list[tuple], entry: int = NONE, exits: tuple[int, ...] = (NONE, ASSISTANT)) -> tuple[int, str]:
    """Cost and audit from ``entry`` to the cheapest of ``exits``."""
    arcs = lattice(rows, exits)
    prices = auction(arcs, entry)
    return prices[entry], trace(arcs, prices, entry)


def reachable(rows: list[tuple], entry: int) -> list[int]:
    """The states that a segment can end in: u and a always, none or s where they stay, s after none by a kept row."""
    ends = [USER, ASSISTANT]
    if entry in (NONE, SYSTEM):
        ends.append(entry)
    if entry == NONE and any(not gone and role[:1] == "s" for role, _, gone, _ in rows):
        ends.append(SYSTEM)
    return ends


def cells(rows: list[tuple], entries: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    return {(x, y): repair_rows(rows, x, (y,)) for x in entries for y in reachable(rows, x)}


# ---------------------------------------------------------------- conversations out of segments

def write_on(digest, rows: list[tuple], audit: str, state: int) -> None:
    """Add the repaired rows to the digest, newline-joined; ``state`` is the last role so far."""
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][:2]
        at += edit != "I"
        if edit == "D":
            continue
        state, before = FOLLOWS[state][role[0]] if edit == "K" else FORCED[state], state
        kept = role if edit == "K" else ROLE[state]
        digest.update(f"{kept}:{text}".encode() if before == NONE else f"\n{kept}:{text}".encode())


class Counts:
    """Faults, illegal neighbours and turns of consecutive rows; two neighbours add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # role initials
        self.low = self.high = None  # turns

    def row(self, turn, role: str, fault: int) -> None:
        one = Counts()
        one.blank, one.duplicate, one.truncated = (int(fault == k) for k in (1, 2, 3))
        one.first = one.last = role[:1]
        if turn is not None:
            one.low = one.high = turn
            one.turns = 1
        self.add(one)

    def add(self, other: Counts) -> None:
        for name in self.FIELDS:
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        if self.high is not None and self.high == other.low:
            self.turns -= 1
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high

    def result(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


class Fold:
    """A conversation from its segments in order: per last role the least (cost, audit) and the digest of its text.

    The start that all candidates share is put aside, so that comparing them stays cheap.
    """

    def __init__(self):
        self.counts, self.shared = Counts(), []
        self.best = {NONE: (0, "", hashlib.sha256())}

    def add(self, rows: list[tuple], counts: Counts, solved: dict | None = None) -> None:
        self.counts.add(counts)
        solved = cells(rows, tuple(self.best)) if solved is None else solved
        chosen = {}
        for (x, y), (cost, audit) in solved.items():
            if x in self.best:
                offer = (self.best[x][0] + cost, self.best[x][1] + audit, x, audit)
                chosen[y] = min(chosen.get(y, offer), offer)
        best = {}
        for y, (cost, whole, x, audit) in chosen.items():
            digest = self.best[x][2].copy()
            write_on(digest, rows, audit, x)
            best[y] = (cost, whole, digest)
        same = os.path.commonprefix([whole for _, whole, _ in best.values()])
        self.shared.append(same)
        self.best = {y: (cost, whole[len(same):], digest) for y, (cost, whole, digest) in best.items()}

    def result(self) -> list:
        cost, audit, digest = min((self.best[y] for y in (NONE, ASSISTANT) if y in self.best), key=lambda c: c[:2])
        return [*self.counts.result(), cost, "".join(self.shared) + audit, digest.hexdigest()]


def whole(rows: list[tuple], counts: Counts) -> list:
    """The result of a conversation of one lattice."""
    cost, audit = repair_rows(rows)
    digest = hashlib.sha256()
    write_on(digest, rows, audit, NONE)
    return [*counts.result(), cost, audit, digest.hexdigest()]


# ---------------------------------------------------------------- the Spark job

RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
OPEN = "part int, no bigint, roles array<string>, texts array<string>, pairs array<int>, costs array<bigint>, audits array<string>, first string, last string, low bigint, high bigint, turns bigint"
_INT, _TEXT = pa.int64(), pa.string()
_RESULT = pa.schema([("conv_id", _INT), *((x.split()[0], _TEXT if x.endswith("string") else _INT) for x in RESULT.split(", "))])
_ALL = pa.schema([*_RESULT, ("part", pa.int32()), ("no", _INT), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT)), ("pairs", pa.list_(pa.int32())), ("costs", pa.list_(_INT)),
                  ("audits", pa.list_(_TEXT)), ("first", _TEXT), ("last", _TEXT), ("low", _INT), ("high", _INT), ("turns", _INT)])
#: Full segments of a conversation that a task holds before it passes them on solved.
HELD = 16


class _Piece:
    """The rows of one conversation that a task reads, in segments."""

    def __init__(self, conv, part: int):
        self.conv, self.part, self.no, self.begins, self.first = conv, part, 0, False, False
        self.rows, self.counts, self.held = [], Counts(), []

    def row(self, turn, role: str, text: str, copies: int, blank: bool, cut: bool) -> Iterator[list]:
        for _ in range(copies):
            fault = 1 if blank else 2 if not self.first else 3 if cut else 0
            self.first = False
            if len(self.rows) == SEGMENT:
                self.held.append((self.rows, self.counts))
                self.rows, self.counts = [], Counts()
                if len(self.held) > HELD:
                    yield from self.release()
            self.rows.append((role, text, fault in (1, 2), fault == 3))
            self.counts.row(turn, role, fault)

    def release(self) -> Iterator[list]:
        """What is held, each segment solved for all its ends."""
        for rows, counts in self.held:
            solved = cells(rows, (NONE,) if self.begins and not self.no else (NONE, SYSTEM, USER, ASSISTANT))
            yield [self.conv, None, counts.blank, counts.duplicate, counts.truncated, counts.illegal, None, None, None, self.part, self.no, [r[0] for r in rows], [r[1] for r in rows],
                   [4 * x + y for x, y in solved], [c for c, _ in solved.values()], [a for _, a in solved.values()], counts.first, counts.last, counts.low, counts.high, counts.turns]
            self.no += 1
        self.held = []

    def close(self, at_border: bool) -> Iterator[list]:
        self.held.append((self.rows, self.counts))
        if at_border or self.no or not self.begins:
            yield from self.release()
        elif len(self.held) == 1:
            yield [self.conv, *whole(self.rows, self.counts), *[None] * 12]
        else:
            fold = Fold()
            for rows, counts in self.held:
                fold.add(rows, counts)
            yield [self.conv, *fold.result(), *[None] * 12]


def _batches(rows: Iterator[list], schema: pa.Schema, limit: int = 2_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + len(row[11] if len(row) > 11 and row[11] else ())
        if size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie inside the partition, segments of the others."""

    def pieces() -> Iterator[list]:
        part, piece = TaskContext.get().partitionId(), None
        for batch in batches:
            for conv, kind, turn, role, text, copies, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or conv != piece.conv:
                    if piece:
                        yield from piece.close(False)
                    piece = _Piece(conv, part)
                if kind == 0:
                    piece.begins = True
                elif kind == 1:
                    piece.first = True
                else:
                    yield from piece.row(turn, role, text, copies, blank, cut)
        if piece:
            yield from piece.close(True)

    yield from _batches(pieces(), _ALL)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations out of their segments, which come in order."""

    def results() -> Iterator[list]:
        conv, fold = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if fold is None or r["conv_id"] != conv:
                    if fold:
                        yield [conv, *fold.result()]
                    conv, fold = r["conv_id"], Fold()
                counts = Counts()
                for name in (*Counts.FIELDS, "first", "last", "low", "high"):
                    setattr(counts, name, r[name])
                solved = {divmod(p, 4): (c, a) for p, c, a in zip(r["pairs"], r["costs"], r["audits"])}
                fold.add(list(zip(r["roles"], r["texts"])), counts, solved)
        if fold:
            yield [conv, *fold.result()]

    yield from _batches(results(), _RESULT)


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` with their digest, whether they are blank, and whether they are cut off."""
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    return rows.select("conv_id", "turn", "role", "text", "copies", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
                       (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` after the damage that crc32 of ``conv_id:turn`` chooses for a row."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role, h = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" ")), F.crc32(key.cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(h == 3, 2).otherwise(1).alias("copies"), h.alias("h"),
    ).filter("h <> 0").drop("h")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``conversations``.

    ``rows`` has conv_id, turn, role, text (no nulls but in ids and turns) and ``copies``, how often the row stands there.  Equal rows are
    counted before they are shuffled; the first of equal texts is found from digests and meets its row by the order alone.
    """
    spark = rows.sparkSession
    copies = _faults(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = _faults(rows).groupBy("conv_id", "role", "digest").agg(F.min(place)["turn"].alias("turn"))
    none = {"role": "string", "digest": "string", "text": "string", "turn": "bigint", "copies": "bigint", "blank": "boolean", "cut": "boolean"}
    cols = ["conv_id", "kind", "turn", "role", "text", "copies", "blank", "cut"]

    def as_rows(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in df.columns}).withColumn("kind", F.lit(kind)).select(*cols, "digest")

    heads = as_rows(conversations.select(F.col("conv_id").cast("bigint")).distinct(), 0)
    every = heads.unionByName(as_rows(first, 1)).unionByName(as_rows(copies, 2)).withColumn("head", F.when(F.col("kind") == 0, 0).otherwise(1))
    order = ["conv_id", "head", "turn", "role", "digest"]
    ranged = every.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "kind").select(*cols)
    pieces = stage(ranged.mapInArrow(_solve, f"conv_id bigint, {RESULT}, {OPEN}"))
    names = ["conv_id", *(x.split()[0] for x in RESULT.split(", "))]
    crossing = pieces.filter("part is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return pieces.filter("part is null").select(*names).unionByName(crossing.mapInArrow(_join, f"conv_id bigint, {RESULT}"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The damaged table's repair, a row for every original conversation."""
    return repair(damage(conversations), conversations)


def messages(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text of the repaired conversations, a row per message."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")
    order = [F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), F.col("role"), F.col("digest"), F.col("copy")]
    each = _faults(rows).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(key, "turn", "role", "text", "digest", "copy")
    numbered = scan(each, ["key"], order, F.when(F.col("turn").isNull(), -1).otherwise(F.greatest(F.lit(0), F.floor(F.col("turn") / 256))), {"at": row_index()})

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, audit in zip(*(c.to_pylist() for c in batch.columns)):
                size = len(audit) - audit.count("D")
                out, at, place = [], 0, 0
                for edit in audit:
                    if edit != "D":
                        forced = None if edit == "K" else "user" if place % 2 == size % 2 else "assistant"
                        out.append((conv, None if edit == "I" else at, place, edit, forced))
                        place += 1
                    at += edit != "I"
                for k in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k:k + 10_000]), (_INT, _INT, _INT, _TEXT, _TEXT))], names=["conv_id", "at", "place", "edit", "forced"])

    steps = repaired.select("conv_id", "audit").mapInArrow(edits, "conv_id bigint, at bigint, place bigint, edit string, forced string").select("*", key)
    found = steps.alias("e").join(numbered.alias("r"), (F.col("e.key") == F.col("r.key")) & (F.col("e.at") == F.col("r.at")), "left")
    return found.select("e.conv_id", "place", "edit", F.coalesce("forced", "r.role").alias("role"), F.coalesce("r.text", F.lit("")).alias("text"))


# ---------------------------------------------------------------- the same in SQL

def _oracle() -> str:
    """Dynamic programming over rows; a state's value is its cost in ten digits and its audit, so least() takes the cheapest, then the ASCII-least."""

    def add(v: str, cost: str, edit: str) -> str:
        return f"(lpad((left({v}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({v}, 11) || '{edit}')"

    def inserted(*v: str) -> str:
        user = f"least({v[2]}, {add(f'least({v[0]}, {v[1]}, {v[3]})', '2', 'I')})"
        return f"{v[0]}, {v[1]}, {user}, least({v[3]}, {add(user, '2', 'I')})"

    def step(y: int) -> str:
        initial = " sua"[y]
        sources = {SYSTEM: [NONE], USER: [NONE, SYSTEM, ASSISTANT], ASSISTANT: [USER]}.get(y, [])
        offers = [add(f"v{y}", "3", "D")]
        for k in sources:
            offers.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(f'v{k}', 'cut', 'K')} END")
            if y != SYSTEM:
                offers.append(f"CASE WHEN NOT gone THEN {add(f'v{k}', '2 + cut', 'R')} END")
        return f"least({', '.join(offers)})"

    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)")
    shown = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    zero = "'0000000000'"
    moved = [step(k) for k in range(4)]
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT *, {crc} % 20 AS h FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE h <> 0),
numbered AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
  left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before, {shown} AS shown FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text), copy)),
r AS (SELECT *, shown = '' OR seen AS gone, (shown <> '' AND NOT seen AND right(shown, 1) NOT IN ('.', '!', '?'))::INT AS cut FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (shown = '') AS blank, count(*) FILTER (shown <> '' AND seen) AS duplicate,
  sum(cut)::BIGINT AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS i, {inserted(zero, "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR")} FROM counts
  UNION ALL SELECT conv_id, i, {inserted("w0", "w1", "w2", "w3")} FROM (SELECT dp.conv_id, r.i, {', '.join(f'{m} AS w{k}' for k, m in enumerate(moved))}
    FROM (SELECT * FROM dp) AS dp(conv_id, i, v0, v1, v2, v3) JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1) AS s(conv_id, i, w0, w1, w2, w3)),
best AS (SELECT dp.conv_id, least(v0, v3) AS v FROM (SELECT * FROM dp) AS dp(conv_id, i, v0, v1, v2, v3) JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.m = dp.i),
audits AS (SELECT conv_id, left(v, 10)::BIGINT AS cost, substr(v, 11) AS audit FROM best),
edits AS (SELECT conv_id, audit, generate_subscripts(string_split(audit, ''), 1) AS p, unnest(string_split(audit, '')) AS e FROM audits WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o, length(replace(audit, 'D', '')) AS n FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
texts AS (SELECT p.conv_id, string_agg(CASE WHEN e = 'K' THEN r.role WHEN (n - o) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p.p) AS t
  FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE e <> 'D' GROUP BY p.conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM k.conv_id
"""


ORACLE = _oracle()
