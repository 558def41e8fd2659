"""Conversation repair against dynamic programming over one conversation at a time."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from versoline.llm import conversations as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) by trying every edit, state by state."""
    best = {"": (0, "")}

    def put(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit) in list(out.items()):
                put(out, "a" if state == "u" else "u", (cost + 2, audit + "I"))
        return out

    best = inserted(best)
    for role, gone, cut in rows:
        nxt = {}
        for state, (cost, audit) in best.items():
            put(nxt, state, (cost + 3, audit + "D"))
            if not gone:
                forced = "a" if state == "u" else "u"
                put(nxt, forced, (cost + 2 + cut, audit + "R"))
                if role[:1] == forced or role[:1] == "s" and state == "":
                    put(nxt, role[:1], (cost + cut, audit + "K"))
        best = inserted(nxt)
    return min(best[s] for s in ("", "a") if s in best)


def plain_version(table):
    """The contract's row per conversation, from a list of (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked, n = set(), [], [0, 0, 0, 0]
        for _, role, text in rows:
            shown = text.rstrip(SPACE)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else 3
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, fault < 2, int(fault == 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(marked)
        kept = len(audit.replace("D", ""))
        final, at = [], 0
        for edit in audit:
            if edit != "D":
                forced = "user" if len(final) % 2 == kept % 2 else "assistant"
                final.append((rows[at][1] if edit == "K" else forced) + ":" + ("" if edit == "I" else rows[at][2]))
            at += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in final))
        out[conv] = (conv, gaps, n[0], n[1], n[2], illegal, cost, audit, hashlib.sha256("\n".join(final).encode()).hexdigest())
    return out


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=14))
def test_auction_equals_dynamic_programming(rows):
    assert c.repair_rows([(role, "", gone, cut and not gone) for role, gone, cut in rows]) == cheapest([(r, g, int(t and not g)) for r, g, t in rows])


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=24), st.lists(st.integers(0, 24), max_size=4))
def test_segments_equal_the_whole(rows, cuts):
    rows = [(role, f"{k}", gone, cut and not gone) for k, (role, gone, cut) in enumerate(rows)]
    ends = [0, *sorted(min(x, len(rows)) for x in cuts), len(rows)]
    fold = c.Fold()
    for a, b in zip(ends, ends[1:]):
        fold.add(rows[a:b], c.Counts())
    assert fold.result()[5:] == c.whole(rows, c.Counts())[5:]


@settings(max_examples=100, deadline=None)
@given(st.lists(ROW, max_size=10))
def test_prices_are_an_optimal_dual(rows):
    arcs = c.lattice([(role, "", gone, cut and not gone) for role, gone, cut in rows], (c.NONE, c.ASSISTANT))
    prices = c.auction(arcs, 0)
    assert prices[-1] == 0 and all(prices[i] <= cost + prices[j] for i, own in enumerate(arcs) for j, cost, _ in own)


def table(rng, convs, sizes):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "ends. \n", "\xa0", "日本。", "a.b"]
    out = []
    for conv, size in zip(convs, sizes):
        for turn in range(size):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", "", None]) if rng.random() < 0.1 or turn == 0 and rng.random() < 0.4 else role
            text = rng.choice([*texts, None]) if rng.random() < 0.5 else f"{turn} {rng.random()}" + rng.choice(".!? ")
            out.append((conv, None if rng.random() < 0.03 else turn + 3 * (rng.random() < 0.05), role, text))
            if rng.random() < 0.05:
                out.append(out[-1])
    return out


def test_whole_table(spark):
    rng = random.Random(4)
    rows = table(rng, range(300), [rng.randint(1, 9) for _ in range(300)])
    rows += table(rng, [None, 1000, 1001], [12, 90, 700])
    rows += table(rng, [2000], [6000])  # more than a third of all rows, over several partitions
    rows += [(3000, None, None, None), (3001, 5, "user", "x" * 200_000 + "."), *[(3002, 1, "user", "Same.")] * 40]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", kind int").repartition(5)
    got = {r["conv_id"]: tuple(r) for r in c.damaged_and_repaired(df).collect()}
    want = plain_version(rows)
    assert got.keys() == want.keys() and all(got[k] == want[k] for k in want)


def test_messages(spark):
    rng = random.Random(6)
    rows = [*table(rng, range(40), [rng.randint(1, 9) for _ in range(40)]), *table(rng, [None, 77], [6, 300])]
    df = spark.createDataFrame(rows, SCHEMA)
    repaired = c.damaged_and_repaired(df)
    by = {}
    for r in c.messages(c.damage(df), repaired).collect():
        by.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for r in repaired.collect():
        own = sorted(by.get(r["conv_id"], []))
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in own).encode()).hexdigest() == r["repaired_sha256"]


def test_empty(spark):
    assert c.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_dropped(spark):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = c.damaged_and_repaired(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


