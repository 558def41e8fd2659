"""Heaviest increasing chains of groups too large for one task.

A chain rises strictly in x and in y.  A group is laid out as a grid: slabs of neighbouring x ranks, bands of neighbouring y ranks.
What a block has to know of all blocks below and left of it is little: per x of its slab the best chain end so far (a staircase), per
y of its band the same, and one best end among the blocks that lie below and left in both.  So the blocks of one diagonal are solved
side by side, each by one task that holds one block and two staircases, diagonal after diagonal; a block sends what it knows to its
neighbours.  Every diagonal is written to the checkpoint folder and read back, so a lost executor costs its blocks only.  The best
end's predecessors are then followed back through the diagonals.  Sums are added up in the order of the chain, so they equal those of a single pass to the last bit.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoline.operators import primitives as P

#: Rows of a block.
BLOCK = 50_000
POINT, SLAB, BAND, PASSED, CORNER, POINTER, TAKEN = range(7)
NOTHING = (0.0, 0, -1, -1, -1)


def ranked(df: DataFrame, keys: list[str], x: str, y: str, tie: str | None, width: int) -> DataFrame:
    """Add ``__n`` (place in the order of x, y and ``tie``), ``__xr`` and ``__yr`` (places of the first row of equal x, of equal y)."""
    more = [tie] if tie else []
    s = P.scan(df, keys, [x, y, *more], P.slice_of(x, width), {"__n": P.row_index(), "__p": P.previous(F.col(x))})
    s = P.scan(P.stage(s), keys, ["__n"], P.slice_of(x, width), {"__xr": P.last_known(F.when(F.col("__p").isNull() | (F.col("__p") < F.col(x)), F.col("__n")))}).drop("__p")
    s = P.scan(P.stage(s), keys, [y, "__n"], P.slice_of(y, width), {"__m": P.row_index(), "__p": P.previous(F.col(y))})
    s = P.scan(P.stage(s), keys, ["__m"], P.slice_of(y, width), {"__yr": P.last_known(F.when(F.col("__p").isNull() | (F.col("__p") < F.col(y)), F.col("__m")))})
    return s.drop("__p", "__m")


def _better(a: tuple, b: tuple) -> tuple:
    """The heavier end; on equal sums the one of the lower tie."""
    return b if b[0] > a[0] or b[0] == a[0] and b[1] < a[1] else a


def _staircase(entries: list[tuple]) -> tuple[list, list]:
    """Places and best ends up to there, out of (place, end)."""
    places, ends = [], []
    for place, end in sorted(entries, key=lambda e: (e[0], -e[1][0], e[1][1])):
        if not ends or _better(ends[-1], end) is end and end != ends[-1]:
            if places and places[-1] == place:
                ends[-1] = end
            else:
                places.append(place)
                ends.append(end)
    return places, ends


def _below(stairs: tuple[list, list], place) -> tuple:
    k = bisect.bisect_left(stairs[0], place)
    return stairs[1][k - 1] if k else NOTHING


def solve_block(points: list[tuple], slab: list[tuple], band: list[tuple], corner: tuple, i: int, j: int) -> tuple[list[tuple], list[tuple]]:
    """Best end per point (x, y, weight, tie, n) sorted by x, as (sum, tie, n, i, j), and each one's predecessor."""
    slab, band = _staircase(slab), _staircase(band)
    levels = {v: k + 1 for k, v in enumerate(sorted({p[1] for p in points}))}
    tree = [NOTHING] * (len(levels) + 1)
    ends, came = [], []
    start = 0
    while start < len(points):
        stop = start
        while stop < len(points) and points[stop][0] == points[start][0]:
            x, y, weight, tie, n = points[stop]
            top = _better(_better(corner, _below(slab, x)), _below(band, y))
            k = levels[y] - 1
            while k > 0:
                top = _better(top, tree[k])
                k -= k & -k
            if top[0] > 0 and top[0] + weight > weight:
                ends.append((top[0] + weight, tie, n, i, j))
                came.append(top[2:])
            else:
                ends.append((weight, tie, n, i, j))
                came.append((-1, -1, -1))
            stop += 1
        for at in range(start, stop):  # equal x can't follow one another
            k = levels[points[at][1]]
            while k < len(tree):
                tree[k] = _better(tree[k], ends[at])
                k += k & -k
        start = stop
    return ends, came


_COLS = ["kind", "a", "b", "best", "tie", "n", "pi", "pj", "came_n", "came_i", "came_j"]
_TYPES = "kind int, a bigint, b bigint, best double, tie bigint, n bigint, pi bigint, pj bigint, came_n bigint, came_i bigint, came_j bigint, __i bigint, __j bigint"


def _framed(rows: list[tuple], pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[*_COLS, "__i", "__j"])
    for c in keys:
        out[c] = [pdf[c].iloc[0]] * len(out)
    return out


def _block(keys: list[str], side: int):
    """Solve a cell: results of its points, and what its neighbours need, addressed to them.  A cell without points passes on what it got."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["__i"].iloc[0]), int(pdf["__j"].iloc[0])
        kind = pdf["kind"].to_numpy()

        def entries(k: int) -> list[tuple]:
            return [(a, tuple(end)) for a, *end in pdf.loc[kind == k, ["a", "best", "tie", "n", "pi", "pj"]].itertuples(index=False, name=None)]

        slab, band, top = entries(SLAB), entries(BAND), NOTHING
        corner = NOTHING
        for _, end in entries(CORNER):
            corner = _better(corner, end)
        for _, end in entries(PASSED):
            top = _better(top, end)
        points = list(pdf.loc[kind == POINT].sort_values(["a", "b", "n"])[["a", "b", "best", "tie", "n"]].itertuples(index=False, name=None))
        ends, came = solve_block(points, slab, band, corner, i, j)
        for end in ends:
            top = _better(top, end)
        top, none = _better(top, corner), (-1, -1, -1)
        rows = [(POINT, p[0], p[1], *end, *back, i, j) for p, end, back in zip(points, ends, came)]
        for k, old, at, to in ((SLAB, slab, 0, (i, j + 1)), (BAND, band, 1, (i + 1, j))):
            if max(to) < side:
                rows += [(k, place, 0, *end, *none, *to) for place, end in zip(*_staircase([*old, *((p[at], end) for p, end in zip(points, ends))]))]
                rows.append((PASSED, 0, 0, *top, *none, *to))
        if max(i, j) + 1 < side or i == j:
            rows.append((CORNER, 0, 0, *top, *none, i + 1, j + 1))
        return _framed(rows, pdf, keys)

    return run


def _followed(keys: list[str], diagonal: int):
    """The chain's part in one cell, backwards from the pointer: its places, and where it goes on.  Pointers to other diagonals stay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pointers = pdf[pdf["kind"] == POINTER]
        if not len(pointers):
            return _framed([], pdf, keys)
        i, j, at = int(pdf["__i"].iloc[0]), int(pdf["__j"].iloc[0]), int(pointers["n"].iloc[0])
        if i + j != diagonal:
            return pointers
        own = pdf[pdf["kind"] == POINT]
        back = {n: came for n, *came in own[["n", "came_n", "came_i", "came_j"]].itertuples(index=False, name=None)}
        rows, came, rest = [], (at, i, j), (-1, -1, -1)
        while came[0] in back:
            rows.append((TAKEN, 0, 0, 0.0, 0, came[0], *rest[:2], *rest, i, j))
            came = back[came[0]]
        if came[0] >= 0:
            rows.append((POINTER, 0, 0, 0.0, 0, came[0], *rest[:2], *rest, came[1], came[2]))
        return _framed(rows, pdf, keys)

    return run


def heaviest(points: DataFrame, keys: list[str], x: str, y: str, weight: str | None, tie: str | None, width: int, block: int = BLOCK) -> DataFrame:
    """The rows of the heaviest chain of every group, ``weight`` (1 where None) summed up.

    ``tie``: the column that decides between equal sums, the lower wins; where None, the place in the order of x, y and weight.
    x and y are whole numbers.  A cell has up to ``block`` rows unless more share one x or one y.
    """
    names = points.columns
    r = P.stage(ranked(points, keys, x, y, weight, width))
    sizes = P.stage(r.groupBy(*keys).agg(F.count("*").alias("__size")))
    most = sizes.agg(F.max("__size")).first()[0]
    if not most:
        return points
    side = max(1, math.ceil(math.sqrt(most / block)))

    def laid(side: int) -> DataFrame:
        place = lambda c: F.floor(F.col(c) * F.lit(side) / F.col("__size"))
        return r.join(sizes, keys).withColumns({"__i": place("__xr"), "__j": place("__yr")})

    while side < most / block and laid(side).groupBy(*keys, "__i", "__j").count().agg(F.max("count")).first()[0] > block:
        side *= 2
    tied, none = F.col(tie) if tie else F.col("__n"), F.lit(-1).cast("bigint")
    cols = [*keys, *_COLS, "__i", "__j"]
    kinds = {f.name: f.dataType.simpleString() for f in points.select(*keys).schema}
    schema = ", ".join([_TYPES, *(f"{k} {kinds[k]}" for k in keys)])
    grid = P.stage(laid(side).select(
        *keys, F.lit(POINT).alias("kind"), F.col(x).cast("bigint").alias("a"), F.col(y).cast("bigint").alias("b"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("best"),
        tied.cast("bigint").alias("tie"), F.col("__n").alias("n"), *(none.alias(c) for c in _COLS[6:]), "__i", "__j", (F.col("__i") + F.col("__j")).alias("__d")), "__d")
    at, steps = [*keys, "__i", "__j"], []

    def diagonal(df: DataFrame, d: int) -> DataFrame:
        return df.filter(F.col("__i") + F.col("__j") == d).select(*cols)

    for d in range(2 * side - 1):
        asked = grid.filter(F.col("__d") == d).select(*cols)
        for sent in steps[-2:]:
            asked = asked.unionByName(diagonal(sent.filter(F.col("kind") != POINT), d))
        steps.append(P.stage(asked.groupBy(*at).applyInPandas(_block(keys, side), schema).select(*cols)))
    last = steps[-1].filter((F.col("kind") == CORNER) & (F.col("__i") == side))
    pointer = last.withColumns({"kind": F.lit(POINTER), "__i": F.col("pi"), "__j": F.col("pj")}).select(*cols)
    taken = []
    for d in reversed(range(2 * side - 1)):
        both = steps[d].filter(F.col("kind") == POINT).unionByName(pointer)
        step = P.stage(both.groupBy(*at).applyInPandas(_followed(keys, d), schema).select(*cols))
        taken.append(step.filter(F.col("kind") == TAKEN).select(*keys, "n"))
        pointer = step.filter(F.col("kind") == POINTER)
    found = taken[0]
    for more in taken[1:]:
        found = found.unionByName(more)
    return r.join(found.withColumnRenamed("n", "__n"), [*keys, "__n"], "left_semi").select(*names)
