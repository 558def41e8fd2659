"""Anchors arriving one window at a time, kept consistent as they come."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from versoline.operators import anchors as A
from versoline.operators import primitives as P

ROW = "audio_ms bigint, char_offset int, confidence double"
OUT = "book_id bigint, chapter_idx int, seq bigint, audio_ms bigint, char_offset int, confidence double, accepted boolean"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Chapter:
    """Anchors of one chapter in order; an arrival must fit between both neighbours."""

    def __init__(self, anchors: list[tuple[int, int, float]] | None = None):
        self.anchors = sorted(anchors or [])

    def insert(self, at: int, offset: int, confidence: float) -> bool:
        i = bisect.bisect_left(self.anchors, (at,))
        below = self.anchors[i - 1] if i else None
        above = self.anchors[i] if i < len(self.anchors) else None
        fits = (below is None or below[1] < offset) and (above is None or (above[0] > at and above[1] > offset))
        if fits:
            self.anchors.insert(i, (at, offset, confidence))
        return fits

    def rebuild(self, refused: list[tuple[int, int, float]]) -> None:
        """Let the majority decide between what is stored and what a window heard."""
        rows = sorted([*self.anchors, *refused])
        x, y, w = (np.array([r[i] for r in rows]) for i in range(3))
        self.anchors = [r for r, keep in zip(rows, A._heaviest(x, y, w)) if keep]


def insert_in_order(arrivals: DataFrame) -> DataFrame:
    """Batch form: arrivals of each chapter in ``seq`` order, with whether each was accepted.

    The state of a chapter is its map; the arrivals themselves stream through.
    """
    class Step:
        def __init__(self):
            self.chapter = Chapter()

        def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
            rows = zip(*(pdf[c].tolist() for c in ("audio_ms", "char_offset", "confidence")))
            return pdf.assign(accepted=[self.chapter.insert(int(a), int(c), float(w)) for a, c, w in rows])[COLUMNS]

    cols = [c for c in COLUMNS if c != "accepted"]
    return P.fold_in_order(arrivals.select(*cols), A.CHAPTER, ["seq"], Step, OUT)


class InsertAnchors(StatefulProcessor):
    """Streaming form; a window mostly refused rebuilds its chapter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getListState("anchors", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chapter = Chapter([tuple(r) for r in self.stored.get()])
        incoming = pd.concat(list(rows)).sort_values("seq")
        out = []
        for _, window in incoming.groupby("window_id", sort=False):
            accepted, refused = 0, []
            for e in window.itertuples(index=False):
                anchor = (int(e.audio_ms), int(e.char_offset), float(e.confidence))
                ok = chapter.insert(*anchor)
                accepted += ok
                if not ok:
                    refused.append(anchor)
                out.append((key[0], key[1], int(e.seq), *anchor, ok))
            if len(refused) > accepted and len(refused) > 1:
                chapter.rebuild(refused)
        self.stored.put(chapter.anchors)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_insert(arrivals: DataFrame) -> DataFrame:
    """``arrivals(book_id, chapter_idx, seq, window_id, audio_ms, char_offset, confidence)`` as a stream."""
    return arrivals.groupBy(*A.CHAPTER).transformWithStateInPandas(InsertAnchors(), outputStructType=OUT, outputMode="Append", timeMode="None")
