"""Text that arrives in pieces, given out block by block: a block is held until its end has come, or its time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUT = "doc string, block int, start int, text string, how string"


def cut(held: str, at: int, number: int, separator: str, final: bool) -> tuple[list[tuple[int, int, str]], str, int, int]:
    """([(number, start, text)] of the blocks that are whole, what is still held, its start, the next number). Blank blocks count but aren't given."""
    parts = held.split(separator)
    whole = parts if final else parts[:-1]
    out = []
    for part in whole:
        if part.strip():
            out.append((number, at, part))
        at, number = at + len(part) + len(separator), number + 1
    return out, "" if final else parts[-1], at, number


class BlockBuffer(StatefulProcessor):
    """Holds the open block of each document. Pieces are taken by their number, once each, and those that come too early wait."""

    def __init__(self, separator: str, patience_ms: int):
        self.separator, self.patience = separator, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "held string, start int, block int, next int, closed boolean")
        self.early = handle.getMapState("early", "seq int", "piece string, final boolean")

    def _state(self) -> list:
        return list(self.open.get()) if self.open.exists() else ["", 0, 0, 0, False]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, start, block, following, closed = self._state()
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if not closed and r.seq >= following and not self.early.containsKey((r.seq,)):
                self.early.updateValue((int(r.seq),), (r.piece or "", bool(r.final)))
        while not closed and self.early.containsKey((following,)):
            piece, final = self.early.getValue((following,))
            self.early.removeKey((following,))
            blocks, held, start, block = cut(held + piece, start, block, self.separator, final)
            out += [(key[0], *b, "final" if final and b is blocks[-1] else "closed") for b in blocks]
            following, closed = following + 1, final
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held and not closed:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience)
        self.open.update((held, start, block, following, closed))
        yield pd.DataFrame(out, columns=["doc", "block", "start", "text", "how"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came in time: what is held goes out, and the rest of the block, should it come, is a block of its own."""
        held, start, block, following, closed = self._state()
        self.open.update(("", start + len(held), block + 1, following, closed))
        yield pd.DataFrame([(key[0], block, start, held, "late")] if held.strip() else [], columns=["doc", "block", "start", "text", "how"])

    def close(self) -> None:
        pass


def blocks(pieces: DataFrame, late: str = "1 minute", patience_ms: int = 10_000, separator: str = "\n\n") -> DataFrame:
    """(doc, block, start, text, how) of a stream of pieces (doc, seq, at, piece, final): whole blocks with their places in the document.

    how: closed (the separator has come), final (the document has ended) or late (the watermark has passed the patience
    since the last piece). Pieces may repeat and come in any order. The session's state store must be RocksDB's.
    """
    rows = pieces.withWatermark("at", late).select("doc", F.col("seq").cast("int").alias("seq"), "at", "piece", "final")
    return rows.groupBy("doc").transformWithStateInPandas(statefulProcessor=BlockBuffer(separator, patience_ms), outputStructType=OUT, outputMode="append", timeMode="eventTime")
