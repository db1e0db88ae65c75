"""Pieces of words to chunk rows: words become stable as the next one begins, the last one may be half a word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import CHUNK, PIECES
from .lifecycle import InOrder, chunk_dicts, keyed
from .state import Pieces

FIELDS = [f.split()[0] for f in CHUNK.split(", ")]
WORD = "text string, audio_start double, audio_end double, confidence double"
NAMES = [f.split()[0] for f in WORD.split(", ")]


def _pieces(row: dict) -> list[tuple[str, float, float]]:
    return [(p["piece"], p["start"], p["logp"]) for p in row["pieces"] or []]


def chunk_of(drain: Pieces, row: dict) -> dict:
    """The chunk row of one row of pieces."""
    said = drain.push(_pieces(row), row["at"], bool(row["last"]))
    return {k: row.get(k) for k in FIELDS} | {"words": said and said["stable"], "tentative": said and said["tentative"], "segments": None, "fragment": bool(said and said["fragment"])}


def _frame(chunks: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([x[c] for x in chunks], dtype=object) for c in FIELDS})


class PieceDrain(InOrder):
    """Rows of pieces of one session to its chunk rows."""

    lists = {"words": WORD, "pending": "piece string, start double, logp double"}
    values = {"clock": "at double, chunk_no bigint"}

    def __init__(self, idle_ms: int | None) -> None:
        super().__init__(idle_ms)

    def load(self, session: int, rows: dict[str, list[tuple]] | None) -> dict:
        thing = {"session_id": session, "drain": Pieces(), "at": 0.0, "chunk_no": -1}
        if rows is not None:
            thing["at"], thing["chunk_no"] = rows["clock"][0]
            thing["drain"].words = [dict(zip(NAMES, r, strict=True)) for r in rows["words"]]
            thing["drain"].pending = [tuple(r) for r in rows["pending"]]
        return thing

    def rows(self, thing: dict) -> dict[str, list[tuple]]:
        return {"clock": [(thing["at"], thing["chunk_no"])], "words": [tuple(w[n] for n in NAMES) for w in thing["drain"].words], "pending": list(thing["drain"].pending)}

    def push(self, thing: dict, row: dict) -> list[dict]:
        thing["at"], thing["chunk_no"] = row["at"], row["chunk_no"]
        return [chunk_of(thing["drain"], row)]

    def is_last(self, row: dict) -> bool:
        return bool(row["last"])

    def finish(self, thing: dict) -> list[dict]:
        end = {"session_id": thing["session_id"], "chunk_no": thing["chunk_no"] + 1, "at": thing["at"], "pieces": None, "speaking": False, "lag": 0.0, "score": None, "last": True}
        return self.push(thing, end)

    def frame(self, session: int, out: list[dict]) -> pd.DataFrame:
        return _frame(out)


def drained(rows: DataFrame, idle: float | None = None) -> DataFrame:
    """Chunk rows (CHUNK) of a streaming DataFrame of pieces (PIECES); see :func:`session_events` for order and ends."""
    return keyed(rows, PIECES, idle, PieceDrain, CHUNK)


def drained_batch(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The same of a table; a task holds one session's open word and the words of its last seconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, drain = None, None
        for batch in batches:
            for key, group in batch.groupby("session_id", sort=False):
                if now != key:
                    now, drain = key, Pieces()
                yield _frame([chunk_of(drain, r) for r in chunk_dicts(group)])

    kept = rows.where("session_id IS NOT NULL").select(*(f.split()[0] for f in PIECES.split(", ")))
    dealt = (kept.repartition("session_id") if parts is None else kept.repartition(parts, "session_id")).sortWithinPartitions("session_id", "chunk_no")
    return dealt.mapInPandas(run, CHUNK)
