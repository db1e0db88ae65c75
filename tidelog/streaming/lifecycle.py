"""The life of a session in a stream: typed keyed state, one value for each thing that a session remembers, timers on
event time for sessions that fall silent, and removal when a session is over."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import accumulate, batched, pairwise
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.polish import Chain
from ..policy import Policy
from ..schema import CHUNK, EVENT, FRAME
from .models import Session
from .state import Cluster, Coordinator

COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
EVENTS = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in EVENT.split(", "))])
#: One row each.
VALUES = {
    "clock": "at double, seq bigint, onset boolean, degraded boolean, turn int, speaker string, turn_unnamed boolean, scored_at double, score double, context string",
    "frontier": "frontier double, place double, text string, since double",
    "endpoint": "silence_since double, fired boolean, had_speech boolean",
    "voices": "minted int",
    "parts": "data binary",
}
#: Any number of rows, each list bounded by the policy or by an utterance.
LISTS = {
    "seen": "place double, text string",
    "heard": "final boolean, text string, audio_start double, audio_end double, confidence double",
    "rings": "index int, last_heard double, vector array<double>, weight double",
    "spans": "start double, end double, index int",
    "open_words": "seq bigint, start double, end double",
    "utterance": "seq bigint, text string",
}
MAPS = {"merged": ("index int", "older int")}
#: Chunks that wait for one before them; beyond so many the missing ones count as lost.
MOST_WAITING = 10_000
#: Of those that wait, rows in one value of the state.
PACK_ROWS = 1_000


def plain(value):
    """Rows, dicts and arrays as dicts and lists."""
    if hasattr(value, "asDict"):
        return value.asDict(True)
    if isinstance(value, dict):
        return value
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0) else value


def chunk_dicts(frame: pd.DataFrame) -> list[dict]:
    """Rows in chunk order; without words, tentative words or segments where they are null."""
    out = []
    for r in frame.sort_values("chunk_no").to_dict("records"):
        for k in ("words", "tentative", "segments", "pieces"):
            if k in r:
                r[k] = None if r[k] is None else [x if type(x) is dict else plain(x) for x in r[k]]
        for s in r.get("segments") or []:
            s["embedding"] = [float(x) for x in s["embedding"]]
        out.append(r)
    return out


def values(a: pa.Array, top: bool = True) -> list:
    """Arrow values as plain ones, made of an array's flat parts: a nested value of its own for each costs many times more.
    A double that is null is NaN unless it lies inside a list, as in a DataFrame."""
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        out = [dict(zip(names, r, strict=True)) for r in zip(*(values(x, top) for x in a.flatten()), strict=True)]
    elif pa.types.is_list(a.type):
        flat = values(a.flatten(), False)
        out = [flat[i:j] for i, j in pairwise(accumulate(a.value_lengths().fill_null(0).to_pylist(), initial=0))]
    elif pa.types.is_floating(a.type) and (top or not a.null_count):
        return a.to_numpy(zero_copy_only=False).tolist()
    else:
        return a.to_pylist()
    return [v if ok else None for v, ok in zip(out, a.is_valid().to_pylist(), strict=True)] if a.null_count else out


def table_dicts(table: pa.Table) -> list[dict]:
    """Rows of a table in chunk order."""
    rows = [r for batch in table.to_batches() for r in values(batch.to_struct_array())]
    return sorted(rows, key=lambda r: (r["chunk_no"] is None, r["chunk_no"]))


def _packed(rows: pa.Array) -> pa.Array:
    return pa.array([pickle.dumps(r) for r in values(rows)], pa.binary())


def event_rows(session: int, events: list[dict]) -> list[tuple]:
    return [(session, *map(e.get, COLUMNS[1:])) for e in events]


def event_frame(session: int, events: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(event_rows(session, events), columns=COLUMNS, dtype=object)


def event_table(session: int, events: list[dict]) -> pa.Table:
    rows = event_rows(session, events)
    return pa.table([pa.array([r[i] for r in rows], f.type, from_pandas=True) for i, f in enumerate(EVENTS)], schema=EVENTS)


def taken_apart(c: Coordinator) -> dict[str, list[tuple]]:
    """What the coordinator remembers, as rows of VALUES, LISTS and MAPS."""
    held = c.commits.held or {"name": (None, None), "since": None}
    heard = c.heard or {"stable": [], "tentative": []}
    word = lambda final, w: (final, w["text"], w["audio_start"], w["audio_end"], w["confidence"])
    return {
        "clock": [(c.at, c.seq, c.onset, c.degraded, c.turn, c.speaker, c.turn_unnamed, c.scored_at, c.score, c.context)],
        "frontier": [(c.commits.frontier, *held["name"], held["since"])],
        "endpoint": [(c.endpoint.silence_since, c.endpoint.fired, c.endpoint.had_speech)],
        "voices": [(c.tracker.minted,)],
        "seen": sorted(c.commits.seen),
        "heard": [word(True, w) for w in heard["stable"]] + [word(False, w) for w in heard["tentative"]],
        "rings": [(k.index, k.last_heard, list(v), w) for k in c.tracker.clusters for v, w in k.ring],
        "spans": list(c.tracker.spans),
        "open_words": list(c.open_words),
        "utterance": list(c.utterance),
        "merged": sorted(c.tracker.merged.items()),
    }


def put_together(policy: Policy, chain: Chain | None, rows: dict[str, list[tuple]]) -> Coordinator:
    """The coordinator that :func:`taken_apart` gave these rows of."""
    c = Coordinator(policy, chain=chain)
    c.at, c.seq, c.onset, c.degraded, c.turn, c.speaker, c.turn_unnamed, c.scored_at, c.score, c.context = rows["clock"][0]
    c.commits.frontier, place, text, since = rows["frontier"][0]
    c.commits.held = None if since is None else {"name": (place, text), "since": since}
    c.commits.seen = {tuple(r) for r in rows["seen"]}
    c.endpoint.silence_since, c.endpoint.fired, c.endpoint.had_speech = rows["endpoint"][0]
    (c.tracker.minted,) = rows["voices"][0]
    said = [(r[0], dict(zip(("text", "audio_start", "audio_end", "confidence"), r[1:], strict=True))) for r in rows["heard"]]
    c.heard = {"stable": [w for final, w in said if final], "tentative": [w for final, w in said if not final]} if said else None
    for index, last_heard, vector, weight in rows["rings"]:
        if not c.tracker.clusters or c.tracker.clusters[-1].index != index:
            c.tracker.clusters.append(Cluster(index, [], last_heard))
        c.tracker.clusters[-1].ring.append((list(vector), weight))
    c.tracker.spans = [tuple(r) for r in rows["spans"]]
    c.tracker.merged = dict(tuple(r) for r in rows["merged"])
    c.open_words, c.utterance = ([tuple(r) for r in rows[k]] for k in ("open_words", "utterance"))
    return c


def take_frame(session: Session, frame: dict) -> list[dict]:
    """The events of one frame: audio is pushed, `finish` ends, anything else is nothing."""
    if frame["kind"] == "finish":
        return session.finish()
    if frame["kind"] != "audio":
        return []
    quiet = frame["words"] is None and frame["tentative"] is None
    said = None if quiet else {"stable": frame["words"] or [], "tentative": frame["tentative"] or [], "fragment": bool(frame["fragment"])}
    return session.push(bytes(frame["pcm"] or b""), frame["lag"] or 0.0, said)


class InOrder(StatefulProcessor):
    """Rows of one session, taken once each in the order of chunk_no, by a thing that lies in typed state between
    triggers. A subclass says what the thing is and how it is kept."""

    values: dict[str, str] = {}
    lists: dict[str, str] = {}
    maps: dict[str, tuple[str, str]] = {}

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    # what a subclass gives
    def load(self, session: int, rows: dict[str, list[tuple]] | None) -> Any: ...

    def rows(self, thing: Any) -> dict[str, list[tuple]]: ...

    def push(self, thing: Any, row: dict) -> list: ...

    def is_last(self, row: dict) -> bool: ...

    def finish(self, thing: Any) -> list: ...

    def frame(self, session: int, out: list) -> pd.DataFrame: ...

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = {"place": "next bigint, due bigint", "over": "over boolean"}
        self.value = {k: handle.getValueState(k, s) for k, s in (own | self.values).items()}
        self.list = {k: handle.getListState(k, s) for k, s in self.lists.items()}
        self.map = {k: handle.getMapState(k, *s) for k, s in self.maps.items()}
        # packs of rows: read and written as a whole, and a typed row would be converted value by value on both sides
        self.waiting = handle.getListState("waiting", "data binary")

    def _load(self, session: int) -> tuple[Any, int, int | None]:
        place = self.value["place"].get()
        if place is None:
            self.had = set()
            return self.load(session, None), 0, None
        rows = {k: [r] for k in self.values if (r := self.value[k].get()) is not None} | {k: list(v.get()) for k, v in self.list.items()}
        rows |= {k: [(*a, *b) for a, b in v.iterator()] for k, v in self.map.items()}
        self.had = {"place"} | {k for k, found in rows.items() if found}  # each call to the state costs, also one that clears nothing
        return self.load(session, rows), *place

    def _keep(self, thing: Any, nxt: int, due: int | None) -> None:
        rows = self.rows(thing)
        self.value["place"].update((nxt, due))
        for k in self.values:
            if k in rows:
                self.value[k].update(rows[k][0])
        for k, v in self.list.items():
            if rows[k]:
                v.put(rows[k])
            elif k in self.had:
                v.clear()
        for k, v in self.map.items():
            if k in self.had:
                v.clear()
            for key, *rest in rows[k]:
                v.updateValue((key,), tuple(rest))

    def _forget(self, due: int | None) -> None:
        for k, v in (self.value | self.list | self.map | {"waiting": self.waiting}).items():
            if k in self.had:
                v.clear()
        if due is not None:  # chunks that are sent again find the session over, until its timer
            self.value["over"].update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        new, arrived = {}, None
        for frame in rows:
            if self.idle_ms is not None and len(frame):
                arrived = max(int(frame["arrived_ms"].max()), arrived or 0)
            frame = frame[frame["chunk_no"].notna()]
            new |= {int(n): bytes(data) for n, data in zip(frame["chunk_no"], frame["data"], strict=True)}
        if not new or self.value["over"].exists():
            return
        thing, nxt, due = self._load(key[0])
        stored = self._stored() if self.had else {}
        wait = {k for k in (*stored, *new) if k >= nxt}
        out, over = [], False
        while not over and (nxt in wait or len(wait) > MOST_WAITING):
            nxt = nxt if nxt in wait else min(wait)
            row = pickle.loads(new[nxt] if nxt in new else stored[nxt])
            out += self.push(thing, row)
            over = self.is_last(row)
            wait.discard(nxt)
            nxt += 1
        if arrived is not None:
            due = self._timer(due, arrived)
        if over:
            self._forget(due)
        else:
            rows_of = lambda ks, src: [(pickle.dumps({k: src[k] for k in pack}),) for pack in batched(sorted(ks), PACK_ROWS)]
            if wait.issuperset(stored):  # nothing of what waits has been taken
                if fresh := rows_of(wait.difference(stored), new):
                    self.waiting.appendList(fresh)
            elif wait:
                self.waiting.put(rows_of(wait, stored | new))
            else:
                self.waiting.clear()
            self._keep(thing, nxt, due)
        if out:
            yield self.frame(key[0], out)

    def _stored(self) -> dict[int, bytes]:
        """The rows that wait, packed, by chunk_no."""
        out = {n: row for (data,) in self.waiting.get() for n, row in pickle.loads(data).items()}
        self.had |= {"waiting"} if out else set()
        return out

    def _timer(self, due: int | None, arrived: int) -> int:
        """One timer for each session, so long behind its last row."""
        at = max(arrived + self.idle_ms, due or 0)
        if at != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.value["over"].exists() or not self.value["place"].exists():
            self.value["over"].clear()
            return
        thing, _, _ = self._load(key[0])
        out, over = [], False
        for _, data in sorted(self._stored().items()):  # what never came is lost
            if not over:
                row = pickle.loads(data)
                out += self.push(thing, row)
                over = self.is_last(row)
        out += [] if over else self.finish(thing)
        self._forget(None)
        if out:
            yield self.frame(key[0], out)

    def close(self) -> None:
        pass


class SessionLog(InOrder):
    """Chunk rows of one session to its events. With `make`, rows are frames of audio for the parts of a session: the
    coordinator's state is typed as well, that of the parts is theirs to pickle."""

    values, lists, maps = VALUES, LISTS, MAPS

    def __init__(self, policy: Policy, idle_ms: int | None, make: Callable[[int], Session] | None = None) -> None:
        super().__init__(idle_ms)
        self.policy, self.make = policy, make

    def load(self, session: int, rows: dict[str, list[tuple]] | None) -> Session | Coordinator:
        thing = self.make(session) if self.make else Coordinator(self.policy)
        if rows is None:
            return thing
        if not self.make:
            return put_together(self.policy, thing.chain, rows)
        thing.coordinator = put_together(self.policy, thing.coordinator.chain, rows)
        thing.recall(pickle.loads(rows["parts"][0][0]))
        return thing

    def rows(self, thing: Session | Coordinator) -> dict[str, list[tuple]]:
        if not self.make:
            return taken_apart(thing)
        return taken_apart(thing.coordinator) | {"parts": [(pickle.dumps(thing.remembered()),)]}

    def push(self, thing: Session | Coordinator, row: dict) -> list[dict]:
        return take_frame(thing, row) if self.make else thing.push(row)

    def is_last(self, row: dict) -> bool:
        return row["kind"] == "finish" if self.make else bool(row["last"])

    def finish(self, thing: Session | Coordinator) -> list[dict]:
        return thing.finish() if self.make else thing.push(finish_row(thing.at))

    def frame(self, session: int, out: list[dict]) -> pd.DataFrame:
        return event_frame(session, out)


def finish_row(at: float) -> dict:
    """The row that ends a session whose last row never came."""
    return {"at": at, "speaking": False, "lag": 0.0, "score": None, "words": None, "tentative": None, "segments": None, "last": True, "fragment": False}


def session_events(rows: DataFrame, policy: Policy, idle: float | None = None, make: Callable[[int], Session] | None = None) -> DataFrame:
    """Events (EVENT) of a streaming DataFrame of chunk rows (CHUNK) or, with `make`, audio frames (FRAME).

    Rows of a session can come in any order; each is taken once, in the order of chunk_no. The row that says `last`, or
    a frame `finish`, ends the session and removes its state. With `idle` seconds, rows need a column `arrived`
    (timestamp) with a watermark: a session that gets no row for so long by event time is finished as it stands, and one
    that has ended is remembered so long for rows that are sent again. Rows without a chunk_no only move the clock.
    """
    row = FRAME if make else CHUNK
    return keyed(rows, row, idle, lambda ms: SessionLog(policy, ms, make), EVENT)


def keyed(rows: DataFrame, row: str, idle: float | None, processor: Callable[[int | None], InOrder], out: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    arrived = [] if idle is None else ["arrived", F.unix_millis("arrived").alias("arrived_ms")]
    # rows are packed before they are dealt: what is grouped, waits and is read again is one value a row
    whole = F.struct(*(f.split()[0] for f in row.split(", ")))
    dealt = rows.select("session_id", "chunk_no", F.arrow_udf(_packed, "binary")(whole).alias("data"), *arrived).groupBy("session_id")
    return dealt.transformWithStateInPandas(processor(None if idle is None else int(idle * 1000)), out, "append", "None" if idle is None else "EventTime")
