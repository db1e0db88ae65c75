"""Audio frames to decisions and logs: sessions lie behind each other in sorted partitions, so that a task holds the
state of one session and one batch of its audio, however long the session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import Policy
from ..schema import EVENT, FRAME, SAMPLE_RATE
from ..streaming.detect import EnergySpeech, SpectralVoices
from ..streaming.lifecycle import chunk_dicts, event_frame, take_frame
from ..streaming.models import Backends, Session, TurnDetector, build, shared_model

FIELDS = [f.split()[0] for f in FRAME.split(", ")]


def in_order(frames: DataFrame, parts: int | None = None) -> DataFrame:
    """parts: how many partitions; else as Spark finds fit by their compressed size, which for audio can be far too few."""
    dealt = frames.repartition("session_id") if parts is None else frames.repartition(parts, "session_id")
    return dealt.sortWithinPartitions("session_id", "chunk_no")


def speech_frames(frames: DataFrame, make: Callable[[], EnergySpeech] = EnergySpeech, parts: int | None = None) -> DataFrame:
    """session_id, frame_no, speaking: the detector's decision behind each whole frame of 512 samples, however the
    audio is cut into rows (session_id, chunk_no, pcm)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, detector, n = None, None, 0
        for batch in batches:
            out = []
            for session, pcm in zip(batch["session_id"], batch["pcm"], strict=True):
                if detector is None or session != now:
                    now, detector, n = session, make(), 0
                for speaking in detector.decide(bytes(pcm or b"")):
                    out.append((session, n, speaking))
                    n += 1
            yield pd.DataFrame(out, columns=["session_id", "frame_no", "speaking"])

    return in_order(frames.select("session_id", "chunk_no", "pcm"), parts).mapInPandas(run, "session_id bigint, frame_no bigint, speaking boolean")


def rolling_audio(frames: DataFrame, wanted: Column, seconds: float = 8.0, text: Column | None = None) -> DataFrame:
    """session_id, chunk_no, text, pcm: the last seconds of audio up to each wanted row of frames. Rows that are not
    wanted only pass through a task's buffer."""
    size = int(seconds * SAMPLE_RATE) * 2
    rows = frames.select("session_id", "chunk_no", "pcm", F.coalesce(wanted, F.lit(False)).alias("wanted"), (F.lit("") if text is None else text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for row in _tails(batches, size):
            out.append(row)
            if len(out) >= ROLLED:
                yield pd.DataFrame(out, columns=["session_id", "chunk_no", "text", "pcm"])
                out = []
        yield pd.DataFrame(out, columns=["session_id", "chunk_no", "text", "pcm"])

    return in_order(rows).mapInPandas(run, "session_id bigint, chunk_no bigint, text string, pcm binary")


def _tails(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple]:
    """session_id, chunk_no, text and the last bytes of audio of each wanted row."""
    now, tail = None, bytearray()
    for batch in batches:
        for session, chunk, pcm, want, said in zip(*(batch[c] for c in ("session_id", "chunk_no", "pcm", "wanted", "text")), strict=True):
            if session != now:
                now, tail = session, bytearray()
            tail += pcm or b""
            if len(tail) > 2 * size:  # now and then, so that a frame costs its own bytes only
                del tail[:-size]
            if want:
                yield session, chunk, said, bytes(tail[-size:])


def rolling_scores(frames: DataFrame, wanted: Column, name: str, make: Callable[[], TurnDetector], seconds: float = 8.0, text: Column | None = None, parts: int | None = None) -> DataFrame:
    """session_id, chunk_no, score: what a turn detector, made once in each worker, says of the audio that
    :func:`rolling_audio` gives. It is scored where it is put together, since tails overlap and are many times the frames."""
    size = int(seconds * SAMPLE_RATE) * 2
    rows = frames.select("session_id", "chunk_no", "pcm", F.coalesce(wanted, F.lit(False)).alias("wanted"), (F.lit("") if text is None else text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, out = shared_model(("turns", name), make), []
        for session, chunk, said, pcm in _tails(batches, size):
            out.append((session, chunk, model.completeness(said or "", pcm)))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["session_id", "chunk_no", "score"])
                out = []
        yield pd.DataFrame(out, columns=["session_id", "chunk_no", "score"])

    return in_order(rows, parts).mapInPandas(run, "session_id bigint, chunk_no bigint, score double")


#: Tails of audio in a batch: 8 s are 256 kB.
ROLLED = 64


def completeness_udf(name: str, make: Callable[[], TurnDetector]):
    """(text, pcm) to the score of a turn detector, which each worker makes once, however many batches and tasks."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared_model(("turns", name), make)
        for text, pcm in batches:
            yield pd.Series([model.completeness(t or "", bytes(p or b"")) for t, p in zip(text, pcm, strict=True)], dtype=float)

    return score


def heard_session(policy: Policy) -> Session:
    """A session that needs no model: speech by energy, voices by spectrum, words with the audio."""
    return build(Backends(None, EnergySpeech, SpectralVoices), policy)


def audio_log(frames: DataFrame, policy: Policy, make: Callable[[int], Session] | None = None, parts: int | None = None) -> DataFrame:
    """The log (EVENT) of each session of frames (FRAME): what :func:`session_events` gives for a stream of them. A
    session without a `finish` is finished behind its last frame; what comes behind a `finish` is nothing."""
    build_one = make or (lambda session: heard_session(policy))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session, over = None, None, True
        for batch in batches:
            for key, group in batch.groupby("session_id", sort=False):
                if now != key:
                    if not over:
                        yield event_frame(now, session.finish())
                    now, session, over = key, build_one(key), False
                events = []
                for row in chunk_dicts(group):
                    if not over:
                        events += take_frame(session, row)
                        over = row["kind"] == "finish"
                yield event_frame(key, events)
        if not over:
            yield event_frame(now, session.finish())

    return in_order(frames.select(*FIELDS).where("session_id IS NOT NULL"), parts).mapInPandas(run, EVENT)


def recorded_frames(recordings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """FRAME rows of recordings (session, chunk_no, pcm) and of what a recogniser said beside each chunk (session,
    chunk_no, words, tentative, fragment). session_id is a hash of the session's name, beside it."""
    good = recordings.where("chunk_no IS NOT NULL")
    said = good if words is None else good.join(words, ["session", "chunk_no"], "left")
    kinds = dict(zip(FIELDS, (f.split(" ", 1)[1] for f in FRAME.split(", ")), strict=True))
    fields = [(F.col(c) if c in said.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in ("pcm", "words", "tentative", "fragment")]
    return said.select("session", F.xxhash64("session").alias("session_id"), "chunk_no", F.lit("audio").alias("kind"), F.lit(0.0).alias("lag"), *fields)
