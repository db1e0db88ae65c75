"""Sessions in a stream: typed state comes and goes, and says what the batch says."""

import collections
import json

import pytest
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.plans import runner
from tidelog.policy import PRESETS
from tidelog.schema import CHUNK, EVENT
from tidelog.streaming.lifecycle import session_events

KEYS = ["session_id", "seq", "kind", "at", "text", "speaker", "target_seq", "reason", "turn"]


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chunks") / "c")
    runner.chunk_rows(spark, DATA).where("session_id < 12").write.parquet(path)
    return spark.read.parquet(path)


def replay(source, root, **k):
    """The rows of the log and the progress of each step."""
    query = session_events(source, **k).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/log")
    query.awaitTermination()
    return [tuple(r[c] for c in KEYS) for r in source.sparkSession.read.schema(EVENT).parquet(f"{root}/log").collect()], [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def test_state_is_gone_behind_the_last_row(spark, chunks, tmp_path):
    want = [tuple(r[c] for c in KEYS) for r in runner.run_batch(chunks, PRESETS["conversation"]).collect()]
    root = str(tmp_path)
    got, states = replay(runner.as_source(chunks, root, 3, 60.0, files=1), root, policy=PRESETS["conversation"], idle=60.0)
    assert collections.Counter(got) == collections.Counter(want) and want
    assert max(s["numRowsTotal"] for s in states) > 12 and states[-1]["numRowsTotal"] == 0


def test_idle_sessions_are_finished(spark, chunks, tmp_path):
    """Sessions whose end never came, and one that lost a chunk: a timer ends them, and a late chunk is no new session."""
    cut = chunks.where("chunk_no < 40 AND NOT last").where("NOT (session_id = 3 AND chunk_no = 7)")
    root = str(tmp_path)
    source = runner.as_source(cut, root, 2, 30.0, files=1)
    got, states = replay(source, root, policy=PRESETS["conversation"], idle=30.0)
    assert states[-1]["numRowsTotal"] == 0
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r[:2]):
        by[r[0]].append(r)
    assert set(by) == {r.session_id for r in cut.select("session_id").distinct().collect()}
    assert all([r[1] for r in log] == list(range(len(log))) for log in by.values())
    last = chunks.sparkSession.createDataFrame([(s, 40, 1e6, False, 0.0, None, None, None, None, True, False) for s in by], CHUNK)
    ended = runner.run_batch(cut.unionByName(last.withColumn("at", F.lit(None).cast("double"))).join(cut.groupBy("session_id").agg(F.max("at").alias("end")), "session_id").withColumn("at", F.coalesce("at", "end")).drop("end"), PRESETS["conversation"])
    assert collections.Counter(got) == collections.Counter(tuple(r[c] for c in KEYS) for r in ended.collect())


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    from tidelog.sources.adapters import audio_frames

    path = str(tmp_path_factory.mktemp("frames") / "f")
    audio_frames(spark, DATA).where("session_id < 5").write.parquet(path)
    return spark.read.parquet(path)


def test_audio_in_a_stream_gives_the_log_of_the_batch(spark, frames, tmp_path):
    from tidelog.plans import audio

    policy = PRESETS["conversation"]
    rows = audio.audio_log(frames, policy).collect()
    want = collections.Counter(tuple(r[c] for c in KEYS) for r in rows)
    assert {"speech_onset", "turn_start", "partial", "commit", "endpoint", "speaker"} <= {r.kind for r in rows}
    assert len({r.speaker for r in rows if r.kind == "commit" and r.speaker}) > 1
    root = str(tmp_path)
    noise = frames.limit(1).selectExpr("session_id", "CAST(1000000 AS BIGINT) AS chunk_no", "'chatter' AS kind", "pcm", "lag", "words", "tentative", "fragment")
    got, states = replay(runner.as_source(frames.unionByName(noise), root, 2, 60.0, files=1), root, policy=policy, idle=60.0, make=lambda session: audio.heard_session(policy))
    assert collections.Counter(got) == want and states[-1]["numRowsTotal"] == 0


def test_speech_does_not_depend_on_chunks(spark, frames):
    """The same samples in rows of 20 ms to a second."""

    from tidelog.plans.audio import speech_frames
    from tidelog.streaming.detect import EnergySpeech

    audio = frames.where("kind = 'audio' AND session_id < 2")
    want = {(r.session_id, r.frame_no): r.speaking for r in speech_frames(audio).collect()}
    assert {True, False} == set(want.values())
    whole = {r.session_id: b"".join(bytes(x.pcm) for x in r.x) for r in audio.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "pcm"))).alias("x")).collect()}
    for seconds in (0.02, 0.0301, 0.3, 1.0):
        size = int(seconds * 16_000) * 2
        rows = [(s, k, bytearray(pcm[at : at + size])) for s, pcm in whole.items() for k, at in enumerate(range(0, len(pcm), size))]
        cut = spark.createDataFrame(rows, "session_id bigint, chunk_no bigint, pcm binary").repartition(3)
        assert {(r.session_id, r.frame_no): r.speaking for r in speech_frames(cut).collect()} == want
    loud, d = b"\x00\x10" * 16_000, EnergySpeech()
    assert d.decide(b"\x05\x00" * 16_000 + loud)[-1] and not any(EnergySpeech().decide(b"\0\0" * 16_000))
    assert not EnergySpeech().decide(loud)[-1]  # what never changes is the floor


class Broken(RuntimeError):
    pass


def test_frames_come_once_whatever_fails(spark, chunks, tmp_path):
    """A query that dies behind its frames, before they count; started again, and then anew without its checkpoint."""
    from tidelog.operators.protocol import encode
    from tidelog.streaming.sink import FrameSink

    class Dying(FrameSink):
        def _mark(self, spark, number, batch):
            if number == 1 and not broken:
                broken.append(number)
                raise Broken
            super()._mark(spark, number, batch)

    want = [(r.session_id, r.seq, r.line) for r in encode(runner.run_batch(chunks, PRESETS["conversation"]), "seq").orderBy("session_id", "seq").collect()]
    # chunks in order, a third at a time
    source = chunks.withColumn("step", F.floor(F.col("chunk_no") * 3 / (F.max("chunk_no").over(Window.partitionBy("session_id")) + 1)))
    for k in range(3):
        source.where(F.col("step") == k).drop("step").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    broken, sink = [], Dying(f"{tmp_path}/out")

    def run(state):
        rows = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        session_events(rows, PRESETS["conversation"]).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="Broken"):
        run("state")
    assert broken and 0 < sink.frames(spark).count() < len(want)
    run("state")
    rows = [tuple(r) for r in sink.frames(spark).collect()]
    assert sorted(rows, key=lambda r: r[:2]) == want
    for session in {r[0] for r in rows}:
        seqs = [r[1] for r in rows if r[0] == session]
        assert len(seqs) == len(set(seqs))
    run("other")
    assert sorted((tuple(r) for r in sink.frames(spark).collect()), key=lambda r: r[:2]) == want
    assert json.loads(want[0][2])["seq"] == 0


def test_recordings_of_a_stream(spark, frames, tmp_path):
    from tidelog.sources.files import parse_wav, recordings
    from tidelog.streaming.sink import RecordingSink

    sink = RecordingSink(f"{tmp_path}/audio")
    frames.repartition(3).write.parquet(f"{tmp_path}/in")
    spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    sink(frames.limit(50), 0)  # a batch that is repeated
    sink(frames, 1)
    wavs = {r.session_id: parse_wav(bytes(r.wav)) for r in recordings(sink.chunks(spark)).collect()}
    whole = {r.session_id: b"".join(bytes(x.pcm) for x in r.x) for r in frames.where("kind = 'audio'").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "pcm"))).alias("x")).collect()}
    assert wavs == {k: (v, []) for k, v in whole.items()}
    sink.write(spark, f"{tmp_path}/files")
    assert {int(p.stem): parse_wav(p.read_bytes()) for p in (tmp_path / "files").glob("*.wav")} == wavs


def test_pieces_in_keyed_state(spark, tmp_path):
    """Any number of pieces a row, out of order over triggers: the chunk rows of the batch; and no half word is final,
    even with early commits."""
    from dataclasses import replace

    from tidelog.plans.registry import _word_pieces, piece_rows
    from tidelog.policy import CommitPolicy
    from tidelog.streaming.drain import drained, drained_batch

    whole = {}
    for r in _word_pieces(spark, DATA).where("conv_id < 3").orderBy("conv_id", "g", "pos").collect():
        whole.setdefault((r.conv_id, r.g), []).append(r.piece)
    want = {s: ["".join(p).strip() for (c, _), p in sorted(whole.items()) if c == s] for s in {k[0] for k in whole}}
    eager = replace(PRESETS["dictation"], commit=CommitPolicy(early=0.5))
    for size in (1, 4, 7):
        rows = piece_rows(spark, DATA, size).where("session_id < 3")
        batch = drained_batch(rows)
        log = runner.run_batch(batch, eager).where("kind = 'commit'").orderBy("session_id", "seq").collect()
        assert {s: [r.text for r in log if r.session_id == s] for s in want} == want
    root = str(tmp_path)
    source = runner.as_source(rows, root, 3, 60.0, files=1)
    query = drained(source, 60.0).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/log")
    query.awaitTermination()
    key = lambda r: (r.session_id, r.chunk_no)
    assert sorted(spark.read.parquet(f"{root}/log").collect(), key=key) == sorted(batch.collect(), key=key)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1] == 0


class Held:
    """A value or a list in memory that counts the calls made to it."""

    def __init__(self, calls):
        self.calls, self.now = calls, None

    def _call(self, what):
        self.calls[what] += 1

    def exists(self):
        self._call("exists")
        return self.now is not None

    def get(self):
        self._call("get")
        return self.now if self.now is not None or not self.many else []

    def update(self, row):
        self._call("update")
        self.now = row

    def put(self, rows):
        self._call("put")
        self.now = list(rows)

    def appendList(self, rows):  # noqa: N802  Spark's name
        self._call("appendList")
        self.now = [*(self.now or []), *rows]

    def iterator(self):
        return iter(())

    def clear(self):
        self._call("clear" if self.now is not None else "clear of nothing")
        self.now = None


def test_rows_wait_in_packs(spark, chunks):
    """rows that wait are one value a pack, not a typed row each; nothing is cleared that isn't there; rows are packed
    by their flat parts."""
    import pandas as pd

    from tidelog.streaming.lifecycle import SessionLog, _packed, values
    from tidelog.streaming.state import Coordinator

    table = chunks.where("session_id = 3").orderBy("chunk_no").toArrow().combine_chunks()
    plain = table.to_pylist()
    assert len(plain) > 60 and values(table.to_batches()[0].to_struct_array()) == plain
    calls, all_held = collections.Counter(), {}

    class Handle:
        def _new(self, name, many):
            all_held[name] = Held(calls)
            all_held[name].many = many
            return all_held[name]

        def getValueState(self, name, *schema):  # noqa: N802
            return self._new(name, False)

        def getListState(self, name, *schema):  # noqa: N802
            return self._new(name, True)

        getMapState = getValueState  # noqa: N815

    policy = PRESETS["conversation"]
    log, got = SessionLog(policy, None), []
    log.init(Handle())
    data = _packed(table.to_batches()[0].to_struct_array()).to_pylist()
    for k in range(3):
        frame = pd.DataFrame({"session_id": 3, "chunk_no": range(k, len(data), 3), "data": data[k::3]})
        got += [r for out in log.handleInputRows((3,), iter([frame]), None) for r in out.itertuples(index=False)]
        assert len(all_held["waiting"].now or []) == (k + 1 if k < 2 else 0)
    c = Coordinator(policy)
    want = [e for r in plain for e in c.push(r)]
    assert [(r.seq, r.kind, r.at, r.text) for r in got] == [(e["seq"], e["kind"], e["at"], e.get("text")) for e in want]
    assert not calls["clear of nothing"] and all(h.now is None for h in all_held.values())


def test_stream_and_batch_read_one_table(spark, monkeypatch):
    """chunk rows are derived once; before, for the batch and for each step of the stream."""
    from tidelog.plans import registry

    read, batch = [], runner.run_batch
    monkeypatch.setattr(runner, "run_batch", lambda rows, policy: read.append(rows.inputFiles()) or batch(rows, policy))
    registry.QUERIES["stream_equals_batch"](spark, DATA)
    assert read[0] and all("tidelog-chunks" in f for f in read[0])
