"""The data source of recordings against the plain reader."""

import collections

import numpy as np
import pytest

from tidelog.sources.files import wav_bytes
from tidelog.sources.recordings import data_range, header, read_recordings, write_recordings


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("wav"), np.random.default_rng(4)
    files = {f"s{k}": rng.integers(-9000, 9000, n).astype("<i2").tobytes() for k, n in enumerate((0, 1, 1600, 16_001, 50_000))}
    (path / "deep").mkdir()
    for i, (name, pcm) in enumerate(files.items()):
        (path / ("deep" if i % 2 else "") / f"{name}.wav").write_bytes(wav_bytes(pcm))
    return path, files


def rows(df):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.session].append((r.chunk_no, r.begin, r.pcm and bytes(r.pcm), r.problems))
    return {k: sorted(v, key=lambda x: (x[0] is None, x[0] or 0)) for k, v in got.items()}


def cut(pcm, size):
    return [(k, k * size // 2, pcm[at : at + size], []) for k, at in enumerate(range(0, len(pcm), size))]


@pytest.mark.parametrize("split", [17, 1000, 3244, 10_007, 1 << 20])
def test_chunks_equal_the_plain_reader(spark, folder, split):
    path, files = folder
    got = rows(read_recordings(spark, str(path), 0.05, max(split, 500) if split < 100 else split))
    assert got == {k: cut(pcm, 1600) for k, pcm in files.items() if pcm}


def test_any_split_of_one_file(tmp_path):
    """Every split size, without Spark: no chunk twice, none lost."""
    from tidelog.sources.recordings import Chunked

    pcm = np.arange(700).astype("<i2").tobytes()
    (tmp_path / "x.wav").write_bytes(wav_bytes(pcm))
    for split in range(1, 1500, 7):
        source = Chunked(str(tmp_path), 64, split)
        got = [(k, pcm_) for s in source.splits(source.listed()) for _, _, k, _, pcm_, _ in source.chunks(s)]
        assert got == [(k, p) for k, _, p, _ in cut(pcm, 64)]


def test_stream_gives_each_file_once(spark, folder, tmp_path):
    path, files = folder
    source = read_recordings(spark, str(path), 0.05, 5000, stream=True)

    def run():
        source.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    run()
    (path / "late.wav").write_bytes(wav_bytes(files["s3"]))
    run()
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == {k: cut(pcm, 1600) for k, pcm in [*files.items(), ("late", files["s3"])] if pcm}
    (path / "late.wav").unlink()


def test_bad_files_say_why(spark, tmp_path):
    good = wav_bytes(b"\1\0" * 100)
    (tmp_path / "slow.wav").write_bytes(wav_bytes(b"\1\0" * 100, 8000))
    (tmp_path / "text.wav").write_bytes(b"no audio at all")
    (tmp_path / "cut.wav").write_bytes(good[:30])
    (tmp_path / "short.wav").write_bytes(good[:-51])
    got = rows(read_recordings(spark, str(tmp_path), 0.001))
    assert "sample rate is 8000" in got["slow"][0][3][0] and got["text"][0][3] == ["not a WAV file"] and got["cut"][0][3] == ["no samples"]
    assert b"".join(p for _, _, p, _ in got["short"]) == good[44:-51]
    assert data_range(header(10) + b"\0" * 10, 54) == (44, 54, [])
    assert read_recordings(spark, str(tmp_path / "none")).count() == 0


def test_written_files_are_whole(spark, folder, tmp_path):
    _, files = folder
    chunks = [(name, k, bytearray(p)) for name, pcm in files.items() for k, _, p, _ in cut(pcm, 700)]
    df = spark.createDataFrame(chunks, "session string, chunk_no bigint, pcm binary").repartition(5)
    write_recordings(df, str(tmp_path / "out"))
    assert {p.stem: p.read_bytes() for p in (tmp_path / "out").rglob("*.wav")} == {k: wav_bytes(pcm) for k, pcm in files.items() if pcm}
    assert not list((tmp_path / "out").glob("_attempt*"))


def test_short_files_share_a_task(tmp_path):
    """Before, each file and each split was a task."""
    from tidelog.sources.recordings import Chunked

    for k in range(500):
        (tmp_path / f"{k}.wav").write_bytes(wav_bytes(b"\1\0" * 50))
    source = Chunked(str(tmp_path), 64, 40)
    splits = source.splits(source.listed())
    packs = source.packs(splits)
    assert len(packs) < 70 < len(splits) and [s for p in packs for s in p.splits] == splits
    assert sum(b.num_rows for p in packs for b in source.batches(p)) == 500 * 2


def test_sound_is_found_in_runs(spark):
    """silence is looked for where a chunk is read, a row a run; before, each 10 ms were a row."""
    from tidelog.sources.recordings import sounding

    loud, quiet = b"\x01\x00" * 160, b"\x00\x00" * 160
    chunks = [("a", 0, quiet + loud * 3 + quiet + loud), ("a", 960, loud[:100]), ("b", 0, quiet * 6), ("b", 960, None), ("c", 0, b"\x00\x01" + quiet)]
    rows = spark.createDataFrame([(s, b, None if p is None else bytearray(p)) for s, b, p in chunks], "session string, begin bigint, pcm binary")
    got = sorted(map(tuple, sounding(rows).collect()))
    assert got == [("a", 160, 480), ("a", 800, 160), ("a", 960, 50), ("c", 0, 160)]


def test_mixed_audio_is_made_where_it_is_written(spark, tmp_path):
    """what is shuffled are the numbers of sounds, and truth is read without a task for each session."""
    from pyspark.sql import functions as F

    from tidelog.sources import adapters, files, fixtures

    rows = [(k, t, f"s{t}", [15] * (3 + t)) for k in range(40) for t in range(2)]
    turns = spark.createDataFrame(rows, "session_id bigint, turn_idx int, speaker string, sounds array<int>")
    made = {"pcm": adapters.sound_pcm(F.col("sounds")), "samples": F.size("sounds") * 640}
    audio, _, _ = fixtures.mixed(turns, **made)
    assert "unhex" not in audio._jdf.queryExecution().optimizedPlan().toString()
    fixtures.write_mixed(turns, str(tmp_path), 2, most=0.14, **made)
    want = bytes.fromhex(adapters._wave(adapters.LOUD, 8) * 40)
    pcm = want * 3 + bytes(22_400) + (want * 4)[:4480] + bytes(22_400 + 48_000)
    assert {p.read_bytes() for p in (tmp_path / "audio").glob("*.wav")} == {header(len(pcm)) + pcm}
    sc = spark.sparkContext
    sc.setJobGroup("truth", "truth")
    back = files.read_truth_turns(spark, f"{tmp_path}/truth").collect()
    sc.setJobGroup("", "")
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("truth") for s in tracker.getJobInfo(j).stageIds]
    assert len(back) == 80 and {(r.turn_idx, r.speaker, r.start, r.end) for r in back} == {(0, "s0", 0.0, 0.12), (1, "s1", 0.82, 0.96)} and sum(tasks) < 40


def test_clips_are_made_where_they_are_written(spark, tmp_path):
    """audio of clips by an expression is made for fit clips only, behind the shuffle; files and scores are the same."""
    from pyspark.sql import functions as F

    from tidelog.plans import registry
    from tidelog.sources import fixtures
    from tidelog.streaming.models import SilenceTurns

    data = "/root/testdata/sf0.001"
    whole, late = str(tmp_path / "whole"), str(tmp_path / "late")
    assert "unhex" not in fixtures.cut_places(registry._turns_said(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    fixtures.write_pairs(registry._turn_clips(spark, data).drop("seconds"), whole, parts=2)
    fixtures.write_pairs(registry._turns_said(spark, data), late, parts=2, pcm=registry._said_pcm())
    files = lambda root: {p.name: p.read_bytes() for p in (tmp_path / root / "audio").glob("*.wav")}
    assert files("late") == files("whole") and len(files("late")) > 10
    scores = lambda root: sorted((r.stem, r.complete, r.score, r.problems) for r in fixtures.pair_scores(spark, root, "silence", SilenceTurns).collect())
    assert scores(late) == scores(whole) and all(s[2] is not None for s in scores(late))
    calls = fixtures.wav_scores_udf("silence", SilenceTurns, 1.5)
    plan = fixtures.read_files(spark, f"{late}/audio").select(calls(F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
